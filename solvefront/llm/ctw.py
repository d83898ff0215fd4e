"""LM scoring: context-tree weighting over bytes, each byte as eight binary decisions.

Every context of up to ``depth`` bytes holds, for each of the 255 inner nodes
of the byte's binary decomposition, counts of zeros and ones.  A node's
Krichevsky-Trofimov estimate is mixed half and half with the product of its
children, down the tree; as the estimate of a block depends on counts alone,
the weights of the whole corpus follow from its (depth + 1)-byte counts.

Contexts seen ``min_count`` times or more are kept, however many there are; a
node's other children are one more child, which pools them.  The tree is never
in one place: grams are dealt by the latest ``SPLIT`` bytes of their context
and sorted, so each task holds whole subtrees and sums their block weights; the
levels above (as many contexts as pairs of bytes occur) are mixed on the driver
and broadcast.  Each distinct gram is scored once, and texts meet the scores of
their grams batch by batch.

Texts are scored with the frozen predictive mixture.  Each text starts after
``depth`` separators (byte 255, which UTF-8 never uses) and ends with one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.llm.common import rows_of, stage, unstage

DEPTH = 5
MIN_COUNT = 2
#: Levels from here down are built where the grams are.
SPLIT = 3
TOP_SHARE = 2.0**-17
SEPARATOR = 255
SLICE_BYTES = 2 << 20
BATCH_BYTES = 32 << 20
CHUNK = 200_000
FLUSH = 150_000
HELD_GRAMS = 1_500_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _bytes(col: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.translate(_LOWER) for t in col.cast(pa.binary()).to_pylist()]


def _stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with separators as one array, the positions to predict, and each text's first of those."""
    pad, end = bytes([SEPARATOR]) * depth, bytes([SEPARATOR])
    buf = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(texts) + 1) * depth, sizes)
    return buf, at, starts


def _codes(buf: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """(depth + 1)-byte grams as integers: the context's latest byte highest, the symbol lowest."""
    every = np.zeros(len(buf) - depth, np.int64)  # of all positions, so that nothing is gathered but the codes asked for
    for d in [*range(1, depth + 1), 0]:
        every <<= 8
        every |= buf[depth - d : len(buf) - d]
    return every[at - depth]


def _pieces(texts: list[bytes], depth: int, size: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram codes, text of each) of texts in order, up to about ``size`` positions at a time: a long text goes in parts, whose contexts overlap."""
    held: list[int] = []
    used = 0

    def together(some: list[int]) -> tuple[np.ndarray, np.ndarray]:
        buf, at, starts = _stream([texts[i] for i in some], depth)
        return _codes(buf, at, depth), np.repeat(np.array(some), np.diff(np.concatenate([starts, [len(at)]])))

    for i, t in enumerate(texts):
        if used + len(t) + 1 > size and held:
            yield together(held)
            held, used = [], 0
        if len(t) < size:
            held.append(i)
            used += len(t) + 1
            continue
        whole = bytes([SEPARATOR]) * depth + t + bytes([SEPARATOR])
        for lo in range(0, len(t) + 1, size):
            buf = np.frombuffer(whole[lo : lo + size + depth], np.uint8)
            codes = _codes(buf, np.arange(depth, len(buf)), depth)
            yield codes, np.full(len(codes), i)
    if held:
        yield together(held)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Partial counts (word, c): words as bytes, an empty word per text end; the caller adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def put():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

        for b in rows_of(batches, text, SLICE_BYTES):
            for t in _bytes(b.column(0)):
                found.update(t.split())
                found[b""] += 1
                if len(found) > FLUSH:
                    yield put()
                    found.clear()
        if found:
            yield put()

    return df.select(text).mapInArrow(run, "word binary, c long")


def batched(df: DataFrame, is_training: Column, key: str, text: str) -> DataFrame:
    """(batch, uid, key, text, train): rows numbered, in batches of about ``BATCH_BYTES``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 40
        uid, used = start, 0
        for b in rows_of(batches, "text", SLICE_BYTES):
            n = b.num_rows
            batch = start + used // BATCH_BYTES
            used += b.column(1).nbytes
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch)), pa.array(np.arange(uid, uid + n)), *b.columns], names=["batch", "uid", "key", "text", "train"])
            uid += n

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(is_training, F.lit(False)).alias("train"))
    return rows.mapInArrow(run, f"batch long, uid long, key {kind}, text string, train boolean")


def batch_grams(rows: DataFrame, depth: int) -> DataFrame:
    """(batch, code, n): all grams of a batch with their counts in training texts (0 if only others hold them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def put():
            codes, counts = merge_counts(held)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), now)), pa.array(codes), pa.array(counts)], names=["batch", "code", "n"])

        for b in rows_of(batches, "text", SLICE_BYTES):
            ids = b.column(0).to_numpy()
            for lo, hi in zip(cuts := [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)], cuts[1:]):
                if held and ids[lo] != now:
                    yield put()
                    held, size = [], 0
                now = ids[lo]
                part = b.slice(lo, hi - lo)
                train = part.column(2).to_numpy(zero_copy_only=False)
                texts = _bytes(part.column(1))
                for use in (True, False):
                    chosen = [t for t, x in zip(texts, train, strict=True) if x == use]
                    for found, _ in _pieces(chosen, depth):
                        codes, counts = np.unique(found, return_counts=True)
                        held.append((codes, counts if use else np.zeros(len(codes), np.int64)))
                        size += len(codes)
                if size > 2 * HELD_GRAMS:
                    held = [merge_counts(held)]
                    size = len(held[0][0])
                    if size > HELD_GRAMS:
                        yield put()
                        held, size = [], 0
        if held:
            yield put()

    return rows.select("batch", "text", "train").mapInArrow(run, "batch long, code long, n long")


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts summed by code."""
    codes, counts = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.nonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))[0] if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series after shifting x up by 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def decompose(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 inner nodes of the byte's binary tree, from counts of the 256 symbols."""
    sums = [counts]
    while sums[-1].shape[1] > 1:
        sums.append(sums[-1][:, 0::2] + sums[-1][:, 1::2])
    levels = sums[-2::-1]
    return np.concatenate([x[:, 0::2] for x in levels], axis=1), np.concatenate([x[:, 1::2] for x in levels], axis=1)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a block with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1)


def symbol_logs(p_one: np.ndarray) -> np.ndarray:
    """ln probability of each of the 256 symbols from the probabilities of a one at the 255 inner nodes."""
    out = np.zeros((len(p_one), 1))
    at = 0
    for level in range(8):
        p = p_one[:, at : at + (1 << level)]
        out = np.stack([out + np.log1p(-p), out + np.log(p)], axis=2).reshape(len(p_one), -1)
        at += 1 << level
    return out


class GramTable:
    """Open addressing from gram codes to values; every code asked for must be there."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        size = 1 << max(4, math.ceil(math.log2(2 * len(codes) + 1)))
        self.shift, self.code, self.value = np.uint64(64 - int(math.log2(size))), np.full(size, -1, np.int64), np.zeros(size)
        slot, left = self._slots(codes), np.arange(len(codes))
        while len(left):
            free = self.code[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.code[slot[first]], self.value[slot[first]] = codes[left[first]], values[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slots(codes)
        out = self.value[slot]
        left = np.flatnonzero(self.code[slot] != codes)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.code) - 1)
            at = self.code[slot]
            if (at < 0).any():
                raise KeyError("a gram that was not counted")
            out[left] = self.value[slot]
            again = at != codes[left]
            left, slot = left[again], slot[again]
        return out


@dataclass
class ContextTree:
    """The frozen predictive tree in one place, for small counts: ``step[node, byte]`` leads to the child, leaves to themselves; ``logs[node, symbol]`` is ln p at a leaf."""

    depth: int
    step: np.ndarray
    logs: np.ndarray

    @classmethod
    def fit(cls, counts: list[dict[int, np.ndarray]]) -> ContextTree:
        """counts[d]: kept context of d bytes (latest byte lowest) to its 256 symbol counts; counts[0] is {0: all}."""
        depth = len(counts) - 1
        kept: list[tuple[int, int]] = [(d, c) for d in range(depth + 1) for c in sorted(counts[d])]
        ids = {x: i for i, x in enumerate(kept)}
        children: list[list[int]] = [[] for _ in kept]
        for (d, c), i in ids.items():
            if d:
                children[ids[d - 1, c & ((1 << 8 * (d - 1)) - 1)]].append(i)
        tables = [counts[d][c] for d, c in kept]
        rest = {}  # the pooled child of each node with children
        for i in range(len(kept)):
            if children[i]:
                rest[i] = len(tables)
                tables.append(tables[i] - np.sum([tables[j] for j in children[i]], axis=0))
        table = np.array(tables, np.float64)
        del tables
        kt = np.concatenate([log_kt(*decompose(table[at : at + 2048])) for at in range(0, len(table), 2048)])
        block = kt.copy()
        stay = {}
        for i in range(len(kept) - 1, -1, -1):  # deeper contexts come later
            if children[i]:
                split = block[rest[i]] + block[children[i]].sum(axis=0)
                block[i] = np.logaddexp(kt[i], split) - math.log(2)
                stay[i] = 1 / (1 + np.exp(np.clip(split - kt[i], -700, 700)))
        del kt, block
        step = np.repeat(np.arange(len(table), dtype=np.int32)[:, None], 256, axis=1)
        logs = np.zeros((len(table), 256), np.float32)

        def estimate(i: int) -> np.ndarray:
            zeros, ones = decompose(table[i : i + 1])
            return ((ones + 0.5) / (zeros + ones + 1))[0]

        def leaf(i: int, done: np.ndarray, left: np.ndarray) -> None:
            logs[i] = symbol_logs(np.clip(done + left * estimate(i), 1e-12, 1 - 1e-12)[None])[0]

        mixed = {0: (np.zeros(255), np.ones(255))}
        for i in range(len(kept)):
            done, left = mixed.pop(i)
            if not children[i]:
                leaf(i, done, left)
                continue
            done, left = done + left * stay[i] * estimate(i), left * (1 - stay.pop(i))
            leaf(rest[i], done, left)
            step[i] = rest[i]
            for j in children[i]:
                mixed[j] = (done, left)
                step[i, kept[j][1] >> 8 * (kept[j][0] - 1)] = j
        return cls(depth, step, logs)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """ln probability of each text with its end."""
        buf, at, starts = _stream(texts, self.depth)
        if not len(texts):
            return np.zeros(0)
        step, logs = self.step.ravel(), self.logs.ravel()
        out = np.empty(len(at))
        for lo in range(0, len(at), 1 << 18):
            part = at[lo : lo + (1 << 18)]
            node = np.zeros(len(part), np.int32)
            for d in range(1, self.depth + 1):
                node = step[(node << 8) + buf[part - d]]
            out[lo : lo + len(part)] = logs[(node << 8) + buf[part]]
        return np.add.reduceat(out, starts)


def _entries(ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's group among equal ids, and each group's first row; ``order`` sorts the ids."""
    ordered = ids[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.empty(len(ids), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def _mix(zeros: np.ndarray, ones: np.ndarray, kept_zeros: np.ndarray, kept_ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From counts, those of kept children and their summed block weights: block weight, share of the own estimate, estimate of the pooled child."""
    rest = zeros - kept_zeros, ones - kept_ones
    own, split = log_kt(zeros, ones), below + log_kt(*rest)
    return np.logaddexp(own, split) - math.log(2), 1 / (1 + np.exp(np.clip(split - own, -700, 700))), _estimate(*rest)


def _subtrees(code: np.ndarray, n: np.ndarray, depth: int, low: int, min_count: int, above=None):
    """Whole subtrees from level ``low`` down; ``code`` is sorted and unique.

    Without ``above``: per entry (context of ``low - 1`` bytes * 256 + node) its
    zeros, ones, those of kept children and their summed block weights.  With
    ``above`` (entry ids, probability so far, weight left, pooled estimate): ln
    p of each row's symbol.  The eight levels of the byte's decision tree do not
    meet, so each is done alone; a node is 1 and the byte's leading bits.
    """
    sym = code & 255
    levels = range(low, depth + 1)
    rows = np.arange(len(code))
    orders, kept = {}, {}
    for d in levels:
        ctx = code >> 8 * (depth + 1 - d)
        orders[d] = rows if d == depth else np.argsort((ctx << 8) | sym, kind="stable")
        group, _ = _entries(ctx, rows)
        kept[d] = np.bincount(group, n)[group] >= min_count
    top = code >> 8 * (depth + 2 - low)
    top_order = np.argsort((top << 8) | sym, kind="stable")
    logs, out = np.zeros(len(code)), []
    for level in range(8):
        node = (1 << level) | (sym >> (8 - level))
        one = (sym >> (7 - level)) & 1 == 1
        made = {}

        def gather(group, size, d):
            """Counts and block weights of the kept entries of level d by the group their first rows are in."""
            g, first, zeros, ones, weight = made[d][:5]
            live = kept[d][first]
            return [np.bincount(group[first], np.where(live, x, 0.0), size) for x in (zeros, ones, weight)]

        for d in reversed(levels):
            group, first = _entries(((code >> 8 * (depth + 1 - d)) << 8) | node, orders[d])
            zeros, ones = np.bincount(group, np.where(one, 0, n), len(first)), np.bincount(group, np.where(one, n, 0), len(first))
            if d == depth:
                made[d] = (group, first, zeros, ones, log_kt(zeros, ones), None, None)
            else:
                made[d] = (group, first, zeros, ones, *_mix(zeros, ones, *gather(group, len(first), d + 1)))
        if above is None:
            ids = (top << 8) | node
            group, first = _entries(ids, top_order)
            zeros, ones = np.bincount(group, np.where(one, 0, n), len(first)), np.bincount(group, np.where(one, n, 0), len(first))
            out.append((ids[first], zeros, ones, *gather(group, len(first), low)))
            continue
        i = np.searchsorted(above[0], (top << 8) | node)
        done, left, rest = (x[i] for x in above[1:])
        p, going = np.empty(len(code)), np.ones(len(code), bool)
        for d in levels:
            stop = going & ~kept[d]
            p[stop] = (done + left * rest)[stop]
            going &= kept[d]
            group, _, zeros, ones, _, stay, pooled = made[d]
            own = _estimate(zeros, ones)[group]
            if d == depth:
                p[going] = (done + left * own)[going]
            else:
                done, left, rest = done + left * stay[group] * own, left * (1 - stay[group]), pooled[group]
        logs += np.log(np.clip(np.where(one, p, 1 - p), 1e-12, 1))
    return logs if above is not None else [np.concatenate(x) for x in zip(*out)]


def _chunks(batches: Iterator[pa.RecordBatch], depth: int, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (code, n) in arrays of ``CHUNK`` rows or more, cut between contexts of ``low`` bytes."""
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, want = 0, CHUNK
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size < want:
            continue
        code, n = (np.concatenate(x) for x in zip(*held))
        ctx = code >> 8 * (depth + 1 - low)
        cut = int(np.searchsorted(ctx, ctx[-1]))
        if cut:
            yield code[:cut], n[:cut]
        held = [(code[cut:], n[cut:])]
        size = len(code) - cut
        want = max(CHUNK, 2 * size)
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _upper_levels(ids, zeros, ones, kept_zeros, kept_ones, below, low: int, min_count: int):
    """Mix the levels above ``low``: entry ids of level low - 1, probability so far, weight left, estimate of the pooled child."""
    made = []
    for d in range(low - 1, -1, -1):
        weight, stay, pooled = _mix(zeros, ones, kept_zeros, kept_ones, below)
        root = ids & 255 == 1
        seen = (zeros + ones)[root]
        live = seen[np.searchsorted((ids >> 8)[root], ids >> 8)] >= min_count if d else np.ones(len(ids), bool)
        up = ((ids >> 16) << 8) | (ids & 255)
        made.append((ids, zeros, ones, stay, pooled, live, up))
        ids, parent = np.unique(up, return_inverse=True)
        total = lambda x, on=None: np.bincount(parent, x if on is None else np.where(on, x, 0.0), len(ids))  # noqa: E731, B023
        zeros, ones, kept_zeros, kept_ones, below = total(zeros), total(ones), total(zeros, live), total(ones, live), total(weight, live)
    at = None
    for ids, zeros, ones, stay, pooled, live, up in reversed(made):
        if at is None:
            done, left, rest = np.zeros(len(ids)), np.ones(len(ids)), pooled
        else:
            i = np.searchsorted(at[0], up)
            done, left, rest = (x[i] for x in at[1:])
        at = (
            ids, np.where(live, done + left * stay * _estimate(zeros, ones), done + left * rest),
            np.where(live, left * (1 - stay), 0.0), pooled,
        )
    return at


def gram_logs(spark: SparkSession, grams: DataFrame, *, depth: int = DEPTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(code, ln_p): the predictive mixture at each gram, from staged (code, n); n may be 0.

    Twice over the same sorted grams: bottom-up to what the upper levels need,
    which is at most 255 rows a pair of bytes, and top-down from their result.
    """
    low = min(SPLIT, depth)

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _chunks(batches, depth, low):
            found = _subtrees(code, n, depth, low, min_count)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "zeros", "ones", "kept_zeros", "kept_ones", "below"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _chunks(batches, depth, low):
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(_subtrees(code, n, depth, low, min_count, above.value))], names=["code", "ln_p"])

    dealt = grams.select("code", "n").repartition(F.shiftright("code", 8 * (depth + 1 - low))).sortWithinPartitions("code")
    sums = ["zeros", "ones", "kept_zeros", "kept_ones", "below"]
    parts = dealt.mapInArrow(up, "id long, zeros double, ones double, kept_zeros double, kept_ones double, below double")
    table = parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in sums]).toArrow().sort_by("id")
    upper = [table.column(c).to_numpy() for c in ["id", *sums]]
    above = spark.sparkContext.broadcast(_upper_levels(*upper, low, min_count) if len(upper[0]) else None)
    return dealt.mapInArrow(down, "code long, ln_p double")


def score_corpus(spark: SparkSession, df: DataFrame, is_training: Column, key: str = "doc_id", text: str = "text", *, depth: int = DEPTH, min_count: int = MIN_COUNT, top_share: float = TOP_SHARE) -> DataFrame:
    """Add n_bytes, score (log10), bits_per_byte, and the smoothed word unigram base: n_tokens, n_known, train_tokens, base_score.

    A-Z count as lower case.  Null texts are empty: one end token.  Words that
    make up ``top_share`` of the training tokens (so 1 / top_share words at
    most) are looked up where the text is; the long tail is joined by word,
    with pre-summed counts per text, so no key is hot.  Without training rows
    the tree predicts evenly and every word is unknown.  Repeated rows are
    scored each; an empty table stays empty; a null key is as good as any.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth is 1 to 6: a gram of depth + 1 bytes must fit a signed 64-bit integer")
    rows = stage(spark, batched(df, is_training, key, text), "batched")
    held = stage(spark, batch_grams(rows, depth), "batch-grams")
    grams = stage(spark, held.groupBy("code").agg(F.sum("n").alias("n")), "grams")
    logs_of = stage(spark, gram_logs(spark, grams, depth=depth, min_count=min_count), "gram-logs")
    unstage(spark, grams)
    looked_up = stage(spark, held.select("batch", "code").join(logs_of, "code"), "looked-up")
    unstage(spark, held, logs_of)
    vocabulary = stage(spark, word_counts(rows.where("train")).groupBy("word").agg(F.sum("c").alias("c")), "words")
    tokens, types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = vocabulary.where(F.col("c") >= F.lit(max(1.0, tokens * top_share)))
    listed = frequent.toArrow()
    top = dict(zip(listed.column("word").to_pylist(), listed.column("c").to_pylist(), strict=True))
    known_words = spark.sparkContext.broadcast(top)
    kind = df.schema[key].dataType.simpleString()
    schema = f"uid long, `{key}` {kind}, n_bytes long, score double, n_tokens long, _known long, _base double, words array<binary>, counts array<long>"

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        logs = {w: math.log10(c + 0.5) for w, c in known_words.value.items()}
        table = GramTable(found.column("code").to_numpy(), found.column("ln_p").to_numpy())
        del found
        out = []
        for b in rows_of(iter(docs.select(["uid", "key", "text"]).to_batches()), "text", SLICE_BYTES):
            texts = _bytes(b.column(2))
            scores = np.zeros(len(texts))
            for wanted, owner in _pieces(texts, depth):
                scores += np.bincount(owner, table.find(wanted), len(texts))
            n_tokens, n_known, base, rest, rest_n = [], [], [], [], []
            for t in texts:
                words = Counter(t.split())
                words[b""] += 1
                far, far_n, known, sum_ = [], [], 0, 0.0
                for w, n in words.items():
                    if (log := logs.get(w)) is None:
                        far.append(w)
                        far_n.append(n)
                    else:
                        known += n
                        sum_ += n * log
                n_tokens.append(words.total())
                n_known.append(known)
                base.append(sum_)
                rest.append(far)
                rest_n.append(far_n)
            out.append(pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(scores / math.log(10)), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(rest, pa.list_(pa.binary())), pa.array(rest_n, pa.list_(pa.int64()))],
                names=["uid", key, "n_bytes", "score", "n_tokens", "_known", "_base", "words", "counts"],
            ))
        return pa.Table.from_batches(out)

    scored = stage(spark, rows.groupBy("batch").cogroup(looked_up.groupBy("batch")).applyInArrow(score, schema), "scored")
    unstage(spark, rows, looked_up)
    tail = scored.select("uid", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    joined = tail.join(vocabulary, "word", "left")
    sums = joined.groupBy("uid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("_far"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("_logs"),
    )
    space = F.log10(F.lit(tokens + 0.5 * (types + 1)))
    out = scored.drop("words", "counts").join(sums, "uid", "left")
    return out.select(
        key, "n_bytes", "score", (F.col("score") * F.lit(-math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"), "n_tokens",
        (F.col("_known") + F.coalesce("_far", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * space).alias("base_score"),
    )
