"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is good or bad.  A line's features are shares and sizes of its own
and of its two neighbours; the field's transitions tie the labels together.
Forward-backward gives each line's marginal, and the marginals weighted by
line length are the document's score.

Only documents have labels, so those of lines are latent: first each line has
its document's, then the lines that a fit of lines alone contradicts most take
the other one, as long as most of the document agrees with its label, and the
field is fitted on these.  So it sees bad blocks inside good documents and good
lines inside bad ones, and its transitions are learnt from these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from solvefront.llm.common import rows_of, sealed

MAX_TRAIN_ROWS = 6_000
MAX_TRAIN_BYTES = 64 << 20
MAX_TRAIN_LINES = 200_000
MAX_TEXT_BYTES = 1 << 20
MAX_TEXT_LINES = 20_000
#: Share of a document's letters that keeps its label, and how often line labels are revised.
AGREE = 0.8
REVISIONS = 2
CHAIN = 128
L2 = 1e-3
STEPS = 250
SLICE_BYTES = 1 << 20

#: Class of each byte: 1 to 8 in this order, 0 for the rest.
_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:",
    b" \t\r\x0b\x0c", bytes(range(128, 256)),
), 1):
    _CLASS[np.frombuffer(_set, np.uint8)] = _i


def own_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of the line itself, lengths, text of each line, hash of each line).  Lines with a word count; a text without any is one empty line of length 1."""
    buf = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    stops = np.nonzero(buf == 10)[0]
    starts = np.concatenate([[0], stops[:-1] + 1])
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    chars = np.add.reduceat(~blank, starts, dtype=np.int64)
    kinds = _CLASS[buf]
    sums = np.stack([np.add.reduceat(kinds == c, starts, dtype=np.int64) for c in range(1, 9)], axis=1)
    # An empty line stays only as the single line of a text without words.
    words_in = np.bincount(doc, chars, len(texts))
    first_of = np.searchsorted(doc, np.arange(len(texts)))
    keep = chars > 0
    keep[first_of[words_in == 0]] = True
    starts, stops, doc, chars, sums = starts[keep], stops[keep], doc[keep], chars[keep], sums[keep]
    n = len(starts)

    # Words: hashes by position-weighted sums of their bytes, wrapping in 64 bits.
    edge = np.diff(np.concatenate([[False], ~blank]).astype(np.int8))
    begin = np.nonzero(edge == 1)[0]
    over = np.nonzero(np.diff(np.concatenate([~blank, [False]]).astype(np.int8)) == -1)[0] + 1 if len(buf) else begin
    length = over - begin
    value = _word_hash(buf, begin, over)
    line_of = np.searchsorted(starts, begin, side="right") - 1
    n_words = np.bincount(line_of, minlength=n)
    same = np.zeros(len(begin), bool)
    same[1:] = (value[1:] == value[:-1]) & (line_of[1:] == line_of[:-1])
    pair = np.stack([line_of.astype(np.uint64), value], axis=1)
    distinct = np.unique(pair[:, 0] * np.uint64(0xD6E8FEB86659FD93) ^ pair[:, 1], return_index=True)[1]
    n_distinct = np.bincount(line_of[distinct], minlength=n)
    n_same = np.bincount(line_of, same, n)
    long_words = np.bincount(line_of, length > 20, n)

    # Lines equal to an earlier line of their text.
    total = np.zeros(n, np.uint64)
    np.add.at(total, line_of, value * (np.arange(len(value), dtype=np.uint64) - np.searchsorted(line_of, line_of).astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((np.arange(n), total, doc))
    repeat = np.zeros(n, bool)
    repeat[order[1:]] = (total[order[1:]] == total[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])

    share = sums / np.maximum(1, stops - starts)[:, None]
    w = np.maximum(1, n_words)
    own = np.column_stack([  # N_OWN columns
        np.log1p(chars), share, np.log1p(chars / w), 1 - n_distinct / w, n_same / w, repeat, long_words / w,
    ])
    return own, np.maximum(1, chars), doc, total


N_OWN = 14
REPEAT = 12  # column of the mark for lines equal to an earlier line


def with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (a line's own at the ends), and whether it is first or last."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first], after[last] = own[first], own[last]
    return np.column_stack([own, before, after, first, last]).astype(np.float64)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, lines per text)."""
    own, length, doc, _ = own_features(texts)
    edge = doc[1:] != doc[:-1]
    first = np.concatenate([[True], edge]) if len(own) else np.zeros(0, bool)
    last = np.concatenate([edge, [True]]) if len(own) else np.zeros(0, bool)
    return with_neighbours(own, first, last), length, np.bincount(doc, minlength=len(texts))


def slices(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in parts of about ``size`` bytes, cut behind line ends (a longer line is a part of its own)."""
    at = 0
    while at < len(text):
        end = text.rfind(b"\n", at, at + size) + 1 or text.find(b"\n", at + size) + 1 or len(text)
        yield text[at:end]
        at = end


def long_text_features(text: bytes, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, lengths) of one text, slice by slice, as :func:`line_features` has them for the whole."""
    seen = np.zeros(0, np.uint64)
    held: tuple[np.ndarray, np.ndarray] | None = None
    before: np.ndarray | None = None

    def done(own, length, before, after):
        rows = np.vstack([before if before is not None else own[:1], own, after if after is not None else own[-1:]])
        mark = np.zeros(len(rows), bool)
        first, last = mark.copy(), mark.copy()
        first[1], last[-2] = before is None, after is None
        return with_neighbours(rows, first, last)[1:-1], length

    for part in slices(text, size):
        if not part.strip(b" \t\n\x0b\x0c\r"):
            continue
        own, length, _, total = own_features([part])
        own[:, REPEAT] = np.maximum(own[:, REPEAT], np.isin(total, seen))
        seen = np.union1d(seen, total)
        if held is not None:
            yield done(*held, before, own[:1])
            before = held[0][-1:]
        held = own, length
    if held is None:
        held = own_features([b""])[:2]
    yield done(*held, before, None)


def _word_hash(buf: np.ndarray, begin: np.ndarray, over: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[begin:over]: per byte a random word, times an odd power for its place."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    inside = np.repeat(begin, over - begin)
    at = np.concatenate([[0], np.cumsum(over - begin)[:-1]])
    place = np.arange(len(inside)) - np.repeat(at, over - begin)
    mixed = _BYTE[buf[inside + place]] * (_POWER[place % len(_POWER)] + (place // len(_POWER)).astype(np.uint64) * np.uint64(2))
    out = np.add.reduceat(mixed, at)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.random.default_rng(11).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def _chains(sizes: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each chain; chains over ``longest`` are cut (for fitting only)."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    if longest is None:
        return starts, sizes
    cuts = -(-sizes // longest)
    of = np.repeat(np.arange(len(sizes)), cuts)
    k = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(cuts)[:-1]]), cuts)
    return starts[of] + k * longest, np.minimum(longest, sizes[of] - k * longest)


def forward_backward(score: np.ndarray, trans: np.ndarray, starts: np.ndarray, sizes: np.ndarray, *, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals per line (n x 2), expected transitions (2 x 2, zero without ``pairs``), and the sum of ln Z.

    All chains advance together, longest first, so step t works on those that reach it.
    """
    order = np.argsort(-sizes, kind="stable")
    s, z = starts[order], sizes[order]
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[s] = score[s]
    longest = int(z[0]) if len(z) else 0
    active = [int(np.searchsorted(-z, -t, side="left")) for t in range(longest + 1)]  # chains longer than t
    for t in range(1, longest):
        at = s[: active[t]] + t
        prev = alpha[at - 1]
        alpha[at] = score[at] + np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
    for t in range(longest - 2, -1, -1):
        at = s[: active[t + 1]] + t
        nxt = score[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
    ends = s + z - 1
    log_z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    per_line = np.empty(len(score))
    per_line[np.repeat(s, z) + (np.arange(int(z.sum())) - np.repeat(np.concatenate([[0], np.cumsum(z)[:-1]]), z))] = np.repeat(log_z, z)
    marginal = np.exp(alpha + beta - per_line[:, None])
    if not pairs:
        return marginal, np.zeros((2, 2)), float(log_z.sum())
    inner = np.ones(len(score), bool)
    inner[s] = False
    at = np.nonzero(inner)[0]
    pair = np.exp(alpha[at - 1][:, :, None] + trans[None] + (score[at] + beta[at])[:, None, :] - per_line[at][:, None, None])
    return marginal, pair.sum(axis=0), float(log_z.sum())


@dataclass
class LineField:
    """Weights of the field: state scores are x @ weight (bad, good)."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    trans: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([z, np.ones(len(z))])

    @classmethod
    def fit(cls, x: np.ndarray, sizes: np.ndarray, label: np.ndarray, length: np.ndarray | None = None, *, l2: float = L2, steps: int = STEPS, chain: int = CHAIN, revisions: int = REVISIONS, agree: float = AGREE) -> LineField:
        """Label every line as its document, revise by a fit of each line alone, and fit the field on the labels found.  Starts at zero: no randomness."""
        columns = range(x.shape[1])
        mean = x.mean(axis=0, dtype=np.float64)
        field = cls(mean, np.maximum([x[:, j].std(dtype=np.float64) for j in columns], 1e-6), np.zeros((len(mean) + 1, 2)), np.zeros((2, 2)))
        # In single precision and column by column: four bytes a feature, and no copy of all of them.
        z = np.ones((len(x), len(mean) + 1), np.float32, order="F")
        for j in columns:
            z[:, j] = np.clip((x[:, j] - field.mean[j]) / field.scale[j], -6, 6)
        length = np.ones(len(x)) if length is None else length.astype(np.float64)
        y = np.repeat(label, sizes)
        # A line's own columns only, the constant among them: its neighbours, which have its document's label too, would speak for it.
        own = z[:, :N_OWN]
        alone = cls(field.mean[:N_OWN], field.scale[:N_OWN], np.zeros((N_OWN + 1, 2)), np.zeros((2, 2)))
        for _ in range(revisions):
            alone._climb(own, y, sizes, l2, steps // 2, 1)
            y = revised(alone._scores(own), sizes, label, length, agree)
        field._climb(z[:, :-1], y, sizes, l2, steps, chain)
        return field

    def _scores(self, z: np.ndarray) -> np.ndarray:
        """State scores of standardised features (without the constant, whose weight is the last), in double precision."""
        return (z @ self.weight[:-1].astype(np.float32)).astype(np.float64) + self.weight[-1]

    def _climb(self, z: np.ndarray, y: np.ndarray, sizes: np.ndarray, l2: float, steps: int, chain: int) -> None:
        """Full-batch Adam on the penalised mean log-likelihood of line labels."""
        starts, lengths = _chains(sizes, chain)
        truth = np.zeros((len(y), 2))
        truth[np.arange(len(y)), y] = 1
        inner = np.ones(len(y), bool)
        inner[starts] = False
        at = np.nonzero(inner)[0]
        real = np.zeros((2, 2))
        np.add.at(real, (y[at - 1], y[at]), 1)
        theta = np.concatenate([self.weight.ravel(), self.trans.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            self.weight, self.trans = theta[:-4].reshape(self.weight.shape), theta[-4:].reshape(2, 2)
            scores = self._scores(z)
            if chain == 1:
                marginal, pair = np.exp(scores - np.logaddexp(scores[:, :1], scores[:, 1:])), np.zeros((2, 2))
            else:
                marginal, pair, _ = forward_backward(scores, self.trans, starts, lengths)
            off = truth - marginal
            slope = np.concatenate([(z.T @ off.astype(np.float32)).ravel(), off.sum(axis=0), (real - pair).ravel()]) / len(starts) - l2 * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weight, self.trans = theta[:-4].reshape(self.weight.shape), theta[-4:].reshape(2, 2)

    def marginals(self, text: bytes, size: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """(probability of good, length) of each line of one text of any length.

        Features are made slice by slice; what stays is a few numbers a line.
        """
        parts = [(self.inputs(x) @ self.weight, length) for x, length in long_text_features(text, size)]
        scores, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        marginal, _, _ = forward_backward(scores, self.trans, np.zeros(1, np.int64), np.array([len(scores)]), pairs=False)
        return marginal[:, 1], length

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted marginal of good of each text."""
        out = np.zeros(len(texts))
        short = [i for i, t in enumerate(texts) if len(t) <= SLICE_BYTES]
        for i in set(range(len(texts))).difference(short):
            good, length = self.marginals(texts[i])
            out[i] = (good * length).sum() / length.sum()
        if short:
            x, length, sizes = line_features([texts[i] for i in short])
            starts, sizes = _chains(sizes)
            marginal, _, _ = forward_backward(self.inputs(x) @ self.weight, self.trans, starts, sizes, pairs=False)
            out[short] = np.add.reduceat(marginal[:, 1] * length, starts) / np.add.reduceat(length.astype(np.float64), starts)
        return np.clip(out, 0.0, 1.0)


def revised(scores: np.ndarray, sizes: np.ndarray, label: np.ndarray, length: np.ndarray, agree: float) -> np.ndarray:
    """Line labels: the document's, but the other one for lines whose own scores say so, most certain first, while ``agree`` of the length keeps the document's."""
    y = np.repeat(label, sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    against = (scores[:, 1] - scores[:, 0]) * np.where(y == 1, -1, 1)
    order = np.lexsort((np.arange(len(y)), -against, doc))
    used = np.cumsum(length[order])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    before = np.repeat(np.concatenate([[0.0], used[np.cumsum(sizes)[:-1] - 1]]), sizes)
    total = np.repeat(np.add.reduceat(length, starts), sizes)
    turn = order[(against[order] > 0) & (used - before <= (1 - agree) * total)]
    y[turn] = 1 - y[turn]
    return y


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", *, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES, max_lines: int = MAX_TRAIN_LINES, max_text: int = MAX_TEXT_BYTES, max_text_lines: int = MAX_TEXT_LINES) -> LineField | None:
    """Fit on at most ``max_rows`` labelled documents, ``max_bytes`` of text and ``max_lines`` lines; None without both labels.

    Documents are taken whole, in the order of a hash of their key, until
    one of the bounds is met; labelled texts above ``max_text`` bytes or
    ``max_text_lines`` lines are passed over (they are scored like any other).
    The lines bound the driver's memory, whatever their length.  The order and the bounds are found
    on keys and lengths; only then are the chosen texts read.  Labels that are
    null or not 0 or 1 are left out; of repeated keys the least label and the
    text of the least hash count.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_y"))
    whole = F.coalesce(F.col(text), F.lit(""))
    n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    plain = docs.select(F.col(key).alias("_key"), F.encode(whole, "UTF-8").alias("_t"), n_lines.alias("_lines"))
    hashed = plain.withColumns({"_n": F.length("_t"), "_text": F.xxhash64("_t")})
    one = hashed.where((F.col("_n") <= max_text) & (F.col("_lines") <= max_text_lines)).groupBy("_key").agg(F.min(F.struct("_text", "_n", "_lines")).alias("_one"))
    known = one.join(usable, "_key").select("_key", "_one.*", "_y", F.xxhash64(F.col("_key"), F.lit("crf")).alias("_h"))
    first = known.orderBy("_h", "_key").limit(max_rows)
    ahead = W.orderBy("_h", "_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = (F.col("_used") <= max_bytes) & (F.col("_used_lines") <= max_lines)
    chosen = first.withColumns({"_used": F.sum("_n").over(ahead), "_used_lines": F.sum("_lines").over(ahead)}).where(within).select("_key", "_text", "_y", "_h")
    got = hashed.join(F.broadcast(chosen), ["_key", "_text"]).dropDuplicates(["_key"]).select("_h", "_t", "_y").toArrow()
    y = got.column("_y").to_numpy().astype(np.int64) if got.num_rows else np.zeros(0, np.int64)
    if len(np.unique(y)) < 2:
        return None
    order = np.lexsort((got.column("_h").to_numpy(), pc.binary_length(got.column("_t")).to_numpy(), y))
    parts, pending, used = [], [], 0
    for k, i in enumerate(order):
        pending.append(got.column("_t")[int(i)].as_py())
        used += len(pending[-1])
        if used >= SLICE_BYTES or k == len(order) - 1:
            x, length, sizes = line_features(pending)
            parts.append((x.astype(np.float32), length, sizes))
            pending, used = [], 0
    del got
    x, length, sizes = (np.concatenate([p[i] for p in parts]) for i in range(3))
    del parts
    return LineField.fit(x, sizes, y[order], length)


def keep_good(spark: SparkSession, df: DataFrame, field: LineField | None, text: str = "text", *, threshold: float) -> DataFrame:
    """The rows of ``df`` that score ``threshold`` or more, with columns of any name as they were; all of them without a field."""
    if field is None:
        return df
    box = sealed(df)
    return box.open(score(spark, box.df, field, box.name(text), threshold=threshold).where("predicted = 1"))


def score(spark: SparkSession, df: DataFrame, field: LineField | None, text: str = "text", *, threshold: float = 0.7) -> DataFrame:
    """Add score and predicted (1 from ``threshold`` on).

    Null and empty texts are one empty line.  Without a field every score is
    0.5.  Whole texts, in the scan's partitions, in slices of bounded bytes;
    columns of these names are replaced.
    """
    rest = [c for c in df.columns if c not in ("score", "predicted")]
    sent = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, text, SLICE_BYTES):
            texts = [t or b"" for t in b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
            got = sent.value.score(texts) if sent.value else np.full(len(texts), 0.5)
            keep = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[*rest, "score", "predicted"])

    return df.select(rest).mapInArrow(run, df.select(rest).schema.add("score", "double").add("predicted", "integer"))
