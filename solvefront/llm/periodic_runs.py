"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of words with smallest period q, of length at least
``max(min_length, min_exponent * q)``, that no neighbouring word extends.  A
run overlaps itself, moved by q, in at least k words, where k is the least
``max(min_length, min_exponent * q) - q`` over all q; so each of its words lies in a
k-word window that occurs again in the document.  Words outside such windows
are masked; runs lie within the unmasked segments.

Segments are divided at their middles.  A run that crosses a middle has two
adjacent equal blocks of its period before it or after it, and its ends are
what common extensions of the two blocks to both sides reach (Main and
Lorentz, 1984).  Blocks and extensions are compared by fingerprints, for all
segments of a batch and all periods of a level at once; every run found is then
compared word by word, and a batch in which one fails is worked again with
another base, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvefront.llm.common import WORD_PATTERN, let, rows_of, sealed

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Texts of a batch that are worked together.
BATCH_BYTES = 4 << 20
#: Periods are looked for in these ranges in turn; what a short one explains at a middle is left out of the next.
PERIODS = ((1, 4), (5, 64), (65, None))
#: Candidate pairs (middle, period) worked at once.
CANDIDATES = 1 << 19
PRIME = np.uint64((1 << 31) - 1)
RUNS = "array<struct<start: long, length: long, period: long>>"


def overlap(min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> int:
    """k: the fewest words that a run shares with itself moved by its period."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))


class Fingerprints:
    """Polynomial fingerprints of all stretches of a sequence of small integers."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        powers = np.ones(n + 1, np.uint64)
        done, step = 1, np.uint64(base)
        while done <= n:  # powers[done:2 done] are the first ones times base^done
            m = min(done, n + 1 - done)
            powers[done : done + m] = powers[:m] * step % PRIME
            done += m
            step = step * step % PRIME
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((words.astype(np.uint64) + np.uint64(1)) * powers[:n] % PRIME, out=sums[1:])
        self.powers, self.sums = powers, sums % PRIME

    def equal(self, at: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretch of ``length`` from ``at`` equals the one ``shift`` later."""
        here = (self.sums[at + length] + PRIME - self.sums[at]) % PRIME
        there = (self.sums[at + shift + length] + PRIME - self.sums[at + shift]) % PRIME
        return here * self.powers[shift] % PRIME == there

    def forward(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words, ``most`` at most, that agree from ``at`` and ``at + shift`` on."""
        found = np.zeros(len(at), np.int64)
        step = 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
        while step and len(at):
            i = np.flatnonzero(found + step <= most)
            ok = i[self.equal(at[i] + found[i], shift[i], np.full(len(i), step))]
            found[ok] += step
            step >>= 1
        return found

    def backward(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words, ``most`` at most, that agree before ``at`` and ``at + shift``."""
        found = np.zeros(len(at), np.int64)
        step = 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
        while step and len(at):
            i = np.flatnonzero(found + step <= most)
            ok = i[self.equal(at[i] - found[i] - step, shift[i], np.full(len(i), step))]
            found[ok] += step
            step >>= 1
        return found


def surviving(words: np.ndarray, bounds: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends): stretches of at least ``least`` words, each of which lies in a k-word window found again in its document.

    ``bounds`` are the documents' ends in ``words``, from 0 on.  Windows are
    compared by a 64-bit hash; equal hashes of unequal windows would only leave more.
    """
    n = len(words)
    sizes = np.diff(bounds)
    starts_of = np.repeat(bounds[:-1], np.maximum(sizes - k + 1, 0))
    first = np.cumsum(np.maximum(sizes - k + 1, 0))
    at = starts_of + np.arange(len(starts_of)) - np.repeat(first - np.maximum(sizes - k + 1, 0), np.maximum(sizes - k + 1, 0))
    h = np.repeat(np.arange(len(sizes), dtype=np.uint64), np.maximum(sizes - k + 1, 0)) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        h = (h ^ words[at + i].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + k, -1)
    covered = np.concatenate([[False], np.cumsum(edge[:n]) > 0, [False]])
    # A document's end ends a stretch too.
    change = covered[1:] != covered[:-1]
    inner = bounds[1:-1]
    both = inner[covered[inner] & covered[inner + 1]]
    starts = np.sort(np.concatenate([np.flatnonzero(change & covered[1:]), both]))
    ends = np.sort(np.concatenate([np.flatnonzero(change & covered[:-1]), both]))
    enough = ends - starts >= least
    return starts[enough], ends[enough]


def _spread(middle: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block, period) pairs with low <= period <= high, some at a time."""
    counts = np.maximum(high - low + 1, 0)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, CANDIDATES):
        place = np.arange(a, min(a + CANDIDATES, total))
        block = np.searchsorted(ends, place, side="right")
        yield block, low[block] + place - (ends[block] - counts[block])


def main_lorentz(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int, min_exponent: int, base: int) -> np.ndarray:
    """Rows (start, end, period), distinct, of the runs within the given stretches; by fingerprints."""
    prints = Fingerprints(words, base)
    found = [np.empty((0, 3), np.int64)]
    lo, hi, a, z = starts, ends, starts, ends  # the parts of this level, and the stretches they lie in
    while len(lo):
        mid, longest = (lo + hi) // 2, (hi - lo) // min_exponent
        for side in (-1, 1):
            known = np.zeros((len(lo), 3), np.int64)  # at each middle, the run found last
            for low, high in PERIODS:
                last = longest if high is None else np.minimum(longest, high)
                for block, q in _spread(mid, np.full(len(lo), low), last):
                    m = mid[block]
                    near = (words[m - 1] == words[m - 1 - q]) if side < 0 else (words[m] == words[np.minimum(m + q, len(words) - 1)])
                    near &= (m - 2 * q >= lo[block]) if side < 0 else (m + 2 * q <= hi[block])
                    s, e, p = known[block].T
                    # Within a known run of period p its multiples give the same run.
                    block_from = m - 2 * q if side < 0 else m
                    near &= ~((p > 0) & (q % np.maximum(p, 1) == 0) & (block_from >= s) & (block_from + 2 * q <= e))
                    block, q, at = block[near], q[near], block_from[near]
                    square = prints.equal(at, q, q)
                    block, q, at = block[square], q[square], at[square]
                    left = at - prints.backward(at, q, at - a[block])
                    right = at + 2 * q + prints.forward(at + q, q, z[block] - at - 2 * q)
                    long = right - left >= np.maximum(min_length, min_exponent * q)
                    found.append(np.stack([left[long], right[long], q[long]], 1))
                    if long.any():
                        # The longest run at each middle, by its smallest period, for what comes next.
                        order = np.lexsort((-q[long], (right - left)[long]))
                        known[block[long][order]] = found[-1][order]
        lo, hi, a, z = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.tile(a, 2), np.tile(z, 2)
        large = hi - lo >= min_length
        lo, hi, a, z = lo[large], hi[large], a[large], z[large]
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # One stretch has one run: that of its smallest period, which divides the others.
    return every[np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(1)])] if len(every) else every


def _holds(words: np.ndarray, run: np.ndarray, start: int, end: int) -> bool:
    s, e, q = run.tolist()
    whole = np.array_equal(words[s : e - q], words[s + q : e])
    return whole and not (s > start and words[s - 1] == words[s - 1 + q]) and not (e < end and words[e] == words[e - q])


def runs_of(words: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, end, period), by start and period, of all runs of the documents between ``bounds``, whose words are numbers.

    ``min_exponent`` is 4 at least: of a run across a middle, one side holds two periods then.
    """
    if min_exponent < 4:
        raise ValueError("min_exponent must be at least 4")
    starts, ends = surviving(words, bounds, overlap(min_length, min_exponent), min_length)
    for base in range(1_000_003, 1 << 31, 7_654_321):
        runs = main_lorentz(words, starts, ends, min_length, min_exponent, base)
        of = np.searchsorted(bounds, runs[:, 0], side="right") - 1
        if all(_holds(words, r, bounds[d], bounds[d + 1]) for r, d in zip(runs, of.tolist(), strict=True)):
            break
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def numbered(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words of each text, their numbers, bounds of texts); ``bytes.split`` cuts at just the six space bytes."""
    lists = [(t or b"").split() for t in texts]
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for ws in lists for w in ws), np.int64)
    return lists, numbers, np.concatenate([[0], np.cumsum([len(ws) for ws in lists])]).astype(np.int64)


def periodic_runs(df: DataFrame, text: str = "text", *, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length and period in words, by start and period) and ``collapsed``.

    ``collapsed`` is the words that no run contains after its first period,
    joined by single spaces.  Null, empty and wordless texts have no runs and
    an empty ``collapsed``.  Each text is worked whole and by itself, so
    repeated rows get equal results and nothing is shuffled; memory is some
    hundred bytes a word of a batch, or of one longer text.  An empty table
    stays empty.  Columns of the added names in ``df`` are replaced.
    """
    made = ("n_words", "runs", "collapsed")
    box = sealed(df.drop(*[c for c in made if c != text]))
    source = box.name(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, source, BATCH_BYTES):
            lists, words, bounds = numbered(batch.column(source).cast(pa.binary()).to_pylist())
            runs = runs_of(words, bounds, min_length, min_exponent)
            of = np.searchsorted(bounds, runs[:, 0], side="right") - 1
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 1], -1)
            kept = np.cumsum(edge[:-1]) == 0
            joined = []
            for ws, b, some in zip(lists, bounds[:-1].tolist(), np.bincount(of, minlength=len(lists)).tolist(), strict=True):
                joined.append(b" ".join([ws[i] for i in np.flatnonzero(kept[b : b + len(ws)])] if some else ws))
            parts = pa.StructArray.from_arrays([pa.array(runs[:, 0] - bounds[of]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], names=["start", "length", "period"])
            offsets = np.searchsorted(of, np.arange(len(lists) + 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts), pa.array(joined, pa.binary()).cast(pa.string())],
                names=[*batch.schema.names, *made],
            )

    schema = T.StructType([*box.df.schema.fields, *T._parse_datatype_string(f"n_words long, runs {RUNS}, collapsed string").fields])
    out = box.df.mapInArrow(work, schema)
    return out.select(*[out[box.name(c)].alias(c) for c in box.names if c not in made], *made)


def repeated_tail(text: Column, key: Column) -> Column:
    """The text, or for a tenth of all keys its words with a tail that repeats.

    With h the crc32 of the key's decimal text and g = h // 10: where h % 10 is
    0 and there are n > 0 words, each word i from a = g % n on becomes word
    a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(w: Column) -> Column:
        n = F.size(w)

        def repeat(x: Column) -> Column:
            place = lambda word, i: F.when(i < x["a"], word).otherwise(F.get(w, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))
            return F.array_join(F.transform(w, place), " ")

        a = F.when(n > 0, g % n).otherwise(0)
        return let(a, lambda a: let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), repeat))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))
    return F.when(h % 10 == 0, let(words, turned)).otherwise(text)
