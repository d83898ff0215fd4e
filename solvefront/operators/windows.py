"""Where short texts occur in long ones: windows of the long ones, told apart by a bitmap and joined by equality.

Every window of a long text that may be one of the short ones becomes a row,
in a distributed way; the join with the short ones is then an equi-join on
text, so it is exact, and no key is hotter than the short texts make it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvefront.functions.arrow import rows_of

#: Bits of the largest bitmap that is broadcast, and code points hashed at once.
MOST_BITS = 1 << 26
PIECE = 1 << 18
#: Bytes of texts worked on and yielded at once.
SLICE_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(points: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each window of ``length`` code points, in one pass over at most a piece."""
    n = len(points)
    if n < length:
        return np.empty(0, np.uint64)
    steps = np.full(n + 1, BASE, np.uint64)
    steps[0] = 1
    back = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    power, inverse = np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
    x = (sums[length:] - sums[: n - length + 1]) * inverse[: n - length + 1]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _bitmap(short: DataFrame, text: str) -> tuple[int, list[int], np.ndarray]:
    """(bits, lengths, bitmap) of the short texts: made on the executors, of bounded size here."""
    facts = short.agg(F.count(F.lit(1)), F.collect_set(F.length(text))).first()
    bits = min(MOST_BITS, 1 << max(20, (64 * facts[0]).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, text, SLICE_BYTES):
            h = [window_hashes(p, len(p))[0] & np.uint64(bits - 1) for p in map(_points, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).astype(np.int64))], names=["bit"])

    made = short.select(text).mapInArrow(place, "bit long").groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")).toArrow()
    marks = np.zeros(bits // 8, np.uint8)
    for k, x in zip(made.column("part").to_pylist(), made.column("bits").to_pylist(), strict=True):
        marks[k * 4096 : (k + 1) * 4096] = np.frombuffer(x, np.uint8)
    return bits, sorted(facts[1]), marks


def windows_like(long: DataFrame, text: str, keep: Sequence[str], short: DataFrame, needle: str) -> DataFrame:
    """(keep, window): the different windows of each long text that are among the short ones, and few that are not.

    Short texts must be neither null nor empty.  They have few different
    lengths: a text is read once for each.  Null texts have no windows.
    """
    bits, lengths, marks = _bitmap(short.select(needle).distinct(), needle)
    shared = long.sparkSession.sparkContext.broadcast(marks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in rows_of(batches, text, SLICE_BYTES):
            rows, found = [], []
            for row, value in enumerate(batch.column(text).to_pylist()):
                seen: set[str] = set()
                for length in lengths if value else ():
                    for start in range(0, max(1, len(value) - length + 1), PIECE):
                        piece = value[start : start + PIECE + length - 1]
                        at = window_hashes(_points(piece), length) & np.uint64(bits - 1)
                        hit = (marked[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                        seen.update(piece[i : i + length] for i in np.flatnonzero(hit).tolist())
                rows += [row] * len(seen)
                found += seen
            taken = batch.select(list(keep)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], names=[*keep, "window"])

    schema = T.StructType([*(long.schema[c] for c in keep), T.StructField("window", T.StringType())])
    return long.select(*dict.fromkeys([*keep, text])).mapInArrow(work, schema)
