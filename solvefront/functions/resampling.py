"""Bootstrap by vector-valued partial aggregation: no row is copied, no group is in one task.

A group's rows are dealt to buckets.  A resample of n draws from n rows sends
to each bucket as many draws as a multinomial law says; halving the buckets
again and again, with a binomial draw at each halving that any task repeats
from its seed, tells a bucket its share without any exchange.  Within a bucket
the draws are indices.  So each bucket yields, for all resamples at once, its
number of draws and their sums, and merging is adding arrays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESAMPLES = 10_000
#: Rows of a bucket about, buckets of a group at most, and draws worked at once.
BUCKET_ROWS = 1 << 16
MOST_BUCKETS = 4096
DRAWS = 1 << 20
#: Buckets added up in one task.
FAN_IN = 64
#: A generator that plain 64-bit arithmetic, SQL's too, can follow: squares modulo a prime. Fixed values.
PRIME = (1 << 31) - 1
MIX = (48_271, 69_621, 16_807, 39_373, 742_938_285)


def group_seed(group: Any, bucket: int, seed: int) -> int:
    return int(hashlib.md5(f"{seed}:{bucket}:{group}".encode()).hexdigest()[:7], 16)


def indices(b: np.ndarray, j: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A number below n for each (resample, draw), as good as random."""
    p = np.int64(PRIME)
    x = (b * MIX[0] + j * MIX[1] + seed) % p
    y = x * x % p
    x = (y + b * MIX[2] + seed) % p
    y = x * x % p
    x = (y + j * MIX[3]) % p
    y = (x * x % p * MIX[4] + x) % p
    return y * n // p


def draws_of_bucket(counts: Sequence[int], place: int, resamples: int, group: Any, seed: int) -> np.ndarray:
    """How many of its n draws each resample takes from the bucket at ``place``; over all buckets they sum to n."""
    low, high = 0, len(counts)
    taken = np.full(resamples, sum(counts), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left, whole = sum(counts[low:middle]), sum(counts[low:high])
        rng = np.random.default_rng([seed, low, high, group_seed(group, 0, seed)])
        taken_left = rng.binomial(taken, left / whole if whole else 0.0)
        taken, low, high = (taken_left, low, middle) if place < middle else (taken - taken_left, middle, high)
    return taken


def resampled_sums(values: np.ndarray, taken: np.ndarray, seed: int) -> np.ndarray:
    """(resamples, columns): the sums of the drawn rows of ``values`` (rows, columns)."""
    out = np.zeros((len(taken), values.shape[1]))
    ends = np.cumsum(taken)
    start = 0
    while start < len(taken):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + DRAWS, side="right")))
        m = taken[start:stop]
        for first in range(0, int(m.max(initial=0)), DRAWS):  # a resample of very many draws goes in parts
            part = np.clip(m - first, 0, DRAWS)
            b = np.repeat(np.arange(start, stop), part)
            j = np.arange(len(b)) - np.repeat(np.cumsum(part) - part, part) + first
            drawn = values[indices(b, j, len(values), seed)]
            for c in range(values.shape[1]):
                out[start:stop, c] += np.bincount(b - start, drawn[:, c], minlength=stop - start)
        start = stop
    return out


def mean_of(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    return sums[:, 0] / n


def percentile_places(resamples: int, confidence: float) -> tuple[int, int]:
    """Where, from 0, the ends of the interval lie among the sorted statistics."""
    half = (1 - confidence) / 2
    return max(0, int(half * resamples)), min(resamples - 1, int((1 - half) * resamples) - 1)


def bootstrap_sums(
    df: DataFrame, by: str, values: Sequence[str], order: str, *, statistic: Callable[[np.ndarray, np.ndarray], np.ndarray] = mean_of,
    resamples: int = RESAMPLES, confidence: float = 0.95, seed: int = 0, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(by, point, low, high, draws): the percentile interval of any statistic of sums.

    ``statistic`` maps the sums of the columns ``values``, a row for each
    resample, and the numbers of draws to one number each: a mean, a ratio, a
    variance from sums of squares.  ``order`` tells rows of a group apart, so
    that results do not depend on partitions.  ``draws`` is what every
    resample drew, the group's size.  Rows with a null value are left out; a
    group without others has no row; a null group is a group of its own.
    """
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    kind = df.schema[by].dataType.simpleString()
    known = df.select(F.col(by).alias("g"), F.col(order).alias("o"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]).dropna(subset=[f"v{i}" for i in range(len(values))])
    largest = known.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, math.ceil(largest / bucket_rows)))
    dealt = known.withColumn("k", F.pmod(F.xxhash64("o"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("g", "k").count().groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "count"))).alias("m"))
    counted = sizes.select(F.col("g").alias("_g"), F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))).alias("counts"))
    rows = dealt.join(counted, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
    width = len(values)

    def partial(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The counts are the same in every row: one list for each batch is read.
        group, place, counts, kept = key[0].as_py(), key[1].as_py(), None, []
        for part in parts:
            counts = counts or part.column("counts")[0].as_py()
            kept.append(part.select(["o", *[f"v{i}" for i in range(width)]]))
        whole = pa.Table.from_batches(kept)
        whole = whole.sort_by([("o", "ascending"), *[(f"v{i}", "ascending") for i in range(width)]])
        matrix = np.stack([whole.column(f"v{i}").to_numpy() for i in range(width)], 1)
        taken = draws_of_bucket(counts, place, resamples, group, seed)
        sums = resampled_sums(matrix, taken, group_seed(group, place, seed))
        flat = np.concatenate([matrix.sum(0), sums.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array([group], to_type), pa.array([place], pa.int32()), pa.array([np.concatenate([[len(matrix)], taken])], pa.list_(pa.int64())), pa.array([flat], pa.list_(pa.float64()))],
            names=["g", "k", "n", "s"],
        )

    def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "k": [frame["k"].iloc[0] // FAN_IN], "n": [np.sum(np.stack(frame["n"]), 0)], "s": [np.sum(np.stack(frame["s"]), 0)]})

    def ended(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, s = np.sum(np.stack(frame["n"]), 0), np.sum(np.stack(frame["s"]), 0).reshape(resamples + 1, width)
        found = statistic(s, n)
        low, high = percentile_places(resamples, confidence)
        ranked = np.sort(found[1:])
        if (n[1:] != n[0]).any():
            raise AssertionError("a resample has not drawn as many rows as there are")
        return pd.DataFrame({by: [frame["g"].iloc[0]], "point": [found[0]], "low": [ranked[low]], "high": [ranked[high]], "draws": [n[0]]})

    from pyspark.sql.pandas.types import to_arrow_type

    to_type, schema = to_arrow_type(df.schema[by].dataType), f"g {kind}, k int, n array<bigint>, s array<double>"
    sums = rows.groupBy("g", "k").applyInArrow(partial, schema)
    while buckets > FAN_IN:
        sums = sums.groupBy("g", F.floor(F.col("k") / FAN_IN)).applyInPandas(added, schema)
        buckets = math.ceil(buckets / FAN_IN)
    return sums.groupBy("g").applyInPandas(ended, f"`{by}` {kind}, point double, low double, high double, draws bigint")


def bootstrap_udaf(statistic: Callable[[np.ndarray], float], *, resamples: int = 1000, confidence: float = 0.95, seed: int = 0):
    """An aggregate of [point, low, high] for statistics that are no function of sums, such as a median; a group must fit a task."""

    @F.pandas_udf("array<double>")
    def interval(values: pd.Series) -> list:
        v = np.sort(values.dropna().to_numpy(float))
        if not len(v):
            return None
        j = np.arange(len(v))
        found = np.sort([statistic(v[indices(np.full(len(v), b), j, len(v), group_seed("", 0, seed))]) for b in range(resamples)])
        low, high = percentile_places(resamples, confidence)
        return [float(statistic(v)), float(found[low]), float(found[high])]

    return interval
