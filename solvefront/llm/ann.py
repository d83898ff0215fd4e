"""Approximate nearest neighbours with randomly rotated one-bit codes.

A unit vector, padded and turned by a fixed random rotation, is kept as the
signs of its B coordinates and one correction scalar, its inner product with
its own code.  A query is turned alike and rounded to four bits a coordinate,
kept as four bit planes; the inner product with a code is then a sum of
population counts of packed words.  Over the correction it estimates the cosine
without bias, with an error of about eps * sqrt((1 - c^2) / c^2) / sqrt(B - 1)
and eps times the rounding's.  Vectors whose estimate plus bound reaches the
k-th best lower bound are reranked on the original vectors in double precision.

Every row is indexed and every query block meets every row shard in codes:
coarse cells would save that only where vectors cluster (on the driver's
embeddings, 0.9 of the neighbours take two thirds of all rows with 25 cells
and more with 100).  Blocks and shards are of bounded size, as large as a task
can hold, as each row is sent once a block and each query once a shard; a
meeting returns its k best per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BITS = 256
EPS = 2.5
SEED = 20240611
QUERY_BLOCK = 16_384
SHARD_ROWS = 8192
_TILE = 64
_PLANES = 4
_ROTATIONS: dict[tuple, np.ndarray] = {}


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """bits x dim with orthonormal columns: a random rotation of the padded space, on the coordinates in use."""
    key = (dim, bits, seed)
    if key not in _ROTATIONS:
        gauss = np.random.default_rng([seed, dim, bits]).standard_normal((max(bits, dim), dim))
        _ROTATIONS[key] = np.linalg.qr(gauss)[0]
    return _ROTATIONS[key]


def usable(vec: Column) -> Column:
    """Not null, not empty, without null or non-finite parts, and not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vec, fine) & F.exists(vec, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The rows times powers of two that bring their largest parts near 1: cosines stay as they are, and no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None]) if len(vectors) else vectors


def turned(vectors: np.ndarray, bits: int, seed: int) -> np.ndarray:
    unit = scaled(vectors)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True) @ rotation(vectors.shape[1], bits, seed).T


def encode(vectors: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction scalars of the rows (n x dim, double)."""
    x = turned(vectors, bits, seed)
    return np.packbits(x > 0, axis=1), np.abs(x).sum(axis=1) / math.sqrt(x.shape[1])


def words(packed: np.ndarray) -> np.ndarray:
    """Packed bytes as 64-bit words, filled up with zeros."""
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def estimates(queries: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(inner products of turned queries with codes of signs, the rounding's step per query); codes as words."""
    low = queries.min(axis=1)
    step = np.maximum(queries.max(axis=1) - low, 1e-300) / ((1 << _PLANES) - 1)
    level = np.rint((queries - low[:, None]) / step[:, None]).astype(np.uint8)
    sums = np.zeros((len(queries), len(codes)), np.int32)
    for j in range(_PLANES):
        plane = words(np.packbits(level >> j & 1, axis=1))
        for w in range(codes.shape[1]):
            sums += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) << j
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
    positive = low[:, None] * ones + step[:, None] * sums
    every = low * width + step * level.sum(axis=1, dtype=np.int64)  # the rounded query's sum: roundings of either sign cancel
    return (2 * positive - every[:, None]) / math.sqrt(width), step


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def build_index(df: DataFrame, key: str = "vec_id", vec: str = "embedding", *, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(id, vector, dim, code, correction) of every usable row with an id; no shuffle."""
    rows = df.where(usable(F.col(vec)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vector"))

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = np.asarray(pc.list_value_length(t.column("vector")))
            for dim in np.unique(dims):
                part = t.filter(pa.array(dims == dim))
                codes, corr = encode(_matrix(part.column("vector")), bits, seed)
                part = part.append_column("dim", pa.array(np.full(len(corr), dim, np.int32)))
                part = part.append_column("code", pa.array([c.tobytes() for c in codes], pa.binary())).append_column("correction", pa.array(corr))
                yield from part.combine_chunks().to_batches()

    return rows.mapInArrow(run, "id long, vector array<double>, dim int, code binary, correction double")


def search_shard(query_ids, queries, ids, rows, codes, corr, k: int, eps: float, bits: int, seed: int):
    """The k nearest rows of one shard for each query of one block: (query index, row index, cosine)."""
    asked = turned(queries, bits, seed)
    width = asked.shape[1]
    packed = words(codes)
    # The smallest slack covers rounding in double precision.
    slack = eps * np.sqrt(np.maximum(0, 1 - corr**2)) / corr / math.sqrt(max(1, width - 1)) + 1e-9
    rows, queries = scaled(rows), scaled(queries)
    row_norm, query_norm = np.sqrt(np.einsum("ij,ij->i", rows, rows)), np.sqrt(np.einsum("ij,ij->i", queries, queries))
    for at in range(0, len(queries), _TILE):
        est, step = estimates(asked[at : at + _TILE], packed, width)
        est /= corr
        off = slack + (eps / math.sqrt(12)) * step[:, None] / corr
        own = query_ids[at : at + _TILE, None] == ids[None, :]
        low = np.where(own, -np.inf, est - off)
        kth = np.partition(low, max(0, low.shape[1] - k), axis=1)[:, max(0, low.shape[1] - k)]
        q, r = np.nonzero((est + off >= kth[:, None]) & ~own)
        score = np.empty(len(q))
        for i in range(0, len(q), 1 << 16):
            qq, rr = q[i : i + (1 << 16)] + at, r[i : i + (1 << 16)]
            score[i : i + (1 << 16)] = np.einsum("ij,ij->i", queries[qq], rows[rr]) / (query_norm[qq] * row_norm[rr])
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.searchsorted(q, q, side="left")
        best = np.arange(len(q)) - first < k
        yield q[best] + at, r[best], score[best]


def search(spark: SparkSession, index: DataFrame, is_query: Column, *, k: int = 5, eps: float = EPS, bits: int = BITS, seed: int = SEED, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by cosine, ties to the smaller id.

    ``is_query`` is a condition on the index's ``id``.  A query's own rows, by
    id, are no candidates; vectors meet only those of their own length.  Fewer
    candidates than k: all of them; none: no row.  Repeated ids are searched
    once per row as candidates, and as a query by the vector of one of them.
    """
    n, nq = index.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(nq / query_block))
    rows = index.withColumn("shard", F.pmod(F.xxhash64("id", "code"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = index.where(is_query).groupBy("id", "dim").agg(F.min("vector").alias("vector"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    by = ["block", "shard", "dim"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            order = np.argsort(left.column("id").to_numpy(), kind="stable")
            left = left.take(pa.array(order))
            ids, query_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            rows_, queries = _matrix(left.column("vector")), _matrix(right.column("vector"))
            for q, r, s in search_shard(query_ids, queries, ids, rows_, codes, left.column("correction").to_numpy(), k, eps, bits, seed):
                for o, x in zip(out, (query_ids[q], ids[r], s), strict=True):
                    o.append(x)
        cols = [np.concatenate(o) if o else np.array([], t) for o, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    near = rows.groupBy(by).cogroup(asked.groupBy(by)).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
