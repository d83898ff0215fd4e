"""Distributed connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.llm.common import stage, unstage


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", *, name: str = "components") -> DataFrame:
    """(vertex, root): root is the least vertex reachable; only vertices with an edge to another one occur.

    Each round rewires every vertex's larger neighbours, then its smaller
    ones, to the least it knows; the number of rounds is logarithmic in
    practice.  Rounds are staged in the shared folder, so nothing of the graph
    is on the driver and a lost executor costs one round; a round's table goes
    when the next one is written.  A vertex with many
    neighbours is the hot side of an equi-join whose other side has one row
    for it, which adaptive execution splits.  Null ends and loops are left
    out; vertices can be of any ordered type.
    """
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    now = stage(spark, clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stage(spark, large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, now = now, stage(spark, small.where("u != v").distinct(), name)
        before, state = state, _state(now)
        unstage(spark, last, large)
        if before == state:
            break
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Count and order-free hashes of the edge set; equal states mean a fixed point."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())
