"""Mixing sources to target weights, in DataFrame operations alone.

Sizes are summed per source; targets fill by weight up to a cap ("water
filling"); each document is emitted floor(rate) times, plus one Bernoulli copy
with the fraction as its probability, seeded by a hash of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from solvefront.llm.common import WORD_PATTERN, sealed, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def word_count(text: str | Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", *, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row per document.

    Sources in code-point order, null last, take the weights in turn.  The
    total is ``share`` of all sizes; no target passes ``most`` times its
    source's size.  Sorted by cap per weight, the capped sources are a prefix:
    source i is capped if its cap is within what its weight gets once all
    before it are capped.  So running sums find the level at which resharing
    ends.  The windows run over one row per source, in one task: sources are
    configuration, and a million of them would be some 50 MB there.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    ranked = per.withColumn("_rank", F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.select(
        source, "source_size", F.get(cycle, F.col("_rank") % len(weights)).alias("_weight"), "_rank",
        (F.col("source_size") * F.lit(float(most))).alias("_cap"),
    ).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    everywhere = W.partitionBy(F.lit(1))
    by_ratio = everywhere.orderBy("_ratio", "_rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(everywhere) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward)
    leveled = weighed.withColumn("_level", level).withColumn("_at", F.row_number().over(by_ratio))
    free = F.when(F.col("_ratio") > F.col("_level"), F.col("_at"))
    found = leveled.withColumn("_first", F.min(free).over(everywhere)).withColumn("_stop", F.max(F.when(F.col("_at") == F.col("_first"), F.col("_level"))).over(everywhere))
    target = F.when(F.col("_first").isNull() | (F.col("_at") < F.col("_first")), F.col("_cap")).otherwise(F.col("_stop") * F.col("_weight"))
    return found.select(source, "source_size", target.alias("target"))


def unit_hash(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of seed and key; a null key counts as the text 'null'."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(spark: SparkSession, df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **targets) -> DataFrame:
    """Add size, source_size, target and copies to each row.

    A null source is a source of its own; a null, empty or wordless text has
    size 0 and is emitted by its source's rate all the same.  Rows that repeat
    a key share one draw.  An empty table stays empty.  A source without words
    has rate 0.  Columns of these names in ``df`` are replaced.  The targets
    are staged: one row per source, so the planner sees their size and
    broadcasts them only below its own threshold; a hot source needs no
    shuffle then, and beyond it the join's skewed partitions are split.
    """
    rest = df.drop("size", "source_size", "target", "copies").withColumn("size", word_count(text))
    goals = stage(spark, source_targets(rest.select(source, "size"), source, **targets), "targets").withColumnRenamed(source, "_source")
    joined = rest.join(goals, rest[source].eqNullSafe(goals["_source"]), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + (unit_hash(F.col(key), seed) < rate - whole).cast("long")).cast("long")
    return joined.withColumn("copies", copies)


def mix(spark: SparkSession, df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed rows themselves, each as often as it is taken, with the columns of ``df``, whatever their names."""
    box = sealed(df)
    taken = with_copies(spark, box.df, key=box.name(key), text=box.name(text), source=box.name(source), **options)
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return box.open(taken.where("copies > 0").withColumn("_copy", again))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS rk FROM per),
weighed AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
leveled AS (
  SELECT *, cap / weight AS ratio, row_number() OVER o AS pos,
    (SUM(source_size) OVER () * 1.5::DOUBLE - COALESCE(SUM(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / SUM(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, rk)),
stop AS (SELECT MIN(pos) AS first_pos FROM leveled WHERE ratio > level),
goals AS (
  SELECT l.source, l.source_size,
    CASE WHEN s.first_pos IS NULL OR l.pos < s.first_pos THEN l.cap
         ELSE (SELECT level FROM leveled WHERE pos = s.first_pos) * l.weight END AS target
  FROM leveled l, stop s),
rated AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1:' || COALESCE(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
