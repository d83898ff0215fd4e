"""Selection, allocation, manifests and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (temperature, share) of the default schedule.
SCHEDULE = ((0.2, 0.10), (0.6, 0.25), (0.8, 0.35), (1.0, 0.20), (1.2, 0.10))


def allocate(spark: SparkSession, n: int, schedule: Sequence[tuple[float, float]] = SCHEDULE) -> DataFrame:
    """(i, temperature): n draws over the stages by highest averages; a prefix of n draws is the allocation of fewer."""
    stages = spark.createDataFrame([(k, float(t), float(f)) for k, (t, f) in enumerate(schedule) if f > 0], "stage int, temperature double, share double")
    seats = stages.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(n))))
    ranked = seats.withColumn("i", F.row_number().over(W.orderBy(F.desc(F.col("share") / F.col("j")), "stage", "j")) - 1)
    return ranked.where(F.col("i") < n).select("i", "temperature", "stage")


def consensus(candidates: DataFrame, by: Sequence[str], key: str = "key", index: str = "idx", keep: Sequence[str] = ()) -> DataFrame:
    """The largest cluster per group, ties to the one seen first, and its earliest member; empty and null keys do not vote.

    Grades must be joined only after this: the choice is blind to them.
    """
    votes = candidates.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(*by, key).agg(F.count(F.lit(1)).alias("votes"), F.min(index).alias("first_index"), *[F.min_by(c, index).alias(c) for c in keep])
    best = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("votes"), "first_index"))
    return votes.withColumn("_r", best).where("_r = 1").drop("_r")


def split_of(unit: Column, train: float, held_out: float) -> Column:
    return F.when(unit < train, "train").when(unit < train + held_out, "held_out").otherwise("transfer")


def assign_splits(tasks: DataFrame, unit: Column, *, train: float, held_out: float, transfer_families: Sequence[str] = ()) -> DataFrame:
    """Split by a hash in [0, 1); tasks of a transfer family go to transfer whatever their hash.  Shares below 0 or above 1 in sum are refused."""
    if min(train, held_out) < 0 or train + held_out > 1 + 1e-9:
        raise ValueError(f"shares must not be negative and at most 1 in sum: {train}, {held_out}")
    moved = F.coalesce(F.col("family").isin(*transfer_families), F.lit(False)) if transfer_families else F.lit(False)
    return tasks.withColumn("split", F.when(moved, "transfer").otherwise(split_of(unit, train, held_out)))


def manifest_diff(frozen: DataFrame, current: DataFrame, on: str = "task_id") -> DataFrame:
    """(task_id, problem): missing, added, hash and split changes, one row each, by a full outer join."""
    f = frozen.select(on, F.col("hash").alias("_fh"), F.col("split").alias("_fs"), F.lit(True).alias("_f"))
    c = current.select(on, F.col("hash").alias("_ch"), F.col("split").alias("_cs"), F.lit(True).alias("_c"))
    both = F.col("_f").isNotNull() & F.col("_c").isNotNull()
    problems = F.array_compact(F.array(
        F.when(F.col("_c").isNull(), "missing"), F.when(F.col("_f").isNull(), "added"),
        F.when(both & ~F.col("_fh").eqNullSafe(F.col("_ch")), "changed_hash"), F.when(both & ~F.col("_fs").eqNullSafe(F.col("_cs")), "changed_split")))
    return f.join(c, on, "full_outer").select(on, F.explode(problems).alias("problem"))


def suite_hash(tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SHA-256 over id, content hash and split in the order of ids, with zero and one bytes between; one bounded suite a group."""
    rows = F.array_sort(F.collect_list(F.struct("task_id", "hash", F.coalesce("split", F.lit("none")).alias("split"))))
    folded = F.array_join(F.transform(rows, lambda x: F.concat(x["task_id"], F.lit("\0"), x["hash"], F.lit("\0"), x["split"], F.lit("\1"))), "")
    return tasks.groupBy(*by).agg(F.sha2(folded, 256).alias("suite_hash"), F.count(F.lit(1)).alias("n_tasks"))


def split_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, truth: str, verdict: str) -> DataFrame:
    """Confusion counts and rate; null on no rows."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col(truth) & F.col(verdict)).alias("false_positives"), F.count_if(F.col(truth) & ~F.col(verdict)).alias("false_negatives"),
        F.avg((F.col(truth) == F.col(verdict)).cast("int")).alias("agreement"))


def disagreements(df: DataFrame, truth: str, verdict: str, order: str, limit: int = 20) -> DataFrame:
    return df.where(F.col(truth) != F.col(verdict)).orderBy(order).limit(limit)
