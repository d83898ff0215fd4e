"""Deterministic attempt generators and the checks run on them."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from solvefront.functions.statistics import binomial_tail, chao1, clopper_pearson_udf
from solvefront.operators.selection import SCHEDULE, allocate

# The toy family's true rates and species weights.
TOY = {
    "toy/sum_list": (0.60, (8.0, 4.0, 1.5, 1.0)), "toy/is_palindrome": (0.45, (10.0, 2.0, 2.0, 1.0)), "toy/count_vowels": (0.35, (6.0, 3.0, 1.0, 1.0)),
    "toy/gcd": (0.25, (5.0, 2.0, 1.0)), "toy/unique_sorted": (0.50, (7.0, 2.0, 1.0)), "toy/impossible_parity": (0.0, (1.0,)),
}


def uniform(*parts: Column) -> Column:
    """[0, 1) from the first 52 bits of the md5 of the parts: the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def effective_weights(weights: Column, temperature: Column, sharpen: bool = True) -> Column:
    """Normalised w^(1/T), the exponent at most 50; even where all vanish."""
    power = F.least(F.lit(50.0), F.lit(1.0) / F.greatest(temperature, F.lit(1e-6)))
    raised = F.when(F.lit(sharpen) & (temperature > 0), F.transform(weights, lambda w: F.pow(w, power))).otherwise(weights)
    total = F.aggregate(raised, F.lit(0.0), lambda a, w: a + w)
    return F.when(total <= 0, F.transform(weights, lambda w: F.lit(1.0) / F.size(weights))).otherwise(F.transform(raised, lambda w: w / total))


def toy_tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, p, list(w)) for t, (p, w) in TOY.items()], "task_id string, p double, weights array<double>")


def draws(tasks: DataFrame, n: int, schedule: Sequence[tuple[float, float]] = SCHEDULE, seed: str = "0", *, sharpen: bool = True) -> DataFrame:
    """Attempts (task_id, i, temperature, passed, species) by md5: no state, any partitioning gives the same rows."""
    plan = allocate(tasks.sparkSession, n, schedule).select("i", "temperature")
    rows = tasks.crossJoin(F.broadcast(plan))  # the plan has n rows, a parameter
    u, v = uniform(F.lit(seed), F.lit("p"), "task_id", "i"), uniform(F.lit(seed), F.lit("s"), "task_id", "i")
    rows = rows.withColumn("passed", u < F.col("p")).withColumn("_w", effective_weights(F.col("weights"), F.col("temperature"), sharpen)).withColumn("_v", v)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"))
    pick = F.aggregate("_w", start, lambda a, w: F.struct((a["sum"] + w).alias("sum"), (a["k"] + (a["sum"] + w <= F.col("_v")).cast("int")).alias("k")))["k"]
    return rows.withColumn("species", F.when(F.col("passed"), F.least(pick, F.size("_w") - 1))).select("task_id", "i", "temperature", "passed", "species")


def derive_seed(*parts: object) -> int:
    """64 bits of the BLAKE2b of the parts' representations, each closed by a zero byte."""
    return int.from_bytes(hashlib.blake2b(b"".join(repr(p).encode() + b"\0" for p in parts), digest_size=8).digest(), "little")


def mock_draw(seed: int, model_id: str, task_id: str, temperature: float, index: int, p: float, weights: Sequence[float]) -> tuple[bool, int]:
    """One exact draw of the mock model: (passed, species or -1)."""
    rng = random.Random(derive_seed(seed, model_id, task_id, temperature, index))
    if rng.random() < p:
        return True, rng.choices(range(len(weights)), weights=weights)[0]
    return False, -1


def mock_draws(attempts: DataFrame, seed: int = 0, model_id: str = "mock") -> DataFrame:
    """Exact draws for rows of task_id, temperature, i, p, w (effective weights), in Arrow batches."""
    @F.pandas_udf("struct<passed boolean, species int>")
    def draw(task: pd.Series, t: pd.Series, i: pd.Series, p: pd.Series, w: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mock_draw(seed, model_id, a, float(b), int(c), d, list(e)) for a, b, c, d, e in zip(task, t, i, p, w, strict=True)], columns=["passed", "species"])

    return attempts.withColumn("d", draw("task_id", "temperature", "i", "p", "w")).select("*", "d.*").drop("d")


def ci_coverage(spark: SparkSession, true_ps: Sequence[float] = (0.0, 0.001, 0.01, 0.1, 0.5, 0.9), n: int = 300, replicates: int = 400, confidence: float = 0.95, seed: str = "ci") -> DataFrame:
    """Coverage of the exact interval per true rate, with three standard errors of tolerance."""
    grid = spark.range(replicates * n).select((F.col("id") / F.lit(n)).cast("long").alias("rep"), F.col("id"), F.explode(F.array(*[F.lit(float(p)) for p in true_ps])).alias("true_p"))
    hits = grid.withColumn("hit", (uniform(F.lit(seed), "true_p", "id") < F.col("true_p")).cast("int")).groupBy("true_p", "rep").agg(F.sum("hit").alias("c"))
    ci = hits.withColumn("ci", clopper_pearson_udf(confidence)("c", F.lit(n)))
    inside = F.col("true_p").between(F.col("ci.low") - 1e-12, F.col("ci.high") + 1e-12)
    return ci.groupBy("true_p").agg(F.avg(inside.cast("int")).alias("coverage"), F.avg(F.col("ci.high") - F.col("ci.low")).alias("mean_width")).withColumn("mc_tolerance", F.lit(3 * (confidence * (1 - confidence) / replicates) ** 0.5))


def chao1_lower_bound(spark: SparkSession, species: int = 12, n: int = 150, replicates: int = 200, seed: str = "chao") -> DataFrame:
    """How Chao1 behaves on a skewed distribution that a sample of n undersamples."""
    weights = [1.0 / (i + 1) for i in range(species)]
    cumulative = [sum(weights[: i + 1]) / sum(weights) for i in range(species)]
    u = uniform(F.lit(seed), "id")
    picked = sum((F.when(u > F.lit(c), 1).otherwise(0) for c in cumulative[:-1]), F.lit(0))
    counts = spark.range(replicates * n).select((F.col("id") / F.lit(n)).cast("long").alias("rep"), picked.alias("s")).groupBy("rep", "s").agg(F.count(F.lit(1)).alias("k"))
    per = counts.groupBy("rep").agg(F.count(F.lit(1)).alias("obs"), F.count_if(F.col("k") == 1).alias("f1"), F.count_if(F.col("k") == 2).alias("f2"))
    est = per.withColumn("e", chao1(F.col("obs"), F.col("f1"), F.col("f2"))["estimate"])
    return est.agg(F.count(F.lit(1)).alias("replicates"), F.avg("obs").alias("mean_observed"), F.avg("e").alias("mean_estimate"),
                   F.avg((F.col("e") <= species + 1e-9).cast("int")).alias("not_above_truth"), F.avg((F.col("e") >= F.col("obs") - 1e-9).cast("int")).alias("at_least_observed"))


def pipeline_validation(tasks: DataFrame, n: int = 400, confidence: float = 0.95, alpha: float = 0.01) -> DataFrame:
    """Draw, estimate, and compare with the truth: how many intervals hold it, and how likely so many misses are."""
    rate = draws(tasks, n, sharpen=False).groupBy("task_id").agg(F.count_if("passed").alias("c"), F.count(F.lit(1)).alias("n"))
    ci = rate.join(tasks.select("task_id", "p"), "task_id").withColumn("ci", clopper_pearson_udf(confidence)("c", "n"))
    done = ci.agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("p").between(F.col("ci.low") - 1e-12, F.col("ci.high") + 1e-12)).alias("recovered"))
    tail = binomial_tail(F.col("n_tasks") - F.col("recovered"), F.col("n_tasks"), F.lit(1 - confidence))
    return done.withColumn("p_value", tail).withColumn("ok", F.col("p_value") >= alpha)


def best_of_n(candidates: DataFrame, by: Sequence[str], grades: DataFrame, key: str = "key", index: str = "idx") -> DataFrame:
    """Consensus choice joined with its grade afterwards, and whether any candidate passed."""
    from solvefront.operators.selection import consensus

    chosen = consensus(candidates, by, key, index)
    any_pass = grades.groupBy(*by).agg(F.bool_or("passed").alias("pass_at_n"))
    graded = chosen.join(grades.select(*by, F.col(index).alias("first_index"), "passed"), [*by, "first_index"], "left")
    return graded.join(any_pass, list(by), "left")


def repair_loop(attempts: DataFrame, by: Sequence[str], order: str = "i", public: str = "public_ok") -> DataFrame:
    """Attempts up to and including the first that passes the public tests: later ones would not have been drawn."""
    before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return attempts.withColumn("_done", F.coalesce(F.max(F.col(public).cast("int")).over(before), F.lit(0))).where("_done = 0").drop("_done")
