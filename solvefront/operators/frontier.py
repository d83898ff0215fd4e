"""Frontier estimation: from attempts to one record per condition and task."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from solvefront.functions.statistics import BUDGET_GRID, budgets, chao1, good_turing_unseen, pass_curve, rarefaction_term, require, rule_of_three, with_clopper_pearson, zero_success_bound

SATURATION = 0.99


def species_counts(attempts: DataFrame, by: Sequence[str], species: str = "species", passed: str = "passed") -> DataFrame:
    """(by, species, n) over passed attempts."""
    return attempts.where(F.col(passed)).groupBy(*by, species).agg(F.count(F.lit(1)).alias("n"))


def counts_of_counts(counts: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """(by, n, f): how many species were seen n times; zero counts do not occur."""
    return counts.where(F.col(n) > 0).groupBy(*by, n).agg(F.count(F.lit(1)).alias("f"))


def diversity(counts: DataFrame, by: Sequence[str], *, bias_corrected: bool = True, confidence: float = 0.95) -> DataFrame:
    """Unseen mass, coverage, saturation and Chao1 per group, in one aggregation."""
    n = F.col("n")
    sums = counts.where(n > 0).groupBy(*by).agg(
        F.sum(n).alias("n_correct"), F.count(F.lit(1)).alias("n_distinct"), F.count_if(n == 1).alias("f1"), F.count_if(n == 2).alias("f2"))
    unseen = good_turing_unseen(F.col("f1"), F.col("n_correct"))
    made = sums.withColumn("unseen_mass", unseen).withColumn("coverage", F.lit(1.0) - F.col("unseen_mass"))
    return made.withColumn("saturated", saturated(F.col("coverage"))).withColumn("chao1", chao1(F.col("n_distinct"), F.col("f1"), F.col("f2"), bias_corrected=bias_corrected, z=NormalDist().inv_cdf(0.5 + confidence / 2)))


def saturated(coverage: Column) -> Column:
    return F.coalesce(coverage >= SATURATION, F.lit(False))


def rarefaction(counts: DataFrame, by: Sequence[str], grid: Sequence[int] = BUDGET_GRID, *, samples: DataFrame | None = None) -> DataFrame:
    """(by, m, expected): expected distinct species in m draws, for m up to max(1, total).

    Species of one count are one row, with how many there are.  With
    ``samples`` (by, n_samples) a group's own number of samples is a budget too.
    """
    each = counts_of_counts(counts, by)
    total = F.sum(F.col("n") * F.col("f")).over(W.partitionBy(*by))
    totals = each.withColumn("_total", total)
    if samples is None:
        ms = F.array(*[F.lit(int(g)).cast("long") for g in grid])
    else:
        totals, ms = totals.join(samples.select(*by, "n_samples"), list(by)), budgets(F.col("n_samples"), grid)
    spread = totals.withColumn("m", F.explode(ms)).where(F.col("m") <= F.greatest(F.lit(1), F.col("_total")))
    return spread.groupBy(*by, "m").agg(F.sum(F.col("f") * rarefaction_term(F.col("_total"), F.col("n"), F.col("m"))).alias("expected"))


def rates(attempts: DataFrame, by: Sequence[str], passed: str = "passed", *, confidence: float = 0.95, more: Sequence[Column] = ()) -> DataFrame:
    """n_samples, n_correct, p_hat and the bounds that need no inverse; ``more`` are further aggregates of the same pass."""
    sums = attempts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col(passed)).alias("n_correct"), *more)
    n = F.col("n_samples")
    return sums.withColumns({
        "p_hat": F.col("n_correct") / n, "rule_of_three_bound": rule_of_three(n), "exact_zero_success_bound": zero_success_bound(n, confidence), "beyond_frontier": F.col("n_correct") == 0})


def frontier_records(attempts: DataFrame, by: Sequence[str] = ("task_id",), *, confidence: float = 0.95, interval: bool = True) -> DataFrame:
    """The record: rate and interval, diversity, pass curve and rarefaction.

    ``by`` must include the condition key where a log holds several conditions.
    Diversity is null, not zero, where nothing passed.  All bounds and
    intervals are at ``confidence``.  Where the log has them, canonicalisation
    methods of passed attempts (canon_method), usage (calls, prompt_tokens,
    completion_tokens, usd), verifier errors (reason) and exhausted budgets
    (exhausted) are added up.
    """
    rated = rates(attempts, by, confidence=confidence, more=_log_fields(attempts))
    counts = species_counts(attempts, by)
    named = counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("species", F.lit("")).alias("species"), "n")))).alias("species_counts"))
    curve = rarefaction(counts, by, samples=rated).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("m", "expected")))).alias("rarefaction"))
    out = rated.join(diversity(counts, by, confidence=confidence).drop("n_correct"), list(by), "left").join(curve, list(by), "left").join(named, list(by), "left")
    if "canon_method" in attempts.columns:
        methods = attempts.where("passed").groupBy(*by, F.coalesce("canon_method", F.lit("unknown")).alias("_m")).agg(F.count(F.lit(1)).alias("_c"))
        out = out.join(methods.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_m", "_c")))).alias("canonicalization_methods")), list(by), "left")
    out = out.withColumn("saturated", F.coalesce("saturated", F.lit(False))).withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    out = out.withColumn("pass_at_k", pass_curve(F.col("n_samples"), F.col("n_correct"), own=True))
    qualifier = F.when(F.col("beyond_frontier"), F.format_string(f"no success in %d samples: rate below %.3g at {confidence * 100:g}%% confidence", F.col("n_samples"), F.col("exact_zero_success_bound")))
    out = out.withColumn("qualifier", qualifier)
    return with_clopper_pearson(out, "n_correct", "n_samples", confidence=confidence) if interval else out


# Reasons of a failed attempt that are the verifier's.
VERIFIER_ERRORS = ("verifier_error", "timeout")
USAGE = ("calls", "prompt_tokens", "completion_tokens", "usd")


def _log_fields(attempts: DataFrame) -> list[Column]:
    """Aggregates of what an attempt log may hold beside the verdicts."""
    has, made = set(attempts.columns), []
    if has.issuperset(USAGE):
        sums = {c: F.sum(F.coalesce(F.col(c), F.lit(0))) for c in USAGE}
        made.append(F.struct(*[v.alias(c) for c, v in sums.items()], (sums["prompt_tokens"] + sums["completion_tokens"]).alias("total_tokens")).alias("usage"))
    if "reason" in has:
        made.append(F.count_if(~F.coalesce("passed", F.lit(False)) & F.col("reason").isin(*VERIFIER_ERRORS)).alias("n_verifier_errors"))
    if "exhausted" in has:
        made.append(F.count_if("exhausted").alias("n_budget_exhausted"))
    return made


def resume_state(samples: DataFrame, condition_key: str, by: Sequence[str] = ("task_id",)) -> DataFrame:
    """What a restarted run must know of each log: done, next index, passes, species, methods, usage, verifier errors.

    Rows under another condition key are an error: their samples must never be pooled.
    """
    mine = F.col("condition_key").eqNullSafe(F.lit(condition_key))
    rows = require(samples, mine, F.concat(F.lit("log of other conditions: "), F.coalesce("condition_key", F.lit("none"))))
    sums = rates(rows, by, more=[(F.max("i") + 1).alias("next_index"), *_log_fields(rows)]).select(*by, F.col("n_samples").alias("n_done"), "n_correct", "next_index", *[c for c in ("usage", "n_verifier_errors") if c == "usage" and set(USAGE) <= set(rows.columns) or c != "usage" and "reason" in rows.columns])
    out = sums
    for column, name, unknown in (("species_key", "species_counts", ""), ("canon_method", "canonicalization_methods", "unknown")):
        if column in rows.columns:
            each = rows.where("passed").groupBy(*by, F.coalesce(column, F.lit(unknown)).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
            out = out.join(each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_c")))).alias(name)), list(by), "left")
    return out


def usage_total(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens", "usd")]
    out = df.groupBy(*by).agg(*sums)
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def first_seen(attempts: DataFrame, by: Sequence[str], order: str = "i", keep: Sequence[str] = ("temperature",)) -> DataFrame:
    """Per species its first index and what stood there."""
    return attempts.where("passed").groupBy(*by, "species").agg(F.min(order).alias("first_seen_index"), *[F.min_by(c, order).alias(c) for c in keep])


def require_one_condition(df: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """The rows, failing when a group mixes conditions: their samples must never be pooled."""
    low, high = F.min(key).over(W.partitionBy(*by)), F.max(key).over(W.partitionBy(*by))
    marked = df.withColumns({"_low": low, "_high": high})
    return require(marked, F.col("_low").eqNullSafe(F.col("_high")), F.concat(F.lit("mixed conditions: "), F.col("_low"), F.lit(" and "), F.col("_high"))).drop("_low", "_high")
