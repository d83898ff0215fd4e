"""Arm analysis: conditional aggregates of result files, pivots, exact tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvefront.functions.statistics import fisher_exact, with_clopper_pearson

# Outcomes of the grading harness.
INFRASTRUCTURE = ("incomplete", "")
WRONG_ARTIFACT = "error"
NO_PATCH = "empty_patch"


def valid_rows(df: DataFrame, result: str = "eval_result") -> DataFrame:
    """Without infrastructure failures; a row without a result is valid, and so is an error of the agent."""
    return df.where(F.coalesce(~F.col(result).isin(*INFRASTRUCTURE), F.lit(True)))


def arm_table(df: DataFrame, by: Sequence[str] = ("arm",), *, interval: bool = True) -> DataFrame:
    """Counts and means per arm over valid rows, how many were infrastructure failures, and exact intervals of the shares.

    An arm whose rows all failed in the infrastructure keeps its row, with n = 0.
    """
    valid = F.coalesce(~F.col("eval_result").isin(*INFRASTRUCTURE), F.lit(True))
    rows = df.select(*by, "eval_result", *[F.when(valid, F.col(c)).alias(c) for c in df.columns if c not in (*by, "eval_result")], valid.alias("_valid"))
    extra = [F.count_if(F.col("pass_at_n")).alias("pass_at_n"), (F.count_if(F.col("pass_at_n")) - F.count_if(F.col("passed"))).alias("selection_headroom")] if "pass_at_n" in df.columns else []
    if "usage" in df.columns:
        extra.append(F.avg("usage.completion_tokens").alias("mean_completion_tokens"))
    if "n_candidates_cfg" in df.columns:
        extra.append(F.max("n_candidates_cfg").alias("n_candidates"))
    out = rows.groupBy(*by).agg(
        F.count_if("_valid").alias("n"), F.count_if(~F.col("_valid")).alias("infra_excluded"), F.count_if(F.col("passed")).alias("resolved"), F.count_if(F.col("tool_calls") > 0).alias("used_tools"),
        F.sum("tool_calls").alias("total_tool_calls"), F.sum("generations").alias("total_generations"),
        F.count_if(F.col("_valid") & F.coalesce(F.col("eval_result") != NO_PATCH, F.lit(True))).alias("nonempty"), F.count_if(F.col("eval_result") == WRONG_ARTIFACT).alias("wrong_artifact"),
        F.avg("elapsed_s").alias("mean_elapsed_s"), *extra)
    if not interval:
        return out
    for count, prefix in (("resolved", "ci"), ("used_tools", "tools"), *([("pass_at_n", "pass_at_n")] if "pass_at_n" in df.columns else [])):
        out = with_clopper_pearson(out, count, "n", prefix)
    return out


def language_pivot(df: DataFrame, languages: Sequence[str], arm: str = "arm", language: str = "language") -> DataFrame:
    """resolved and n per arm and language, languages as columns."""
    cells = valid_rows(df).groupBy(arm).pivot(language, list(languages))
    return cells.agg(F.count_if(F.col("passed")).alias("resolved"), F.count(F.lit(1)).alias("n"))


def language_totals(df: DataFrame, arm: str = "arm", language: str = "language") -> DataFrame:
    """The same in long form with a null language for each arm's total, by grouping sets in one pass."""
    rows = valid_rows(df)
    return rows.groupingSets([[F.col(arm), F.col(language)], [F.col(arm)]], F.col(arm), F.col(language)).agg(F.count_if(F.col("passed")).alias("resolved"), F.count_if(F.col("tool_calls") > 0).alias("used_tools"), F.count(F.lit(1)).alias("n"))


def against_baseline(arms: DataFrame, baseline: str, count: str = "resolved", arm: str = "arm", **options) -> DataFrame:
    """Fisher's exact test of each arm against one."""
    base = arms.where(F.col(arm) == baseline).select(F.col(count).alias("_c"), F.col("n").alias("_n"))
    rest = arms.where(F.col(arm) != baseline).crossJoin(F.broadcast(base.limit(1)))  # a single row
    p = fisher_exact(F.col("_c"), F.col("_n") - F.col("_c"), F.col(count), F.col("n") - F.col(count), **options)
    return rest.select(arm, count, "n", p.alias("p_value"))


def labelled(df: DataFrame, labels: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Add the arm's label from ``labels`` (model, agent, label), or model and agent where there is none; best-of-N arms say their N."""
    names = df.sparkSession.createDataFrame(list(labels), "model string, agent_src string, arm string")
    out = df.join(F.broadcast(names), ["model", "agent_src"], "left").withColumn("arm", F.coalesce("arm", F.concat_ws(" | ", "model", "agent_src")))  # the caller's list
    if "n_candidates_cfg" not in df.columns:
        return out
    best_of = F.when(F.col("n_candidates_cfg") > 1, F.concat(F.lit(" bo"), F.col("n_candidates_cfg").cast("string"))).otherwise(F.lit(""))
    return out.withColumn("arm", F.concat("arm", best_of))
