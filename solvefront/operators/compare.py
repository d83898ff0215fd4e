"""Matched-compute comparison, ablation, crossing verdicts, placement, archive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvefront.functions.statistics import inverse_incomplete_beta_udf, pass_at_k, require, with_clopper_pearson
from solvefront.operators.windows import windows_like

# The four rows of the placement matrix.
ROWS = {"bounded": "bounded_search", "elicitation": "superhuman_elicitation", "genuine": "genuine_expansion", "illusory": "illusory_expansion"}


def solve_summary(attempts: DataFrame, by: Sequence[str] = ("system", "task_id"), *, interval: bool = True, exclude_exhausted: bool = False) -> DataFrame:
    """Per system and task: repetitions, solved, means, exhausted, and the share of solved ones that used an expanding operation (0 if none).

    Exhausted attempts count in the denominator unless excluded.
    """
    rows = attempts.where(~F.col("exhausted")) if exclude_exhausted else attempts
    solved = F.count_if(F.col("passed"))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_reps"), solved.alias("n_solved"), F.avg("calls").alias("mean_calls"), F.avg("tokens").alias("mean_total_tokens"),
        F.count_if(F.col("exhausted")).alias("n_budget_exhausted"),
        F.coalesce(F.try_divide(F.count_if(F.col("passed") & F.col("used_expanding")), solved), F.lit(0.0)).alias("expanding_dependency"))
    return with_clopper_pearson(out, "n_solved", "n_reps") if interval else out.withColumn("p_hat", F.col("n_solved") / F.col("n_reps"))


def op_count_map(trace: DataFrame, by: Sequence[str], op: str = "op") -> DataFrame:
    counts = trace.groupBy(*by, op).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(op, "n")))).alias("op_counts"))


def baseline_at_budget(records: DataFrame, budget: int) -> DataFrame:
    """pass@budget off larger records, with the interval's ends pushed through it; too few samples is an error."""
    n, c, b = F.col("n_samples"), F.col("n_correct"), F.lit(budget)
    enough = F.when(n >= budget, n).otherwise(F.raise_error(F.lit("fewer samples than the budget")))
    low = F.greatest(F.lit(0), (F.col("ci_low") * n).cast("bigint"))
    high = F.least(n, (F.col("ci_high") * n).cast("bigint") + 1)
    at = [pass_at_k(enough, x, b) for x in (low, high)]
    return records.withColumns({"s0_p_hat": pass_at_k(enough, c, b), "s0_low": F.least(*at), "s0_high": F.greatest(*at)})


def comparison(summaries: DataFrame, baseline: DataFrame, on: str = "task_id") -> DataFrame:
    """Gain of each summary over the baseline; a task without a baseline is an error."""
    joined = summaries.join(baseline.select(on, "s0_p_hat"), on, "left")
    there = require(joined, F.col("s0_p_hat").isNotNull(), F.concat(F.lit("no record for task "), F.col(on).cast("string")))
    return there.withColumn("elicitation_gain", F.col("p_hat") - F.col("s0_p_hat"))


def require_match(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join in which a left row without a partner is an error."""
    right = right.withColumn("_there", F.lit(True))
    joined = left.join(right, on, "left")
    return require(joined, F.col("_there").isNotNull(), F.concat(F.lit("no partner for "), F.col(on).cast("string"))).drop("_there")


def require_same(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join in which a row without a partner is an error on either side."""
    both = left.withColumn("_left", F.lit(True)).join(right.withColumn("_right", F.lit(True)), on, "full")
    return require(both, F.col("_left").isNotNull() & F.col("_right").isNotNull(), F.concat(F.lit("no partner for "), F.col(on).cast("string"))).drop("_left", "_right")


def missing_records(tasks: DataFrame, records: DataFrame, n: int, on: str = "task_id") -> DataFrame:
    """Tasks without a record of at least n samples."""
    return tasks.join(records.where(F.col("n_samples") >= n), on, "left_anti")


def ablation_effect(base: DataFrame, ablated: DataFrame, on: str = "task_id") -> DataFrame:
    """(on, removed, fraction_removed, load_bearing): solves lost when an operation is off, not below 0; a task on one side only is an error."""
    joined = require_same(base.select(on, F.col("n_solved").alias("b")), ablated.select(on, F.col("n_solved").alias("a")), on)
    removed = F.greatest(F.lit(0), F.col("b") - F.col("a"))
    return joined.select(on, removed.alias("removed"), F.coalesce(F.try_divide(removed, F.col("b")), F.lit(0.0)).alias("fraction_removed"), (F.col("a") < F.col("b")).alias("load_bearing"))


def crossing(records: DataFrame, evolved: DataFrame, ablated: DataFrame, k: int, of: int, on: str = "task_id", contested: Sequence[str] = ()) -> DataFrame:
    """The four-part verdict per task.

    A task with a record or an evolved summary only, an ablation of another
    task, and a budget other than the record's samples are errors; no
    ablation: null, and not crossed.
    """
    bar = F.lit(k / of)
    e = evolved.select(on, "n_solved", "n_reps", "budget_calls", *(["ops"] if "ops" in evolved.columns else []))
    a = ablated.select(on, F.coalesce(F.try_divide(F.col("n_solved"), F.col("n_reps")), F.lit(0.0)).alias("_ablated"))
    known = require_same(records.select(on, "n_samples", "beyond_frontier"), e, on)
    same = require(known, F.col("n_samples") == F.col("budget_calls"), F.lit("budget differs from the record's samples"))
    j = same.withColumn("_task", F.lit(True)).join(a.withColumn("_off", F.lit(True)), on, "full")
    j = require(j, F.col("_task").isNotNull(), F.concat(F.lit("ablation of another task: "), F.col(on).cast("string"))).drop("_task", "_off")
    out = j.withColumns({
        "reliable_solve": F.coalesce(F.try_divide(F.col("n_solved"), F.col("n_reps")) >= bar, F.lit(False)),
        "compute_matched": F.col("budget_calls") <= F.col("n_samples"),
        "ablation_removes": F.col("_ablated") < bar,
        "rests_on_contested": F.arrays_overlap("ops", F.array(*[F.lit(c) for c in contested])) if "ops" in evolved.columns and contested else F.lit(False)})
    crossed = F.col("reliable_solve") & F.col("beyond_frontier") & F.col("compute_matched") & F.coalesce("ablation_removes", F.lit(False))
    return out.withColumn("crossed", crossed).drop("_ablated", "n_solved", "n_reps", "n_samples", "budget_calls", "ops")


def placement(crossing_rate: Column, evolved_low: Column, baseline_high: Column, retention: Column, gap: Column, *, epsilon: float, retention_high: float, gap_high: float) -> Column:
    """Row of the matrix.  All thresholds are the caller's; unknown retention is not high, unknown gap is not large."""
    beats = evolved_low > baseline_high
    sound = F.coalesce(retention >= retention_high, F.lit(False)) & ~F.coalesce(gap >= gap_high, F.lit(False))
    return (
        F.when((crossing_rate <= epsilon) & beats, ROWS["elicitation"]).when(crossing_rate <= epsilon, ROWS["bounded"])
        .when(beats & sound, ROWS["genuine"]).otherwise(ROWS["illusory"])
    )


def overfitting_gap(train: Column, held_out: Column) -> Column:
    return train - held_out


def transfer_retention(held_out: Column, transfer: Column, base_held_out: Column, base_transfer: Column) -> Column:
    """Transfer gain over held-out gain; null if unmeasured or the latter is nil."""
    gain = held_out - base_held_out
    return F.when(F.abs(gain) < 1e-9, F.lit(None)).otherwise(F.try_divide(transfer - base_transfer, gain))


#: UTF-8 bytes of all literals up to which one automaton of them goes to every executor.
AUTOMATON_BYTES = 8 << 20


def hard_coded(archive: DataFrame, literals: DataFrame, source: str = "source_excerpt", literal: str = "literal", least: int = 6) -> DataFrame:
    """Archive rows whose source holds a task literal of at least ``least`` characters, a row per literal.

    Literals of :data:`AUTOMATON_BYTES` in all go to every executor as one
    automaton that reads each source once, whatever their number.  Beyond
    that each literal is known by its rarest piece of ``least`` characters:
    sources' pieces that are some literal's meet these in an equi-join, and
    what meets is compared whole.  Literals with one beginning have other pieces, so no key is hot.
    """
    found = literals.select(F.trim(F.col(literal)).alias("_l")).where(F.length("_l") >= least).distinct()
    size = found.agg(F.sum(F.octet_length("_l"))).first()[0] or 0
    if size <= AUTOMATON_BYTES:
        return _by_automaton(archive, [r[0] for r in found.collect()], source)
    starts = F.transform(F.sequence(F.lit(1), F.length("_l") - least + 1), lambda i: F.substring(F.col("_l"), i, F.lit(least)))
    pieces = found.select("_l", F.explode(F.array_distinct(starts)).alias("_piece"))
    counts = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    keyed = pieces.join(counts, "_piece").groupBy("_l").agg(F.min_by("_piece", F.struct("_n", F.xxhash64("_piece"))).alias("window"))
    # Sources go by their digest until a literal's piece has met one, so a long source is not copied for each piece.
    sources = archive.withColumn("_key", F.md5(F.col(source)))
    met = windows_like(sources.where("_key is not null"), source, ["_key"], keyed, "window").join(keyed, "window").select("_key", "_l").distinct()
    return sources.join(met, "_key").where(F.contains(source, F.col("_l"))).select(*archive.columns, F.col("_l").alias("literal"))


def _by_automaton(archive: DataFrame, words: list[str], source: str) -> DataFrame:
    sent = archive.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("array<string>")
    def inside(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()  # once a task, not once a batch
        for w in sent.value:
            machine.add_word(w, w)
        if len(machine):
            machine.make_automaton()
        for text in texts:
            yield text.map(lambda t: sorted({w for _, w in machine.iter(t)}) if t and len(machine) else [])

    return archive.withColumn("literal", F.explode(inside(source)))


def thompson_parameters(nodes: DataFrame, utility: str = "mean_utility", evals: str = "evals") -> DataFrame:
    """Posterior of each candidate node: finite and positive utility, or all finite ones if none is positive."""
    finite = nodes.where(F.col(utility).isNotNull() & ~F.isnan(utility) & (F.abs(F.col(utility)) < float("inf")))
    some = finite.agg(F.max((F.col(utility) > 0).cast("int")).alias("_any"))
    kept = finite.crossJoin(F.broadcast(some)).where((F.col("_any") == 0) | (F.col(utility) > 0)).drop("_any")  # one row against all
    total = F.aggregate(evals, F.lit(0.0), lambda a, x: a + x)
    return kept.withColumn("alpha", total + 1).withColumn("beta", F.size(evals) - total + 1)


def thompson_draw(posteriors: DataFrame, node: str, seed: int = 0) -> DataFrame:
    """Add theta, a draw from each node's posterior, and ``chosen`` on the largest; ties go to the greater md5 of seed and node.

    The draw inverts the posterior's distribution function at a uniform number
    from the first 52 bits of that md5, so it depends on the node alone: not
    on rows beside it, their order or their partition.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(node).cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    drawn = posteriors.withColumn("theta", inverse_incomplete_beta_udf()(F.col("alpha").cast("double"), F.col("beta").cast("double"), u)).withColumn("_tie", digest)
    best = drawn.agg(F.max(F.struct("theta", "_tie")).alias("_best"))
    return drawn.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("_tie") == F.col("_best._tie")).drop("_best", "_tie")  # one row against all
