"""Scaffolds replayed from logs: what each would have chosen, drawn and asked, as relations instead of loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from solvefront.functions.statistics import require
from solvefront.functions.text import extract_code, verdict
from solvefront.operators.budget import match_report
from solvefront.operators.compare import ablation_effect, baseline_at_budget, comparison
from solvefront.operators.selection import consensus

# Execution backends, and whether each isolates the code it runs.
BACKENDS = (("docker", True), ("subprocess", False))


def with_backend(runs: DataFrame, backend: str = "backend") -> DataFrame:
    """Add is_security_boundary to execution logs; a backend that is not known is an error."""
    flag = F.lit(None).cast("boolean")
    for name, isolates in BACKENDS:
        flag = F.when(F.col(backend) == name, isolates).otherwise(flag)
    return require(runs.withColumn("is_security_boundary", flag), F.col("is_security_boundary").isNotNull(), F.concat(F.lit("unknown backend "), F.coalesce(F.col(backend), F.lit("null"))))


def single_shot(completions: DataFrame, runs: DataFrame, marker: str, by: Sequence[str] = ("task_id",)) -> DataFrame:
    """One completion a task: its code, and the reason and verdict of its one replayed execution.

    ``completions`` (by, completion), ``runs`` (by, timed_out, stdout,
    exit_code).  Code that was never run, unless it is empty, is an error.
    """
    code = completions.withColumn("code", extract_code(F.col("completion")))
    joined = code.join(runs.withColumn("_run", F.lit(True)), list(by), "left")
    ran = require(joined, F.col("_run").isNotNull() | (F.trim(F.coalesce("code", F.lit(""))) == ""), F.concat(F.lit("no execution of "), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by]))
    out = ran.withColumn("reason", verdict(F.col("code"), F.coalesce("timed_out", F.lit(False)), F.coalesce("stdout", F.lit("")), F.coalesce("exit_code", F.lit(0)), marker))
    return out.withColumn("passed", F.col("reason") == "ok").drop("_run", "timed_out", "stdout", "exit_code")


def self_test(tasks: DataFrame, runs: DataFrame, marker: str, reference: str = "reference_solution") -> DataFrame:
    """(task_id, reason, passed): the verdict of each task's own reference solution; a task without one has null for both."""
    have = tasks.where(F.col(reference).isNotNull()).select("task_id", F.col(reference).alias("code"))
    judged = have.join(runs, "task_id", "left").withColumn("reason", verdict(F.col("code"), F.coalesce("timed_out", F.lit(False)), F.coalesce("stdout", F.lit("")), F.coalesce("exit_code", F.lit(0)), marker))
    return tasks.select("task_id").join(judged.select("task_id", "reason", (F.col("reason") == "ok").alias("passed")), "task_id", "left")


def staged_candidates(log: DataFrame, by: Sequence[str], *, repairs: int, candidates: int, calls: int | None = None, stop_early: bool = False) -> DataFrame:
    """The rows of a full log that a run with these limits would have drawn, with ``last`` on each candidate's final code.

    ``log`` (by, candidate, step, compiles, public_ok): every repair of every
    candidate, in order.  A candidate ends at the first code that compiles and
    does not fail the public tests, or after ``repairs`` repairs; a run ends
    after ``calls`` rows, or with ``stop_early`` at the first candidate whose
    final code passed the public tests.
    """
    group = W.partitionBy(*by)
    within = W.partitionBy(*by, "candidate").orderBy("step")
    done = (F.col("compiles") & F.coalesce(F.col("public_ok"), F.lit(True))).cast("int")
    earlier = F.coalesce(F.max(done).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = log.where((F.col("step") <= repairs) & (F.col("candidate") < candidates)).withColumn("_done", earlier).where("_done = 0").drop("_done")
    if stop_early:
        passing = F.min(F.when(F.col("compiles") & F.coalesce(F.col("public_ok"), F.lit(False)), F.col("candidate"))).over(group)
        rows = rows.withColumn("_first", passing).where(F.col("_first").isNull() | (F.col("candidate") <= F.col("_first"))).drop("_first")
    if calls is not None:
        rows = rows.withColumn("_n", F.row_number().over(group.orderBy("candidate", "step"))).where(F.col("_n") <= calls).drop("_n")
    return rows.withColumn("last", F.lead(F.lit(1)).over(within).isNull())


def staged_choice(log: DataFrame, hidden: DataFrame, by: Sequence[str] = ("task_id",), key: str = "key", **limits) -> DataFrame:
    """Per group: candidates, those that pass in public, the consensus among them (among all where none does), and its one hidden verdict.

    The hidden verdicts (by, candidate, step, passed) meet the choice only
    once it is made; no other row of theirs is read into the result.
    """
    finals = staged_candidates(log, by, **limits).where("last")
    ok = F.coalesce(F.col("public_ok"), F.lit(False)) & F.col("compiles")
    counted = finals.groupBy(*by).agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(ok).alias("n_public_passing"))
    pool = finals.withColumn("_ok", ok).withColumn("_any", F.max(F.col("_ok")).over(W.partitionBy(*by))).where(F.col("_ok") | ~F.col("_any"))
    chosen = consensus(pool, by, key, "candidate", keep=["step"]).withColumnRenamed("first_index", "candidate")
    graded = chosen.join(hidden.select(*by, "candidate", "step", "passed"), [*by, "candidate", "step"], "left")
    return counted.join(graded, list(by), "left")


def merged_counts(rows: DataFrame, by: Sequence[str], counts: str = "op_counts") -> DataFrame:
    """One map of counts per group, the sum of its rows' maps."""
    each = rows.select(*by, F.explode(counts).alias("_k", "_c")).groupBy(*by, "_k").agg(F.sum("_c").alias("_c"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_c")))).alias(counts))


def add_counts(a: Column, b: Column) -> Column:
    """Sum of two maps of counts; a missing key is 0, a null map is empty."""
    none = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def suite_comparison(summaries: DataFrame, records: DataFrame, spend: DataFrame, budget: int, on: str = "task_id") -> DataFrame:
    """Each task's summary against the single-shot baseline at the same budget, with whether the systems' spend matched.

    Tasks without a record are an error; without spend ``matched`` is null.
    """
    gains = comparison(summaries, baseline_at_budget(records, budget), on)
    return gains.join(match_report(spend, on), on, "left")


def suite_ablation(full: DataFrame, ablated: DataFrame, on: str = "task_id") -> DataFrame:
    """Per removed operation over the suite: tasks, solves removed, and on how many tasks it carried the result.

    ``ablated`` holds one summary per task and ``operation``.
    """
    ops = ablated.select("operation").distinct()
    base = full.select(on, "n_solved").crossJoin(F.broadcast(ops))  # operations are a registry's few
    pair = F.struct(F.col(on), F.col("operation"))
    effect = ablation_effect(base.select(pair.alias("pair"), "n_solved"), ablated.select(pair.alias("pair"), "n_solved"), "pair")
    return effect.groupBy(F.col("pair.operation").alias("operation")).agg(F.count(F.lit(1)).alias("n_tasks"), F.sum("removed").alias("removed"), F.count_if("load_bearing").alias("load_bearing_tasks"))


def intercepted_attempts(model_calls: DataFrame, verifier_calls: DataFrame, session: str = "session_id", sequence: str | None = None) -> DataFrame:
    """One attempt per session of an intercepted run: calls, tokens, the last verdict, and when it began and how long it took.

    ``model_calls`` (session, ts, prompt_tokens, completion_tokens, status),
    ``verifier_calls`` (session, ts, passed).  Failed calls count in n_calls only.
    Of the last checks at one instant the one of the greatest ``sequence``, a
    column of the checks, counts; without such a column they pass only if all do.
    """
    last = F.struct("ts", F.col(sequence) if sequence else ~F.coalesce("passed", F.lit(False)))
    good = F.col("status").between(200, 299)
    calls = model_calls.groupBy(session).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(good).alias("calls"), *[F.coalesce(F.sum(F.when(good, F.coalesce(c, F.lit(0)))), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")],
        F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    checks = verifier_calls.groupBy(session).agg(F.count(F.lit(1)).alias("n_checks"), F.max_by("passed", last).alias("passed"), F.min("ts").alias("_vfirst"), F.max("ts").alias("_vlast"))
    both = calls.join(checks, session, "full").withColumns({"created_at": F.least("_first", "_vfirst"), "_end": F.greatest("_last", "_vlast")})
    seconds = (F.unix_micros(F.col("_end").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(1e6)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_calls", "calls", "prompt_tokens", "completion_tokens", "n_checks")}
    return both.withColumns(zero).withColumns({"passed": F.coalesce("passed", F.lit(False)), "elapsed_s": seconds}).drop("_first", "_last", "_vfirst", "_vlast", "_end")


def run_agent(tasks: DataFrame, agent, schema: str, seed: int = 0) -> DataFrame:
    """Rows that a caller's ``agent(row, seed)`` yields for each task, on the executors, a task's rows at a time.

    The seed is derived from the task, so a lost executor's rows come out the same again.
    """
    import zlib

    def run(parts):
        import pandas as pd

        for part in parts:
            for row in part.to_dict("records"):
                made = list(agent(row, zlib.crc32(f"{seed}:{row['task_id']}".encode())))
                if made:
                    yield pd.DataFrame(made)

    return tasks.mapInPandas(run, schema)


def backends(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BACKENDS), "backend string, is_security_boundary boolean")
