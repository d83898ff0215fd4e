"""Comparison, verdicts, arms, traces, selection, manifests, code and text over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from solvefront.functions import code as co
from solvefront.functions import statistics as st
from solvefront.functions import text as tx
from solvefront.operators import arms as ar
from solvefront.operators import compare as cm
from solvefront.operators import frontier as fr
from solvefront.operators import selection as se
from solvefront.operators import simulate as si
from solvefront.operators import trace as tr
from solvefront.plans.bindings import SQL_ARMS, SQL_ATTEMPTS, SQL_CP, SQL_INDEXED, arm_rows, attempts, indexed, shared_path, table
from solvefront.plans.registry import query

R = lambda c, d=8: F.round(c, d)

_SOLVE = """s AS (SELECT system, task_id, COUNT(*) AS n_reps, COUNT(*) FILTER (passed) AS n_solved, AVG(calls) AS mean_calls, AVG(tokens) AS mean_total_tokens, COUNT(*) FILTER (exhausted) AS n_budget_exhausted,
  COALESCE(COUNT(*) FILTER (passed AND used_expanding) / nullif(COUNT(*) FILTER (passed), 0), 0.0) AS expanding_dependency FROM attempts GROUP BY ALL)"""


@query("WITH RECURSIVE " + SQL_ATTEMPTS + ", " + _SOLVE + ", cp_in AS (SELECT n_solved AS c, n_reps AS n FROM s), " + SQL_CP + " SELECT system, task_id, n_reps, n_solved, round(mean_calls, 6) AS mean_calls, round(mean_total_tokens, 6) AS mean_total_tokens, n_budget_exhausted, round(expanding_dependency, 6) AS expanding_dependency, round(low, 6) AS ci_low, round(high, 6) AS ci_high FROM s JOIN cp ON n_solved = c AND n_reps = n")
def solve_rate_summary(spark, sf):
    s = cm.solve_summary(attempts(spark, sf))
    return s.select("system", "task_id", "n_reps", "n_solved", "n_budget_exhausted", *[R(c, 6).alias(c) for c in ("mean_calls", "mean_total_tokens", "expanding_dependency", "ci_low", "ci_high")])


_P = "CASE WHEN {c} = 0 THEN 0.0::DOUBLE WHEN n - {c} < 20 THEN 1.0::DOUBLE ELSE 1 - list_aggregate(list_transform(range(n - {c} + 1, n + 1), lambda i: 1 - 20 / i::DOUBLE), 'product') END"


@query("WITH RECURSIVE " + SQL_ATTEMPTS + ", s AS (SELECT task_id, COUNT(*) AS n, COUNT(*) FILTER (passed) AS c FROM attempts WHERE system = 'O' GROUP BY 1), cp_in AS (SELECT c, n FROM s), " + SQL_CP + ", e AS (SELECT task_id, s.n, s.c, trunc(low * s.n)::BIGINT AS a, least(s.n, trunc(high * s.n)::BIGINT + 1) AS b FROM s JOIN cp ON s.c = cp.c AND s.n = cp.n) SELECT task_id, round(" + _P.format(c="c") + ", 8) AS s0_p_hat, round(" + _P.format(c="a") + ", 8) AS s0_low, round(" + _P.format(c="b") + ", 8) AS s0_high FROM e")
def baseline_at_budget(spark, sf):
    r = st.with_clopper_pearson(fr.rates(attempts(spark, sf).where("system = 'O'"), ["task_id"]), "n_correct", "n_samples")
    return cm.baseline_at_budget(r, 20).select("task_id", *[R(c).alias(c) for c in ("s0_p_hat", "s0_low", "s0_high")])


@query("WITH " + SQL_ATTEMPTS + ", s AS (SELECT task_id, COUNT(*) FILTER (system = 'O') AS n, COUNT(*) FILTER (system = 'O' AND passed) AS c, COUNT(*) FILTER (system = 'F' AND passed) / COUNT(*) FILTER (system = 'F') AS p FROM attempts GROUP BY 1) SELECT task_id, round(p - (" + _P.format(c="c") + "), 8) AS elicitation_gain FROM s")
def elicitation_gain(spark, sf):
    a = attempts(spark, sf)
    r = st.with_clopper_pearson(fr.rates(a.where("system = 'O'"), ["task_id"]), "n_correct", "n_samples")
    s = cm.solve_summary(a.where("system = 'F'"), interval=False)
    return cm.comparison(s, cm.baseline_at_budget(r, 20)).select("task_id", R("elicitation_gain").alias("elicitation_gain"))


_ABL = "b AS (SELECT task_id, COUNT(*) FILTER (passed AND system = 'F') AS b, COUNT(*) FILTER (passed AND system = 'F' AND NOT used_expanding) AS a FROM attempts GROUP BY 1)"


@query("WITH " + SQL_ATTEMPTS + ", " + _ABL + " SELECT task_id, greatest(0, b - a) AS removed, round(COALESCE(greatest(0, b - a) / nullif(b, 0), 0.0), 8) AS fraction_removed, a < b AS load_bearing FROM b")
def ablation_effect(spark, sf):
    a = attempts(spark, sf).where("system = 'F'")
    s = lambda rows: cm.solve_summary(rows, ["task_id"], interval=False)
    return cm.ablation_effect(s(a), s(a.withColumn("passed", F.col("passed") & ~F.col("used_expanding")))).withColumn("fraction_removed", R("fraction_removed"))


@query("WITH " + SQL_ATTEMPTS + """, s AS (SELECT task_id, COUNT(*) AS n, COUNT(*) FILTER (passed AND used_expanding) AS c, COUNT(*) FILTER (species = '0.05|0.05') AS z FROM attempts GROUP BY 1)
SELECT task_id, z = 0 AS beyond_frontier, c / n >= 0.1 AS reliable_solve, true AS compute_matched, CASE WHEN task_id % 5 <> 0 THEN false END AS rests, CASE WHEN task_id % 5 <> 0 THEN 0.0 < 0.1 END AS ablation_removes, c / n >= 0.1 AND z = 0 AND task_id % 5 <> 0 AS crossed FROM s""".replace("CASE WHEN task_id % 5 <> 0 THEN false END AS rests, ", "false AS rests_on_contested, "))
def crossing_verdict(spark, sf):
    a = attempts(spark, sf)
    rec = a.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_samples"), (F.count_if(F.col("species") == "0.05|0.05") == 0).alias("beyond_frontier"))
    evolved = a.groupBy("task_id").agg(F.count_if(F.col("passed") & F.col("used_expanding")).alias("n_solved"), F.count(F.lit(1)).alias("n_reps")).withColumn("budget_calls", F.col("n_reps"))
    ablated = evolved.where("task_id % 5 <> 0").select("task_id", F.lit(0).alias("n_solved"), "n_reps")
    return cm.crossing(rec, evolved, ablated, 1, 10)


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 0 AND c_custkey % 7 > c_nationkey % 5 THEN 'superhuman_elicitation' WHEN c_acctbal <= 0 THEN 'bounded_search' WHEN c_custkey % 7 > c_nationkey % 5 AND COALESCE(CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey / 25.0 END >= 0.5, false) AND NOT COALESCE(CASE WHEN c_nationkey % 6 <> 0 THEN c_custkey % 10 / 10.0 END >= 0.2, false) THEN 'genuine_expansion' ELSE 'illusory_expansion' END AS placement FROM customer")
def interpretation_matrix(spark, sf):
    c = table(spark, sf, "customer")
    retention = F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey") / 25.0)
    gap = F.when(F.col("c_nationkey") % 6 != 0, (F.col("c_custkey") % 10) / 10.0)
    return c.select("c_custkey", cm.placement(F.col("c_acctbal"), F.col("c_custkey") % 7, F.col("c_nationkey") % 5, retention, gap, epsilon=0.0, retention_high=0.5, gap_high=0.2).alias("placement"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 3 <> 0 THEN s_acctbal / 10000 - s_nationkey / 25.0::DOUBLE END AS gap, round(CASE WHEN s_nationkey % 3 <> 0 AND abs(s_nationkey / 25.0::DOUBLE - 0.2) >= 1e-9 THEN (s_acctbal / 10000 - 0.1) / (s_nationkey / 25.0::DOUBLE - 0.2) END, 8) AS retention FROM supplier")
def archive_gap_and_retention(spark, sf):
    s = table(spark, sf, "supplier")
    held = F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey") / F.lit(25.0))
    return s.select("s_suppkey", cm.overfitting_gap(F.col("s_acctbal") / 10000, held).alias("gap"), R(cm.transfer_retention(held, F.col("s_acctbal") / 10000, F.lit(0.2), F.lit(0.1))).alias("retention"))


@query("WITH l AS (SELECT DISTINCT trim(text) AS literal FROM benchmark WHERE length(trim(text)) >= 6) SELECT doc_id, literal FROM documents JOIN l ON contains(text, literal)")
def hard_coded_literals(spark, sf):
    lits = table(spark, sf, "benchmark").select(F.col("text").alias("literal"))
    return cm.hard_coded(table(spark, sf, "documents").select("doc_id", F.col("text").alias("source_excerpt")), lits).select("doc_id", "literal")


@query("WITH n AS (SELECT l_suppkey, AVG(l_discount) AS u, SUM(l_quantity) AS t, COUNT(*) AS k FROM lineitem GROUP BY 1) SELECT l_suppkey, t + 1 AS alpha, k - t + 1 AS beta FROM n WHERE u > 0")
def thompson_posterior(spark, sf):
    nodes = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("mean_utility"), F.collect_list("l_quantity").alias("evals"))
    return cm.thompson_parameters(nodes).select("l_suppkey", "alpha", "beta")


@query("WITH RECURSIVE " + SQL_ATTEMPTS + """, n AS (
  SELECT task_id, COUNT(*) FILTER (passed) + 1 AS a, COUNT(*) FILTER (NOT passed) + 1 AS b, md5('7:' || task_id) AS h FROM attempts GROUP BY 1),
u AS (SELECT *, (('0x' || substr(h, 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u FROM n),
steps(task_id, a, b, h, u, k, lo, hi) AS (
  SELECT task_id, a, b, h, u, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM u
  UNION ALL
  SELECT task_id, a, b, h, u, k + 1, CASE WHEN below < u THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below < u THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT *, list_sum(list_transform(range(a, a + b), lambda i: exp(lgamma(a + b) - lgamma(i + 1) - lgamma(a + b - i) + i * ln((lo + hi) / 2) + (a + b - 1 - i) * ln(1 - (lo + hi) / 2)))) AS below
        FROM steps WHERE k < 40)),
t AS (SELECT task_id, a, b, h, (lo + hi) / 2 AS theta FROM steps WHERE k = 40)
SELECT task_id, a::DOUBLE AS alpha, b::DOUBLE AS beta, round(theta, 6) AS theta, row_number() OVER (ORDER BY theta DESC, h DESC) = 1 AS chosen FROM t""")
def thompson_draw(spark, sf):
    """One draw from each task's posterior of its pass rate, and the task to go on with."""
    each = attempts(spark, sf).groupBy("task_id").agg(F.avg(F.col("passed").cast("double")).alias("mean_utility"), F.collect_list(F.col("passed").cast("double")).alias("evals"))
    drawn = cm.thompson_draw(cm.thompson_parameters(each), "task_id", seed=7)
    return drawn.select("task_id", "alpha", "beta", R("theta", 6).alias("theta"), "chosen")


@query("WITH " + SQL_ATTEMPTS + ", r AS (SELECT task_id, COUNT(*) AS n FROM attempts GROUP BY 1) SELECT s_suppkey AS task_id FROM supplier WHERE s_suppkey NOT IN (SELECT task_id FROM r WHERE n >= 600)")
def missing_records(spark, sf):
    return cm.missing_records(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("task_id")), fr.rates(attempts(spark, sf), ["task_id"]), 600)


@query("WITH " + SQL_ATTEMPTS + " SELECT s_suppkey AS task_id, s_name, COUNT(*) AS n_samples FROM supplier JOIN attempts ON s_suppkey = task_id GROUP BY ALL")
def tasks_with_records(spark, sf):
    tasks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("task_id"), "s_name")
    return cm.require_match(tasks, fr.rates(attempts(spark, sf), ["task_id"]).select("task_id", "n_samples"), "task_id")


# --- arms ----------------------------------------------------------------------------------------------------

_ARM = "infra AS (SELECT arm AS a, COUNT(*) FILTER (NOT COALESCE(eval_result NOT IN ('incomplete', ''), true)) AS infra_excluded FROM rows_ GROUP BY 1), t AS (SELECT arm, COUNT(*) AS n, COUNT(*) FILTER (passed) AS resolved, COUNT(*) FILTER (tool_calls > 0) AS used_tools, SUM(tool_calls)::BIGINT AS total_tool_calls, SUM(generations)::BIGINT AS total_generations, COUNT(*) FILTER (COALESCE(eval_result <> 'empty_patch', true)) AS nonempty, COUNT(*) FILTER (eval_result = 'error') AS wrong_artifact, AVG(elapsed_s) AS mean_elapsed_s, COUNT(*) FILTER (pass_at_n) AS pass_at_n, COUNT(*) FILTER (pass_at_n) - COUNT(*) FILTER (passed) AS selection_headroom FROM valid GROUP BY 1)"


@query("WITH " + SQL_ARMS + ", " + _ARM + " SELECT t.* REPLACE (round(mean_elapsed_s, 4) AS mean_elapsed_s), infra_excluded FROM t JOIN infra ON arm = a")
def arm_table(spark, sf):
    return ar.arm_table(arm_rows(spark, sf), interval=False).withColumn("mean_elapsed_s", R("mean_elapsed_s", 4))


@query("WITH RECURSIVE " + SQL_ARMS + ", " + _ARM + ", cp_in AS (SELECT resolved AS c, n FROM t UNION SELECT used_tools, n FROM t UNION SELECT pass_at_n, n FROM t), " + SQL_CP + """
SELECT arm, round(x.low, 6) AS ci_low, round(x.high, 6) AS ci_high, round(y.low, 6) AS tools_low, round(y.high, 6) AS tools_high, round(z.low, 6) AS pass_at_n_low, round(z.high, 6) AS pass_at_n_high
FROM t JOIN cp x ON x.c = resolved AND x.n = t.n JOIN cp y ON y.c = used_tools AND y.n = t.n JOIN cp z ON z.c = t.pass_at_n AND z.n = t.n""")
def arm_intervals(spark, sf):
    ends = [f"{p}_{e}" for p in ("ci", "tools", "pass_at_n") for e in ("low", "high")]
    return ar.arm_table(arm_rows(spark, sf)).select("arm", *[R(c, 6).alias(c) for c in ends])


@query("WITH " + SQL_ARMS + " SELECT arm, language, COUNT(*) FILTER (passed) AS resolved, COUNT(*) FILTER (tool_calls > 0) AS used_tools, COUNT(*) AS n FROM valid GROUP BY GROUPING SETS ((arm, language), (arm))")
def language_totals(spark, sf):
    return ar.language_totals(arm_rows(spark, sf))


@query("WITH " + SQL_ARMS + " SELECT arm, " + ", ".join(f"COUNT(*) FILTER (passed AND language = '{y}') AS \"{y}_resolved\", COUNT(*) FILTER (language = '{y}') AS \"{y}_n\"" for y in range(1992, 2002)) + " FROM valid GROUP BY 1")
def language_pivot(spark, sf):
    return ar.language_pivot(arm_rows(spark, sf), [str(y) for y in range(1992, 2002)]).na.fill(0)


def _fisher_sql(fits: str) -> str:
    lp = "(lgamma(r1 + 1) - lgamma(x + 1) - lgamma(r1 - x + 1) + lgamma(r2 + 1) - lgamma(c1 - x + 1) - lgamma(r2 - c1 + x + 1) - lgamma(r1 + r2 + 1) + lgamma(c1 + 1) + lgamma(r1 + r2 - c1 + 1))"
    return "WITH " + SQL_ARMS + f""", t AS (SELECT arm, COUNT(*) AS n, COUNT(*) FILTER (passed) AS resolved FROM valid GROUP BY 1),
m AS (SELECT b.resolved AS a, b.n AS r1, t.n AS r2, b.resolved + t.resolved AS c1, t.arm, t.resolved, t.n FROM t, t b WHERE b.arm = '1-URGENT' AND t.arm <> '1-URGENT'),
p AS (SELECT *, exp({lp.replace('x', 'a').replace('eap', 'exp')}) AS seen, list_transform(range(greatest(0, c1 - r2), least(r1, c1) + 1), lambda x: exp({lp})) AS ps FROM m)
SELECT arm, resolved, n, round(least(1.0, list_sum(list_filter(ps, lambda v: {fits}))), 6) AS p_value FROM p"""


@query(_fisher_sql("v <= seen * (1 + 1e-9)"))
def fisher_exact(spark, sf):
    return ar.against_baseline(ar.arm_table(arm_rows(spark, sf), interval=False), "1-URGENT").withColumn("p_value", R("p_value", 6))


_PV = "p AS (SELECT task_id, round(list_sum(list_transform(range(c, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.25) + (n - i) * ln(0.75)))), 6) AS p_value FROM (SELECT task_id, COUNT(*) AS n, COUNT(*) FILTER (passed) AS c FROM attempts GROUP BY 1) WHERE c > 0)"


@query("WITH " + SQL_ATTEMPTS + ", " + _PV + """, r AS (SELECT *, row_number() OVER (ORDER BY p_value, task_id) AS r, COUNT(*) OVER () AS m FROM p)
SELECT task_id, p_value, COALESCE(p_value <= (SELECT MAX(p_value) FROM r WHERE p_value <= r / m * 0.05), false) AS reject, round(least(1.0, MIN(p_value * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q_value FROM r""")
def benjamini_hochberg(spark, sf):
    s = fr.rates(attempts(spark, sf), ["task_id"]).where("n_correct > 0")
    p = s.select("task_id", R(st.binomial_tail(F.col("n_correct"), F.col("n_samples"), F.lit(0.25)), 6).alias("p_value"))
    return st.benjamini_hochberg(p).withColumn("q_value", R("q_value", 9))


@query()
def bootstrap_exact(spark, sf):
    return st.bootstrap_by_group(_solve_rates(spark, sf), "system", "rate")


_POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def _solve_rates(spark, sf):
    return attempts(spark, sf).groupBy("system", "task_id").agg(F.avg(F.col("passed").cast("int")).alias("rate"))


@query("WITH " + SQL_ATTEMPTS + ", x AS (SELECT system, task_id, AVG(passed::INT) AS v FROM attempts GROUP BY ALL), w AS (SELECT *, unnest(range(1, 10001)) AS b FROM x), " + f"""
u AS (SELECT *, ('0x' || substr(md5(b || ':' || task_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM w),
k AS (SELECT system, b, v, {" + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in _POISSON)} AS n FROM u),
mm AS (SELECT system, b, SUM(n * v) / SUM(n) AS mean FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY mean) AS r FROM mm)
SELECT system, round(MIN(mean) FILTER (r = 251), 6) AS low, round(MIN(mean) FILTER (r = 9750), 6) AS high FROM r GROUP BY 1""")
def bootstrap_hashed(spark, sf):
    rows = _solve_rates(spark, sf).withColumn("_id", F.col("task_id"))
    return st.bootstrap_hashed(rows, "system", "rate", resamples=10_000).select("system", R("low", 6).alias("low"), R("high", 6).alias("high"))


@query("WITH " + SQL_ATTEMPTS + """, x AS (SELECT system, task_id, AVG(passed::INT) AS v FROM attempts GROUP BY ALL),
r AS (SELECT system, v, row_number() OVER (PARTITION BY system ORDER BY task_id) - 1 AS r FROM x),
g AS (SELECT system, COUNT(*) AS n, AVG(v) AS point, ('0x' || substr(md5('0:0:' || system), 1, 7))::BIGINT AS s FROM x GROUP BY 1),
d AS (SELECT system, n, s, b, unnest(range(n)) AS j FROM (SELECT *, unnest(range(10000)) AS b FROM g)),
x1 AS (SELECT *, (b * 48271 + j * 69621 + s) % 2147483647 AS x FROM d),
x2 AS (SELECT *, (x * x % 2147483647 + b * 16807 + s) % 2147483647 AS y FROM x1),
x3 AS (SELECT *, (y * y % 2147483647 + j * 39373) % 2147483647 AS z FROM x2),
k AS (SELECT system, b, ((z * z % 2147483647 * 742938285 + z) % 2147483647) * n // 2147483647 AS r FROM x3),
m AS (SELECT system, b, AVG(v) AS mean FROM k JOIN r USING (system, r) GROUP BY ALL),
o AS (SELECT system, mean, row_number() OVER (PARTITION BY system ORDER BY mean) AS place FROM m)
SELECT g.system, round(ANY_VALUE(point), 6) AS point, round(MIN(mean) FILTER (place = 251), 6) AS low, round(MIN(mean) FILTER (place = 9750), 6) AS high, ANY_VALUE(n) AS draws FROM o JOIN g USING (system) GROUP BY 1""")
def bootstrap_multinomial(spark, sf):
    """The interval of each system's mean solve rate from 10,000 resamples, without a copy of a row."""
    from solvefront.functions.resampling import bootstrap_sums

    found = bootstrap_sums(_solve_rates(spark, sf), "system", ["rate"], "task_id")
    return found.select("system", *[R(c, 6).alias(c) for c in ("point", "low", "high")], "draws")


# --- traces --------------------------------------------------------------------------------------------------

_OPS = "ops AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'single_call' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'best_of_n' WHEN 'error' THEN 'execution_feedback' ELSE 'temperature_schedule' END AS op FROM events)"
_CLS = "cls AS (SELECT *, op IN ('execution_feedback', 'tool_call') AS e, op = 'temperature_schedule' AS k FROM ops)"


def _trace(spark, sf):
    kind = F.col("event_type")
    op = F.when(kind == "view", "single_call").when(kind == "click", "tool_call").when(kind == "purchase", "best_of_n").when(kind == "error", "execution_feedback").otherwise("temperature_schedule")
    return table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), op.alias("op"))


@query("WITH " + _OPS + ", " + _CLS + " SELECT user_id, md5(string_agg(DISTINCT CASE WHEN e THEN 'expanding' ELSE 'preserving' END, ',' ORDER BY CASE WHEN e THEN 'expanding' ELSE 'preserving' END)) AS classes, bool_or(e) AS used_expanding, COALESCE(string_agg(DISTINCT op, ',' ORDER BY op) FILTER (e), '') AS expanding_ops, COALESCE(string_agg(DISTINCT op, ',' ORDER BY op) FILTER (k), '') AS contested_ops FROM cls GROUP BY 1")
def trace_attribution(spark, sf):
    a = tr.attribution(tr.classify(_trace(spark, sf), tr.registry(spark)), ["user_id"])
    j = lambda c: F.array_join(c, ",")
    return a.select("user_id", "used_expanding", F.md5(j("classes").cast("binary")).alias("classes"), j("expanding_ops").alias("expanding_ops"), j("contested_ops").alias("contested_ops"))


@query("WITH " + _OPS + " SELECT user_id, op, COUNT(*) AS n FROM ops GROUP BY ALL")
def op_counts(spark, sf):
    m = cm.op_count_map(_trace(spark, sf), ["user_id"])
    return m.select("user_id", F.explode("op_counts").alias("op", "n"))


@query("SELECT op, class, rationale, contested FROM (VALUES " + ", ".join(f"('{op}', '{kind}', 'built in', {str(op in tr.CONTESTED).lower()})" for kind, ops in (("preserving", tr.PRESERVING), ("expanding", tr.EXPANDING)) for op in ops) + ") v(op, class, rationale, contested)")
def operation_registry(spark, sf):
    return tr.registry(spark)


def _calls(spark, sf):
    e = table(spark, sf, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    return e.select("user_id", F.col("event_id").alias("seq"), k.alias("n_messages"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), (F.col("event_id") % 7 != 0).cast("int").alias("n_choices"), F.floor("value").cast("bigint").alias("prompt_tokens"), F.when(F.col("event_id") % 3 != 0, F.lit(2)).cast("bigint").alias("completion_tokens"), F.floor("value").cast("bigint").alias("tokens"), (F.col("event_id") % 5 == 0).alias("had_tool_calls"))


_CALLS = "calls AS (SELECT user_id, event_id AS seq, COALESCE((props->>'$.k')::BIGINT, 0) AS n_messages, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, CASE WHEN event_id % 7 <> 0 THEN 1 ELSE 0 END AS n_choices, floor(value)::BIGINT AS prompt_tokens, CASE WHEN event_id % 3 <> 0 THEN 2 END AS completion_tokens, event_id % 5 = 0 AS had_tool_calls FROM events)"


@query("WITH " + _CALLS + ", s AS (SELECT *, COALESCE(SUM(ok::INT) OVER w, 0) AS s FROM calls WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id, seq, (s + greatest(0, COALESCE(MAX(n_messages - s) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS seen FROM s")
def trace_reconstruction(spark, sf):
    return tr.seen_before(_calls(spark, sf), ["user_id"], ["seq"]).select("user_id", "seq", "seen")


@query("WITH h AS (SELECT conv_id, turn, COUNT(*) OVER (PARTITION BY conv_id ORDER BY turn, text) AS n, COUNT(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn, text) AS u FROM conversations) SELECT conv_id, MAX(u) AS n_tool FROM h GROUP BY 1")
def tool_messages_total(spark, sf):
    h = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda m: F.struct(m["role"].alias("role"))).alias("messages"))
    return tr.tool_messages(h.withColumn("seen", F.lit(0)), role="user").select("conv_id", "n_tool")


@query("""WITH h AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) AS r FROM conversations WHERE role IN ('system', 'user'))
SELECT c.conv_id, sha256(COALESCE('[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY r) FILTER (r <= 2) || ']', '[]')) AS conversation FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN h ON h.conv_id = c.conv_id GROUP BY 1""")
def conversation_ids(spark, sf):
    h = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    return h.select("conv_id", tr.conversation_id().alias("conversation"))


@query("WITH " + _CALLS + " SELECT user_id, COUNT(*) AS calls, SUM(COALESCE(prompt_tokens, 0))::BIGINT AS prompt_tokens, SUM(COALESCE(completion_tokens, 0))::BIGINT AS completion_tokens FROM calls WHERE status BETWEEN 200 AND 299 AND n_choices > 0 GROUP BY 1")
def usage_from_events(spark, sf):
    return tr.usage_from_events(_calls(spark, sf), ["user_id"])


@query("WITH " + _CALLS + " SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 200) AS ok, COUNT(*) FILTER (status <> 200) AS failed, COUNT(*) FILTER (status = 200 AND had_tool_calls) AS with_tools, SUM(prompt_tokens) FILTER (status = 200)::BIGINT AS tokens FROM calls")
def run_summary(spark, sf):
    return tr.run_summary(_calls(spark, sf))


_VM = "v AS (SELECT conv_id AS session_id, turn AS seq, text AS error FROM conversations WHERE turn % 2 = 0), m AS (SELECT conv_id AS session_id, turn AS seq, text AS prompt FROM conversations), c AS (SELECT v.session_id, v.seq, EXISTS (SELECT 1 FROM m WHERE m.session_id = v.session_id AND m.seq > v.seq AND contains(m.prompt, substr(trim(v.error), 1, 6)) AND substr(trim(v.error), 1, 6) <> '') AS feedback FROM v)"


def _verifier(spark, sf):
    c = table(spark, sf, "conversations")
    return c.where("turn % 2 = 0").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("error")), c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("prompt"))


@query("WITH " + _VM.replace("1, 6", "1, 24") + " SELECT session_id, seq, feedback FROM c")
def conditioned_feedback(spark, sf):
    v, m = _verifier(spark, sf)
    return tr.conditioned(v, m).select("session_id", "seq", "feedback")


@query("WITH " + _VM.replace("1, 6", "1, 24") + " SELECT session_id, seq, CASE WHEN feedback THEN 'execution_feedback' ELSE 'test_guided_selection' END AS op FROM c UNION ALL SELECT session_id, seq, 'single_call' FROM m")
def event_classification(spark, sf):
    return tr.event_trace(*_verifier(spark, sf))


@query("WITH " + _OPS + " SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY op, seq) - 1 AS seq, op FROM ops")
def merged_traces(spark, sf):
    return tr.merge_traces(_trace(spark, sf).withColumn("sub", F.col("op")), ["user_id"]).select("user_id", F.col("seq").cast("bigint").alias("seq"), "op")


@query("WITH f AS (SELECT DISTINCT role AS arm, conv_id, turn FROM conversations) SELECT arm, COUNT(*) AS files, COUNT(*) FILTER (turn % 3 < 2) AS emitted, COUNT(*) FILTER (turn % 3 = 0) AS parses, COUNT(*) FILTER (turn % 3 = 0) AS runnable FROM f GROUP BY 1")
def prose_calls(spark, sf):
    body = F.when(F.col("turn") % 3 == 0, F.lit('```json\n{"name": "editor", "arguments": {"command": "create", "path": "a", "file_text": "x"}}\n```')).when(F.col("turn") % 3 == 1, F.lit('{"name": "bash", broken}')).otherwise(F.col("text"))
    return tr.prose_calls(table(spark, sf, "conversations").select(F.col("role").alias("arm"), F.concat_ws("-", "conv_id", "turn").alias("file"), body.alias("text")))


# --- selection, manifests, agreement -------------------------------------------------------------------------


@query("WITH " + SQL_INDEXED + ", v AS (SELECT task_id, species, COUNT(*) AS votes, MIN(i) AS first_index FROM idx GROUP BY ALL) SELECT task_id, species, votes, first_index FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY votes DESC, first_index) AS r FROM v) WHERE r = 1")
def majority_vote(spark, sf):
    return se.consensus(indexed(attempts(spark, sf)), ["task_id"], "species", "i")


@query("WITH " + SQL_INDEXED + ", v AS (SELECT task_id, species, COUNT(*) AS votes, MIN(i) AS first_index FROM idx GROUP BY ALL), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY votes DESC, first_index) AS r FROM v) WHERE r = 1), a AS (SELECT task_id, bool_or(passed) AS pass_at_n FROM idx GROUP BY 1) SELECT w.task_id, w.first_index, idx.passed, pass_at_n FROM w JOIN idx ON w.task_id = idx.task_id AND w.first_index = idx.i JOIN a ON w.task_id = a.task_id")
def best_of_n_blind(spark, sf):
    rows = indexed(attempts(spark, sf))
    return si.best_of_n(rows.select("task_id", "species", "i"), ["task_id"], rows.select("task_id", "i", "passed"), "species", "i").select("task_id", "first_index", "passed", "pass_at_n")


_UNIT = "('0x' || substr(md5('s:' || p_partkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_SPLIT = f"CASE WHEN p_brand = 'Brand#11' THEN 'transfer' WHEN {_UNIT} < 0.6 THEN 'train' WHEN {_UNIT} < 0.6::DOUBLE + 0.2::DOUBLE THEN 'held_out' ELSE 'transfer' END"


def _splits(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("task_id"), F.col("p_brand").alias("family"), F.sha2(F.col("p_name").cast("binary"), 256).alias("hash"), "p_partkey", "p_size")
    return se.assign_splits(p, si.uniform(F.lit("s"), F.col("p_partkey").cast("string")), train=0.6, held_out=0.2, transfer_families=["Brand#11"])


@query(f"SELECT p_partkey, {_SPLIT} AS split FROM part")
def split_assignment(spark, sf):
    return _splits(spark, sf).select("p_partkey", "split")


@query(f"SELECT COALESCE(CASE WHEN p_size > 5 THEN {_SPLIT} END, 'unassigned') AS split, COUNT(*) AS n FROM part GROUP BY 1")
def split_counts(spark, sf):
    return se.split_counts(_splits(spark, sf).withColumn("split", F.when(F.col("p_size") > 5, F.col("split"))))


@query("SELECT p_partkey FROM part WHERE " + _SPLIT + " = 'held_out'")
def split_filter(spark, sf):
    return _splits(spark, sf).where("split = 'held_out'").select("p_partkey")


@query()
def split_assignment_blake2(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("task_id"), F.col("p_brand").alias("family"))
    return se.assign_splits(p, co.blake2_unit_column(F.col("task_id"), "split-1"), train=0.6, held_out=0.2)


_TASKS = f"tasks AS (SELECT p_partkey::VARCHAR AS task_id, sha256(p_name) AS hash, {_SPLIT} AS split, p_brand, p_partkey, p_size FROM part)"


_DRIFT = "WITH " + _TASKS + ", f AS (SELECT * FROM tasks WHERE p_partkey % 10 <> 0), c AS (SELECT task_id, CASE WHEN p_size = 3 THEN 'x' ELSE hash END AS hash, CASE WHEN p_size = 4 THEN 'train' ELSE split END AS split FROM tasks WHERE p_partkey % 11 <> 0), j AS (SELECT COALESCE(f.task_id, c.task_id) AS task_id, [CASE WHEN c.task_id IS NULL THEN 'missing' END, CASE WHEN f.task_id IS NULL THEN 'added' END, CASE WHEN f.task_id IS NOT NULL AND c.task_id IS NOT NULL AND f.hash <> c.hash THEN 'changed_hash' END, CASE WHEN f.task_id IS NOT NULL AND c.task_id IS NOT NULL AND f.split <> c.split THEN 'changed_split' END] AS p FROM f FULL JOIN c ON f.task_id = c.task_id), u AS (SELECT task_id, unnest(p) AS problem FROM j) SELECT * FROM u WHERE problem IS NOT NULL"


@query(_DRIFT)
def manifest_diff(spark, sf):
    t = _splits(spark, sf)
    current = t.where("p_partkey % 11 <> 0").withColumn("hash", F.when(F.col("p_size") == 3, "x").otherwise(F.col("hash"))).withColumn("split", F.when(F.col("p_size") == 4, "train").otherwise(F.col("split")))
    return se.manifest_diff(t.where("p_partkey % 10 <> 0"), current)


@query(_DRIFT)
def manifest_freeze(spark, sf):
    """Drift from a split that was frozen, frozen again with its rows in another order, and kept against other content."""
    from solvefront.sources import manifests

    t = _splits(spark, sf)
    path, ratios = shared_path(spark, "manifest"), manifests.SplitRatios(0.6, 0.2, 0.2)
    kept = t.where("p_partkey % 10 <> 0")
    current = t.where("p_partkey % 11 <> 0").withColumn("hash", F.when(F.col("p_size") == 3, "x").otherwise(F.col("hash"))).withColumn("split", F.when(F.col("p_size") == 4, "train").otherwise(F.col("split")))
    manifests.freeze(spark, kept, path, ratios, salt="split-1")
    manifests.freeze(spark, kept.orderBy(F.desc("task_id")), path, ratios, salt="split-1")
    try:
        manifests.freeze(spark, current, path, ratios, salt="split-1")
    except manifests.FrozenSplitError:
        return manifests.verify(spark, current, path)
    raise AssertionError("another content took a frozen place")


@query("WITH " + _TASKS + " SELECT p_brand AS family, sha256(string_agg(task_id || chr(0) || hash || chr(0) || split || chr(1), '' ORDER BY task_id)) AS suite_hash, COUNT(*) AS n_tasks FROM tasks GROUP BY 1")
def suite_hash(spark, sf):
    return se.suite_hash(_splits(spark, sf), ["family"])


@query("""SELECT p_partkey, sha256('{"entry_point": "f", "family": "' || p_brand || '", "prompt": "' || p_name || '", "public_tests": "p", "setup": "", "task_id": "' || p_partkey || '", "tests": "t"}') AS hash FROM part""")
def content_hash(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_partkey").cast("string").alias("task_id"), F.col("p_brand").alias("family"), F.col("p_name").alias("prompt"), F.lit("t").alias("tests"), F.lit("p").alias("public_tests"), F.lit("f").alias("entry_point"), F.lit("").alias("setup")).alias("t"))
    return p.select("p_partkey", co.content_hash_udf("t").alias("hash"))


_AGREE = "x AS (SELECT doc_id, quality = 1 AS truth, length(text) > 800 AS verdict FROM labels JOIN documents USING (doc_id))"


def _agree(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("truth"), (F.length("text") > 800).alias("verdict"))


@query("WITH " + _AGREE + " SELECT COUNT(*) AS n, COUNT(*) FILTER (NOT truth AND verdict) AS false_positives, COUNT(*) FILTER (truth AND NOT verdict) AS false_negatives, round(AVG((truth = verdict)::INT), 8) AS agreement FROM x")
def verifier_agreement(spark, sf):
    return se.agreement(_agree(spark, sf), "truth", "verdict").withColumn("agreement", R("agreement"))


@query("WITH " + _AGREE + " SELECT * FROM x WHERE truth <> verdict ORDER BY doc_id LIMIT 20")
def first_disagreements(spark, sf):
    return se.disagreements(_agree(spark, sf), "truth", "verdict", "doc_id")


@query("SELECT a.arm, a.n AS attempts, t.n AS transcripts FROM (SELECT l_linestatus AS arm, COUNT(*) AS n FROM lineitem GROUP BY 1) a JOIN (SELECT o_orderstatus AS arm, COUNT(*) AS n FROM orders GROUP BY 1) t USING (arm)")
def arm_and_transcript_counts(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("arm")).agg(F.count(F.lit(1)).alias("attempts"))
    return a.join(table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("arm")).agg(F.count(F.lit(1)).alias("transcripts")), "arm")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_skip(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def id_allow_list(spark, sf):
    ids = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey").join(ids, "l_orderkey", "left_semi").distinct()


# --- text and code -------------------------------------------------------------------------------------------

_FENCED = "CASE WHEN doc_id % 3 = 0 THEN 'x' || chr(10) || '```python' || chr(10) || 'a = ' || doc_id || chr(10) || '```' || chr(10) || '```' || chr(10) || 'b' WHEN doc_id % 3 = 1 THEN '  ' || text || '  ' ELSE text END"


def _fenced(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", "text", F.when(d % 3 == 0, F.concat(F.lit("x\n```python\na = "), d.cast("string"), F.lit("\n```\n```\nb"))).when(d % 3 == 1, F.concat(F.lit("  "), F.col("text"), F.lit("  "))).otherwise(F.col("text")).alias("c"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a = ' || doc_id || chr(10) || chr(10) || 'b' ELSE regexp_replace(" + _FENCED + r", '^\s+|\s+$', '', 'g') END AS code FROM documents")
def fence_extraction(spark, sf):
    return _fenced(spark, sf).select("doc_id", tx.extract_code(F.col("c")).alias("code"))


@query()
def fence_extraction_whole(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.extract_code(F.col("text")).alias("code"))


@query(r"SELECT doc_id, right(text, 800) AS tail, greatest(1, length(text) // 4)::BIGINT AS tokens, regexp_replace(source || '/' || lang, '[^\p{L}\p{N}\-_.]', '_', 'g') AS slug FROM documents")
def text_functions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.tail(F.col("text")).alias("tail"), tx.token_estimate(F.col("text")).alias("tokens"), tx.slug(F.concat_ws("/", "source", "lang")).alias("slug"))


@query("WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) SELECT doc_id, array_to_string(l[1:greatest(1, (len(l) + 1) // 2)], chr(10)) || chr(10) AS public FROM l")
def public_half(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.first_half_lines(F.col("text")).alias("public"))


@query("WITH c AS (SELECT doc_id, left(text, 10) AS c, doc_id % 7 = 0 AS t, CASE WHEN doc_id % 2 = 0 THEN 'OK!' ELSE '' END AS o, doc_id % 3 AS e FROM documents) SELECT doc_id, CASE WHEN trim(c) = '' THEN 'empty_candidate' WHEN t THEN 'timeout' WHEN o = 'OK!' AND e = 0 THEN 'ok' WHEN o = 'OK!' THEN 'marker_but_nonzero_exit' WHEN e <> 0 THEN 'test_failed' ELSE 'no_success_marker' END AS reason FROM c")
def verdict_lattice(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", tx.verdict(F.col("text"), d % 7 == 0, F.when(d % 2 == 0, "OK!").otherwise(""), d % 3, "OK!").alias("reason"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'import os' || chr(10) || chr(10) ELSE '' END || text || chr(10) || chr(10) || 'assert 1' || chr(10) || chr(10) || 'print(''OK!'')' AS program FROM documents")
def program_assembly(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.assemble_program(F.when(F.col("doc_id") % 2 == 0, "import os").otherwise(""), F.col("text"), F.lit("assert 1"), "OK!").alias("program"))


@query()
def canonical_species(spark, sf):
    d = F.col("doc_id")
    program = F.concat(F.lit("def f(x"), (d % 5).cast("string"), F.lit("):\n    return x"), (d % 5).cast("string"), F.lit(" + 1\n"))
    code = F.when(d % 2 == 0, F.concat(program, F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))).otherwise(F.col("text"))
    return co.with_canonical_form(table(spark, sf, "documents").select("doc_id", code.alias("code"))).select("doc_id", "canon.method", "canon.key", co.compiles_udf("code").alias("compiles"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '(^|[^''\"])#.*$', '\\1'), '\\s+$', '')), lambda x: x <> ''), chr(10)) AS canon FROM documents")
def canonical_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.canonical_text(F.col("text")).alias("canon"))


@query()
def entry_points(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("assert f"), (F.col("p_size") % 4).cast("string"), F.lit("(1) == 2\nassert g(2) == 3\nassert g(3) == 4")).alias("t"))
    return t.select("p_partkey", co.entry_point_udf("t").alias("entry_point"), co.public_asserts_udf("t").alias("public"), co.short_hash_udf("t").alias("short"))


# --- sources and sinks, streams ------------------------------------------------------------------------------


@query("WITH " + SQL_INDEXED + " SELECT task_id, i, passed, tokens AS prompt_tokens FROM idx")
def sample_log_round_trip(spark, sf):
    from solvefront.sources.readers import read_samples, write_samples

    path = shared_path(spark, "samples")
    rows = indexed(attempts(spark, sf)).select(F.col("task_id").cast("string").alias("task_id"), F.col("i").cast("bigint").alias("i"), "passed", F.col("tokens").alias("prompt_tokens"), F.lit("c").alias("condition_key"))
    write_samples(rows, path)
    return read_samples(spark, path).select(F.col("task_id").cast("bigint").alias("task_id"), F.col("i").cast("int").alias("i"), "passed", "prompt_tokens")


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def archive_round_trip(spark, sf):
    from solvefront.sources.readers import read_archive, write_json

    path = shared_path(spark, "archive")
    write_json(table(spark, sf, "supplier").select(F.struct(F.col("s_suppkey").cast("string").alias("variant_id")).alias("entry"), F.col("s_acctbal").alias("train_solve_rate")), path)
    return read_archive(spark, path).select(F.col("entry.variant_id").cast("bigint").alias("s_suppkey"), F.col("train_solve_rate").alias("s_acctbal"))


@query("SELECT event_type, COUNT(*) AS n, date_trunc('day', ts) AS day FROM events GROUP BY ALL")
def streamed_daily_counts(spark, sf):
    from solvefront.streaming.jobs import event_stream, run_available, state_of, windowed_counts

    checkpoint = shared_path(spark, "stream")
    run_available(windowed_counts(event_stream(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema)), "complete", checkpoint)
    return state_of(spark, checkpoint).select("event_type", F.col("count").alias("n"), F.col("window.start").cast("timestamp_ntz").alias("day"))


