"""Frontier estimation, budgets and simulation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvefront.functions import statistics as st
from solvefront.operators import budget as bu
from solvefront.operators import frontier as fr
from solvefront.operators import simulate as si
from solvefront.operators.selection import SCHEDULE, allocate
from solvefront.plans.bindings import SQL_ATTEMPTS, SQL_COUNTS, SQL_CP, SQL_INDEXED, attempts, indexed, table
from solvefront.plans.registry import query

R = lambda c, d=8: F.round(c, d)

_PASS = "CASE WHEN c = 0 THEN 0.0::DOUBLE WHEN n - c < {k} THEN 1.0::DOUBLE ELSE 1 - list_aggregate(list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k} / i::DOUBLE), 'product') END"


@query("WITH " + SQL_ATTEMPTS + ", s AS (SELECT task_id, COUNT(*) AS n, COUNT(*) FILTER (passed) AS c FROM attempts GROUP BY 1) SELECT task_id, n AS n_samples, c AS n_correct, round(c / n, 8) AS p_hat, round(least(1.0, 3.0 / n), 8) AS rule_of_three_bound, round(1 - pow(0.05, 1.0 / n), 8) AS exact_zero_success_bound, c = 0 AS beyond_frontier, round(" + _PASS.format(k=10) + ", 8) AS pass_at_10 FROM s")
def frontier_rates(spark, sf):
    made = fr.rates(attempts(spark, sf), ["task_id"]).withColumn("pass_at_10", st.pass_at_k(F.col("n_samples"), F.col("n_correct"), F.lit(10)))
    return made.select("task_id", "n_samples", "n_correct", "beyond_frontier", *[R(c).alias(c) for c in ("p_hat", "rule_of_three_bound", "exact_zero_success_bound", "pass_at_10")])


@query("WITH RECURSIVE " + SQL_COUNTS + ", s AS (SELECT task_id, COUNT(*) AS n, COUNT(*) FILTER (passed) AS c FROM attempts GROUP BY 1), cp_in AS (SELECT c, n FROM s), " + SQL_CP + """,
d AS (SELECT task_id, SUM(n) AS t, COUNT(*) AS o, COUNT(*) FILTER (n = 1) AS f1, COUNT(*) FILTER (n = 2) AS f2 FROM counts GROUP BY 1)
SELECT s.task_id, s.n AS n_samples, s.c AS n_correct, round(s.c / s.n, 6) AS p_hat, round(low, 6) AS ci_low, round(high, 6) AS ci_high, COALESCE(o, 0) AS n_distinct,
  round(f1 / t, 6) AS unseen_mass, round(1 - f1 / t, 6) AS coverage, COALESCE(1 - f1 / t >= 0.99, false) AS saturated, round(o + f1 * (f1 - 1) / (2.0 * (f2 + 1)), 6) AS richness
FROM s JOIN cp ON s.c = cp.c AND s.n = cp.n LEFT JOIN d ON s.task_id = d.task_id""")
def frontier_records(spark, sf):
    r = fr.frontier_records(attempts(spark, sf))
    return r.select("task_id", "n_samples", "n_correct", R("p_hat", 6).alias("p_hat"), R("ci_low", 6).alias("ci_low"), R("ci_high", 6).alias("ci_high"), "n_distinct", R("unseen_mass", 6).alias("unseen_mass"), R("coverage", 6).alias("coverage"), "saturated", R("chao1.estimate", 6).alias("richness"))


@query("WITH " + SQL_COUNTS + """,
s AS (SELECT task_id, COUNT(*) AS n, COUNT(*) FILTER (passed) AS c FROM attempts GROUP BY 1),
ks AS (SELECT task_id, n, c, unnest(list_distinct(list_append(list_filter([""" + ", ".join(map(str, st.BUDGET_GRID)) + """], lambda x: x <= n), n)))::BIGINT AS k FROM s)
SELECT task_id, 'pass_at_k' AS curve, k, round(CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0 ELSE 1 - exp(lgamma(n - c + 1) - lgamma(n - c - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) END, 6) AS y FROM ks
UNION ALL
SELECT task_id, 'rarefaction', k, round(SUM(CASE WHEN k >= c THEN 1.0 WHEN c - counts.n < k THEN 1.0 ELSE 1 - exp(lgamma(c - counts.n + 1) - lgamma(c - counts.n - k + 1) - lgamma(c + 1) + lgamma(c - k + 1)) END), 6)
FROM ks JOIN counts USING (task_id) WHERE k <= greatest(1, c) GROUP BY ALL
UNION ALL
SELECT task_id, 'species:' || species, n, 0.0 FROM counts""")
def frontier_record_curves(spark, sf):
    """The record's pass curve, rarefaction and species, in long form."""
    r = fr.frontier_records(attempts(spark, sf), interval=False)
    long = lambda m, name: r.select("task_id", F.explode(m).alias("k", "y")).select("task_id", name("k"), F.col("k").cast("bigint").alias("k"), R("y", 6).alias("y"))
    species = r.select("task_id", F.explode("species_counts").alias("s", "k")).select("task_id", F.concat(F.lit("species:"), "s").alias("curve"), "k", F.lit(0.0).alias("y"))
    return long("pass_at_k", lambda _: F.lit("pass_at_k").alias("curve")).union(long("rarefaction", lambda _: F.lit("rarefaction").alias("curve"))).union(species)


@query("WITH " + SQL_INDEXED + """, x AS (SELECT * FROM idx),
sp AS (SELECT task_id, species, COUNT(*) AS n FROM x WHERE passed GROUP BY ALL)
SELECT task_id, COUNT(*) AS n_done, COUNT(*) FILTER (passed) AS n_correct, MAX(i) + 1 AS next_index, SUM(calls)::BIGINT AS calls, SUM(tokens)::BIGINT AS total_tokens, COUNT(*) FILTER (NOT passed AND exhausted) AS n_verifier_errors,
  COALESCE((SELECT SUM(n) FROM sp WHERE sp.task_id = x.task_id), 0)::BIGINT AS species_total, COALESCE((SELECT COUNT(*) FROM sp WHERE sp.task_id = x.task_id), 0)::BIGINT AS n_species
FROM x GROUP BY task_id""")
def resume_fold(spark, sf):
    """The state of the whole logs, from which a run goes on."""
    log = indexed(attempts(spark, sf)).select("task_id", "i", "passed", "calls", F.col("tokens").alias("prompt_tokens"), F.lit(0).alias("completion_tokens"), F.lit(0.0).alias("usd"), F.when(F.col("exhausted"), "timeout").alias("reason"), F.col("species").alias("species_key"), F.lit("c").alias("condition_key"))
    got = fr.resume_state(log, "c")
    n = F.coalesce(F.aggregate(F.map_values("species_counts"), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))
    return got.select("task_id", "n_done", "n_correct", "next_index", "usage.calls", "usage.total_tokens", "n_verifier_errors", n.alias("species_total"), F.coalesce(F.size("species_counts"), F.lit(0)).cast("bigint").alias("n_species"))


@query("WITH " + SQL_COUNTS + " SELECT task_id, n, COUNT(*) AS f FROM counts GROUP BY ALL")
def frequency_of_frequencies(spark, sf):
    return fr.counts_of_counts(fr.species_counts(attempts(spark, sf), ["task_id"]), ["task_id"])


_CHAO = """, d AS (SELECT task_id, COUNT(*)::DOUBLE AS s, COUNT(*) FILTER (n = 1)::DOUBLE AS a, COUNT(*) FILTER (n = 2)::DOUBLE AS b FROM counts GROUP BY 1),
e AS (SELECT *, {est} AS f0, {var} AS v FROM d)
SELECT task_id, round(s + f0, 6) AS estimate, round(v, 6) AS variance,
  round(CASE WHEN f0 > 0 AND v > 0 THEN s + f0 / exp(1.959963984540054 * sqrt(ln(1 + v / (f0 * f0)))) ELSE s END, 6) AS low,
  round(CASE WHEN f0 > 0 AND v > 0 THEN s + f0 * exp(1.959963984540054 * sqrt(ln(1 + v / (f0 * f0)))) ELSE s END, 6) AS high FROM e"""
_CORRECTED = ("a * (a - 1) / (2 * (b + 1))", "a * (a - 1) / (2 * (b + 1)) + a * pow(2 * a - 1, 2) / (4 * pow(b + 1, 2)) + a * a * b * pow(a - 1, 2) / (4 * pow(b + 1, 4))")


@query("WITH " + SQL_COUNTS + _CHAO.format(est=_CORRECTED[0], var=_CORRECTED[1]))
def chao1_bias_corrected(spark, sf):
    d = fr.diversity(fr.species_counts(attempts(spark, sf), ["task_id"]), ["task_id"])
    return d.select("task_id", *[R(f"chao1.{c}", 6).alias(c) for c in ("estimate", "variance", "low", "high")])


@query("WITH " + SQL_COUNTS + _CHAO.format(est=f"CASE WHEN b > 0 THEN a * a / (2 * b) ELSE {_CORRECTED[0]} END", var=f"CASE WHEN b > 0 THEN b * (0.5 * pow(a / b, 2) + pow(a / b, 3) + 0.25 * pow(a / b, 4)) ELSE {_CORRECTED[1]} END"))
def chao1_classic(spark, sf):
    d = fr.diversity(fr.species_counts(attempts(spark, sf), ["task_id"]), ["task_id"], bias_corrected=False)
    return d.select("task_id", *[R(f"chao1.{c}", 6).alias(c) for c in ("estimate", "variance", "low", "high")])


_LB = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@query("WITH " + SQL_COUNTS + ", t AS (SELECT *, SUM(n) OVER (PARTITION BY task_id) AS total FROM counts), g AS (SELECT *, unnest([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000]) AS m FROM t) SELECT task_id, m::BIGINT AS m, round(SUM(CASE WHEN m >= total THEN 1.0 WHEN total - n >= m THEN 1 - exp(" + _LB.format(n="(total - n)", k="m") + " - " + _LB.format(n="total", k="m") + ") ELSE 1.0 END), 5) AS expected FROM g WHERE m <= greatest(1, total) GROUP BY ALL")
def solution_rarefaction(spark, sf):
    return fr.rarefaction(fr.species_counts(attempts(spark, sf), ["task_id"]), ["task_id"]).select("task_id", "m", R("expected", 5).alias("expected"))


@query("WITH " + SQL_ATTEMPTS + ", s AS (SELECT task_id, COUNT(*) AS n, COUNT(*) FILTER (passed) AS c FROM attempts GROUP BY 1), g AS (SELECT *, unnest([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000]) AS k FROM s) SELECT task_id, k, round(" + _PASS.format(k="k") + ", 8) AS p FROM g WHERE k <= n")
def pass_at_k_curve(spark, sf):
    r = fr.rates(attempts(spark, sf), ["task_id"])
    return r.select("task_id", F.explode(st.pass_curve(F.col("n_samples"), F.col("n_correct"))).alias("k", "p")).select("task_id", "k", R("p").alias("p"))


@query("WITH RECURSIVE " + SQL_ATTEMPTS + ", s AS (SELECT task_id, system, COUNT(*) AS n, COUNT(*) FILTER (passed) AS c FROM attempts GROUP BY ALL), cp_in AS (SELECT c, n FROM s), " + SQL_CP + " SELECT task_id, system, round(low, 6) AS low, round(high, 6) AS high, 0.5::DOUBLE BETWEEN low - 1e-12 AND high + 1e-12 AS holds_half FROM s JOIN cp USING (c, n)")
def clopper_pearson(spark, sf):
    s = attempts(spark, sf).groupBy("task_id", "system").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c"))
    r = st.with_clopper_pearson(s, "c", "n")
    return r.select("task_id", "system", R("ci_low", 6).alias("low"), R("ci_high", 6).alias("high"), F.lit(0.5).between(F.col("ci_low") - 1e-12, F.col("ci_high") + 1e-12).alias("holds_half"))


@query("WITH RECURSIVE " + SQL_ATTEMPTS + ", s AS (SELECT task_id, COUNT(*) AS n, COUNT(*) FILTER (passed) AS c FROM attempts GROUP BY 1) SELECT task_id, round(least(1.0, list_sum(list_transform(range(c, n + 1), lambda i: exp(" + _LB.format(n="n", k="i") + " + i * ln(0.3) + (n - i) * ln(0.7))))), 6) AS tail FROM s WHERE c > 0")
def binomial_upper_tail(spark, sf):
    s = fr.rates(attempts(spark, sf), ["task_id"]).where("n_correct > 0")
    return s.select("task_id", R(st.binomial_tail(F.col("n_correct"), F.col("n_samples"), F.lit(0.3)), 6).alias("tail"))


@query("WITH RECURSIVE " + SQL_ATTEMPTS + ", s AS (SELECT task_id, COUNT(*) AS n, COUNT(*) FILTER (passed) AS c FROM attempts GROUP BY 1) SELECT task_id, round(list_sum(list_transform(range(c, n + 1), lambda i: exp(" + _LB.format(n="n", k="i") + " + i * ln(0.25) + (n - i) * ln(0.75)))), 6) AS value FROM s WHERE c > 0")
def regularised_incomplete_beta(spark, sf):
    s = fr.rates(attempts(spark, sf), ["task_id"]).where("n_correct > 0")
    return s.select("task_id", R(st.incomplete_beta_udf()("n_correct", F.col("n_samples") - F.col("n_correct") + 1, F.lit(0.25)), 6).alias("value"))


@query("WITH RECURSIVE " + SQL_ATTEMPTS + ", s AS (SELECT task_id, COUNT(*) AS n, COUNT(*) FILTER (passed) AS c FROM attempts GROUP BY 1), cp_in AS (SELECT c, n FROM s WHERE c > 0), " + SQL_CP + " SELECT task_id, round(low, 6) AS x FROM s JOIN cp USING (c, n)")
def inverse_incomplete_beta(spark, sf):
    s = fr.rates(attempts(spark, sf), ["task_id"]).where("n_correct > 0")
    return s.select("task_id", R(st.inverse_incomplete_beta_udf()("n_correct", F.col("n_samples") - F.col("n_correct") + 1, F.lit(0.025)), 6).alias("x"))


@query("SELECT p_partkey, round(lgamma(p_partkey + p_size + 1) - lgamma(p_size + 1) - lgamma(p_partkey + 1), 5) AS v FROM part")
def log_binomial(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R(st.log_binomial(F.col("p_partkey") + F.col("p_size"), F.col("p_size")), 5).alias("v"))


def _horner_sql(x: str, coefficients) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


_TAIL = lambda p: _horner_sql(f"sqrt(-2 * ln({p}))", st.ACKLAM_C) + " / " + _horner_sql(f"sqrt(-2 * ln({p}))", (*st.ACKLAM_D, 1.0))
_MIDDLE = _horner_sql("(q * q)", st.ACKLAM_A) + " * q / " + _horner_sql("(q * q)", (*st.ACKLAM_B, 1.0))


@query(f"WITH x AS (SELECT p_partkey, p_size / 51.0::DOUBLE AS p, p_size / 51.0::DOUBLE - 0.5 AS q FROM part) SELECT p_partkey, round(CASE WHEN p < 0.02425 THEN {_TAIL('p')} WHEN p <= 1 - 0.02425 THEN {_MIDDLE} ELSE -({_TAIL('(1 - p)')}) END, 8) AS z FROM x")
def normal_quantile(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R(st.normal_quantile(F.col("p_size") / 51.0)).alias("z"))


@query("WITH " + SQL_INDEXED + " SELECT task_id, species, MIN(i) AS first_seen_index, arg_min(tokens, i) AS tokens FROM idx WHERE passed GROUP BY ALL")
def first_seen_species(spark, sf):
    return fr.first_seen(indexed(attempts(spark, sf)), ["task_id"], keep=["tokens"])


@query("WITH " + SQL_ATTEMPTS + " SELECT system, SUM(calls)::BIGINT AS calls, SUM(tokens)::BIGINT AS prompt_tokens, COUNT(*) AS completion_tokens, 0.0::DOUBLE AS usd, (SUM(tokens) + COUNT(*))::BIGINT AS total_tokens FROM attempts GROUP BY 1")
def usage_sum(spark, sf):
    rows = attempts(spark, sf).select("system", "calls", F.col("tokens").alias("prompt_tokens"), F.lit(1).cast("bigint").alias("completion_tokens"), F.lit(0.0).alias("usd"))
    return fr.usage_total(rows, ["system"])


@query("WITH " + SQL_INDEXED + " SELECT task_id, i, spent::BIGINT AS spent, spent > 5000 AS exhausted FROM (SELECT task_id, i, SUM(tokens) OVER (PARTITION BY task_id ORDER BY i) AS spent FROM idx)")
def budget_truncation(spark, sf):
    return bu.take_affordable(indexed(attempts(spark, sf)), ["task_id"], ["i"], "tokens", F.lit(5000)).select("task_id", "i", "spent", "exhausted")


@query("WITH " + SQL_INDEXED + """, c AS (SELECT task_id, list(tokens::DOUBLE ORDER BY i) AS c FROM idx GROUP BY 1),
r AS (SELECT task_id, list_reduce(list_transform(c, lambda x: {'s': x, 't': 0::BIGINT, 'r': 0::BIGINT}), lambda a, x: {'s': CASE WHEN a.s + x.s <= 5000 THEN a.s + x.s ELSE a.s END, 't': CASE WHEN a.s + x.s <= 5000 THEN a.t + 1 ELSE a.t END, 'r': CASE WHEN a.s + x.s <= 5000 THEN a.r ELSE a.r + 1 END}, {'s': 0.0::DOUBLE, 't': 0::BIGINT, 'r': 0::BIGINT}) AS x FROM c)
SELECT task_id, x.s AS spent, x.t AS taken, x.r AS refused FROM r""")
def budget_reject_and_continue(spark, sf):
    return bu.charge_in_order(indexed(attempts(spark, sf)), ["task_id"], "i", "tokens", 5000.0)


_PATHS = "paths AS (SELECT 'run/' || l_linestatus || '/' || l_suppkey AS path, l_linenumber::BIGINT AS calls, l_quantity::BIGINT AS tokens FROM lineitem)"


def _charges(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat_ws("/", F.lit("run"), "l_linestatus", F.col("l_suppkey").cast("string")).alias("path"), F.col("l_linenumber").cast("bigint").alias("calls"), F.col("l_quantity").cast("bigint").alias("tokens"))


@query("WITH " + _PATHS + ", x AS (SELECT unnest([list_aggregate(string_split(path, '/')[1:k], 'string_agg', '/') for k in range(1, len(string_split(path, '/')) + 1)]) AS account, calls, tokens FROM paths) SELECT account, SUM(calls)::BIGINT AS calls, SUM(tokens)::BIGINT AS tokens, len(string_split(account, '/'))::INT AS level FROM x GROUP BY account")
def ledger_rollup(spark, sf):
    return bu.ledger(_charges(spark, sf))


@query("WITH " + _PATHS + """, x AS (SELECT unnest([list_aggregate(string_split(path, '/')[1:k], 'string_agg', '/') for k in range(1, len(string_split(path, '/')) + 1)]) AS account, calls, tokens FROM paths),
b AS (SELECT account, len(string_split(account, '/')) AS level, SUM(calls)::BIGINT AS calls, SUM(tokens)::BIGINT AS tokens FROM x GROUP BY ALL)
SELECT p.account, p.level::INT AS level, p.calls, p.tokens, k.account AS child, k.calls AS child_calls, k.tokens AS child_tokens FROM b p LEFT JOIN b k ON k.level = p.level + 1 AND starts_with(k.account, p.account || '/')""")
def ledger_snapshot(spark, sf):
    made = bu.snapshot(bu.ledger(_charges(spark, sf)))
    return made.select("account", "level", "calls", "tokens", F.explode_outer("children").alias("k")).select("account", "level", "calls", "tokens", F.col("k.account").alias("child"), F.col("k.calls").alias("child_calls"), F.col("k.tokens").alias("child_tokens"))


@query("""WITH paths AS (
  SELECT ['run', l_linestatus, l_suppkey::VARCHAR, l_returnflag] AS p, SUM(l_linenumber)::BIGINT AS calls, SUM(l_quantity)::BIGINT AS tokens FROM lineitem GROUP BY 1),
l4 AS (SELECT p, '{"calls":' || calls || ',"children":[],"label":"' || p[4] || '","tokens":' || tokens || '}' AS tree, calls, tokens FROM paths),
l3 AS (SELECT p[1:3] AS p, '{"calls":' || SUM(calls)::BIGINT || ',"children":[' || string_agg(tree, ',' ORDER BY p[4]) || '],"label":"' || p[3] || '","tokens":' || SUM(tokens)::BIGINT || '}' AS tree,
  SUM(calls)::BIGINT AS calls, SUM(tokens)::BIGINT AS tokens FROM l4 GROUP BY p[1:3], p[3]),
l2 AS (SELECT p[1:2] AS p, '{"calls":' || SUM(calls)::BIGINT || ',"children":[' || string_agg(tree, ',' ORDER BY p[3]) || '],"label":"' || p[2] || '","tokens":' || SUM(tokens)::BIGINT || '}' AS tree,
  SUM(calls)::BIGINT AS calls, SUM(tokens)::BIGINT AS tokens FROM l3 GROUP BY p[1:2], p[2])
SELECT 'run' AS account, '{"calls":' || SUM(calls)::BIGINT || ',"children":[' || string_agg(tree, ',' ORDER BY p[2]) || '],"label":"run","tokens":' || SUM(tokens)::BIGINT || '}' AS tree FROM l2""")
def ledger_tree(spark, sf):
    """Four levels of accounts in one value."""
    four = F.concat_ws("/", F.lit("run"), "l_linestatus", F.col("l_suppkey").cast("string"), "l_returnflag")
    charges = table(spark, sf, "lineitem").select(four.alias("path"), F.col("l_linenumber").cast("bigint").alias("calls"), F.col("l_quantity").cast("bigint").alias("tokens"))
    return bu.snapshot_tree(bu.ledger(charges)).select("account", F.to_json("tree").alias("tree"))


@query("WITH " + _PATHS + """, leaf AS (SELECT path, SUM(calls) AS spent FROM paths GROUP BY 1), mid AS (SELECT string_split(path, '/')[2] AS m, SUM(calls) AS spent FROM paths GROUP BY 1)
SELECT path, 10::BIGINT AS calls, leaf.spent + 10 <= 1700 AND mid.spent + 10 <= 1000000 AS can_afford FROM leaf JOIN mid ON m = string_split(path, '/')[2]""")
def affordable_chain(spark, sf):
    charges = _charges(spark, sf)
    balances = bu.ledger(charges)
    caps = balances.where("level > 1").select("account", F.when(F.col("level") == 3, F.lit(1700)).otherwise(F.lit(1000000)).alias("cap"))
    return bu.affordable(charges.select("path", F.lit(10).cast("bigint").alias("calls")).distinct(), balances, caps)


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN greatest(0.0::DOUBLE, 5000.0 - c_acctbal) END AS headroom, CASE WHEN c_acctbal + 100 > 8000 THEN 'calls' WHEN c_acctbal * 2 + 100 > 9000 AND c_nationkey % 3 <> 0 THEN 'usd' END AS breach, trunc(c_custkey * 0.37)::BIGINT AS scaled FROM customer")
def caps_and_headroom(spark, sf):
    c = table(spark, sf, "customer").withColumns({"cap": F.when(F.col("c_nationkey") % 3 != 0, F.lit(5000.0))})
    make = lambda *v: F.struct(*[F.lit(x).cast("double").alias(n) if not hasattr(x, "alias") else x.cast("double").alias(n) for n, x in zip(bu.DIMENSIONS, v, strict=True)])
    none = F.lit(None)
    c = c.withColumns({"caps": make(8000.0, none, none, none, F.when(F.col("c_nationkey") % 3 != 0, F.lit(9000.0))), "spent": make(F.col("c_acctbal"), 0, 0, 0, F.col("c_acctbal") * 2), "use": make(100, 0, 0, 0, 100)})
    return c.select("c_custkey", bu.headroom(F.col("cap"), F.col("c_acctbal")).alias("headroom"), bu.first_breach("caps", "spent", "use").alias("breach"), bu.scaled(F.col("c_custkey"), F.lit(0.37), whole=True).alias("scaled"))


_SPEND = "spend AS (SELECT task_id, system, SUM(calls) AS calls, SUM(tokens) AS tokens FROM attempts GROUP BY ALL)"
_MATCH = "m AS (SELECT task_id, COUNT(*) AS n_systems, COUNT(*) < 2 OR ((MAX(calls) - MIN(calls) <= 0.05::DOUBLE * MAX(calls) OR MAX(calls) = 0) AND (MAX(tokens) - MIN(tokens) <= 0.05::DOUBLE * MAX(tokens) OR MAX(tokens) = 0)) AS matched FROM spend GROUP BY 1)"


def _spend(spark, sf):
    return attempts(spark, sf).groupBy("task_id", "system").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))


@query("WITH " + SQL_ATTEMPTS + ", " + _SPEND + ", " + _MATCH + " SELECT * FROM m")
def matched_compute(spark, sf):
    return bu.match_report(_spend(spark, sf))


@query("WITH " + SQL_ATTEMPTS + ", " + _SPEND + " SELECT task_id, system, round(calls / MAX(calls) OVER (PARTITION BY task_id), 8) AS calls_ratio, round(tokens / MAX(tokens) OVER (PARTITION BY task_id), 8) AS tokens_ratio FROM spend")
def relative_spend(spark, sf):
    return bu.relative_spend(_spend(spark, sf)).select("task_id", "system", R("calls_ratio").alias("calls_ratio"), R("tokens_ratio").alias("tokens_ratio"))


@query("WITH " + SQL_ATTEMPTS + ", " + _SPEND + ", " + _MATCH + " SELECT COUNT(*) AS n_tasks, COUNT(*) FILTER (NOT matched) AS n_unmatched, md5(COALESCE(string_agg(task_id::VARCHAR, ',' ORDER BY task_id) FILTER (NOT matched), '')) AS unmatched FROM m")
def match_overall(spark, sf):
    return bu.overall_report(bu.match_report(_spend(spark, sf))).withColumn("unmatched", F.md5(F.array_join("unmatched", ",").cast("binary")))


@query("WITH st AS (SELECT * FROM (VALUES (0, 0.2::DOUBLE, 0.10::DOUBLE), (1, 0.6, 0.25), (2, 0.8, 0.35), (3, 1.0, 0.20), (4, 1.2, 0.10)) v(stage, temperature, share)), s AS (SELECT *, unnest(range(1, 501)) AS j FROM st) SELECT i, temperature, stage FROM (SELECT row_number() OVER (ORDER BY share / j DESC, stage, j) - 1 AS i, temperature::DOUBLE AS temperature, stage FROM s) WHERE i < 500")
def temperature_allocation(spark, sf):
    return allocate(spark, 500, SCHEDULE)


@query("""WITH st AS (SELECT * FROM (VALUES (0, 0.2::DOUBLE, 0.10::DOUBLE), (1, 0.6, 0.25), (2, 0.8, 0.35), (3, 1.0, 0.20), (4, 1.2, 0.10)) v(stage, temperature, share)), s AS (SELECT *, unnest(range(1, 201)) AS j FROM st),
plan AS (SELECT i, temperature FROM (SELECT row_number() OVER (ORDER BY share / j DESC, stage, j) - 1 AS i, temperature FROM s) WHERE i < 200),
toy AS (SELECT * FROM (VALUES ('toy/sum_list', 0.60::DOUBLE), ('toy/is_palindrome', 0.45), ('toy/count_vowels', 0.35), ('toy/gcd', 0.25), ('toy/unique_sorted', 0.50), ('toy/impossible_parity', 0.0)) v(task_id, p))
SELECT task_id, i, temperature, ('0x' || substr(md5('0:p:' || task_id || ':' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p AS passed FROM toy, plan""")
def mock_draws_hashed(spark, sf):
    return si.draws(si.toy_tasks(spark), 200).select("task_id", "i", "temperature", "passed")


@query()
def mock_draws_exact(spark, sf):
    rows = si.draws(si.toy_tasks(spark), 200).drop("passed", "species").join(si.toy_tasks(spark), "task_id")
    return si.mock_draws(rows.withColumn("w", si.effective_weights(F.col("weights"), F.col("temperature")))).select("task_id", "i", "temperature", "passed", "species")


@query("""WITH w AS (SELECT p_partkey, [4.0, 2.0, 1.0] AS w, p_size / 25.0 AS t FROM part), r AS (SELECT *, list_transform(w, lambda x: pow(x, least(50.0, 1.0 / t))) AS p FROM w)
SELECT p_partkey, round(p[1] / list_sum(p), 8) AS first FROM r""")
def effective_weights(spark, sf):
    t = table(spark, sf, "part")
    return t.select("p_partkey", R(F.get(si.effective_weights(F.array(F.lit(4.0), F.lit(2.0), F.lit(1.0)), F.col("p_size") / 25.0), F.lit(0))).alias("first"))


@query("""WITH RECURSIVE d AS (SELECT id // 300 AS rep, true_p, (('0x' || substr(md5('ci:' || true_p || ':' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < true_p)::INT AS hit
  FROM range(120000) t(id), (SELECT unnest([0.0, 0.001, 0.01, 0.1, 0.5, 0.9]::DOUBLE[]) AS true_p)),
h AS (SELECT true_p, rep, SUM(hit)::BIGINT AS c FROM d GROUP BY ALL), cp_in AS (SELECT DISTINCT c, 300::BIGINT AS n FROM h), """ + SQL_CP + """
SELECT true_p, round(AVG((true_p BETWEEN low - 1e-12 AND high + 1e-12)::INT), 6) AS coverage, round(AVG(high - low), 6) AS mean_width, round(3 * sqrt(0.95::DOUBLE * 0.05::DOUBLE / 400), 6) AS mc_tolerance FROM h JOIN cp USING (c) GROUP BY 1""")
def ci_coverage_simulation(spark, sf):
    return si.ci_coverage(spark).select("true_p", *[R(c, 6).alias(c) for c in ("coverage", "mean_width", "mc_tolerance")])


_ZIPF = [1.0 / (i + 1) for i in range(12)]
_CUMULATIVE = [sum(_ZIPF[: i + 1]) / sum(_ZIPF) for i in range(11)]


@query(f"""WITH d AS (SELECT id // 150 AS rep, len(list_filter({_CUMULATIVE!r}::DOUBLE[], lambda c: ('0x' || substr(md5('chao:' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE > c)) AS s FROM range(30000) t(id)),
k AS (SELECT rep, s, COUNT(*) AS k FROM d GROUP BY ALL), e AS (SELECT rep, COUNT(*) AS o, COUNT(*) FILTER (k = 1) AS f1, COUNT(*) FILTER (k = 2) AS f2 FROM k GROUP BY 1), v AS (SELECT *, o + f1 * (f1 - 1) / (2.0::DOUBLE * (f2 + 1)) AS e FROM e)
SELECT COUNT(*) AS replicates, round(AVG(o), 6) AS mean_observed, round(AVG(e), 6) AS mean_estimate, round(AVG((e <= 12 + 1e-9)::INT), 6) AS not_above_truth, round(AVG((e >= o - 1e-9)::INT), 6) AS at_least_observed FROM v""")
def chao1_lower_bound_simulation(spark, sf):
    return si.chao1_lower_bound(spark).select("replicates", *[R(c, 6).alias(c) for c in ("mean_observed", "mean_estimate", "not_above_truth", "at_least_observed")])


@query("""WITH RECURSIVE toy AS (SELECT * FROM (VALUES ('toy/sum_list', 0.60::DOUBLE), ('toy/is_palindrome', 0.45), ('toy/count_vowels', 0.35), ('toy/gcd', 0.25), ('toy/unique_sorted', 0.50), ('toy/impossible_parity', 0.0)) v(task_id, p)),
h AS (SELECT task_id, p, COUNT(*) FILTER (('0x' || substr(md5('0:p:' || task_id || ':' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p) AS c, 400::BIGINT AS n FROM toy, range(400) t(i) GROUP BY ALL),
cp_in AS (SELECT DISTINCT c, n FROM h), """ + SQL_CP + """,
k AS (SELECT COUNT(*) AS n_tasks, COUNT(*) FILTER (p BETWEEN low - 1e-12 AND high + 1e-12) AS recovered FROM h JOIN cp USING (c, n)),
t AS (SELECT *, list_sum(list_transform(range(n_tasks - recovered, n_tasks + 1), lambda j: exp(lgamma(n_tasks + 1) - lgamma(j + 1) - lgamma(n_tasks - j + 1) + j * ln(0.05) + (n_tasks - j) * ln(0.95)))) AS v FROM k)
SELECT n_tasks, recovered, round(v, 6) AS p_value, v >= 0.01 AS ok FROM t""")
def pipeline_validation(spark, sf):
    return si.pipeline_validation(si.toy_tasks(spark)).withColumn("p_value", R("p_value", 6))


@query("WITH " + SQL_INDEXED + " SELECT task_id, i FROM (SELECT task_id, i, COALESCE(MAX(CASE WHEN species = '0.01|0.01' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM idx) WHERE done = 0")
def stop_at_first_public_pass(spark, sf):
    rows = indexed(attempts(spark, sf)).withColumn("public_ok", F.col("species") == "0.01|0.01")
    return si.repair_loop(rows, ["task_id"]).select("task_id", "i")


