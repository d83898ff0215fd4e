"""Queries on replayed scaffolds, suites and epochs."""

from __future__ import annotations


from pyspark.sql import functions as F

from solvefront.operators import compare as cm
from solvefront.operators import replay as rp
from solvefront.plans.bindings import SQL_INDEXED, attempts, indexed, table
from solvefront.plans.bindings import rounded as R
from solvefront.plans.bindings import shared_path
from solvefront.plans.registry import query

_LOG = """log AS (
  SELECT task_id, system, (row_number() OVER w - 1) // 3 AS candidate, (row_number() OVER w - 1) % 3 AS step, tokens > 3 AS compiles,
    CASE WHEN tokens % 5 = 0 THEN true WHEN tokens % 5 < 4 THEN false END AS public_ok, species AS key, passed
  FROM idx WINDOW w AS (PARTITION BY task_id, system ORDER BY i))"""
# A row is drawn if no earlier row of its candidate was done, its candidate is not after the first that passed in public, and the calls last.
_DRAWN = """open_ AS (SELECT * FROM log l WHERE candidate < 6 AND step <= 2 AND NOT EXISTS (
    SELECT 1 FROM log e WHERE e.task_id = l.task_id AND e.system = l.system AND e.candidate = l.candidate AND e.step < l.step AND e.compiles AND e.public_ok IS DISTINCT FROM false)),
firsts AS (SELECT task_id, system, MIN(candidate) AS stop FROM open_ WHERE compiles AND public_ok GROUP BY ALL),
cut AS (SELECT o.* FROM open_ o LEFT JOIN firsts f USING (task_id, system) WHERE stop IS NULL OR candidate <= stop),
drawn AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY task_id, system ORDER BY candidate, step) <= 10),
finals AS (SELECT * FROM drawn QUALIFY step = MAX(step) OVER (PARTITION BY task_id, system, candidate)),
counted AS (SELECT task_id, system, COUNT(*) AS n_candidates, COUNT(*) FILTER (compiles AND public_ok) AS n_public_passing FROM finals GROUP BY ALL),
pool AS (SELECT f.* FROM finals f JOIN counted c USING (task_id, system) WHERE n_public_passing = 0 OR (compiles AND public_ok)),
votes AS (SELECT task_id, system, key, COUNT(*) AS votes, MIN(candidate) AS candidate FROM pool GROUP BY ALL),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY task_id, system ORDER BY votes DESC, candidate) = 1)"""


def _log(spark, sf):
    rows = indexed(attempts(spark, sf), ("task_id", "system"))
    t = F.col("tokens") % 5
    return rows.select("task_id", "system", F.floor(F.col("i") / 3).alias("candidate"), (F.col("i") % 3).cast("bigint").alias("step"), (F.col("tokens") > 3).alias("compiles"),
                       F.when(t == 0, True).when(t < 4, False).alias("public_ok"), F.col("species").alias("key"), "passed")


@query("WITH " + SQL_INDEXED + ", " + _LOG + ", " + _DRAWN + """
SELECT c.task_id, c.system, n_candidates, n_public_passing, b.candidate, b.votes, f.step, f.passed
FROM counted c JOIN best b USING (task_id, system) JOIN finals f ON f.task_id = c.task_id AND f.system = c.system AND f.candidate = b.candidate""")
def staged_choice(spark, sf):
    log = _log(spark, sf)
    return rp.staged_choice(log.drop("passed"), log, ["task_id", "system"], repairs=2, candidates=6, calls=10, stop_early=True).drop("key")


@query("""SELECT p_partkey::VARCHAR AS task_id, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'empty_candidate' WHEN p_size % 3 = 0 THEN 'timeout' WHEN p_size % 2 = 0 THEN 'ok' ELSE 'test_failed' END AS reason,
  CASE WHEN p_size % 5 <> 0 THEN p_size % 7 <> 0 AND p_size % 3 <> 0 AND p_size % 2 = 0 END AS passed FROM part""")
def reference_self_test(spark, sf):
    p, size = table(spark, sf, "part"), F.col("p_size")
    key = F.col("p_partkey").cast("string").alias("task_id")
    tasks = p.select(key, F.when(size % 5 == 0, None).when(size % 7 == 0, "  ").otherwise(F.col("p_name")).alias("reference_solution"))
    runs = p.select(key, (size % 3 == 0).alias("timed_out"), F.when(size % 2 == 0, "OK!").otherwise("").alias("stdout"), (size % 2).alias("exit_code"))
    return rp.self_test(tasks, runs, "OK!")


@query("""WITH m AS (SELECT user_id AS session_id, COUNT(*) AS n_calls, COUNT(*) FILTER (event_type <> 'error') AS calls, COALESCE(SUM(event_id % 50) FILTER (event_type <> 'error'), 0)::BIGINT AS prompt_tokens,
  COALESCE(SUM(event_id % 7) FILTER (event_type <> 'error'), 0)::BIGINT AS completion_tokens, MIN(ts) AS a, MAX(ts) AS b FROM events WHERE event_type <> 'purchase' GROUP BY 1),
v AS (SELECT user_id AS session_id, COUNT(*) AS n_checks, arg_max(value > 50, (ts, event_id)) AS passed, MIN(ts) AS a, MAX(ts) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT COALESCE(m.session_id, v.session_id) AS session_id, COALESCE(n_calls, 0) AS n_calls, COALESCE(calls, 0) AS calls, COALESCE(prompt_tokens, 0) AS prompt_tokens, COALESCE(completion_tokens, 0) AS completion_tokens,
  COALESCE(n_checks, 0) AS n_checks, COALESCE(passed, false) AS passed, epoch_us(least(m.a, v.a)) AS began_us, round((epoch_us(greatest(m.b, v.b)) - epoch_us(least(m.a, v.a))) / 1e6::DOUBLE, 3) AS elapsed_s
FROM m FULL JOIN v ON m.session_id = v.session_id""")
def intercepted_attempts(spark, sf):
    """Events as an intercepted run: purchases are checks; of a user's checks at one instant the later event counts."""
    e = table(spark, sf, "events").withColumn("session_id", F.col("user_id"))
    calls = e.where("event_type <> 'purchase'").select("session_id", "ts", (F.col("event_id") % 50).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))
    checks = e.where("event_type = 'purchase'").select("session_id", "ts", "event_id", (F.col("value") > 50).alias("passed"))
    out = rp.intercepted_attempts(calls, checks, sequence="event_id")
    return out.withColumn("began_us", F.unix_micros(F.col("created_at").cast("timestamp"))).withColumn("elapsed_s", R("elapsed_s", 3)).drop("created_at")


@query("SELECT user_id, event_type AS op, COUNT(*) AS n FROM events GROUP BY ALL")
def merged_op_counts(spark, sf):
    daily = cm.op_count_map(table(spark, sf, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type")
    return rp.merged_counts(daily, ["user_id"]).select("user_id", F.explode("op_counts").alias("op", "n"))


@query("""WITH t AS (SELECT l_suppkey AS task_id, COUNT(*) FILTER (l_returnflag = 'R') AS b, [COUNT(*) FILTER (l_returnflag = 'R' AND l_linenumber % 4 <> 0), COUNT(*) FILTER (l_returnflag = 'R' AND l_linenumber % 4 <> 1),
  COUNT(*) FILTER (l_returnflag = 'R' AND l_linenumber % 4 <> 2), COUNT(*) FILTER (l_returnflag = 'R' AND l_linenumber % 4 <> 3)] AS a FROM lineitem GROUP BY 1), x AS (SELECT b, unnest(range(4)) AS operation, unnest(a) AS a FROM t)
SELECT operation, COUNT(*) AS n_tasks, SUM(greatest(0, b - a))::BIGINT AS removed, COUNT(*) FILTER (a < b) AS load_bearing_tasks FROM x GROUP BY 1""")
def suite_ablation(spark, sf):
    """A line's number tells which of four operations solved it."""
    t = table(spark, sf, "lineitem").withColumn("task_id", F.col("l_suppkey"))
    solved = F.col("l_returnflag") == "R"
    full = t.groupBy("task_id").agg(F.count_if(solved).alias("n_solved"))
    off = t.withColumn("operation", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).groupBy("task_id", "operation").agg(F.count_if(solved & (F.col("l_linenumber") % 4 != F.col("operation"))).alias("n_solved"))
    return rp.suite_ablation(full, off)


@query("SELECT user_id, date_trunc('day', ts)::DATE AS epoch, COUNT(*) AS calls, SUM(event_id % 50)::BIGINT AS tokens FROM events GROUP BY ALL")
def streamed_epochs(spark, sf):
    from solvefront.streaming.jobs import epoch_totals, event_stream, run_available, state_of

    e = table(spark, sf, "events")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    epochs = e.select("user_id", day.cast("date").alias("epoch"), day.alias("starts"), (day + F.expr("interval 1 day")).alias("ends")).distinct()
    stream = event_stream(spark, f"{sf}/events.parquet*", e.schema).withColumn("tokens", F.col("event_id") % 50)
    checkpoint = shared_path(spark, "epochs")
    run_available(epoch_totals(stream, epochs, key="user_id"), "complete", checkpoint)
    return state_of(spark, checkpoint).select("user_id", "epoch", F.col("count").alias("calls"), F.col("sum").alias("tokens"))
