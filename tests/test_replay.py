"""Replayed scaffolds, reports, the generator and the epoch streams."""

import datetime as dt

import pytest

from solvefront.operators import replay as rp
from solvefront.operators import simulate
from solvefront.sources import generator, readers, reports
from solvefront.streaming import jobs

LOG = "task_id string, candidate int, step int, compiles boolean, public_ok boolean, key string"


def test_single_shot_and_self_test(spark):
    done = spark.createDataFrame([("a", "```python\nx = 1\n```"), ("b", "y"), ("c", "  ")], "task_id string, completion string")
    runs = spark.createDataFrame([("a", False, "OK!", 0), ("b", False, "", 1)], "task_id string, timed_out boolean, stdout string, exit_code int")
    got = {r.task_id: (r.code, r.reason, r.passed) for r in rp.single_shot(done, runs, "OK!").collect()}
    assert got == {"a": ("x = 1", "ok", True), "b": ("y", "test_failed", False), "c": ("", "empty_candidate", False)}
    with pytest.raises(Exception, match="no execution of b"):
        rp.single_shot(done, runs.where("task_id = 'a'"), "OK!").select("task_id").collect()
    tasks = spark.createDataFrame([("a", "x"), ("n", None)], "task_id string, reference_solution string")
    assert {tuple(r) for r in rp.self_test(tasks, runs, "OK!").collect()} == {("a", "ok", True), ("n", None, None)}


def test_staged_choice(spark):
    rows = [
        ("t", 0, 0, False, None, "p"), ("t", 0, 1, True, False, "q"), ("t", 0, 2, True, False, "x"),
        ("t", 1, 0, True, True, "y"), ("t", 1, 1, True, True, "never drawn"), ("t", 2, 0, True, None, "x"),
        ("u", 0, 0, True, False, "m"), ("u", 0, 1, True, False, "n"), ("u", 1, 0, True, None, "n")]
    log = spark.createDataFrame(rows, LOG)
    hidden = spark.createDataFrame([("t", 1, 0, True), ("u", 0, 1, False)], "task_id string, candidate int, step int, passed boolean")
    one = {r.task_id: r for r in rp.staged_choice(log, hidden, repairs=2, candidates=3).collect()}
    assert (one["t"].key, one["t"].n_candidates, one["t"].n_public_passing, one["t"].passed) == ("y", 3, 1, True)
    assert (one["u"].key, one["u"].candidate, one["u"].votes, one["u"].passed) == ("n", 0, 2, False)  # none passes in public: all vote
    early = rp.staged_candidates(log, ["task_id"], repairs=2, candidates=3, stop_early=True).where("task_id = 't'")
    assert early.count() == 4
    few = rp.staged_candidates(log, ["task_id"], repairs=2, candidates=3, calls=2).where("task_id = 't'").collect()
    assert [(r.step, r["last"]) for r in sorted(few, key=lambda r: r.step)] == [(0, False), (1, True)]
    assert rp.staged_choice(log.limit(0), hidden, repairs=2, candidates=3).count() == 0


def test_counts_merge(spark):
    df = spark.createDataFrame([("a", {"x": 1}), ("a", {"x": 2, "y": 5}), ("b", None)], "k string, op_counts map<string,bigint>")
    assert {r.k: r.op_counts for r in rp.merged_counts(df, ["k"]).collect()} == {"a": {"x": 3, "y": 5}}
    pair = spark.createDataFrame([({"x": 1}, {"x": 2, "z": 1}), (None, {"y": 3})], "a map<string,bigint>, b map<string,bigint>")
    assert [r[0] for r in pair.select(rp.add_counts(pair.a, pair.b)).collect()] == [{"x": 3, "z": 1}, {"y": 3}]


def test_suite_comparison(spark):
    summaries = spark.createDataFrame([("t", 0.5)], "task_id string, p_hat double")
    records = spark.createDataFrame([("t", 10, 0, 0.0, 0.3)], "task_id string, n_samples bigint, n_correct bigint, ci_low double, ci_high double")
    spend = spark.createDataFrame([("t", "a", 10, 100), ("t", "b", 10, 200)], "task_id string, system string, calls bigint, tokens bigint")
    row = rp.suite_comparison(summaries, records, spend, 5).first()
    assert row.elicitation_gain == 0.5 and row.matched is False and row.n_systems == 2
    with pytest.raises(Exception, match="no record"):
        rp.suite_comparison(summaries, records.limit(0), spend, 5).collect()


def test_intercepted_attempts(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    calls = spark.createDataFrame([("s", at(1), 5, 2, 200), ("s", at(9), None, 3, 200), ("s", at(2), 7, 7, 500)], "session_id string, ts timestamp, prompt_tokens bigint, completion_tokens bigint, status int")
    checks = spark.createDataFrame([("s", at(0), False), ("s", at(11), True), ("only", at(3), False)], "session_id string, ts timestamp, passed boolean")
    got = {r.session_id: r for r in rp.intercepted_attempts(calls, checks).collect()}
    assert (got["s"].n_calls, got["s"].calls, got["s"].prompt_tokens, got["s"].completion_tokens, got["s"].passed, got["s"].elapsed_s) == (3, 2, 5, 5, True, 11.0)
    assert (got["only"].calls, got["only"].n_checks, got["only"].elapsed_s) == (0, 1, 0.0)


def test_checks_at_one_instant(spark):
    """The greatest sequence number decides; without one, all of the tied checks must have passed."""
    at = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([], "session_id string, ts timestamp, prompt_tokens bigint, completion_tokens bigint, status int")
    rows = [("a", at, 1, False), ("a", at, 2, True), ("b", at, 2, False), ("b", at, 1, True), ("c", at, 1, True), ("c", at, 2, True)]
    checks = spark.createDataFrame(rows, "session_id string, ts timestamp, n int, passed boolean")
    for parts in (1, 3):
        ranked = rp.intercepted_attempts(calls, checks.repartition(parts), sequence="n")
        assert {r.session_id: r.passed for r in ranked.collect()} == {"a": True, "b": False, "c": True}
        plain = rp.intercepted_attempts(calls, checks.repartition(parts))
        assert {r.session_id: (r.passed, r.n_checks) for r in plain.collect()} == {"a": (False, 2), "b": (False, 2), "c": (True, 2)}


def test_agent_and_backends(spark):
    def agent(row, seed):
        return [{"task_id": row["task_id"], "seed": seed, "k": k} for k in range(2)]

    tasks = spark.createDataFrame([("a",), ("b",)], "task_id string")
    made = [rp.run_agent(tasks.repartition(n), agent, "task_id string, seed long, k long").orderBy("task_id", "k").collect() for n in (1, 2)]
    assert made[0] == made[1] and len(made[0]) == 4
    runs = spark.createDataFrame([("docker",), ("subprocess",)], "backend string")
    assert {tuple(r) for r in rp.with_backend(runs).collect()} == {tuple(r) for r in rp.backends(spark).collect()}
    with pytest.raises(Exception, match="unknown backend"):
        rp.with_backend(spark.createDataFrame([(None,)], "backend string")).select("backend").collect()


def test_mock_source(spark):
    generator.register(spark)
    read = lambda parts: spark.read.format("mock_attempts").option("n", 30).option("partitions", parts).load()
    rows = {tuple(r) for r in read(3).collect()}
    assert rows == {tuple(r) for r in read(7).collect()} and len(rows) == 180
    tasks = simulate.toy_tasks(spark).withColumn("temperature", simulate.F.lit(0.8)).withColumn("i", simulate.F.explode(simulate.F.sequence(simulate.F.lit(0), simulate.F.lit(29))))
    exact = simulate.mock_draws(tasks.withColumn("w", simulate.effective_weights(simulate.F.col("weights"), simulate.F.col("temperature"))))
    assert {(r.task_id, r.i, r.passed, r.species) for r in exact.collect()} == {(t, i, p, s) for t, i, _, p, s in rows}


def test_reports(spark):
    df = spark.createDataFrame([("a_b", 1, 0.25), (None, 20, None)], "arm string, n int, rate double")
    assert reports.text_table(df) == "arm  n   rate\n---  --  ----\na_b  1   0.25\n     20\n"
    tex = reports.latex_table(df)
    assert r"\begin{tabular}{lrr}" in tex and r"a\_b & 1 & 0.25 \\" in tex
    assert [r.record for r in reports.record_json(df).collect()][1] == '{"arm":null,"n":20,"rate":null}'


def test_samples_in_many_splits(spark, tmp_path):
    """Splits of a few lines each: order, the torn line and repeats hold across them."""
    lines = [f'{{"i": {i}, "passed": {str(i % 2 == 0).lower()}, "task_id": "t", "condition_key": "c"}}' for i in [*range(300), *range(100)]]
    (tmp_path / "log.jsonl").write_text("\n".join([*lines, '{"i": 300, "pas', '{"i": 301, "passed": true, "task_id": "t", "condition_key": "c"}']) + "\n")
    (tmp_path / "other.jsonl").write_text('{"i": 0, "passed": true, "task_id": "u", "condition_key": "c"}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = readers.read_samples(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.i for r in rows if r.task_id == "t") == list(range(300)) and sum(r.task_id == "u" for r in rows) == 1
    assert [r.i for r in sorted((r for r in rows if r.task_id == "t"), key=lambda r: tuple(r.line))] == list(range(300))


def test_epochs_and_snapshots(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([("s", at(1), 5), ("s", at(9), 7), ("s", at(12), 1)], "session_id string, ts timestamp, tokens bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    epochs = spark.createDataFrame([("s", 1, at(0), at(10)), ("s", 2, at(10), at(20))], "session_id string, epoch int, starts timestamp, ends timestamp")
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.epoch_totals(read(), epochs), "complete", str(tmp_path / "ck1"))
    assert {(r.epoch, r["count"], r["sum"]) for r in jobs.state_of(spark, str(tmp_path / "ck1")).collect()} == {(1, 2, 12), (2, 1, 1)}
    totals = read().groupBy("session_id").count()
    assert jobs.periodic_snapshot(totals, str(tmp_path / "snap"), str(tmp_path / "ck2"), every=None).awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "snap")).select("session_id", "count").collect()] == [("s", 3)]
