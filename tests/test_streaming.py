"""Streams against their batch forms: order of arrival, expiry, restarts, the log with two outputs, results read from state."""

import datetime as dt
import json
import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from solvefront.operators import frontier, trace
from solvefront.streaming import attempt_log, jobs, ordered

CALLS = "conversation long, seq long, n_messages long, ok boolean"


def files(spark, rows, schema, path, parts):
    """One file for each part, in that order of time."""
    for part in parts:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def stream_of(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def to_parquet(stream, out, checkpoint):
    return jobs.finished(stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def test_traces_of_shuffled_arrival(spark, tmp_path):
    rows = [(c, s, (s * 7 + c) % 11, (s + c) % 3 != 0) for c in range(4) for s in range(12)]
    places = list(range(len(rows)))
    random.Random(2).shuffle(places)
    files(spark, rows, CALLS, str(tmp_path / "in"), [places[k::3] for k in range(3)] + [places[:5]])  # the last file repeats some
    to_parquet(ordered.stateful_seen(stream_of(spark, CALLS, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    batch = {(r.conversation, r.seq): r.seen for r in trace.seen_before(spark.createDataFrame(rows, CALLS), ["conversation"], ["seq"]).collect()}
    assert len(found) == len(rows) and {(r.conversation, r.seq): r.seen for r in found} == batch and all(r.in_order for r in found)
    at = {r.conversation: (r.next, r.held) for r in jobs.state_of(spark, str(tmp_path / "ck"), variable="at").collect()}
    assert at == {c: (12, 0) for c in range(4)}
    assert jobs.state_of(spark, str(tmp_path / "ck"), variable="held").count() == 0
    # After the first batch rows were waiting, and the store still tells.
    assert sum(r.held for r in jobs.state_of(spark, str(tmp_path / "ck"), variable="at", batch=0).collect()) > 0


def test_no_task_writes_a_whole_batch(spark):
    """A batch of arrivals is as many files as its rows have tasks, and there are three batches all the same."""
    from solvefront.plans.stream_queries import shuffled_arrival

    rows = spark.range(4000, numPartitions=8).select((F.col("id") % 40).alias("key"), F.floor(F.col("id") / 40).alias("seq"))
    stream = shuffled_arrival(spark, rows, "seq", "key", 2)
    place = stream._jdf.queryExecution().analyzed().toString().split("[")[1].split("]")[0].removeprefix("file:")
    assert len([n for n in os.listdir(place) if n.endswith(".parquet")]) >= 6
    query = jobs.finished(stream.writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).start())
    written = spark.table("arrivals")
    assert written.count() == 4000 == written.distinct().count()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3


def test_species_are_asked_once_a_batch():
    fold = object.__new__(attempt_log.FirstSeen)
    fold.passed, fold.species, fold.order, fold.columns, fold.told = "passed", "species", "i", ["i", "passed", "species"], set()
    asked, held = [], {("b",): (0,)}

    class Sightings:
        containsKey = staticmethod(lambda k: asked.append(k) or k in held)
        updateValue = staticmethod(held.__setitem__)

    fold.sightings = Sightings
    made = [fold.fold((0,), {"i": i, "passed": s != "x", "species": s})[1][-1] for i, s in enumerate(["a", "b", "x", None, "a", "b", "c", "a"])]
    assert made == [True, False, False, False, False, False, True, False] and asked == [("a",), ("b",), ("c",)]


def test_expired_conversations_leave_the_store(spark, tmp_path):
    schema = CALLS + ", ts timestamp"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [
        (1, 0, 1, True, at(0)), (1, 2, 9, True, at(1)), (2, 0, 1, True, at(0)),  # 1 lacks its second call
        (9, 0, 1, True, at(100)), (9, 1, 1, True, at(101)), (1, 1, 3, True, at(2)),  # which comes when 1 has expired
    ]
    files(spark, rows, schema, str(tmp_path / "in"), [[0, 1, 2], [3], [4], [5]])
    stream = ordered.stateful_seen(stream_of(spark, schema, str(tmp_path / "in")), time="ts", delay="1 minute", gap_seconds=600)
    to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    found = {(r.conversation, r.seq): (r.seen, r.in_order) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(1, 0): (0, True), (1, 2): (2, False), (2, 0): (0, True), (9, 0): (0, True), (9, 1): (2, True)}
    assert [r.conversation for r in jobs.state_of(spark, str(tmp_path / "ck"), variable="at").collect()] == [9]


def test_budget_of_shuffled_arrival(spark, tmp_path):
    rows = [("a", i, float(c)) for i, c in enumerate([3, 9, 2, 5, 1])]
    schema = "account string, seq long, cost double"
    files(spark, rows, schema, str(tmp_path / "in"), [[3, 0], [4, 2], [1]])
    to_parquet(ordered.stateful_budget(stream_of(spark, schema, str(tmp_path / "in")), 6.0), str(tmp_path / "out"), str(tmp_path / "ck"))
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.accepted, r.spent) for r in found] == [(True, 3.0), (False, 3.0), (True, 5.0), (False, 5.0), (True, 6.0)]


def test_what_cannot_wait_is_refused(spark, tmp_path):
    spark.createDataFrame([(1, 0, [1], True)], "conversation long, seq long, n_messages array<long>, ok boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conversation long, seq long, n_messages array<long>, ok boolean").parquet(str(tmp_path / "in"))
    with pytest.raises(TypeError, match="n_messages"):
        ordered.stateful_seen(stream)
    with pytest.raises(ValueError):
        ordered.fold_in_order(stream, ordered.Seen, ["conversation"], "seq", ["ok"], "seen bigint", gap_seconds=5)


# --- the log with two outputs -------------------------------------------------------------------------------------

ATTEMPTS = "condition_key string, task_id string, i long, passed boolean, species string, tokens long"


def attempts(n, tasks=2):
    return [("c", f"t{t}", i, (i + t) % 3 != 0, None if i % 11 == 5 else f"s{(i * i + t) % 7}", i * 10) for t in range(tasks) for i in range(n)]


def logged(spark, path):
    """(samples, species) of the log, and what they must be after so many attempts."""
    samples = sorted((r.task_id, r.i, r.passed, r.species, r.tokens) for r in attempt_log.read_log(spark, path).collect())
    species = sorted((r.task_id, r.species, r.i) for r in attempt_log.read_log(spark, path, "species").collect())
    return samples, species


def expected(spark, rows):
    df = spark.createDataFrame(rows, ATTEMPTS)
    seen = frontier.first_seen(df.where("species is not null"), ["task_id"], keep=())
    return sorted((r[1], r[2], r[3], r[4], r[5]) for r in rows), sorted((r.task_id, r.species, r.first_seen_index) for r in seen.collect())


def test_log_of_shuffled_attempts_restart_and_lost_checkpoint(spark, tmp_path):
    rows, inbox, log = attempts(20), str(tmp_path / "in"), str(tmp_path / "log")
    places = list(range(len(rows)))
    random.Random(5).shuffle(places)
    files(spark, rows, ATTEMPTS, inbox, [places[:25], places[20:]])  # some come twice
    run = lambda ck: jobs.finished(attempt_log.append_attempts(spark, stream_of(spark, ATTEMPTS, inbox), log, str(tmp_path / ck), also=("tokens",)))
    run("ck")
    assert logged(spark, log) == expected(spark, rows)
    more = attempts(26)
    files(spark, more, ATTEMPTS, inbox, [[i for i, r in enumerate(more) if r[2] >= 20]])
    run("ck")  # the same checkpoint goes on
    assert logged(spark, log) == expected(spark, more)
    run("ck")
    run("lost")  # a new one reads all input again; its state comes from the log
    assert logged(spark, log) == expected(spark, more)
    again = attempts(30, 3)
    files(spark, again, ATTEMPTS, inbox, [[i for i, r in enumerate(again) if r[2] >= 26 or r[1] == "t2"]])
    run("lost")
    assert logged(spark, log) == expected(spark, again)
    points = attempt_log.resume_points(spark, log, ["condition_key", "task_id"], "i", "species")
    assert {(r.task_id, r.next) for r in points.collect()} == {("t0", 30), ("t1", 30), ("t2", 30)}


def test_log_with_state_in_files_or_in_the_store(spark, tmp_path):
    rows, inbox = [*attempts(12), ("c", None, 0, True, "s", 1), ("c", None, 1, None, "s", 1)], str(tmp_path / "in")
    places = list(range(len(rows)))
    random.Random(7).shuffle(places)
    files(spark, rows, ATTEMPTS, inbox, [places[:9], places[6:]])
    logs = {}
    for state in ("files", "store"):
        log, ck = str(tmp_path / state), str(tmp_path / f"ck-{state}")
        asked = {} if state == "files" else {"state": state}
        for again in ({}, asked):  # a checkpoint goes on with what it began with
            query = attempt_log.append_attempts(spark, stream_of(spark, ATTEMPTS, inbox), log, ck, also=("tokens",), **(again or asked))
            jobs.finished(query)
        logs[state] = [sorted((tuple(r) for r in attempt_log.read_log(spark, log, o).collect()), key=repr) for o in attempt_log.OUTPUTS]
        assert os.path.isdir(f"{ck}/state") == (state == "store")  # in files, no row waits in a keyed processor
        with pytest.raises(ValueError, match="checkpoint"):
            attempt_log.append_attempts(spark, stream_of(spark, ATTEMPTS, inbox), log, ck, state="store" if state == "files" else "files")
    assert logs["files"] == logs["store"] and len(logs["files"][0]) == len(rows)
    done = attempt_log.manifests(spark, str(tmp_path / "files"))
    assert [bool(m["held"]) for m in done] == [True, False]
    there = [[os.path.exists(f"{tmp_path}/files/{n}") for o in attempt_log.STATE for n in m[o]] for m in done]
    assert not any(there[0]) and there[1] and all(there[1])  # a batch's state goes when the next one's is committed


def test_batches_run_twice_killed_or_aborted(spark, tmp_path):
    schema = spark.createDataFrame([], "condition_key string, task_id string, i long, passed boolean, species string, first_seen boolean").schema
    writer = attempt_log.AttemptLog({"path": str(tmp_path), "run": "r"}).streamWriter(schema, False)
    batch = lambda *i: pa.RecordBatch.from_pylist([{"condition_key": "c", "task_id": "t", "i": k, "passed": True, "species": f"s{k}", "first_seen": k % 2 == 0} for k in i])
    assert attempt_log.read_log(spark, str(tmp_path)) is None
    seen = lambda: (sorted(r.i for r in attempt_log.read_log(spark, str(tmp_path)).collect()), sorted(r.i for r in attempt_log.read_log(spark, str(tmp_path), "species").collect()))
    writer.commit([writer.write(iter([batch(0, 1), batch(2)])), writer.write(iter([])), None], 0)
    assert seen() == ([0, 1, 2], [0, 2])
    left = lambda: sorted(os.listdir(tmp_path / "samples"))
    before = left()
    writer.commit([writer.write(iter([batch(0, 1, 2)]))], 0)  # the same batch, run again
    assert seen() == ([0, 1, 2], [0, 2]) and left() == before
    writer.write(iter([batch(3, 4)]))  # dies before its commit
    assert seen() == ([0, 1, 2], [0, 2])
    writer.abort([writer.write(iter([batch(5, 6)])), None], 1)
    assert seen() == ([0, 1, 2], [0, 2]) and len(left()) == len(before) + 1
    writer.commit([writer.write(iter([batch(3)]))], 1)
    assert seen() == ([0, 1, 2, 3], [0, 2])
    assert [(m["batch"], m["run"]) for m in attempt_log.manifests(spark, str(tmp_path))] == [(0, "r"), (1, "r")]
    assert not [n for n in os.listdir(tmp_path / "manifests") if n.startswith(".") and not n.endswith(".crc")]
    assert json.loads((tmp_path / "manifests" / "r-000000001.json").read_text())["species"] == []


# --- results from state -------------------------------------------------------------------------------------------


def test_state_is_the_snapshot_and_a_restart_goes_on(spark, tmp_path):
    schema = "task_id string, passed boolean"
    first, second = [("a", True), ("a", False), ("b", True)], [("a", True), ("c", False)]
    files(spark, first + second, schema, str(tmp_path / "in"), [[0, 1, 2]])
    run = lambda: jobs.run_available(jobs.running_rates(stream_of(spark, schema, str(tmp_path / "in"))), "complete", str(tmp_path / "ck"))
    rates = lambda **of: {tuple(r) for r in jobs.state_of(spark, str(tmp_path / "ck"), **of).collect()}
    run()
    assert rates() == {("a", 2, 1), ("b", 1, 1)}
    files(spark, first + second, schema, str(tmp_path / "in"), [[3, 4]])
    run()
    assert rates() == {("a", 3, 2), ("b", 1, 1), ("c", 1, 0)}
    whole = frontier.rates(spark.createDataFrame(first + second, schema), ["task_id"])
    assert rates() == {(r.task_id, r.n_samples, r.n_correct) for r in whole.collect()}
    assert rates(batch=0) == {("a", 2, 1), ("b", 1, 1)}  # the earlier snapshot is there still


def test_sessions(spark, tmp_path, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    stream = jobs.event_stream(spark, f"{tiny}/events.parquet*", events.schema)
    jobs.run_available(jobs.sessions(stream), "complete", str(tmp_path / "ck"))
    names = jobs.state_of(spark, str(tmp_path / "ck")).columns
    assert jobs.state_of(spark, str(tmp_path / "ck")).agg(F.sum("count")).first()[0] == events.count(), names
