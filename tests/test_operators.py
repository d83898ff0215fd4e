"""Rules of the operators on small literal tables."""

import datetime as dt
import hashlib
import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from solvefront.functions import code as co
from solvefront.functions import statistics
from solvefront.functions import text as tx
from solvefront.operators import arms, budget, compare, frontier, scans, selection, simulate, trace, windows
from solvefront.sources import readers


def test_trace_matches_loop(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for c in range(20):
        known = 0
        for seq in range(15):
            n, ok = rng.randrange(20), rng.random() < 0.7
            rows.append((c, seq, n, ok))
            expected[c, seq] = known
            known = max(known, n) + ok
    df = spark.createDataFrame(rows, "c int, seq int, n_messages int, ok boolean")
    assert {(r.c, r.seq): r.seen for r in trace.seen_before(df, ["c"], ["seq"]).collect()} == expected


def test_unregistered_operation(spark):
    df = spark.createDataFrame([("nope",)], "op string")
    with pytest.raises(Exception, match="unregistered"):
        trace.classify(df, trace.registry(spark)).collect()
    with pytest.raises(ValueError, match="tool_call"):
        trace.registry(spark, [("tool_call", "preserving", "why", False)])
    with pytest.raises(ValueError, match="rationale"):
        trace.registry(spark, [("new", "preserving", " ", False)])
    kinds = {r["class"]: r["count"] for r in trace.registry(spark).groupBy("class").count().collect()}
    assert kinds == {"preserving": 9, "expanding": 6}


def test_allocation(spark):
    plan = [r.temperature for r in selection.allocate(spark, 500).orderBy("i").collect()]
    for n in (1, 2, 7, 15, 40, 99, 250):
        assert [r.temperature for r in selection.allocate(spark, n).orderBy("i").collect()] == plan[:n]
    assert len(set(plan[:20])) >= 4
    two = [r.stage for r in selection.allocate(spark, 100, [(0.2, 0.5), (0.9, 0.5)]).collect()]
    assert two.count(0) == two.count(1) == 50


def test_vote_ties_go_to_first(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, ""), (1, 5, None)], "t int, idx int, key string")
    assert selection.consensus(df, ["t"]).first().key == "b"


def crossing_of(spark, n=1000, c=0, solved=8, budget_calls=1000, ablated=1):
    rec = spark.createDataFrame([("t", n, c == 0)], "task_id string, n_samples bigint, beyond_frontier boolean")
    ev = spark.createDataFrame([("t", solved, 10, budget_calls)], "task_id string, n_solved bigint, n_reps bigint, budget_calls bigint")
    ab = spark.createDataFrame([("t", ablated, 10)] if ablated is not None else [], "task_id string, n_solved bigint, n_reps bigint")
    return compare.crossing(rec, ev, ab, 6, 10).first()


def test_crossing(spark):
    assert crossing_of(spark).crossed
    assert not crossing_of(spark, solved=2).crossed
    assert not crossing_of(spark, c=50).crossed
    assert not crossing_of(spark, ablated=7).crossed
    none = crossing_of(spark, ablated=None)
    assert none.ablation_removes is None and not none.crossed
    with pytest.raises(Exception, match="budget differs"):
        crossing_of(spark, budget_calls=50)


def test_placement_treats_unknowns(spark):
    place = lambda *a, gap_high=0.2: spark.range(1).select(compare.placement(*[F.lit(x).cast("double") for x in a], epsilon=0.0, retention_high=0.5, gap_high=gap_high)).first()[0]
    assert place(0, 0.1, 0.5, None, None) == "bounded_search"
    assert place(0, 0.6, 0.5, None, None) == "superhuman_elicitation"
    assert place(0.1, 0.6, 0.5, None, None) == "illusory_expansion"
    assert place(0.1, 0.6, 0.5, 0.9, None) == "genuine_expansion"
    assert place(0.1, 0.6, 0.5, 0.9, 0.25) == "illusory_expansion"
    assert place(0.1, 0.6, 0.5, 0.9, 0.25, gap_high=0.3) == "genuine_expansion"


def test_valid_rows_keep_missing_results(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "incomplete"), ("a", "error"), ("a", "resolved")], "arm string, eval_result string")
    assert arms.valid_rows(df).count() == 3


def test_arm_labels_and_pivot(spark):
    df = spark.createDataFrame([("big", "tools"), ("m", "a")], "model string, agent_src string")
    assert {r.arm for r in arms.labelled(df, [("big", "tools", "big with tools")]).collect()} == {"big with tools", "m | a"}


def test_ledger_and_caps(spark):
    charges = spark.createDataFrame([("a/b", 1, 10), ("a/c", 2, 20), ("a", 4, 40)], "path string, calls bigint, tokens bigint")
    got = {r.account: (r.calls, r.tokens) for r in budget.ledger(charges).collect()}
    assert got == {"a": (7, 70), "a/b": (1, 10), "a/c": (2, 20)}
    requests = spark.createDataFrame([("a/b", 1)], "path string, calls bigint")
    caps = lambda n: spark.createDataFrame([("a", n)], "account string, cap bigint")
    assert budget.affordable(requests, budget.ledger(charges), caps(8)).first().can_afford
    assert not budget.affordable(requests, budget.ledger(charges), caps(7)).first().can_afford
    assert {r.account: r.children for r in budget.snapshot(budget.ledger(charges)).collect()}["a"][0].account == "a/b"


def test_reject_and_continue(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([3, 9, 2, 5])], "k string, i int, c int")
    r = budget.charge_in_order(df, ["k"], "i", "c", 6).first()
    assert (r.spent, r.taken, r.refused) == (5.0, 2, 2)


def test_reject_and_continue_over_many_batches(spark):
    """Accounts larger than a batch, several in one, null ones and null costs: equal to the plain fold."""
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "c"]), j, i, rng.choice([None, 0.5, 1.0, 3.0, 40.0])) for i in range(900) for j in (1, 2)] + [("z", 1, 5, 7.0), ("z", 1, 5, 6.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, j int, i int, c double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(r.k, r.j): (r.spent, r.taken, r.refused) for r in budget.charge_in_order(df, ["k", "j"], "i", "c", 50.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for k, j, _, c in sorted(rows, key=lambda r: (r[2], -1 if r[3] is None else r[3])):
        spent, taken, refused = want.get((k, j), (0.0, 0, 0))
        fits = c is not None and spent + c <= 50
        want[k, j] = (spent + c, taken + 1, refused) if fits else (spent, taken, refused + 1)
    assert got == want
    assert budget.charge_in_order(df.where("false"), ["k", "j"], "i", "c", 50.0).count() == 0


def test_match_report(spark):
    df = spark.createDataFrame([(1, "a", 100, 0), (1, "b", 96, 0), (2, "a", 100, 0), (2, "b", 90, 0), (3, "a", 5, 5)], "task_id int, system string, calls int, tokens int")
    assert {r.task_id: r.matched for r in budget.match_report(df).collect()} == {1: True, 2: False, 3: True}


def test_manifest_diff(spark):
    frozen = spark.createDataFrame([("a", "1", "train"), ("b", "1", "train"), ("c", "1", None)], "task_id string, hash string, split string")
    now = spark.createDataFrame([("b", "2", "train"), ("c", "1", "held_out"), ("d", "1", "train")], "task_id string, hash string, split string")
    assert {tuple(r) for r in selection.manifest_diff(frozen, now).collect()} == {("a", "missing"), ("b", "changed_hash"), ("c", "changed_split"), ("d", "added")}


def test_blake2_unit(spark):
    digest = hashlib.blake2b(b"salt\0toy/gcd", digest_size=8).digest()
    assert co.blake2_unit("toy/gcd", "salt") == int.from_bytes(digest, "little") / 2**64
    df = spark.createDataFrame([(f"t{i}", "f" if i % 5 else "moved") for i in range(400)], "task_id string, family string")
    rows = selection.assign_splits(df, co.blake2_unit_column(F.col("task_id"), "salt"), train=0.6, held_out=0.2, transfer_families=["moved"]).collect()
    assert {r.split for r in rows if r.family == "moved"} == {"transfer"}
    assert 0.5 < sum(r.split == "train" for r in rows if r.family == "f") / 320 < 0.7


def test_literals(spark):
    archive = spark.createDataFrame([(1, "x = 'abcdef123'"), (2, "nothing"), (3, None)], "id int, source_excerpt string")
    lits = spark.createDataFrame([(" abcdef ",), ("not",), ("thingsx",)], "literal string")
    assert [(r.id, r.literal) for r in compare.hard_coded(archive, lits).collect()] == [(1, "abcdef")]


def test_literals_of_one_beginning_both_ways(spark, monkeypatch):
    """Every literal has the same first forty characters; the automaton and the join by rarest pieces find the same rows."""
    head = "the very same beginning of each of these "
    lits = [f"{head}{i:04d}{'é漢'[i % 2]}😀 tail" for i in range(300)] + ["abcdef", "fedcba  spaced"]
    texts = [f"x{lits[i]}y{lits[(7 * i) % 300]}" for i in range(0, 300, 3)] + [head * 50, "abcdefedcba", None, "", "xx fedcba  spaced", "long " * 60_000 + lits[5]]
    archive = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")], "id int, source_excerpt string, window string")
    literals = spark.createDataFrame([(f" {x} ",) for x in lits] + [("short",), (None,)], "literal string")
    by_machine = sorted((r.id, r.literal, r.window) for r in compare.hard_coded(archive, literals).collect())
    monkeypatch.setattr(compare, "AUTOMATON_BYTES", 0)
    by_join = sorted((r.id, r.literal, r.window) for r in compare.hard_coded(archive, literals).collect())
    plain = sorted((i, x, "s") for i, t in [*enumerate(texts), (0, texts[0])] for x in lits if t and x in t)
    assert by_machine == by_join == plain


def test_texts_are_worked_on_in_slices_each_once(monkeypatch):
    """No more texts are Python objects at a time than a slice has; equal ones of a slice are parsed once; nulls stay."""
    calls = []
    texts = pa.array(["a" * 400, None, "b" * 400, "a" * 400, None, "c" * 5000, "", "a" * 400])
    monkeypatch.setattr(co, "SLICE_BYTES", 1300)
    got = co.by_slices(lambda t: calls.append(t) or len(t), texts, pa.int64())
    assert got.to_pylist() == [400, None, 400, 400, None, 5000, 0, 400]
    assert [t[:1] for t in calls] == ["a", "b", "c", "", "a"]
    assert co.by_slices(len, pa.array([], pa.string()), pa.int64()).to_pylist() == []


def test_equal_programs_are_parsed_once_a_batch(spark, tmp_path):
    """The functions of entry_points, on rows of few different texts, against one call a row."""
    texts = [None, "assert f(1) == 2\nassert g(2) == 3", "(", "", "x = 1"]
    df = spark.createDataFrame([(i, texts[i % 5]) for i in range(40)], "id int, t string").coalesce(1)
    got = df.select("id", "t", co.entry_point_udf("t").alias("e"), co.public_asserts_udf(F.col("t")).alias("p"), co.short_hash_udf("t").alias("s"), co.compiles_udf("t").alias("c"), co.canonical_udf("t").alias("k")).collect()
    plain = lambda f, t: None if t is None else f(t)
    assert len(got) == 40
    for r in got:
        assert (r.e, r.p, r.s, r.c) == tuple(plain(f, r.t) for f in (co.entry_point, co.public_asserts, co.short_hash, co.compiles))
        assert (None if r.k is None else tuple(r.k)) == plain(co.canonical_form, r.t)


def test_windows_are_yielded_in_slices(spark, monkeypatch):
    """A batch of long texts goes out in slices of bounded bytes, whose windows are those of the whole."""
    sizes = []
    rows = [(i, f"{i:04d}" + "x" * 96 + f"{i % 7:04d}") for i in range(200)] + [(900, None), (901, "")]
    long = spark.createDataFrame(rows, "id int, t string").coalesce(1)
    short = spark.createDataFrame([("x0003",), ("0199x",)], "n string")
    grab = type(long).mapInArrow
    monkeypatch.setattr(windows, "SLICE_BYTES", 1000)

    def watched(df, work, schema, *more):
        if "window" in str(schema):
            sizes.extend(b.num_rows for b in work(iter(df.toArrow().to_batches())))
        return grab(df, work, schema, *more)

    monkeypatch.setattr(type(long), "mapInArrow", watched)
    found = windows.windows_like(long, "t", ["id"], short, "n").join(short, F.col("window") == F.col("n")).select("id", "window").collect()
    assert {(r.id, r.window) for r in found} == {(i, w) for i, t in rows for w in ("x0003", "0199x") if t and w in t}
    assert len(sizes) > 20 and max(sizes) <= 40


def test_a_log_is_no_task(spark, tmp_path):
    """One file's rows go to many tasks, whatever the size of what they are joined with; a torn line still ends the file."""
    lines = [json.dumps({"i": i % 900, "passed": True, "condition_key": "c", "task_id": f"t{i % 3}"}) for i in range(1000)]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines, '{"i": 5', json.dumps({"i": 9999, "task_id": "t0"})]))
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        places = readers.read_samples(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        few = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        many = readers.read_samples(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", few)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in places) == sum(r["count"] for r in many) == len({(i % 900, i % 3) for i in range(1000)})
    assert len(places) > 1 and len(many) > 8


def test_canonical_form():
    key = lambda c: co.canonical_form(c)[2]
    assert key("def f(a):\n    return a+1") == key('def f(bb):\n    """doc"""\n    return bb + 1')
    assert key("def f(a):\n    return a+1") != key("def g(a):\n    return a+1")
    assert key("import math\ndef f(a):\n    return math.sqrt(a)") != key("import cmath\ndef f(a):\n    return cmath.sqrt(a)")
    assert co.canonical_form("def f(:")[1] == "text"
    assert not co.compiles("def f(:") and co.compiles("x = 1")
    assert co.entry_point("assert add(1, 2) == 3") == "add"


def test_texts_beyond_the_parser():
    """Unparsable by depth, by null bytes or by syntax: the stripped text, and nothing public."""
    from solvefront.functions import code as co

    for text in ("x = " + "-" * 20_000 + "1", "f = " + "lambda: " * 3000 + "1", "x = " + "+".join(["1"] * 50_000), "x\0y", "def"):
        assert co.canonical_form(text)[1] == "text" and not co.compiles(text)
        assert co.entry_point(text) == co.public_asserts("assert 1\n" + text) == co.public_table("def check(f):\n  inputs = [1]\n  results = [1]\n" + text, "f") == ""
    assert co.canonical_form("x = " + "(" * 150 + "1" + ")" * 150)[:2] == ("v0 = 1", "ast")


def test_public_tests():
    table = "def check(candidate):\n    inputs = [1, 2, 3]\n    results = [2, 3, 4]\n    for i, r in zip(inputs, results):\n        assert candidate(i) == r\n"
    out = co.public_table(table, "f")
    assert "[1, 2]" in out and "[2, 3]" in out and out.endswith("check(f)\n")
    assert co.public_table("x = 1", "f") == ""


def test_extract_code(spark):
    cases = {"```python\na\n```": "a", "x\n```\nb\n```\n```py\nc\n```": "b\n\nc", "plain ": "plain", "```python\nopen": "open"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", tx.extract_code(F.col("t")).alias("c")).collect()} == cases


def test_prose_calls(spark):
    good = '```json\n{"name": "bash", "arguments": {"command": "ls"}}\n```'
    df = spark.createDataFrame([("a", "1", good), ("a", "2", '{"name": "bash", broken}'), ("a", "3", "text")], "arm string, file string, text string")
    assert tuple(trace.prose_calls(df).first()) == ("a", 3, 2, 1, 1)


def test_torn_log(spark, tmp_path):
    path = tmp_path / "samples.jsonl"
    line = lambda i, p: json.dumps({"i": i, "passed": p, "task_id": "t", "condition_key": "c"})
    path.write_text("\n".join([line(0, True), line(1, False), line(1, True), "", '{"i": 2, "pas', line(3, True)]))
    rows = readers.read_samples(spark, str(path)).orderBy("i").collect()
    assert [(r.i, r.passed) for r in rows] == [(0, True), (1, False)]


def test_mixed_arm_file(spark, tmp_path):
    (tmp_path / "arm.json").write_text(json.dumps([{"model": "a", "passed": True}, {"model": "b", "passed": True}]))
    with pytest.raises(Exception, match="mixed arms"):
        readers.read_arm(spark, str(tmp_path / "arm.json")).collect()
    (tmp_path / "one.json").write_text(json.dumps([{"model": "a", "passed": True, "trace_op_counts": {"tool_call": 3}}]))
    assert readers.read_arm(spark, str(tmp_path / "one.json")).first().tool_calls == 3


def test_records_last_wins(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"task_id": "t", "n_samples": 1}\n{"task_id": "t", "n_samples": 2}\n')
    assert readers.read_records(spark, str(tmp_path / "r.jsonl")).first().n_samples == 2


def test_config(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"b": 1, "c": 2}}')
    (tmp_path / "child.json").write_text('{"extends": "base.json", "a": {"b": 3}}')
    config = readers.load_config(str(tmp_path / "child.json"), ["a.d=true", "x=1.5"])
    assert config.get("a.b") == 3 and config.get("a.c") == 2 and config.get("a.d") is True and config.get("x") == 1.5
    assert len(config.fingerprint()) == 16
    with pytest.raises(KeyError):
        config.get("a.z")


def test_swebench_lists(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"instance_id": "i", "FAIL_TO_PASS": "[\\"a\\", \\"b\\"]", "PASS_TO_PASS": "[]"}\n')
    assert readers.read_suite(spark, str(tmp_path / "s.jsonl"), "swebench").first().FAIL_TO_PASS == ["a", "b"]


def test_simulations(spark):
    row = simulate.chao1_lower_bound(spark, replicates=50).first()
    assert row.at_least_observed == 1.0
    cover = simulate.ci_coverage(spark, n=60, replicates=80).collect()
    assert all(r.coverage >= 0.95 - r.mc_tolerance for r in cover)
    assert simulate.pipeline_validation(simulate.toy_tasks(spark), 200).first().ok


def test_exact_draw_is_stable():
    assert simulate.mock_draw(0, "m", "t", 0.5, 1, 0.5, [1.0, 2.0]) == simulate.mock_draw(0, "m", "t", 0.5, 1, 0.5, [1.0, 2.0])
    assert simulate.mock_draw(0, "m", "t", 0.5, 1, 0.0, [1.0]) == (False, -1)


def test_thompson(spark):
    schema = "id string, mean_utility double, evals array<double>"
    some = spark.createDataFrame([("a", 0.0, [0.0, 0.0]), ("b", 0.9, [1.0, 1.0, 0.0]), ("c", float("nan"), [1.0])], schema)
    post = compare.thompson_parameters(some).collect()
    assert [(r.id, r.alpha, r.beta) for r in post] == [("b", 3.0, 2.0)]
    none = spark.createDataFrame([("a", 0.0, [0.0, 0.0]), ("d", 0.0, [0.0])], schema)
    drawn = compare.thompson_draw(compare.thompson_parameters(none), "id").collect()
    assert {r.id for r in drawn} == {"a", "d"} and sum(r.chosen for r in drawn) == 1
    assert max(drawn, key=lambda r: r.theta).chosen


def test_broken_tasks_and_timeouts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "task_id string")
    got = {r.task_id: r.timeout_s for r in readers.without_broken(df, ["b"], {"c": 60.0}).collect()}
    assert got == {"a": 20.0, "c": 60.0}


def test_whole_canonical_text(spark, tiny):
    """Every document, comments removed unless a quote stands before the sign."""
    import re

    import __spark_entry__ as entry_module

    def canon(text):
        lines = (re.sub(r"[ \t\n\x0b\f\r]+$", "", re.sub(r"(?<!['\"])#.*$", "", x)) for x in re.split(r"\r\n|\r|\n", text))
        return "\n".join(x for x in lines if x)

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {r.doc_id: r.canon for r in entry_module.queries()["canonical_text"](spark, tiny).collect()}
    assert any("#" in (t or "") for t in docs.values())
    assert got == {i: None if t is None else canon(t) for i, t in docs.items()}


def test_whole_texts_are_read(spark, tmp_path):
    """What stands beyond the first characters counts."""
    import __spark_entry__ as entry_module

    blank = " " * 20
    text = "a = 1\n" * 50 + "```python\nb = 2\n```\n"
    docs = [(1, blank + "x = 1"), (3, "c = 3\n" * 60 + "d = ("), (5, text), (7, "the passage opens alike, then it goes on"), (9, "the passage opens alike, then it parts")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the passage opens alike, then it parts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    q = {n: {r.doc_id: r for r in entry_module.queries()[n](spark, str(tmp_path)).collect()} for n in ("verdict_lattice", "canonical_species", "fence_extraction_whole", "program_assembly", "hard_coded_literals")}
    assert q["verdict_lattice"][1].reason == "test_failed"
    assert not q["canonical_species"][3].compiles
    assert q["fence_extraction_whole"][5].code == "b = 2"
    assert q["program_assembly"][5].program.startswith(text)
    assert set(q["hard_coded_literals"]) == {9}


# --- guards and records --------------------------------------------------------------------------------------


@pytest.mark.parametrize("one_key", [True, False])
def test_scans_by_ranges_equal_windows(spark, one_key):
    """Sums, numbers and known lengths by ranges of thirty rows, a key holding all rows or several, null keys and values among them."""
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [("k" if one_key else rng.choice([None, "a", "b", "b", "b"]), start + dt.timedelta(seconds=rng.randrange(400) ** 2), i, rng.choice([None, 1, 2, 9]), rng.randrange(30), rng.random() < 0.4) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int, cost int, length int, ok boolean")
    for order in (["i"], ["ts", "i"]):
        w = Window.partitionBy("k").orderBy(*order)
        assert scans.ranged(df, ["k"], order, 30).select("k", scans.RANGE).distinct().count() > 15
        got = scans.running_sum(df, ["k"], order, F.col("cost"), "x", range_rows=30)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, df.withColumn("x", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).collect()))
        got = scans.running_number(df, ["k"], order, "x", range_rows=30)
        assert {(r.i, r.x) for r in got.collect()} == {(r.i, r.x) for r in df.withColumn("x", F.row_number().over(w) - 1).collect()}
        seen = {r.i: r.seen for r in trace.seen_before(df, ["k"], order, "length", range_rows=30).collect()}
        known: dict = {}
        for r in sorted(df.collect(), key=lambda r: tuple(r[c] for c in order)):
            assert seen[r.i] == known.get(r.k, 0)
            known[r.k] = max(known.get(r.k, 0), r.length) + r.ok
    assert scans.ranged(df, ["k"], ["k"], 30).select(scans.RANGE).distinct().count() == 1
    assert scans.running_sum(df.where("false"), ["k"], ["i"], F.col("cost"), "x").count() == 0


def test_ranges_of_one_key_are_several_tasks(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = scans.running_number(df, ["k"], ["i"], "x", range_rows=100).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def test_feedback_by_windows(spark):
    """Heads of every length, quotes before and after, across a piece of a long prompt, in other sessions."""
    heads = ["x", "ab", "E: wörld 😀 failed at line 123 of it", "  padded error that is long enough ", " ", None, "E: wörld 😀 failed at li", "never quoted at all, not once"]
    errors = [(s, 2 * i, h) for s in ("a", "b") for i, h in enumerate(heads)]
    filler = "q" * (windows.PIECE - 10)
    prompts = [("a", 1, "x"), ("a", 3, "zabz"), ("a", 5, filler + "E: wörld 😀 failed at line"), ("a", 9, None), ("a", 7, "padded error that is lo"), ("b", 20, "padded error that is long"), ("b", 1, "ab x"), ("b", 30, ""), ("b", 31, "E: wörld 😀 failed at li!")]
    v = spark.createDataFrame(errors, "session_id string, seq int, error string")
    m = spark.createDataFrame(prompts, "session_id string, seq int, prompt string")
    got = {(r.session_id, r.seq): r.feedback for r in trace.conditioned(v, m).collect()}
    need = lambda e: (e or "").strip(" ")[:24]
    want = {(s, q): any(ps == s and pq > q and p and need(e) in p for ps, pq, p in prompts) if need(e) else False for s, q, e in errors}
    assert got == want and sum(want.values()) >= 5
    assert trace.conditioned(v.where("false"), m).count() == 0 and not trace.conditioned(v, m.where("false")).where("feedback").count()


def test_guards_hold_whatever_is_selected(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "task_id string, x int")
    two = spark.createDataFrame([("a", 3)], "task_id string, y int")
    for frame in (compare.require_match(one, two, "task_id"), compare.require_same(one, two, "task_id"), compare.require_same(two, one, "task_id")):
        with pytest.raises(Exception, match="no partner for b"):
            frame.select("x").collect()
    assert compare.require_match(two, one, "task_id").count() == 1
    mixed = spark.createDataFrame([("a", "c1"), ("a", "c2")], "task_id string, condition_key string")
    with pytest.raises(Exception, match="mixed conditions"):
        frontier.require_one_condition(mixed, "condition_key", ["task_id"]).select("task_id").collect()
    with pytest.raises(Exception, match="unregistered operation"):
        trace.classify(spark.createDataFrame([("t", "nothing")], "task_id string, op string"), trace.registry(spark)).select("task_id").collect()


def test_crossing_refuses_other_tasks(spark):
    record = lambda t: spark.createDataFrame([(t, 10, True)], "task_id string, n_samples long, beyond_frontier boolean")
    summary = lambda t: spark.createDataFrame([(t, 8, 10, 10)], "task_id string, n_solved long, n_reps long, budget_calls long")
    assert compare.crossing(record("a"), summary("a"), summary("a").where("false"), 6, 10).count() == 1
    for r, e, a in (("a", "b", "a"), ("a", "a", "b")):
        with pytest.raises(Exception, match="no partner|another task"):
            compare.crossing(record(r), summary(e), summary(a), 6, 10).select("reliable_solve").collect()
    with pytest.raises(Exception, match="no partner"):
        compare.ablation_effect(summary("a"), summary("b")).collect()


def test_records_have_their_own_size_and_level(spark):
    log = [("t", i, False, None, None, "timeout" if i else None, 1, 2, 3, 0.5) for i in range(3)] + [("u", i, True, f"s{i % 2}", "ast", None, 1, 2, 3, 0.5) for i in range(7)]
    rows = spark.createDataFrame(log, "task_id string, i long, passed boolean, species string, canon_method string, reason string, calls long, prompt_tokens long, completion_tokens long, usd double")
    got = {r.task_id: r for r in frontier.frontier_records(rows, confidence=0.5).collect()}
    assert got["t"].exact_zero_success_bound == pytest.approx(1 - 0.5 ** (1 / 3)) and "0.206 at 50%" in got["t"].qualifier
    assert sorted(got["t"].pass_at_k) == [1, 2, 3] and sorted(got["u"].pass_at_k) == [1, 2, 5, 7] and sorted(got["u"].rarefaction) == [1, 2, 5, 7]
    assert got["u"].species_counts == {"s0": 4, "s1": 3} and got["u"].canonicalization_methods == {"ast": 7} and got["u"].usage.total_tokens == 35 and got["t"].n_verifier_errors == 2
    assert got["u"].rarefaction[7] == 2 and got["u"].pass_at_k[7] == 1


def test_resume_state(spark):
    rows = spark.createDataFrame([("t", 0, True, "s", "c"), ("t", 1, False, None, "c"), ("u", 0, True, "s", "c")], "task_id string, i long, passed boolean, species_key string, condition_key string")
    got = {r.task_id: r for r in frontier.resume_state(rows, "c").collect()}
    assert (got["t"].n_done, got["t"].next_index, got["t"].n_correct, got["t"].species_counts) == (2, 2, 1, {"s": 1}) and got["u"].n_done == 1
    with pytest.raises(Exception, match="other conditions"):
        frontier.resume_state(rows, "d").select("task_id").collect()


def test_arm_table_counts_infrastructure(spark):
    rows = [("a", "resolved", True, 1, 2, 1.0), ("a", "incomplete", True, 1, 2, 9.0), ("a", "error", False, 0, 1, 3.0), ("b", "", False, 0, 0, 1.0), ("a", None, False, 0, 1, 2.0)]
    got = {r.arm: r for r in arms.arm_table(spark.createDataFrame(rows, "arm string, eval_result string, passed boolean, tool_calls long, generations long, elapsed_s double")).collect()}
    a = got["a"]
    assert (a.n, a.resolved, a.infra_excluded, a.used_tools, a.nonempty, a.wrong_artifact, a.total_generations, a.mean_elapsed_s) == (3, 1, 1, 1, 3, 1, 4, 2.0)
    assert 0 < a.ci_low < a.tools_high < 1 and got["b"].n == 0 and got["b"].infra_excluded == 1


def test_prose_call_details(spark):
    call = lambda name, **args: json.dumps({"name": name, "arguments": args})
    texts = [("x", f"f{i}.md", "```json\n" + call("bash", command="ls") + "\n```") for i in range(5)] + [("x", "e.md", "```json\n" + call("editor", command="create", path="p", file_text="t") + "\n```"), ("y", "n.md", "nothing")]
    got = {r.arm: r for r in trace.prose_call_details(spark.createDataFrame(texts, "arm string, file string, text string")).collect()}
    assert got["x"].tools_used == {"bash": 5, "editor": 1} and got["x"].commands_used == {"create": 1} and got["x"].runnable_examples == ["e.md", "f0.md", "f1.md"] and got["y"].tools_used is None


def test_pass_at_k_by_either_product(spark):
    cases = [(n, c, k) for n in (1, 7, 60) for c in (0, 1, n // 2, n) for k in (1, n // 3 or 1, n)]
    df = spark.createDataFrame(cases, "n long, c long, k long").withColumn("p", statistics.pass_at_k(F.col("n"), F.col("c"), F.col("k")))
    for r in df.collect():
        assert r.p == pytest.approx(1 - math.comb(r.n - r.c, r.k) / math.comb(r.n, r.k), abs=1e-12)
