"""Frozen splits, account trees of any depth, posterior draws."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from solvefront.operators import budget, compare, selection
from solvefront.sources import manifests

TASKS = "task_id string, hash string, split string"
HALF = manifests.SplitRatios(0.5, 0.5)


def suite(spark, n=50, changed=()):
    return spark.createDataFrame([(f"t{i}", f"h{i}" + "x" * (i in changed), "train" if i % 2 else None) for i in range(n)], TASKS)


def test_freeze_and_verify(spark, tmp_path):
    path = str(tmp_path / "m")
    assert manifests.frozen(spark, path) is None
    with pytest.raises(FileNotFoundError):
        manifests.verify(spark, suite(spark), path)
    said = manifests.freeze(spark, suite(spark), path, HALF, salt="s", name="toy")
    assert said["counts"] == {"train": 25, "unassigned": 25} and said["ratios"] == {"train": 0.5, "held_out": 0.5, "transfer": 0.0}
    assert manifests.freeze(spark, suite(spark).orderBy(F.desc("hash")).repartition(7), path, HALF, salt="s") == said
    assert manifests.verify(spark, suite(spark), path).isEmpty()
    assert [tuple(r) for r in manifests.verify(spark, suite(spark, changed=(7,)), path).collect()] == [("t7", "changed_hash")]
    for other in (suite(spark, changed=(7,)), suite(spark, 49), suite(spark).withColumn("split", F.lit("train"))):
        with pytest.raises(manifests.FrozenSplitError):
            manifests.freeze(spark, other, path, HALF, salt="s")
    assert manifests.frozen(spark, path) == said and manifests.frozen_tasks(spark, path).count() == 50
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["frozen"]


def test_a_crash_before_publishing_leaves_the_old(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    publish = manifests._publish
    monkeypatch.setattr(manifests, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        manifests.freeze(spark, suite(spark), path, HALF, salt="s")
    assert manifests.frozen(spark, path) is None
    monkeypatch.setattr(manifests, "_publish", publish)
    manifests.freeze(spark, suite(spark, 10), path, HALF, salt="s")
    assert manifests.frozen_tasks(spark, path).count() == 10


def test_of_two_at_once_one_wins(spark, tmp_path):
    path, outcomes = str(tmp_path / "m"), []

    def go(n):
        try:
            outcomes.append(manifests.freeze(spark, suite(spark, n), path, HALF, salt="s")["suite_hash"])
        except manifests.FrozenSplitError:
            outcomes.append("refused")

    threads = [threading.Thread(target=go, args=(n,)) for n in (20, 21, 20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    said = manifests.frozen(spark, path)
    won = manifests.frozen_tasks(spark, path)
    assert manifests.content_digest(won) == said["suite_hash"] and len(outcomes) == 3
    assert set(outcomes) <= {"refused", said["suite_hash"]} and outcomes.count("refused") == (1 if won.count() == 20 else 2)


def test_shares_are_checked(spark):
    for bad in ((0.5, 0.9, 0.0), (1.2, -0.2, 0.0), (0.5, 0.4, 0.0)):
        with pytest.raises(ValueError):
            manifests.SplitRatios(*bad)
    manifests.SplitRatios(0.6, 0.2, 0.2)
    with pytest.raises(ValueError):
        selection.assign_splits(suite(spark), F.lit(0.5), train=0.7, held_out=0.5)


def test_tree_of_any_depth(spark):
    charges = [("a/b/c/d/e", 1, 10), ("a/b/c/d/e", 2, 0), ("a/b/x", 3, 1), ("a", 4, 4), ("a/b/c", 5, 5), ('q"/\\z', 6, 6), ("a/bb", 7, 7)]
    trees = budget.snapshot_tree(budget.ledger(spark.createDataFrame(charges, "path string, calls long, tokens long")))
    got = {r.account: json.loads(r.t) for r in trees.select("account", F.to_json("tree").alias("t")).collect()}

    def tree(path):
        below = [c for c in charges if c[0] == path or c[0].startswith(path + "/")]
        kids = sorted({"/".join(c[0].split("/")[: path.count("/") + 2]) for c in below} - {path})
        return {"label": path.split("/")[-1], "calls": sum(c[1] for c in below), "tokens": sum(c[2] for c in below), "children": [tree(k) for k in kids]}

    assert got == {"a": tree("a"), 'q"': tree('q"')}
    deep = trees.select(F.expr("variant_get(tree, '$.children[0].children[0].children[0].children[0].calls', 'long')").alias("x"), "account").where("account = 'a'").first()
    assert deep.x == 3
    assert budget.snapshot_tree(budget.ledger(spark.createDataFrame([], "path string, calls long, tokens long"))).count() == 0


def test_draws_depend_on_the_node_alone(spark):
    rows = [(f"n{i}", 1.0 + i % 5, 2.0 + i % 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, alpha double, beta double")
    whole = {r.id: (r.theta, r.chosen) for r in compare.thompson_draw(df, "id").collect()}
    some = {r.id: r.theta for r in compare.thompson_draw(df.where("id < 'n2'").repartition(5), "id").collect()}
    assert all(whole[k][0] == v for k, v in some.items())
    best = max(whole, key=lambda k: whole[k][0])
    assert [k for k, (_, c) in whole.items() if c] == [best]
    assert {r.id for r in compare.thompson_draw(df, "id", seed=1).where("theta > 0.9").collect()} != {k for k, (t, _) in whole.items() if t > 0.9}
    for a, b in {(r[1], r[2]) for r in rows}:
        mine = [whole[r[0]][0] for r in rows if (r[1], r[2]) == (a, b)]
        assert abs(sum(mine) / len(mine) - a / (a + b)) < 4 * (a * b / ((a + b) ** 2 * (a + b + 1)) / len(mine)) ** 0.5
