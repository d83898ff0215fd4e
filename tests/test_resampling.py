"""Resampling by sums: exact draws, buckets that need no exchange, intervals against plain resampling."""

import numpy as np
import pytest

from solvefront.functions import resampling as rs


def test_draws_of_all_buckets_sum_to_n():
    counts = [5, 0, 40, 1, 17, 900, 3]
    taken = np.stack([rs.draws_of_bucket(counts, k, 4000, "g", 3) for k in range(len(counts))])
    assert (taken.sum(0) == sum(counts)).all() and (taken[1] == 0).all()
    share = np.array(counts) / sum(counts)
    spread = np.sqrt(sum(counts) * share * (1 - share) / 4000)
    assert (abs(taken.mean(1) - sum(counts) * share) <= 5 * spread + 1e-9).all()
    assert (taken[0] == rs.draws_of_bucket(counts, 0, 4000, "g", 3)).all() and (taken[5] != rs.draws_of_bucket(counts, 5, 4000, "h", 3)).any()


def test_indices_are_uniform_and_independent():
    b, j = np.repeat(np.arange(1000), 100), np.tile(np.arange(100), 1000)
    at = rs.indices(b, j, 50, 12345)
    assert at.min() >= 0 and at.max() < 50
    chi = ((np.bincount(at, minlength=50) - 2000) ** 2 / 2000).sum()
    assert 20 < chi < 95  # 49 degrees of freedom
    pairs = ((np.bincount(at[:-1] * 50 + at[1:], minlength=2500) - 40) ** 2 / 40).sum()
    assert 2150 < pairs < 2900
    once = np.array([len(set(at[k * 100 : k * 100 + 100].tolist())) for k in range(1000)])
    assert abs(once.mean() - 50 * (1 - 0.98**100)) < 0.3


def test_sums_are_those_of_the_drawn_rows(monkeypatch):
    values, taken = np.random.default_rng(0).random((30, 2)), np.array([30, 0, 12, 55, 1])
    plain = np.array([[values[rs.indices(np.full(m, b), np.arange(m), 30, 9)][:, c].sum() for c in (0, 1)] for b, m in enumerate(taken)])
    for at_once in (1 << 20, 40, 7):
        monkeypatch.setattr(rs, "DRAWS", at_once)
        assert np.allclose(rs.resampled_sums(values, taken, 9), plain)


@pytest.mark.parametrize("bucket_rows", [1 << 16, 25, 3])
def test_intervals(spark, bucket_rows):
    """Whatever the number of buckets: near the normal interval of the mean, every resample of the group's size."""
    rng = np.random.default_rng(2)
    rows = [("a", i, float(v)) for i, v in enumerate(rng.random(400))] + [(None, i, 7.0) for i in range(9)] + [("a", 999, None), ("gone", 1, None)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    got = {r.g: r for r in rs.bootstrap_sums(df, "g", ["v"], "i", resamples=2000, bucket_rows=bucket_rows).collect()}
    v = np.array([r[2] for r in rows[:400]])
    assert set(got) == {"a", None} and got["a"].draws == 400 and got["a"].point == pytest.approx(v.mean())
    half = 1.96 * v.std() / 20
    assert got["a"].low == pytest.approx(v.mean() - half, abs=0.15 * half) and got["a"].high == pytest.approx(v.mean() + half, abs=0.15 * half)
    assert (got[None].low, got[None].high, got[None].draws) == (7.0, 7.0, 9)
    again = {r.g: r for r in rs.bootstrap_sums(df.repartition(7), "g", ["v"], "i", resamples=2000, bucket_rows=bucket_rows).collect()}
    assert again == got


def test_other_statistics(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(5, 2, 500)
    df = spark.createDataFrame([("a", i, float(v), float(v * v)) for i, v in enumerate(x)], "g string, i long, v double, vv double")
    variance = lambda s, n: s[:, 1] / n - (s[:, 0] / n) ** 2
    r = rs.bootstrap_sums(df, "g", ["v", "vv"], "i", statistic=variance, resamples=1000, bucket_rows=100).first()
    assert r.point == pytest.approx(x.var()) and r.low < x.var() < r.high and r.high - r.low == pytest.approx(3.92 * x.var() * (2 / 500) ** 0.5, rel=0.25)
    point, low, high = df.groupBy("g").agg(rs.bootstrap_udaf(np.median, resamples=300)("v").alias("m")).first().m
    assert point == pytest.approx(np.median(x)) and low < point < high
    with pytest.raises(ValueError):
        rs.bootstrap_sums(df, "g", ["v"], "i", confidence=1.0)


def test_no_row_is_copied(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "g string, i long, v double")
    plan = rs.bootstrap_sums(df, "g", ["v"], "i")._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Explode" not in plan
    assert rs.bootstrap_sums(df.where("false"), "g", ["v"], "i").count() == 0
