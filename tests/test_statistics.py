"""Golden values and invariants of the numeric core."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from solvefront.functions import statistics as st
from solvefront.operators import frontier as fr


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def L(x):  # noqa: N802
    return F.lit(x).cast("bigint")


@pytest.mark.parametrize("a,b,x,v", [(2, 3, 0.5, 0.6875), (1, 1, 0.5, 0.5), (2, 2, 0.3, 0.216), (5, 5, 0.5, 0.5)])
def test_incomplete_beta(a, b, x, v):
    assert st.incomplete_beta(a, b, x) == pytest.approx(v, abs=1e-12)


@pytest.mark.parametrize("c,n,low,high", [(2, 10, 0.0252107, 0.5560955), (0, 10, 0, 0.3084971), (5, 10, 0.1870860, 0.8129140), (10, 10, 0.6915029, 1), (1, 100, 0.0002531, 0.0544594)])
def test_clopper_pearson(c, n, low, high):
    _, lo, hi = st.clopper_pearson_arrays([c], [n])
    assert lo[0] == pytest.approx(low, abs=5e-6) and hi[0] == pytest.approx(high, abs=5e-6)


def test_clopper_pearson_edges():
    point, low, high = st.clopper_pearson_arrays([0], [0])
    assert math.isnan(point[0]) and (low[0], high[0]) == (0, 1)
    with pytest.raises(ValueError):
        st.clopper_pearson_arrays([3], [2])


@settings(max_examples=50, deadline=None)
@given(hs.integers(1, 300), hs.data())
def test_interval_contains_rate(n, data):
    c = data.draw(hs.integers(0, n))
    p, low, high = st.clopper_pearson_arrays([c], [n])
    assert low[0] <= p[0] <= high[0]
    assert low[0] == 0 or st.incomplete_beta(c, n - c + 1, low[0]) == pytest.approx(0.025, abs=1e-9)


@pytest.mark.parametrize("n,c,k,v", [(10, 5, 1, 0.5), (10, 5, 10, 1), (10, 2, 2, 1 - 28 / 45), (1000, 137, 1, 0.137), (10000, 1, 10000, 1), (100, 0, 7, 0)])
def test_pass_at_k(spark, n, c, k, v):
    assert value(spark, st.pass_at_k(L(n), L(c), L(k))) == pytest.approx(v, abs=1e-12)


@pytest.mark.parametrize("n,c,k", [(10, 5, 0), (10, 5, 11), (5, 6, 1)])
def test_pass_at_k_domain(spark, n, c, k):
    with pytest.raises(Exception, match="pass@k"):
        value(spark, st.pass_at_k(L(n), L(c), L(k)))


@pytest.mark.parametrize("k,n,p,v", [(0, 6, 0.05, 1), (7, 6, 0.05, 0), (1, 6, 0.05, 1 - 0.95**6)])
def test_binomial_tail(spark, k, n, p, v):
    assert value(spark, st.binomial_tail(L(k), L(n), F.lit(p))) == pytest.approx(v, abs=1e-9)


def test_normal_quantile(spark):
    assert value(spark, st.normal_quantile(F.lit(0.975))) == pytest.approx(1.959964, abs=1e-6)
    assert value(spark, st.normal_quantile(F.lit(0.001))) == pytest.approx(-3.090232, abs=1e-5)
    assert value(spark, st.normal_quantile(F.lit(1.5))) is None


def test_zero_bounds(spark):
    for n in (10, 100, 1000):
        assert value(spark, st.zero_success_bound(L(n))) == pytest.approx(st.clopper_pearson_arrays([0], [n], 0.9)[2][0], abs=1e-9)
    assert value(spark, st.rule_of_three(L(0))) == 1 and value(spark, st.rule_of_three(L(2))) == 1


def diversity(spark, counts, **options):
    rows = [("t", str(i), n) for i, n in enumerate(counts)]
    df = spark.createDataFrame(rows, "task_id string, species string, n bigint")
    return fr.diversity(df, ["task_id"], **options).first()


def test_diversity(spark):
    r = diversity(spark, [1, 1, 1, 2, 5])
    assert r.unseen_mass == pytest.approx(0.3) and r.coverage == pytest.approx(0.7) and not r.saturated
    assert r.chao1.estimate == pytest.approx(6.5) and r.chao1.low >= 5
    assert diversity(spark, [1, 1, 1, 2, 5], bias_corrected=False).chao1.estimate == pytest.approx(9.5)
    assert diversity(spark, [1, 1, 3], bias_corrected=False).chao1.estimate == diversity(spark, [1, 1, 3]).chao1.estimate
    assert diversity(spark, [10, 10, 10]).chao1.estimate == 3
    assert diversity(spark, [1] * 10).unseen_mass == 1
    assert diversity(spark, [5, 7]).saturated
    assert diversity(spark, []) is None


def test_rarefaction(spark):
    df = spark.createDataFrame([("t", str(i), n) for i, n in enumerate([1, 1, 1, 2, 5])], "task_id string, species string, n bigint")
    got = {r.m: r.expected for r in fr.rarefaction(df, ["task_id"], [1, 2, 5, 10, 20]).collect()}
    assert got[1] == pytest.approx(1) and got[10] == 5 and 20 not in got and got[1] < got[2] < got[5]


def test_empty_diversity_is_null(spark):
    attempts = spark.createDataFrame([("a", False, "x"), ("b", True, "x")], "task_id string, passed boolean, species string")
    got = {r.task_id: r for r in fr.frontier_records(attempts).collect()}
    assert got["a"].unseen_mass is None and got["a"].chao1 is None and got["a"].beyond_frontier and got["a"].n_distinct == 0
    assert got["b"].ci_high == 1 and "95%" in got["a"].qualifier


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.20, 0.15, 0.09, 0.001, 0.30, 0.02]
    rows = st.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p_value double")).collect()
    assert {r.i for r in rows if r.reject} == {0, 3, 7, 9}
    q = {r.i: r.q_value for r in rows}
    expected = {0: 0.0333, 1: 0.0667, 2: 0.06, 3: 0.025, 4: 0.2222, 5: 0.1875, 6: 0.1286, 7: 0.01, 8: 0.30, 9: 0.05}
    assert all(q[i] == pytest.approx(v, abs=1e-4) for i, v in expected.items())


@pytest.mark.parametrize("t,v", [((0, 59, 2, 57), 0.495726), ((0, 59, 4, 55), 0.118618), ((0, 59, 59, 0), 8.2113e-35), ((0, 5, 0, 5), 1)])
def test_fisher(spark, t, v):
    assert value(spark, st.fisher_exact(*map(L, t))) == pytest.approx(v, rel=1e-4)


def test_fisher_absolute_tolerance(spark):
    assert value(spark, st.fisher_exact(*map(L, (0, 59, 59, 0)), absolute_tolerance=True)) == pytest.approx(3.3751e-13, rel=1e-3)


def test_fisher_matches_the_whole_support():
    rng = np.random.default_rng(5)
    tables = rng.integers(0, 40, (200, 4)).tolist() + [[0, 0, 0, 0], [3, 0, 0, 0], [0, 9, 0, 4], [500, 480, 20, 30], [7, 7, 7, 7]]
    got = st.fisher_arrays(*np.array(tables).T)
    for (a, b, c, d), p in zip(tables, got, strict=True):
        ways = [math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
        seen = math.comb(a + b, a) * math.comb(c + d, c)
        assert p == pytest.approx(sum(w for w in ways if w <= seen * (1 + 1e-9)) / sum(ways), rel=1e-9)
    assert np.isnan(st.fisher_arrays([np.nan], [1], [1], [1])[0])
    assert 0 < st.fisher_arrays([500_000], [500_000], [501_000], [499_000])[0] < 1  # wide support, short tails
    with pytest.raises(ValueError):
        st.fisher_arrays([-1], [1], [1], [1])


def test_benjamini_hochberg_families_ties_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(f if f else None, None if k % 9 == 0 else float(np.round(rng.random() ** 3, 2))) for f in ("", "a", "b") for k in range(60)]
    got = st.benjamini_hochberg(spark.createDataFrame(rows, "family string, p double"), "p", by=["family"]).collect()
    assert len(got) == len(rows)
    for f in (None, "a", "b"):
        ps = sorted(p for g, p in rows if g == f and p is not None)
        m = len(ps)
        top = max((p for k, p in enumerate(ps, 1) if p <= k / m * 0.05), default=-1)
        for r in got:
            if r.family == f:
                assert r.reject == (r.p is not None and r.p <= top)
                q = None if r.p is None else min(1, min(p * m / k for k, p in enumerate(ps, 1) if p >= r.p))
                assert r.q_value == (None if q is None else pytest.approx(q))
    assert st.benjamini_hochberg(spark.createDataFrame([], "p double"), "p").count() == 0


def test_log_factorial(spark):
    for n in (0, 1, 5, 170, 100000):
        assert value(spark, st.log_factorial(L(n))) == pytest.approx(math.lgamma(n + 1), rel=1e-10, abs=1e-10)


def test_bootstrap_repeats():
    values = list(np.linspace(0, 1, 20))
    assert st.bootstrap_interval(values, resamples=200) == st.bootstrap_interval(values, resamples=200)
    with pytest.raises(ValueError):
        st.bootstrap_interval([])


def test_bootstrap_draws_as_arrays_what_randrange_draws(monkeypatch):
    """The interval is the plain loop's to the last bit, and no number is drawn by a call of its own."""
    def plain(values, stat, resamples, seed):
        draw, n = random.Random(seed).randrange, len(values)
        found = sorted(stat([values[draw(n)] for _ in range(n)]) for _ in range(resamples))
        return stat(values), found[max(0, int((1 - 0.95) / 2 * resamples))], found[min(resamples - 1, int((1 - (1 - 0.95) / 2) * resamples) - 1)]

    mean, rng = (lambda xs: sum(xs) / len(xs)), np.random.default_rng(1)
    cases = [(v, stat, resamples, seed) for n, resamples in ((1, 40), (2, 300), (7, 900), (1000, 80), (70_000, 5)) for seed in (0, 5) for v, stat in (
        ((rng.integers(0, 9, n) / 9).tolist(), None), (rng.normal(0, 1e6, n).tolist(), None), (rng.integers(0, 9, n).tolist(), None), ([0.1] * n, None),
        ([float("inf")] + [1.0] * (n - 1), None), ([(k, 1) for k in range(n)], max), ([1e308] * n, None),
    )]
    expected = [plain(v, stat or mean, resamples, seed) for v, stat, resamples, seed in cases]
    monkeypatch.setattr(random.Random, "randrange", None)
    for (v, stat, resamples, seed), e in zip(cases, expected, strict=True):
        assert st.bootstrap_interval(v, stat, resamples=resamples, seed=seed) == e
