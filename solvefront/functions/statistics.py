"""Statistical functions as Column expressions; the two that have no closed form as Arrow-batched UDFs."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sampling budgets at which curves are reported.
BUDGET_GRID = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000)

# Lanczos coefficients, g = 7, nine terms.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0."""
    x = n.cast("double")
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (x + F.lit(float(i)))
    t = x + F.lit(7.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + F.lit(0.5)) * F.log(t) - t + F.log(total)


def log_binomial(n: Column, k: Column) -> Column:
    """ln C(n, k); null outside 0 <= k <= n."""
    return F.when((k >= 0) & (k <= n), log_factorial(n) - log_factorial(k) - log_factorial(n - k))


def require(df: DataFrame, holds: Column, message: Column) -> DataFrame:
    """The rows, failing where ``holds`` is not true: a filter, so that no choice of columns prunes it."""
    return df.where(F.when(holds, F.lit(True)).otherwise(F.raise_error(message)))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k), as a product of min(k, c) factors; 1 where fewer than k attempts fail."""
    n, c, k = (x.cast("bigint") for x in (n, c, k))
    product = lambda first, last, by: F.aggregate(F.sequence(first, last), F.lit(1.0), lambda a, i: a * (F.lit(1.0) - by / i.cast("double")))
    missed = F.when(c <= k, product(n - c + 1, n, k)).otherwise(product(n - k + 1, n, c))
    legal = (k >= 1) & (k <= n) & (c >= 0) & (c <= n)
    return F.when(~legal, F.raise_error(F.lit("pass@k needs 1 <= k <= n and 0 <= c <= n"))).when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - missed)


def budgets(n: Column, grid: Sequence[int] = BUDGET_GRID) -> Column:
    """The grid's budgets up to n, and n itself."""
    ks = F.filter(F.array(*[F.lit(int(k)).cast("bigint") for k in grid]), lambda k: (k > 0) & (k <= n))
    return F.when(n > 0, F.array_union(ks, F.array(n.cast("bigint")))).otherwise(ks)


def pass_curve(n: Column, c: Column, grid: Sequence[int] = BUDGET_GRID, *, own: bool = False) -> Column:
    """map<budget, pass@budget>; budgets above n are left out; with ``own`` n itself is always one."""
    ks = budgets(n, grid) if own else F.filter(F.array(*[F.lit(k) for k in grid]), lambda k: k <= n)
    return F.map_from_arrays(ks, F.transform(ks, lambda k: pass_at_k(n, c, k)))


def rule_of_three(n: Column) -> Column:
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(3.0) / n))


def zero_success_bound(n: Column, confidence: float = 0.95) -> Column:
    """One-sided exact upper bound on the rate after n failures."""
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.pow(F.lit(1 - confidence), F.lit(1.0) / n))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Bin(n, p): the incomplete beta function at p, whatever the size of n."""
    one = F.lit(1.0)
    inner = incomplete_beta_udf()(F.greatest(k.cast("double"), one), F.greatest((n - k + 1).cast("double"), one), p.cast("double"))
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).when(p <= 0, F.lit(0.0)).when(p >= 1, F.lit(1.0)).otherwise(inner)


# Rational approximation of the normal quantile (Acklam).
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function; null outside (0, 1)."""
    low, q = 0.02425, p - F.lit(0.5)
    tail = lambda x: _horner(F.sqrt(F.lit(-2.0) * F.log(x)), ACKLAM_C) / _horner(F.sqrt(F.lit(-2.0) * F.log(x)), (*ACKLAM_D, 1.0))
    middle = _horner(q * q, ACKLAM_A) * q / _horner(q * q, (*ACKLAM_B, 1.0))
    return F.when((p > 0) & (p < low), tail(p)).when((p >= low) & (p <= 1 - low), middle).when((p > 1 - low) & (p < 1), -tail(F.lit(1.0) - p))


def good_turing_unseen(f1: Column, n: Column) -> Column:
    """f1 / N; null (no information) on an empty sample."""
    return F.when(n > 0, f1 / n)


def chao1(observed: Column, f1: Column, f2: Column, *, bias_corrected: bool = True, z: float = 1.959963984540054) -> Column:
    """struct(estimate, variance, low, high); null where nothing was observed.

    Classic where asked for and f2 > 0, else bias-corrected.  The interval is
    log-normal on the unseen part and never below the observed count.
    """
    s, a, b = (x.cast("double") for x in (observed, f1, f2))
    corrected = s + a * (a - 1) / (2 * (b + 1))
    v_corrected = a * (a - 1) / (2 * (b + 1)) + a * (2 * a - 1) * (2 * a - 1) / (4 * (b + 1) * (b + 1)) + a * a * b * (a - 1) * (a - 1) / (4 * F.pow(b + 1, F.lit(4.0)))
    r = F.try_divide(a, b)
    classic, v_classic = s + a * a / (2 * F.when(b > 0, b)), b * (F.lit(0.5) * r * r + r * r * r + F.lit(0.25) * r * r * r * r)
    use_classic = (b > 0) if not bias_corrected else F.lit(False)
    estimate = F.when(use_classic, classic).otherwise(corrected)
    variance = F.when(use_classic, v_classic).otherwise(v_corrected)
    unseen = estimate - s
    k = F.exp(F.lit(z) * F.sqrt(F.log1p(F.try_divide(variance, unseen * unseen))))
    spread = (unseen > 0) & (variance > 0)
    return F.when(observed > 0, F.struct(
        estimate.alias("estimate"), variance.alias("variance"),
        F.when(spread, s + unseen / k).otherwise(s).alias("low"), F.when(spread, s + unseen * k).otherwise(s).alias("high")))


def rarefaction_term(n: Column, count: Column, m: Column) -> Column:
    """One species' share of the expected number of species in m of n draws."""
    ratio = log_factorial(n - count) - log_factorial(n - count - m) - (log_factorial(n) - log_factorial(n - m))  # m! cancels
    gone = F.when(n - count >= m, F.exp(ratio)).otherwise(F.lit(0.0))
    return F.when((m <= 0) | (n <= 0), F.lit(0.0)).when(m >= n, F.lit(1.0)).otherwise(F.lit(1.0) - gone)


# --- incomplete beta and its inverse: vectorised over an Arrow batch -----------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def log_beta(a, b) -> np.ndarray:
    return _log_gamma(a) + _log_gamma(b) - _log_gamma(np.add(a, b))


def incomplete_beta(a, b, x, known_log_beta: np.ndarray | None = None) -> np.ndarray:
    """Regularised incomplete beta function by the modified Lentz continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    scale = log_beta(a, b) if known_log_beta is None else known_log_beta
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - scale) / p
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(y), 1 / keep(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for numerator in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / keep(1 + numerator * d), keep(1 + numerator / c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    value = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.clip(np.where(flip, 1 - value, value), 0, 1)


def inverse_incomplete_beta(a, b, p) -> np.ndarray:
    """x with I_x(a, b) = p, by bisection."""
    a, b, p = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, p)))
    low, high, scale = np.zeros(a.shape), np.ones(a.shape), log_beta(a, b)
    for _ in range(60):
        mid = (low + high) / 2
        below = incomplete_beta(a, b, mid, scale) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def clopper_pearson_arrays(c, n, confidence: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, low, high); no trials: (NaN, 0, 1); impossible counts raise."""
    c, n = np.asarray(c, float), np.asarray(n, float)
    if np.any((c < 0) | (n < 0) | (c > n)):
        raise ValueError("successes must lie in 0..trials")
    half = (1 - confidence) / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        point = np.where(n > 0, c / n, np.nan)
    inner_low, inner_high = (n > 0) & (c > 0), (n > 0) & (c < n)
    low, high = np.zeros(c.shape), np.ones(c.shape)
    low[inner_low] = inverse_incomplete_beta(c[inner_low], (n - c + 1)[inner_low], half)
    high[inner_high] = inverse_incomplete_beta((c + 1)[inner_high], (n - c)[inner_high], 1 - half)
    return point, low, high


def clopper_pearson_udf(confidence: float = 0.95):
    @F.pandas_udf("struct<point double, low double, high double>")
    def interval(c: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("point", "low", "high"), clopper_pearson_arrays(c.to_numpy(), n.to_numpy(), confidence), strict=True)))

    return interval


def incomplete_beta_udf():
    @F.pandas_udf("double")
    def value(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(incomplete_beta(a.to_numpy(), b.to_numpy(), x.to_numpy()))

    return value


def inverse_incomplete_beta_udf():
    @F.pandas_udf("double")
    def value(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(inverse_incomplete_beta(a.to_numpy(), b.to_numpy(), p.to_numpy()))

    return value


def with_clopper_pearson(df: DataFrame, c: str, n: str, prefix: str = "ci", confidence: float = 0.95) -> DataFrame:
    """Add <prefix>_point, _low and _high.  The interval is computed once per distinct (c, n) and joined back."""
    pairs = df.select(F.col(c).alias("_c"), F.col(n).alias("_n")).distinct()
    found = pairs.withColumn("_ci", clopper_pearson_udf(confidence)("_c", "_n"))
    joined = df.join(found, (F.col(c) == F.col("_c")) & (F.col(n) == F.col("_n")), "left")
    return joined.select(*[df[x] for x in df.columns], *[F.col(f"_ci.{x}").alias(f"{prefix}_{x}") for x in ("point", "low", "high")])


# --- multiple testing, exact tests, bootstrap ----------------------------------------------------------------


def benjamini_hochberg(df: DataFrame, p: str = "p_value", alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Add reject and q_value per group of ``by`` (none: one family of hypotheses).

    Equal p-values share the last of their ranks.  Ranks come from counts per
    distinct p in buckets of its logarithm: the only window over a whole
    family has a row per bucket, some 70,000 at most.  A null p is no
    hypothesis: it does not count, and has reject false and a null q.
    """
    g = [f"_g{k}" for k in range(len(by))]
    each = df.where(F.col(p).isNotNull()).groupBy(*[F.col(c).alias(n) for c, n in zip(by, g, strict=True)], F.col(p).cast("double").alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    bucket = F.when(F.col("_p") > 0, F.floor(F.log2("_p") * 64)).otherwise(F.lit(-(1 << 17)))
    each = each.withColumn("_b", bucket)
    inner, family = W.partitionBy(*g, "_b").orderBy("_p"), W.partitionBy(*g)
    before = family.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = each.groupBy(*g, "_b").agg(F.sum("_k").alias("_n"))
    starts = sums.select(*g, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(family).alias("_m"))
    ranked = _join_null_safe(each, starts, [*g, "_b"]).withColumn("_r", F.col("_start") + F.sum("_k").over(inner))
    ranked = ranked.withColumn("_v", F.col("_p") * F.col("_m") / F.col("_r")).withColumn("_ok", F.col("_p") <= F.col("_r") / F.col("_m") * F.lit(alpha))
    after = family.orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    ends = ranked.groupBy(*g, "_b").agg(F.min("_v").alias("_low"), F.max(F.when(F.col("_ok"), F.col("_p"))).alias("_top"))
    ends = ends.select(*g, "_b", F.min("_low").over(after).alias("_later"), F.max("_top").over(family).alias("_top"))
    here = F.min("_v").over(inner.rowsBetween(W.currentRow, W.unboundedFollowing))
    found = _join_null_safe(ranked, ends, [*g, "_b"]).withColumn("q_value", F.least(F.lit(1.0), here, F.col("_later")))
    found = found.select(*g, "_p", F.coalesce(F.col("_p") <= F.col("_top"), F.lit(False)).alias("reject"), "q_value")
    same = F.col(p).cast("double") == F.col("_p")
    for c, n in zip(by, g, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return df.join(found, same, "left").drop(*g, "_p").withColumn("reject", F.coalesce("reject", F.lit(False)))


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which null keys meet; the keys stay once."""
    other = right.withColumnsRenamed({c: f"{c}_right" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_right"))
    return left.join(other, same).drop(*[f"{c}_right" for c in on])


def fisher_arrays(a, b, c, d, absolute_tolerance: bool = False) -> np.ndarray:
    """Two-sided exact tests of 2x2 tables.

    The tables with the seen margins rise in probability up to the mode and
    fall after it, so those no likelier than the one seen are two tails.  Each
    tail's first table is found by halving, and its sum by the ratio of
    neighbours, which ends where terms no longer matter.
    """
    a, b, c, d = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, c, d)))
    known = ~(np.isnan(a) | np.isnan(b) | np.isnan(c) | np.isnan(d))
    if np.any(known & (np.minimum(np.minimum(a, b), np.minimum(c, d)) < 0)):
        raise ValueError("counts must not be negative")
    row, col, total = a + b, a + c, a + b + c + d
    out = np.where(known, 1.0, np.nan)
    use = known & (row > 0) & (row < total) & (col > 0) & (col < total)  # an empty margin gives 1
    if not use.any():
        return out
    a, row, col, total = a[use], row[use], col[use], total[use]
    rest = total - row
    fixed = sum(_log_gamma(v + 1) for v in (row, rest, col, total - col)) - _log_gamma(total + 1)
    log_p = lambda x: fixed - sum(_log_gamma(v + 1) for v in (x, row - x, col - x, rest - col + x))
    low, high = np.maximum(0, row + col - total), np.minimum(row, col)
    mode = np.clip(np.floor((row + 1) * (col + 1) / (total + 2)), low, high)
    seen = log_p(a)
    limit = np.log(np.exp(seen) + 1e-12) if absolute_tolerance else seen + 1e-9
    summed = np.zeros(a.shape)
    for end, sign in ((low, -1), (high, 1)):
        near, far = mode.copy(), end + sign  # near: likelier than the limit, far: not (or beyond the end)
        while np.any(np.abs(far - near) > 1):
            wide = np.abs(far - near) > 1
            mid = np.where(wide, np.trunc((near + far) / 2), near)
            small = wide & (log_p(mid) <= limit)
            near, far = np.where(wide & ~small, mid, near), np.where(small, mid, far)
        x, inside = np.clip(far, low, high), (far >= low) & (far <= high)
        term = np.where(inside, np.exp(log_p(x)), 0.0)
        tail = term.copy()
        while np.any(term > tail * 1e-17):
            up = (row - x) * (col - x) / ((x + 1) * (rest - col + x + 1)) if sign > 0 else x * (rest - col + x) / ((row - x + 1) * (col - x + 1))
            term = term * np.maximum(up, 0.0)
            tail, x = tail + term, np.clip(x + sign, low, high)
        summed += tail
    out[use] = np.where(log_p(mode) <= limit, 1.0, np.minimum(1.0, summed))
    return out


def fisher_exact(a: Column, b: Column, c: Column, d: Column, *, absolute_tolerance: bool = False) -> Column:
    """Two-sided exact test of a 2x2 table; an empty margin gives 1, an unknown count null.

    Tables no likelier than the one seen are summed, with a relative tolerance
    of 1e-9; ``absolute_tolerance`` sums those within an absolute 1e-12
    instead, which inflates very small values.
    """
    @F.pandas_udf("double")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(fisher_arrays(*(v.to_numpy(float, na_value=np.nan) for v in (a, b, c, d)), absolute_tolerance))

    return test(a, b, c, d)


class TwisterDraws:
    """What ``random.Random(seed).randrange(n)`` gives call by call, as arrays: the same Mersenne Twister, the same rejection."""

    CHUNK = 1 << 16

    def __init__(self, seed: int, n: int):
        *key, place = random.Random(seed).getstate()[1]
        self.twister = np.random.MT19937()
        self.numbers = np.random.Generator(self.twister)
        self.n, self.shift = n, np.uint32(32 - n.bit_length())
        self.go_to((np.array(key, np.uint32), place, 0))

    def go_to(self, mark: tuple[np.ndarray, int, int]) -> None:
        key, place, used = mark
        self.twister.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": place}}
        self._draw()
        self.used = used

    def _draw(self) -> None:
        before = self.twister.state["state"]
        self.before = before["key"].copy(), before["pos"]
        raw = self.numbers.integers(0, 1 << 32, self.CHUNK, np.uint32) >> self.shift
        self.ready, self.used = raw[raw < self.n], 0

    def mark(self) -> tuple[np.ndarray, int, int]:
        """Where the next draw is, for ``go_to``."""
        return (*self.before, self.used)

    def take(self, count: int) -> Iterator[np.ndarray]:
        """The next ``count`` draws, in pieces."""
        while count:
            if self.used == len(self.ready):
                self._draw()
            piece = self.ready[self.used : self.used + count]
            self.used += len(piece)
            count -= len(piece)
            yield piece


def bootstrap_interval(values: Sequence[float], statistic: Callable | None = None, *, resamples: int = 10_000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """Percentile bootstrap of one bounded group: order statistics at truncated places, Mersenne Twister indices.

    Means are first summed as arrays, which is off by rounding alone.  The two
    resamples that are asked for are then found among those within that of
    their places, whose draws are taken again and summed as a list.
    """
    if not len(values):
        raise ValueError("no values to resample")
    stat = statistic or (lambda xs: sum(xs) / len(xs))
    n, half = len(values), (1 - confidence) / 2
    places = max(0, int(half * resamples)), min(resamples - 1, int((1 - half) * resamples) - 1)
    draws = TwisterDraws(seed, n)
    listed = np.empty(n, object)
    for i, v in enumerate(values):
        listed[i] = v
    exact = lambda: stat([x for piece in draws.take(n) for x in listed[piece].tolist()])
    array = np.array(values) if statistic is None else listed
    if array.dtype != np.float64 or not (np.abs(array) < np.finfo(float).max / n).all():
        found = sorted(exact() for _ in range(resamples))
        return stat(values), found[places[0]], found[places[1]]
    marks, near = [], np.empty(resamples)
    for b in range(resamples):
        marks.append(draws.mark())
        near[b] = sum(float(array[piece].sum()) for piece in draws.take(n)) / n
    # Beyond what either sum of n numbers can be off, the list's and the array's.
    off = 2 * (n + 64) * np.finfo(float).eps * float(np.abs(array).max())
    ranked, ends = np.sort(near), []
    for place in places:
        below, close = int((near < ranked[place] - 2 * off).sum()), np.flatnonzero(np.abs(near - ranked[place]) <= 2 * off)
        again = []
        for b in close:
            draws.go_to(marks[b])
            again.append(exact())
        ends.append(sorted(again)[place - below])
    return stat(values), ends[0], ends[1]


def bootstrap_by_group(df: DataFrame, by: str, value: str, **options) -> DataFrame:
    """The interval per group, one group a task: for groups that fit one (a metric per task, not raw rows)."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        point, low, high = bootstrap_interval(pdf.sort_values(value)[value].tolist(), **options)
        return pd.DataFrame({by: [key[0]], "point": [point], "low": [low], "high": [high]})

    return df.groupBy(by).applyInPandas(run, f"`{by}` {df.schema[by].dataType.simpleString()}, point double, low double, high double")


def bootstrap_hashed(df: DataFrame, by: str, value: str, *, resamples: int = 100, confidence: float = 0.95) -> DataFrame:
    """The same interval for the mean from Poisson(1) weights drawn by md5: no index into the group, so it sums per partition."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("_b"), F.col("_id")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    weight = sum((F.when(u >= F.lit(s), 1).otherwise(0) for s in steps), F.lit(0))
    spread = df.select(by, value, F.col("_id"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_b")).withColumn("_w", weight)
    means = spread.groupBy(by, "_b").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("_mean"))
    half = (1 - confidence) / 2
    low, high = max(0, int(half * resamples)) + 1, min(resamples - 1, int((1 - half) * resamples) - 1) + 1
    ranked = means.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy("_mean")))
    return ranked.groupBy(by).agg(F.min(F.when(F.col("_r") == low, F.col("_mean"))).alias("low"), F.min(F.when(F.col("_r") == high, F.col("_mean"))).alias("high"))
