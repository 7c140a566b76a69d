"""Tail probabilities against known values and exact counting."""
import math
from fractions import Fraction
from itertools import product

import pytest
from pyspark.sql import functions as F

from plumbline.functions import pvalues as P


def values(spark, rows, names, *exprs):
    """One tuple of expression values per row, in order."""
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], f"i long, {', '.join(n + ' double' for n in names)}")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_known_values(spark):
    # Published or closed-form values.
    got = values(spark, [(0,)], ["x"],
                 P.p_t_two_sided(F.lit(2.0), F.lit(10)), P.t_quantile(F.lit(4), 0.975), P.t_quantile(F.lit(1), 0.975), P.p_f(F.lit(3.0), F.lit(2), F.lit(20)), P.p_chi2(F.lit(7.0), F.lit(3)),
                 P.p_normal_upper(F.lit(1.96)), P.p_normal_lower(F.lit(1.96)), P.p_t_two_sided(F.lit(1.0), F.lit(1)), P.p_f(F.lit(1e-9), F.lit(1), F.lit(1)))[0]
    assert got == pytest.approx((2 * 0.03669401738537018, 2.7764451051977987, 12.706204736174698, 0.07253815028640571, 0.07189777249646505,
                                 0.024997895148220428, 0.9750021048517795, 0.5, 0.99997986), rel=1e-5)
    assert got[:6] == pytest.approx((2 * 0.03669401738537018, 2.7764451051977987, 12.706204736174698, 0.07253815028640571, 0.07189777249646505, 0.024997895148220428), rel=1e-9)


def test_normal_tail(spark):
    z = [-6, -1.5, -0.01, 0, 0.3, 1, 1.7, 1.74, 2, 5, 9, 30]
    got = values(spark, [(x,) for x in z], ["z"], P.p_normal_upper("z"))
    assert [g[0] for g in got] == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in z], rel=1e-9)


def test_log_gamma(spark):
    x = [0.5, 1, 1.5, 2, 7.25, 40, 1e3, 1e6, 1e9]
    got = values(spark, [(v,) for v in x], ["x"], P.log_gamma(F.col("x")))
    assert [g[0] for g in got] == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-10)


def test_beta_against_polynomials(spark):
    """Whole a and b: a binomial tail in exact arithmetic."""
    rows = [(a, b, x) for a in (1, 2, 7, 30) for b in (1, 3, 12) for x in (0.0, 0.02, 0.3, 0.5, 0.77, 0.99, 1.0)]
    got = values(spark, rows, ["a", "b", "x"], P.beta_inc(F.col("a"), F.col("b"), F.col("x")))
    exp = [float(sum(math.comb(a + b - 1, j) * Fraction(x) ** j * (1 - Fraction(x)) ** (a + b - 1 - j) for j in range(a, a + b))) for a, b, x in rows]
    assert [g[0] for g in got] == pytest.approx(exp, rel=1e-9, abs=1e-300)


def test_fair_tosses(spark):
    rows = [(k, n) for n in (0, 1, 7, 40) for k in range(0, n + 2, max(1, n // 9))] + [(520, 1000)]
    got = values(spark, rows, ["k", "n"], P.p_binom_greater("k", "n"), P.p_binom_two_sided("k", "n"))
    tail = lambda k, n: float(Fraction(sum(math.comb(n, j) for j in range(max(k, 0), n + 1)), 2**n))
    assert [g[0] for g in got] == pytest.approx([tail(k, n) for k, n in rows], rel=1e-8)
    assert [g[1] for g in got] == pytest.approx([min(1.0, 2 * tail(max(k, n - k), n)) if n else 1.0 for k, n in rows], rel=1e-8)
    # On both sides of the number of tosses from which the normal limit is taken.
    n = P.EXACT_BINOMIAL_N
    big = values(spark, [(k, m) for m in (n, n + 2) for k in (m // 2, m // 2 + 900)], ["k", "n"], P.p_binom_greater("k", "n"))
    normal = [0.5 * math.erfc((k - 0.5 - m / 2) / (math.sqrt(m) / 2) / math.sqrt(2)) for m in (n, n + 2) for k in (m // 2, m // 2 + 900)]
    assert [g[0] for g in big] == pytest.approx(normal, rel=1e-5)


def test_hypergeometric(spark):
    rows = [(h, n, a, k) for n, a, k in ((10, 4, 3), (10, 9, 8), (60, 20, 30), (5, 0, 2), (5, 5, 2)) for h in range(-1, k + 2)] + [(260, 2_000, 400, 1_200)]
    got = values(spark, rows, ["h", "n", "a", "k"], P.p_hypergeom("h", "n", "a", "k"))
    exp = [float(Fraction(sum(math.comb(a, i) * math.comb(n - a, k - i) for i in range(max(h, 0), min(a, k) + 1)), math.comb(n, k))) for h, n, a, k in rows]
    assert [g[0] for g in got] == pytest.approx(exp, rel=1e-7, abs=1e-14)
    big = values(spark, [(100_000, 10**9, 10**7, 10**7)], ["h", "n", "a", "k"], P.p_hypergeom("h", "n", "a", "k"))[0][0]
    sd = math.sqrt(10**5 * 0.99 * 0.99)
    assert big == pytest.approx(0.5 * math.erfc(-0.5 / sd / math.sqrt(2)), abs=3e-4)


def test_signed_ranks(spark):
    rows = [(w, n, 0) for n in (1, 4, 9) for w in range(0, n * (n + 1) // 2 + 1)]
    got = values(spark, rows, ["w", "n", "t"], *[P.p_wilcoxon("w", "n", "t", a) for a in ("greater", "less", "two-sided")])
    for (w, n, _), g in zip(rows, got):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product((0, 1), repeat=n)]
        up, down = sum(s >= w for s in sums) / 2**n, sum(s <= w for s in sums) / 2**n
        assert g == pytest.approx((up, down, min(1, 2 * min(up, down))))
    # Both sides of the size up to which it is exact, and ties.
    mean, sd = 50 * 51 / 4, math.sqrt(50 * 51 * 101 / 24)
    exact, normal, none = values(spark, [(800, 50, 0), (800, 50, 1e-9), (0, 0, 0)], ["w", "n", "t"], P.p_wilcoxon("w", "n", "t", "greater"))
    assert normal[0] == pytest.approx(0.5 * math.erfc((800 - mean) / sd / math.sqrt(2)), rel=1e-6)
    assert exact[0] == pytest.approx(normal[0], rel=0.05) and none[0] is None


def test_two_sample_distance(spark):
    rows = [(0.01, 5, 9), (0.3, 40, 60), (0.9, 100, 100), (1.0, 2, 2)]
    got = values(spark, rows, ["d", "a", "b"], P.p_ks("d", "a", "b"))
    for (d, a, b), g in zip(rows, got):
        x = d * math.sqrt(a * b / (a + b))
        assert g[0] == pytest.approx(1.0 if x < 0.2 else min(1.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))), abs=1e-12)


def test_correlation(spark):
    got = values(spark, [(0.5, 12), (-0.5, 12), (1.0, 9), (0.2, 2)], ["r", "n"], P.p_correlation("r", "n"))
    t = 0.5 * math.sqrt(10 / 0.75)
    same = values(spark, [(t, 10)], ["t", "n"], P.p_t_two_sided("t", "n"))[0][0]
    assert got[0][0] == pytest.approx(same) == got[1][0] and got[2][0] == 0.0 and got[3][0] is None


def test_quantile_inverts(spark):
    got = values(spark, [(d,) for d in (1, 5, 60)], ["d"], P.p_t_two_sided(P.t_quantile("d", 0.95), "d"), P.t_quantile("d", 0.95))
    assert [g[0] for g in got] == pytest.approx([0.1] * 3, rel=1e-9)
    assert got[-1][1] == pytest.approx(1.6706, abs=1e-4)
    assert values(spark, [(0,)], ["d"], P.t_quantile("d", 0.95))[0][0] is None


def test_nulls(spark):
    df = spark.createDataFrame([(None, None)], "x double, n double")
    row = df.select(P.p_normal_upper("x"), P.p_ks("x", "n", "n"), P.p_wilcoxon("x", "n", "x", "less"), P.p_hypergeom("x", "n", "n", "n"), P.p_binom_greater("x", "n"), P.p_f(F.col("x"), F.col("n"), F.col("n")), P.p_correlation("x", "n")).first()
    assert set(row) == {None}
