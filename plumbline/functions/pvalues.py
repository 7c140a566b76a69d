"""Tail probabilities as column expressions.

Spark has no distribution functions. These are continued fractions and series summed by ``aggregate`` over a
sequence, with as many terms as the parameters need, on the result tables of tests (one row per test). What a term needs
is carried in the state, and ``_let`` binds a value to a name: an expression that uses it often then holds it once.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_BINOMIAL_N = 1_000_000  # beyond, the tail of fair tosses is the normal one with continuity correction
EXACT_SIGNED_RANK_N = 50  # up to this many differences without ties the signed-rank p is exact
_TINY = 1e-300


def _col(x: Column | str | float) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")


def _state(**fields: Column | float) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in fields.items()])


def _let(body, **values: Column) -> Column:
    """``body`` of a struct of the named values, each evaluated once."""
    return F.get(F.transform(F.array(_state(**values)), body), F.lit(0))


def _kept(x: Column) -> Column:
    """x, or a tiny number where it vanishes (modified Lentz evaluation)."""
    return F.when(F.abs(x) > _TINY, x).otherwise(_TINY)


def _terms(*sizes: Column) -> Column:
    """1, 2, … as many terms as a fraction with parameters of these sizes needs: some multiples of the root of the largest."""
    return F.sequence(F.lit(1), F.ceil(60 + 6 * F.sqrt(F.greatest(*sizes, F.lit(1.0)))).cast("int"))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series, eight steps up."""
    def body(s: Column) -> Column:
        x, y = s["x"], s["y"]
        series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
        return series - F.log(x * (x + 1) * (x + 2) * (x + 3)) - F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))

    return _let(body, x=x, y=x + 8)


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b), a and b positive."""
    def pick(s: Column) -> Column:
        # The fraction converges fast below the mean; beyond it the other tail is taken.
        a, b, x = s["a"], s["b"], s["x"]
        tail = _let(lambda t: F.when(t["swapped"] > 0, 1 - _beta_tail(b, a, 1 - x)).otherwise(_beta_tail(a, b, x)), swapped=F.when(x >= (a + 1) / (a + b + 2), 1.0).otherwise(0.0))
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(tail)

    return _let(pick, a=_col(a), b=_col(b), x=_col(x))


def _beta_tail(p: Column, q: Column, z: Column) -> Column:
    """I_z(p, q) by its continued fraction."""
    def half(s: Column, num: Column) -> Column:
        def next_(t: Column) -> Column:
            return _state(p=s["p"], q=s["q"], z=s["z"], c=t["c"], d=t["d"], h=s["h"] * t["c"] * t["d"])

        return _let(lambda n: _let(next_, c=_kept(1 + n["n"] / s["c"]), d=1 / _kept(1 + n["n"] * s["d"])), n=num)

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (s["q"] - m) * s["z"] / ((s["p"] + 2 * m - 1) * (s["p"] + 2 * m))
        odd = -(s["p"] + m) * (s["p"] + s["q"] + m) * s["z"] / ((s["p"] + 2 * m) * (s["p"] + 2 * m + 1))
        return half(s, F.when(k % 2 == 0, even).otherwise(odd))

    def body(s: Column) -> Column:
        p, q, z = s["p"], s["q"], s["z"]
        start = _let(lambda t: _state(p=p, q=q, z=z, c=1.0, d=t["d"], h=t["d"]), d=1 / _kept(1 - (p + q) * z / (p + 1)))
        fraction = F.aggregate(F.sequence(F.lit(2), 2 * F.size(_terms(p, q))), start, step, lambda s: s["h"])
        return F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(z) + q * F.log1p(-z)) / p * fraction

    return _let(body, p=p, q=q, z=z)


def gamma_upper(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x), a positive."""
    def series(a: Column, x: Column) -> Column:
        def step(s: Column, n: Column) -> Column:
            return _let(lambda t: _state(a=s["a"], x=s["x"], term=t["t"], total=s["total"] + t["t"]), t=s["term"] * s["x"] / (s["a"] + n))

        return F.aggregate(_terms(a, x), _state(a=a, x=x, term=1 / a, total=1 / a), step, lambda s: s["total"])

    def fraction(a: Column, x: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            num, b = -i * (i - s["a"]), s["b"] + 2
            return _let(lambda t: _state(a=s["a"], b=b, c=t["c"], d=t["d"], h=s["h"] * t["c"] * t["d"]), c=_kept(b + num / s["c"]), d=1 / _kept(num * s["d"] + b))

        start = _let(lambda t: _state(a=a, b=t["b"], c=1 / _TINY, d=t["d"], h=t["d"]), b=x + 1 - a, d=1 / _kept(x + 1 - a))
        return F.aggregate(_terms(a, x), start, step, lambda s: s["h"])

    def body(s: Column) -> Column:
        a, x, front = s["a"], s["x"], s["front"]
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series(a, x)).otherwise(front * fraction(a, x))

    front = lambda s: _let(body, a=s["a"], x=s["x"], front=F.exp(-s["x"] + s["a"] * F.log(s["x"]) - log_gamma(s["a"])))
    return _let(front, a=_col(a), x=_col(x))


def p_normal_upper(z: Column | str) -> Column:
    return _let(lambda s: F.when(s["z"] >= 0, s["t"]).otherwise(1 - s["t"]), z=_col(z), t=0.5 * gamma_upper(F.lit(0.5), _col(z) * _col(z) / 2))


def p_normal_lower(z: Column | str) -> Column:
    return p_normal_upper(-_col(z))


def p_t_two_sided(t: Column | str, df: Column | str) -> Column:
    return _let(lambda s: beta_inc(s["df"] / 2, F.lit(0.5), s["df"] / (s["df"] + s["t"] * s["t"])), t=_col(t), df=_col(df))


def t_quantile(df: Column | str, q: float) -> Column:
    """Upper quantile (q > 0.5) of the t distribution, by halving the range of df / (df + t * t)."""
    df = _col(df)
    wanted = 2 * (1 - q)

    def step(s: Column, _: Column) -> Column:
        def narrow(t: Column) -> Column:
            below = t["p"] < wanted
            return _state(df=s["df"], lo=F.when(below, t["mid"]).otherwise(s["lo"]), hi=F.when(below, s["hi"]).otherwise(t["mid"]))

        return _let(lambda m: _let(narrow, mid=m["m"], p=beta_inc(s["df"] / 2, F.lit(0.5), m["m"])), m=(s["lo"] + s["hi"]) / 2)

    x = F.aggregate(F.sequence(F.lit(1), F.lit(52)), _state(df=df, lo=0.0, hi=1.0), step, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(df > 0, _let(lambda s: F.sqrt(s["df"] * (1 - s["x"]) / s["x"]), df=df, x=x))


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    def body(s: Column) -> Column:
        f, d1, d2 = s["f"], s["d1"], s["d2"]
        return F.when(f.isNotNull(), F.when(f > 0, beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))).otherwise(1.0))

    return _let(body, f=_col(f), d1=_col(d1), d2=_col(d2))


def p_chi2(x: Column, df: Column) -> Column:
    return gamma_upper(_col(df) / 2, _col(x) / 2)


def p_binom_greater(k: Column | str, n: Column | str) -> Column:
    """P(X >= k) for n fair coin tosses."""
    def body(s: Column) -> Column:
        k, n = s["k"], s["n"]
        many = _let(lambda t: p_normal_upper(t["z"]), z=(k - 0.5 - n / 2) / (F.sqrt(n) / 2))
        return F.when(k.isNull() | n.isNull(), None).when(k <= 0, 1.0).when(k > n, 0.0).when(n > EXACT_BINOMIAL_N, many).otherwise(beta_inc(k, n - k + 1, F.lit(0.5)))

    return _let(body, k=_col(k), n=_col(n))


def p_binom_two_sided(k: Column | str, n: Column | str) -> Column:
    k, n = _col(k), _col(n)
    return F.when(n > 0, F.least(F.lit(1.0), 2 * p_binom_greater(F.greatest(k, n - k), n))).otherwise(F.when(n == 0, 1.0))


def p_hypergeom(hits: Column | str, n: Column | str, actives: Column | str, k: Column | str) -> Column:
    """P(X >= hits) when k of n rows are drawn and ``actives`` of the n are active.

    Terms further than 25 standard deviations from the mean are below the precision and left out.
    """
    def body(s: Column) -> Column:
        n, a, k = s["n"], s["a"], s["k"]
        choose = lambda u, v: log_gamma(u + 1) - log_gamma(v + 1) - log_gamma(u - v + 1)

        def step(x: Column, j: Column) -> Column:
            # term: that of j, from that of the hit before
            return _let(
                lambda t: _state(n=x["n"], a=x["a"], k=x["k"], term=t["t"], total=x["total"] + t["t"]),
                t=x["term"] * (x["a"] - j + 1) * (x["k"] - j + 1) / (j * (x["n"] - x["a"] - x["k"] + j)))

        def add(t: Column) -> Column:
            more = F.when(s["hi"] > s["lo"], F.sequence(s["lo"].cast("bigint") + 1, s["hi"].cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
            return F.aggregate(more, _state(n=n, a=a, k=k, term=t["first"], total=t["first"]), step, lambda x: x["total"])

        first = F.exp(choose(a, s["lo"]) + choose(n - a, k - s["lo"]) - s["all"])
        return F.when(s["lo"] > s["hi"], 0.0).otherwise(F.least(F.lit(1.0), _let(add, first=first)))

    def bounds(s: Column) -> Column:
        n, a, k = s["n"], s["a"], s["k"]
        mean = k * a / n
        reach = 25 * F.sqrt(mean * (1 - a / n)) + 25
        every = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
        return _let(body, n=n, a=a, k=k, all=every, lo=F.greatest(s["hits"], F.lit(0.0), k - (n - a), F.floor(mean - reach)), hi=F.least(k, a, F.ceil(mean + reach)))

    return F.when(_col(n).isNotNull() & _col(hits).isNotNull(), _let(bounds, hits=_col(hits), n=_col(n), a=_col(actives), k=_col(k)))


def _signed_rank_upper(w: Column, n: Column) -> Column:
    """P(W+ >= w) for n untied differences (n at most ``EXACT_SIGNED_RANK_N``): ways to reach every rank sum, rank by rank."""
    top = (n * (n + 1) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), top), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    add = lambda ways, r: F.transform(ways, lambda x, s: x + F.when(s >= r, F.get(ways, s - r)).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, add)
    first = F.greatest(F.ceil(w - 1e-9), F.lit(0)).cast("int")
    return F.aggregate(F.slice(ways, first + 1, F.greatest(top - first + 1, F.lit(0))), F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), n)


def p_wilcoxon(w_plus: Column | str, n: Column | str, ties: Column | str, alternative: str) -> Column:
    """p of a signed-rank statistic: exact for small untied samples, else normal with tie correction; null without differences."""
    def body(s: Column) -> Column:
        w, n = s["w"], s["n"]
        exact = (n <= EXACT_SIGNED_RANK_N) & (s["ties"] == 0)
        up = F.when(exact, _signed_rank_upper(w, F.when(exact, n).otherwise(1.0))).otherwise(F.coalesce(s["up"], F.lit(1.0)))
        down = F.when(exact, _signed_rank_upper(n * (n + 1) / 2 - w, F.when(exact, n).otherwise(1.0))).otherwise(F.coalesce(1 - s["up"], F.lit(1.0)))
        if alternative != "two-sided":
            return {"greater": up, "less": down}[alternative]
        return _let(lambda t: F.least(F.lit(1.0), 2 * F.least(t["up"], t["down"])), up=up, down=down)

    w, n, ties = map(_col, (w_plus, n, ties))
    z = F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48))
    return F.when(n > 0, _let(body, w=w, n=n, ties=ties, up=p_normal_upper(z)))


def p_ks(d: Column | str, n1: Column | str, n2: Column | str) -> Column:
    """Limiting two-sample Kolmogorov-Smirnov tail."""
    def body(s: Column) -> Column:
        sign = lambda j: F.when(j % 2 == 1, 1.0).otherwise(-1.0)
        total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda x, j: x + sign(j) * F.exp(-2 * j * j * s["x"]))
        return F.when(s["x"] < 0.04, 1.0).when(s["x"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total)))

    d, a, b = map(_col, (d, n1, n2))
    return _let(body, x=d * d * a * b / (a + b))


def p_correlation(r: Column | str, n: Column | str) -> Column:
    """Two-sided t test of a correlation coefficient of n rows; null for fewer than three."""
    def body(s: Column) -> Column:
        t = F.sqrt((s["n"] - 2) / (1 - s["r"] * s["r"])) * F.abs(s["r"])
        p = _let(lambda u: p_t_two_sided(u["t"], u["df"]), t=F.when(F.abs(s["r"]) < 1, t).otherwise(0.0), df=s["n"] - 2)
        return F.when(s["r"].isNotNull() & (s["n"] >= 3), F.when(F.abs(s["r"]) >= 1, 0.0).otherwise(p))

    return _let(body, r=_col(r), n=_col(n))
