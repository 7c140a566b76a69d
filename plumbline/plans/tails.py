"""SQL of tail probabilities, by quadrature: another way than the continued fractions the queries use."""
from __future__ import annotations

STEPS = 4000


def _simpson(f: str, lo: str, hi: str) -> str:
    """Integral of ``f`` (an expression of u) from lo to hi."""
    h = f"(({hi}) - ({lo})) / {STEPS}.0"
    value = f.replace("{u}", f"(({lo}) + i * {h})")
    return f"({h} / 3 * list_sum([(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {value} for i in range({STEPS + 1})]))"


def normal_upper(z: str) -> str:
    top = f"least(greatest({z}, -12.0), 12.0)"
    return f"(0.5 - {_simpson('exp(-{u} * {u} / 2) / sqrt(2 * pi())', '0.0', top)})"


def beta_inc(a: str, b: str, x: str) -> str:
    """I_x(a, b) for a, b of one half or more, over the angle whose squared sine is the variable."""
    log_beta = f"(lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b})))"
    f = f"exp((2 * ({a}) - 1) * ln(greatest(sin({{u}}), 1e-300)) + (2 * ({b}) - 1) * ln(greatest(cos({{u}}), 1e-300)) - {log_beta}) * 2"
    return _simpson(f, "0.0", f"asin(sqrt({x}))")


def f_upper(f: str, d1: str, d2: str) -> str:
    return "(1 - " + beta_inc(f"({d1}) / 2.0", f"({d2}) / 2.0", f"({d1}) * ({f}) / (({d2}) + ({d1}) * ({f}))") + ")"


def t_two_sided(t: str, df: str) -> str:
    return f_upper(f"(({t}) * ({t}))", "1", df)


def chi2_upper(x: str, df: str) -> str:
    f = f"2 * exp((({df}) - 1) * ln(greatest({{u}}, 1e-300)) - {{u}} * {{u}} - lgamma(({df}) / 2.0))"
    return f"(1 - {_simpson(f, '0.0', f'sqrt(({x}) / 2.0)')})"


def ks_upper(d: str, n1: str, n2: str) -> str:
    x2 = f"(({d}) * ({d}) * ({n1}) * ({n2}) / (({n1}) + ({n2})))"
    total = f"2 * list_sum([(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * {x2}) for j in range(1, 101)])"
    return f"(CASE WHEN {x2} < 0.04 THEN 1.0 ELSE greatest(0.0, least(1.0, {total})) END)"


def binom_upper(k: str, n: str) -> str:
    return f"coalesce(list_sum([exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) - {n} * ln(2.0)) for j in range({k}, {n} + 1)]), 0.0)"


def hypergeom_upper(hits: str, n: str, a: str, k: str) -> str:
    choose = lambda u, v: f"lgamma({u} + 1) - lgamma({v} + 1) - lgamma({u} - ({v}) + 1)"
    lo, hi = f"greatest({hits}, 0, {k} - ({n} - {a}))", f"least({k}, {a})"
    return f"coalesce(least(1.0, list_sum([exp({choose(a, 'j')} + {choose(f'({n} - {a})', f'({k} - j)')} - ({choose(n, k)})) for j in range({lo}, {hi} + 1)])), 0.0)"
