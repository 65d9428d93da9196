"""Student-t two-sided p-value as a JVM-side column expression.

The expression is SQL text, parsed once, and applied to aggregate rows (one
per test).  Both branches have a fixed number of terms: how many are needed
depends on t, and by the choice of the branch not even on t, and never on
the degrees of freedom, so on the size of the table.

With a = dof / 2 and y = t^2 / (dof + t^2) the p-value is I_{1-y}(a, 1/2):

* |t| < 1.25: 1 - I_y(1/2, a) by its power series, all terms positive;
* else the even part of the continued fraction of I_{1-y}(a, 1/2), written
  in a * y rather than 1 - (1 - y) so that nothing cancels for large a; it
  keeps its relative accuracy for the smallest p-values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SWITCH = 1.25
SERIES_TERMS, FRACTION_TERMS = 64, 96

# Lanczos approximation coefficients (g = 7, n = 9).
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028,
            771.32342877765313, -176.61502916214059, 12.507343278686905,
            -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def _d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def lgamma_sql(x: str) -> str:
    """log Gamma(x) for x >= 0.5 (Lanczos) as SQL text."""
    z = f"(({x}) - 1.0D)"
    terms = " + ".join([_d(_LANCZOS[0])] + [f"{_d(c)} / ({z} + {float(i)!r}D)"
                                            for i, c in enumerate(_LANCZOS[1:], start=1)])
    t = f"({z} + 7.5D)"
    return f"(0.9189385332046727D + ({z} + 0.5D) * ln({t}) - {t} + ln({terms}))"


def lgamma_step_sql(a: str) -> str:
    """log Gamma(a + 1/2) - log Gamma(a) for a > 0 as SQL text.

    From 20 on by the difference of the two Stirling series: the logarithms
    themselves grow with a and would cancel.
    """
    i = f"(1.0D / ({a}))"
    j = f"({i} * {i})"
    stirling = (f"0.5D * ln({a}) + {i} * (-1.0D / 8 + {j} * (1.0D / 192 + {j} * (-1.0D / 640 "
                f"+ {j} * (17.0D / 14336 - {j} * 31.0D / 18432))))")
    small = f"{lgamma_sql(f'{a} + 1.5D')} - ln({a} + 0.5D) - {lgamma_sql(f'{a} + 1.0D')} + ln({a})"
    return f"(CASE WHEN {a} >= 20.0D THEN {stirling} ELSE {small} END)"


def _let(value: str, var: str, body: str) -> str:
    """Bind ``value`` to lambda variable ``var`` once, then evaluate ``body``
    (a one-element ``transform``): keeps repeated sub-expressions out of the
    expression tree the optimizer and code generator have to walk."""
    return f"transform(array({value}), {var} -> {body})[0]"


def _series() -> str:
    """The power series over the bound struct ``v`` (a, x, y, front)."""
    term = "z.term * (v.a + 0.5D + n) / (1.5D + n) * v.y"
    step = _let(term, "k", "named_struct('term', k, 'total', z.total + k)")
    return (f"aggregate(sequence(0, {SERIES_TERMS - 1}), named_struct('term', 1.0D, 'total', 1.0D), "
            f"(z, n) -> {step}, z -> 1.0D - 2.0D * v.front * z.total)")


def _fraction() -> str:
    """The continued fraction over the bound struct ``v``; convergents are scaled to a denominator of one."""
    first = "((1.0D / v.a + 1.0D) / (v.a * v.y - 0.5D * v.x + 1.0D))"
    num = ("(1.0D + (n - 1) / v.a) * (1.0D + (n - 0.5D) / v.a) * pow(v.a / (v.a - 1.0D + 2 * n), 2) "
           "* pow(n * v.x, 2) * (0.5D - n) / n")
    den = ("n + n * (0.5D - n) * v.x / (v.a - 1.0D + 2 * n) + (n / v.a + 1.0D) / (1.0D + (1.0D + 2 * n) / v.a) "
           "* (v.a * v.y - 0.5D * v.x + 1.0D + n * (v.y + 1.0D))")
    nxt = _let("named_struct('a', w.num * z.a + w.den * z.r, 'b', w.num * z.b + w.den)", "k",
               "named_struct('a', z.r / k.b, 'b', 1.0D / k.b, 'r', k.a / k.b)")
    step = _let(f"named_struct('num', {num}, 'den', {den})", "w", nxt)
    return (f"aggregate(sequence(1, {FRACTION_TERMS}), named_struct('a', 0.0D, 'b', {first}, 'r', {first}), "
            f"(z, n) -> {step}, z -> v.front * z.r)")


def t_pvalue_sql(t: str, dof: str) -> str:
    """Two-sided Student-t p-value of columns/expressions ``t`` and ``dof`` (SQL text)."""
    front = (f"exp({lgamma_step_sql('u.a')} - 0.5723649429247001D - u.a * log1p(u.q / u.d) "
             "+ 0.5D * ln(u.q / (u.d + u.q)))")
    value = _let(f"named_struct('a', u.a, 'x', u.d / (u.d + u.q), 'y', u.q / (u.d + u.q), 'front', {front})", "v",
                 f"CASE WHEN u.q < {_d(SWITCH * SWITCH)} THEN {_series()} ELSE {_fraction()} END")
    body = ("CASE WHEN s.t IS NULL OR s.d IS NULL OR s.d <= 0 OR isnan(s.t) OR isnan(s.d) THEN NULL "
            "WHEN s.t = 0 THEN 1.0D WHEN s.d / (s.d + s.t * s.t) <= 0.0D THEN 0.0D ELSE "
            + _let("named_struct('a', s.d / 2.0D, 'd', s.d, 'q', s.t * s.t)", "u", f"least(greatest({value}, 0.0D), 1.0D)")
            + " END")
    return _let(f"named_struct('t', CAST({t} AS DOUBLE), 'd', CAST({dof} AS DOUBLE))", "s", body)


def t_pvalue(t: str, dof: str) -> Column:
    """Two-sided p-value of Student's t for two named columns."""
    return F.expr(t_pvalue_sql(f"`{t}`", f"`{dof}`"))
