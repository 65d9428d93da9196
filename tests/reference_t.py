"""Plain-Python Student-t tail probability: the test reference for the SQL fold."""

import math
from decimal import Decimal, localcontext

import numpy as np

# --- Student-t tail probability ------------------------------------------
# Regularised incomplete beta by Lentz's continued fraction; vectorised
# numpy over an Arrow batch.  It is only ever applied to aggregate rows
# (one per hypothesis / pair), never to the raw table.

def _betacf(a: float, b: float, x: float, iters: int = 300, eps: float = 3e-16) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
           + a * math.log(x) + b * math.log1p(-x))
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or not np.isfinite(df) or df <= 0 or np.isnan(t):
        return None
    if np.isinf(t):
        return 0.0
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


# --- The same to 40 digits ------------------------------------------------
# Power series of I_y(1/2, dof / 2) in decimal arithmetic: all terms are
# positive, and 80 digits leave enough of 1 - I for the smallest p below.

def t_two_sided_p_exact(t: float, dof: float) -> float:
    with localcontext() as ctx:
        ctx.prec = 80
        pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899862803")
        bernoulli = [Decimal(n) / d for n, d in ((1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730), (7, 6),
                                                 (-3617, 510), (43867, 798), (-174611, 330))]
        half, t, dof = Decimal("0.5"), Decimal(t), Decimal(dof)

        def log_gamma(x):
            return (x - half) * x.ln() - x + (2 * pi).ln() / 2 + sum(
                b / (2 * k * (2 * k - 1) * x ** (2 * k - 1)) for k, b in enumerate(bernoulli, 1))

        a = shifted = dof / 2
        ratio = Decimal(1)
        while shifted < 200:
            ratio *= shifted / (shifted + half)
            shifted += 1
        y = t * t / (dof + t * t)
        front = (log_gamma(shifted + half) - log_gamma(shifted) + ratio.ln() - pi.ln() / 2
                 + a * (1 - y).ln() + y.ln() / 2).exp()
        total = term = Decimal(1)
        n = 0
        while abs(term) > total * Decimal(10) ** -78 or n < 10:
            term *= (half + a + n) / (Decimal("1.5") + n) * y
            total += term
            n += 1
        return float(1 - 2 * front * total)
