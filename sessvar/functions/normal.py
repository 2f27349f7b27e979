"""The normal distribution as expressions of built-in functions, the same text for any SQL engine.

Neither engine has an error function, so the cumulative distribution is a published rational
approximation (double precision) and its inverse another; both stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numerator and denominator of the rational approximation to the upper tail, constant term first.
TAIL_TOP = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-2)
TAIL_BOTTOM = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2)
#: The published inverse's coefficients, centre (top, bottom) and tails (top, bottom), highest power first, and where they meet.
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_INV_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_INV_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
MEET = 0.02425


def number(value: float) -> str:
    """A double literal in any SQL engine."""
    return f"{value:.17e}" if value >= 0 else f"({value:.17e})"


def _horner(highest_first: tuple[float, ...], x: str) -> str:
    out = number(highest_first[0])
    for c in highest_first[1:]:
        out = f"({out} * {x} + {number(c)})"
    return out


def tail_sql(x: str) -> str:
    """The upper tail at the absolute value of column ``x``."""
    a = f"abs({x})"
    inner = f"exp(-{x} * {x} / 2e0) * {_horner(TAIL_TOP[::-1], a)} / {_horner(TAIL_BOTTOM[::-1], a)}"
    fraction = a
    for n in (0.65, 4, 3, 2, 1):
        fraction = f"({a} + {number(n)} / {fraction})" if n != 0.65 else f"({a} + {number(0.65)})"
    outer = f"exp(-{x} * {x} / 2e0) / {fraction} / {number(2.506628274631)}"
    return f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < {number(7.07106781186547)} THEN {inner} ELSE {outer} END)"


def cdf_sql(x: str, tail: str | None = None) -> str:
    """The cumulative distribution of column ``x``, which is named several times: give a column, not an expression. ``tail``: a column that holds its tail."""
    tail = tail or tail_sql(x)
    return f"(CASE WHEN {x} > 0 THEN 1e0 - {tail} ELSE {tail} END)"


def pdf_sql(x: str) -> str:
    return f"(exp(-{x} * {x} / 2e0) * {number(0.3989422804014327)})"


def inverse_sql(p: str) -> str:
    """The quantile of column ``p`` in (0, 1)."""
    q, low, high = f"({p} - 0.5e0)", f"sqrt(-2e0 * ln({p}))", f"sqrt(-2e0 * ln(1e0 - {p}))"
    r = f"({q} * {q})"
    centre = f"{_horner(CENTRE_TOP, r)} * {q} / {_horner(CENTRE_BOTTOM, r)}"
    below = f"{_horner(TAIL_INV_TOP, low)} / {_horner(TAIL_INV_BOTTOM, low)}"
    above = f"(-{_horner(TAIL_INV_TOP, high)} / {_horner(TAIL_INV_BOTTOM, high)})"
    return f"(CASE WHEN {p} < {number(MEET)} THEN {below} WHEN {p} > {number(1 - MEET)} THEN {above} ELSE {centre} END)"


def _poly(highest_first: tuple[float, ...], x: Column) -> Column:
    out = F.lit(highest_first[0])
    for c in highest_first[1:]:
        out = out * x + F.lit(c)
    return out


def cdf(x: Column) -> Column:
    """The standard normal cumulative distribution. Give a column or a cheap expression: it is named several times."""
    a = F.abs(x)
    density = F.exp(-x * x / 2.0)
    fraction = a + 0.65
    for n in (4.0, 3.0, 2.0, 1.0):
        fraction = a + n / fraction
    inner = density * _poly(TAIL_TOP[::-1], a) / _poly(TAIL_BOTTOM[::-1], a)
    tail = F.when(a > 37.0, 0.0).when(a < 7.07106781186547, inner).otherwise(density / fraction / 2.506628274631)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) * 0.3989422804014327


def inverse(p: Column) -> Column:
    """The standard normal quantile of ``p`` in (0, 1)."""
    q = p - 0.5
    r = q * q
    low, high = F.sqrt(-2.0 * F.ln(p)), F.sqrt(-2.0 * F.ln(1.0 - p))
    below = _poly(TAIL_INV_TOP, low) / _poly(TAIL_INV_BOTTOM, low)
    above = -_poly(TAIL_INV_TOP, high) / _poly(TAIL_INV_BOTTOM, high)
    return F.when(p < MEET, below).when(p > 1 - MEET, above).otherwise(_poly(CENTRE_TOP, r) * q / _poly(CENTRE_BOTTOM, r))
