"""Undiscounted option formulas on a forward, as column expressions.

Arguments are named several times in the result: give columns, not long expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normal


def _d1(sigma: Column, forward: Column, strike: Column, ttm: Column) -> Column:
    return (F.ln(forward / strike) + sigma * sigma * ttm / 2.0) / (sigma * F.sqrt(ttm))


def black76(sigma: Column, forward: Column, strike: Column, ttm: Column, is_call: Column) -> Column:
    """Undiscounted price; puts by parity."""
    d1 = _d1(sigma, forward, strike, ttm)
    call = forward * normal.cdf(d1) - strike * normal.cdf(d1 - sigma * F.sqrt(ttm))
    return F.when(is_call, call).otherwise(call - forward + strike)


def vega(sigma: Column, forward: Column, strike: Column, ttm: Column) -> Column:
    """Undiscounted price change for a unit of volatility."""
    return forward * normal.pdf(_d1(sigma, forward, strike, ttm)) * F.sqrt(ttm)


def straddle(forward: Column, strike: Column, variance: Column) -> Column:
    """Undiscounted straddle for a total variance; intrinsic value where it is not positive."""
    root = F.sqrt(F.greatest(variance, F.lit(1e-300)))
    d1 = F.ln(forward / strike) / root + root / 2.0
    live = forward * (2.0 * normal.cdf(d1) - 1.0) - strike * (2.0 * normal.cdf(d1 - root) - 1.0)
    return F.when(variance > 0, live).otherwise(F.abs(forward - strike))


def straddle_delta(forward: Column, strike: Column, variance: Column) -> Column:
    """2 cdf(d1) - 1; plus or minus one where no variance is left."""
    root = F.sqrt(F.greatest(variance, F.lit(1e-300)))
    d1 = F.ln(forward / strike) / root + root / 2.0
    return F.when(variance > 0, 2.0 * normal.cdf(d1) - 1.0).otherwise(F.when(forward >= strike, 1.0).otherwise(-1.0))


#: The edge of the no-arbitrage bounds as a part of the forward, and the volatilities searched.
EDGE, LOWEST, HIGHEST, HALVINGS = 1e-8, 1e-4, 5.0, 60


def implied_vol(price: Column, forward: Column, strike: Column, ttm: Column, is_call: Column) -> Column:
    """Volatility of an undiscounted price by bisection inside the row; null outside the no-arbitrage bounds or the search range."""
    intrinsic = F.greatest(F.when(is_call, forward - strike).otherwise(strike - forward), F.lit(0.0))
    ceiling = F.when(is_call, forward).otherwise(strike)
    sound = (price > intrinsic + EDGE * forward) & (price < ceiling - EDGE * forward) & (ttm > 0)

    def halve(state: Column, _: Column) -> Column:
        middle = (state["lo"] + state["hi"]) / 2.0
        low = black76(middle, forward, strike, ttm, is_call) < price
        return F.struct(F.when(low, middle).otherwise(state["lo"]).alias("lo"), F.when(low, state["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2.0)
    reachable = (black76(F.lit(LOWEST), forward, strike, ttm, is_call) <= price) & (black76(F.lit(HIGHEST), forward, strike, ttm, is_call) >= price)
    return F.when(sound, F.when(reachable, found))
