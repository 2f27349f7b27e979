"""From an option panel to at-the-money variance: liquidity, parity forwards, implied volatility, smiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import normal, options
from ..functions.options import EDGE, HIGHEST, LOWEST

#: Annual rate and days, least pairs of a forward, least trades of a leg.
RATE, YEAR, LEAST_PAIRS, LEAST_TRADES = 0.065, 365.0, 6, 5
KEY = ("trade_date", "symbol", "expiry")


def liquid(panel: DataFrame) -> DataFrame:
    return panel.filter("volume > 0 AND n_trades >= 5 AND open_int >= 500")


def near_money(quotes: DataFrame, most: float = 0.15, least_sessions: int = 2) -> DataFrame:
    """Quotes near the forward with sessions to go; rows without either drop out."""
    return quotes.filter((F.abs(F.ln(F.col("strike") / F.col("fwd"))) <= most) & (F.col("dte_trd") >= least_sessions))


def pairs(panel: DataFrame) -> DataFrame:
    """Call and put settlements of a strike, one pass of conditional aggregation in place of a self-join; both sides must be there, and traded."""
    live = panel.filter((F.col("volume") > 0) & (F.col("n_trades") >= LEAST_TRADES))
    # a condition of the aggregate, not a filter, which would be pushed below and repeat whatever computes the settlement
    side = lambda t: F.max(F.when((F.col("opt_type") == t) & (F.col("settle") > 0), F.col("settle")))
    return live.groupBy(*KEY, "strike", "dte").agg(side("CE").alias("call"), side("PE").alias("put")).filter("call is not null and put is not null")


def unexpired(panel: DataFrame) -> DataFrame:
    """The panel, which raises on a row of the expiry day: a settlement is no option price then."""
    return panel.withColumn("dte", F.when(F.col("dte") < 1, F.raise_error(F.lit("an expiring contract has no forward")).cast("long")).otherwise(F.col("dte")))


def discounting(rate: float) -> Column:
    return F.exp(F.lit(-rate) * F.col("dte") / YEAR)


def forwards(panel: DataFrame, rate: float = RATE, least: int = LEAST_PAIRS) -> DataFrame:
    """Put-call-parity forward of each expiry: the median over strikes, with the deviations' median and maximum. Expiring contracts raise."""
    discount = discounting(rate)
    each = pairs(unexpired(panel)).withColumn("f", F.col("strike") + (F.col("call") - F.col("put")) / discount)
    # over windows, so that pairs are made once; the deviations' median uses their partitioning again
    whole = Window.partitionBy(*KEY)
    middle = each.withColumns({"fwd": F.median("f").over(whole), "n_pairs": F.count("*").over(whole)}).filter(F.col("n_pairs") >= least)
    off = F.abs(F.col("f") - F.col("fwd"))
    return middle.groupBy(*KEY, "dte", "fwd", "n_pairs").agg(F.max(off).alias("fwd_dev_max"), F.median(off).alias("fwd_mad")).withColumn("discount", discount)


def forward_sensitivity(panel: DataFrame, rates: tuple[float, float, float] = (0.055, 0.065, 0.075), least: int = LEAST_PAIRS) -> DataFrame:
    """The forward at three rates side by side: the pairs are made once, and one aggregation takes all medians."""
    each = pairs(unexpired(panel))
    at = lambda rate: F.median(F.col("strike") + (F.col("call") - F.col("put")) / discounting(rate))
    found = each.groupBy(*KEY).agg(F.count("*").alias("n_pairs"), *(at(r).alias(f"fwd_{i}") for i, r in enumerate(rates)))
    return found.filter(F.col("n_pairs") >= least).drop("n_pairs")


def _normal(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    density = np.exp(-x * x / 2)
    fraction = a + 0.65
    for n in (4.0, 3.0, 2.0, 1.0):
        fraction = a + n / fraction
    tail = np.where(a < 7.07106781186547, density * np.polyval(normal.TAIL_TOP[::-1], a) / np.polyval(normal.TAIL_BOTTOM[::-1], a), density / fraction / 2.506628274631)
    return np.where(x > 0, 1 - tail, tail)


def solve_volatility(price: np.ndarray, forward: np.ndarray, strike: np.ndarray, ttm: np.ndarray, is_call: np.ndarray, steps: int = 64) -> np.ndarray:
    """Volatilities of undiscounted prices, NaN where none exists: Newton steps kept inside a shrinking bracket."""
    call = np.where(is_call, price, price + forward - strike)
    with np.errstate(all="ignore"):
        floor = np.where(is_call, np.maximum(forward - strike, 0), np.maximum(strike - forward, 0))
        sound = (price > floor + EDGE * forward) & (price < np.where(is_call, forward, strike) - EDGE * forward) & (ttm > 0)
        root = np.sqrt(np.where(ttm > 0, ttm, np.nan))
        low, high = np.full(price.shape, LOWEST), np.full(price.shape, HIGHEST)
        sigma = np.clip(np.sqrt(2 * np.pi) * price / forward / root, LOWEST, HIGHEST)
        for _ in range(steps):
            d1 = np.log(forward / strike) / (sigma * root) + sigma * root / 2
            miss = forward * _normal(d1) - strike * _normal(d1 - sigma * root) - call
            low, high = np.where(miss < 0, sigma, low), np.where(miss < 0, high, sigma)
            newton = sigma - miss / (forward * np.exp(-d1 * d1 / 2) / np.sqrt(2 * np.pi) * root)
            new = np.where((newton > low) & (newton < high), newton, (low + high) / 2)
            if np.nanmax(np.abs(new - sigma), initial=0) < 1e-14:
                break
            sigma = new
        d1 = np.log(forward / strike) / (sigma * root) + sigma * root / 2
        miss = np.abs(forward * _normal(d1) - strike * _normal(d1 - sigma * root) - call)
        return np.where(sound & (miss <= 1e-8 * np.maximum(forward, 1)), sigma, np.nan)


def with_volatility(quotes: DataFrame, price: Column, forward: Column, strike: Column, ttm: Column, is_call: Column, name: str = "iv") -> DataFrame:
    """Adds the implied volatility in Arrow batches; null where there is none."""
    kept = quotes.columns
    # a new type: StructType.add would alter the one that the frame holds
    schema = StructType([*quotes.schema.fields, StructField(name, DoubleType())])
    staged = quotes.select("*", price.alias("_p"), forward.alias("_f"), strike.alias("_k"), ttm.cast("double").alias("_t"), is_call.alias("_c"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[kept].copy()
            iv = solve_volatility(*(pdf[c].to_numpy(float) for c in ("_p", "_f", "_k", "_t")), pdf["_c"].to_numpy(bool))
            out[name] = pd.array(iv, dtype="Float64")
            out.loc[np.isnan(iv), name] = pd.NA
            yield out

    return staged.mapInPandas(work, schema)


def surface(panel: DataFrame) -> DataFrame:
    """Liquid quotes near the money with forward, implied volatility and discounted vega."""
    live = panel.filter("dte >= 1")
    fwd = forwards(live).select(*KEY, "fwd", F.col("discount").alias("df"))
    quotes = near_money(liquid(live).join(fwd, [*KEY])).withColumn("ttm", F.col("dte") / YEAR).withColumn("log_moneyness", F.ln(F.col("strike") / F.col("fwd")))
    found = with_volatility(quotes, F.col("settle") / F.col("df"), F.col("fwd"), F.col("strike"), F.col("ttm"), F.col("opt_type") == "CE")
    d1 = (-F.col("log_moneyness") + F.col("iv") * F.col("iv") * F.col("ttm") / 2) / (F.col("iv") * F.sqrt("ttm"))
    vega = F.col("fwd") * normal.pdf(d1) * F.sqrt("ttm") * F.col("df")
    return found.withColumn("vega", vega).withColumn("total_var", F.col("iv") * F.col("iv") * F.col("ttm"))


def volatility_in_row(panel: DataFrame) -> DataFrame:
    """The implied volatilities of :func:`surface`, of every symbol, type and expiry, by higher-order functions alone."""
    live = panel.filter("dte >= 1")
    fwd = forwards(live).select(*KEY, "fwd", F.col("discount").alias("df"))
    quotes = near_money(liquid(live).join(fwd, [*KEY])).withColumn("ttm", F.col("dte") / YEAR)
    iv = options.implied_vol(F.col("settle") / F.col("df"), F.col("fwd"), F.col("strike"), F.col("ttm"), F.col("opt_type") == "CE")
    return quotes.withColumn("iv", iv)


def smiles(quotes: DataFrame, least: int = 6) -> DataFrame:
    """Vega-weighted quadratic smile of each expiry by its normal equations: level at the money, its variance, residuals.

    Sums of powers stand beside the quotes, so that ``quotes`` are made once, and the 3 by 3 system is solved in columns by
    cofactors; residuals take a second pass, safer than expanding them. Groups of fewer quotes, or singular ones, have no row.
    Quotes spread by their expiry stay in their tasks.
    """
    good = quotes.filter(F.col("iv").isNotNull() & ~F.isnan("iv") & (F.col("vega") > 0)).dropna(subset=[*KEY]).withColumn("w", F.col("vega") * F.col("vega"))
    x, w, y = F.col("log_moneyness"), F.col("w"), F.col("iv")
    whole = Window.partitionBy(*KEY)
    powers = {f"s{k}": F.sum(w * F.pow(x, F.lit(k))).over(whole) for k in range(5)} | {f"b{k}": F.sum(w * F.pow(x, F.lit(k)) * y).over(whole) for k in range(3)}
    sums = good.withColumns({"n_quotes": F.count("*").over(whole), **powers}).filter(F.col("n_quotes") >= least)
    s, b = [F.col(f"s{k}") for k in range(5)], [F.col(f"b{k}") for k in range(3)]
    c00, c01, c02 = s[2] * s[4] - s[3] * s[3], s[2] * s[3] - s[1] * s[4], s[1] * s[3] - s[2] * s[2]
    c11, c12, c22 = s[0] * s[4] - s[2] * s[2], s[1] * s[2] - s[0] * s[3], s[0] * s[2] - s[1] * s[1]
    det = s[0] * c00 + s[1] * c01 + s[2] * c02
    solved = sums.withColumn("det", det).filter("det > 0")
    solved = solved.select(*good.columns, "n_quotes", ((c00 * b[0] + c01 * b[1] + c02 * b[2]) / F.col("det")).alias("a0"), ((c01 * b[0] + c11 * b[1] + c12 * b[2]) / F.col("det")).alias("a1"), ((c02 * b[0] + c12 * b[1] + c22 * b[2]) / F.col("det")).alias("a2"), (c00 / F.col("det")).alias("inv00"))
    r = F.col("iv") - (F.col("a0") + F.col("a1") * x + F.col("a2") * x * x)
    fitted = solved.groupBy(*KEY, "n_quotes", "dte", "dte_trd", "ttm", "a0", "a1", "a2", "inv00").agg(F.sum(w * r * r).alias("wrss"), F.sqrt(F.avg(r * r)).alias("resid_rms"))
    return fitted.withColumnRenamed("a0", "atm_iv").withColumn("var_atm_iv", F.col("wrss") / (F.col("n_quotes") - 3) * F.col("inv00")).drop("wrss", "inv00")


def atm_variance(fits: DataFrame) -> DataFrame:
    """Total variance at the money, raw and less the fit's own variance; null, never clipped, where that is not positive."""
    corrected = F.col("atm_iv") * F.col("atm_iv") - F.col("var_atm_iv")
    return fits.select("*", (F.col("atm_iv") * F.col("atm_iv") * F.col("ttm")).alias("total_var_raw"), F.when(corrected > 0, corrected * F.col("ttm")).alias("total_var_corr"), (F.col("var_atm_iv") / (F.col("atm_iv") * F.col("atm_iv"))).alias("noise_share"))


def dte_bucket(dte: Column) -> Column:
    return F.when(dte <= 3, "1-3").when(dte <= 7, "4-7").when(dte <= 14, "8-14").when(dte <= 30, "15-30").otherwise("31+")


def max_pain(panel: DataFrame, least: int = 20) -> DataFrame:
    """The strike at which option holders as a whole are paid least on expiry, by date and expiry; ties to the lowest.

    Pain is a sum over strikes on either side, so running sums of open interest and of open interest times strike give
    it at every strike at once; no strike is joined with another.
    """
    oi = lambda t: F.sum(F.when(F.col("opt_type") == t, F.col("open_int")).otherwise(0))
    by = panel.groupBy(*KEY, "strike").agg(oi("CE").alias("c"), oi("PE").alias("p"), F.count("*").alias("rows"))
    below = Window.partitionBy(*KEY).orderBy("strike").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*KEY).orderBy("strike").rowsBetween(1, Window.unboundedFollowing)
    k = F.col("strike")
    part = lambda e, w: F.coalesce(F.sum(e).over(w), F.lit(0))
    pain = k * part(F.col("c"), below) - part(F.col("c") * k, below) + part(F.col("p") * k, above) - k * part(F.col("p"), above)
    least_pain = by.withColumn("pain", pain).groupBy(*KEY).agg(F.sum("rows").alias("rows"), F.min(F.struct("pain", "strike")).alias("m")).filter(F.col("rows") >= least)
    return least_pain.select(*KEY, F.col("m.strike").alias("max_pain"), F.col("m.pain").alias("pain"))


def max_pain_gaps(pain: DataFrame, spots: DataFrame) -> DataFrame:
    """Distances of max pain from spot on the quote day and on the expiry day, percent of that day's spot. ``spots``: symbol, day, spot; rows without either day drop out."""
    now = spots.select("symbol", F.col("day").alias("trade_date"), F.col("spot").alias("spot_now"))
    final = spots.select("symbol", F.col("day").alias("expiry"), F.col("spot").alias("spot_final"))
    joined = pain.join(now, ["symbol", "trade_date"]).join(final, ["symbol", "expiry"])
    gap = lambda c: F.abs(F.col(c) - F.col("max_pain")) / F.col(c) * 100
    return joined.withColumn("dte", F.date_diff("expiry", "trade_date")).withColumn("gap_now", gap("spot_now")).withColumn("gap_final", gap("spot_final"))
