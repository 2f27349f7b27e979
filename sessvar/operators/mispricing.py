"""What pricing by calendar time costs: straddles on a clock of weekday weights against equal weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal, options, random

#: Spot, annual volatility, sessions of a year.
SPOT, ANNUAL_VOL, SESSIONS = 25_000.0, 0.13, 252
DAILY_VARIANCE = ANNUAL_VOL**2 / SESSIONS


def normalised(weights: DataFrame, *by: str) -> DataFrame:
    """(wd, day, raw) with ``w``: the weight over the mean of its five; one such set for each value of ``by``."""
    return weights.withColumn("w", F.col("raw") / F.avg("raw").over(Window.partitionBy(*(by or [F.lit(1)]))))


def clock_draws(weights: DataFrame, draws: int, noise: float) -> DataFrame:
    """Resampled clocks: each weight times a lognormal factor drawn by (draw, weekday), scaled to mean one."""
    each = weights.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("u", random.uniform(F.lit("clock"), F.col("draw"), F.col("wd")))
    return normalised(each.withColumn("raw", F.col("raw") * F.exp(noise * normal.inverse(F.col("u")))).drop("u"), "draw")


def atm(sessions: Column) -> Column:
    """At-the-money straddle on so many average sessions; nothing for none. At the forward both deltas are one number, so a single distribution term does."""
    return SPOT * (4.0 * normal.cdf(F.sqrt(sessions * DAILY_VARIANCE) / 2.0) - 2.0)


def entry_errors(legs: DataFrame, clock: DataFrame, *by: str) -> DataFrame:
    """Relative price error of a calendar-time trader by product. ``legs``: product, sign, wd; a row for each session of each leg."""
    legs = legs.join(F.broadcast(clock), "wd").groupBy(*by, "product", "sign").agg(F.sum("w").alias("clock"), F.count("*").cast("double").alias("flat"))
    legs = legs.select(*by, "product", "sign", (F.col("sign") * atm(F.col("clock"))).alias("p_clock"), (F.col("sign") * atm(F.col("flat"))).alias("p_flat"))
    return legs.groupBy(*by, "product").agg(F.sum("p_clock").alias("p_clock"), F.sum("p_flat").alias("p_flat")).withColumn("error", F.col("p_clock") / F.col("p_flat") - 1)


def naive_band(legs: DataFrame, draws: DataFrame) -> DataFrame:
    """The errors at every weight's own 2.5% point together and at its 97.5% point together."""
    points = F.percentile("w", F.array(F.lit(0.025), F.lit(0.975)))
    corners = draws.groupBy("wd").agg(points.alias("p")).select("wd", F.posexplode("p").alias("corner", "w"))
    return entry_errors(legs, corners, "corner").groupBy("product").agg(F.min("error").alias("low"), F.max("error").alias("high"))


def believed_variance(weights: DataFrame, per_session: int) -> DataFrame:
    """Steps of the week that ends on Tuesday: realised and evenly believed variance, realised so far, believed still to come with the step's own."""
    steps = normalised(weights).select((F.col("wd") + 3).alias("at"), "w").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_session - 1))))
    steps = steps.select(((F.col("at") % 5) * per_session + F.col("j")).alias("step"), (F.col("w") * DAILY_VARIANCE / per_session).alias("realised"), F.lit(DAILY_VARIANCE / per_session).alias("believed"))
    order = Window.partitionBy(F.lit(1)).orderBy("step")
    before = F.sum("realised").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("elapsed", F.coalesce(before, F.lit(0.0))).withColumn("remaining", (5 * per_session - F.col("step")) * F.col("believed")).withColumn("true_remaining", F.sum("realised").over(order.rowsBetween(0, Window.unboundedFollowing)))


def expected_half_s2_gamma(elapsed: Column, remaining: Column) -> Column:
    """Expected half squared spot times gamma of an at-the-money straddle: the strike times a normal density at half of all variance."""
    every = elapsed + remaining
    return F.when(remaining > 0, SPOT * normal.pdf(F.sqrt(every) / 2.0) / F.sqrt(every)).otherwise(0.0)


def _density(x: Column, variance: Column) -> Column:
    return F.exp(-x * x / (2.0 * variance)) / F.sqrt(2.0 * 3.141592653589793 * variance)


def pair_kernel(v_s: Column, r_s: Column, v_t: Column, r_t: Column) -> Column:
    """Expected product of two dollar gammas over the squared strike, at times s <= t: elapsed and believed remaining variance of each."""
    later = r_t + v_t - v_s
    both = r_s + later
    joint = r_s * later
    # the means are half the variances, so their joint mean is the joint variance
    return _density((r_s - later) / 2.0, both) * _density(joint / both + v_s / 2.0, joint / both + v_s)


def second_moment(points: DataFrame) -> DataFrame:
    """E[I^2] over points (id, elapsed, remaining, q), a table of bounded size: a few hundred nodes whatever the data."""
    s = points.select(*(F.col(c).alias(f"{c}_s") for c in points.columns))
    t = points.select(*(F.col(c).alias(f"{c}_t") for c in points.columns))
    # the kernel is symmetric once ordered in time: pairs off the diagonal count twice
    pairs = s.join(F.broadcast(t), F.col("id_s") <= F.col("id_t"))
    value = F.col("q_s") * F.col("q_t") * pair_kernel(F.col("elapsed_s"), F.col("remaining_s"), F.col("elapsed_t"), F.col("remaining_t"))
    return pairs.agg((SPOT * SPOT * F.sum(value * F.when(F.col("id_s") == F.col("id_t"), 1.0).otherwise(2.0))).alias("second_moment"))


def quadrature(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """Gauss-Legendre points (no, x, wq) spread over each session in the root of the time left: id, dt, w, elapsed, true and flat remaining variance, and q, the excess belief."""
    order = Window.partitionBy(F.lit(1)).orderBy("pos")
    days = normalised(weights).select(((F.col("wd") + 3) % 5).alias("pos"), "w")
    days = days.withColumn("before", F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    high, low = F.sqrt(5.0 - F.col("pos")), F.sqrt(4.0 - F.col("pos"))
    out = days.crossJoin(F.broadcast(nodes)).withColumn("u", (high - low) / 2.0 * F.col("x") + (high + low) / 2.0).withColumn("t", 5.0 - F.col("u") * F.col("u"))
    out = out.withColumn("dt", F.col("wq") * (high - low) * F.col("u")).withColumn("elapsed", DAILY_VARIANCE * (F.col("before") + F.col("w") * (F.col("t") - F.col("pos"))))
    return out.select((F.col("pos") * 1000 - F.col("no")).alias("id"), "dt", "w", "elapsed", (5 * DAILY_VARIANCE - F.col("elapsed")).alias("true_remaining"), (DAILY_VARIANCE * (5.0 - F.col("t"))).alias("remaining"), (F.col("dt") * DAILY_VARIANCE * (1.0 - F.col("w"))).alias("q"))


def rate_constants(points: DataFrame) -> DataFrame:
    """Leading constants of the hedging error of either trader and of their difference."""
    def gg(a: str, b: str) -> Column:
        return SPOT * SPOT * pair_kernel(F.col("elapsed"), F.col(a), F.col("elapsed"), F.col(b))

    clock, flat, cross = gg("true_remaining", "true_remaining"), gg("remaining", "remaining"), gg("remaining", "true_remaining")
    scale = F.lit(2.0 * DAILY_VARIANCE**2) * F.col("dt") * F.col("w") * F.col("w")
    parts = {"clock": clock, "calendar": flat, "difference": flat - 2.0 * cross + clock}
    return points.agg(*(F.sqrt(F.sum(scale * e)).alias(n) for n, e in parts.items()))


def taxed(rates: DataFrame, spans: DataFrame, clock: DataFrame) -> DataFrame:
    """Straddle prices and errors under transaction tax: by period and opening day."""
    opened = spans.join(F.broadcast(clock), "wd").groupBy("opened").agg(F.sum("w").alias("w_clock"), F.count("*").alias("sessions"))
    opened = opened.withColumn("v_clock", F.col("w_clock") * DAILY_VARIANCE).withColumn("v_flat", F.col("sessions") * DAILY_VARIANCE)
    out = opened.crossJoin(F.broadcast(rates)).withColumn("p", F.col("sale_pct") / 100).withColumn("e", F.col("exercised_pct") / 100)
    c, f, e, p = atm(F.col("w_clock")), atm(F.col("sessions").cast("double")), F.col("e"), F.col("p")

    def notional(variance: Column) -> Column:
        root = F.sqrt(variance)
        call = options.black76(root, F.lit(SPOT), SPOT / (1 - e), F.lit(1.0), F.lit(True))
        put = options.black76(root, F.lit(SPOT), SPOT / (1 + e), F.lit(1.0), F.lit(False))
        return (1 - e) * call + (1 + e) * put

    out = out.withColumn("price_clock", c).withColumn("price_flat", f).withColumn("optimal_clock", notional(F.col("v_clock"))).withColumn("optimal_flat", notional(F.col("v_flat")))
    c, f = F.col("price_clock"), F.col("price_flat")
    return out.select(
        "start", "opened", "sessions", "price_clock", "price_flat", ((1 - e) * c).alias("long_max"), (c / (1 - p)).alias("short_min"), (e * c).alias("exercise_tax"), (p * c / (1 - p)).alias("premium_tax"),
        (1 / (1 - p) - 1 + e).alias("band"), (c / f - 1).alias("err_frictionless"), ((c - e * SPOT) / (f - e * SPOT) - 1).alias("err_forced"), (F.col("optimal_clock") / F.col("optimal_flat") - 1).alias("err_optimal"),
        "v_clock", "e",
    )


def trap(prices: DataFrame) -> DataFrame:
    """Width and probability of settlements at which exercising pays less than its tax on a notional base."""
    e, v = F.col("e"), F.col("v_clock")
    high, low = (F.ln(1 / (1 - e)) + v / 2) / F.sqrt(v), (F.ln(1 / (1 + e)) + v / 2) / F.sqrt(v)
    return prices.select("start", "opened", (SPOT / (1 - e) - SPOT / (1 + e)).alias("width"), (normal.cdf(high) - normal.cdf(low)).alias("probability"))
