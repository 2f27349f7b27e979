"""Returns of sessions, volatility forecasts, event studies, randomization and resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import random

#: Decay of the forecast, squares that seed it; sessions on either side of an event and between pseudo-events.
DECAY, SEED = 0.94, 20
#: Blocks of a scan whose results are handed on.
CARRIED = 40
REACH, STRIDE = 63, 5
#: Percent.
GENUINE = 20.0


def daily_prices(ticks: DataFrame, name: str, at: str, tie: str, value: str) -> DataFrame:
    """Open, high, low and close of each name and day, in order of time and then ``tie``."""
    order = F.struct(at, tie)
    return ticks.groupBy(F.col(name).alias("index_name"), F.to_date(at).alias("day")).agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"))


def log_ratio(top: Column, bottom: Column) -> Column:
    """Log of a ratio of prices, null where either is not positive."""
    return F.ln(F.when(top > 0, top)) - F.ln(F.when(bottom > 0, bottom))


def close_to_close(daily: DataFrame) -> DataFrame:
    order = Window.partitionBy("index_name").orderBy("session")
    return daily.withColumn("r", log_ratio(F.col("close"), F.lag("close").over(order)))


def range_variances(daily: DataFrame) -> DataFrame:
    """Overnight and open-to-close returns and the Parkinson variance of each session after the first."""
    order = Window.partitionBy("index_name").orderBy("session")
    out = daily.withColumn("overnight", log_ratio(F.col("open"), F.lag("close").over(order))).withColumn("intraday", log_ratio(F.col("close"), F.col("open")))
    return out.withColumn("parkinson", F.pow(log_ratio(F.col("high"), F.col("low")), F.lit(2.0)) / (4.0 * 0.6931471805599453)).filter("overnight IS NOT NULL")


def forecasts(returns: DataFrame, decay: float = DECAY) -> DataFrame:
    """Variance forecast of each return from those before it, and its square over the forecast (z2).

    The recurrence f -> decay * f + (1 - decay) * r ** 2 composes, so it is a scan by blocks: within a block a running sum of squares grown by the decay,
    across blocks what each hands to the next. A block is long enough that its weight is 1e-8, so what lies CARRIED blocks back weighs less than the
    smallest double, and no array is longer than that.
    """
    block = max(1, math.floor(math.log(1e-8) / math.log(decay)))
    order = Window.partitionBy("index_name").orderBy("session")
    rows = returns.filter("r IS NOT NULL").select("index_name", "session", "day", "r", (F.row_number().over(order) - 1).alias("i"), (F.col("r") * F.col("r")).alias("x"))
    rows = rows.withColumn("block", F.floor(F.col("i") / block)).withColumn("at", F.col("i") - F.col("block") * block)
    news = (1 - decay) * F.col("x") * F.pow(F.lit(decay), -F.col("at") - 1)
    within = Window.partitionBy("index_name", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("own", F.coalesce(F.sum(news).over(within), F.lit(0.0)))
    # a sum and a count of the first SEED squares, which may lie in several blocks
    first = F.col("i") < SEED
    sums = rows.groupBy("index_name", "block").agg((F.sum(news) * decay**block).alias("told"), F.sum(F.when(first, F.col("x"))).alias("s"), F.count_if(first).alias("n"))
    whole = Window.partitionBy("index_name")
    seed = F.sum("s").over(whole) / F.sum("n").over(whole)
    earlier = F.collect_list("told").over(whole.orderBy("block").rowsBetween(-CARRIED, -1))
    starts = sums.select("index_name", "block", F.aggregate(earlier, seed, lambda f, x: f * decay**block + x).alias("start"))
    found = inside.join(starts, ["index_name", "block"]).withColumn("forecast", F.pow(F.lit(decay), F.col("at")) * (F.col("start") + F.col("own")))
    return found.select("index_name", "session", "day", "r", "forecast", F.try_divide("x", "forecast").alias("z2"))


def front_returns(futures: DataFrame) -> DataFrame:
    """Log returns in percent of the contract that expires first on each day, from the day before of the same contract; rolls and jumps of ``GENUINE`` or more are left out."""
    live = futures.filter("settle > 0 AND vol > 0")
    front = live.groupBy("sym", "trade_date").agg(F.min_by(F.struct("expiry_no", "settle"), "expiry_no").alias("f")).select("sym", "trade_date", "f.*")
    order = Window.partitionBy("sym", "expiry_no").orderBy("trade_date")
    out = front.withColumn("r", 100 * log_ratio(F.col("settle"), F.lag("settle").over(order))).filter(F.abs("r") < GENUINE)
    return out.withColumn("sq", F.col("r") * F.col("r"))


def session_variance(returns: DataFrame) -> DataFrame:
    return returns.groupBy("trade_date").agg(F.avg("sq").alias("variance"), F.count("*").alias("n"))


def log_weights(z: DataFrame, *by: str) -> DataFrame:
    """Log of a weekday's mean of z2 over the mean of all weekdays, by unit (index_name), window and ``by``."""
    sums = z.groupBy(*by, "index_name", "window", "wd").agg(F.sum("z2").alias("s"), F.count("*").alias("n"))
    unit = Window.partitionBy(*by, "index_name", "window")
    return sums.withColumn("lw", log_ratio(F.col("s") / F.col("n"), F.sum("s").over(unit) / F.sum("n").over(unit)))


def changes(weights: DataFrame, *by: str) -> DataFrame:
    """Change of log weights from window 0 to window 1."""
    wide = weights.groupBy(*by, "index_name", "wd").agg(F.max(F.when(F.col("window") == 0, F.col("lw"))).alias("pre"), F.max(F.when(F.col("window") == 1, F.col("lw"))).alias("post"))
    return wide.withColumn("change", F.col("post") - F.col("pre"))


def differences(changed: DataFrame, control: Column) -> DataFrame:
    """Each unit's change less that of the control unit, by weekday."""
    held = changed.filter(F.col("index_name") == control).select("wd", F.col("change").alias("held"))
    return changed.filter(F.col("index_name") != control).join(F.broadcast(held), "wd").select("index_name", "wd", (F.col("change") - F.col("held")).alias("did"))


def pseudo_events(sessions: DataFrame, event: Column, blackout: tuple[Column, Column], reach: int = REACH, stride: int = STRIDE) -> DataFrame:
    """(tau, day, is_event): every ``stride`` sessions with ``reach`` on either side, windows neither across the event nor touching the blackout; and the event itself."""
    split = sessions.filter(F.col("day") >= event).agg(F.min("session").alias("split"))
    edges = sessions.select(F.col("session").alias("s"), F.col("day").alias("edge"))
    out = sessions.crossJoin(F.broadcast(split)).join(edges.select((F.col("s") + reach).alias("session"), F.col("edge").alias("lo")), "session").join(edges.select((F.col("s") - reach + 1).alias("session"), F.col("edge").alias("hi")), "session")
    star = F.col("session") == F.col("split")
    clear = ((F.col("session") - reach) % stride == 0) & ~((F.col("session") - reach < F.col("split")) & (F.col("split") < F.col("session") + reach)) & ~((F.col("lo") <= blackout[1]) & (F.col("hi") >= blackout[0]))
    return out.filter(star | clear).select(F.col("session").alias("tau"), "day", star.alias("is_event"))


def weekday_shift(events: DataFrame, sessions: DataFrame, squares: DataFrame, reach: int = REACH) -> DataFrame:
    """S at each event: log change of Tuesday's mean square less Thursday's. Squares are added up by session before the windows are laid out."""
    daily = squares.groupBy(F.col("trade_date").alias("day")).agg(F.sum("sq").alias("s"), F.count("*").alias("n")).join(sessions, "day").withColumn("wd", F.weekday("day")).filter("wd IN (1, 3)")
    laid = events.select("tau", "is_event", F.explode(F.sequence(F.col("tau") - reach, F.col("tau") + reach - 1)).alias("session")).join(daily, "session")
    post = F.col("session") >= F.col("tau")

    def mean(wd: int, when: Column) -> Column:
        own = when & (F.col("wd") == wd)
        return F.try_divide(F.sum(F.when(own, F.col("s"))), F.sum(F.when(own, F.col("n"))))

    value = log_ratio(mean(1, post), mean(1, ~post)) - log_ratio(mean(3, post), mean(3, ~post))
    return laid.groupBy("tau", "is_event").agg(value.alias("stat"))


def rank_p(stats: DataFrame) -> DataFrame:
    """The event's statistic among those of pseudo-events: lower-sided p, percentile, and whether it lies in the middle nine tenths. No row if the event has no statistic."""
    star = stats.filter("is_event AND stat IS NOT NULL").select(F.col("stat").alias("star"))
    null = stats.filter("NOT is_event AND stat IS NOT NULL").crossJoin(F.broadcast(star))
    out = null.groupBy("star").agg(F.count("*").alias("n"), F.count_if(F.col("stat") <= F.col("star")).alias("extreme"), F.avg((F.col("stat") < F.col("star")).cast("double")).alias("below"), F.median("stat").alias("null_median"))
    return out.select("star", "n", "null_median", (100 * F.col("below")).alias("percentile"), ((1 + F.col("extreme")) / (1 + F.col("n"))).alias("p"), F.col("below").between(0.05, 0.95).alias("inside"))


def disjoint(events: DataFrame, reach: int = REACH) -> DataFrame:
    """How many pseudo-events can be chosen, from the first on, without overlapping windows. The array holds one number per pseudo-event of a calendar."""
    taus = events.filter("NOT is_event").agg(F.array_sort(F.collect_list("tau")).alias("a"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(10**9)).cast("long").alias("last"))

    def take(state: Column, tau: Column) -> Column:
        fits = tau >= state["last"] + 2 * reach
        return F.struct((state["n"] + fits.cast("long")).alias("n"), F.when(fits, tau.cast("long")).otherwise(state["last"]).alias("last"))

    return taus.select(F.aggregate("a", start, take, lambda s: s["n"]).alias("n"))


def ratio_draws(values: DataFrame, draws: int) -> DataFrame:
    """Resampled ratios of mean ``x`` of sample 1 to sample 0: rows (sample, x, no), numbered from 0 within their sample; each draw picks by hash."""
    sizes = values.groupBy("sample").agg(F.count("*").alias("n"))
    picks = values.select("sample", F.col("no").alias("slot")).join(F.broadcast(sizes), "sample").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    picks = picks.withColumn("no", F.floor(random.uniform(F.col("sample"), F.col("draw"), F.col("slot")) * F.col("n")))
    means = picks.join(values, ["sample", "no"]).groupBy("draw").agg(F.avg(F.when(F.col("sample") == 1, F.col("x"))).alias("top"), F.avg(F.when(F.col("sample") == 0, F.col("x"))).alias("bottom"))
    return means.select("draw", F.try_divide("top", "bottom").alias("value"))


def interval(draws: DataFrame, *by: str) -> DataFrame:
    """2.5% and 97.5% points of finite values and how many are not finite."""
    value = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return draws.withColumn("value", value).groupBy(*by).agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"), F.count_if(F.col("value").isNull()).alias("not_finite"))


def week_multiplicity(weeks: DataFrame, draws: int) -> DataFrame:
    """How often each draw takes each week of a window, as many as there are: the same for all units. ``weeks``: (window, week, no), numbered from 0 within a window."""
    sizes = weeks.groupBy("window").agg(F.count("*").alias("k"))
    picks = weeks.select("window", F.col("no").alias("slot")).join(F.broadcast(sizes), "window").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    picks = picks.withColumn("no", F.floor(random.uniform(F.lit("week"), F.col("window"), F.col("draw"), F.col("slot")) * F.col("k")))
    return picks.groupBy("draw", "window", "no").agg(F.count("*").alias("times")).join(weeks, ["window", "no"]).select("draw", "window", "week", "times")


def reweighted(z: DataFrame, times: DataFrame) -> DataFrame:
    """Log weights by draw. Sums by week go before the draws, so the join grows with weeks and draws, not with rows."""
    weekly = z.groupBy("index_name", "window", "week", "wd").agg(F.sum("z2").alias("s"), F.count("*").alias("n"))
    each = weekly.join(times, ["window", "week"]).groupBy("draw", "index_name", "window", "wd").agg(F.sum(F.col("s") * F.col("times")).alias("s"), F.sum(F.col("n") * F.col("times")).alias("n"))
    unit = Window.partitionBy("draw", "index_name", "window")
    return each.withColumn("lw", log_ratio(F.col("s") / F.col("n"), F.sum("s").over(unit) / F.sum("n").over(unit)))
