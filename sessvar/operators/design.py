"""Event designs over expiries and returns: roles, doses, shifts, expiry days against others, resampled dates, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import random
from . import calendar, returns

#: Decay of the slower forecast; draws of the date bootstrap.
SLOW, DATE_DRAWS = 0.97, 100
#: Draws of the ratios of variances.
RATIO_DRAWS = 400


def _part(day: str, pre: tuple[str, str], post: tuple[str, str]) -> Column:
    return F.when(F.col(day).between(*(F.lit(d).cast("date") for d in pre)), 0).when(F.col(day).between(*(F.lit(d).cast("date") for d in post)), 1)


def modal_weekdays(expiries: DataFrame) -> DataFrame:
    """The commonest weekday of expiries by symbol and part; ties to the one that comes first."""
    counted = expiries.groupBy("symbol", "part", F.weekday("expiry").cast("long").alias("wd")).agg(F.count("*").alias("n"), F.min("expiry").alias("first"))
    return counted.groupBy("symbol", "part").agg(F.min_by("wd", F.struct(-F.col("n"), F.col("first"))).alias("wd"))


def roles(expiries: DataFrame, days: DataFrame, pre: tuple[str, str], post: tuple[str, str]) -> DataFrame:
    """Of each symbol: treated if its modal expiry weekday differs between the windows, else control; both weekdays; and doses,
    the share of that weekday's sessions that are its own expiries. ``place`` orders a role's symbols by the later dose."""
    inside = expiries.withColumn("part", _part("expiry", pre, post)).filter("part is not null")
    pool = days.select("day", _part("day", pre, post).alias("part"), F.weekday("day").cast("long").alias("wd"))
    own = expiries.select(F.col("symbol").alias("s"), F.col("expiry").alias("e"))
    flagged = modal_weekdays(inside).join(pool, ["part", "wd"]).join(own, (F.col("s") == F.col("symbol")) & (F.col("e") == F.col("day")), "left")
    doses = flagged.groupBy("symbol", "part", "wd").agg(F.avg(F.col("e").isNotNull().cast("double")).alias("dose"))
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    wide = doses.groupBy("symbol").agg(of(0, "wd").alias("old_wd"), of(1, "wd").alias("new_wd"), of(0, "dose").alias("dose_pre"), of(1, "dose").alias("dose_post"))
    kind = F.when(F.col("old_wd") != F.col("new_wd"), "treated").otherwise("control")
    known = wide.filter("old_wd is not null and new_wd is not null").withColumn("role", kind)
    return known.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy("dose_post", "symbol")))


def shifts(changed: DataFrame, old: int, new: int) -> DataFrame:
    """S of each unit: the change of the new weekday's log weight less that of the old one's."""
    of = lambda wd: F.max(F.when(F.col("wd") == wd, F.col("change")))
    return changed.groupBy("index_name").agg((of(new) - of(old)).alias("s"))


def ratios(shifted: DataFrame, full: str) -> DataFrame:
    """Each unit's shift over that of the unit of full dose; null over nothing. A row per unit."""
    base = shifted.filter(F.col("index_name") == full).select(F.col("s").alias("full"))
    return shifted.join(F.broadcast(base)).withColumn("ratio", F.try_divide("s", "full"))


def worst(z: DataFrame) -> DataFrame:
    """The session of largest standardised square by unit and window; ties to the earliest."""
    return z.filter("z2 is not null").groupBy("index_name", "window").agg(F.min_by(F.struct("day", "z2"), F.struct(-F.col("z2"), F.col("day"))).alias("w")).select("index_name", "window", "w.*")


def estimators(daily: DataFrame) -> DataFrame:
    """(index_name, day, estimator, value): squared returns from close to close, overnight and from open to close, and the Parkinson variance."""
    found = returns.range_variances(returns.close_to_close(daily))
    square = lambda c: F.col(c) * F.col(c)
    # the first session has an intraday range, but nothing before it
    first = daily.withColumn("r", F.lit(None).cast("double")).withColumn("overnight", F.lit(None).cast("double")).withColumn("intraday", returns.log_ratio(F.col("close"), F.col("open")))
    first = first.withColumn("parkinson", F.pow(returns.log_ratio(F.col("high"), F.col("low")), F.lit(2.0)) / (4.0 * 0.6931471805599453))
    rest = first.join(found.select("index_name", "session"), ["index_name", "session"], "left_anti").unionByName(found)
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("estimator"), v.alias("value")) for n, v in (("close_close", square("r")), ("overnight", square("overnight")), ("open_close", square("intraday")), ("parkinson", F.col("parkinson"))))))
    return rest.select("index_name", "day", values.alias("v")).select("index_name", "day", "v.*").filter("value is not null")


def decomposition(daily: DataFrame, expiries: DataFrame) -> DataFrame:
    """Squared returns and Parkinson variances on expiry days over those on other days, mean and median, by index and estimator.

    Medians of one index are those of its calendar's days.
    """
    flagged = estimators(daily).join(F.broadcast(expiries.select("day", F.lit(True).alias("on_expiry"))), "day", "left")
    on, off = F.when(F.col("on_expiry"), F.col("value")), F.when(F.col("on_expiry").isNull(), F.col("value"))
    sums = flagged.groupBy("index_name", "estimator").agg(F.count(on).alias("n_expiry"), F.count(off).alias("n_other"), F.try_divide(F.avg(on), F.avg(off)).alias("mean_ratio"), F.try_divide(F.median(on), F.median(off)).alias("median_ratio"))
    return sums


def resampled_ratios(values: DataFrame, keys: list[str], draws: int = RATIO_DRAWS) -> DataFrame:
    """(keys, draw, stat, value): mean and median of ``value`` of sample 1 over those of sample 0, for each draw of as many values as a sample has, by hash;
    draw 0 is the samples as they are.

    ``values``: keys, sample, value, and ``tie``, which orders equal values. A draw is how often it takes each value. Values are ranked once, so a draw's
    median lies where its numbers, added up in that order, pass the middle.
    """
    one = [*keys, "sample"]
    ranked = values.select(*one, "value", (F.row_number().over(Window.partitionBy(*one).orderBy("value", "tie")) - 1).cast("long").alias("no"))
    sizes = values.groupBy(*one).agg(F.count("*").alias("n"))
    slots = ranked.select(*one, F.col("no").alias("slot")).join(sizes, one).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    picked = F.when(F.col("draw") == 0, F.col("slot")).otherwise(F.floor(random.uniform(F.lit("ratio"), *(F.col(k) for k in one), F.col("draw"), F.col("slot")) * F.col("n")))
    times = slots.groupBy(*one, "n", "draw", picked.alias("no")).agg(F.count("*").alias("times")).join(ranked, [*one, "no"])
    before = F.coalesce(F.sum("times").over(Window.partitionBy(*one, "draw").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = times.withColumn("before", before)
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("times")), F.col("value")))
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.ceil((F.col("n") - 1) / 2))) / 2
    stats = placed.groupBy(*one, "draw").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("mean"), middle.alias("median"))
    side = lambda sample, c: F.max(F.when(F.col("sample") == sample, F.col(c)))
    both = stats.groupBy(*keys, "draw").agg(*(F.try_divide(side(1, c), side(0, c)).alias(c) for c in ("mean", "median")))
    return both.select(*keys, "draw", F.explode(F.array(*(F.struct(F.lit(c).alias("stat"), F.col(c).alias("value")) for c in ("mean", "median")))).alias("s")).select(*keys, "draw", "s.*")


def ratio_table(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """Point, 95% interval over finite draws, how many were not finite, and whether the interval leaves out 1."""
    by = [*keys, "stat"]
    points = ratios.filter("draw = 0").select(*by, F.col("value").alias("ratio"))
    spans = returns.interval(ratios.filter("draw > 0"), *by)
    return points.join(spans, by).withColumn("apart", ~((F.col("low") < 1) & (F.col("high") > 1)))


def index_samples(daily: DataFrame, expiries: DataFrame, split: Column) -> DataFrame:
    """Values of :func:`estimators` by part, before and after ``split``: sample 1 on expiry days."""
    flagged = estimators(daily).join(F.broadcast(expiries.select("day").distinct().withColumn("on", F.lit(1))), "day", "left")
    return flagged.select(F.when(F.col("day") < split, "pre").otherwise("post").alias("part"), "estimator", F.coalesce("on", F.lit(0)).alias("sample"), "value", F.col("day").alias("tie"))


def stock_samples(returns_: DataFrame, expiries: DataFrame, split: Column) -> DataFrame:
    """Session means of squared stock returns (sym, trade_date, expiry_no, sq) by contrast: any index expiry against other sessions, before and after ``split``, and against
    sessions on which neither an index nor the contract expires, weekly index expiries of contracts that go on and monthly ones of contracts that end too.

    ``expiries``: nominal, expiry, tenor of the index. Stocks of one session share its shock, so a session is one value. A contract ends on its month's monthly expiry.
    """
    monthly = expiries.filter("tenor = 'monthly'")
    days = expiries.groupBy(F.col("expiry").alias("trade_date")).agg(F.max(F.when(F.col("tenor") == "monthly", 2).otherwise(1)).alias("kind"))
    ends = monthly.select(F.col("expiry").alias("trade_date"), (F.year("nominal") * 12 + F.month("nominal")).cast("long").alias("expiry_no"), F.lit(True).alias("ends")).distinct()
    flagged = returns_.join(F.broadcast(days), "trade_date", "left").join(F.broadcast(ends), ["trade_date", "expiry_no"], "left")
    kind, ends_ = F.coalesce("kind", F.lit(0)), F.coalesce("ends", F.lit(False))
    part = F.when(F.col("trade_date") < split, "any_expiry_pre").otherwise("any_expiry_post")
    quiet = (kind == 0) & ~ends_
    contrasts = F.array(
        F.struct(part.alias("contrast"), F.when(kind > 0, 1).otherwise(0).alias("sample")),
        F.struct(F.lit("weekly_going_on").alias("contrast"), F.when((kind == 1) & ~ends_, 1).when(quiet, 0).alias("sample")),
        F.struct(F.lit("monthly_ending_too").alias("contrast"), F.when((kind == 2) & ends_, 1).when(quiet, 0).alias("sample")),
    )
    laid = flagged.select("trade_date", "sq", F.explode(contrasts).alias("c")).select("trade_date", "sq", "c.*").filter("sample IS NOT NULL")
    return laid.groupBy("contrast", "sample", "trade_date").agg(F.avg("sq").alias("value")).withColumnRenamed("trade_date", "tie")


def date_multiplicity(days: DataFrame, draws: int = DATE_DRAWS) -> DataFrame:
    """How often each draw takes each date, as many as there are. ``days``: day, session numbered from 0."""
    size = days.agg(F.count("*").alias("k"))
    picks = days.select("session").join(F.broadcast(size)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    picks = picks.select("draw", F.floor(random.uniform(F.lit("date"), F.col("draw"), F.col("session")) * F.col("k")).alias("session"))
    return picks.groupBy("draw", "session").agg(F.count("*").alias("times")).join(days, "session").select("draw", "day", "times")


def with_sessions(panel: DataFrame, calendar_: DataFrame) -> DataFrame:
    """Numbers of the sessions of trade date and expiry, and those between; the calendar is a row a day and broadcast. What is not in the calendar is null."""
    at = lambda day, name: F.broadcast(calendar_.select(F.col("day").alias(day), F.col("session").alias(name)))
    both = panel.join(at("trade_date", "session"), "trade_date", "left").join(at("expiry", "expiry_session"), "expiry", "left")
    return both.withColumn("dte_trd", F.col("expiry_session") - F.col("session"))


def timeline(expiries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Regimes of each symbol, rolls off them, and weekend sessions."""
    regimes = calendar.regimes(expiries)
    rolls = calendar.rolls(expiries, regimes).select(F.lit("roll").alias("what"), "symbol", F.col("expiry").alias("start"), "wd", "regime_wd", "days_early", "kind")
    weekend = calendar.weekend_sessions(sessions).select(F.lit("weekend").alias("what"), F.col("day").alias("start"), "wd", F.col("classification").alias("kind"))
    found = regimes.select(F.lit("regime").alias("what"), "symbol", "start", "end", F.col("regime_wd").cast("int").alias("regime_wd"), "n")
    return found.unionByName(rolls, allowMissingColumns=True).unionByName(weekend, allowMissingColumns=True)
