"""Randomization of an event's date: its statistic beside those of every pseudo design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import returns

WEEKDAYS = range(5)


def running_sums(z: DataFrame, sessions: DataFrame, units: tuple[str, ...]) -> DataFrame:
    """(index_name, session) with the sums of z2 (``s0`` to ``s4``) and counts (``n0`` to ``n4``) of each weekday up to that session.

    A window's sum is a difference of two of these rows, so designs cost the same however long their windows are.
    """
    by_day = z.groupBy("index_name", "session").agg(*(F.sum(F.when(F.col("wd") == k, F.col("z2"))).alias(f"s{k}") for k in WEEKDAYS), *(F.count_if((F.col("wd") == k) & F.col("z2").isNotNull()).alias(f"n{k}") for k in WEEKDAYS))
    grid = sessions.select("session", F.explode(F.array(*map(F.lit, units))).alias("index_name"))
    upto = Window.partitionBy("index_name").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    columns = [f"{c}{k}" for c in "sn" for k in WEEKDAYS]
    return grid.join(by_day, ["index_name", "session"], "left").select("index_name", "session", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in columns))


def did_designs(pseudo: DataFrame, sessions: DataFrame, blackout: tuple[Column, Column], reach: int = returns.REACH) -> DataFrame:
    """(is_event, tau, pre_from, pre_to, post_from, post_to) as sessions: pseudo designs are contiguous, the true one stops before the blackout and goes on after it."""
    taus = pseudo.filter("NOT is_event").select(F.lit(False).alias("is_event"), "tau", F.col("tau").alias("later"))
    edges = sessions.agg(F.min(F.when(F.col("day") >= blackout[0], F.col("session"))).alias("tau"), F.min(F.when(F.col("day") > blackout[1], F.col("session"))).alias("later"))
    every = taus.unionByName(edges.select(F.lit(True).alias("is_event"), "tau", "later"))
    return every.select("is_event", "tau", (F.col("tau") - reach).alias("pre_from"), (F.col("tau") - 1).alias("pre_to"), F.col("later").alias("post_from"), (F.col("later") + reach - 1).alias("post_to"))


def did_by_design(designs: DataFrame, sums: DataFrame, treated: str, control: str, weekday: int) -> DataFrame:
    """``did``: the change of the weekday's log weight from the window before to that after, of the treated unit less that of the control; null where a window lacks it."""
    edge = lambda window, sign, at: F.struct(F.lit(window).alias("window"), F.lit(sign).alias("sign"), at.alias("session"))
    four = F.explode(F.array(edge(0, -1, F.col("pre_from") - 1), edge(0, 1, F.col("pre_to")), edge(1, -1, F.col("post_from") - 1), edge(1, 1, F.col("post_to"))))
    # a session before the first has no row and counts as nothing
    looked = designs.withColumn("e", four).select(*designs.columns, "e.*").join(sums.filter(F.col("index_name").isin(treated, control)), "session")
    by = [*designs.columns, "index_name", "window"]
    total = lambda c: F.sum(F.col("sign") * F.col(c))
    found = looked.groupBy(*by).agg(*(total(f"{c}{k}").alias(f"{c}{k}") for c in "sn" for k in WEEKDAYS))
    everything = lambda c: sum((F.col(f"{c}{k}") for k in WEEKDAYS), F.lit(0.0))
    weight = returns.log_ratio(F.try_divide(F.col(f"s{weekday}"), F.col(f"n{weekday}")), F.try_divide(everything("s"), everything("n")))
    weighed = found.withColumn("lw", weight)
    side = lambda unit, window: F.max(F.when((F.col("index_name") == unit) & (F.col("window") == window), F.col("lw")))
    return weighed.groupBy(*designs.columns).agg(((side(treated, 1) - side(treated, 0)) - (side(control, 1) - side(control, 0))).alias("did"))


def ranked(stats: DataFrame, sign: int, *by: str) -> DataFrame:
    """The event's ``stat`` among those of pseudo-events: how many, their median and 5% and 95% points, percentile, p on the side that ``sign`` expects, and whether it lies in the middle
    nine tenths. Without a statistic of the event there is no row."""
    star = stats.filter("is_event AND stat IS NOT NULL").select(*by, F.col("stat").alias("star"))
    null = stats.filter("NOT is_event AND stat IS NOT NULL")
    null = null.join(F.broadcast(star), list(by)) if by else null.crossJoin(F.broadcast(star))
    extreme = F.col("stat") <= F.col("star") if sign < 0 else F.col("stat") >= F.col("star")
    out = null.groupBy(*by, "star").agg(F.count("*").alias("n"), F.median("stat").alias("null_median"), F.percentile("stat", F.lit(0.05)).alias("q05"), F.percentile("stat", F.lit(0.95)).alias("q95"), F.count_if(extreme).alias("extreme"), F.avg((F.col("stat") < F.col("star")).cast("double")).alias("below"))
    return out.select(*by, "star", "n", "null_median", "q05", "q95", (100 * F.col("below")).alias("percentile"), ((1 + F.col("extreme")) / (1 + F.col("n"))).alias("p"), F.col("below").between(0.05, 0.95).alias("inside"))
