"""Dose response: the clock before and after events, in index returns and in option quotes, as one long table of estimates with intervals.

Both channels give log weights of weekdays by event, variant, draw, unit and part (0 before the event, 1 after); draw 0 is the estimate itself. Every
statistic is a sum of such weights with coefficients that follow from the units' roles, so statistics and weights meet in one join, and an
interval is that of the statistic's own draws: within a draw all units have the same weeks, or the same dates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import random
from . import clock, pseudo_fits, returns
from .clock_windows import WEEK, Quotes, levels

CASE = ("event", "variant")
WEIGHT = (*CASE, "draw", "unit", "part", "wd", "lw", "n")
#: Draws of either channel.
WEEK_DRAWS, DATE_DRAWS = 2000, 300


def roles(expiries: DataFrame, days: DataFrame, windows: DataFrame) -> DataFrame:
    """Of every unit (symbol) in every case: role, old and new weekday and the dose of each, the share of that weekday's sessions that are its own expiries.

    ``windows``: event, variant, part, start, end; a few rows, as the units are few. The commonest weekday counts; ties to the one that comes first.
    """
    inside = lambda day: (day >= F.col("start")) & (day <= F.col("end"))
    small = F.broadcast(windows)
    own = expiries.select("symbol", "expiry").distinct()
    placed = own.join(small, inside(F.col("expiry"))).groupBy(*CASE, "part", "symbol", F.weekday("expiry").cast("long").alias("wd")).agg(F.count("*").alias("m"), F.min("expiry").alias("first"))
    modal = placed.groupBy(*CASE, "part", "symbol").agg(F.min_by("wd", F.struct(-F.col("m"), F.col("first"))).alias("wd"))
    pool = days.select("day", F.weekday("day").cast("long").alias("wd")).join(small, inside(F.col("day"))).select(*CASE, "part", "day", "wd")
    marked = modal.join(pool, [*CASE, "part", "wd"]).join(own.select("symbol", F.col("expiry").alias("day"), F.lit(1.0).alias("own")), ["symbol", "day"], "left")
    doses = marked.groupBy(*CASE, "symbol", "part", "wd").agg(F.avg(F.coalesce("own", F.lit(0.0))).alias("dose"))
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    wide = doses.groupBy(*CASE, F.col("symbol").alias("unit")).agg(of(0, "wd").alias("old_wd"), of(1, "wd").alias("new_wd"), of(0, "dose").alias("dose_pre"), of(1, "dose").alias("dose_post"))
    return wide.filter("old_wd IS NOT NULL AND new_wd IS NOT NULL").withColumn("treated", F.col("old_wd") != F.col("new_wd"))


def coefficients(found: DataFrame) -> DataFrame:
    """event, variant, quantity, symbol, label, and one row for each weight (unit, part, wd) in it with its ``coef``, out of ``terms``.

    One treated and one control unit: the difference in differences on the treated one's old weekday, their gap before, and the control's own change.
    Two treated units: each one's shift from old to new weekday.
    """
    by = Window.partitionBy(*CASE)
    counted = found.withColumns({"n_treated": F.count_if("treated").over(by), "n_units": F.count("*").over(by)})
    counted = counted.withColumns({"other": F.max(F.when(~F.col("treated"), F.col("unit"))).over(by), "other_wd": F.max(F.when(~F.col("treated"), F.col("old_wd"))).over(by)})

    def statistic(quantity: str, symbol: Column, label: Column, *terms: tuple[Column, int, Column, int]) -> Column:
        rows = F.array(*(F.struct(u.alias("unit"), F.lit(part).alias("part"), wd.alias("wd"), F.lit(coef).alias("coef")) for u, part, wd, coef in terms))
        return F.struct(F.lit(quantity).alias("quantity"), symbol.alias("symbol"), label.alias("label"), rows.alias("terms"))

    unit, other, old, new, own = (F.col(c) for c in ("unit", "other", "old_wd", "new_wd", "other_wd"))
    name = lambda wd: F.element_at(F.array(*map(F.lit, WEEK)), wd.cast("int") + 1)
    pair = F.array(
        statistic("did", unit, name(old), (unit, 1, old, 1), (unit, 0, old, -1), (other, 1, old, -1), (other, 0, old, 1)),
        statistic("level_gap_pre", unit, name(old), (unit, 0, old, 1), (other, 0, old, -1)),
        statistic("delta_own", other, name(own), (other, 1, own, 1), (other, 0, own, -1)),
    )
    both = F.array(statistic("S", unit, F.concat_ws("->", name(old), name(new)), (unit, 1, new, 1), (unit, 0, new, -1), (unit, 1, old, -1), (unit, 0, old, 1)))
    kind = F.when((F.col("n_treated") == 1) & (F.col("n_units") == 2), pair).when((F.col("n_treated") == 2) & (F.col("n_units") == 2), both)
    laid = counted.filter("treated").withColumn("q", F.explode(kind)).select(*CASE, "q.quantity", "q.symbol", "q.label", F.size("q.terms").alias("terms"), F.explode("q.terms").alias("t"))
    return laid.select(*CASE, "quantity", "symbol", "label", "terms", "t.*")


def dose_pairs(found: DataFrame) -> DataFrame:
    """Cases of two treated units: the one of the lower later dose and the one of the higher; ties by name."""
    two = found.groupBy(*CASE).agg(F.count_if("treated").alias("k"), F.count("*").alias("m"), F.array_sort(F.collect_list(F.struct("dose_post", "unit"))).alias("u"))
    return two.filter("k = 2 AND m = 2").select(*CASE, F.col("u")[0]["unit"].alias("low"), F.col("u")[1]["unit"].alias("high"))


def week_weights(z: DataFrame, draws: int = WEEK_DRAWS) -> DataFrame:
    """WEIGHT rows of the returns channel from standardised squares (event, variant, part, unit, day, wd, z2): whole weeks are drawn, the same for all units of a case's part.

    Squares are added up by week before the draws, so those grow with weeks.
    """
    weekly = z.groupBy(*CASE, "part", "unit", F.trunc("day", "week").alias("week"), "wd").agg(F.sum("z2").alias("s"), F.count("z2").alias("n"))
    weeks = z.select(*CASE, "part", F.trunc("day", "week").alias("week")).distinct()
    one = Window.partitionBy(*CASE, "part")
    numbered = weeks.withColumns({"no": (F.row_number().over(one.orderBy("week")) - 1).cast("long"), "k": F.count("*").over(one)})
    picks = numbered.select(*CASE, "part", "no", "k", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    drawn = F.floor(random.uniform(F.lit("dose"), *(F.col(c) for c in CASE), F.col("part"), F.col("draw"), F.col("no")) * F.col("k"))
    times = picks.groupBy(*CASE, "part", "draw", F.when(F.col("draw") == 0, F.col("no")).otherwise(drawn).alias("no")).agg(F.count("*").alias("times"))
    times = times.join(numbered.select(*CASE, "part", "no", "week"), [*CASE, "part", "no"]).drop("no")
    sums = weekly.join(times, [*CASE, "part", "week"]).groupBy(*CASE, "draw", "unit", "part", "wd").agg(F.sum(F.col("s") * F.col("times")).alias("s"), F.sum(F.col("n") * F.col("times")).alias("n"))
    whole = Window.partitionBy(*CASE, "draw", "unit", "part")
    lw = returns.log_ratio(F.try_divide("s", "n"), F.sum("s").over(whole) / F.sum("n").over(whole))
    return sums.withColumn("lw", lw).select(*WEIGHT)


_DRAWN = "event string, variant string, draw int, unit string, part int, wd int, lw double, n long, condition double, refusal string"


def date_weights(quotes: DataFrame, calendar: DataFrame, windows: DataFrame, draws: int = DATE_DRAWS) -> DataFrame:
    """WEIGHT rows of the options channel and each fit's condition and refusal: one fit for each unit, case and part, and one for each draw of whole dates, the same
    dates for all units. A task has a unit's window: its calendar's sessions times its maturities, however many quotes there are.

    A refused fit is one row without weights; a draw that does not settle has none.
    """
    days = sorted((r["day"], r["session"], r["wd"]) for r in calendar.select("day", "session", "wd").collect())
    kinds = np.minimum(np.array([wd for *_, wd in days]), pseudo_fits.KINDS - 1)
    spans = windows.join(F.broadcast(calendar), (F.col("day") >= F.col("start")) & (F.col("day") <= F.col("end"))).groupBy(*CASE, "part").agg(F.min("session").alias("low"), F.max("session").alias("high"))
    rows = pseudo_fits.grouped(quotes).join(F.broadcast(spans), (F.col("t") >= F.col("low")) & (F.col("es") <= F.col("high")))

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        event, variant, part, unit = key

        def each() -> Iterator[tuple]:
            group.sort_values(["t", "es"], inplace=True)
            t, es, n, y = (group[c].to_numpy() for c in ("t", "es", "n", "y"))
            low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
            found, warm = pseudo_fits.fitted(t, es, n, y, kinds, None)
            if warm is None:
                yield event, variant, 0, unit, part, None, None, int(n.sum()), None, found[-1]
                return
            for wd, lw in enumerate(found[:5]):
                yield event, variant, 0, unit, part, wd, lw, int(n.sum()), found[5], ""
            kept, theta = warm
            counts, spanned = pseudo_fits.counts_of(t, es, kinds)
            quotes_, features = Quotes(counts, t, y, n), clock.FEATURES[:, kept]
            dates = t[quotes_.starts] - low
            for draw in range(1, draws + 1):
                picks = np.random.default_rng([int(part), draw]).integers(0, high - low + 1, high - low + 1)
                drawn = quotes_.solved(features, theta, np.bincount(picks, minlength=high - low + 1)[dates])
                if drawn is not None:
                    weights = levels(drawn, kept, spanned)
                    for wd, name in enumerate(WEEK):
                        yield event, variant, draw, unit, part, wd, float(np.log(weights[name])), 0, None, ""

        return pd.DataFrame(each(), columns=[c.split()[0] for c in _DRAWN.split(", ")])

    return rows.groupBy(*CASE, "part", F.col("symbol").alias("unit")).applyInPandas(solve, _DRAWN)


def readable(fits: DataFrame, units: int = 2) -> DataFrame:
    """Whether all of a case's fits are, ``units`` before and as many after: well conditioned and without a weight outside the range. A case with a refused or missing fit is not."""
    point = fits.filter("draw = 0")
    fine = (F.col("refusal") == "") & (F.col("condition") <= clock.MOST_CONDITION) & (F.abs("lw") <= float(np.log(clock.HIGH_WEIGHT)))
    return point.groupBy(*CASE).agg((F.min(F.coalesce(fine, F.lit(False))) & (F.count_distinct("unit", "part") == 2 * units)).alias("readable"))


def estimates(weights: DataFrame, found: DataFrame) -> DataFrame:
    """event, variant, quantity, symbol, label, estimate, low and high (95% over finite draws), not_finite and n: the weights themselves and the statistics of ``found``, the roles."""
    name = F.element_at(F.array(*map(F.lit, WEEK)), F.col("wd").cast("int") + 1)
    own = weights.filter("wd IS NOT NULL").select(*CASE, "draw", F.when(F.col("part") == 0, "ln_w_pre").otherwise("ln_w_post").alias("quantity"), F.col("unit").alias("symbol"), name.alias("label"), F.col("lw").alias("value"), F.when(F.col("draw") == 0, F.col("n")).alias("n"))
    keys = [*CASE, "draw", "quantity", "symbol", "label"]
    met = weights.join(F.broadcast(coefficients(found)), [*CASE, "unit", "part", "wd"])
    # a sum lacks a value where any of its weights does; a draw without all of them has none
    stats = met.groupBy(*keys, "terms").agg(F.when((F.count("*") == F.col("terms")) & (F.count("lw") == F.col("terms")), F.sum(F.col("lw") * F.col("coef"))).alias("value"))
    shifts = stats.filter("quantity = 'S'").join(F.broadcast(dose_pairs(found)), list(CASE))
    side = lambda c: F.max(F.when(F.col("symbol") == F.col(c), F.col("value")))
    ratio = shifts.groupBy(*CASE, "draw", "low", "high").agg(F.try_divide(side("low"), side("high")).alias("value"))
    ratio = ratio.select(*CASE, "draw", F.lit("dose_ratio").alias("quantity"), F.col("low").alias("symbol"), F.concat_ws("/", "low", "high").alias("label"), "value")
    every = own.unionByName(stats.drop("terms"), allowMissingColumns=True).unionByName(ratio, allowMissingColumns=True)
    by = [*CASE, "quantity", "symbol", "label"]
    points = every.filter("draw = 0").groupBy(*by).agg(F.max("value").alias("estimate"), F.max("n").alias("n"))
    return points.join(returns.interval(every.filter("draw > 0"), *by), by, "left")
