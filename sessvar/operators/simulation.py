"""Hedged straddles on simulated paths whose variance follows a clock of weekday weights.

A path's steps are rows with counter-based normals, so paths need no order and any partitioning gives the same draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal, options, random
from .mispricing import DAILY_VARIANCE, SPOT, believed_variance

TRADERS = ("clock", "calendar")


def gbm_paths(spark: SparkSession, weights: DataFrame, half: int, per_session: int = 1) -> DataFrame:
    """Twice ``half`` paths, the second half mirrored: path, step, prices before and after the step, and the variance columns of the step."""
    steps = believed_variance(weights, per_session)
    draws = spark.range(half).select(F.col("id").alias("p")).crossJoin(F.broadcast(steps)).withColumn("u", random.uniform(F.lit("gbm"), F.col("p"), F.col("step")))
    draws = draws.withColumn("z", normal.inverse(F.col("u"))).withColumn("mirror", F.explode(F.array(F.lit(0), F.lit(1))))
    draws = draws.withColumn("move", -F.col("realised") / 2 + F.sqrt("realised") * F.col("z") * (1 - 2 * F.col("mirror"))).withColumn("path", F.col("p") + half * F.col("mirror"))
    order = Window.partitionBy("path").orderBy("step")
    before = F.coalesce(F.sum("move").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = draws.withColumn("from_price", SPOT * F.exp(before)).withColumn("to_price", SPOT * F.exp(F.sum("move").over(order)))
    return out.select("path", "step", "from_price", "to_price", *steps.columns[1:])


def hedged(paths: DataFrame, costs: tuple[float, ...]) -> DataFrame:
    """Profit of a short straddle hedged at each step, by path and cost in basis points: a column for each trader, and ``proxy``, the summed gamma of the calendar trader times excess belief.

    The hedge holds the straddle's delta at the variance that its trader believes is left, with the step's own.
    """
    order = Window.partitionBy("path").orderBy("step")
    left = {"clock": F.col("true_remaining"), "calendar": F.col("remaining")}
    out = paths.withColumn("last", F.lead("step").over(order).isNull())
    for name in TRADERS:
        root = F.sqrt(left[name])
        out = out.withColumn(f"d_{name}", F.ln(F.col("from_price") / SPOT) / root + root / 2).withColumn(f"hold_{name}", 2 * normal.cdf(F.col(f"d_{name}")) - 1)
        out = out.withColumn(f"trade_{name}", F.col(f"hold_{name}") - F.coalesce(F.lag(f"hold_{name}").over(order), F.lit(0.0)))
    total = F.sum("realised")
    gamma = F.col("from_price") * normal.pdf(F.col("d_calendar")) / F.sqrt("remaining")
    sums = [F.sum(F.col(f"trade_{n}") * F.col("from_price")).alias(f"paid_{n}") for n in TRADERS] + [F.sum(F.abs(f"trade_{n}") * F.col("from_price")).alias(f"turned_{n}") for n in TRADERS]
    sums += [F.sum(F.when(F.col("last"), F.col(f"hold_{n}") * F.col("to_price"))).alias(f"held_{n}") for n in TRADERS]
    of_path = out.groupBy("path").agg(*sums, F.sum(F.when(F.col("last"), F.col("to_price"))).alias("final"), F.sum(gamma * (F.col("believed") - F.col("realised"))).alias("proxy"), total.alias("total"))
    entry = options.straddle(F.lit(SPOT), F.lit(SPOT), F.lit(5 * DAILY_VARIANCE))
    of_path = of_path.withColumn("cost", F.explode(F.array(*(F.lit(c) for c in costs))))

    def pnl(n: str) -> Column:
        return entry - F.col(f"paid_{n}") - F.col(f"turned_{n}") * F.col("cost") * 1e-4 + F.col(f"held_{n}") - F.abs(F.col("final") - SPOT)

    return of_path.select("path", "cost", *(pnl(n).alias(n) for n in TRADERS), "proxy")


def pnl_summary(results: DataFrame) -> DataFrame:
    """Count, mean, population deviation and skew, and the lowest twentieth, by trader and cost."""
    long = results.unpivot(["path", "cost"], list(TRADERS), "trader", "pnl")
    return long.groupBy("trader", "cost").agg(F.count("*").alias("n"), F.avg("pnl").alias("mean"), F.stddev_pop("pnl").alias("sd"), F.skewness("pnl").alias("skew"), F.percentile("pnl", F.lit(0.05)).alias("p05"))


def hedging_shares(results: DataFrame) -> DataFrame:
    """Deviation of either trader and of their difference, and the difference's share of the clock trader's, by cost."""
    off = F.col("calendar") - F.col("clock")
    found = results.groupBy("cost").agg(F.stddev_pop("clock").alias("sd_clock"), F.stddev_pop("calendar").alias("sd_calendar"), F.avg(off).alias("mean_diff"), F.stddev_pop(off).alias("sd_diff"))
    return found.withColumn("share", F.col("sd_diff") / F.col("sd_clock"))


def proxy_fit(results: DataFrame) -> DataFrame:
    """How the gamma proxy of a path compares with the traders' difference at no cost: correlation and the gap's deviation relative to the difference's."""
    off = F.col("calendar") - F.col("clock")
    return results.filter("cost = 0").agg(F.corr("proxy", off).alias("correlation"), (F.stddev_pop(F.col("proxy") - off) / F.stddev_pop(off)).alias("relative_gap"), F.avg("proxy").alias("mean_proxy"))


def level_moments(levels: list[tuple[int, DataFrame, DataFrame | None]]) -> DataFrame:
    """Sums of the levels' corrections (level, n, s1, s2): ``results`` of a level, and those of the next coarser steps on the same draws.

    The quantity is the squared difference of the traders at no cost.
    """
    def square(results: DataFrame, name: str) -> DataFrame:
        return results.filter("cost = 0").select("path", F.pow(F.col("calendar") - F.col("clock"), F.lit(2.0)).alias(name))

    out = None
    for level, fine, coarse in levels:
        y = square(fine, "y") if coarse is None else square(fine, "f").join(square(coarse, "c"), "path").select("path", (F.col("f") - F.col("c")).alias("y"))
        part = y.agg(F.count("*").alias("n"), F.sum("y").alias("s1"), F.sum(F.col("y") * F.col("y")).alias("s2")).select(F.lit(level).alias("level"), "n", "s1", "s2")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("mean", F.col("s1") / F.col("n")).withColumn("variance", F.greatest(F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), F.lit(2.0)), F.lit(0.0)))


def coarser(paths: DataFrame) -> DataFrame:
    """The same paths at half as many steps a session: each two steps become one."""
    pair = F.floor(F.col("step") / 2)
    first, last = F.col("step") % 2 == 0, F.col("step") % 2 == 1
    firsts = [F.sum(F.when(first, F.col(c))).alias(c) for c in ("from_price", "elapsed", "remaining", "true_remaining")]
    return paths.groupBy("path", pair.alias("step")).agg(*firsts, F.sum(F.when(last, F.col("to_price"))).alias("to_price"), F.sum("realised").alias("realised"), F.sum("believed").alias("believed"))


def allocation(moments: DataFrame, tolerance: float, steps: int = 5) -> DataFrame:
    """Samples that each level needs for a standard error of tolerance over the root of two, at a cost of its steps, fine and coarse."""
    cost = steps * F.pow(F.lit(2.0), F.col("level")) * F.when(F.col("level") > 0, 1.5).otherwise(1.0)
    out = moments.withColumn("cost", cost)
    total = F.sum(F.sqrt(F.col("variance") * F.col("cost"))).over(Window.partitionBy(F.lit(1)))
    return out.withColumn("samples", F.ceil(2.0 / tolerance**2 * F.sqrt(F.col("variance") / F.col("cost")) * total))


def telescoped(moments: DataFrame) -> DataFrame:
    """The levels' sum, its standard error, the rate of decay of the corrections from level 1 on, and the sum carried on to the limit at rate one."""
    last = F.max_by("mean", "level")
    decay = -F.regr_slope(F.when(F.col("level") >= 1, F.log2(F.abs("mean"))), F.col("level").cast("double"))
    found = moments.agg(F.sum("mean").alias("estimate"), F.sqrt(F.sum(F.col("variance") / F.col("n"))).alias("error"), decay.alias("decay"), last.alias("last"))
    return found.select("estimate", "error", "decay", (F.col("estimate") + F.col("last")).alias("limit"))
