"""The clock within windows of a symbol's calendar: points, intervals from resampled dates, and what tells a fit that cannot be relied on.

A window takes the observations whose whole span lies in it. Each is fitted without and with the macro events; the expiry day
has no multiplier of its own there, since within one regime it is nearly a weekday. All fits and draws are one job: a group is a
window and BATCH draws. Dates whose quotes span the same sessions are one shape, a few hundred in any calendar; a fit needs no more of them than
how often they were drawn and their quotes' means, so a group holds a number and a few values a date and fits shapes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from . import clock

#: Draws of a whole regime and of a half of one, and the effects beside the weekdays by specification. Draws a task makes.
FULL_DRAWS, HALF_DRAWS, BATCH = 300, 100, 25
#: Sessions whose dates lie in one row of :func:`blocks`.
BLOCK = 8192
SPECS = {"weekday": ("weekend",), "macro": ("weekend", "macro_event")}
WEEK = ("Mon", *clock.DAYS)
WINDOW = ("symbol", "label", "half")
FIT = (*WINDOW, "spec")
PATTERNS = [f"p{p}" for p in range(len(clock.FEATURES))]
RAW = """symbol string, label string, half string, spec string, draw int, parameter string, value double, vif double, condition double,
    n_obs long, n_dates long, rmse double, dropped string, refusal string"""


def halves(regimes: DataFrame) -> DataFrame:
    """Windows of each regime (symbol, regime_wd, start, end): the whole, and its two halves by the calendar. A weekday that comes back is numbered."""
    again = F.row_number().over(Window.partitionBy("symbol", "regime_wd").orderBy("start"))
    label = F.concat(F.element_at(F.array(*map(F.lit, WEEK)), F.col("regime_wd").cast("int") + 1), F.lit(" regime"), F.when(again > 1, F.concat(F.lit(" "), again.cast("string"))).otherwise(""))
    middle = F.date_add("start", F.floor(F.datediff("end", "start") / 2).cast("int"))

    def part(half: str, start: Column, end: Column, rule: str, draws: int) -> Column:
        return F.struct(F.lit(half).alias("half"), start.alias("start"), end.alias("end"), F.lit(rule).alias("split_rule"), F.lit(draws).alias("n_boot"))

    parts = F.array(
        part("full", F.col("start"), F.col("end"), "", FULL_DRAWS),
        part("h1", F.col("start"), middle, "calendar midpoint", HALF_DRAWS),
        part("h2", F.date_add(middle, 1), F.col("end"), "calendar midpoint", HALF_DRAWS),
    )
    # numbered before the explode, which would else come first
    named = regimes.filter("regime_wd < 5").withColumn("label", label)
    return named.select("symbol", "label", F.explode(parts).alias("w")).select("symbol", "label", "w.*")


def inside(observations: DataFrame, windows: DataFrame) -> DataFrame:
    """Observations (with opened and expiry days) by window. Windows are few: one symbol's meet its rows by the equal symbol."""
    return observations.join(windows, "symbol").filter("opened >= start AND expiry <= end").select(*windows.columns, "obs_id", "t", "opened", "ln_var", *(c for c in observations.columns if c in ("es", *PATTERNS)))


class Quotes:
    """One window's observations as arrays, sorted by date, with log variances less their date's mean. A row may stand for ``n`` alike ones and their mean."""

    def __init__(self, counts: np.ndarray, dates: np.ndarray, ln_var: np.ndarray, n: np.ndarray | None = None) -> None:
        self.counts, self.n = counts, np.ones(len(dates)) if n is None else n
        self.starts = np.flatnonzero(np.concatenate([[True], dates[1:] != dates[:-1]]))
        self.sizes = np.diff(np.append(self.starts, len(dates)))
        self.totals = np.add.reduceat(self.n, self.starts)
        self.y = self.demeaned(ln_var[:, None])[:, 0]

    def demeaned(self, values: np.ndarray) -> np.ndarray:
        return values - np.repeat(np.add.reduceat(values * self.n[:, None], self.starts, axis=0) / self.totals[:, None], self.sizes, axis=0)

    def linearised(self, theta: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals, and how the fitted values move with each parameter."""
        weighed = self.counts * np.exp(features @ theta)
        total = weighed.sum(axis=1, keepdims=True)
        moved = self.demeaned(np.hstack([np.log(total), weighed @ features / total]))
        return self.y - moved[:, 0], moved[:, 1:]

    def solved(self, features: np.ndarray, start: np.ndarray, times: np.ndarray, rounds: int = 60) -> np.ndarray | None:
        """Least squares with each date counted ``times`` over, by damped Gauss-Newton steps; None if it does not settle."""
        weight = np.repeat(times, self.sizes) * self.n
        theta, damping = start, 1e-3
        error, slope = self.linearised(theta, features)
        loss = weight @ error**2
        for _ in range(rounds):
            jtj, pull = slope.T @ (slope * weight[:, None]), slope.T @ (weight * error)
            step = np.linalg.lstsq(jtj + damping * np.diag(np.diag(jtj) + 1e-12), pull, rcond=None)[0]
            with np.errstate(all="ignore"):
                tried, tilt = self.linearised(theta + step, features)
                now = weight @ tried**2
            if np.isfinite(now) and now <= loss:
                theta, error, slope, loss, damping = theta + step, tried, tilt, now, damping / 10
                if np.abs(step).max() < 1e-9:
                    return theta
            elif np.abs(step).max() < 1e-9:
                return theta
            else:
                damping *= 10
        return None


def levels(theta: np.ndarray, kept: list[int], sessions: np.ndarray) -> dict[str, float]:
    """Weekday levels, scaled so that the window's sessions average one, and the multipliers that were fitted."""
    whole = np.zeros(len(clock.PARAMETERS))
    whole[kept] = theta
    scale = sessions @ np.exp(clock.FEATURES @ whole) / sessions.sum()
    out = dict(zip(WEEK, (np.exp(np.concatenate([[0.0], whole[:4]])) / scale).tolist(), strict=True))
    return out | {clock.PARAMETERS[k]: float(np.exp(whole[k])) for k in kept if k >= len(clock.DAYS)}


class Shapes:
    """A window's dates by shape: the sessions by pattern of each of their quotes. Dates of a shape differ in their log variances alone."""

    def __init__(self, blocks: pd.DataFrame) -> None:
        blocks = blocks.sort_values("block")
        names = sorted({name for own in blocks["shapes"] for name in own})
        number = {name: i for i, name in enumerate(names)}
        codes = [np.array([number[name] for name in own])[np.frombuffer(b, np.int32)] for own, b in zip(blocks["shapes"], blocks["codes"], strict=True)]
        self.codes, values = np.concatenate(codes), np.concatenate([np.frombuffer(b) for b in blocks["ln_var"]])
        rows = [name.split("|") for name in names]
        sizes = np.array([len(r) for r in rows])
        self.n, self.dates = len(values), len(self.codes)
        self.of = np.repeat(np.arange(len(names)), sizes)
        self.quotes = Quotes(np.array([q.split() for r in rows for q in r], float), self.of, np.zeros(len(self.of)))
        # of each quote its date and its place among the rows of shapes, quotes of a date one after another
        own = sizes[self.codes]
        self.date = np.repeat(np.arange(self.dates), own)
        self.place = np.arange(self.n) - np.repeat(np.cumsum(own) - own, own) + np.repeat(self.quotes.starts[self.codes], own)
        self.values = values - (np.bincount(self.date, values) / own)[self.date]

    def drawn(self, times: np.ndarray) -> np.ndarray:
        """How often each shape occurs if each date counts ``times`` over; the shapes' quotes become the means of these dates'."""
        counted = np.bincount(self.codes, times, len(self.quotes.sizes))
        sums = np.bincount(self.place, times[self.date] * self.values, len(self.of))
        self.quotes.y = self.quotes.demeaned((sums / np.maximum(counted, 1)[self.of])[:, None])[:, 0]
        return counted


def fits_and_draws(shapes: Shapes, sessions: np.ndarray, spec: str, first: int, draws: int) -> Iterator[tuple]:
    """Rows of RAW after the keys: the point as draw -1 if ``first`` is 0, and draws from ``first`` on. A draw that does not settle is left out."""
    among = [k for k, name in enumerate(clock.PARAMETERS) if k < len(clock.DAYS) or name in SPECS[spec]]
    kept = clock.identifiable(sessions, among)
    quotes, features = shapes.quotes, clock.FEATURES[:, kept]
    n, dates = shapes.n, shapes.dates
    dropped = ",".join(clock.PARAMETERS[k] for k in among if k not in kept)
    reason, theta = "", None
    each = shapes.drawn(np.ones(dates))
    # rows of shapes as heavy as all that are alike: the design's products, singular values and rank are those of the quotes
    heavy = np.sqrt(each)[shapes.of][:, None]
    if n < clock.LEAST_ROWS:
        reason = f"{n} observations"
    elif not kept or n - dates - len(kept) <= 0:
        reason = "no residual degree of freedom"
    elif _rank(quotes.linearised(np.zeros(len(kept)), features)[1] * heavy, n) < len(kept):
        reason = "demeaned design of too low a rank"
    else:
        theta = quotes.solved(features, np.zeros(len(kept)), each)
        reason = "" if theta is not None else "least squares did not settle"
    if theta is None:
        if first == 0:
            yield from ((-1, day, None, None, None, n, dates, None, dropped, reason) for day in WEEK)
        return
    if first == 0:
        error, slope = quotes.linearised(theta, features)
        whole, slope = shapes.values - (quotes.y - error)[shapes.place], slope * heavy
        low = np.linalg.svd(slope, compute_uv=False)
        spread = np.diag(np.linalg.pinv(slope.T @ slope)) * (slope**2).sum(axis=0)
        vif = {clock.PARAMETERS[k]: float(s) for k, s in zip(kept, spread, strict=True)}
        condition = float(low[0] / low[-1]) if low[-1] > 0 else float("inf")
        for name, value in levels(theta, kept, sessions).items():
            yield -1, name, value, vif.get(name), condition, n, dates, float(np.sqrt(np.mean(whole**2))), dropped, ""
    for draw in range(first, min(first + BATCH, draws)):
        times = np.bincount(np.random.default_rng([0, draw]).integers(0, dates, dates), minlength=dates)
        found = quotes.solved(features, theta, shapes.drawn(times))
        if found is not None:
            yield from ((draw, name, value, None, None, n, dates, None, dropped, "") for name, value in levels(found, kept, sessions).items())


def _rank(design: np.ndarray, n: int) -> int:
    """The rank of ``n`` rows that ``design`` stands for."""
    values = np.linalg.svd(design, compute_uv=False)
    return int((values > values.max() * max(n, design.shape[1]) * np.finfo(float).eps).sum())


def _fit_group(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    *names, first = key
    columns = [part.split()[0] for part in RAW.split(",")]
    shapes, sessions, draws = Shapes(blocks), np.array(blocks["sessions"].iloc[0], float), int(blocks["n_boot"].iloc[0])
    return pd.DataFrame([(*names, spec, *r) for spec in SPECS for r in fits_and_draws(shapes, sessions, spec, int(first), draws)], columns=columns)


def _block(key: tuple, dates: pd.DataFrame) -> pd.DataFrame:
    dates = dates.sort_values("t")
    codes, shapes = pd.factorize(dates["shape"])
    values = np.concatenate([np.asarray(v, float) for v in dates["ln_var"]])
    return pd.DataFrame([(*key, dates["sessions"].iloc[0], shapes.tolist(), codes.astype(np.int32).tobytes(), values.tobytes())])


def blocks(rows: DataFrame) -> DataFrame:
    """Windows of :func:`designed` in rows of BLOCK sessions' dates: their shapes, each date's shape by its number among these, and log variances, all by date."""
    quote = F.struct(F.concat_ws(" ", *PATTERNS).alias("counts"), "ln_var")
    by = (*WINDOW, "n_boot")
    dates = rows.groupBy(*by, "t").agg(F.sort_array(F.collect_list(quote)).alias("q"), F.first("sessions").alias("sessions"))
    flat = dates.select(*by, F.floor(F.col("t") / BLOCK).alias("block"), "t", "sessions", F.array_join("q.counts", "|").alias("shape"), F.col("q.ln_var").alias("ln_var"))
    kinds = dict(flat.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, "block", "sessions")) + ", shapes array<string>, codes binary, ln_var binary"
    return flat.groupBy(*by, "block").applyInPandas(_block, schema)


def designed(observations: DataFrame, patterns: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window's observations with their sessions by pattern, and the window's distinct sessions by pattern in ``sessions``."""
    spans = clock.spanned(inside(observations, windows).drop("split_rule"), patterns)
    by = (*WINDOW, "n_boot")
    # made distinct first: a distinct count of each pattern would lay out every row once for each
    distinct = spans.select(*WINDOW, "pattern", "session").distinct()
    sessions = distinct.groupBy(*WINDOW).agg(F.array(*(F.count_if(F.col("pattern") == p) for p in range(len(PATTERNS)))).alias("sessions"))
    each = [F.count_if(F.col("pattern") == p).alias(name) for p, name in enumerate(PATTERNS)]
    return spans.groupBy(*by, "obs_id", "t", "opened", "ln_var").agg(*each).join(sessions, list(WINDOW))


def resampled(rows: DataFrame) -> DataFrame:
    """Points and draws (RAW) of every window of :func:`designed`, by both specifications."""
    first = F.explode(F.sequence(F.lit(0), F.col("n_boot") - 1, F.lit(BATCH)))
    # of few bytes, which would else be few tasks
    tasks = blocks(rows).withColumn("first", first).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *WINDOW, "first")
    return tasks.groupBy(*WINDOW, "first").applyInPandas(_fit_group, RAW)


def fit_table(raw: DataFrame, windows: DataFrame) -> DataFrame:
    """A row for each window, specification and parameter: the point, its 95% interval over draws, the share of draws outside the range, and
    why the fit is flagged, if it is. A refused fit has rows of nulls; a window without observations has none in ``raw`` and gets them here."""
    outside = ~F.col("value").between(clock.LOW_WEIGHT, clock.HIGH_WEIGHT)
    over = raw.filter("draw >= 0").groupBy(*FIT, "parameter").agg(
        F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"), F.count("*").alias("n_draws"), F.avg(outside.cast("double")).alias("boundary_share")
    )
    whole = Window.partitionBy(*FIT)
    weekday = F.col("parameter").isin(*WEEK)
    beyond = F.sort_array(F.collect_list(F.when(outside, F.concat_ws(" ", "parameter", F.round("value", 3).cast("string")))).over(whole))
    steep = F.when(F.col("condition") > clock.MOST_CONDITION, F.concat(F.lit("condition "), F.round("condition", 1).cast("string")))
    refused = F.when(F.col("refusal") != "", F.concat(F.lit("refused: "), F.col("refusal")))
    points = raw.filter("draw = -1").withColumns({
        "flag": F.coalesce(refused, F.concat_ws("; ", steep, beyond)),
        "weekdays_in_range": F.coalesce(F.min(F.when(weekday, ~outside)).over(whole), F.lit(False)),
    })
    every = windows.withColumn("spec", F.explode(F.array(*map(F.lit, SPECS))))
    empty = every.join(points.select(*FIT).distinct(), list(FIT), "left_anti").select(*FIT, F.explode(F.array(*map(F.lit, WEEK))).alias("parameter"))
    empty = empty.select(*FIT, "parameter", F.lit(0).cast("long").alias("n_obs"), F.lit("refused: 0 observations").alias("flag"), F.lit(False).alias("weekdays_in_range"))
    found = points.drop("draw", "refusal").unionByName(empty, allowMissingColumns=True).join(over, [*FIT, "parameter"], "left")
    return windows.join(found, list(WINDOW)).withColumnRenamed("value", "point").withColumn("identified", F.col("flag") == "")


def macro_shift(fits: DataFrame) -> DataFrame:
    """How far each parameter of a whole regime moves when macro events are told apart."""
    of = lambda spec: F.max(F.when(F.col("spec") == spec, F.col("point"))).alias(spec)
    wide = fits.where("half = 'full'").groupBy("symbol", "label", "start", "parameter").agg(*map(of, SPECS))
    return wide.select("*", (F.try_divide("macro", "weekday") - 1).alias("rel_change")).dropna(subset=list(SPECS))


def observed_and_fitted(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """Observations of the whole regimes, less their date's mean, beside the fit of the weekdays."""
    points = raw.filter("draw = -1 AND half = 'full' AND spec = 'weekday' AND value IS NOT NULL")
    wide = points.groupBy("symbol", "label", "half").pivot("parameter", [*WEEK, "weekend"]).agg(F.first("value"))
    kinds = [*map(F.col, WEEK), F.col("Mon") * F.coalesce("weekend", F.lit(1.0))]
    total = sum((F.col(name) * kinds[p // 4] for p, name in enumerate(PATTERNS)), F.lit(0.0))
    lined = rows.join(wide, list(WINDOW)).withColumns({"fitted": F.ln(total), "sessions": sum((F.col(p) for p in PATTERNS), F.lit(0))})
    for name in ("ln_var", "fitted"):
        lined = clock.demeaned(lined, name, "symbol", "label", "t")
    return lined.select("symbol", "label", "obs_id", "opened", F.date_format("opened", "E").alias("open_weekday"), "sessions", F.col("ln_var_dev").alias("observed_dm"), F.col("fitted_dev").alias("fitted_dm"))


def identification(observed: DataFrame, most_sessions: int = 12, least: int = 5) -> DataFrame:
    """Mean observed and fitted term structure by opening weekday: where the same count of sessions spans other weekdays."""
    by = observed.filter(F.col("sessions") <= most_sessions).groupBy("symbol", "label", "open_weekday", "sessions")
    return by.agg(F.avg("observed_dm").alias("observed_dm"), F.avg("fitted_dm").alias("fitted_dm"), F.count("*").alias("n")).filter(F.col("n") >= least)


def business_time(raw: DataFrame) -> DataFrame:
    """Variance accumulated over an expiry cycle, from the session after the expiry weekday to the next, five in all, with its 95% band."""
    days = raw.filter("half = 'full' AND spec = 'weekday' AND value IS NOT NULL").filter(F.col("parameter").isin(*WEEK))
    number = F.array_position(F.array(*map(F.lit, WEEK)), F.col("parameter")) - F.array_position(F.array(*map(F.lit, WEEK)), F.substring("label", 1, 3))
    one = Window.partitionBy("symbol", "label", "draw")
    share = days.withColumn("place", F.pmod(number - 1, F.lit(5)) + 1).withColumn("share", 5 * F.col("value") / F.sum("value").over(one))
    grown = share.withColumn("cum", F.sum("share").over(one.orderBy("place")))
    keys = ("symbol", "label", "place", F.col("parameter").alias("session"))
    drawn = F.when(F.col("draw") >= 0, F.col("cum"))
    ends = grown.groupBy(*keys).agg(F.max(F.when(F.col("draw") < 0, F.col("cum"))).alias("clock_cum"), F.percentile(drawn, 0.025).alias("lo"), F.percentile(drawn, 0.975).alias("hi"))
    zero = [F.lit(0.0).alias(c) for c in ("clock_cum", "lo", "hi")]
    return ends.unionByName(ends.select("symbol", "label").distinct().select("symbol", "label", F.lit(0).cast("long").alias("place"), F.lit("start").alias("session"), *zero))


def stability(fits: DataFrame) -> DataFrame:
    """The expiry weekday's own weight in every fit: whole regimes by both specifications, halves by weekdays alone."""
    own = fits.filter("parameter = substring(label, 1, 3) AND (half = 'full' OR spec = 'weekday')")
    return own.select("symbol", "label", "start", "half", "spec", "parameter", "point", "lo", "hi", "condition", "identified")


def saved_fits(observations: DataFrame, patterns: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`designed` and :func:`resampled`, each written once."""
    rows = scratch.saved(designed(observations, patterns, windows), "clock-windows")
    return rows, scratch.saved(resampled(rows), "clock-draws")
