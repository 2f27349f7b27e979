"""The clock fitted on either side of every pseudo date of a calendar: the options channel of a randomization.

Quotes of one symbol that span the same sessions differ in nothing but noise, so they are first added up to a number and a mean, and the rest costs
what the calendar costs, however many quotes there are. From the sessions (t, es] of such a row follows which windows hold it whole: those that begin
at es - reach + 1 or later and at t or before. Windows are taken in runs of neighbours, a task a run and symbol, and each fit starts
where the one before it ended.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import clock
from .clock_windows import WEEK, Quotes, levels

#: Windows of a run.
RUN = 16
#: Kinds of session: Monday to Friday, weekend.
KINDS = 6
AMONG = [*range(len(clock.DAYS)), clock.PARAMETERS.index("weekend")]

_FIT = "symbol string, start long, " + ", ".join(f"{d} double" for d in WEEK) + ", condition double, n_obs long, refusal string"


def _times(quotes: DataFrame) -> Column:
    return F.col("n") if "n" in quotes.columns else F.lit(1.0)


def grouped(quotes: DataFrame) -> DataFrame:
    """(symbol, t, es) with the number of quotes ``n`` and their mean ``y``. Rows that are such means already bring their ``n``."""
    return quotes.filter("es > t AND ln_var IS NOT NULL").groupBy("symbol", "t", "es").agg(F.sum(_times(quotes)).alias("n"), F.try_divide(F.sum(F.col("ln_var") * _times(quotes)), F.sum(_times(quotes))).alias("y"))


def window_starts(designs: DataFrame, reach: int) -> list[int]:
    """First sessions of the windows before and after each date (``tau``): no more than the calendar has sessions, so they are collected."""
    found = designs.select(F.explode(F.array(F.col("tau") - reach, F.col("tau"))).alias("start")).distinct().collect()
    return sorted(r["start"] for r in found)


def runs_of(rows: DataFrame, starts: list[int], sessions: int, reach: int) -> DataFrame:
    """Rows by the runs whose windows hold them whole: ``run`` is added. Looked up by session, so no interval is compared with another."""
    below = np.searchsorted(starts, np.arange(sessions + 1))
    places = rows.sparkSession.createDataFrame(list(enumerate(below.tolist())), "session long, below long")
    first = F.greatest(F.col("es") - reach + 1, F.lit(0))
    placed = rows.withColumns({"from": first, "upto": F.col("t") + 1})
    placed = placed.join(places.select(F.col("session").alias("from"), F.col("below").alias("low")), "from").join(places.select(F.col("session").alias("upto"), F.col("below").alias("high")), "upto")
    # windows low to high - 1 hold the row
    return placed.filter("high > low").withColumn("run", F.explode(F.sequence(F.expr(f"low div {RUN}"), F.expr(f"(high - 1) div {RUN}")))).select("run", "symbol", "t", "es", "n", "y")


def counts_of(t: np.ndarray, es: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sessions by pattern of every row's (t, es], and of all sessions that any row spans. ``kinds``: the kind of each session of the calendar."""
    upto = np.zeros((len(kinds) + 1, len(clock.FEATURES)))
    upto[1:][np.arange(len(kinds)), 4 * kinds] = 1
    upto = np.cumsum(upto, axis=0)
    covered = np.zeros(len(kinds) + 1, int)
    np.add.at(covered, t + 1, 1)
    np.add.at(covered, es + 1, -1)
    spanned = np.bincount(4 * kinds[np.cumsum(covered)[:-1] > 0], minlength=len(clock.FEATURES)).astype(float)
    return upto[es + 1] - upto[t + 1], spanned


def fitted(t: np.ndarray, es: np.ndarray, n: np.ndarray, y: np.ndarray, kinds: np.ndarray, warm: tuple[list[int], np.ndarray] | None) -> tuple[tuple, tuple[list[int], np.ndarray] | None]:
    """One window's log weights Monday to Friday, condition number, quotes and refusal; and where the next fit may start. Rows are sorted by t."""
    total = int(n.sum())
    refused = lambda reason: ((*[None] * 5, None, total, reason), None)
    if total < clock.LEAST_ROWS:
        return refused(f"{total} observations")
    counts, spanned = counts_of(t, es, kinds)
    kept = clock.identifiable(spanned, AMONG)
    if not kept or total - len(np.unique(t)) - len(kept) <= 0:
        return refused("no residual degree of freedom")
    quotes, features = Quotes(counts, t, y, n), clock.FEATURES[:, kept]
    root = np.sqrt(n)[:, None]
    if np.linalg.matrix_rank(root * quotes.linearised(np.zeros(len(kept)), features)[1]) < len(kept):
        return refused("demeaned design of too low a rank")
    start = warm[1] if warm is not None and warm[0] == kept else np.zeros(len(kept))
    theta = quotes.solved(features, start, np.ones(len(quotes.sizes)))
    if theta is None:
        return refused("least squares did not settle")
    low = np.linalg.svd(root * quotes.linearised(theta, features)[1], compute_uv=False)
    weights = levels(theta, kept, spanned)
    condition = float(low[0] / low[-1]) if low[-1] > 0 else float("inf")
    return (*(float(np.log(weights[d])) for d in WEEK), condition, total, ""), (kept, theta)


def window_fits(quotes: DataFrame, calendar: DataFrame, starts: list[int], reach: int) -> DataFrame:
    """symbol, start, the log weights, condition, n_obs and refusal of every window that holds a quote. ``calendar``: session, from 0, and weekday ``wd``; a row a day, collected."""
    days = sorted(((r["session"], r["wd"]) for r in calendar.select("session", "wd").collect()))
    kinds = np.minimum(np.array([wd for _, wd in days]), KINDS - 1)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        def each() -> Iterator[tuple]:
            t, es, n, y = (rows.sort_values(["t", "es"])[c].to_numpy() for c in ("t", "es", "n", "y"))
            run, symbol = key
            warm = None
            for start in starts[int(run) * RUN : (int(run) + 1) * RUN]:
                own = (t >= start) & (es <= start + reach - 1)
                if own.any():
                    found, warm = fitted(t[own], es[own], n[own], y[own], kinds, warm)
                    yield symbol, start, *found

        return pd.DataFrame(each(), columns=[c.split()[0] for c in _FIT.split(", ")])

    return runs_of(grouped(quotes), starts, len(kinds), reach).groupBy("run", "symbol").applyInPandas(solve, _FIT)


def shifts(designs: DataFrame, fits: DataFrame, symbol: str, old: str, new: str, reach: int) -> DataFrame:
    """(tau, is_event) with ``s``, the change of the new weekday's log weight less that of the old one's, the worse condition and the largest log weight
    of the two fits; ``s`` is null and both others infinite where a fit is refused."""
    extreme = F.greatest(*(F.abs(F.col(d)) for d in WEEK))
    own = fits.filter((F.col("symbol") == symbol) & (F.col("refusal") == "")).select("start", (F.col(new) - F.col(old)).alias("gap"), "condition", extreme.alias("extreme"))
    side = lambda name: own.select(*(F.col(c).alias(f"{name}_{c}") for c in own.columns))
    both = designs.select("tau", "is_event").join(side("pre"), F.col("tau") - reach == F.col("pre_start"), "left").join(side("post"), F.col("tau") == F.col("post_start"), "left")
    known = F.col("pre_gap").isNotNull() & F.col("post_gap").isNotNull()
    worse = lambda c: F.when(known, F.greatest(f"pre_{c}", f"post_{c}")).otherwise(float("inf"))
    return both.select("tau", "is_event", (F.col("post_gap") - F.col("pre_gap")).alias("s"), worse("condition").alias("cond"), worse("extreme").alias("logw"))


def options_channel(quotes: DataFrame, calendar: DataFrame, designs: DataFrame, symbols: tuple[str, str], old: str, new: str, reach: int) -> DataFrame:
    """Of every date the statistic and health of both symbols' fits and their difference ``did``."""
    fits = scratch.saved(window_fits(quotes, calendar, window_starts(designs, reach), reach), "pseudo-fits")
    out = None
    for name in symbols:
        own = shifts(designs, fits, name, old, new, reach)
        own = own.select("tau", "is_event", *(F.col(c).alias(f"{c}_{name.lower()}") for c in ("s", "cond", "logw")))
        out = own if out is None else out.join(own, ["tau", "is_event"])
    a, b = (f"s_{n.lower()}" for n in symbols)
    return out.withColumn("did", F.col(a) - F.col(b))


def healthy(symbols: tuple[str, str]) -> Column:
    """Dates whose four fits are well conditioned and have no weight outside the range."""
    most = float(np.log(clock.HIGH_WEIGHT))
    return F.forall(F.array(*itertools.chain.from_iterable(((F.col(f"cond_{n.lower()}") <= clock.MOST_CONDITION), (F.col(f"logw_{n.lower()}") <= most)) for n in symbols)), lambda ok: ok)
