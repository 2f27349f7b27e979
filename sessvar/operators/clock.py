"""The weekday clock behind at-the-money variances: ln V(t, T) = ln s(t) + ln of the summed weights of the sessions in (t, T]."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: Parameters in order, Monday pinned at zero; fewest observations; fewest sessions of a parameter; largest condition number and range of weights that pass unflagged.
DAYS = ("Tue", "Wed", "Thu", "Fri")
LEAST_ROWS, LEAST_SESSIONS = 50, 3
MOST_CONDITION, LOW_WEIGHT, HIGH_WEIGHT = 30.0, 0.1, 10.0


def bridge(observations: DataFrame) -> DataFrame:
    """A row for each session that an observation's variance spans: laid out from its bounds, so no range join is planned."""
    return observations.withColumn("session", F.explode(F.sequence(F.col("t") + 1, F.col("es")))).withColumn("wd", F.col("session") % 5)


def design(bridged: DataFrame) -> DataFrame:
    """Sessions of each weekday by observation."""
    return bridged.groupBy("obs_id", "symbol", "t", "ln_var").agg(*(F.count_if(F.col("wd") == k).alias(f"n_{d}") for k, d in enumerate(("Mon", *DAYS))))


def demeaned(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.withColumn(f"{value}_dev", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))


def identified(rows: DataFrame) -> DataFrame:
    """Observations that share their date and symbol with another: a lone one only sets its own scale."""
    return rows.withColumn("m", F.count("*").over(Window.partitionBy("symbol", "t"))).filter("m >= 2").drop("m")


def fit(rows: DataFrame, rounds: int = 25) -> DataFrame:
    """Least squares of the demeaned log variances by damped Gauss-Newton steps, each one aggregation over all observations.

    Five numbers a symbol reach the driver, and their cross products: symbols are a handful whatever the rows. Returns symbol,
    weights scaled to mean one, rows, condition number and ``verdict``: ok, flagged, or refused with null weights.
    """
    rows = identified(rows)
    used = {r["symbol"]: r for r in rows.groupBy("symbol").agg(F.count("*").alias("n"), *(F.count_if(F.col(f"n_{d}") > 0).alias(d) for d in DAYS)).collect()}
    theta = {s: np.zeros(4) for s, r in used.items() if r["n"] >= LEAST_ROWS and min(r[d] for d in DAYS) >= LEAST_SESSIONS}
    condition = dict.fromkeys(theta, math.inf)
    best: dict[str, tuple[float, np.ndarray]] = {}
    damping = dict.fromkeys(theta, 1e-3)
    systems: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for _ in range(rounds if theta else 0):
        for symbol, (loss, jtj, jtr) in _normal_equations(rows, theta).items():
            if symbol not in best or loss <= best[symbol][0]:
                best[symbol], systems[symbol], damping[symbol] = (loss, theta[symbol]), (jtj, jtr), damping[symbol] / 10
                condition[symbol] = math.sqrt(np.linalg.cond(jtj))
            else:
                damping[symbol] *= 10
            jtj, jtr = systems[symbol]
            theta[symbol] = best[symbol][1] + np.linalg.lstsq(jtj + damping[symbol] * np.diag(np.diag(jtj) + 1e-12), jtr, rcond=None)[0]
    found = []
    for symbol, r in sorted(used.items()):
        if symbol not in best or not condition[symbol] < 1e8:
            found.append((symbol, int(r["n"]), *[None] * 6, "refused"))
            continue
        weights = np.exp(np.concatenate([[0.0], best[symbol][1]]))
        weights /= weights.mean()
        odd = condition[symbol] > MOST_CONDITION or weights.min() < LOW_WEIGHT or weights.max() > HIGH_WEIGHT
        found.append((symbol, int(r["n"]), *map(float, weights), condition[symbol], "flagged" if odd else "ok"))
    schema = "symbol string, n long, " + ", ".join(f"{d} double" for d in ("Mon", *DAYS)) + ", condition double, verdict string"
    return rows.sparkSession.createDataFrame(found, schema)


def _normal_equations(rows: DataFrame, theta: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    def of_symbol(k: int) -> Column:
        out = F.lit(None).cast("double")
        for symbol, values in theta.items():
            out = F.when(F.col("symbol") == symbol, float(math.exp(values[k]))).otherwise(out)
        return out

    live = rows.filter(F.col("symbol").isin(*theta))
    weighed = live.select("symbol", "t", "ln_var", "n_Mon", *(F.col(f"n_{d}") * of_symbol(k) for k, d in enumerate(DAYS)))
    weighed = weighed.toDF("symbol", "t", "y", "mon", *DAYS).withColumn("total", sum((F.col(d) for d in DAYS), F.col("mon")))
    parts = weighed.select("symbol", "t", (F.col("y") - F.ln("total")).alias("e"), *((F.col(d) / F.col("total")).alias(d) for d in DAYS))
    for name in ("e", *DAYS):
        parts = demeaned(parts, name, "symbol", "t")
    dev = [F.col(f"{n}_dev") for n in ("e", *DAYS)]
    sums = [F.sum(dev[i] * dev[j]).alias(f"s{i}{j}") for i in range(5) for j in range(i, 5)]
    out = {}
    for r in parts.groupBy("symbol").agg(*sums).collect():
        jtj = np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(1, 5)] for i in range(1, 5)])
        out[r["symbol"]] = (r["s00"], jtj, np.array([r[f"s0{i}"] for i in range(1, 5)]))
    return out


#: What a session is charged to: its weekday or the weekend, and whether it is an expiry day and a macro event. A pattern's number is 4 * kind + 2 * expiry + macro.
EXTRA = ("weekend", "expiry_day", "macro_event")
PARAMETERS = (*DAYS, *EXTRA)
FEATURES = np.array([[*(kind == k for k in range(1, 6)), bool(p & 2), bool(p & 1)] for kind in range(6) for p in range(4)], float)


def session_patterns(sessions: DataFrame, symbols: DataFrame, expiries: DataFrame, macro: DataFrame) -> DataFrame:
    """(symbol, session, pattern) of a real calendar: ``sessions`` (day, session), ``expiries`` (symbol, expiry) and ``macro`` (day)."""
    flagged = sessions.join(F.broadcast(macro.select("day").distinct().withColumn("macro", F.lit(1))), "day", "left").crossJoin(symbols)
    marked = flagged.join(expiries.select("symbol", F.col("expiry").alias("day"), F.lit(1).alias("ends")).distinct(), ["symbol", "day"], "left")
    number = 4 * F.least(F.weekday("day"), F.lit(5)) + 2 * F.coalesce("ends", F.lit(0)) + F.coalesce("macro", F.lit(0))
    return marked.select("symbol", "session", number.alias("pattern"))


def spanned(observations: DataFrame, patterns: DataFrame) -> DataFrame:
    """A row for each session in (t, T] of an observation, with its pattern."""
    return observations.filter("es > t").withColumn("session", F.explode(F.sequence(F.col("t") + 1, F.col("es")))).join(patterns, ["symbol", "session"])


def flagged_design(spans: DataFrame) -> DataFrame:
    """Sessions of each pattern by observation."""
    return spans.groupBy("obs_id", "symbol", "t", "ln_var").agg(*(F.count_if(F.col("pattern") == p).alias(f"p{p}") for p in range(len(FEATURES))))


def identifiable(counts: np.ndarray, among: Sequence[int] = range(len(PARAMETERS))) -> list[int]:
    """Parameters of ``among`` that distinct sessions, so many of each pattern, can tell: on LEAST_SESSIONS sessions at least, and then less, one by one, those that are combinations of others, the least certain first."""
    kept = [k for k in among if counts @ FEATURES[:, k] >= LEAST_SESSIONS]
    while len(kept) > 1:
        active = FEATURES[:, kept] * np.sqrt(counts)[:, None]
        if np.linalg.matrix_rank(active) == len(kept):
            break
        # only a column that the others can replace goes; of equals the last, so that a weekday carries what an expiry day adds
        rank, spread = np.linalg.matrix_rank(active), np.diag(np.linalg.pinv(active.T @ active))
        spare = [i for i in range(len(kept)) if np.linalg.matrix_rank(np.delete(active, i, axis=1)) == rank]
        kept.pop(max(spare, key=lambda i: (round(float(spread[i]), 12), i)))
    return kept


def fit_sessions(observations: DataFrame, patterns: DataFrame, rounds: int = 25) -> DataFrame:
    """The clock of weekdays, weekend, expiry day and macro events, as :func:`fit` but over a real calendar.

    What a symbol's sessions cannot tell is dropped and named, the rest is fitted. Weekdays are levels, scaled so that
    the sessions' fitted weights average one; the others multiply a weekday. ``on_<day>`` and ``on_<day>_expiry`` combine
    a weekday with the expiry day, relative to Monday. Refused with null weights: fewer than LEAST_ROWS observations,
    no residual degree of freedom, or a demeaned design of too low a rank.
    """
    spans = spanned(observations, patterns)
    rows = scratch.saved(flagged_design(spans), "clock-design")
    sizes = {r["symbol"]: (r["n"], r["dates"]) for r in rows.groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("t").alias("dates")).collect()}
    sessions = {s: np.zeros(len(FEATURES)) for s in sizes}
    for r in spans.groupBy("symbol", "pattern").agg(F.count_distinct("session").alias("n")).collect():
        sessions[r["symbol"]][r["pattern"]] = r["n"]
    kept = {s: identifiable(c) for s, c in sessions.items()}
    theta = {s: np.zeros(len(PARAMETERS)) for s, (n, dates) in sizes.items() if n >= LEAST_ROWS and kept[s] and n - dates - len(kept[s]) > 0}
    best: dict[str, tuple[float, np.ndarray]] = {}
    condition: dict[str, float] = {}
    damping = dict.fromkeys(theta, 1e-3)
    systems: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for turn in range(rounds):
        if not theta:
            break
        moved = 0.0
        for symbol, (loss, jtj, jtr) in _pattern_equations(rows, theta).items():
            own = kept[symbol]
            jtj, jtr = jtj[np.ix_(own, own)], jtr[own]
            if turn == 0 and np.linalg.matrix_rank(jtj, hermitian=True) < len(own):
                del theta[symbol]
                continue
            if symbol not in best or loss <= best[symbol][0]:
                best[symbol], systems[symbol], damping[symbol] = (loss, theta[symbol]), (jtj, jtr), damping[symbol] / 10
                condition[symbol] = math.sqrt(np.linalg.cond(jtj))
            else:
                damping[symbol] *= 10
            jtj, jtr = systems[symbol]
            step = np.linalg.lstsq(jtj + damping[symbol] * np.diag(np.diag(jtj) + 1e-12), jtr, rcond=None)[0]
            theta[symbol] = best[symbol][1].copy()
            theta[symbol][own] += step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-10:
            break
    names = ["Mon", *PARAMETERS, *(f"on_{d}{e}" for d in ("Mon", *DAYS) for e in ("", "_expiry"))]
    found = []
    for symbol, (n, _) in sorted(sizes.items()):
        if symbol not in best:
            found.append((symbol, n, *[None] * len(names), None, None, None, "refused"))
            continue
        value, own = best[symbol][1], kept[symbol]
        raw = np.exp(np.concatenate([[0.0], value[:4]]))
        levels = raw * sessions[symbol].sum() / (sessions[symbol] @ np.exp(FEATURES @ value))
        extra = [float(np.exp(value[k])) if k in own else None for k in range(4, len(PARAMETERS))]
        combined = [float(w * e) for w in raw for e in (1.0, math.exp(value[5]))]
        weights = [*map(float, levels), *(e for e in extra if e is not None)]
        odd = not condition[symbol] <= MOST_CONDITION or min(weights) < LOW_WEIGHT or max(weights) > HIGH_WEIGHT
        dropped = ",".join(p for k, p in enumerate(PARAMETERS) if k not in own)
        found.append((symbol, n, *map(float, levels), *extra, *combined, condition[symbol], inflation(systems[symbol][0]), dropped, "flagged" if odd else "ok"))
    return rows.sparkSession.createDataFrame(found, "symbol string, n long, " + ", ".join(f"{c} double" for c in names) + ", condition double, vif double, dropped string, verdict string")


def inflation(jtj: np.ndarray) -> float:
    """The largest variance inflation factor of the parameters, from their normal equations: 1 where none leans on the others."""
    scale = np.sqrt(np.diag(jtj))
    return float(np.diag(np.linalg.pinv(jtj / np.outer(scale, scale))).max())


def _pattern_equations(rows: DataFrame, theta: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    weights = rows.sparkSession.createDataFrame([(s, np.exp(FEATURES @ v).tolist()) for s, v in theta.items()], "symbol string, w array<double>")
    weighed = rows.join(F.broadcast(weights), "symbol").select("symbol", "t", "ln_var", *((F.col(f"p{p}") * F.col("w")[p]).alias(f"p{p}") for p in range(len(FEATURES))))

    def total(which: np.ndarray) -> Column:
        return sum((F.col(f"p{p}") for p in np.flatnonzero(which).tolist()), F.lit(0.0))

    weighed = weighed.withColumn("total", total(np.ones(len(FEATURES))))
    parts = weighed.select("symbol", "t", (F.col("ln_var") - F.ln("total")).alias("e"), *((total(FEATURES[:, k]) / F.col("total")).alias(p) for k, p in enumerate(PARAMETERS)))
    for name in ("e", *PARAMETERS):
        parts = demeaned(parts, name, "symbol", "t")
    dev, m = [F.col(f"{n}_dev") for n in ("e", *PARAMETERS)], len(PARAMETERS) + 1
    sums = [F.sum(dev[i] * dev[j]).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]
    out = {}
    for r in parts.groupBy("symbol").agg(*sums).collect():
        full = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
        out[r["symbol"]] = (full[0, 0], full[1:, 1:], full[0, 1:])
    return out
