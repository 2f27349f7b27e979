"""Pricing queries: entry errors, transaction tax, expected hedging errors in closed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import cdf_sql, inverse_sql, number, pdf_sql
from ..functions.random import uniform_sql
from ..operators import mispricing as m
from ..sources.fixtures import Views
from .registry import query

S, DV = number(m.SPOT), number(m.DAILY_VARIANCE)
DRAWS, NOISE, NODES = 200, 0.1, 100
CLOCK = "ck AS (SELECT wd, day, raw / (SELECT avg(raw) FROM weights) AS w FROM weights)"
#: Draws of the clock, by the same hashes.
DRAWN = f"""du AS (SELECT draw, wd, raw, {uniform_sql("'clock'", 'draw', 'wd')} AS u FROM weights CROSS JOIN range(1, {DRAWS + 1}) AS r(draw)),
    dr AS (SELECT draw, wd, raw * exp({NOISE} * {inverse_sql('u')}) AS raw FROM du), cd AS (SELECT draw, wd, raw / avg(raw) OVER (PARTITION BY draw) AS w FROM dr)"""


def errors_sql(clock: str, by: str = "") -> str:
    """Errors by product over a table with wd and w, one set for each value of ``by``."""
    by = by and f"{by}, "
    return f"""SELECT {by}product, sum(sign * {S} * (4e0 * {cdf_sql('dc')} - 2e0)) AS p_clock, sum(sign * {S} * (4e0 * {cdf_sql('df')} - 2e0)) AS p_flat
        FROM (SELECT {by}product, sign, sqrt(sum(w) * {DV}) / 2 AS dc, sqrt(count(*) * {DV}) / 2 AS df FROM legs JOIN {clock} c ON legs.wd = c.wd GROUP BY {by}product, sign) l GROUP BY {by}product"""


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Rounded columns other than ``keys``; adding nothing turns a negative zero into zero."""
    return df.select(*keys, *((F.round(c, digits) + 0.0).alias(c) for c in df.columns if c not in keys))


@query("entry_price_error", f"""WITH {CLOCK} SELECT opened, sessions, round(w_clock, 6) AS w_clock, round(100 * ((4e0 * {cdf_sql('dc')} - 2e0) / (4e0 * {cdf_sql('df')} - 2e0) - 1), 6) + 0e0 AS error_pct
    FROM (SELECT opened, count(*) AS sessions, sum(w) AS w_clock, sqrt(sum(w) * {DV}) / 2 AS dc, sqrt(count(*) * {DV}) / 2 AS df FROM spans JOIN ck ON spans.wd = ck.wd GROUP BY opened) x""")
def entry_price_error(v: Views) -> DataFrame:
    opened = v.spans.join(F.broadcast(m.normalised(v.weights)), "wd").groupBy("opened").agg(F.count("*").alias("sessions"), F.sum("w").alias("w_clock"))
    return opened.select("opened", "sessions", F.round("w_clock", 6).alias("w_clock"), (F.round(100 * (m.atm(F.col("w_clock")) / m.atm(F.col("sessions").cast("double")) - 1), 6) + 0.0).alias("error_pct"))


@query("calendar_spread_error", f"WITH {CLOCK}, er AS ({errors_sql('ck')}) SELECT product, round(p_clock, 6) AS p_clock, round(p_flat, 6) AS p_flat, round(p_clock / p_flat - 1, 6) + 0e0 AS error FROM er")
def calendar_spread_error(v: Views) -> DataFrame:
    return rounded(m.entry_errors(v.legs, m.normalised(v.weights)), "product")


@query("entry_error_by_draw", f"WITH {DRAWN}, er AS ({errors_sql('cd', 'draw')}) SELECT draw, product, round(p_clock / p_flat - 1, 6) + 0e0 AS error FROM er")
def entry_error_by_draw(v: Views) -> DataFrame:
    return m.entry_errors(v.legs, m.clock_draws(v.weights, DRAWS, NOISE), "draw").select("draw", "product", (F.round("error", 6) + 0.0).alias("error"))


@query("naive_band", f"""WITH {DRAWN}, co AS (SELECT wd, 0 AS corner, quantile_cont(w, 0.025) AS w FROM cd GROUP BY wd UNION ALL SELECT wd, 1, quantile_cont(w, 0.975) FROM cd GROUP BY wd),
    er AS ({errors_sql('co', 'corner')}) SELECT product, round(min(p_clock / p_flat - 1), 6) AS low, round(max(p_clock / p_flat - 1), 6) AS high FROM er GROUP BY product""")
def naive_band(v: Views) -> DataFrame:
    return rounded(m.naive_band(v.legs, m.clock_draws(v.weights, DRAWS, NOISE)), "product")


_NB = f"((1 - e) * ({S} * {cdf_sql('ca')} - {S} / (1 - e) * {cdf_sql('cb')}) + (1 + e) * ({S} * {cdf_sql('pa')} - {S} / (1 + e) * {cdf_sql('pb')} - {S} + {S} / (1 + e)))"
_OPEN = f"""{CLOCK}, op AS (SELECT opened, count(*) AS sessions, sum(w) * {DV} AS v_clock, count(*) * {DV} AS v_flat FROM spans JOIN ck ON spans.wd = ck.wd GROUP BY opened),
    xr AS (SELECT *, sale_pct / 100 AS p, exercised_pct / 100 AS e FROM op CROSS JOIN stt_rates)"""


def _notional_sql(v: str) -> str:
    return f"""SELECT start, opened, {_NB} AS nb FROM (SELECT *, ln(1 - e) / sqrt({v}) + sqrt({v}) / 2 AS ca, ln(1 - e) / sqrt({v}) - sqrt({v}) / 2 AS cb, ln(1 + e) / sqrt({v}) + sqrt({v}) / 2 AS pa, ln(1 + e) / sqrt({v}) - sqrt({v}) / 2 AS pb FROM xr) y"""


@query("stt_effect", f"""WITH {_OPEN}, nc AS ({_notional_sql('v_clock')}), nf AS ({_notional_sql('v_flat')}),
    pr AS (SELECT *, {S} * (4e0 * {cdf_sql('dc')} - 2e0) AS c, {S} * (4e0 * {cdf_sql('df')} - 2e0) AS f FROM (SELECT *, sqrt(v_clock) / 2 AS dc, sqrt(v_flat) / 2 AS df FROM xr) q)
    SELECT pr.start, pr.opened, sessions, round(c, 6) AS price_clock, round(f, 6) AS price_flat, round((1 - e) * c, 6) AS long_max, round(c / (1 - p), 6) AS short_min, round(e * c, 6) AS exercise_tax, round(p * c / (1 - p), 6) AS premium_tax,
           round(1 / (1 - p) - 1 + e, 6) AS band, round(c / f - 1, 6) + 0e0 AS err_frictionless, round((c - e * {S}) / (f - e * {S}) - 1, 6) + 0e0 AS err_forced, round(nc.nb / nf.nb - 1, 6) + 0e0 AS err_optimal
    FROM pr JOIN nc ON pr.start = nc.start AND pr.opened = nc.opened JOIN nf ON pr.start = nf.start AND pr.opened = nf.opened""")
def stt_effect(v: Views) -> DataFrame:
    return rounded(m.taxed(v.stt_rates, v.spans, m.normalised(v.weights)).drop("v_clock", "e"), "start", "opened", "sessions")


@query("stt_trap_probability", f"""WITH {_OPEN} SELECT start, opened, round({S} / (1 - e) - {S} / (1 + e), 6) AS width, round({cdf_sql('hi')} - {cdf_sql('lo')}, 6) AS probability
    FROM (SELECT *, (-ln(1 - e) + v_clock / 2) / sqrt(v_clock) AS hi, (-ln(1 + e) + v_clock / 2) / sqrt(v_clock) AS lo FROM xr) x""")
def stt_trap_probability(v: Views) -> DataFrame:
    return rounded(m.trap(m.taxed(v.stt_rates, v.spans, m.normalised(v.weights))), "start", "opened")


def steps_sql(per: int) -> str:
    return f"""SELECT {per} AS per_session, step, realised, {DV} / {per} AS believed, coalesce(sum(realised) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS elapsed, ({5 * per} - step) * {DV} / {per} AS remaining
        FROM (SELECT (wd + 3) % 5 * {per} + j AS step, w * {DV} / {per} AS realised FROM ck CROSS JOIN range(0, {per}) AS r(j)) x"""


GRIDS, FEW = (1, 4, 16, 64), (1, 2, 4, 8)


def grids(v: Views, sizes: tuple[int, ...]) -> list[tuple[int, DataFrame]]:
    return [(n, m.believed_variance(v.weights, n)) for n in sizes]


def stacked(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def union_sql(sizes: tuple[int, ...]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({steps_sql(n)}) g{n}" for n in sizes)


@query("believed_variance_paths", f"WITH {CLOCK}, st AS ({union_sql(FEW)}) SELECT per_session, step, round(realised * 1e6, 6) AS realised, round(believed * 1e6, 6) AS believed, round(elapsed * 1e6, 6) AS elapsed, round(remaining * 1e6, 6) AS remaining FROM st")
def believed_variance_paths(v: Views) -> DataFrame:
    return stacked([g.select(F.lit(n).alias("per_session"), "step", *(F.round(F.col(c) * 1e6, 6).alias(c) for c in ("realised", "believed", "elapsed", "remaining"))) for n, g in grids(v, FEW)])


_HSG = f"(CASE WHEN remaining > 0 THEN {S} * {pdf_sql('hv')} / (2 * hv) ELSE 0e0 END)"


@query("expected_half_s2_gamma", f"WITH {CLOCK}, st AS ({union_sql(FEW)}) SELECT per_session, step, round({_HSG}, 4) AS gamma FROM (SELECT *, sqrt(elapsed + remaining) / 2 AS hv FROM st) x")
def expected_half_s2_gamma(v: Views) -> DataFrame:
    return stacked([g.select(F.lit(n).alias("per_session"), "step", F.round(m.expected_half_s2_gamma(F.col("elapsed"), F.col("remaining")), 4).alias("gamma")) for n, g in grids(v, FEW)])


@query("ekjs_proxy_mean", f"WITH {CLOCK}, st AS ({union_sql(GRIDS)}) SELECT per_session, round(sum({_HSG} * (believed - realised)), 6) AS mean FROM (SELECT *, sqrt(elapsed + remaining) / 2 AS hv FROM st) x GROUP BY per_session")
def ekjs_proxy_mean(v: Views) -> DataFrame:
    value = m.expected_half_s2_gamma(F.col("elapsed"), F.col("remaining")) * (F.col("believed") - F.col("realised"))
    return stacked([g.agg(F.round(F.sum(value), 6).alias("mean")).select(F.lit(n).alias("per_session"), "mean") for n, g in grids(v, GRIDS)])


def density_sql(x: str, var: str) -> str:
    return f"(exp(-({x}) * ({x}) / (2e0 * ({var}))) / sqrt(2e0 * pi() * ({var})))"


def kernel_sql(vs: str, rs: str, vt: str, rt: str) -> str:
    later = f"({rt} + {vt} - {vs})"
    joint = f"({rs} * {later} / ({rs} + {later}))"
    return f"{density_sql(f'({rs} - {later}) / 2e0', f'{rs} + {later}')} * {density_sql(f'{joint} + {vs} / 2e0', f'{joint} + {vs}')}"


@query("riemann_second_moment", f"""WITH {CLOCK}, st AS ({union_sql(FEW)}) SELECT a.per_session, round({S} * {S} * sum((a.believed - a.realised) * (b.believed - b.realised) * {kernel_sql('a.elapsed', 'a.remaining', 'b.elapsed', 'b.remaining')} * CASE WHEN a.step = b.step THEN 1 ELSE 2 END), 5) AS second_moment
    FROM st a JOIN st b ON a.per_session = b.per_session AND a.step <= b.step GROUP BY a.per_session""")
def riemann_second_moment(v: Views) -> DataFrame:
    found = [(n, m.second_moment(g.select(F.col("step").alias("id"), "elapsed", "remaining", (F.col("believed") - F.col("realised")).alias("q")))) for n, g in grids(v, FEW)]
    return stacked([f.select(F.lit(n).alias("per_session"), F.round("second_moment", 5).alias("second_moment")) for n, f in found])


_X, _Q = np.polynomial.legendre.leggauss(NODES)
_NODE_ROWS = ", ".join(f"({i}, {number(float(x))}, {number(float(q))})" for i, (x, q) in enumerate(zip(_X, _Q, strict=True)))
QUAD = f"""{CLOCK}, dy AS (SELECT (wd + 3) % 5 AS pos, w FROM ck), db AS (SELECT pos, w, coalesce(sum(w) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS pre, sqrt(5e0 - pos) AS hi, sqrt(4e0 - pos) AS lo FROM dy),
    nd AS (SELECT *, (hi - lo) / 2 * x + (hi + lo) / 2 AS u FROM db CROSS JOIN (VALUES {_NODE_ROWS}) AS n(no, x, wq)),
    qd AS (SELECT pos * 1000 - no AS id, wq * (hi - lo) * u AS dt, w, {DV} * (pre + w * (5 - u * u - pos)) AS elapsed, {DV} * u * u AS remaining, wq * (hi - lo) * u * {DV} * (1 - w) AS q FROM nd),
    pt AS (SELECT *, 5 * {DV} - elapsed AS true_remaining FROM qd)"""


def points(v: Views) -> DataFrame:
    nodes = v.spark.createDataFrame([(i, float(x), float(q)) for i, (x, q) in enumerate(zip(_X, _Q, strict=True))], "no int, x double, wq double")
    return m.quadrature(v.weights, nodes)


@query("floor_closed_form", f"WITH {QUAD} SELECT round(sqrt({S} * {S} * sum(a.q * b.q * {kernel_sql('a.elapsed', 'a.remaining', 'b.elapsed', 'b.remaining')} * CASE WHEN a.id = b.id THEN 1 ELSE 2 END)), 5) AS floor FROM pt a JOIN pt b ON a.id <= b.id")
def floor_closed_form(v: Views) -> DataFrame:
    return m.second_moment(points(v).select("id", "elapsed", "remaining", "q")).select(F.round(F.sqrt("second_moment"), 5).alias("floor"))


def _gg(a: str, b: str) -> str:
    return f"{S} * {S} * {kernel_sql('elapsed', a, 'elapsed', b)}"


_SC = f"2e0 * {DV} * {DV} * dt * w * w"
_GC, _GF, _GX = _gg("true_remaining", "true_remaining"), _gg("remaining", "remaining"), _gg("remaining", "true_remaining")


@query("rate_constants", f"WITH {QUAD} SELECT round(sqrt(sum({_SC} * {_GC})), 5) AS clock, round(sqrt(sum({_SC} * {_GF})), 5) AS calendar, round(sqrt(sum({_SC} * ({_GF} - 2e0 * {_GX} + {_GC}))), 5) AS difference FROM pt")
def rate_constants(v: Views) -> DataFrame:
    return rounded(m.rate_constants(points(v)), digits=5)
