"""Simulation queries: paths, hedged straddles, pathwise proxies, multilevel estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import cdf_sql, inverse_sql, number, pdf_sql
from ..functions.random import uniform_sql
from ..operators import mispricing as m
from ..operators import simulation as sim
from ..sources.fixtures import Views
from .pricing_queries import CLOCK, DV, S, rounded, stacked, steps_sql
from .registry import query

#: Pairs of mirrored paths; costs in basis points; steps a session of the sensitivity grid; finest level, and the tolerance of its allocation.
HALF, COSTS, GRID, LEVELS, TOLERANCE = 1000, (0.0, 0.5, 2.0), (1, 2, 4), 3, 0.5
ENTRY = f"({S} * (4e0 * {cdf_sql(number((5 * m.DAILY_VARIANCE) ** 0.5 / 2))} - 2e0))"


def paths_ctes(per: int, tag: str = "") -> str:
    """``pa``: paths at so many steps a session, ``tag`` behind every name."""
    t = tag
    return f"""se{t} AS (SELECT *, sum(realised) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS true_remaining FROM ({steps_sql(per)}) s),
    un{t} AS (SELECT *, {uniform_sql("'gbm'", 'p', 'step')} AS u FROM range(0, {HALF}) AS r(p) CROSS JOIN se{t}), no{t} AS (SELECT *, {inverse_sql('u')} AS z FROM un{t}),
    mo{t} AS (SELECT *, p + {HALF} * mi AS path, -realised / 2 + sqrt(realised) * z * (1 - 2 * mi) AS mv FROM no{t} CROSS JOIN (VALUES (0), (1)) AS s(mi)),
    pa{t} AS (SELECT path, step, realised, believed, elapsed, remaining, true_remaining, {S} * exp(coalesce(sum(mv) OVER (PARTITION BY path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS from_price,
      {S} * exp(sum(mv) OVER (PARTITION BY path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS to_price FROM mo{t})"""


def hedged_ctes(source: str, tag: str = "") -> str:
    """``pl``: profit by path and cost."""
    t = tag
    d1 = "ln(from_price / {s}) / sqrt({r}) + sqrt({r}) / 2"
    return f"""dd{t} AS (SELECT *, {d1.format(s=S, r='true_remaining')} AS dk, {d1.format(s=S, r='remaining')} AS df, lead(step) OVER (PARTITION BY path ORDER BY step) IS NULL AS fin FROM {source}),
    hl{t} AS (SELECT *, 2 * {cdf_sql('dk')} - 1 AS hk, 2 * {cdf_sql('df')} - 1 AS hf FROM dd{t}),
    tr{t} AS (SELECT *, hk - coalesce(lag(hk) OVER (PARTITION BY path ORDER BY step), 0) AS tk, hf - coalesce(lag(hf) OVER (PARTITION BY path ORDER BY step), 0) AS tf FROM hl{t}),
    ag{t} AS (SELECT path, sum(tk * from_price) AS bk, sum(tf * from_price) AS bf, sum(abs(tk) * from_price) AS ak, sum(abs(tf) * from_price) AS af, sum(CASE WHEN fin THEN hk * to_price END) AS ek, sum(CASE WHEN fin THEN hf * to_price END) AS ef,
      sum(CASE WHEN fin THEN to_price END) AS lp, sum(from_price * {pdf_sql('df')} / sqrt(remaining) * (believed - realised)) AS proxy FROM tr{t} GROUP BY path),
    pl{t} AS (SELECT path, cost, {ENTRY} - bk - ak * cost * 1e-4 + ek - abs(lp - {S}) AS clock, {ENTRY} - bf - af * cost * 1e-4 + ef - abs(lp - {S}) AS calendar, proxy FROM ag{t} CROSS JOIN (VALUES {", ".join(f"({number(c)})" for c in COSTS)}) AS cs(cost))"""


def results(v: Views, per: int = 1) -> DataFrame:
    return sim.hedged(sim.gbm_paths(v.spark, v.weights, HALF, per), COSTS)


@query("gbm_paths", f"WITH {CLOCK}, {paths_ctes(1)} SELECT path, step, round(from_price, 4) AS from_price, round(to_price, 4) AS to_price FROM pa")
def gbm_paths(v: Views) -> DataFrame:
    return rounded(sim.gbm_paths(v.spark, v.weights, HALF).select("path", "step", "from_price", "to_price"), "path", "step", digits=4)


@query("hedge_pnl", f"""WITH {CLOCK}, {paths_ctes(1)}, {hedged_ctes('pa')}, lo AS (SELECT cost, 'clock' AS trader, clock AS pnl FROM pl UNION ALL SELECT cost, 'calendar', calendar FROM pl)
    SELECT trader, cost, count(*) AS n, round(avg(pnl), 4) AS mean, round(stddev_pop(pnl), 4) AS sd, round((avg(pnl * pnl * pnl) - 3 * avg(pnl) * avg(pnl * pnl) + 2 * pow(avg(pnl), 3)) / pow(stddev_pop(pnl), 3), 4) AS skew, round(quantile_cont(pnl, 0.05), 4) AS p05 FROM lo GROUP BY trader, cost""")
def hedge_pnl(v: Views) -> DataFrame:
    return rounded(sim.pnl_summary(results(v)), "trader", "cost", "n", digits=4)


@query("ekjs_pathwise", f"""WITH {CLOCK}, {paths_ctes(1)}, {hedged_ctes('pa')} SELECT round(corr(proxy, calendar - clock), 6) AS correlation, round(stddev_pop(proxy - calendar + clock) / stddev_pop(calendar - clock), 6) AS relative_gap, round(avg(proxy), 4) AS mean_proxy FROM pl WHERE cost = 0""")
def ekjs_pathwise(v: Views) -> DataFrame:
    found = sim.proxy_fit(results(v))
    return found.select(F.round("correlation", 6).alias("correlation"), F.round("relative_gap", 6).alias("relative_gap"), F.round("mean_proxy", 4).alias("mean_proxy"))


def _shares(per: int) -> str:
    return f"""SELECT {per} AS per_session, cost, round(stddev_pop(clock), 4) AS sd_clock, round(stddev_pop(calendar), 4) AS sd_calendar, round(avg(calendar - clock), 4) AS mean_diff, round(stddev_pop(calendar - clock), 4) AS sd_diff,
        round(stddev_pop(calendar - clock) / stddev_pop(clock), 4) AS share FROM pl{per} GROUP BY cost"""


@query("hedging_sensitivity", f"WITH {CLOCK}, {', '.join(f'{paths_ctes(n, str(n))}, {hedged_ctes(f"pa{n}", str(n))}' for n in GRID)} {' UNION ALL '.join(_shares(n) for n in GRID)}")
def hedging_sensitivity(v: Views) -> DataFrame:
    return stacked([rounded(sim.hedging_shares(results(v, n)).withColumn("per_session", F.lit(n)), "per_session", "cost", digits=4) for n in GRID])


def _coarse(level: int) -> str:
    return f"""co{level} AS (SELECT path, CAST(floor(step / 2) AS BIGINT) AS step, sum(CASE WHEN step % 2 = 0 THEN from_price END) AS from_price, sum(CASE WHEN step % 2 = 0 THEN remaining END) AS remaining, sum(CASE WHEN step % 2 = 0 THEN true_remaining END) AS true_remaining,
        sum(CASE WHEN step % 2 = 1 THEN to_price END) AS to_price, sum(realised) AS realised, sum(believed) AS believed FROM pa{level} GROUP BY path, CAST(floor(step / 2) AS BIGINT))"""


_SQ = "pow(calendar - clock, 2)"
MLMC = f"{CLOCK}, " + ", ".join(
    f"{paths_ctes(2**lv, str(lv))}, {hedged_ctes(f'pa{lv}', str(lv))}, " + (f"{_coarse(lv)}, {hedged_ctes(f'co{lv}', f'{lv}c')}, ys{lv} AS (SELECT {lv} AS level, pow(f.calendar - f.clock, 2) - pow(c.calendar - c.clock, 2) AS y FROM pl{lv} f JOIN pl{lv}c c ON f.path = c.path AND f.cost = 0 AND c.cost = 0)" if lv else f"ys0 AS (SELECT 0 AS level, {_SQ} AS y FROM pl0 WHERE cost = 0)")
    for lv in range(LEVELS + 1)
) + ", lm AS (SELECT level, count(*) AS n, avg(y) AS mean, avg(y * y) - avg(y) * avg(y) AS variance FROM (" + " UNION ALL ".join(f"SELECT * FROM ys{lv}" for lv in range(LEVELS + 1)) + ") a GROUP BY level)"


def moments(v: Views) -> DataFrame:
    levels = []
    for level in range(LEVELS + 1):
        paths = sim.gbm_paths(v.spark, v.weights, HALF, 2**level)
        levels.append((level, sim.hedged(paths, (0.0,)), sim.hedged(sim.coarser(paths), (0.0,)) if level else None))
    return sim.level_moments(levels)


@query("mlmc_levels", f"WITH {MLMC} SELECT level, n, round(mean, 3) AS mean, round(variance, 1) AS variance FROM lm")
def mlmc_levels(v: Views) -> DataFrame:
    return moments(v).select("level", "n", F.round("mean", 3).alias("mean"), F.round("variance", 1).alias("variance"))


@query("mlmc_allocation", f"""WITH {MLMC}, lc AS (SELECT *, 5 * pow(2, level) * CASE WHEN level > 0 THEN 1.5e0 ELSE 1e0 END AS cost FROM lm)
    SELECT level, cost, CAST(ceil({2 / TOLERANCE**2} * sqrt(variance / cost) * (SELECT sum(sqrt(variance * cost)) FROM lc)) AS BIGINT) AS samples FROM lc""")
def mlmc_allocation(v: Views) -> DataFrame:
    return sim.allocation(moments(v), TOLERANCE).select("level", "cost", "samples")


@query("mlmc_estimate", f"""WITH {MLMC} SELECT round(sum(mean), 3) AS estimate, round(sqrt(sum(variance / n)), 3) AS error, round(-regr_slope(CASE WHEN level >= 1 THEN log2(abs(mean)) END, level), 4) AS decay, round(sum(mean) + max_by(mean, level), 3) AS "limit" FROM lm""")
def mlmc_estimate(v: Views) -> DataFrame:
    return sim.telescoped(moments(v)).select(F.round("estimate", 3).alias("estimate"), F.round("error", 3).alias("error"), F.round("decay", 4).alias("decay"), F.round("limit", 3).alias("limit"))
