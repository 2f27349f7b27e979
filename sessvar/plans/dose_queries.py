"""Dose-response queries: two events, each with the whole window after it and one cut short, and robustness runs of the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform_sql
from ..operators import design, dose
from ..operators import returns as r
from ..sources import scratch
from ..sources.fixtures import Views
from .pricing_queries import rounded
from .randomization_queries import recurrence
from .registry import query

UNITS = ("BNK", "NFT")
#: event, variant, and the days of its windows before and after; the stand-in calendar's changes are in June 1998 and February 1999.
WINDOWS = """SELECT event, variant, part, CAST(first_day AS DATE) AS start, CAST(last_day AS DATE) AS "end" FROM (VALUES
    ('withdrawal', 'full', 0, '1998-07-01', '1998-12-31'), ('withdrawal', 'full', 1, '1999-04-01', '1999-10-31'), ('withdrawal', 'cut', 0, '1998-07-01', '1998-12-31'), ('withdrawal', 'cut', 1, '1999-04-01', '1999-06-30'),
    ('switch', 'full', 0, '1997-12-01', '1998-05-29'), ('switch', 'full', 1, '1998-06-01', '1998-11-30'), ('switch', 'cut', 0, '1997-12-01', '1998-05-29'), ('switch', 'cut', 1, '1998-06-01', '1998-08-14')) AS w(event, variant, part, first_day, last_day)"""
#: Robustness runs of the first event's whole windows: a slower forecast, and without the control's session of largest square.
BASE, SLOW, DROPPED = "withdrawal", "slow_forecast", "without_worst"
CONTROL = "NFT"

_INSIDE = "{day} BETWEEN w.start AND w.\"end\""
ROLES = f"""wn AS ({WINDOWS}), ow AS (SELECT DISTINCT symbol, expiry FROM long_expiries WHERE symbol IN ('BNK', 'NFT')),
    pl AS (SELECT event, variant, part, symbol, isodow(expiry) - 1 AS wd, count(*) AS m, min(expiry) AS f FROM ow JOIN wn w ON {_INSIDE.format(day='expiry')} GROUP BY ALL),
    mo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event, variant, part, symbol ORDER BY m DESC, f) AS best FROM pl) x WHERE best = 1),
    ds AS (SELECT mo.event, mo.variant, mo.part, mo.symbol AS unit, mo.wd, avg(CASE WHEN ow.expiry IS NULL THEN 0e0 ELSE 1e0 END) AS dose FROM mo JOIN wn w ON w.event = mo.event AND w.variant = mo.variant AND w.part = mo.part JOIN trading_days d ON {_INSIDE.format(day='d.day')} AND d.wd = mo.wd
      LEFT JOIN ow ON ow.symbol = mo.symbol AND ow.expiry = d.day GROUP BY ALL),
    ro AS (SELECT a.event, a.variant, a.unit, a.wd AS old_wd, b.wd AS new_wd, a.dose AS dose_pre, b.dose AS dose_post, a.wd <> b.wd AS treated FROM ds a JOIN ds b ON a.event = b.event AND a.variant = b.variant AND a.unit = b.unit WHERE a.part = 0 AND b.part = 1)"""


def renamed(sql: str, prefix: str) -> str:
    """The recurrence's tables under other names."""
    for name in ("lr", "lf", "lz"):
        sql = sql.replace(f"{name} AS", f"{prefix}{name} AS").replace(f"FROM {name}", f"FROM {prefix}{name}")
    return sql


_NAME = "CASE {wd} WHEN 0 THEN 'Mon' WHEN 1 THEN 'Tue' WHEN 2 THEN 'Wed' WHEN 3 THEN 'Thu' ELSE 'Fri' END"


def name(wd: str) -> str:
    return _NAME.format(wd=wd)


_LIVE = "wd < 5 AND day NOT IN (SELECT day FROM excluded_days)"
ESTIMATES = f"""{recurrence()}, {renamed(recurrence(design.SLOW), 's')}, {ROLES},
    zb AS (SELECT event, variant, part, index_name AS unit, day, wd, z2 FROM lz JOIN wn w ON {_INSIDE.format(day='day')} WHERE {_LIVE}),
    wo AS (SELECT day FROM zb WHERE event = '{BASE}' AND variant = 'full' AND unit = '{CONTROL}' AND z2 IS NOT NULL ORDER BY z2 DESC, day LIMIT 1),
    za AS (SELECT * FROM zb UNION ALL SELECT event, '{DROPPED}', part, unit, day, wd, z2 FROM zb WHERE event = '{BASE}' AND variant = 'full' AND day NOT IN (SELECT day FROM wo)
      UNION ALL SELECT event, '{SLOW}', part, index_name, day, wd, z2 FROM slz JOIN wn w ON {_INSIDE.format(day='day')} WHERE event = '{BASE}' AND variant = 'full' AND {_LIVE}),
    ra AS (SELECT * FROM ro UNION ALL SELECT event, x.v, unit, old_wd, new_wd, dose_pre, dose_post, treated FROM ro CROSS JOIN (VALUES ('{SLOW}'), ('{DROPPED}')) AS x(v) WHERE event = '{BASE}' AND variant = 'full'),
    wk AS (SELECT *, row_number() OVER (PARTITION BY event, variant, part ORDER BY week) - 1 AS no, count(*) OVER (PARTITION BY event, variant, part) AS k FROM (SELECT DISTINCT event, variant, part, date_trunc('week', day) AS week FROM za) x),
    pk AS (SELECT event, variant, part, draw, CASE WHEN draw = 0 THEN no ELSE CAST(floor({uniform_sql("'dose'", 'event', 'variant', 'part', 'draw', 'no')} * k) AS BIGINT) END AS no FROM wk CROSS JOIN range(0, {dose.WEEK_DRAWS + 1}) AS r(draw)),
    mu AS (SELECT pk.event, pk.variant, pk.part, draw, week, count(*) AS times FROM pk JOIN wk ON wk.event = pk.event AND wk.variant = pk.variant AND wk.part = pk.part AND wk.no = pk.no GROUP BY ALL),
    ws AS (SELECT event, variant, part, unit, date_trunc('week', day) AS week, wd, sum(z2) AS s, count(z2) AS n FROM za GROUP BY ALL),
    su AS (SELECT ws.event, ws.variant, draw, unit, ws.part, wd, sum(s * times) AS s, sum(n * times) AS n FROM ws JOIN mu ON mu.event = ws.event AND mu.variant = ws.variant AND mu.part = ws.part AND mu.week = ws.week GROUP BY ALL),
    lw AS (SELECT *, ln(CASE WHEN s > 0 THEN s END / n) - ln(sum(s) OVER g / sum(n) OVER g) AS lw FROM su WINDOW g AS (PARTITION BY event, variant, draw, unit, part)),
    td AS (SELECT event, variant, count(*) FILTER (WHERE treated) AS k FROM ra GROUP BY event, variant),
    a1 AS (SELECT a.event, a.variant, a.unit AS t, a.old_wd AS d, c.unit AS c, c.old_wd AS own FROM ra a JOIN ra c ON a.event = c.event AND a.variant = c.variant JOIN td ON td.event = a.event AND td.variant = a.variant WHERE k = 1 AND a.treated AND NOT c.treated),
    a2 AS (SELECT ra.* FROM ra JOIN td ON td.event = ra.event AND td.variant = ra.variant WHERE k = 2 AND treated),
    co AS (SELECT event, variant, 'did' AS quantity, t AS symbol, {name('d')} AS label, 4 AS terms, CASE WHEN x.own = 1 THEN t ELSE c END AS unit, x.part, d AS wd, x.coef FROM a1 CROSS JOIN (VALUES (1, 1, 1), (1, 0, -1), (0, 1, -1), (0, 0, 1)) AS x(own, part, coef)
      UNION ALL SELECT event, variant, 'level_gap_pre', t, {name('d')}, 2, CASE WHEN x.own = 1 THEN t ELSE c END, 0, d, x.coef FROM a1 CROSS JOIN (VALUES (1, 1), (0, -1)) AS x(own, coef)
      UNION ALL SELECT event, variant, 'delta_own', c, {name('own')}, 2, c, x.part, own, x.coef FROM a1 CROSS JOIN (VALUES (1, 1), (0, -1)) AS x(part, coef)
      UNION ALL SELECT event, variant, 'S', unit, {name('old_wd')} || '->' || {name('new_wd')}, 4, unit, x.part, CASE WHEN x.new = 1 THEN new_wd ELSE old_wd END, x.coef FROM a2 CROSS JOIN (VALUES (1, 1, 1), (1, 0, -1), (0, 1, -1), (0, 0, 1)) AS x(new, part, coef)),
    ev AS (SELECT event, variant, draw, CASE WHEN part = 0 THEN 'ln_w_pre' ELSE 'ln_w_post' END AS quantity, unit AS symbol, {name('wd')} AS label, lw AS value, CASE WHEN draw = 0 THEN n END AS n FROM lw),
    sx AS (SELECT co.event, co.variant, draw, quantity, symbol, label, CASE WHEN count(*) = terms AND count(lw) = terms THEN sum(lw * coef) END AS value FROM lw JOIN co ON co.event = lw.event AND co.variant = lw.variant AND co.unit = lw.unit AND co.part = lw.part AND co.wd = lw.wd GROUP BY co.event, co.variant, draw, quantity, symbol, label, terms),
    lh AS (SELECT event, variant, min_by(unit, dose_post) AS low, max_by(unit, dose_post) AS high FROM a2 GROUP BY event, variant),
    al AS (SELECT event, variant, draw, quantity, symbol, label, value, n FROM ev UNION ALL SELECT event, variant, draw, quantity, symbol, label, value, NULL FROM sx
      UNION ALL SELECT sx.event, sx.variant, draw, 'dose_ratio', low, low || '/' || high, max(CASE WHEN symbol = low THEN value END) / nullif(max(CASE WHEN symbol = high THEN value END), 0), NULL FROM sx JOIN lh ON lh.event = sx.event AND lh.variant = sx.variant WHERE quantity = 'S' GROUP BY sx.event, sx.variant, draw, low, high)"""


def windows(v: Views) -> DataFrame:
    return v.spark.sql(WINDOWS.replace('"end"', "`end`"))


def own_roles(v: Views) -> DataFrame:
    expiries = v.long_expiries.filter(F.col("symbol").isin(*UNITS))
    return dose.roles(expiries, v.trading_days.select("day"), windows(v))


def squares_by_case(v: Views) -> DataFrame:
    """Standardised squares of weekday sessions by case, those of the robustness runs too."""
    cases = F.broadcast(windows(v))
    live = lambda decay: r.forecasts(r.close_to_close(v.long_daily), decay).withColumn("wd", F.weekday("day").cast("long")).filter("wd < 5").join(F.broadcast(v.excluded_days), "day", "left_anti")
    placed = lambda z: z.join(cases, (F.col("day") >= F.col("start")) & (F.col("day") <= F.col("end"))).select(*dose.CASE, "part", F.col("index_name").alias("unit"), "day", "wd", "z2")
    base, first = placed(live(r.DECAY)), (F.col("event") == BASE) & (F.col("variant") == "full")
    worst = base.filter(first & (F.col("unit") == CONTROL) & F.col("z2").isNotNull()).orderBy(F.desc("z2"), "day").limit(1).select("day")
    dropped = base.filter(first).join(F.broadcast(worst), "day", "left_anti").withColumn("variant", F.lit(DROPPED))
    slow = placed(live(design.SLOW)).filter(first).withColumn("variant", F.lit(SLOW))
    return base.unionByName(dropped).unionByName(slow)


def with_robustness(found: DataFrame) -> DataFrame:
    """Roles of the cases; robustness runs have those of the windows that they are runs of."""
    again = found.filter((F.col("event") == BASE) & (F.col("variant") == "full")).withColumn("variant", F.explode(F.array(F.lit(SLOW), F.lit(DROPPED))))
    return found.unionByName(again)


def returns_table(v: Views) -> DataFrame:
    weights = scratch.saved(dose.week_weights(squares_by_case(v)), "dose-weeks")
    return dose.estimates(weights, with_robustness(own_roles(v)))


def options_table(v: Views) -> DataFrame:
    """A row for each estimate and, for a refused fit, none; ``readable`` is false for every estimate of a case with a fit that is not healthy."""
    quotes = v.term_quotes.filter(F.col("symbol").isin(*UNITS))
    weights = scratch.saved(dose.date_weights(quotes, v.trading_days, windows(v)), "dose-dates")
    return dose.estimates(weights, own_roles(v)).join(dose.readable(weights), list(dose.CASE))


KEYS = (*dose.CASE, "quantity", "symbol", "label")


@query("dose_roles", f"WITH {ROLES} SELECT event, variant, unit, old_wd, new_wd, round(dose_pre, 9) AS dose_pre, round(dose_post, 9) AS dose_post, treated FROM ro")
def dose_roles(v: Views) -> DataFrame:
    return rounded(own_roles(v), *dose.CASE, "unit", "old_wd", "new_wd", "treated", digits=9)


@query("dose_response_returns", f"""WITH {ESTIMATES} SELECT event, variant, quantity, symbol, label, round(max(CASE WHEN draw = 0 THEN value END), 6) AS estimate, CAST(max(CASE WHEN draw = 0 THEN n END) AS BIGINT) AS n, round(quantile_cont(value, 0.025) FILTER (WHERE draw > 0), 6) AS low,
    round(quantile_cont(value, 0.975) FILTER (WHERE draw > 0), 6) AS high, count(*) FILTER (WHERE draw > 0 AND value IS NULL) AS not_finite FROM al GROUP BY event, variant, quantity, symbol, label""")
def dose_response_returns(v: Views) -> DataFrame:
    """The returns channel: weights before and after, differences, shifts and their ratio with intervals over whole weeks, and the robustness runs."""
    return rounded(returns_table(v), *KEYS, "n", "not_finite")


@query("dose_response_options")
def dose_response_options(v: Views) -> DataFrame:
    """The options channel with joint intervals over whole dates. Without SQL, the fits being nonlinear; tested against single fits of resampled rows."""
    return rounded(options_table(v), *KEYS, "n", "not_finite", "readable")


@query("dose_response")
def dose_response(v: Views) -> DataFrame:
    """Both channels as one table; what a channel lacks is null. A case of the returns channel can always be read."""
    found = returns_table(v).withColumns({"channel": F.lit("returns"), "readable": F.lit(True)}).unionByName(options_table(v).withColumn("channel", F.lit("options")))
    return rounded(found, "channel", *KEYS, "n", "not_finite", "readable")
