"""Event designs: roles and doses, shifts and their ratios, expiry days against others, date bootstrap, panel with sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform_sql
from ..operators import calendar as cal
from ..operators import design
from ..operators import returns as r
from ..sources.fixtures import Views
from .calendar_queries import REGIMES
from .pricing_queries import rounded
from .registry import query
from .returns_queries import CH, DAYS, FRONT, LW, WIN, ln_ratio, scaled

#: The windows before and after the event, as days of the stand-in chains.
PRE, POST = ("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-06-30")
INSIDE = "CASE WHEN {0} BETWEEN DATE '2024-01-01' AND DATE '2024-03-31' THEN 0 WHEN {0} BETWEEN DATE '2024-04-01' AND DATE '2024-06-30' THEN 1 END"

ROLES = f"""ow AS (SELECT symbol, expiry, isodow(expiry) - 1 AS wd, {INSIDE.format('expiry')} AS part FROM (SELECT DISTINCT symbol, expiry FROM chains WHERE trade_date = expiry) x),
    mo AS (SELECT symbol, part, wd FROM (SELECT symbol, part, wd, row_number() OVER (PARTITION BY symbol, part ORDER BY count(*) DESC, min(expiry)) AS best FROM ow WHERE part IS NOT NULL GROUP BY symbol, part, wd) x WHERE best = 1),
    se AS (SELECT DISTINCT trade_date AS day, isodow(trade_date) - 1 AS wd, {INSIDE.format('trade_date')} AS part FROM chains),
    ds AS (SELECT mo.symbol, mo.part, mo.wd, avg(CASE WHEN ow.expiry IS NULL THEN 0e0 ELSE 1e0 END) AS dose FROM mo JOIN se ON se.part = mo.part AND se.wd = mo.wd LEFT JOIN ow ON ow.symbol = mo.symbol AND ow.expiry = se.day GROUP BY mo.symbol, mo.part, mo.wd),
    ro AS (SELECT a.symbol, CASE WHEN a.wd <> b.wd THEN 'treated' ELSE 'control' END AS role, a.wd AS old_wd, b.wd AS new_wd, round(a.dose, 9) AS dose_pre, round(b.dose, 9) AS dose_post FROM ds a JOIN ds b ON a.symbol = b.symbol WHERE a.part = 0 AND b.part = 1)"""


@query("event_roles", f"WITH {ROLES} SELECT *, row_number() OVER (PARTITION BY role ORDER BY dose_post, symbol) AS place FROM ro")
def event_roles(v: Views) -> DataFrame:
    """Treated or control by the commonest weekday of a symbol's expiries in each window, with doses, ordered by the later dose within a role."""
    return rounded(design.roles(cal.own_session_expiries(v.chains), v.chains.select(F.col("trade_date").alias("day")).distinct(), PRE, POST), "symbol", "role", "old_wd", "new_wd", "place", digits=9)


@query("dose_ratio", f"WITH RECURSIVE {WIN}, lw AS ({LW}), {CH}, sh AS (SELECT index_name, max(CASE WHEN wd = 1 THEN change END) - max(CASE WHEN wd = 3 THEN change END) AS s FROM ch GROUP BY index_name) SELECT a.index_name, round(a.s, 6) AS s, round(a.s / nullif(b.s, 0), 4) AS ratio FROM sh a CROSS JOIN (SELECT s FROM sh WHERE index_name = 'view') b")
def dose_ratio(v: Views) -> DataFrame:
    """Each unit's shift from Thursday to Tuesday, and its ratio to that of the unit of full dose."""
    shifts = design.shifts(r.changes(r.log_weights(scaled(v))), old=3, new=1)
    return design.ratios(shifts, "view").select("index_name", F.round("s", 6).alias("s"), F.round("ratio", 4).alias("ratio"))


@query("worst_session", f"WITH RECURSIVE {WIN} SELECT index_name, part, day, round(z2, 6) AS z2 FROM (SELECT *, row_number() OVER (PARTITION BY index_name, part ORDER BY z2 DESC, day) AS best FROM zw WHERE z2 IS NOT NULL) x WHERE best = 1")
def worst_session(v: Views) -> DataFrame:
    """The session of largest standardised square in each window, which a sensitivity run leaves out."""
    top = design.worst(scaled(v))
    return top.select("index_name", F.col("window").alias("part"), "day", F.round("z2", 6).alias("z2"))


SLOW = WIN.replace(f"{r.DECAY} * fo.f + (1 - {r.DECAY})", f"{design.SLOW} * fo.f + (1 - {design.SLOW})")


@query("event_did_slow_forecast", f"WITH RECURSIVE {SLOW}, lw AS ({LW}), {CH} SELECT a.index_name, a.wd, round(a.change - b.change, 7) AS did FROM ch a JOIN ch b ON a.wd = b.wd WHERE b.index_name = 'view' AND a.index_name <> 'view'")
def event_did_slow_forecast(v: Views) -> DataFrame:
    """The differences of event_did under a forecast that forgets more slowly."""
    return r.differences(r.changes(r.log_weights(scaled(v, design.SLOW))), F.lit("view")).select("index_name", "wd", F.round("did", 7).alias("did"))


@query("event_did_without_worst", f"""WITH RECURSIVE {WIN}, ws AS (SELECT day FROM zw WHERE index_name = 'view' AND z2 IS NOT NULL ORDER BY z2 DESC, day LIMIT 1), lw AS ({LW.replace('FROM zw GROUP', 'FROM zw WHERE day NOT IN (SELECT day FROM ws) GROUP')}), {CH}
    SELECT a.index_name, a.wd, round(a.change - b.change, 7) AS did FROM ch a JOIN ch b ON a.wd = b.wd WHERE b.index_name = 'view' AND a.index_name <> 'view'""")
def event_did_without_worst(v: Views) -> DataFrame:
    """The differences of event_did without the one session of largest standardised square of the control."""
    z = scaled(v)
    worst = z.filter("index_name = 'view' AND z2 IS NOT NULL").orderBy(F.desc("z2"), "day").limit(1).select("day")
    return r.differences(r.changes(r.log_weights(z.join(F.broadcast(worst), "day", "left_anti"))), F.lit("view")).select("index_name", "wd", F.round("did", 7).alias("did"))


@query("index_decomposition", f"""WITH ex AS (SELECT DISTINCT expiry AS day FROM chains), x AS (SELECT *, lag(close) OVER (PARTITION BY index_name ORDER BY session) AS before FROM index_daily),
    es AS (SELECT index_name, day, 'close_close' AS estimator, pow({ln_ratio('close', 'before')}, 2) AS value FROM x UNION ALL SELECT index_name, day, 'overnight', pow({ln_ratio('open', 'before')}, 2) FROM x
      UNION ALL SELECT index_name, day, 'open_close', pow({ln_ratio('close', 'open')}, 2) FROM x UNION ALL SELECT index_name, day, 'parkinson', pow({ln_ratio('high', 'low')}, 2) / (4 * ln(2e0)) FROM x),
    fl AS (SELECT es.*, ex.day IS NOT NULL AS on_expiry FROM es LEFT JOIN ex ON ex.day = es.day WHERE value IS NOT NULL)
    SELECT index_name, estimator, count(*) FILTER (WHERE on_expiry) AS n_expiry, count(*) FILTER (WHERE NOT on_expiry) AS n_other, round(avg(value) FILTER (WHERE on_expiry) / nullif(avg(value) FILTER (WHERE NOT on_expiry), 0), 6) AS mean_ratio,
      round(median(value) FILTER (WHERE on_expiry) / nullif(median(value) FILTER (WHERE NOT on_expiry), 0), 6) AS median_ratio FROM fl GROUP BY index_name, estimator""")
def index_decomposition(v: Views) -> DataFrame:
    """Variance on listed expiry days over that on others, by estimator: mean and median."""
    return rounded(design.decomposition(v.index_daily, v.chains.select(F.col("expiry").alias("day")).distinct()), "index_name", "estimator", "n_expiry", "n_other")


@query("date_cluster_multiplicity", f"""WITH {DAYS}, pk AS (SELECT draw, session, CAST(floor({uniform_sql("'date'", 'draw', 'session')} * (SELECT count(*) FROM dy)) AS BIGINT) AS pick FROM dy CROSS JOIN range(1, {design.DATE_DRAWS + 1}) AS r(draw))
    SELECT pk.draw, dy.day, count(*) AS times FROM pk JOIN dy ON dy.session = pk.pick GROUP BY pk.draw, dy.day""")
def date_cluster_multiplicity(v: Views) -> DataFrame:
    """How often each draw of the date bootstrap takes each whole date."""
    return design.date_multiplicity(cal.sessions(v.lineitem, "l_shipdate"))


@query("panel_sessions", f"""WITH se AS (SELECT DISTINCT trade_date AS day, t FROM chains), nu AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS session FROM se)
    SELECT symbol, count(*) AS n, count(b.session) AS known, CAST(sum(b.session - a.session) AS BIGINT) AS sessions, min(b.session - a.session) AS least FROM option_panel p LEFT JOIN nu a ON a.day = p.trade_date LEFT JOIN nu b ON b.day = p.expiry GROUP BY symbol""")
def panel_sessions(v: Views) -> DataFrame:
    """Sessions to expiry of each quote, from the calendar joined at both ends; an expiry beyond the calendar has none."""
    joined = design.with_sessions(v.option_panel.drop("session", "expiry_session", "dte_trd"), cal.sessions(v.chains, "trade_date"))
    return joined.groupBy("symbol").agg(F.count("*").alias("n"), F.count("expiry_session").alias("known"), F.sum("dte_trd").alias("sessions"), F.min("dte_trd").alias("least"))


@query("variance_scaling", f"WITH {FRONT} SELECT isodow(trade_date) - 1 AS wd, round(regr_slope(ln(variance), ln(n)), 6) AS slope FROM (SELECT trade_date, avg(sq) AS variance, count(*) AS n FROM rr GROUP BY trade_date) x WHERE variance > 0 GROUP BY 1")
def variance_scaling(v: Views) -> DataFrame:
    """Log-log slope of a session's variance against the number of stocks behind it, by weekday."""
    each = r.session_variance(r.front_returns(v.stock_futures)).filter("variance > 0")
    return each.groupBy(F.weekday("trade_date").cast("long").alias("wd")).agg(F.round(F.regr_slope(F.ln("variance"), F.ln("n")), 6).alias("slope"))


@query("expiry_timeline", f"""WITH RECURSIVE {REGIMES} SELECT 'regime' AS what, symbol, start, finish AS "end", regime_wd, n, NULL AS wd, NULL AS days_early, NULL AS kind FROM rg
    UNION ALL SELECT 'roll', symbol, expiry, NULL, regime_wd, NULL, wd, days_early, CASE WHEN days_early <= 3 THEN 'backward_roll' ELSE 'off_cycle' END FROM ro
    UNION ALL SELECT 'weekend', NULL, day, NULL, NULL, NULL, wd, NULL, CASE WHEN month(day) = 2 AND day(day) = 1 THEN 'union_budget' ELSE 'special_session' END FROM trading_days WHERE wd >= 5""")
def expiry_timeline(v: Views) -> DataFrame:
    """Regimes, rolls and weekend sessions of the long calendar in one table, columns that one kind lacks being null."""
    return design.timeline(v.long_expiries.select("symbol", "expiry").distinct(), v.trading_days.select("day", "session"))
