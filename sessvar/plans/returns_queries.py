"""Return queries: prices, forecasts, event studies, randomization, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import uniform_sql
from ..operators import calendar as cal
from ..operators import returns as r
from ..sources.fixtures import Views
from .pricing_queries import rounded
from .registry import query

#: Draws of the two bootstraps; the event's date among shipping days and the blackout around another; the session at which the index windows part.
RATIO_DRAWS, WEEK_DRAWS, PART = 400, 2000, 14
EVENT, BLACKOUT = "DATE '1998-06-01'", ("DATE '1999-01-01'", "DATE '1999-03-31'")



def ln_ratio(top: str, bottom: str) -> str:
    """As :func:`returns.log_ratio`."""
    return f"(ln(CASE WHEN {top} > 0 THEN {top} END) - ln(CASE WHEN {bottom} > 0 THEN {bottom} END))"


RET = f"rt AS (SELECT index_name, day, session, {ln_ratio('close', 'before')} AS r FROM (SELECT *, lag(close) OVER (PARTITION BY index_name ORDER BY session) AS before FROM index_daily) x)"


@query("index_ohlc", "SELECT index_name, day, open, high, low, close FROM index_daily")
def index_ohlc(v: Views) -> DataFrame:
    return r.daily_prices(v.events, "event_type", "ts", "event_id", "value")


@query("close_to_close", f"WITH {RET} SELECT index_name, day, round(r, 8) AS r FROM rt")
def close_to_close(v: Views) -> DataFrame:
    return r.close_to_close(v.index_daily).select("index_name", "day", F.round("r", 8).alias("r"))


@query("overnight_intraday_parkinson", f"""SELECT index_name, day, round({ln_ratio('open', 'before')}, 8) AS overnight, round({ln_ratio('close', 'open')}, 8) AS intraday, round(pow({ln_ratio('high', 'low')}, 2) / (4 * ln(2e0)), 8) AS parkinson
    FROM (SELECT *, lag(close) OVER (PARTITION BY index_name ORDER BY session) AS before FROM index_daily) x WHERE open > 0 AND before > 0""")
def overnight_intraday_parkinson(v: Views) -> DataFrame:
    return rounded(r.range_variances(v.index_daily).select("index_name", "day", "overnight", "intraday", "parkinson"), "index_name", "day", digits=8)


FORE = f"""{RET}, sq AS (SELECT *, row_number() OVER (PARTITION BY index_name ORDER BY session) - 1 AS n FROM rt WHERE r IS NOT NULL),
    fo AS (SELECT index_name, CAST(0 AS BIGINT) AS n, avg(r * r) AS f FROM sq WHERE n < {r.SEED} GROUP BY index_name
      UNION ALL SELECT fo.index_name, fo.n + 1, {r.DECAY} * fo.f + (1 - {r.DECAY}) * sq.r * sq.r FROM fo JOIN sq ON sq.index_name = fo.index_name AND sq.n = fo.n WHERE EXISTS (SELECT 1 FROM sq s2 WHERE s2.index_name = fo.index_name AND s2.n = fo.n + 1)),
    zz AS (SELECT sq.index_name, day, session, r, f AS forecast, r * r / nullif(f, 0) AS z2 FROM sq JOIN fo ON sq.index_name = fo.index_name AND sq.n = fo.n)"""
WIN = f"{FORE}, zw AS (SELECT *, CASE WHEN session > {PART} THEN 1 ELSE 0 END AS part, isodow(day) - 1 AS wd, session - session % 7 AS week FROM zz WHERE isodow(day) <= 5)"
LW = "SELECT *, ln(CASE WHEN s > 0 THEN s END / n / (sum(s) OVER (PARTITION BY index_name, part) / sum(n) OVER (PARTITION BY index_name, part))) AS lw FROM (SELECT index_name, part, wd, sum(z2) AS s, count(*) AS n FROM zw GROUP BY index_name, part, wd) g"
CH = "ch AS (SELECT index_name, wd, max(CASE WHEN part = 1 THEN lw END) - max(CASE WHEN part = 0 THEN lw END) AS change FROM lw GROUP BY index_name, wd)"


def scaled(v: Views, decay: float = r.DECAY) -> DataFrame:
    """Standardised squares of weekday sessions with window, weekday and week (of seven sessions)."""
    z = r.forecasts(r.close_to_close(v.index_daily), decay).withColumn("wd", F.weekday("day").cast("long")).filter("wd < 5")
    return z.withColumn("window", F.when(F.col("session") > PART, 1).otherwise(0)).withColumn("week", F.col("session") - F.col("session") % 7)


@query("ewma_forecast", f"WITH RECURSIVE {FORE} SELECT index_name, day, round(forecast, 8) AS forecast FROM zz")
def ewma_forecast(v: Views) -> DataFrame:
    return r.forecasts(r.close_to_close(v.index_daily)).select("index_name", "day", F.round("forecast", 8).alias("forecast"))


@query("standardised_squares", f"WITH RECURSIVE {FORE} SELECT index_name, day, round(z2, 8) AS z2 FROM zz")
def standardised_squares(v: Views) -> DataFrame:
    return r.forecasts(r.close_to_close(v.index_daily)).select("index_name", "day", F.round("z2", 8).alias("z2"))


@query("weekday_log_weights", f"WITH RECURSIVE {WIN}, lw AS ({LW}) SELECT index_name, part, wd, n, round(lw, 7) AS lw FROM lw")
def weekday_log_weights(v: Views) -> DataFrame:
    return r.log_weights(scaled(v)).select("index_name", F.col("window").alias("part"), "wd", "n", F.round("lw", 7).alias("lw"))


@query("event_did", f"WITH RECURSIVE {WIN}, lw AS ({LW}), {CH} SELECT a.index_name, a.wd, round(a.change - b.change, 7) AS did FROM ch a JOIN ch b ON a.wd = b.wd WHERE b.index_name = 'view' AND a.index_name <> 'view'")
def event_did(v: Views) -> DataFrame:
    return r.differences(r.changes(r.log_weights(scaled(v))), F.lit("view")).select("index_name", "wd", F.round("did", 7).alias("did"))


_WK = f"""wk AS (SELECT part, week, row_number() OVER (PARTITION BY part ORDER BY week) - 1 AS no, count(*) OVER (PARTITION BY part) AS k FROM (SELECT DISTINCT part, week FROM zw) d),
    pk AS (SELECT draw, part, CAST(floor({uniform_sql("'week'", 'part', 'draw', 'no')} * k) AS BIGINT) AS pick FROM wk CROSS JOIN range(1, {WEEK_DRAWS + 1}) AS r(draw)),
    mu AS (SELECT pk.draw, pk.part, wk.week, count(*) AS times FROM pk JOIN wk ON wk.part = pk.part AND wk.no = pk.pick GROUP BY pk.draw, pk.part, wk.week)"""


def multiplicity(z: DataFrame) -> DataFrame:
    weeks = z.select("window", "week").distinct().withColumn("no", F.row_number().over(Window.partitionBy("window").orderBy("week")) - 1)
    return r.week_multiplicity(weeks, WEEK_DRAWS)


@query("week_cluster_multiplicity", f"WITH RECURSIVE {WIN}, {_WK} SELECT draw, part, week, times FROM mu")
def week_cluster_multiplicity(v: Views) -> DataFrame:
    return multiplicity(scaled(v)).select("draw", F.col("window").alias("part"), "week", "times")


@query("week_block_bootstrap", f"""WITH RECURSIVE {WIN}, {_WK}, bs AS (SELECT draw, index_name, zw.part, wd, sum(z2 * times) AS s, sum(times) AS n FROM zw JOIN mu ON mu.part = zw.part AND mu.week = zw.week GROUP BY draw, index_name, zw.part, wd),
    lw AS (SELECT *, ln(CASE WHEN s > 0 THEN s END / n / (sum(s) OVER (PARTITION BY draw, index_name, part) / sum(n) OVER (PARTITION BY draw, index_name, part))) AS lw FROM bs),
    ch AS (SELECT draw, index_name, wd, max(CASE WHEN part = 1 THEN lw END) - max(CASE WHEN part = 0 THEN lw END) AS change FROM lw GROUP BY draw, index_name, wd)
    SELECT index_name, wd, round(quantile_cont(change, 0.025), 6) AS low, round(quantile_cont(change, 0.975), 6) AS high, count(*) - count(change) AS not_finite FROM ch GROUP BY index_name, wd""")
def week_block_bootstrap(v: Views) -> DataFrame:
    z = scaled(v)
    changed = r.changes(r.reweighted(z, multiplicity(z)), "draw").withColumnRenamed("change", "value")
    return rounded(r.interval(changed, "index_name", "wd"), "index_name", "wd", "not_finite")


FRONT = f"""fr AS (SELECT sym, trade_date, expiry_no, settle FROM (SELECT *, row_number() OVER (PARTITION BY sym, trade_date ORDER BY expiry_no) AS first_no FROM stock_futures WHERE settle > 0 AND vol > 0) x WHERE first_no = 1),
    rr AS (SELECT *, r * r AS sq FROM (SELECT *, 100 * ln(settle / lag(settle) OVER (PARTITION BY sym, expiry_no ORDER BY trade_date)) AS r FROM fr WHERE settle > 0) y WHERE abs(r) < {r.GENUINE})"""


@query("front_contract_returns", f"WITH {FRONT} SELECT sym, trade_date, expiry_no, round(r, 8) AS r FROM rr")
def front_contract_returns(v: Views) -> DataFrame:
    return r.front_returns(v.stock_futures).select("sym", "trade_date", "expiry_no", F.round("r", 8).alias("r"))


@query("session_clustered_variance", f"WITH {FRONT} SELECT trade_date, count(*) AS n, round(avg(sq), 8) AS variance FROM rr GROUP BY trade_date")
def session_clustered_variance(v: Views) -> DataFrame:
    return rounded(r.session_variance(r.front_returns(v.stock_futures)), "trade_date", "n", digits=8)


@query("weekday_variance", f"WITH {FRONT} SELECT isodow(trade_date) - 1 AS wd, count(*) AS n, round(avg(sq), 8) AS variance FROM rr GROUP BY 1")
def weekday_variance(v: Views) -> DataFrame:
    return r.front_returns(v.stock_futures).groupBy(F.weekday("trade_date").cast("long").alias("wd")).agg(F.count("*").alias("n"), F.round(F.avg("sq"), 8).alias("variance"))


DAYS = "dy AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS session FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) d)"
PSEUDO = f"""{DAYS}, sp AS (SELECT min(session) AS split FROM dy WHERE day >= {EVENT}), ps AS (SELECT t.session AS tau, t.day, t.session = split AS is_event FROM dy t CROSS JOIN sp JOIN dy lo ON lo.session = t.session - {r.REACH} JOIN dy hi ON hi.session = t.session + {r.REACH} - 1
    WHERE t.session = split OR ((t.session - {r.REACH}) % {r.STRIDE} = 0 AND NOT (t.session - {r.REACH} < split AND split < t.session + {r.REACH}) AND NOT (lo.day <= {BLACKOUT[1]} AND hi.day >= {BLACKOUT[0]})))"""
STAT = f"""{FRONT}, {PSEUDO}, sd AS (SELECT trade_date AS day, sum(sq) AS s, count(*) AS n FROM rr GROUP BY trade_date), sw AS (SELECT session, s, n, isodow(sd.day) - 1 AS wd FROM sd JOIN dy ON dy.day = sd.day),
    me AS (SELECT tau, is_event, wd, session >= tau AS post, sum(s) / sum(n) AS m FROM ps JOIN sw ON session >= tau - {r.REACH} AND session < tau + {r.REACH} WHERE wd IN (1, 3) GROUP BY tau, is_event, wd, session >= tau),
    st AS (SELECT tau, is_event, sum(CASE WHEN post THEN 1 ELSE -1 END * CASE WHEN wd = 1 THEN 1 ELSE -1 END * ln(CASE WHEN m > 0 THEN m END)) AS stat, count(CASE WHEN m > 0 THEN 1 END) AS four FROM me GROUP BY tau, is_event)"""


def shipping(v: Views) -> DataFrame:
    return cal.sessions(v.lineitem, "l_shipdate").select("day", "session")


def pseudo(v: Views) -> DataFrame:
    return r.pseudo_events(shipping(v), F.expr(EVENT), (F.expr(BLACKOUT[0]), F.expr(BLACKOUT[1])))


@query("eligible_pseudo_events", f"WITH {PSEUDO} SELECT tau, day, is_event FROM ps")
def eligible_pseudo_events(v: Views) -> DataFrame:
    return pseudo(v)


@query("disjoint_designs", f"WITH RECURSIVE {PSEUDO}, ta AS (SELECT tau FROM ps WHERE NOT is_event), ga AS (SELECT min(tau) AS tau FROM ta UNION ALL SELECT (SELECT min(ta.tau) FROM ta WHERE ta.tau >= ga.tau + {2 * r.REACH}) FROM ga WHERE ga.tau IS NOT NULL) SELECT count(tau) AS n FROM ga")
def disjoint_designs(v: Views) -> DataFrame:
    return r.disjoint(pseudo(v))


@query("randomization_stock_stat", f"WITH {STAT} SELECT tau, is_event, round(CASE WHEN four = 4 THEN stat END, 7) AS stat FROM st")
def randomization_stock_stat(v: Views) -> DataFrame:
    return rounded(r.weekday_shift(pseudo(v), shipping(v), r.front_returns(v.stock_futures)), "tau", "is_event", digits=7)


@query("randomization_pvalue", f"""WITH {STAT}, nu AS (SELECT n.stat, e.stat AS star FROM st n CROSS JOIN (SELECT stat FROM st WHERE is_event AND four = 4) e WHERE NOT n.is_event AND n.four = 4)
    SELECT round(star, 7) AS star, count(*) AS n, round(median(stat), 7) AS null_median, round(100 * avg(CASE WHEN stat < star THEN 1e0 ELSE 0e0 END), 6) AS percentile, round((1 + count(*) FILTER (WHERE stat <= star)) / (1e0 + count(*)), 6) AS p,
           avg(CASE WHEN stat < star THEN 1e0 ELSE 0e0 END) BETWEEN 0.05 AND 0.95 AS inside FROM nu GROUP BY star""")
def randomization_pvalue(v: Views) -> DataFrame:
    found = r.rank_p(r.weekday_shift(pseudo(v), shipping(v), r.front_returns(v.stock_futures)))
    return found.select(F.round("star", 7).alias("star"), "n", F.round("null_median", 7).alias("null_median"), F.round("percentile", 6).alias("percentile"), F.round("p", 6).alias("p"), "inside")


RATIO = f"""{FRONT}, va AS (SELECT CASE WHEN isodow(trade_date) = 2 THEN 1 ELSE 0 END AS sample, trade_date, avg(sq) AS x FROM rr GROUP BY trade_date),
    nv AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY trade_date) - 1 AS no, count(*) OVER (PARTITION BY sample) AS n FROM va),
    pi AS (SELECT draw, sample, CAST(floor({uniform_sql('sample', 'draw', 'no')} * n) AS BIGINT) AS pick FROM nv CROSS JOIN range(1, {RATIO_DRAWS + 1}) AS r(draw)),
    rd AS (SELECT draw, avg(CASE WHEN pi.sample = 1 THEN x END) / avg(CASE WHEN pi.sample = 0 THEN x END) AS ratio FROM pi JOIN nv ON nv.sample = pi.sample AND nv.no = pi.pick GROUP BY draw)"""


def ratios(v: Views) -> DataFrame:
    """Tuesdays (sample 1) against other sessions."""
    x = r.session_variance(r.front_returns(v.stock_futures)).select(F.when(F.weekday("trade_date") == 1, 1).otherwise(0).alias("sample"), "trade_date", F.col("variance").alias("x"))
    return r.ratio_draws(x.withColumn("no", F.row_number().over(Window.partitionBy("sample").orderBy("trade_date")) - 1).drop("trade_date"), RATIO_DRAWS)


@query("iid_ratio_bootstrap", f"WITH {RATIO} SELECT draw, round(ratio, 7) AS ratio FROM rd")
def iid_ratio_bootstrap(v: Views) -> DataFrame:
    return ratios(v).select("draw", F.round("value", 7).alias("ratio"))


@query("finite_percentile_ci", f"WITH {RATIO} SELECT round(quantile_cont(ratio, 0.025), 6) AS low, round(quantile_cont(ratio, 0.975), 6) AS high, count(*) - count(ratio) AS not_finite FROM rd")
def finite_percentile_ci(v: Views) -> DataFrame:
    return rounded(r.interval(ratios(v)), "not_finite")
