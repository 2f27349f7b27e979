"""Calendar queries: sessions, tenors, expiries, regimes, rolls, open-interest chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..sources.fixtures import Views
from .registry import query

EXPIRIES = "SELECT DISTINCT symbol, expiry FROM chains"


def listed(v: Views) -> DataFrame:
    return v.chains.select("symbol", "expiry").distinct()


@query("session_calendar", "SELECT day, row_number() OVER (ORDER BY day) - 1 AS session, isodow(day) - 1 AS wd FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) d")
def session_calendar(v: Views) -> DataFrame:
    return cal.sessions(v.lineitem, "l_shipdate").withColumn("wd", F.weekday("day").cast("long"))


@query("weekend_sessions", """SELECT day, session, isodow(day) - 1 AS wd, CASE WHEN month(day) = 2 AND day(day) = 1 THEN 'union_budget' ELSE 'special_session' END AS classification
    FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS session FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) d) s WHERE isodow(day) >= 6""")
def weekend_sessions(v: Views) -> DataFrame:
    return cal.weekend_sessions(cal.sessions(v.lineitem, "l_shipdate"))


@query("calendar_mismatch", """WITH a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT day, 'a_only' AS side FROM a WHERE day NOT IN (SELECT day FROM b) UNION ALL SELECT day, 'b_only' FROM b WHERE day NOT IN (SELECT day FROM a)""")
def calendar_mismatch(v: Views) -> DataFrame:
    return cal.mismatches(cal.sessions(v.lineitem, "l_shipdate").select("day"), cal.sessions(v.orders, "o_orderdate").select("day"))


@query("panel_tidy_casts", """SELECT symbol, count(*) AS n, count(TRY_CAST(txt AS DOUBLE)) AS numbers, CAST(sum(CAST(TRY_CAST(txt AS DOUBLE) AS BIGINT)) AS BIGINT) AS total, count(kind) AS options, min(CAST(substr(stamp, 1, 10) AS DATE)) AS first_day
    FROM (SELECT symbol, CASE WHEN volume % 10 = 0 THEN '' WHEN volume % 10 = 1 THEN '-' ELSE CAST(volume AS VARCHAR) || '.0' END AS txt, CASE WHEN opt_type IN ('CE', 'PE') AND volume % 4 > 0 THEN opt_type END AS kind,
          CAST(trade_date AS VARCHAR) || 'T15:30:00' AS stamp FROM option_panel) x GROUP BY symbol""")
def panel_tidy_casts(v: Views) -> DataFrame:
    from ..sources.files import tidy

    number = F.when(F.col("volume") % 10 == 0, "").when(F.col("volume") % 10 == 1, "-").otherwise(F.concat(F.col("volume").cast("string"), F.lit(".0")))
    raw = v.option_panel.select("symbol", number.alias("volume"), F.when(F.col("volume") % 4 > 0, F.col("opt_type")).otherwise("XX").alias("opt_type"), F.concat(F.col("trade_date").cast("string"), F.lit("T15:30:00")).alias("trade_date"))
    typed = tidy(raw)
    return typed.groupBy("symbol").agg(F.count("*").alias("n"), F.count("volume").alias("numbers"), F.sum("volume").alias("total"), F.count("opt_type").alias("options"), F.min("trade_date").alias("first_day"))


@query("tenor_classification", """SELECT symbol, tenor, count(*) AS n, min(dte) AS least_dte, max(dte) AS most_dte FROM (
      SELECT symbol, dte, CASE WHEN expiry < max(expiry) OVER (PARTITION BY trade_date, symbol, year(expiry), month(expiry)) THEN 'weekly'
        WHEN (year(expiry) - year(trade_date)) * 12 + month(expiry) - month(trade_date) <= 2 THEN 'monthly' ELSE 'long_dated' END AS tenor FROM chains) x GROUP BY symbol, tenor""")
def tenor_classification(v: Views) -> DataFrame:
    return cal.tenor(v.chains).groupBy("symbol", "tenor").agg(F.count("*").alias("n"), F.min("dte").alias("least_dte"), F.max("dte").alias("most_dte"))


@query("expiry_quoted_on_own_session", "SELECT DISTINCT symbol, expiry FROM chains WHERE trade_date = expiry")
def expiry_quoted_on_own_session(v: Views) -> DataFrame:
    return cal.own_session_expiries(v.chains)


@query("listed_expiry_set", "SELECT symbol, count(DISTINCT expiry) AS expiries, min(expiry) AS first_expiry, max(expiry) AS last_expiry FROM chains GROUP BY symbol")
def listed_expiry_set(v: Views) -> DataFrame:
    return v.chains.groupBy("symbol").agg(F.count_distinct("expiry").alias("expiries"), F.min("expiry").alias("first_expiry"), F.max("expiry").alias("last_expiry"))


@query("expiry_mismatch", "SELECT symbol, count(*) AS never_quoted FROM (SELECT symbol, expiry FROM chains GROUP BY symbol, expiry HAVING max(CASE WHEN trade_date = expiry THEN 1 ELSE 0 END) = 0) x GROUP BY symbol")
def expiry_mismatch(v: Views) -> DataFrame:
    return listed(v).join(cal.own_session_expiries(v.chains), ["symbol", "expiry"], "left_anti").groupBy("symbol").agg(F.count("*").alias("never_quoted"))


@query("weekday_runs", f"""SELECT symbol, wd, min(expiry) AS "start", max(expiry) AS "end", count(*) AS n FROM (SELECT symbol, expiry, wd, sum(changed) OVER (PARTITION BY symbol ORDER BY expiry) AS run FROM (
      SELECT symbol, expiry, isodow(expiry) - 1 AS wd, CASE WHEN isodow(expiry) <> lag(isodow(expiry)) OVER (PARTITION BY symbol ORDER BY expiry) THEN 1 ELSE 0 END AS changed FROM ({EXPIRIES}) e) x) y GROUP BY symbol, run, wd""")
def weekday_runs(v: Views) -> DataFrame:
    return cal.weekday_runs(listed(v)).drop("run")


@query("expiry_month_last", f"""SELECT symbol, expiry, expiry = m AS is_last, max(CASE WHEN expiry < m THEN expiry END) OVER (PARTITION BY symbol, year(expiry), month(expiry)) AS last_weekly
    FROM (SELECT symbol, expiry, max(expiry) OVER (PARTITION BY symbol, year(expiry), month(expiry)) AS m FROM ({EXPIRIES}) e) x""")
def expiry_month_last(v: Views) -> DataFrame:
    return cal.month_last(listed(v))


LOTS = "SELECT symbol, trade_date, 25 + 25 * (CAST(floor(t / 30e0) AS BIGINT) % 3) + CASE WHEN k = 3 AND t % 30 < 5 THEN 10 ELSE 0 END AS lot FROM chains"


@query("lot_size_staircase", f"""SELECT symbol, trade_date, members FROM (SELECT *, lag(members) OVER (PARTITION BY symbol ORDER BY trade_date) AS before FROM (
      SELECT symbol, trade_date, string_agg(CAST(lot AS VARCHAR), ',' ORDER BY lot) AS members FROM (SELECT DISTINCT symbol, trade_date, lot FROM ({LOTS}) l) d GROUP BY symbol, trade_date) x) y WHERE before IS NULL OR before <> members""")
def lot_size_staircase(v: Views) -> DataFrame:
    lots = v.chains.select("symbol", "trade_date", (25 + 25 * (F.floor(F.col("t") / 30) % 3) + F.when((F.col("k") == 3) & (F.col("t") % 30 < 5), 10).otherwise(0)).alias("lot"))
    return cal.changed_sets(lots, "symbol", "trade_date", "lot")


#: Expiries of the long calendar, numbered; their regimes; those off their regime's weekday.
REGIMES = f"""xe AS (SELECT symbol, expiry, isodow(expiry) - 1 AS wd, row_number() OVER (PARTITION BY symbol ORDER BY expiry) AS i FROM (SELECT DISTINCT symbol, expiry FROM long_expiries) d),
    {cal.segments_sql('xe', spark=False)},
    gc AS (SELECT sg.symbol, lo, wd, count(*) AS c, min(expiry) AS f, max(expiry) AS l FROM xe JOIN sg ON sg.symbol = xe.symbol AND xe.i > lo AND xe.i <= hi GROUP BY sg.symbol, lo, wd),
    gt AS (SELECT symbol, lo, sum(c) AS n, min(f) AS a, max(l) AS b FROM gc GROUP BY symbol, lo),
    gm AS (SELECT gt.*, w.wd FROM gt JOIN (SELECT symbol, lo, wd, row_number() OVER (PARTITION BY symbol, lo ORDER BY c DESC, f) AS best FROM gc) w ON w.symbol = gt.symbol AND w.lo = gt.lo AND best = 1),
    gr AS (SELECT *, sum(changed) OVER (PARTITION BY symbol ORDER BY a) AS run FROM (SELECT *, CASE WHEN wd <> lag(wd) OVER (PARTITION BY symbol ORDER BY a) THEN 1 ELSE 0 END AS changed FROM gm) x),
    rg AS (SELECT symbol, wd AS regime_wd, min(a) AS start, max(b) AS finish, CAST(sum(n) AS BIGINT) AS n FROM gr GROUP BY symbol, run, wd),
    ro AS (SELECT xe.symbol, xe.expiry, xe.wd, rg.regime_wd, (rg.regime_wd - xe.wd + 7) % 7 AS days_early FROM xe JOIN rg ON rg.symbol = xe.symbol AND xe.expiry BETWEEN rg.start AND rg.finish WHERE xe.wd <> rg.regime_wd)"""


@query("expiry_regimes_every", f'WITH RECURSIVE {REGIMES} SELECT symbol, regime_wd, start, finish AS "end", n FROM rg')
def expiry_regimes_every(v: Views) -> DataFrame:
    """All regimes of each symbol's expiries, however many: one recursive query of the engine, held against the same recursion in SQL and, in tests, against a loop."""
    return cal.regimes(v.long_expiries)


@query("holiday_rolls_of_regimes", f"WITH RECURSIVE {REGIMES} SELECT *, CASE WHEN days_early <= 3 THEN 'backward_roll' ELSE 'off_cycle' END AS kind FROM ro")
def holiday_rolls_of_regimes(v: Views) -> DataFrame:
    """Expiries off the weekday of the regime that they lie in: holidays of the long calendar roll them back."""
    dates = v.long_expiries.select("symbol", "expiry").distinct()
    return cal.rolls(dates, cal.regimes(dates))


@query("oi_chain_reconciliation", """SELECT symbol, count(*) AS transitions, CAST(sum(CASE WHEN open_int = prev + chg_oi THEN 1 ELSE 0 END) AS BIGINT) AS matched, round(avg(CASE WHEN open_int = prev + chg_oi THEN 1e0 ELSE 0e0 END), 9) AS share
    FROM (SELECT symbol, open_int, chg_oi, lag(open_int) OVER (PARTITION BY symbol, expiry, strike, opt_type ORDER BY trade_date, open_int, chg_oi) AS prev FROM option_panel) x WHERE prev IS NOT NULL GROUP BY symbol""")
def oi_chain_reconciliation(v: Views) -> DataFrame:
    """How often a contract's open interest is that of the day before and the change that the panel reports."""
    by = Window.partitionBy("symbol", "expiry", "strike", "opt_type").orderBy("trade_date", "open_int", "chg_oi")
    seen = v.option_panel.withColumn("prev", F.lag("open_int").over(by)).filter("prev is not null")
    ok = (F.col("open_int") == F.col("prev") + F.col("chg_oi")).cast("int")
    return seen.groupBy("symbol").agg(F.count("*").alias("transitions"), F.sum(ok).alias("matched"), F.round(F.avg(ok.cast("double")), 9).alias("share"))
