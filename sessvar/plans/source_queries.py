"""Source and sink queries: the panel in folders, tables with manifests, archives by day, files taken in once; and tables of a report."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import randomization as ri
from ..operators import returns as r
from ..operators import surface as s
from ..sources import archives, panel, scratch
from ..sources.fixtures import Views
from ..streaming import ingest
from .calendar_queries import REGIMES
from .clock_queries import shared
from .randomization_queries import DESIGNS, did_rows
from .registry import query
from .surface_queries import FWD, live

EXCHANGE = "CASE WHEN symbol IN ('AAA', 'BBB') THEN 'NSE' ELSE 'BSE' END"
START, END = dt.date(2024, 1, 8), dt.date(2025, 6, 30)


def folder(v: Views, name: str) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{scratch.scratch(v.spark)}/{name}-{uuid.uuid4().hex}"


def stored_panel(v: Views) -> DataFrame:
    """The option panel by exchange and year, written once for the queries of a session."""

    def make() -> DataFrame:
        path = folder(v, "panel")
        panel.write_panel(v.option_panel.withColumn("exchange", F.expr(EXCHANGE)), path)
        return v.spark.read.parquet(path)

    return shared(v, "panel", make)


@query("panel_pruned", f"""SELECT symbol, opt_type, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume, max(open_int) AS most_open FROM option_panel WHERE {EXCHANGE} = 'NSE' AND trade_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY symbol, opt_type""")
def panel_pruned(v: Views) -> DataFrame:
    """One exchange's quotes of a span of days: folders and row groups outside it are not read."""
    some = stored_panel(v).filter(panel.traded(START, END) & (F.col("exchange") == "NSE"))
    return some.groupBy("symbol", "opt_type").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.max("open_int").alias("most_open"))


@query("panel_on_expiries", "SELECT p.symbol, count(*) AS n, CAST(sum(open_int) AS BIGINT) AS open_int FROM option_panel p WHERE trade_date IN (SELECT expiry FROM chains WHERE trade_date = expiry AND symbol = 'AAA' AND year(expiry) = 2024) GROUP BY p.symbol")
def panel_on_expiries(v: Views) -> DataFrame:
    """Quotes of all symbols on one symbol's expiry days of a year: the days prune folders while the query runs."""
    days = cal.own_session_expiries(v.chains).filter("symbol = 'AAA' AND year(expiry) = 2024").select(F.col("expiry").alias("day"))
    return panel.on_days(stored_panel(v), days).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("open_int").alias("open_int"))


@query("table_manifest", "SELECT 'session_variance' AS name, count(*) AS n, true AS intact FROM (SELECT DISTINCT trade_date FROM stock_futures) x")
def table_manifest(v: Views) -> DataFrame:
    """A result written with its side-car, whose rows and digest are observed in the same job, and held against what lies there."""
    path = folder(v, "session-variance")
    found = v.stock_futures.groupBy("trade_date").agg(F.sum("vol").alias("volume"), F.sum("oi").alias("oi"))
    made = panel.write_observed(found, path, {"table": "session_variance"})
    return v.spark.createDataFrame([("session_variance", made["rows"], panel.intact(v.spark, path))], "name string, n long, intact boolean")


@query("archive_days", "SELECT day, count(*) AS n, round(sum(close), 4) AS closes FROM index_daily WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY day")
def archive_days(v: Views) -> DataFrame:
    """Prices written as a zipped file a day and read again for a span of days, whose files alone are opened."""
    path = folder(v, "archives")
    archives.write_archives(v.index_daily.select("day", "index_name", "close"), path if "://" in path or path.startswith("file:") else f"file://{path}", "day").agg(F.sum("n")).collect()
    rows = archives.archives(v.spark, f"{path}/*.zip", ["index_name", "close"], dt.date(2024, 1, 5), dt.date(2024, 1, 20))
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum(F.col("close").cast("double")), 4).alias("closes"))


@query("incremental_ingest", "SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT event_id) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def incremental_ingest(v: Views) -> DataFrame:
    """Events taken in by two runs of a file stream, of which the second finds nothing new, against one batch."""
    target, state = folder(v, "ingest"), folder(v, "ingest-state")
    for _ in range(2):
        stream = ingest.arriving(v.spark, f"{v.sf_dir}/events.parquet*", v.events.schema, "ts")
        ingest.ingest(stream, "event_id", "ts", target, state)
    return v.spark.read.parquet(target).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count_distinct("event_id").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_OFF = "(f.fwd / u.settle - 1) * 1e4"


@query("report_largest_gaps", f"WITH {FWD} SELECT f.trade_date, f.symbol, f.expiry, f.n_pairs, round({_OFF}, 4) AS gap_bp FROM fw f JOIN index_futures u ON f.trade_date = u.trade_date AND f.symbol = u.symbol AND f.expiry = u.expiry ORDER BY round(abs({_OFF}), 4) DESC, f.trade_date, f.symbol, f.expiry LIMIT 60")
def report_largest_gaps(v: Views) -> DataFrame:
    """A report table shows sixty rows at most: here the forwards farthest from their futures."""
    off = (F.col("fwd") / F.col("settle") - 1) * 1e4
    rows = s.forwards(live(v)).join(v.index_futures, [*s.KEY]).select(*s.KEY, "n_pairs", F.round(off, 4).alias("gap_bp"))
    return rows.orderBy(F.desc(F.abs("gap_bp")), *s.KEY).limit(60)


@query("headline_tiles", f"""WITH RECURSIVE {REGIMES}, {DESIGNS}, {FWD} SELECT (SELECT round(did, 4) FROM dx WHERE is_event) AS event_did, (SELECT round((1 + count(*) FILTER (WHERE did >= (SELECT did FROM dx WHERE is_event))) / (1e0 + count(*)), 4) FROM dx WHERE NOT is_event AND did IS NOT NULL) AS event_p,
    (SELECT count(*) FROM rg) AS regimes, (SELECT count(*) FROM ro) AS rolls, (SELECT count(*) FROM trading_days) AS sessions,
    (SELECT round(avg({_OFF}), 4) FROM fw f JOIN index_futures u ON f.trade_date = u.trade_date AND f.symbol = u.symbol AND f.expiry = u.expiry) AS forward_bias_bp""")
def headline_tiles(v: Views) -> DataFrame:
    """One row of a report's headline numbers, each a scalar subquery over a table of results: one plan, nothing typed in."""
    designs = did_rows(v)
    dates = v.long_expiries.select("symbol", "expiry").distinct()
    regimes = scratch.saved(cal.regimes(dates), "regimes")
    gaps = s.forwards(live(v)).join(v.index_futures, [*s.KEY]).select(((F.col("fwd") / F.col("settle") - 1) * 1e4).alias("gap_bp"))
    return v.spark.sql(
        """SELECT (SELECT round(max(did), 4) FROM {designs} WHERE is_event) AS event_did, (SELECT round(max(p), 4) FROM {ranks}) AS event_p, (SELECT count(*) FROM {regimes}) AS regimes,
        (SELECT count(*) FROM {rolls}) AS rolls, (SELECT count(*) FROM {days}) AS sessions, (SELECT round(avg(gap_bp), 4) FROM {gaps}) AS forward_bias_bp""",
        designs=designs, ranks=ri.ranked(designs.withColumnRenamed("did", "stat"), 1), regimes=regimes, rolls=cal.rolls(dates, regimes), days=v.trading_days, gaps=gaps,
    )
