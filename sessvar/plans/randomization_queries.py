"""Randomization queries over the calendar of years: the index difference and the options channel at every pseudo design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pseudo_fits
from ..operators import randomization as ri
from ..operators import returns as r
from ..sources import scratch
from ..sources.fixtures import Views
from .pricing_queries import rounded
from .registry import query
from .returns_queries import BLACKOUT, EVENT, ln_ratio

#: The unit that the event treats, its control, and the weekday (Wednesday) that the treated unit's expiries leave.
TREATED, CONTROL, WEEKDAY = "BNK", "NFT", 2


def recurrence(decay: float = r.DECAY, daily: str = "long_daily") -> str:
    """Forecasts as SQL, the recurrence written out: past squares, each grown by the decay to the power of its age."""
    return f"""lr AS (SELECT *, row_number() OVER (PARTITION BY index_name ORDER BY session) - 1 AS i FROM (SELECT index_name, day, session, {ln_ratio('close', 'before')} AS r FROM (SELECT *, lag(close) OVER (PARTITION BY index_name ORDER BY session) AS before FROM {daily}) x) y WHERE r IS NOT NULL),
    lf AS (SELECT *, pow({decay}, i) * (avg(CASE WHEN i < {r.SEED} THEN r * r END) OVER (PARTITION BY index_name) + coalesce(sum((1 - {decay}) * r * r * pow({decay}, -i - 1)) OVER (PARTITION BY index_name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS forecast FROM lr),
    lz AS (SELECT index_name, day, session, forecast, r * r / nullif(forecast, 0) AS z2, isodow(day) - 1 AS wd FROM lf)"""


PSEUDO = f"""sp AS (SELECT min(session) AS split FROM trading_days WHERE day >= {EVENT}), ps AS (SELECT t.session AS tau, t.day, t.session = split AS is_event FROM trading_days t CROSS JOIN sp JOIN trading_days lo ON lo.session = t.session - REACH JOIN trading_days hi ON hi.session = t.session + REACH - 1
    WHERE t.session = split OR ((t.session - REACH) % {r.STRIDE} = 0 AND NOT (t.session - REACH < split AND split < t.session + REACH) AND NOT (lo.day <= {BLACKOUT[1]} AND hi.day >= {BLACKOUT[0]})))"""
DESIGNS = f"""{recurrence()}, {PSEUDO}, de AS (SELECT is_event, tau, tau - REACH AS pre_from, tau - 1 AS pre_to, tau AS post_from, tau + REACH - 1 AS post_to FROM ps WHERE NOT is_event
      UNION ALL SELECT true, a, a - REACH, a - 1, b, b + REACH - 1 FROM (SELECT min(CASE WHEN day >= {BLACKOUT[0]} THEN session END) AS a, min(CASE WHEN day > {BLACKOUT[1]} THEN session END) AS b FROM trading_days) x),
    zk AS (SELECT * FROM lz WHERE wd < 5 AND day NOT IN (SELECT day FROM excluded_days)),
    sm AS (SELECT is_event, tau, index_name, session >= post_from AS post, sum(z2) FILTER (WHERE wd = {WEEKDAY}) / count(z2) FILTER (WHERE wd = {WEEKDAY}) AS own, sum(z2) / count(z2) AS every FROM de JOIN zk ON session BETWEEN pre_from AND pre_to OR session BETWEEN post_from AND post_to GROUP BY ALL),
    dd AS (SELECT is_event, tau, sum((CASE WHEN post THEN 1 ELSE -1 END) * (CASE WHEN index_name = '{TREATED}' THEN 1 ELSE -1 END) * ln(CASE WHEN own > 0 THEN own / every END)) AS did, count(CASE WHEN own > 0 THEN 1 END) AS four FROM sm GROUP BY is_event, tau),
    dx AS (SELECT de.*, CASE WHEN four = 4 THEN did END AS did FROM de JOIN dd ON de.tau = dd.tau AND de.is_event = dd.is_event)""".replace("REACH", str(r.REACH))


def squares(v: Views, decay: float = r.DECAY) -> DataFrame:
    """Standardised squares of weekday sessions of the long calendar, without the days that studies leave out."""
    z = r.forecasts(r.close_to_close(v.long_daily), decay).withColumn("wd", F.weekday("day").cast("long")).filter("wd < 5")
    return z.join(F.broadcast(v.excluded_days), "day", "left_anti")


def blackout() -> tuple:
    return tuple(F.expr(d) for d in BLACKOUT)


def pseudo(v: Views, reach: int = r.REACH) -> DataFrame:
    return r.pseudo_events(v.trading_days.select("day", "session"), F.expr(EVENT), blackout(), reach)


def did_rows(v: Views) -> DataFrame:
    sessions = v.trading_days.select("day", "session")
    designs = ri.did_designs(pseudo(v), sessions, blackout())
    return ri.did_by_design(designs, ri.running_sums(squares(v), sessions, (TREATED, CONTROL)), TREATED, CONTROL, WEEKDAY)


@query("long_forecast", f"WITH {recurrence()} SELECT index_name, day, round(forecast, 7) AS forecast, round(z2, 6) AS z2 FROM lz")
def long_forecast(v: Views) -> DataFrame:
    """Forecasts and standardised squares over years, scanned by blocks."""
    return r.forecasts(r.close_to_close(v.long_daily)).select("index_name", "day", F.round("forecast", 7).alias("forecast"), F.round("z2", 6).alias("z2"))


@query("randomization_did", f"WITH {DESIGNS} SELECT is_event, tau, a.day AS pre_start, b.day AS post_start, round(did, 6) AS did FROM dx JOIN trading_days a ON a.session = pre_from JOIN trading_days b ON b.session = post_from")
def randomization_did(v: Views) -> DataFrame:
    """The difference in differences of the treated unit's old weekday at the event and at every pseudo design."""
    days = v.trading_days
    start = lambda c, name: F.broadcast(days.select(F.col("session").alias(c), F.col("day").alias(name)))
    found = did_rows(v).join(start("pre_from", "pre_start"), "pre_from").join(start("post_from", "post_start"), "post_from")
    return rounded(found.select("is_event", "tau", "pre_start", "post_start", "did"), "is_event", "tau", "pre_start", "post_start")


@query("randomization_did_p", f"""WITH RECURSIVE {DESIGNS}, ta AS (SELECT tau FROM dx WHERE NOT is_event AND did IS NOT NULL), ga AS (SELECT min(tau) AS tau FROM ta UNION ALL SELECT (SELECT min(ta.tau) FROM ta WHERE ta.tau >= ga.tau + {2 * r.REACH}) FROM ga WHERE ga.tau IS NOT NULL),
    nu AS (SELECT n.did, e.did AS star FROM dx n CROSS JOIN (SELECT did FROM dx WHERE is_event AND did IS NOT NULL) e WHERE NOT n.is_event AND n.did IS NOT NULL)
    SELECT round(star, 6) AS star, count(*) AS n, round(median(did), 6) AS null_median, round(quantile_cont(did, 0.05), 6) AS q05, round(quantile_cont(did, 0.95), 6) AS q95, round(100 * avg(CASE WHEN did < star THEN 1e0 ELSE 0e0 END), 6) AS percentile, round((1 + count(*) FILTER (WHERE did >= star)) / (1e0 + count(*)), 6) AS p,
      avg(CASE WHEN did < star THEN 1e0 ELSE 0e0 END) BETWEEN 0.05 AND 0.95 AS inside, (SELECT count(tau) FROM ga) AS disjoint FROM nu GROUP BY star""")
def randomization_did_p(v: Views) -> DataFrame:
    """Percentile and upper-sided p of the event's difference, and how many designs share no session."""
    rows = did_rows(v)
    found = ri.ranked(rows.withColumnRenamed("did", "stat"), 1)
    apart = r.disjoint(rows.filter("NOT is_event AND did IS NOT NULL")).withColumnRenamed("n", "disjoint")
    return rounded(found.crossJoin(F.broadcast(apart)), "n", "inside", "disjoint")


#: The two symbols of the options channel, whose expiries trade the weekdays that they move to and from; sessions on either side.
PAIR, OLD, NEW, REACHES = ("NFT", "SNX"), "Thu", "Tue", (63, 42)


def channels(v: Views) -> DataFrame:
    """Every date of either reach with the statistics of both symbols, their difference, and that of the stocks. The quotes are read once."""
    calendar = v.trading_days
    quotes = scratch.saved(pseudo_fits.grouped(v.term_quotes).withColumnRenamed("y", "ln_var"), "term-quotes")
    stock = r.front_returns(v.stock_futures)
    out = None
    for reach in REACHES:
        dates = pseudo(v, reach)
        found = pseudo_fits.options_channel(quotes, calendar, dates, PAIR, OLD, NEW, reach)
        stocks = r.weekday_shift(dates, calendar.select("day", "session"), stock, reach).withColumnRenamed("stat", "s_stocks")
        both = dates.join(found, ["tau", "is_event"]).join(stocks, ["tau", "is_event"], "left").withColumn("h", F.lit(reach))
        out = both if out is None else out.unionByName(both)
    return out


@query("randomization_options")
def randomization_options(v: Views) -> DataFrame:
    """The options channel at the event and at every pseudo date, for both reaches. Without SQL, the fits being nonlinear; tested against single fits of the rows as they are."""
    return rounded(channels(v), "h", "tau", "day", "is_event")


@query("randomization_options_p")
def randomization_options_p(v: Views) -> DataFrame:
    """Where the event lies among the pseudo dates, by channel: both symbols, their difference, with degenerate fits and without, and the stocks."""
    rows = scratch.saved(channels(v), "randomization-channels")
    a, b = (f"s_{n.lower()}" for n in PAIR)
    fine = pseudo_fits.healthy(PAIR)
    rows = rows.withColumn("did_healthy", F.when(fine, F.col("did")))
    out = None
    for column, sign in ((a, -1), (b, 1), ("did", -1), ("did_healthy", -1), ("s_stocks", -1)):
        own = rows.select("h", "is_event", F.when(~F.isnan(column), F.col(column)).alias("stat"))
        found = ri.ranked(own, sign, "h").withColumn("channel", F.lit(column)).withColumn("side", F.lit("lower" if sign < 0 else "upper"))
        out = found if out is None else out.unionByName(found)
    return rounded(out, "h", "channel", "side", "n", "inside")
