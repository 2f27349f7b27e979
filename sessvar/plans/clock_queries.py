"""Clock queries: sessions of observations, design, demeaning, the fitted weekday weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import clock
from ..operators import clock_windows as cw
from ..sources import scratch
from ..sources.fixtures import Views
from .pricing_queries import rounded
from .registry import query


@query("observation_session_bridge", "SELECT obs_id, session, session % 5 AS wd FROM (SELECT obs_id, unnest(range(t + 1, es + 1)) AS session FROM atm_obs) x")
def observation_session_bridge(v: Views) -> DataFrame:
    return clock.bridge(v.atm_obs).select("obs_id", "session", "wd")


@query("design_matrix", """SELECT obs_id, count(*) FILTER (WHERE s % 5 = 0) AS n_Mon, count(*) FILTER (WHERE s % 5 = 1) AS n_Tue, count(*) FILTER (WHERE s % 5 = 2) AS n_Wed, count(*) FILTER (WHERE s % 5 = 3) AS n_Thu, count(*) FILTER (WHERE s % 5 = 4) AS n_Fri
    FROM (SELECT obs_id, unnest(range(t + 1, es + 1)) AS s FROM atm_obs) x GROUP BY obs_id""")
def design_matrix(v: Views) -> DataFrame:
    return clock.design(clock.bridge(v.atm_obs)).drop("symbol", "t", "ln_var")


@query("demeaned_log_variance", "SELECT obs_id, round(ln_var - avg(ln_var) OVER (PARTITION BY symbol, t), 8) AS dev FROM atm_obs")
def demeaned_log_variance(v: Views) -> DataFrame:
    return clock.demeaned(v.atm_obs, "ln_var", "symbol", "t").select("obs_id", F.round("ln_var_dev", 8).alias("dev"))


#: Tables that queries of one session share, by application and folder: a fit is made once and read again by every query that needs it.
_SHARED: dict[tuple, object] = {}


def shared(v: Views, name: str, make: Callable[[], object]) -> object:
    key = (v.spark.sparkContext.applicationId, v.sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def patterns(v: Views, observations: DataFrame) -> DataFrame:
    """The stand-in calendar, weekdays from the first quote to the last expiry, with the expiry days of the symbols observed and macro events on a day in every thirteen."""
    bounds = v.chains.agg(F.min("trade_date").alias("a"), F.max("expiry").alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("day")).filter(F.weekday("day") < 5)
    macro = days.filter(F.dayofyear("day") % 13 == 6)
    return clock.session_patterns(cal.sessions(days), observations.select("symbol").distinct(), cal.own_session_expiries(v.chains), macro)


#: A symbol whose rows cannot tell its weights: of one that can, each date's nearest expiry alone.
LONE, OF = "ONE", "AAA"


def fitted(v: Views) -> DataFrame:
    columns = ("obs_id", "symbol", "t", "es", "ln_var")
    known = v.atm_obs.filter("n_sessions >= 2")
    lone = known.filter((F.col("symbol") == OF) & (F.col("k") == 0)).withColumn("symbol", F.lit(LONE))
    rows = known.select(*columns).unionByName(lone.select(*columns))
    return shared(v, "fit", lambda: scratch.saved(clock.fit_sessions(rows, patterns(v, rows)), "clock-fit"))


@query("clock_fit", """SELECT symbol, n, day, round(CASE WHEN n >= 50 THEN raw / (sum(raw) OVER (PARTITION BY symbol) / 5e0) END, 5) AS weight
    FROM (SELECT symbol, count(*) AS n FROM atm_obs WHERE n_sessions >= 2 GROUP BY symbol) o CROSS JOIN weights w""")
def clock_fit(v: Views) -> DataFrame:
    """Weights of the weekdays, scaled to average one over the five. These rows have no noise, so their planted weights are the SQL."""
    days = ("Mon", *clock.DAYS)
    mean = sum((F.col(d) for d in days), F.lit(0.0)) / 5
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("day"), F.round(F.col(d) / mean, 5).alias("weight")) for d in days)))
    return fitted(v).filter(F.col("symbol") != LONE).select("symbol", "n", each.alias("w")).select("symbol", "n", "w.*")


@query("clock_diagnostics")
def clock_diagnostics(v: Views) -> DataFrame:
    """The whole fit: multipliers of weekend, expiry day and macro event, combined ones, condition, variance inflation, what was dropped, the verdict. Tested on planted weights."""
    return rounded(fitted(v), "symbol", "n", "dropped", "verdict")


@query("clock_refusals", f"""SELECT symbol, count(*) AS n, 'refused' AS verdict FROM (SELECT symbol FROM atm_obs WHERE n_sessions >= 2 UNION ALL SELECT '{LONE}' FROM atm_obs WHERE n_sessions >= 2 AND symbol = '{OF}' AND k = 0) x
    GROUP BY symbol HAVING symbol = '{LONE}' OR count(*) < {clock.LEAST_ROWS}""")
def clock_refusals(v: Views) -> DataFrame:
    """Symbols whose weights the rows cannot tell, by the fit of clock_fit: too few of them, or each alone on its date."""
    return fitted(v).filter("verdict <> 'ok'").select("symbol", "n", "verdict")


def windowed(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of the regimes that the expiries show, their observations (the noisy ones), and fits and draws: made once for all queries."""

    def make() -> tuple[DataFrame, DataFrame, DataFrame]:
        spans = v.chains.select(F.col("p_partkey").alias("obs_id"), "expiry")
        observations = v.atm_obs.filter("n_sessions >= 2").join(spans, "obs_id").select("obs_id", "symbol", "t", "es", F.col("trade_date").alias("opened"), "expiry", F.col("noisy").alias("ln_var"))
        windows = scratch.saved(cw.halves(cal.regimes(cal.own_session_expiries(v.chains))), "clock-regimes")
        return windows, *cw.saved_fits(observations, patterns(v, observations), windows)

    return shared(v, "windows", make)


@query("clock_regime_fits")
def clock_regime_fits(v: Views) -> DataFrame:
    """The clock within every regime and its halves, without and with macro events. Tested on planted weights and against a loop over resampled rows."""
    windows, _, raw = windowed(v)
    fits = cw.fit_table(raw, windows)
    return rounded(fits, *(c for c, kind in fits.dtypes if kind != "double"))


@query("clock_regime_draws")
def clock_regime_draws(v: Views) -> DataFrame:
    return rounded(windowed(v)[2].filter("draw >= 0").select(*cw.FIT, "draw", "parameter", "value"), *cw.FIT, "draw", "parameter")


@query("clock_regime_observations")
def clock_regime_observations(v: Views) -> DataFrame:
    _, rows, raw = windowed(v)
    return rounded(cw.observed_and_fitted(rows, raw), "symbol", "label", "obs_id", "opened", "open_weekday", "sessions")


@query("clock_identification")
def clock_identification(v: Views) -> DataFrame:
    _, rows, raw = windowed(v)
    return rounded(cw.identification(cw.observed_and_fitted(rows, raw)), "symbol", "label", "open_weekday", "sessions", "n")


@query("clock_business_time")
def clock_business_time(v: Views) -> DataFrame:
    return rounded(cw.business_time(windowed(v)[2]), "symbol", "label", "place", "session")


@query("clock_stability")
def clock_stability(v: Views) -> DataFrame:
    windows, _, raw = windowed(v)
    return rounded(cw.stability(cw.fit_table(raw, windows)), "symbol", "label", "start", "half", "spec", "parameter", "identified")


@query("clock_weights")
def clock_weights(v: Views) -> DataFrame:
    """Weekday weights of the whole regimes with their intervals."""
    windows, _, raw = windowed(v)
    days = cw.fit_table(raw, windows).filter("half = 'full'").filter(F.col("parameter").isin(*cw.WEEK))
    return rounded(days.select("symbol", "label", "start", "spec", "parameter", "point", "lo", "hi", "condition"), "symbol", "label", "start", "spec", "parameter")


@query("clock_macro_shift")
def clock_macro_shift(v: Views) -> DataFrame:
    windows, _, raw = windowed(v)
    return rounded(cw.macro_shift(cw.fit_table(raw, windows)), "symbol", "label", "start", "parameter")
