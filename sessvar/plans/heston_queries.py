"""Prices under stochastic variance on a grid of correlations and volatilities of variance, and the entry error of a flat clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import heston
from ..sources.fixtures import Views
from .registry import query

#: Spot, yearly variance, sessions of a year, speed of return.
SPOT, VARIANCE, SESSIONS, KAPPA = 25_000.0, 0.13**2, 252.0, 2.0
GRID = "VALUES_RHO CROSS JOIN VALUES_XI".replace("VALUES_RHO", "(VALUES (0e0), (-0.3e0), (-0.6e0), (-0.9e0)) AS r(rho)").replace("VALUES_XI", "(VALUES (0.2e0), (0.5e0), (0.8e0)) AS x(xi)")


def contracts(v: Views) -> DataFrame:
    """Each opening day's straddle until Tuesday's expiry, under the published clock and under a flat one, at each point of the grid."""
    spans = v.sql(f"SELECT s.opened, r.rho, x.xi, w.wd, 5 * w.raw / (SELECT sum(raw) FROM weights) AS weight FROM spans s JOIN weights w ON w.wd = s.wd CROSS JOIN {GRID}")
    # sessions in order of time: after the opening day, Tuesday last
    place = F.pmod(F.col("wd") - 2, F.lit(5))
    by = spans.groupBy("opened", "rho", "xi").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "weight"))).alias("s"))
    clock = by.select("opened", "rho", "xi", F.explode(F.array(F.struct(F.lit("clock").alias("kind"), F.col("s.weight").alias("weights")), F.struct(F.lit("flat").alias("kind"), F.transform("s", lambda x: F.lit(1.0)).alias("weights")))).alias("k")).select("opened", "rho", "xi", "k.*")
    lit = {"forward": SPOT, "strike": SPOT, "v0": VARIANCE, "theta": VARIANCE, "kappa": KAPPA, "dt": 1 / SESSIONS}
    return clock.select("*", *(F.lit(x).alias(c) for c, x in lit.items()))


@query("heston_clock_straddle")
def heston_clock_straddle(v: Views) -> DataFrame:
    """Without SQL: complex quadrature; tested against the lognormal limit, a direct flat formula and split pieces."""
    return heston.priced(contracts(v)).select("opened", "rho", "xi", "kind", F.round("call", 4).alias("call"), F.round("straddle", 4).alias("straddle"))


@query("heston_entry_error")
def heston_entry_error(v: Views) -> DataFrame:
    """Percent by which the clock's price differs from the flat one, by opening day and point of the grid."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("straddle")))
    found = heston.priced(contracts(v)).groupBy("opened", "rho", "xi").agg(of("clock").alias("clock"), of("flat").alias("flat"))
    return found.select("opened", "rho", "xi", F.round(100 * (F.col("clock") / F.col("flat") - 1), 4).alias("error_pct"))
