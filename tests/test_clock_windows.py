"""The clock within windows: planted weights, draws against rows laid out anew, refusals, tables over the fits."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessvar.operators import clock
from sessvar.operators import clock_windows as cw

FIRST, RAW = dt.date(2024, 1, 1), np.array([1.3, 0.7, 1.2, 0.8, 1.0])
DRAWS = 4


def day(session):
    return FIRST + dt.timedelta(session // 5 * 7 + session % 5)


@pytest.fixture(scope="module")
def case(spark):
    """Weekdays of 30 weeks; macro events every 11th session, twice as heavy; three maturities a date, with noise."""
    rng, rows = np.random.default_rng(5), []
    macro = {s for s in range(150) if s % 11 == 4}
    for t in range(120):
        scale = rng.lognormal(0, 0.2)
        for k in range(3):
            es = t + 2 + 4 * k + int(rng.integers(0, 3))
            total = sum(RAW[s % 5] * (2 if s in macro else 1) for s in range(t + 1, es + 1))
            rows.append((3 * t + k, "X", t, es, day(t), day(es), math.log(scale * total) + rng.normal(0, 0.01)))
    schema = "obs_id long, symbol string, t long, es long, opened date, expiry date, ln_var double"
    patterns = spark.createDataFrame([("X", s, 4 * (s % 5) + int(s in macro)) for s in range(150)], "symbol string, session long, pattern long")
    bounds = [("X", "Tue regime", "full", day(0), day(130), "", DRAWS), ("X", "Tue regime", "h1", day(0), day(12), "m", 2), ("X", "Tue regime", "h2", day(148), day(149), "m", 2)]
    windows = spark.createDataFrame(bounds, "symbol string, label string, half string, start date, end date, split_rule string, n_boot int")
    designed, raw = cw.saved_fits(spark.createDataFrame(rows, schema), patterns, windows)
    return rows, macro, windows, designed, raw


def plain_fit(rows, macro, dates):
    """Undamped steps over the rows of the drawn dates, each date drawn a group of its own."""
    picked = [(g, r) for g, t in enumerate(dates) for r in rows if r[2] == t and r[5] <= day(130)]
    group, y = np.array([g for g, _ in picked]), np.array([r[6] for _, r in picked])
    x = np.zeros((len(picked), 150))
    for i, (_, r) in enumerate(picked):
        x[i, r[2] + 1 : r[3] + 1] = 1
    f = np.array([[*(s % 5 == k for k in range(1, 5)), s in macro] for s in range(150)], float)
    same = (group[:, None] == group[None, :]) / np.bincount(group)[group][:, None]
    inner, theta = np.eye(len(y)) - same, np.zeros(5)
    for _ in range(30):
        w = np.exp(f @ theta)
        slope = inner @ ((x * w) @ f / (x @ w)[:, None])
        theta = theta + np.linalg.lstsq(slope, inner @ (y - np.log(x @ w)), rcond=None)[0]
    return theta


def ratios(found):
    return [math.log(found[d] / found["Mon"]) for d in clock.DAYS] + [math.log(found["macro_event"])]


def test_point_and_draws_equal_fits_of_rows_laid_out_anew(case):
    rows, macro, _, _, raw = case
    got = {}
    for r in raw.filter("half = 'full' AND spec = 'macro'").collect():
        got.setdefault(r["draw"], {})[r["parameter"]] = r["value"]
    dates = sorted({r[2] for r in rows if r[5] <= day(130)})
    assert sorted(got) == [-1, *range(DRAWS)]
    assert ratios(got[-1]) == pytest.approx(plain_fit(rows, macro, dates), abs=1e-6)
    assert ratios(got[-1]) == pytest.approx([*np.log(RAW[1:] / RAW[0]), math.log(2)], abs=0.05)
    for draw in range(DRAWS):
        pick = np.random.default_rng([0, draw]).integers(0, len(dates), len(dates))
        assert ratios(got[draw]) == pytest.approx(plain_fit(rows, macro, [dates[i] for i in pick]), abs=1e-6)


def test_levels_average_one_over_the_sessions_of_the_window(case):
    rows, macro, _, _, raw = case
    found = {r["parameter"]: r["value"] for r in raw.filter("half = 'full' AND spec = 'macro' AND draw = -1").collect()}
    spanned = {s for r in rows if r[5] <= day(130) for s in range(r[2] + 1, r[3] + 1)}
    mean = np.mean([found[cw.WEEK[s % 5]] * (found["macro_event"] if s in macro else 1) for s in spanned])
    assert mean == pytest.approx(1, abs=1e-9)


def test_fit_table_and_what_is_made_of_it(case):
    _, _, windows, designed, raw = case
    table = cw.fit_table(raw, windows)
    rows = {(r["half"], r["spec"], r["parameter"]): r for r in table.collect()}
    drawn = [r["value"] for r in raw.filter("half = 'full' AND spec = 'macro' AND draw >= 0 AND parameter = 'Tue'").collect()]
    tue = rows["full", "macro", "Tue"]
    assert (tue["lo"], tue["hi"]) == pytest.approx(tuple(np.percentile(drawn, [2.5, 97.5])))
    assert tue["identified"] and tue["flag"] == "" and tue["n_draws"] == DRAWS and tue["boundary_share"] == 0 and tue["dropped"] == "weekend"
    assert rows["full", "macro", "Mon"]["vif"] is None and tue["vif"] >= 1
    # few observations, and none at all
    assert rows["h1", "weekday", "Fri"]["flag"].startswith("refused") and rows["h1", "weekday", "Fri"]["point"] is None
    assert rows["h2", "macro", "Mon"]["flag"] == "refused: 0 observations" and not rows["h2", "macro", "Mon"]["weekdays_in_range"]
    shift = {r["parameter"]: r["rel_change"] for r in cw.macro_shift(table).collect()}
    assert shift.keys() == set(cw.WEEK) and shift["Tue"] == pytest.approx(tue["point"] / rows["full", "weekday", "Tue"]["point"] - 1)
    assert {r["parameter"] for r in cw.stability(table).collect()} == {"Tue"}
    path = sorted(cw.business_time(raw).collect(), key=lambda r: r["place"])
    assert [r["session"] for r in path] == ["start", "Wed", "Thu", "Fri", "Mon", "Tue"] and path[-1]["clock_cum"] == pytest.approx(5)
    seen = cw.observed_and_fitted(designed, raw)
    rmse = seen.agg(F.sqrt(F.avg(F.pow(F.col("observed_dm") - F.col("fitted_dm"), F.lit(2))))).first()[0]
    assert rmse == pytest.approx(rows["full", "weekday", "Tue"]["rmse"], rel=1e-6)
    assert all(r["n"] >= 5 and r["sessions"] <= 12 for r in cw.identification(seen).collect())


def test_windows_of_a_weekday_that_comes_back_keep_apart(spark):
    bounds = [("X", w, day(a), day(b)) for w, a, b in ((3, 3, 40), (1, 41, 80), (3, 83, 120))]
    found = cw.halves(spark.createDataFrame(bounds, "symbol string, regime_wd int, start date, end date")).collect()
    assert len({(r["label"], r["half"]) for r in found}) == 9
    assert {r["label"] for r in found} == {"Thu regime", "Tue regime", "Thu regime 2"}
    halves = {r["half"]: r for r in found if r["label"] == "Tue regime"}
    assert halves["h1"]["end"] + dt.timedelta(1) == halves["h2"]["start"] and (halves["h1"]["start"], halves["h2"]["end"]) == (day(41), day(80))


def test_draws_are_made_of_shapes_of_dates(spark, case, monkeypatch):
    """What a group of draws holds does not grow with quotes or their sessions, and blocks of dates are put together in order."""
    rows, _, _, designed, raw = case
    monkeypatch.setattr(cw, "BLOCK", 16)
    parts = cw.blocks(designed.filter("half = 'full'")).collect()
    within = [r for r in rows if r[5] <= day(130)]
    assert {c for p in parts for c in p.asDict()} == {*cw.WINDOW, "n_boot", "block", "sessions", "shapes", "codes", "ln_var"}
    assert sum(len(p["codes"]) for p in parts) == 4 * len({r[2] for r in within}) and sum(len(p["ln_var"]) for p in parts) == 8 * len(within)
    key = ("half", "spec", "draw", "parameter")
    values = lambda table: {tuple(r[c] for c in key): r["value"] for r in table.collect()}
    got, want = values(cw.resampled(designed)), values(raw)
    assert got.keys() == want.keys() and all(want[k] is None or got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_sessions_of_a_window_are_counted_without_a_copy_for_each_pattern(spark):
    schema = "obs_id long, symbol string, t long, es long, opened date, expiry date, ln_var double"
    seen = spark.createDataFrame([(1, "X", 0, 4, day(0), day(4), 0.1), (2, "X", 0, 6, day(0), day(6), 0.2)], schema)
    patterns = spark.createDataFrame([("X", s, 4 * (s % 5)) for s in range(9)], "symbol string, session long, pattern long")
    windows = spark.createDataFrame([("X", "Tue regime", "full", day(0), day(9), "", 1)], "symbol string, label string, half string, start date, end date, split_rule string, n_boot int")
    found = cw.designed(seen, patterns, windows)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    counts = [0] * 24
    for s in range(1, 7):
        counts[4 * (s % 5)] += 1
    assert [list(r["sessions"]) for r in found.collect()] == [counts, counts]
