"""The clock over a real calendar: flags, distinct sessions, dropped parameters, one fit for both queries."""

import datetime as dt
import math

import numpy as np
import pytest

from sessvar.operators import clock

TRUE = {"Tue": 0.82, "Wed": 1.27, "Thu": 0.71, "Fri": 0.93, "weekend": 0.35, "expiry_day": 1.4, "macro_event": 2.3}


def calendar(weekends=True):
    """Weekdays less some holidays, with some Saturdays; expiries on Thursdays, then on Tuesdays; macro events."""
    days = [dt.date(2022, 8, 1) + dt.timedelta(i) for i in range(280)]
    days = [d for i, d in enumerate(days) if (d.weekday() < 5 and i % 23 != 11) or (weekends and d.weekday() == 5 and i % 4 == 1)]
    expiries = [d for i, d in enumerate(days) if d.weekday() == (3 if i < len(days) // 2 else 1)]
    return days, expiries, days[9::17]


def tables(spark, days, expiries, macro):
    frame = spark.createDataFrame
    sessions = frame([(d, i) for i, d in enumerate(days)], "day date, session long")
    return clock.session_patterns(sessions, frame([("X",)], "symbol string"), frame([("X", d) for d in expiries], "symbol string, expiry date"), frame([(d,) for d in macro], "day date"))


def observations(spark, days, expiries, macro, until=150):
    def weight(d):
        day = "weekend" if d.weekday() > 4 else ("Mon", "Tue", "Wed", "Thu", "Fri")[d.weekday()]
        return TRUE.get(day, 1.0) * (TRUE["expiry_day"] if d in expiries else 1) * (TRUE["macro_event"] if d in macro else 1)

    rng, rows, w = np.random.default_rng(3), [], [weight(d) for d in days]
    for t in range(until):
        scale = float(rng.uniform(0.2, 3.0))
        for k in range(5):
            es = t + 2 + int(rng.integers(0, 3)) + 3 * k
            rows.append((t * 5 + k, "X", t, es, math.log(scale * sum(w[t + 1 : es + 1]))))
    return spark.createDataFrame(rows, "obs_id long, symbol string, t long, es long, ln_var double")


def test_planted_flags_over_a_calendar_with_holidays_and_weekends(spark):
    case = calendar()
    found = clock.fit_sessions(observations(spark, *case), tables(spark, *case)).collect()[0]
    assert found["verdict"] == "ok" and found["dropped"] == ""
    for day in ("Tue", "Wed", "Thu", "Fri"):
        assert found[day] / found["Mon"] == pytest.approx(TRUE[day], abs=1e-5)
        assert found[f"on_{day}_expiry"] == pytest.approx(TRUE[day] * TRUE["expiry_day"], abs=1e-5)
    assert [found[k] for k in clock.EXTRA] == pytest.approx([TRUE[k] for k in clock.EXTRA], abs=1e-5)


def test_scarce_parameters_are_dropped_and_the_rest_is_fitted(spark):
    days, expiries, _ = calendar(weekends=False)
    case = days, expiries, days[40:42]  # two events, in the spans of many observations
    found = clock.fit_sessions(observations(spark, *case, until=60), tables(spark, *case)).collect()[0]
    # up to there every expiry is a Thursday and every Thursday one
    assert found["dropped"] == "weekend,expiry_day,macro_event" and found["verdict"] != "refused"
    assert found["macro_event"] is None and found["expiry_day"] is None and found["Tue"] is not None


def test_one_of_two_equal_columns_is_dropped():
    counts = np.zeros(24)
    counts[[0, 4, 8, 16]], counts[12 + 2] = 20, 20  # every Thursday is an expiry day
    kept = clock.identifiable(counts)
    assert kept == [0, 1, 2, 3]


def test_lone_observations_are_refused(spark):
    case = calendar()
    lone = observations(spark, *case).filter("obs_id % 5 = 0")
    assert clock.fit_sessions(lone, tables(spark, *case)).collect()[0]["verdict"] == "refused"


def test_refusals_filter_the_fit(spark):
    from sessvar.plans import catalogue

    fit, refusals = (catalogue.queries()[n](spark, "/root/testdata/sf0.01").collect() for n in ("clock_diagnostics", "clock_refusals"))
    assert sorted((r["symbol"], r["n"], r["verdict"]) for r in fit if r["verdict"] != "ok") == sorted(map(tuple, refusals))
    assert all(r["dropped"] is not None for r in fit if r["verdict"] != "refused")
