"""Designs by running sums and fits by runs of windows against plain loops over the rows as they are."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessvar.operators import clock, clock_windows, pseudo_fits, randomization, returns

START = dt.date(2031, 3, 3)  # a Monday


def calendar(n):
    """Sessions: weekdays without every 17th day, and each fifth Saturday."""
    days = [START + dt.timedelta(k) for k in range(3 * n)]
    kept = [d for k, d in enumerate(days) if k % 17 and (d.weekday() < 5 or d.weekday() == 5 and k % 5 == 0)][:n]
    return [(d, s, d.weekday()) for s, d in enumerate(kept)]


@pytest.mark.parametrize("decay", [0.9, 0.94, 0.9995])
def test_forecasts_against_a_loop(spark, decay):
    rng = random.Random(8)
    series = {"long": [rng.gauss(0, 1) for _ in range(900)], "short": [0.5, -1.0, 2.0], "one": [0.3], "zero": [0.0] * 5 + [1.0]}
    rows = [(name, s, START + dt.timedelta(s), r if s % 50 != 7 else None) for name, values in series.items() for s, r in enumerate(values)]
    got = {(r.index_name, r.session): (r.forecast, r.z2) for r in returns.forecasts(spark.createDataFrame(rows, "index_name string, session long, day date, r double"), decay).collect()}
    for name, values in series.items():
        kept = [(s, r) for s, r in enumerate(values) if s % 50 != 7]
        f = np.mean([r * r for _, r in kept[:20]])
        for s, r in kept:
            forecast, z2 = got.pop((name, s))
            assert forecast == pytest.approx(f, rel=1e-9, abs=1e-300)
            assert z2 == pytest.approx(r * r / f, rel=1e-9) if f else z2 is None
            f = decay * f + (1 - decay) * r * r
    assert not got


def test_differences_by_design_against_a_loop(spark):
    rng = random.Random(2)
    days = calendar(150)
    z = [(u, s, wd, rng.expovariate(1) if rng.random() < 0.97 else None) for u in ("t", "c", "other") for _, s, wd in days if wd < 5 and not (u == "t" and 40 <= s < 70 and wd == 3)]
    sessions = spark.createDataFrame([(d, s) for d, s, _ in days], "day date, session long")
    frame = spark.createDataFrame(z, "index_name string, session long, wd long, z2 double")
    blackout = (days[60][0], days[71][0])
    dates = returns.pseudo_events(sessions, F.lit(days[100][0]), tuple(map(F.lit, blackout)), 20, 5)
    designs = randomization.did_designs(dates, sessions, tuple(map(F.lit, blackout)), 20)
    got = {(r.is_event, r.tau): r for r in randomization.did_by_design(designs, randomization.running_sums(frame, sessions, ("t", "c")), "t", "c", 3).collect()}
    assert (got[True, 60].pre_from, got[True, 60].post_from, got[True, 60].post_to) == (40, 72, 91)
    assert len(got) == designs.count() > 8

    def weight(unit, low, high):
        inside = [(wd, v) for u, s, wd, v in z if u == unit and low <= s <= high and v is not None]
        own = [v for wd, v in inside if wd == 3]
        return math.log(np.mean(own) / np.mean([v for _, v in inside])) if own else None

    nulls = 0
    for r in got.values():
        parts = [weight(u, *w) for u in "tc" for w in ((r.pre_from, r.pre_to), (r.post_from, r.post_to))]
        if None in parts:
            nulls += 1
            assert r.did is None
        else:
            assert r.did == pytest.approx(parts[1] - parts[0] - parts[3] + parts[2], abs=1e-9)
    assert nulls


def test_ranks(spark):
    rows = [(1, i, False, float(i)) for i in range(20)] + [(1, 99, True, 18.5), (1, 98, False, None), (2, 1, False, 1.0), (2, 2, True, None)]
    stats = spark.createDataFrame(rows, "h int, tau int, is_event boolean, stat double")
    (up,) = randomization.ranked(stats, 1, "h").collect()
    (down,) = randomization.ranked(stats, -1, "h").collect()
    assert (up.h, up.n, up.star, up.percentile, up.p, up.inside) == (1, 20, 18.5, 95.0, 2 / 21, True)
    assert down.p == 20 / 21 and down.null_median == 9.5


def planted(days, rng, per_day=9):
    weight = {0: 1.3, 1: 0.7, 2: 1.05, 3: 1.15, 4: 0.85, 5: 0.5}
    quotes = []
    for _, t, _ in days:
        scale = rng.uniform(0.5, 2)
        for k in range(per_day):
            es = min(t + 2 + rng.randrange(7), len(days) - 1)
            total = sum(weight[wd] for _, s, wd in days[t + 1 : es + 1])
            if total:
                quotes.append((len(quotes), "A" if k % 3 else "B", t, es, math.log(scale * total) + rng.gauss(0, 0.05)))
    return quotes + [(10**6, "B", 5, 5, 0.0), (10**6 + 1, "B", 5, 7, None)]


def test_window_fits_against_single_fits_of_every_quote(spark):
    days = calendar(90)
    rng = random.Random(3)
    quotes = planted(days, rng)
    frame = spark.createDataFrame(quotes, "obs_id long, symbol string, t long, es long, ln_var double")
    cal = spark.createDataFrame(days, "day date, session long, wd int")
    reach, taus = 25, [25, 30, 35, 40, 45, 50, 55, 60, 63, 65]
    designs = spark.createDataFrame([(t, t == 63) for t in taus], "tau long, is_event boolean")
    starts = pseudo_fits.window_starts(designs, reach)
    assert starts == sorted({s for t in taus for s in (t - reach, t)})
    got = {(r.symbol, r.start): r for r in pseudo_fits.window_fits(frame, cal, starts, reach).collect()}
    kinds = [wd for *_, wd in days]
    for symbol in "AB":
        for start in starts:
            own = sorted((t, i, es, y) for i, s, t, es, y in quotes if s == symbol and es > t and y is not None and t >= start and es <= start + reach - 1)
            r = got.pop((symbol, start))
            assert r.n_obs == len(own)
            if len(own) < clock.LEAST_ROWS:
                assert r.refusal and r.Mon is None
                continue
            counts = np.zeros((len(own), 24))
            seen = set()
            for row, (t, _, es, _) in zip(counts, own, strict=True):
                seen |= set(range(t + 1, es + 1))
                for s in range(t + 1, es + 1):
                    row[4 * kinds[s]] += 1
            spanned = np.bincount([4 * kinds[s] for s in seen], minlength=24).astype(float)
            kept = clock.identifiable(spanned, pseudo_fits.AMONG)
            single = clock_windows.Quotes(counts, np.array([t for t, *_ in own]), np.array([y for *_, y in own]))
            theta = single.solved(clock.FEATURES[:, kept], np.zeros(len(kept)), np.ones(len(single.sizes)))
            want = clock_windows.levels(theta, kept, spanned)
            singular = np.linalg.svd(single.linearised(theta, clock.FEATURES[:, kept])[1], compute_uv=False)
            assert [r[d] for d in clock_windows.WEEK] == pytest.approx([math.log(want[d]) for d in clock_windows.WEEK], abs=1e-6)
            assert r.condition == pytest.approx(singular[0] / singular[-1], rel=1e-6) and r.refusal == ""
    assert not got

    found = {r.tau: r for r in pseudo_fits.options_channel(frame, cal, designs, ("A", "B"), "Thu", "Tue", reach).collect()}
    fits = {(r.symbol, r.start): r for r in pseudo_fits.window_fits(frame, cal, starts, reach).collect()}
    for tau in taus:
        pre, post = fits["A", tau - reach], fits["A", tau]
        assert found[tau].s_a == pytest.approx(post.Tue - pre.Tue - post.Thu + pre.Thu, abs=1e-12)
        assert found[tau].cond_a == max(pre.condition, post.condition)
        assert found[tau].logw_a == max(abs(f[d]) for f in (pre, post) for d in clock_windows.WEEK)


def test_refused_windows_give_no_statistic(spark):
    days = calendar(60)
    quotes = [q for q in planted(days, random.Random(5)) if q[1] == "A" or q[2] < 4]
    frame = spark.createDataFrame(quotes, "obs_id long, symbol string, t long, es long, ln_var double")
    cal = spark.createDataFrame(days, "day date, session long, wd int")
    designs = spark.createDataFrame([(30, True), (25, False)], "tau long, is_event boolean")
    found = pseudo_fits.options_channel(frame, cal, designs, ("A", "B"), "Thu", "Tue", 25)
    rows = found.withColumn("fine", pseudo_fits.healthy(("A", "B"))).collect()
    assert len(rows) == 2 and all(r.s_b is None and r.did is None and r.cond_b == math.inf and not r.fine and r.s_a is not None for r in rows)
