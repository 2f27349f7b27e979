"""Dose-response statistics and the draws of the options channel against plain loops over the quotes as they are."""

import math
import random

import numpy as np
import pytest

from sessvar.operators import clock, clock_windows, dose, pseudo_fits
from test_randomization import calendar, planted

WEEK = clock_windows.WEEK


def frames(spark, days, quotes, cuts):
    cal = spark.createDataFrame(days, "day date, session long, wd int")
    rows = [("e", "v", part, days[a][0], days[b][0]) for part, (a, b) in enumerate(cuts)]
    return cal, spark.createDataFrame(quotes, "obs_id long, symbol string, t long, es long, ln_var double"), spark.createDataFrame(rows, "event string, variant string, part int, start date, end date")


def single(own, kinds, times):
    """Log weights of one fit in which each date's quotes stand as often as ``times`` says, every one a row of its own."""
    rows = [(t + 1000 * copy, t, es, y) for t, _, es, y in own for copy in range(times.get(t, 0))]
    counts = np.zeros((len(rows), 24))
    for row, (_, t, es, _) in zip(counts, rows, strict=True):
        for s in range(t + 1, es + 1):
            row[4 * kinds[s]] += 1
    spanned = np.bincount([4 * kinds[s] for s in sorted({s for t, _, es, _ in own for s in range(t + 1, es + 1)})], minlength=24).astype(float)
    kept = clock.identifiable(spanned, pseudo_fits.AMONG)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    quotes = clock_windows.Quotes(counts[order], np.array([rows[i][0] for i in order]), np.array([rows[i][3] for i in order]))
    theta = quotes.solved(clock.FEATURES[:, kept], np.zeros(len(kept)), np.ones(len(quotes.sizes)))
    found = clock_windows.levels(theta, kept, spanned)
    return [math.log(found[d]) for d in WEEK]


def test_points_and_draws_are_single_fits(spark):
    days = calendar(80)
    quotes = planted(days, random.Random(11))
    cuts = ((2, 36), (40, 79))
    cal, frame, windows = frames(spark, days, quotes, cuts)
    got = {}
    rows = dose.date_weights(frame, cal, windows, draws=3).collect()
    for r in rows:
        got.setdefault((r.unit, r.part, r.draw), {})[r.wd] = r.lw
    kinds = [wd for *_, wd in days]
    assert len(got) == 16
    for (unit, part, draw), found in got.items():
        low, high = cuts[part]
        own = sorted((t, i, es, y) for i, s, t, es, y in quotes if s == unit and es > t and y is not None and t >= low and es <= high)
        picks = np.random.default_rng([part, draw]).integers(0, high - low + 1, high - low + 1)
        times = {t: 1 for t, *_ in own} if draw == 0 else {low + k: int(m) for k, m in enumerate(np.bincount(picks))}
        assert [found[k] for k in range(5)] == pytest.approx(single(own, kinds, times), abs=1e-6)


def test_statistics_of_known_weights(spark):
    rng = random.Random(1)
    lw = {(case, draw, u, part, wd): rng.gauss(0, 1) for case in ("pair", "both") for draw in range(40) for u in "ab" for part in (0, 1) for wd in range(5)}
    weights = [("e", case, draw, u, part, wd, x, 7 if draw == 0 else 0) for (case, draw, u, part, wd), x in lw.items() if not (case == "both" and draw == 3 and u == "a" and part == 1 and wd == 4)]
    roles = [("e", "pair", "a", 2, 4, 0.2, 0.3, True), ("e", "pair", "b", 3, 3, 1.0, 1.0, False), ("e", "both", "a", 0, 4, 1.0, 0.25, True), ("e", "both", "b", 1, 2, 1.0, 1.0, True), ("e", "lone", "a", 1, 2, 1.0, 1.0, True)]
    found = spark.createDataFrame(roles, "event string, variant string, unit string, old_wd long, new_wd long, dose_pre double, dose_post double, treated boolean")
    frame = spark.createDataFrame(weights, "event string, variant string, draw int, unit string, part int, wd long, lw double, n long")
    got = {(r.variant, r.quantity, r.symbol, r.label): r for r in dose.estimates(frame, found).collect()}

    def value(case, draw, *terms):
        return sum(c * lw[case, draw, u, part, wd] for c, u, part, wd in terms)

    did = [value("pair", d, (1, "a", 1, 2), (-1, "a", 0, 2), (-1, "b", 1, 2), (1, "b", 0, 2)) for d in range(40)]
    gap = [value("pair", d, (1, "a", 0, 2), (-1, "b", 0, 2)) for d in range(40)]
    own = [value("pair", d, (1, "b", 1, 3), (-1, "b", 0, 3)) for d in range(40)]
    shift = {u: [value("both", d, (1, u, 1, new), (-1, u, 0, new), (-1, u, 1, old), (1, u, 0, old)) for d in range(40)] for u, old, new in (("a", 0, 4), ("b", 1, 2))}
    ratio = [x / y for x, y in zip(shift["a"], shift["b"], strict=True)]
    del shift["a"][3], ratio[3]
    for key, values, missing in ((("pair", "did", "a", "Wed"), did, 0), (("pair", "level_gap_pre", "a", "Wed"), gap, 0), (("pair", "delta_own", "b", "Thu"), own, 0), (("both", "S", "a", "Mon->Fri"), shift["a"], None), (("both", "S", "b", "Tue->Wed"), shift["b"], 0), (("both", "dose_ratio", "a", "a/b"), ratio, 1)):
        r = got[key]
        assert r.estimate == pytest.approx(values[0]) and r.low == pytest.approx(np.percentile(values[1:], 2.5)) and r.high == pytest.approx(np.percentile(values[1:], 97.5))
        assert missing is None or r.not_finite == missing
    assert len(got) == 6 + 40 and got["pair", "ln_w_pre", "a", "Mon"].n == 7


@pytest.mark.parametrize("kept", [None, 0, 30])
def test_a_refused_or_missing_fit_leaves_its_case_unreadable(spark, kept):
    days = calendar(80)
    quotes = planted(days, random.Random(12))
    if kept is not None:
        early = [q for q in quotes if q[1] == "B" and q[2] <= 36]
        quotes = [q for q in quotes if q not in early] + early[:kept]
    cal, frame, windows = frames(spark, days, quotes, ((2, 36), (40, 79)))
    rows = dose.date_weights(frame, cal, windows, draws=1)
    assert [(r.unit, r.part, r.lw) for r in rows.collect() if r.refusal] == ([("B", 0, None)] if kept else [])
    assert dose.readable(rows).first().readable == (kept is None)


def test_roles(spark):
    days = calendar(80)
    cal, _, windows = frames(spark, days, [(0, "A", 0, 1, 0.0)], ((0, 36), (40, 79)))
    ends = [("treated", d) for d, s, wd in days if wd == (3 if s < 38 else 1)] + [("control", d) for d, _, wd in days if wd == 2 and d.day < 8] + [("absent", days[1][0])]
    got = {r.unit: r for r in dose.roles(spark.createDataFrame(ends, "symbol string, expiry date"), cal.select("day"), windows).collect()}
    assert set(got) == {"treated", "control"}
    assert (got["treated"].treated, got["treated"].old_wd, got["treated"].new_wd, got["treated"].dose_pre, got["treated"].dose_post) == (True, 3, 1, 1.0, 1.0)
    pool = [d for d, s, wd in days if wd == 2 and s <= 36]
    assert not got["control"].treated and got["control"].dose_pre == pytest.approx(sum(d.day < 8 for d in pool) / len(pool))
