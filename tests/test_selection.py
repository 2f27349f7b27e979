"""Exact medians against sorted lists."""

import math
import random
from statistics import median

import pytest

from sessvar.operators import selection


@pytest.mark.parametrize(("cells", "most"), [(4, 3), (64, 50), (selection.CELLS, selection.SORTED)])
def test_medians_are_exact(spark, cells, most):
    rng = random.Random(3)
    groups = {
        ("a", 1): [rng.gauss(0, 1) for _ in range(501)],
        ("a", 2): [rng.choice((1.0, 2.0, 3.0)) for _ in range(400)],
        ("b", 1): [math.exp(rng.uniform(-40, 40)) for _ in range(300)],
        ("b", None): [5.0] * 200,
        (None, 1): [1.0, 4.0],
        (None, None): [-1e300, 1e300, 7.0],
        ("", 0): [2.5],
        ("two", 0): [0.1] * 100 + [0.2] * 100,
    }
    rows = [(*k, v, "clash") for k, values in groups.items() for v in values] + [("a", 1, None, "x"), ("only nulls", 1, None, "x"), ("a", 1, float("nan"), "x")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, h int, v double, n string").repartition(5)
    got = {(r.g, r.h): (r.n, r["median"]) for r in selection.medians(frame, ["g", "h"], "v", cells, most).collect()}
    assert got == {k: (len(v), pytest.approx(median(v), rel=1e-15)) for k, v in groups.items()}
    assert selection.medians(frame.filter("false"), ["g", "h"], "v").count() == 0
