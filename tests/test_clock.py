"""The fit finds planted weights and refuses what it cannot tell."""

import math

import numpy as np
import pytest

from sessvar.operators import clock

PLANTED = [1.25, 0.7, 1.3, 0.8, 0.95]


def observations(spark, days, noise):
    rng, rows = np.random.default_rng(3), []
    for t in range(days):
        scale = float(rng.uniform(0.5, 3))
        for k in range(3):
            es = t + 1 + int(rng.integers(0, 4)) + 3 * k
            total = sum(PLANTED[d % 5] for d in range(t + 1, es + 1))
            rows.append((t * 3 + k, "X", t, es, math.log(scale * total) + noise * float(rng.standard_normal())))
    return spark.createDataFrame(rows, "obs_id long, symbol string, t long, es long, ln_var double")


def test_planted_weights(spark):
    found = clock.fit(clock.design(clock.bridge(observations(spark, 100, 0.0))), rounds=10).collect()[0]
    assert [found[d] for d in ("Mon", "Tue", "Wed", "Thu", "Fri")] == pytest.approx(PLANTED, abs=1e-4)
    assert found["verdict"] == "ok"


def test_too_few_are_refused(spark):
    found = clock.fit(clock.design(clock.bridge(observations(spark, 8, 0.0)))).collect()[0]
    assert found["verdict"] == "refused" and found["Mon"] is None


def test_empty(spark):
    assert clock.fit(clock.design(clock.bridge(observations(spark, 8, 0.0).limit(0)))).collect() == []
