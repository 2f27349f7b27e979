"""Published answers that need no market data."""

import pytest

from sessvar.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalogue.queries()[name](spark, SF).collect()


def test_entry_errors(spark):
    found = {r["opened"]: r["error_pct"] for r in rows(spark, "entry_price_error")}
    assert found == pytest.approx({"Mon": -21.8, "Fri": 2.0, "Thu": -0.6, "Wed": -1.3, "Tue": 0.0}, abs=0.06)


def test_monday_spread(spark):
    assert {r["product"]: r["error"] for r in rows(spark, "calendar_spread_error")}["spread_Mon"] == pytest.approx(0.095, abs=6e-4)


def test_floor(spark):
    assert rows(spark, "floor_closed_form")[0]["floor"] == pytest.approx(12.17, abs=0.01)


def test_rate_constant(spark):
    assert any(abs(v - 144.8) < 0.1 for v in rows(spark, "rate_constants")[0].asDict().values())


def test_gamma_proxy(spark):
    found = {r["per_session"]: r["mean"] for r in rows(spark, "ekjs_proxy_mean")}
    assert found == pytest.approx({1: -0.699, 4: -0.174, 16: -0.043, 64: -0.011}, abs=6e-4)


def test_hedged_deviation(spark):
    """200,000 paths gave 136.9 for the clock trader at one hedge a session and no cost; these are 2,000."""
    found = {(r["trader"], r["cost"]): r["sd"] for r in rows(spark, "hedge_pnl")}
    assert found["clock", 0.0] == pytest.approx(136.9, rel=0.06)
