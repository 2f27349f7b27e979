"""The surface queries over every quote, and max pain's distance at expiry."""

import datetime as dt
import re

import duckdb
import pytest

from sessvar.operators import surface
from sessvar.plans import catalogue
from sessvar.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_in_row_solver_covers_every_quote(spark):
    """The same quotes and volatilities as the SQL of implied_vol gives."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{SF}/part.parquet')")
    found = con.execute(catalogue.oracle_sql()["implied_vol"])
    names = [d[0] for d in found.description]
    key = ("trade_date", "symbol", "expiry", "strike", "opt_type")
    plain = lambda r: (str(r["trade_date"])[:10], r["symbol"], str(r["expiry"])[:10], r["strike"], r["opt_type"])
    want = {plain(r): r["iv"] for r in (dict(zip(names, row, strict=True)) for row in found.fetchall())}
    rows = surface.volatility_in_row(fixtures.Views(spark, SF).option_panel).select(*key, "iv").collect()
    got = {plain(r): r["iv"] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert len({k[1] for k in got}) == 4 and {k[4] for k in got} == {"CE", "PE"} and any((r["expiry"] - r["trade_date"]).days > 7 for r in rows)
    for k, iv in want.items():
        assert got[k] is None if iv is None else got[k] == pytest.approx(iv, abs=2e-6)


def test_gap_at_expiry_uses_the_expiry_days_spot(spark):
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 4)
    pain = spark.createDataFrame([(a, "X", b, 100.0), (a, "X", dt.date(2024, 1, 9), 100.0)], "trade_date date, symbol string, expiry date, max_pain double")
    spots = spark.createDataFrame([("X", a, 80.0), ("X", b, 125.0), ("Y", b, 1.0)], "symbol string, day date, spot double")
    (r,) = surface.max_pain_gaps(pain, spots).collect()
    assert (r["dte"], r["gap_now"], r["gap_final"]) == (3, pytest.approx(25.0), pytest.approx(20.0))


def test_quotes_are_made_and_grouped_by_tasks_of_few_chains(spark, monkeypatch):
    """Parts lie in one row group, whose task would make every quote; a chain's quotes stay in the task that made them."""
    monkeypatch.setattr(fixtures, "CHAINS_A_TASK", 20)
    v = fixtures.Views(spark, SF)
    panel = v.option_panel
    assert panel.rdd.getNumPartitions() == -(-v.part.count() // 20) > 4
    for found in (surface.pairs(panel), surface.forwards(panel.filter("dte >= 1")), surface.max_pain(panel)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert panel.count() == 22 * v.chains.count()


def test_quotes_are_priced_by_methods_that_the_jvm_compiles(spark):
    """The same values as the view's SQL, whose generated method is beyond the 8,000 bytes that the JVM compiles."""
    v = fixtures.Views(spark, SF)
    plain, priced = v.sql("SELECT * FROM option_panel"), v.option_panel
    assert priced.schema == plain.schema and priced.count() == plain.count() > 0
    assert priced.exceptAll(plain).isEmpty()
    largest = lambda df: max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen"))))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans show no code before they have run
    try:
        assert largest(v.sql("SELECT * FROM option_panel")) > 8000 > largest(v.option_panel)
        assert largest(surface.pairs(v.option_panel)) < 8000 and largest(surface.max_pain(v.option_panel)) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_smiles_solve_quotes_once_and_fit_them_by_tasks_of_few_chains(spark, monkeypatch):
    """Quotes lose their place in Python; spread by their chains again they are not fitted by the few tasks that the session's shuffle partitions make."""
    monkeypatch.setattr(fixtures, "CHAINS_A_TASK", 20)
    tasks = -(-fixtures.Views(spark, SF).part.count() // 20)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("smile_fit", "atm_variance"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInPandas") == 1 and "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", "")
        # chains for forwards, chains for quotes, solved quotes
        assert len(re.findall(rf"Exchange hashpartitioning\(trade_date#\d+, symbol#\d+, expiry#\d+, {tasks}\), REPARTITION_BY_NUM", plan)) == 3


def test_smiles_leave_out_quotes_without_an_expiry_or_a_volatility(spark):
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 4)
    quote = lambda symbol, i, iv: (a, symbol, b, 3, 3, 3 / 365, i / 10, iv, 3.0 + i)
    rows = [quote(symbol, i, 0.2 + 0.1 * i / 10 + 0.5 * i * i / 100) for symbol in ("X", None) for i in range(-3, 4)] + [quote("X", 1, None), quote("X", 1, float("nan")), *(quote("Y", i, 0.2) for i in range(5))]
    quotes = spark.createDataFrame(rows, "trade_date date, symbol string, expiry date, dte long, dte_trd long, ttm double, log_moneyness double, iv double, vega double")
    (r,) = surface.smiles(quotes).collect()
    assert (r["symbol"], r["n_quotes"]) == ("X", 6) and r["atm_iv"] == pytest.approx(0.2) and r["a1"] == pytest.approx(0.1) and r["a2"] == pytest.approx(0.5)
    assert r["resid_rms"] < 1e-12 and r["var_atm_iv"] < 1e-24
