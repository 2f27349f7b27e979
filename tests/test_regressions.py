"""Cases that once went wrong."""

from sessvar.operators import returns, surface


def test_solving_volatilities_leaves_the_frame_as_it_was(spark):
    quotes = spark.createDataFrame([(100.0, 100.0, 0.25, True, 4.0)], "fwd double, strike double, ttm double, call boolean, price double")
    found = surface.with_volatility(quotes, quotes["price"], quotes["fwd"], quotes["strike"], quotes["ttm"], quotes["call"])
    assert quotes.columns == ["fwd", "strike", "ttm", "call", "price"] and found.columns[-1] == "iv"
    assert abs(found.first()["iv"] - 0.2006) < 1e-3


def test_pairs_need_trades_and_volume_on_both_sides(spark):
    rows = [("d", "S", "e", 100.0 + k, 5, side, 3.0, volume, 9) for k, volume in enumerate((1, 0)) for side in ("CE", "PE")]
    panel = spark.createDataFrame(rows, "trade_date string, symbol string, expiry string, strike double, dte int, opt_type string, settle double, volume int, n_trades int")
    assert [r["strike"] for r in surface.pairs(panel).collect()] == [100.0]


def test_prices_of_zero_have_no_return(spark):
    daily = spark.createDataFrame([("i", 0, 0.0, 1.0, 0.0, 2.0), ("i", 1, 0.0, 1.0, 0.0, 0.0), ("i", 2, 1.0, 1.0, 0.5, 1.0)], "index_name string, session int, open double, high double, low double, close double")
    assert [r["r"] for r in returns.close_to_close(daily).orderBy("session").collect()] == [None, None, None]
    assert returns.range_variances(daily).count() == 0


def test_an_event_without_a_statistic_has_no_p(spark):
    stats = spark.createDataFrame([(1, True, None), (2, False, 0.5)], "tau int, is_event boolean, stat double")
    assert returns.rank_p(stats).collect() == []
