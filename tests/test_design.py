"""Event designs, closed-form prices and sources, against plain versions."""

import datetime as dt
import io
import math
import zipfile
from collections import Counter

import numpy as np
import pytest

from sessvar.operators import calendar, design, heston
from sessvar.sources import files


def lognormal_call(f, k, v):
    cdf = lambda x: math.erfc(-x / math.sqrt(2)) / 2
    d = (math.log(f / k) + v / 2) / math.sqrt(v)
    return f * cdf(d) - k * cdf(d - math.sqrt(v))


def test_little_volatility_of_variance_is_lognormal():
    for k in (90.0, 100.0, 115.0):
        assert heston.call(100.0, k, [(1.0, 0.5)], 0.04, 2.0, 0.04, 1e-3, -0.5) == pytest.approx(lognormal_call(100.0, k, 0.02), abs=2e-3)


def test_pieces_can_be_split_and_carry_their_clock():
    whole = heston.call(100.0, 103.0, [(1.4, 0.2), (0.6, 0.1)], 0.05, 1.5, 0.04, 0.6, -0.7)
    assert heston.call(100.0, 103.0, [(1.4, 0.05), (1.4, 0.15), (0.6, 0.04), (0.6, 0.06)], 0.05, 1.5, 0.04, 0.6, -0.7) == pytest.approx(whole, abs=1e-9)
    # without noise of the variance only the weighted time counts
    mixed = heston.call(100.0, 100.0, [(1.5, 0.1), (0.5, 0.1)], 0.04, 1.0, 0.04, 1e-3, 0.0)
    assert mixed == pytest.approx(lognormal_call(100.0, 100.0, 0.04 * 0.2), abs=2e-3)


def test_exponents_solve_their_equation():
    u, kappa, theta, xi, rho, w = np.array([0.7 - 0.5j, 3.0 - 0.5j]), 1.3, 0.05, 0.4, -0.6, 1.2
    b, a, n = np.zeros(2, complex), np.zeros(2, complex), 20_000
    for _ in range(n):  # small steps of the differential equation
        slope = lambda b: -w * (u * u + 1j * u) / 2 - (kappa - 1j * rho * xi * math.sqrt(w) * u) * b + xi * xi / 2 * b * b
        k1 = slope(b)
        k2 = slope(b + k1 * 0.3 / n / 2)
        a, b = a + kappa * theta * (b + k1 * 0.3 / n / 2) * 0.3 / n, b + k2 * 0.3 / n
    got = heston.exponents(u, [(w, 0.3)], kappa, theta, xi, rho)
    np.testing.assert_allclose(got[0], a, atol=1e-8)
    np.testing.assert_allclose(got[1], b, atol=1e-8)


def test_entry_errors_move_little_with_the_variance_s_noise(spark):
    from sessvar.plans import catalogue

    found = {(r["opened"], r["rho"], r["xi"]): r["error_pct"] for r in catalogue.queries()["heston_entry_error"](spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == 60
    monday = [e for (opened, _, _), e in found.items() if opened == "Mon"]
    assert all(abs(e + 21.831) < 0.02 for e in monday)
    assert all(abs(e) < 0.5 for (opened, _, _), e in found.items() if opened == "Tue")


def test_roles_against_a_loop(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(182) if (dt.date(2024, 1, 1) + dt.timedelta(i)).weekday() < 5]
    own = [("S", d) for d in days if d.weekday() == (3 if d < dt.date(2024, 4, 1) else 1)] + [("T", d) for i, d in enumerate(d for d in days if d.weekday() == 2) if i % 4 == 0]
    pre, post = ("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-06-30")
    got = {r["symbol"]: r for r in design.roles(spark.createDataFrame(own, "symbol string, expiry date"), spark.createDataFrame([(d,) for d in days], "day date"), pre, post).collect()}
    for symbol in "ST":
        doses = []
        for a, b in (pre, post):
            inside = [d for s, d in own if s == symbol and a <= str(d) <= b]
            wd = Counter(d.weekday() for d in inside).most_common(1)[0][0]
            pool = [d for d in days if a <= str(d) <= b and d.weekday() == wd]
            doses.append((wd, sum(d in inside for d in pool) / len(pool)))
        r = got[symbol]
        assert (r["old_wd"], r["new_wd"]) == (doses[0][0], doses[1][0]) and [r["dose_pre"], r["dose_post"]] == pytest.approx([x for _, x in doses])
    assert got["S"]["role"] == "treated" and got["T"]["role"] == "control"


def test_timeline_of_a_planted_calendar(spark):
    weeks = [dt.date(2024, 1, 1) + dt.timedelta(7 * i) for i in range(40)]
    own = [("S", w + dt.timedelta((3 if i < 20 else 1) - (i == 10))) for i, w in enumerate(weeks)]
    sessions = calendar.sessions(spark.createDataFrame([(dt.date(2025, 2, 1),), (dt.date(2025, 2, 3),)], "day date"))
    rows = design.timeline(spark.createDataFrame(own, "symbol string, expiry date"), sessions).collect()
    assert sorted((r["what"], r["regime_wd"], r["n"], r["kind"]) for r in rows if r["what"] == "regime") == [("regime", 1, 20, None), ("regime", 3, 20, None)]
    assert [(r["start"], r["days_early"], r["kind"]) for r in rows if r["what"] == "roll"] == [(weeks[10] + dt.timedelta(2), 1, "backward_roll")]
    assert [(r["start"], r["kind"]) for r in rows if r["what"] == "weekend"] == [(dt.date(2025, 2, 1), "union_budget")]


def test_sources(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.csv", "A, B,C\n1, x,\n2, y,3\n")
        z.writestr("b.csv", "A,B,C\n9,z,9\n")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "one.zip").write_bytes(buffer.getvalue())
    assert sorted(map(tuple, files.zipped_csv(spark, str(tmp_path / "z"), ["A", "B", "D"]).collect())) == [("1", "x", None), ("2", "y", None)]
    with pytest.raises(Exception, match="(?i)path"):
        files.zipped_csv(spark, str(tmp_path / "none"), ["A"]).collect()
    (tmp_path / "i.csv").write_bytes("\ufeffIndex Name, Close\n NIFTY 50 , 22000.5\nX,-\n".encode())
    index = files.index_csv(spark, str(tmp_path / "i.csv"), ("Close",))
    assert index.columns == ["Index Name", "Close"] and sorted(map(tuple, index.collect()), key=str) == [("NIFTY 50", 22000.5), ("X", None)]
    spark.createDataFrame([(1, "a")], "x int, y string").write.parquet(str(tmp_path / "p1"))
    spark.createDataFrame([(2, 0.5)], "x int, z double").write.parquet(str(tmp_path / "p2"))
    assert sorted(map(tuple, files.panels(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")]).collect())) == [(1, "a", None), (2, None, 0.5)]
    files.write_json({"trading_days": ["2024-01-02", "2024-01-01"]}, str(tmp_path / "c.json"))
    assert files.calendar_days(str(tmp_path / "c.json")) == ["2024-01-01", "2024-01-02"]
    assert [(r["day"].day, r["session"]) for r in files.calendar(spark, str(tmp_path / "c.json")).collect()] == [(1, 0), (2, 1)]


def test_manifests_and_audit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"abc")
    (tmp_path / "in" / "b").write_bytes(b"xyz")
    found = files.digests(spark, str(tmp_path / "in"))
    payload = files.manifest("t", {"b": 1, "a": 2}, found, {"spark.sql.ansi.enabled": "true"}, seed=7)
    assert payload["inputs"]["a"].startswith("ba7816bf") and payload["config"] == files.text_digest({"a": 2, "b": 1})
    listed = spark.createDataFrame([("a", payload["inputs"]["a"]), ("b", "0"), ("c", "0")], "file string, sha256 string")
    assert sorted(map(tuple, files.audit(found, listed).collect())) == [("a", "ok"), ("b", "changed"), ("c", "missing")]
    assert files.checked_start(dt.date(2024, 1, 1)) == dt.date(2024, 1, 1)
    with pytest.raises(ValueError, match="older format"):
        files.checked_start(dt.date(2023, 12, 29))


def test_years_and_tables_are_written_sorted_and_replaced(spark, tmp_path):
    rows = [(dt.date(2024 + i % 2, 1, 1 + i), "S", dt.date(2025, 6, 1), ("CE", None)[i % 3 == 0], float(i)) for i in range(8)]
    panel = spark.createDataFrame(rows, "trade_date date, symbol string, expiry date, opt_type string, strike double")
    files.write_years(panel, str(tmp_path / "y"))
    assert sorted(p.name for p in (tmp_path / "y").glob("year=*")) == ["year=2024", "year=2025"]
    assert spark.read.parquet(str(tmp_path / "y")).filter("year = 2024").count() == 4
    for _ in range(2):
        files.write_table(panel, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8 and len(list((tmp_path / "t").glob("*.parquet"))) == 1
