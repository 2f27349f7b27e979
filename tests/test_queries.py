"""Every query with SQL gives the same rows as DuckDB does over the same files; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from sessvar.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Without rows on the smallest tables: their twelve days have no roll.
# too few dates on the smallest tables: every window is refused
NONE_HERE = {"holiday_rolls_of_regimes", "clock_regime_draws", "clock_regime_observations", "clock_identification", "clock_business_time", "clock_macro_shift"}
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{float(value):.6g}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.6g}"
    return str(value)[:10] if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name not in SQL:
        assert got or name in NONE_HERE
        return
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted([plain(r[i]) for i in places] for r in found.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            if x != y:
                assert float(x) == pytest.approx(float(y), rel=1e-4, abs=1e-6)
