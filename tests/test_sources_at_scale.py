"""Archives, pruned panels, observed manifests and incremental ingest: what is read, and that it is read once."""

import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sessvar.sources import archives, files, panel
from sessvar.streaming import ingest


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def zipped(tmp_path):
    for k in range(8):
        with zipfile.ZipFile(tmp_path / f"day_202403{k + 1:02d}.csv.zip", "w") as z:
            z.writestr("a.csv", "sym,qty,note\n" + "".join(f"S{i},{i * k},\n" for i in range(5)))
            z.writestr("second.csv", "sym\nnever read\n")
    (tmp_path / "day_20240309.csv.zip").write_bytes(b"no archive at all")
    (tmp_path / "readme.zip").write_bytes(b"no day in the name")
    return str(tmp_path / "*.zip")


def test_only_files_of_the_days_asked_for_are_opened(spark, zipped):
    march = [dt.date(2024, 3, d) for d in range(10)[1:]]
    read = lambda start, end: archives.archives(spark, zipped, ["qty", "sym", "absent"], start, end)
    assert read(None, None).columns == ["day", "qty", "sym", "absent"]
    for start, end, days in ((None, march[7], march[:8]), (march[3], march[3], [march[3]]), (march[2], march[4], march[2:5])):
        some = read(start, end)
        assert some.rdd.getNumPartitions() == len(days)
        assert sorted({(r.day, r.sym, r.qty, r.absent) for r in some.collect()}) == sorted((d, f"S{i}", str(i * (d.day - 1)), None) for d in days for i in range(5))
    # two filters over one frame hold for their own scans
    rows = read(march[0], march[7])
    both = rows.filter(F.col("day") == march[2]).unionByName(rows.filter((F.col("day") == march[5]) & (F.col("sym") == "S4")))
    assert both.count() == 6 and rows.count() == 40
    assert read(march[8], march[8]).rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="zip"):
        read(None, None).collect()
    assert read(dt.date(2031, 1, 1), None).count() == 0


def test_no_files_and_days_of_names(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        archives.archives(spark, str(tmp_path / "*.zip"), ["a"])
    assert archives.day_of("x/fo_2024-02-29.zip") == archives.day_of("20240229") == dt.date(2024, 2, 29)
    assert archives.day_of("fo_20240230.zip") is None and archives.day_of("2024/readme") is None


@pytest.fixture
def written(spark, tmp_path):
    rng = random.Random(1)
    rows = [(e, dt.date(y, m, 1 + k), f"{e}{k % 3}", dt.date(y, m, 28), float(k), rng.randrange(100)) for e in "NB" for y in range(2020, 2025) for m in range(1, 13) for k in range(6)]
    path = str(tmp_path / "panel")
    frame = spark.createDataFrame(rows, "exchange string, trade_date date, symbol string, expiry date, strike double, volume int")
    panel.write_panel(frame, path)
    return rows, spark.read.parquet(path)


def test_filters_reach_folders_and_row_groups(spark, written):
    rows, table = written
    start, end = dt.date(2022, 3, 2), dt.date(2022, 7, 4)
    some = table.filter(panel.traded(start, end) & (F.col("exchange") == "N") & (F.col("symbol") == "N1")).groupBy("symbol").agg(F.sum("volume").alias("v"))
    plan = plan_of(some)
    pruned, pushed = (plan.split(f"{what}: [")[1].split("]")[0] for what in ("PartitionFilters", "PushedFilters"))
    assert "exchange" in pruned and "year" in pruned and "2022" in pruned
    assert "GreaterThanOrEqual(trade_date,2022-03-02)" in pushed and "EqualTo(symbol,N1)" in pushed
    assert "ReadSchema: struct<trade_date:date,symbol:string,volume:int>" in plan
    assert some.first().v == sum(r[5] for r in rows if r[0] == "N" and r[2] == "N1" and start <= r[1] <= end)
    files_read = {f.split("/panel/")[1].rsplit("/", 1)[0] for f in table.filter((F.col("year") == 2022) & (F.col("exchange") == "N")).inputFiles()}
    assert files_read <= {f"exchange={e}/year={y}" for e in "NB" for y in range(2020, 2025)}


def test_days_of_a_calendar_prune_folders_at_run_time(spark, written, tmp_path):
    rows, table = written
    days = [(dt.date(y, m, 1 + k), y * 100 + m) for y in range(2020, 2025) for m in range(1, 13) for k in range(6)]
    spark.createDataFrame(days, "day date, ym int").write.parquet(str(tmp_path / "calendar"))
    chosen = spark.read.parquet(str(tmp_path / "calendar")).filter("ym = 202105")
    joined = panel.on_days(table, chosen).groupBy("exchange").agg(F.sum("volume").alias("v"))
    assert "dynamicpruning" in plan_of(joined).lower()
    assert {r.exchange: r.v for r in joined.collect()} == {e: sum(r[5] for r in rows if r[0] == e and (r[1].year, r[1].month) == (2021, 5)) for e in "NB"}


def test_a_manifest_tells_of_the_rows_as_they_were_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x\n1\n")
    table = spark.createDataFrame([(i, f"t{i}", [i, None], None if i % 3 else 0.5) for i in range(100)], "z long, b string, c array<int>, a double").repartition(5)
    path = str(tmp_path / "table")
    made = panel.write_observed(table, path, {"least": 5}, files.digests(spark, str(tmp_path / "in")), seed=7)
    side = json.loads((tmp_path / "table.manifest.json").read_text())
    assert made["rows"] == side["rows"] == 100 and side["seed"] == 7 and len(side["config"]) == 16 and set(side["inputs"]) == {"a.csv"}
    assert side["commit"] == panel.commit() and len(side["commit"]) == 40
    assert panel.intact(spark, path)
    again = panel.write_observed(table.orderBy("b").coalesce(1), str(tmp_path / "again"), {"least": 5})
    assert (again["xor"], again["sum"]) == (made["xor"], made["sum"])
    spark.createDataFrame([(1, "more", None, None)], table.schema).write.mode("append").parquet(path)
    assert not panel.intact(spark, path)
    empty = panel.write_observed(table.filter("false"), str(tmp_path / "empty"), {})
    assert empty["rows"] == 0 and panel.intact(spark, str(tmp_path / "empty"))


def test_ingest_takes_each_key_once_over_runs(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = lambda d, h=0: dt.datetime(2024, 5, d, h)

    def arrive(*rows):
        spark.createDataFrame(rows, "id long, at timestamp, v string").coalesce(1).write.mode("append").parquet(source)

    def run():
        schema = spark.read.parquet(source).schema
        return ingest.ingest(ingest.arriving(spark, source, schema, "at"), "id", "at", target, state)

    arrive((1, day(1), "a"), (2, day(2), "b"), (2, day(2), "b"))
    assert run() == 1 and run() == 0
    arrive((2, day(2), "again"), (3, day(9), "c"))  # known
    assert run() == 1
    arrive((4, day(8), "within three days of the newest"), (5, day(3), "settled"), (3, day(9), "again"))
    assert run() == 1
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4]
