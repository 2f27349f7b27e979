"""The panel as a table of exchanges and years, and tables that say what they were made from."""

from __future__ import annotations

import datetime as dt
import json
import platform
import subprocess
from pathlib import Path

import pyspark
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import text_digest


def write_panel(panel: DataFrame, path: str) -> None:
    """A folder for each exchange and year. Rows of one are rebalanced over as many files as they fill and lie by symbol and day, so that
    footers tell which row groups a filter needs."""
    rows = panel.withColumn("year", F.year("trade_date")).hint("rebalance", "exchange", "year")
    rows.sortWithinPartitions("exchange", "year", "symbol", "trade_date", "expiry", "strike").write.mode("overwrite").partitionBy("exchange", "year").parquet(path)


def traded(start: dt.date, end: dt.date) -> Column:
    """Days from ``start`` to ``end``: on the folders' years too, which the days alone would not prune."""
    return F.col("year").between(start.year, end.year) & F.col("trade_date").between(F.lit(start), F.lit(end))


def on_days(panel: DataFrame, days: DataFrame) -> DataFrame:
    """The panel on some days (``day``), few beside it: their years prune its folders while the query runs."""
    wanted = days.select(F.col("day").alias("trade_date"), F.year("day").alias("year"))
    return panel.join(F.broadcast(wanted), ["year", "trade_date"])


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that the session can write to; replaced as a whole."""
    store, where = _hadoop(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def commit() -> str | None:
    """The commit of the code that runs, if it lies in a repository."""
    try:
        found = subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return found.stdout.strip() or None


def _metrics(columns: list[str]) -> list[Column]:
    """Rows, and two digests that do not depend on their order."""
    row = F.xxhash64(*columns)
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")]


def sidecar(path: str) -> str:
    return path.rstrip("/") + ".manifest.json"


def write_observed(table: DataFrame, path: str, settings: dict, inputs: DataFrame | None = None, seed: int | None = None) -> dict:
    """Writes ``table`` and, beside it, what it was made from: its rows and digest, taken while they are written and not by another pass, digests of its
    input files (:func:`files.digests`), the settings' digest, versions and the commit. Columns may be of any type that hashes, which maps do not."""
    spark, seen = table.sparkSession, Observation()
    table.observe(seen, *_metrics(table.columns)).write.mode("overwrite").parquet(path)
    made = {"name": Path(path).name, "columns": [list(c) for c in table.dtypes], "config": text_digest(settings), "seed": seed, "commit": commit(), "python": platform.python_version(), "spark": pyspark.__version__, **seen.get}
    made["inputs"] = {r["file"]: r["sha256"] for r in inputs.collect()} if inputs is not None else {}
    write_text(spark, sidecar(path), json.dumps(made, indent=2, sort_keys=True, default=str))
    return made


def intact(spark: SparkSession, path: str) -> bool:
    """Whether a table still has the rows that its side-car tells of."""
    made = json.loads(read_text(spark, sidecar(path)))
    now, columns = spark.read.parquet(path), [name for name, _ in made["columns"]]
    found = now.agg(*_metrics(columns)).first().asDict() if set(now.columns) == set(columns) else {}
    return {k: str(v) for k, v in found.items()} == {k: str(made[k]) for k in ("rows", "xor", "sum")}
