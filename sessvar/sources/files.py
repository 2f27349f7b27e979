"""Raw archives: zipped CSVs, index files with byte-order marks, JSON calendars, digests, and yearly parquet."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import io
import json
import platform
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the panel by type; anything else stays text.
DOUBLES = ("strike", "open", "high", "low", "close", "prev_close", "spot", "settle", "turnover")
WHOLE = ("open_int", "chg_oi", "volume", "n_trades", "lot_size")
DATES = ("trade_date", "expiry")


def tidy(raw: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Text columns to panel types: bad numbers are null, whole numbers go through double, other option types are null."""
    out = raw.filter(F.col("symbol").isin(symbols)) if symbols else raw
    for c in out.columns:
        if c in DOUBLES:
            out = out.withColumn(c, F.expr(f"try_cast(`{c}` AS DOUBLE)"))
        elif c in WHOLE:
            out = out.withColumn(c, F.expr(f"cast(try_cast(`{c}` AS DOUBLE) AS BIGINT)"))
        elif c in DATES:
            out = out.withColumn(c, F.to_date(F.substring(c, 1, 10)))
        elif c == "opt_type":
            out = out.withColumn(c, F.when(F.col(c).isin("CE", "PE"), F.col(c)))
    if {"trade_date", "expiry"} <= set(out.columns):
        out = out.withColumn("dte_cal", F.datediff("expiry", "trade_date"))
    return out


def zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The first member of each zip file under ``path`` as CSV, every column text; a missing path raises.

    One file is one task's work; an exchange's daily file is small.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as member:
                    table = pd.read_csv(member, dtype=str, keep_default_na=False, skipinitialspace=True)
                found = table.reindex(columns=columns).astype(object)
                yield found.where(found.notna(), None)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, schema)


def index_csv(spark: SparkSession, path: str, levels: tuple[str, ...] = ()) -> DataFrame:
    """Index closes: names and values trimmed, a byte-order mark before the header dropped, ``levels`` to numbers (null where they are none)."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    clean = raw.select(*(F.trim(F.col(f"`{c}`")).alias(c.replace("\ufeff", "").strip()) for c in raw.columns))
    return clean.select(*(F.col(f"`{c}`").try_cast("double").alias(c) if c in levels else F.col(f"`{c}`") for c in clean.columns))


def panels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Panels of several exchanges as one: by name, with null for columns that one lacks; filters and columns reach each scan."""
    found = [spark.read.parquet(p) for p in paths]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def write_json(value: dict, path: str) -> None:
    """A small result (timeline, manifest) as a file; keys sorted."""
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, default=str), encoding="utf-8")


def manifest(table: str, settings: dict, inputs: DataFrame, conf: dict[str, str], seed: int | None = None) -> dict:
    """What a result came from: its settings' digest, versions, session settings, and the digests of its input files (:func:`digests`, one row a file)."""
    files = {r["file"]: r["sha256"] for r in inputs.collect()}
    return {"name": table, "config": text_digest(settings), "seed": seed, "python": platform.python_version(), "spark": pyspark.__version__, "conf": conf, "inputs": files}


#: Fixed value: the first day that the exchange's files have in the format read here.
FIRST_DAY = dt.date(2024, 1, 1)


def checked_start(start: dt.date) -> dt.date:
    """The first day of a sample; earlier ones raise, for their files have another format."""
    if start < FIRST_DAY:
        raise ValueError(f"a sample from {start} on needs files of an older format; the first day that can be read is {FIRST_DAY}")
    return start


def calendar_days(path: str) -> list[str]:
    """The trading days of a calendar file, sorted."""
    return sorted(json.loads(Path(path).read_text())["trading_days"])


def calendar(spark: SparkSession, path: str) -> DataFrame:
    days = calendar_days(path)
    return spark.createDataFrame(list(enumerate(days)), "session long, day string").select(F.to_date("day").alias("day"), "session")


def write_years(panel: DataFrame, path: str) -> None:
    """One folder per year, rows sorted within its files, futures (no option type) first."""
    by_year = panel.withColumn("year", F.year("trade_date")).repartition("year", "trade_date")
    by_year.sortWithinPartitions("year", "trade_date", "symbol", "expiry", F.asc_nulls_first("opt_type"), "strike").write.mode("overwrite").partitionBy("year").parquet(path)


def write_table(table: DataFrame, path: str) -> None:
    """A result table in one file, replaced as a whole. For results of bounded size."""
    table.coalesce(1).write.mode("overwrite").parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes and sha256 of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def audit(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against a manifest: changed, missing, or not listed."""
    joined = found.alias("f").join(manifest.alias("m"), "file", "full")
    state = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("m.sha256").isNull(), "unlisted").when(F.col("f.sha256") == F.col("m.sha256"), "ok").otherwise("changed")
    return joined.select("file", state.alias("state"))


def is_real(payload: bytes, zipped: bool) -> bool:
    """Whether a download is the archive it should be and not an error page."""
    if zipped:
        return payload[:2] == b"PK"
    head = payload[:512].lstrip(b"\xef\xbb\xbf").lstrip().lower()
    return bool(head) and not head.startswith((b"<!doctype", b"<html")) and b"," in head


def text_digest(value: dict, without: tuple[str, ...] = ()) -> str:
    """Sixteen hex digits of a settings dictionary, keys sorted, locations left out."""
    kept = {k: v for k, v in value.items() if k not in without}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:16]
