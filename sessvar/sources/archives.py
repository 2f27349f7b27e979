"""Zipped daily files as a data source: a partition for each file, and files outside the days asked for are never opened."""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.csv as pc_csv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "daily_archive"
#: A file's day is the date in its name, with or without dashes.
_DAY = re.compile(r"(\d{4})-?(\d{2})-?(\d{2})(?!\d)")

def day_of(name: str) -> dt.date | None:
    """The day in a file's name, None if there is none."""
    found = _DAY.search(name.rsplit("/", 1)[-1])
    try:
        return dt.date(*map(int, found.groups())) if found else None
    except ValueError:
        return None


class _File(InputPartition):
    def __init__(self, path: str, day: dt.date):
        self.path, self.day = path, day


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.columns = json.loads(options["columns"])
        self.files = [(path, day) for path in json.loads(options["files"]) if (day := day_of(path))]

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(path, day) for path, day in self.files]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files at all
            return
        store, path = pafs.FileSystem.from_uri(partition.path)
        with store.open_input_file(path) as raw:
            content = raw.read()
        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as member:
            options = pc_csv.ConvertOptions(include_columns=self.columns, include_missing_columns=True, column_types=dict.fromkeys(self.columns, pa.string()), strings_can_be_null=False)
            for batch in pc_csv.open_csv(member, convert_options=options):
                columns = [c.cast(pa.string()) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array([partition.day] * len(batch), pa.date32()), *columns], names=["day", *self.columns])


class Archives(DataSource):
    """Options: ``files``, a JSON list of them, and ``columns``, a JSON list of those to parse, every one text."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "day date, " + ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def write_archives(rows: DataFrame, folder: str, day: str) -> DataFrame:
    """A zipped CSV of each day's rows (day, then the other columns as text) in ``folder``, any store that pyarrow opens by its address: file and rows of each.

    For tables of an exchange's size a day: a day's rows are one task's. A run that is repeated writes the same files again.
    """
    columns = [c for c in rows.columns if c != day]

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"day_{key[0]:%Y%m%d}.csv.zip"
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(name[:-4]), group[columns].sort_values(columns).to_csv(index=False))
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(held.getvalue())
        return pd.DataFrame({"file": [name], "n": [len(group)]})

    text = rows.select(F.col(day).cast("date").alias(day), *(F.col(c).cast("string").alias(c) for c in columns))
    return text.groupBy(day).applyInPandas(work, "file string, n long")


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Files of any store that the session reads, by glob: a name a day, listed by the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(str(f.getPath()) for f in found) if found else []


def archives(spark: SparkSession, pattern: str, columns: Sequence[str], start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """``day`` and the columns asked for of every file that the glob finds with a day from ``start`` to ``end``; nothing found by the glob raises.

    The days choose the files here and not by a pushed filter: this engine keeps one reader for all scans of a frame, so that a filter pushed for
    one query would hold for the next. A file is a task's work, as an exchange's day is small; its first member is read, and a column that it
    lacks is null. Files without a day in their name are left out.
    """
    files = listed(spark, pattern)
    if not files:
        raise FileNotFoundError(pattern)
    wanted = [f for f in files if (day := day_of(f)) and (start is None or day >= start) and (end is None or day <= end)]
    spark.dataSource.register(Archives)
    return spark.read.format(NAME).option("files", json.dumps(wanted)).option("columns", json.dumps(list(columns))).load()
