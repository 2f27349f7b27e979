"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only a session on one machine may leave it unset, and gets a temporary folder for as long as it lives; on a cluster that
    is an error, for a folder of one machine is lost with the machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # not local-cluster, whose executors are processes of their own
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


#: Of each :func:`only` that is under way, the innermost last, the folders written so far.
_MADE: list[list[str]] = []


def saved(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, saved, after which the tables that it saved on the way are removed: for work that leaves large ones behind."""
    made: list[str] = []
    _MADE.append(made)
    try:
        found = make()
        _MADE.pop()
        return saved(found, name)
    finally:
        if _MADE and _MADE[-1] is made:
            _MADE.pop()
        for folder in made:
            _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that saved() made and that nothing needs any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
