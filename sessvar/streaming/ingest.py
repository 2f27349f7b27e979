"""Incremental ingest: each run takes what has arrived since the last one, keeps a key once, and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: how long after its day a row may still arrive; an absence is final only then.
SETTLED = "3 days"


def arriving(spark: SparkSession, path: str, schema: StructType, at: str, most_files: int | None = None) -> DataFrame:
    """Parquet files under ``path`` (a folder or a glob) as a stream, ``at`` as its time."""
    reader = spark.readStream.schema(schema)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def ingest(stream: DataFrame, key: str, at: str, target: str, checkpoint: str, settled: str = SETTLED) -> int:
    """Appends the stream's new rows to ``target``, a key once, and returns how many batches that took.

    A key that comes again within ``settled`` of its first row is dropped; so is a row that comes more than that behind the newest time of earlier
    batches: its day is settled. What was seen, and which files, lies in ``checkpoint``, a folder that driver and executors share, so a
    run that was broken off goes on where it stopped and nothing is written twice.
    """
    once = stream.withWatermark(at, settled).dropDuplicatesWithinWatermark([key])
    run = once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return len([p for p in run.recentProgress if p["numInputRows"]])
