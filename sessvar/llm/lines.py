"""Line dedup against levelled sorted runs of line hashes.

The hashes that earlier documents hold lie in runs: tables bucketed and sorted by hash, in levels.
A batch of later documents is merge-anti-joined with the runs; what is left of it, with the smallest
document that holds each hash, is the batch's own run and joins the first level. When a level has
FANOUT runs they are merged into one of the next. A line stays just where its document is the one in the batch's new run.

Odd input is handled as :mod:`.common` states, but for what is said here.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Production parameters: shortest key in code points, batches a table is taken in, runs of a level before they are merged.
LEAST = 10
BATCHES = 4
FANOUT = 2

#: The white space that keys are stripped of.
SPACE = b" \t\n\x0b\x0c\r"


def key(line: bytes, least: int = LEAST) -> bytes | None:
    """The 128-bit hash of a line's key, None if the key is shorter than ``least`` code points."""
    plain = line.strip(SPACE).lower()  # of bytes: A-Z alone
    if len(plain) < least or len(plain) < 4 * least and len(plain.decode()) < least:
        return None
    return hashlib.md5(plain, usedforsecurity=False).digest()


def _row() -> Column:
    """What tells rows of one doc_id apart: rows that agree in it and in their doc_id have the same lines, but for a chance of 2 ** -64."""
    return F.xxhash64("text").alias("row")


def line_hashes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, row, h): the distinct hashes of the lines of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids, rows, hashes = [], [], []
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), common.encoded(batch), strict=True):
                found = {h for line in text.split(b"\n") if (h := key(line, least))}
                ids += [doc_id] * len(found)
                rows += [row] * len(found)
                hashes += found
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(hashes, pa.binary())], names=["doc_id", "row", "h"])

    return common.texts(docs).withColumn("row", _row()).mapInArrow(work, "doc_id long, row long, h binary")


class Runs:
    """Runs of (h, doc_id), one row per hash over all of them, kept as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = df.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").format("parquet")
        writer.option("path", f"{common.scratch(self.spark)}/{name}").saveAsTable(name)
        return name

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of (doc_id, h) whose documents come after all earlier ones; returns its run."""
        first = batch.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
        for table in self.tables():
            first = first.join(self.spark.table(table).select("h").hint("merge"), "h", "left_anti")
        name = self._write(first)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return self.spark.table(name)

    def compact(self) -> None:
        """Merges full levels. A run that add() returned may be gone afterwards: use it before."""
        at = 0
        while at < len(self.levels):
            full = self.levels[at]
            if len(full) >= self.fanout:
                merged = self._write(functools.reduce(DataFrame.unionByName, map(self.spark.table, full)))
                self.levels[at] = []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(merged)
                self._drop(full)
            at += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            files = self.spark.table(name)
            self.spark.sql(f"DROP TABLE {name}")
            common.dropped(files)

    def close(self) -> None:
        self._drop(self.tables())
        self.levels = []


def repeated_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, row, h) of the lines to drop: hashes of a document that a smaller doc_id holds too. A null doc_id counts as the largest."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)])).first()[0] or []
    # the batch of a document is how many cuts are below it
    number = sum((F.when(F.col("doc_id").isNull() | (F.col("doc_id") > c), 1).otherwise(0) for c in cuts), F.lit(0))
    hashes = common.saved(line_hashes(docs, least).withColumn("batch", number), "lines", partition_by=("batch",))
    runs, found = Runs(spark, fanout), []
    for i in range(len(cuts) + 1):
        batch = hashes.filter(F.col("batch") == i).select("doc_id", "row", "h")
        own = runs.add(batch).select(F.col("h").alias("own_h"), F.col("doc_id").alias("own_id")).hint("merge")
        # joined on both columns, so that a line which very many documents hold is spread over tasks
        lost = batch.join(own, (F.col("h") == F.col("own_h")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left_anti")
        found.append(common.saved(lost.distinct(), "lines-lost"))
        if i < len(cuts):
            runs.compact()
    runs.close()
    common.dropped(hashes)
    return functools.reduce(DataFrame.unionByName, found)


def deduplicated(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The documents with repeated lines gone, and n_lines (before) and n_dropped.

    Of doc_id, text, lang, source and n_chars those that ``docs`` has are kept; n_chars follows the text.
    A null or empty text is one empty line. Rows of one doc_id count as one document.
    """
    kept = [c for c in common.DOCUMENT_COLUMNS if c in docs.columns]
    # a row's own lines alone, and by row, so that neither a null doc_id nor a frequent one is a group
    lost = repeated_lines(docs, least, batches, fanout).groupBy(F.col("doc_id").alias("lost_id"), F.col("row").alias("lost_row")).agg(F.collect_list("h").alias("lost")).hint("shuffle_hash")
    whole = common.texts(docs, *(c for c in kept if c not in ("doc_id", "text"))).withColumn("row", _row())
    joined = whole.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("row") == F.col("lost_row")), "left").drop("lost_id", "lost_row", "row")
    places = {c: joined.columns.index(c) for c in joined.columns}
    schema = joined.drop("lost").schema.add("n_lines", "long").add("n_dropped", "long")

    def work(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches_):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(common.encoded(batch), batch.column(places["lost"]).to_pylist(), strict=True):
                n_lines.append(text.count(b"\n") + 1)
                if drop:
                    gone = set(drop)
                    rows = [line for line in text.split(b"\n") if key(line, least) not in gone]
                    n_dropped.append(n_lines[-1] - len(rows))
                    text = b"\n".join(rows)
                else:
                    n_dropped.append(0)
                texts.append(text)
            columns = {c: batch.column(i) for c, i in places.items() if c != "lost"}
            columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t.decode()) for t in texts], pa.int64()).cast(columns["n_chars"].type)
            yield pa.record_batch([*columns.values(), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return joined.mapInArrow(work, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: lines before, lines dropped, and a digest of what is kept."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: The same in SQL. Keys are compared as they are.
SQL = r"""
WITH lines AS (
  SELECT doc_id, t.i AS i, t.line AS line,
         translate(trim(t.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_zip(range(1, len(parts) + 1), parts)) AS z, z[1] AS i, z[2] AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)) t
), owners AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.owner < l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE o.owner IS NULL OR o.owner = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN owners o ON length(l.k) >= 10 AND o.k = l.k
GROUP BY l.doc_id
"""
