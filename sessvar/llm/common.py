"""What the operators of this subpackage share: reading documents, shared scratch tables, Arrow helpers.

Rules that hold for every operator here unless its own docstring says otherwise:
a null text is an empty text, a null ``doc_id`` is an ordinary value that sorts last, columns other
than those named are ignored (so their names cannot clash), an empty table gives an empty result
with the same schema, and repeated rows are each processed. A text is handled whole however long it is: it is a slice of
its own, in memory in proportion to its length. Ties are broken by doc_id and then by the text's hash; rows that agree in both are
alike, and which of them is taken makes no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import dropped, only, saved, scratch

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
__all__ = ["DOCUMENT_COLUMNS", "WORD", "documents", "dropped", "encoded", "id_crc", "only", "saved", "scratch", "slices", "texts"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """``doc_id`` long, ``text`` with null as empty, and the other columns asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *others)


def id_crc(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id written as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


#: Rows handed to Python at a time, and the bytes of text after which a slice is worked on by itself.
SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of ``column``, so that a worker's memory does not follow the batch."""
    for batch in batches:
        start = size = 0
        text = batch.column(batch.schema.get_field_index(column))
        lengths = pc.binary_length(text).to_pylist()
        for i, n in enumerate(lengths):
            size += n or 0
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < len(lengths):
            yield batch.slice(start)


def encoded(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
