"""Best-fit-decreasing packing of tokenized documents into sequences.

Lengths are whole numbers up to the capacity, so what best-fit decreasing does to all pieces follows
from how many there are of each length. The plan is made from that histogram: lengths descend, a
segment tree over the remaining capacities finds the tightest open bin that still fits, and runs of equal
pieces are placed at once. It has runs of bins, not bins, and so stays small whatever the corpus. Each piece is
then numbered among those of its length, and its run gives its sequence and offset.

Odd input is handled as :mod:`.common` states, but for what is said here.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Production parameters.
CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Pieces in a bucket, within which those of a length are numbered in one task.
BUCKET_PIECES = 10_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Tree:
    """A segment tree over remaining capacities; a leaf counts the open bins with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open bin has."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first bin, pieces in each bin, offset) runs of best-fit decreasing.

    Piece ``rank`` of a length lies in bin ``first bin + (rank - first rank) // each`` at
    ``offset + (rank - first rank) % each * length``.
    """
    tree, open_bins = _Tree(capacity), {r: deque() for r in range(capacity + 1)}
    runs, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins[room].append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].popleft()
                tree.add(room, -n)
            each = room // length  # a bin that took a piece is the tightest until it is full
            filled = min(n, left // each)
            if filled:
                runs.append((length, rank, filled * each, first, each, capacity - room))
                put(room - each * length, first, filled)
                rank, left, first, n = rank + filled * each, left - filled * each, first + filled, n - filled
            if n and left:
                runs.append((length, rank, left, first, each, capacity - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return runs


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut only where it is longer than ``capacity``.

    A null or empty text is a piece of the end id alone. ``ids`` (little-endian, 32 bits each) only if asked for.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    end = np.array([END_ID], "<u4").tobytes()
    schema = PIECES + (", ids binary" if keep_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in common.slices(batches):
            out = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encoder.encode(common.encoded(batch)), strict=True):
                ids = raw + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names[: len(columns)])

    return common.texts(docs).mapInArrow(work, schema)


def _ranked(cut: DataFrame, n: int) -> DataFrame:
    """Numbers the pieces of each length from 0. Buckets keep a frequent length from being one task's work."""
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(1 + n // BUCKET_PIECES)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bucketed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return bucketed.withColumn("inside", F.row_number().over(inside)).join(bases.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside") - 1).drop("bucket", "base", "inside")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` (and doc_id, piece, start, ids_crc32, which order equal ones).

    Only the histogram, at most ``capacity`` rows, reaches the driver. ``cut`` is read twice: save it first.
    """
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = np.array(plan(histogram, capacity), np.int64).reshape(-1, 6)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    first_of = np.searchsorted(runs[:, 0], np.arange(capacity + 2))
    schema = cut.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    names = cut.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            run = np.empty(len(pdf), np.int64)
            for n in np.unique(length):
                mine = length == n
                low, high = first_of[n], first_of[n + 1]
                run[mine] = low + np.searchsorted(runs[low:high, 1], rank[mine], side="right") - 1
            _, start, _, first, each, offset = runs[run].T
            pdf["sequence_id"] = first + (rank - start) // each
            pdf["offset"] = offset + (rank - start) % each * length
            yield pdf[[*names, "sequence_id", "offset"]]

    return _ranked(cut, sum(histogram.values())).mapInPandas(place, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenizes, cuts and packs: a row per piece. The texts are read and tokenized once."""
    return pack(common.saved(pieces(docs, vocabulary, capacity), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packed_documents(common.documents(spark, sf_dir))
