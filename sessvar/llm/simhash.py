"""SimHash near-dedup by covering locality-sensitive hashing.

Each of the 64 bits has a vector over GF(2) of radius + 1 places; each nonzero vector v gives a mask of the
bits whose vector is not orthogonal to it. The vectors of up to ``radius`` differing bits never span the
space, so some v is orthogonal to all of them and its mask leaves them out: every pair within the
radius agrees under one of the 2 ** (radius + 1) - 1 masks, with no chance of a miss.

Equal fingerprints are one node. Within a bucket a spanning forest of the links is made, never all
pairs. A bucket too large for that is linked through middle points: two fingerprints are within 2m bits
just when some value is within m bits of both, so links to such values connect the same nodes, in linear size.

Odd input is handled as :mod:`.common` states, but for what is said here.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, graph

#: Production parameters: words in a shingle, differing bits at most, distinct fingerprints of a bucket that one task links.
SHINGLE = 4
RADIUS = 4
BUCKET = 8192
#: Fixed values of the fingerprint: the hash's seed and width.
SEED, BITS = 42, 64


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """Bit by bit whether over half of the shingles' hashes have it; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = (ends - [len(w) + 1 for w in found])[: max(1, len(found) - words + 1)].tolist()
    stops = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), "<u8", len(starts))
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 16_384):
        bits = np.unpackbits(hashes[i : i + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks. Bit i's vector is i modulo the nonzero vectors, plus one, so all occur about equally often."""
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(BITS)]
    return [sum(((vectors[i] & v).bit_count() & 1) << i for i in range(BITS)) for v in range(1, 1 << radius + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_hash) of every row; fp holds the 64 bits as a long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            prints = np.array([fingerprint(t, words) for t in common.encoded(batch)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(prints), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    hashed = common.texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return hashed.mapInArrow(work, "doc_id long, fp long, text_hash long")


def _forest(values: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links between distinct values: each value, once reached, looks for those not yet reached."""
    a, b, rest = [], [], values
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                a += [int(at)] * len(found)
                b += found.tolist()
                queue += list(found)
    return a, b


def _bucket_links(keyed: DataFrame, radius: int, most: int) -> DataFrame:
    """(a, b, t) links within the buckets of each partition, sorted by bucket; b is null for a member of a bucket over ``most``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("t", pa.int32())])
        held: list[np.ndarray] = []  # the last bucket's rows so far: (table, key, fingerprint)
        size, over = 0, False
        a: list[int] = []
        b: list[int | None] = []
        t: list[int] = []

        def close() -> None:
            nonlocal size, over
            if size > 1:
                rows = np.concatenate(held, axis=1)
                values = np.unique(rows[2])
                if over or len(values) > most:
                    a.extend(values.tolist())
                    b.extend([None] * len(values))
                    t.extend([int(rows[0, 0])] * len(values))
                else:
                    x, y = _forest(values.view(np.uint64), radius)
                    a.extend(_signed(v) for v in x)
                    b.extend(_signed(v) for v in y)
                    t.extend([int(rows[0, 0])] * len(x))
            held.clear()
            size, over = 0, False

        for batch in batches:
            rows = np.array([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            change = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            bounds = [0, *change.tolist(), rows.shape[1]]
            for low, high in itertools.pairwise(bounds):
                if size and (held[0][0, 0] != rows[0, low] or held[0][1, 0] != rows[1, low]):
                    close()
                held.append(rows[:, low:high])
                size += high - low
                if size > most:  # pass its rows on as they come
                    over = True
                    part = np.concatenate(held, axis=1)
                    a.extend(part[2].tolist())
                    b.extend([None] * part.shape[1])
                    t.extend(part[0].tolist())
                    held[:] = [part[:, -1:]]
                    size = 1
            if len(a) > 50_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t, pa.int32())], schema=schema)
                a, b, t = [], [], []
        close()
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t, pa.int32())], schema=schema)

    return keyed.mapInArrow(work, "a long, b long, t int")


def _middle_links(hot: DataFrame, radius: int, covering: list[int]) -> DataFrame:
    """Links of the members of oversized buckets through values within half the radius, of the bits that the bucket's mask leaves out."""
    steps = []
    for t, mask in enumerate(covering):
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        steps += [(t, _signed(sum(c))) for n in range(radius // 2 + 1) for c in itertools.combinations(free, n)]
    spark = hot.sparkSession
    # one row per mask and step: radius and width bound it
    moves = spark.createDataFrame(steps, "t int, step long")
    met = hot.join(F.broadcast(moves), "t").select(F.col("a"), F.col("a").bitwiseXOR(F.col("step")).alias("middle"))
    least = met.groupBy("middle").agg(F.min("a").alias("b"), F.max("a").alias("top")).filter("b < top").select(F.col("middle").alias("m"), "b")
    return met.join(least, F.col("middle") == F.col("m")).select("a", "b").filter("a <> b").distinct()


def links(prints: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that connect just those which links of at most ``radius`` bits connect.

    ``prints`` has distinct ``fp``.
    """
    if radius % 2:
        raise ValueError("middle points need an even radius")
    covering = masks(radius)
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(covering))))
    keyed = prints.select("fp", keys.alias("k")).select("k.t", "k.key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    found = common.saved(_bucket_links(keyed, radius, most), "simhash-links")
    edges = found.filter("b is not null").select("a", "b")
    hot = found.filter("b is null").select("a", "t").distinct()
    if hot.limit(1).count():
        edges = edges.union(_middle_links(hot, radius, covering))
    return edges.distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """doc_id, fp, text_hash, component_id, the least doc_id reachable over links of at most ``radius`` differing bits, and root.

    Documents without words have fingerprint zero and link like any other. A component of null ids alone has a null id; rows of one
    doc_id may lie in different components, which then share an id. ``root``, a fingerprint, is each component's own.
    """
    prints = common.saved(fingerprints(docs, words), "fingerprints")
    distinct = common.saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-ids")
    roots = graph.components(links(distinct, radius, most))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(of_root, "root").select(F.col("fp").alias("p"), "component_id", "root")
    return prints.join(of_print.hint("merge"), F.col("fp") == F.col("p")).select("doc_id", "fp", "text_hash", "component_id", "root")


def representatives(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents with one row of each near-duplicate group left, that of the least doc_id; the columns of documents."""
    found = near_duplicates(docs, words, radius)
    chosen = found.groupBy("root").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("o"), "doc_id", "text_hash")).alias("r"))
    chosen = chosen.select(F.col("r.doc_id").alias("d"), F.col("r.text_hash").alias("h")).hint("shuffle_hash")
    hashed = docs.select(*common.DOCUMENT_COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = hashed.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    # equal rows of one doc_id: one stays
    first: Column = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0)))
    return kept.withColumn("n", first).filter("n = 1").select(*common.DOCUMENT_COLUMNS)


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
