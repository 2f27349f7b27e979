"""Mixing sources to target weights.

The words of each source, documents in order of a hash bucket and then doc_id, are packed into blocks of a fixed
length. Every output shard draws how many of its slots each source gets from a multinomial over the
targets. The slots of a source, numbered through all shards, run through a pseudorandom permutation
of its block indices, once per pass over the source, and are joined to the blocks by index.

Independent draws miss a source's exact number of slots by chance; the slots that a source drew
beyond its number are dealt, in order, to those that drew too few. So the mix takes every block of a
source equally often to within one, and a source at three times its size takes every block thrice.

Odd input is handled as :mod:`.common` states, but for what is said here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Production parameters: words in a block, slots in an output shard, passes over a source at most, seed.
BLOCK_WORDS = 64
SHARD_SLOTS = 65_536
MOST_PASSES = 3
SEED = 20_240_229
#: Documents in a hash bucket, within which positions are summed in one task; slots that a task lays out.
BUCKET_DOCUMENTS = 1_000
TASK_SLOTS = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST_PASSES) -> list[float]:
    """Shares of all sizes by weight; what a source would have beyond ``most`` times its size goes to the others by weight."""
    total, full = float(sum(sizes)), set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        target = [float(most * s) if i in full else rest * w / weight for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        over = {i for i, (s, t) in enumerate(zip(sizes, target, strict=True)) if i not in full and t > most * s}
        if not over:
            return target
        full |= over


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permuted(index: np.ndarray, sizes: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(size), row by row: a four-round Feistel network on the least even
    number of bits that holds the size, walked along its cycle until it is back in range."""
    bits = np.ceil(np.log2(np.maximum(sizes, 2).astype(np.float64)) / 2).astype(np.uint64)
    bits += ((np.uint64(1) << (np.uint64(2) * bits)) < sizes.astype(np.uint64)).astype(np.uint64)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    key = key.astype(np.uint64)
    with np.errstate(over="ignore"):
        while len(todo):
            b = bits[todo]
            mask = (np.uint64(1) << b) - np.uint64(1)
            left, right = out[todo] >> b, out[todo] & mask
            for r in range(4):
                left, right = right, left ^ (_mixed(right + key[todo] + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & mask)
            out[todo] = left << b | right
            todo = todo[out[todo] >= sizes[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _numbered(sized: DataFrame, n_docs: int) -> DataFrame:
    """Adds ``at``: the words of the source before the document, in order of bucket, doc_id, the rest.

    Sums within a bucket are windows over (source, bucket), the buckets' own bases windows over one
    row per (source, bucket); no task needs all rows of a source.
    """
    buckets = 1 + n_docs // BUCKET_DOCUMENTS
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    bases = sized.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")).select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.join(bases.hint("merge"), ["source_no", "bucket"]).withColumn("at", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")


class Mix:
    """A planned mix. ``sources``: a row per source with its size, target and slots; ``pieces``: the part of each
    document in each block; ``slots``: which block each slot of each output shard takes."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        spark = docs.sparkSession
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))
        sized = common.saved(sized, "mix-sizes")  # the texts are read once
        # One row per source, not per document, reaches the driver: weights and targets are a matter of the list of sources.
        found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()
        found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
        words = [r["words"] for r in found]
        goal = targets(words, [weights[i % len(weights)] for i in range(len(found))]) if found else []
        blocks = [-(-w // block_words) for w in words]
        slots = [min(MOST_PASSES * n, round(t * n / w)) if w else 0 for n, w, t in zip(blocks, words, goal, strict=True)]
        self.block_words = block_words
        rows = [(i, r["source"], w, t, n, q) for i, (r, w, t, n, q) in enumerate(zip(found, words, goal, blocks, slots, strict=True))]
        self.sources = spark.createDataFrame(rows, "source_no int, source string, source_size long, target double, blocks long, slots long")
        key = [F.col("s.source").eqNullSafe(F.col("d.source"))]
        known = sized.alias("d").join(F.broadcast(self.sources.select("source_no", "source")).alias("s"), key).select("d.doc_id", "d.size", "d.text_hash", "s.source_no")
        self.documents = _numbered(known, sum(r["docs"] for r in found))
        self.pieces = self._pieces()
        self.slots = self._slots(spark, slots, blocks, shard_slots, seed)

    def _pieces(self) -> DataFrame:
        """A row per document and block it reaches into; one row with a null block for a document without words."""
        n = F.lit(self.block_words)
        first, last = F.floor(F.col("at") / n), F.floor((F.col("at") + F.col("size") - 1) / n)
        held = self.documents.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        start = F.greatest(F.col("block") * n - F.col("at"), F.lit(0))
        end = F.least((F.col("block") + 1) * n - F.col("at"), F.col("size"))
        return held.withColumn("start", start).withColumn("n_words", F.coalesce(end - start, F.lit(0)))

    def _slots(self, spark: SparkSession, quota: list[int], blocks: list[int], shard_slots: int, seed: int) -> DataFrame:
        total, n = sum(quota), len(quota)
        shares = np.array(quota, float) / max(total, 1)

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for shard in pdf["id"]:
                    size = min(shard_slots, total - shard * shard_slots)
                    count = np.random.default_rng([seed, shard]).multinomial(size, shares)
                    yield pd.DataFrame({"shard": shard, "source_no": np.arange(n, dtype=np.int32), "count": count})

        schema = "shard long, source_no int, count long"
        shards = -(-total // shard_slots)
        drawn = common.saved(spark.range(shards).mapInPandas(draw, schema) if total else spark.createDataFrame([], schema), "mix-draws")
        # One row per source again: by how much the draws miss its number of slots.
        got = {r["source_no"]: r["n"] for r in drawn.groupBy("source_no").agg(F.sum("count").alias("n")).collect()}
        miss = np.array([got.get(i, 0) - q for i, q in enumerate(quota)], np.int64)
        surplus_from = np.concatenate([[0], np.cumsum(np.maximum(miss, 0))]).astype(np.int64)
        deficit_to = np.concatenate([[0], np.cumsum(np.maximum(-miss, 0))]).astype(np.int64)
        want, size_of = np.array(quota, np.int64), np.array(blocks, np.int64)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                source, at = pdf["source_no"].to_numpy().astype(np.int64), pdf["at"].to_numpy().astype(np.int64)
                over = at >= want[source]
                rank = surplus_from[source[over]] + at[over] - want[source[over]]
                to = np.searchsorted(deficit_to, rank, side="right") - 1
                source[over], at[over] = to, want[to] + miss[to] + rank - deficit_to[to]
                turn, index = np.divmod(at, size_of[source])
                key = _mixed((source * 1_000_003 + turn).astype(np.uint64) + np.uint64(seed))
                yield pd.DataFrame({"shard": pdf["shard"], "source_no": source.astype(np.int32), "turn": turn, "block": permuted(index, size_of[source], key)})

        before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        runs = drawn.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).filter("count > 0")
        # the windows leave a source's runs together: they are dealt out before each becomes very many rows
        dealt = runs.repartition(1 + total // TASK_SLOTS, "shard", "source_no")
        numbered = dealt.select("shard", "source_no", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("at"))
        return numbered.mapInPandas(place, "shard long, source_no int, turn long, block long")

    def taken(self) -> DataFrame:
        """doc_id, size, source_no and the words that the mix takes of each document row, repeats counted."""
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        joined = self.pieces.join(times.hint("merge"), ["source_no", "block"], "left")  # both sides grow with the input
        words = F.sum(F.col("n_words") * F.coalesce(F.col("times"), F.lit(0))).cast("long").alias("taken")
        # at and the rest tell rows of one doc_id apart; equal rows without words are counted one by one
        by = ["source_no", "at", "doc_id", "size", "text_hash"]
        found = joined.groupBy(*by).agg(words, F.count(F.when(F.col("size") == 0, 1)).alias("empty"))
        return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("empty", F.lit(1))))).select("doc_id", "size", "source_no", "taken")

    def spans(self) -> DataFrame:
        """shard, order_key, source_no, turn, block and the span of words (start, n_words) of the document that fills it."""
        held = self.pieces.filter("n_words > 0").join(self.slots.hint("merge"), ["source_no", "block"])
        return held.withColumn("order_key", F.xxhash64("shard", "source_no", "turn", "block"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as rows of documents: for each pass over a document, a row for each run of consecutive words taken.

    The other columns are the document's; n_chars follows the new text. A run that is the whole document
    keeps its text as it is, others are joined by single spaces. Documents that the mix takes nothing of have no row.
    """
    mix = Mix(docs, **parameters)
    # Rows of one doc_id with one text are told apart by a number; any order will do, since they are equal.
    same = Window.partitionBy("doc_id", "text_hash").orderBy("at")
    numbered = mix.documents.filter("size > 0").withColumn("copy", F.row_number().over(same)).select("source_no", "at", "copy")
    by = ["source_no", "at", "doc_id", "text_hash", "size", "turn"]
    order = Window.partitionBy(*by).orderBy("start")
    touches = F.coalesce(F.lag(F.col("start") + F.col("n_words")).over(order) == F.col("start"), F.lit(False))
    parts = mix.spans().withColumn("new", (~touches).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy(*by, "run").agg(F.min("start").alias("start"), F.sum("n_words").alias("n_words")).join(numbered.hint("merge"), ["source_no", "at"])
    runs = runs.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "copy", "size").agg(F.collect_list(F.struct("start", "n_words")).alias("runs")).hint("shuffle_hash")
    whole = docs.select(*common.DOCUMENT_COLUMNS).withColumn("h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    ranked = whole.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy(F.lit(0))))
    out = ranked.alias("t").join(runs.alias("r"), F.col("t.doc_id").eqNullSafe(F.col("r.d")) & (F.col("t.h") == F.col("r.h")) & (F.col("t.copy") == F.col("r.copy")))

    def cut(words: Column) -> Column:
        joined = lambda run: F.array_join(F.slice(words, (run["start"] + 1).cast("int"), run["n_words"].cast("int")), " ")
        return F.transform("r.runs", lambda run: F.when(run["n_words"] == F.col("r.size"), F.col("text")).otherwise(joined(run)))

    # an array of one, bound to a name: the text is split once, not for each run
    split = F.array(F.regexp_extract_all(F.col("text"), F.lit(f"({common.WORD})"), F.lit(1)))
    texts = F.element_at(F.transform(split, cut), 1)
    out = out.select("t.doc_id", F.explode(texts).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table mixed: what is taken of each document, beside its source's size and target."""
    mix = Mix(common.documents(spark, sf_dir))
    rows = mix.taken().join(F.broadcast(mix.sources.select("source_no", "source", "source_size", "target")), "source_no")
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken")
