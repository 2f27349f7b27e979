"""Near-duplicate groups of two operators together: what SimHash links, and what it cannot reach but the exact similarity join does.

At a similarity of 0.8 two documents' fingerprints differ in about ten of 64 bits, and masks that cover such a radius number thousands, so the few
bits that are covered link about half of such pairs. The join on shingles links them all; groups are those that both kinds of links make.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph, jaccard, simhash

#: Production parameters: words in a shingle of the join, and its similarity as NUM / DEN.
SHINGLE, NUM, DEN = 5, 80, 100

_KEY = ("doc_id", "text_hash")


def _classes(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash and ``id``, the set's class (-1 without words), of every distinct (doc_id, text), and the links between classes."""
    rows, classes, found = jaccard.linked_classes(docs, words, num, den)
    own = rows.select(*_KEY, "digest").distinct().join(classes.select(F.col("digest").alias("c"), "id").hint("merge"), F.col("digest") == F.col("c"), "left")
    return own.select(*_KEY, F.coalesce("id", F.lit(-1)).alias("id")), found


def groups(docs: DataFrame, words: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, text_hash and ``near``, the group, of every distinct (doc_id, text). Texts without words are a group, with whatever SimHash links to them.

    One graph has all links: between classes of equal sets, and of SimHash between the least classes of two fingerprints, a fingerprint's classes being linked to its least.
    """
    prints = common.saved(simhash.fingerprints(docs).distinct(), "near-prints")
    close = simhash.links(prints.select("fp").distinct())
    own, similar = _classes(docs, words, num, den)
    named = own.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "id")
    both = common.saved(prints.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select(*_KEY, "fp", "id"), "near-both")
    met = both.select("fp", "id").distinct()
    least = common.saved(met.groupBy("fp").agg(F.min("id").alias("least")), "near-least")
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_id"))
    edges = met.join(least, "fp").select(F.col("id").alias("a"), F.col("least").alias("b"))
    edges = edges.union(close.join(of("a"), "a").join(of("b"), "b").select("a_id", "b_id"))
    roots = graph.components(edges.union(similar))
    return both.join(roots, F.col("id") == F.col("node"), "left").select(*_KEY, F.coalesce("root", "id").alias("near"))


def representatives(docs: DataFrame, words: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """The documents with one row of each group left, that of the least doc_id (null is largest); the columns of documents."""
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("o"), "doc_id", "text_hash")
    least = lambda: groups(docs, words, num, den).groupBy("near").agg(F.min(order).alias("r")).select(F.col("r.doc_id").alias("d"), F.col("r.text_hash").alias("h"))
    chosen = common.only(docs.sparkSession, least, "near-chosen").hint("shuffle_hash")
    hashed = docs.select(*common.DOCUMENT_COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = hashed.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    # equal rows of one doc_id: one stays
    first = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.lit(0)))
    return kept.withColumn("first", first).filter("first = 1").select(*common.DOCUMENT_COLUMNS)
