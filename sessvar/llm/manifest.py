"""Merkle manifest of a dataset: a digest of each row, one of each source, one of all, and for each row the proof that it belongs.

The tree is built from the bottom: every ``FANOUT`` consecutive nodes of a group become one, and each level is a persisted table
whose rows hold their children's digests. Proofs are pushed down from the top: a level's nodes, with the proof they inherited, join
their own row of the persisted level, and each child prepends its siblings to that proof.

Rows are numbered within their source by a range partition and sums over its parts, so no source is one task's work. A null doc_id
comes last in its source; rows of one doc_id follow in order of their leaf; each row is a leaf, repeated ones too. A null source
is a group of its own and comes first. An empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node; the fields of a leaf in order.
FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<left:string,right:string>>"


def _field(value: Column) -> Column:
    """A dash for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, with some of them replaced."""
    return _digest(*(_field(changed.get(c, F.col(c))) for c in FIELDS))


def tampered() -> Column:
    """Rows that the self-test changes: those whose doc_id, as text, has an even crc32. A null doc_id is left alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, ``key`` (the source, in an order with null first), ``h`` (the leaf) and ``bad``, the leaf without line ends where the self-test tampers."""
    bare = leaf(text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), leaf().alias("h"), F.when(tampered(), bare).alias("bad"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``i``, a row's place within its ``key`` from 0, and ``n``, the rows of the key.

    Rows go to ranges of (key, order); a range's rows are counted by key, and a key's earlier ranges are summed: a table of as many rows as
    there are ranges and keys. ``rows`` is read twice: save it first.
    """
    ranged = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed = common.saved(ranged.withColumn("place", F.monotonically_increasing_id()), "manifest-order")
    placed = placed.withColumns({"part": F.shiftright("place", 33), "at": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))}).drop("place")
    by_part = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    parts = parts.withColumns({"before": F.coalesce(F.sum("rows").over(by_part), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy("key"))})
    joined = placed.join(parts.drop("rows"), ["key", "part"])
    return joined.withColumn("i", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def levels(bottom: DataFrame, carry: Sequence[str]) -> list[DataFrame]:
    """The levels of each key's tree, the leaves (key, i, n, h and the columns of ``carry``) first; each is persisted in the shared folder.

    Higher levels have key, i, n, h and ``kids``: i, h and, of leaves, what they carry. A key's tree ends at the level where ``n`` is 1.
    """
    out = [common.saved(bottom.select("key", "i", "n", "h", *carry), "manifest-level")]
    most = out[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        kid = F.struct("i", "h", *(c for c in carry if len(out) == 1))
        grouped = out[-1].filter("n > 1").groupBy("key", F.expr(f"i div {FANOUT}").alias("p")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(kid)).alias("kids"))
        above = grouped.select("key", F.col("p").alias("i"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), _digest(F.array_join("kids.h", "")).alias("h"), "kids")
        out.append(common.saved(above, "manifest-level"))
        most = -(-most // FANOUT)
    return out


def tops(tree: list[DataFrame]) -> DataFrame:
    """key and ``h``, the digest of its whole tree."""
    found = tree[0].filter("n = 1").select("key", "h")
    for level in tree[1:]:
        found = found.unionByName(level.filter("n = 1").select("key", "h"))
    return found


def proofs(tree: list[DataFrame], roots: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Every leaf with ``steps``, what stands left and right of it and then of its ancestors up to the top.

    ``roots`` has a row for each key: its own steps beyond this tree, and further columns that leaves inherit.
    """
    inherited = [c for c in roots.columns if c != "key"]
    down = None
    for depth in reversed(range(len(tree))):
        own = [*carry] if depth == 0 else []
        found = tree[depth].filter("n = 1").select("key", "i", "h", *own).join(roots, "key")
        if down is not None:
            found = found.unionByName(down)
        if depth == 0:
            return found
        joined = found.drop("h").join(tree[depth].select("key", "i", "kids"), ["key", "i"])
        child = joined.select("key", *inherited, "kids", F.posexplode("kids").alias("at", "kid"))
        left = F.array_join(F.slice(F.col("kids.h"), F.lit(1), F.col("at")), "")
        right = F.array_join(F.slice(F.col("kids.h"), F.col("at") + 2, F.lit(FANOUT)), "")
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        extra = [F.col(f"kid.{c}").alias(c) for c in carry] if depth == 1 else []
        down = child.select("key", "kid.i", "kid.h", *extra, F.concat(step, "steps").alias("steps"), *(c for c in inherited if c != "steps"))
    raise ValueError("a tree has a level of leaves")


def folded(start: Column, steps: str = "steps") -> Column:
    """The root that a leaf's digest leads to by its proof."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, bad (see :func:`leaves`), steps, subroot and root of every row."""
    carry = ("doc_id", "bad")
    found = common.saved(leaves(docs).withColumn("tie", F.monotonically_increasing_id()), "manifest-leaves")
    of_rows = levels(numbered(found, F.asc_nulls_last("doc_id"), F.col("h"), F.col("tie")), carry)
    common.dropped(found)
    subroots = common.saved(tops(of_rows).select(F.lit("").alias("key"), F.col("key").alias("name"), "h"), "manifest-subroots")
    of_sources = levels(numbered(subroots, F.col("name")), ("name",))
    root = tops(of_sources).select("key", F.array().cast(_STEPS).alias("steps"), F.col("h").alias("root"))
    by_source = proofs(of_sources, root, ("name",)).select(F.col("name").alias("key"), "steps", F.col("h").alias("subroot"), "root")
    return proofs(of_rows, by_source, carry).select("doc_id", F.col("h").alias("leaf"), "bad", "steps", "subroot", "root")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the proof holds for the document as it is, every other one having lost its line ends."""
    found = manifest(common.documents(spark, sf_dir))
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded(F.coalesce("bad", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same in SQL: levels by a recursive table, proofs by division of the leaf's place, folds by another recursive table.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('s' || source, 'n') AS key,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1)))),
           lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)) & 1 = 1 AS bad
  FROM documents
), l0 AS (
  SELECT doc_id, key, bad, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
         sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS bare FROM d
), l AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, h) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM l0
), lv AS (
  SELECT key, 0 AS k, i, n, h FROM l
  UNION ALL
  SELECT key, k + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY key, k, i // 3
), s AS (
  SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1
), sv AS (
  SELECT 0 AS k, i, n, h FROM s
  UNION ALL
  SELECT k + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM sv WHERE n > 1 GROUP BY k, i // 3
), rung AS (
  SELECT l.doc_id, l.key, l.i AS place, 0 AS tree, v.k, string_agg(v.h, '' ORDER BY v.i) FILTER (WHERE v.i < l.i // CAST(pow(3, v.k) AS BIGINT)) AS lo, string_agg(v.h, '' ORDER BY v.i) FILTER (WHERE v.i > l.i // CAST(pow(3, v.k) AS BIGINT)) AS hi
  FROM l JOIN lv v ON v.key = l.key AND v.n > 1 AND v.i // 3 = l.i // CAST(pow(3, v.k + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, l.key, l.i, 1, v.k, string_agg(v.h, '' ORDER BY v.i) FILTER (WHERE v.i < s.i // CAST(pow(3, v.k) AS BIGINT)), string_agg(v.h, '' ORDER BY v.i) FILTER (WHERE v.i > s.i // CAST(pow(3, v.k) AS BIGINT))
  FROM l JOIN s ON s.key = l.key JOIN sv v ON v.n > 1 AND v.i // 3 = s.i // CAST(pow(3, v.k + 1) AS BIGINT) GROUP BY l.doc_id, l.key, l.i, s.i, v.k
), steps AS (
  SELECT key, place, coalesce(lo, '') AS lo, coalesce(hi, '') AS hi, row_number() OVER (PARTITION BY key, place ORDER BY tree, k) AS no FROM rung
), up AS (
  SELECT key, i AS place, CAST(0 AS BIGINT) AS no, CASE WHEN bad THEN bare ELSE h END AS h FROM l
  UNION ALL
  SELECT up.key, up.place, steps.no, sha256(steps.lo || up.h || steps.hi) FROM up JOIN steps ON steps.key = up.key AND steps.place = up.place AND steps.no = up.no + 1
)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM l JOIN s ON s.key = l.key CROSS JOIN (SELECT h FROM sv WHERE n = 1) r
LEFT JOIN (SELECT key, place, string_agg(lo || hi, '' ORDER BY no) AS proof FROM steps GROUP BY key, place) p ON p.key = l.key AND p.place = l.i
JOIN (SELECT key, place, max_by(h, no) AS h FROM up GROUP BY key, place) f ON f.key = l.key AND f.place = l.i
"""
