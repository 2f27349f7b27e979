import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sessvar.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = [(d, [(line, line.strip(SPACE).translate(lower)) for line in (t or "").split("\n")]) for d, t in rows]
    owner = {}
    order = lambda d: (d is None, d or 0)
    for d, found in keyed:
        for _, k in found:
            if len(k) >= 10 and (k not in owner or order(d) < order(owner[k])):
                owner[k] = d
    out = []
    for d, found in keyed:
        kept = [line for line, k in found if len(k) < 10 or owner[k] == d]
        out.append((d, len(found), len(found) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    common = ["The same passage stands here.", "THE SAME passage stands here.  ", "short", "ééééééééé", "éééééééééé", "", "x" * 10, "x" * 9]
    out = [(i, "\n".join([*common[i % 3 :], f"own line number {i}", f"own line number {i}", " nbsp is no space"])) for i in range(40, 0, -1)]
    return [*out, (7, "The same passage stands here."), (7, "The same passage stands here."), (100, None), (101, ""), (None, "only nulls hold this line"), (None, "only nulls hold this line\nx"), (None, "own line number 3"), (5, "\n" * 3000 + "own line number 40")]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    data = rows()
    docs = spark.createDataFrame([(d, t, 0) for d, t in data], "doc_id long, text string, h int").repartition(3)
    out = lines.deduplicated(docs, batches=batches, fanout=fanout).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out], key=str) == plain(data)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a shared line\nb", "en", "s", 14), (2, "a shared line", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = lines.deduplicated(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a shared line\nb", "en", "s", 15, 2, 0), (2, "", None, None, 0, 1, 1)]
    assert lines.deduplicated(docs.filter("doc_id = 9")).count() == 0


def test_sql_says_the_same():
    data = [(d, t) for i, (d, t) in enumerate(rows()) if d is not None and d not in (5, 7)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    assert sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({lines.SQL})").fetchall(), key=str) == plain(data)


def test_rows_of_a_null_id_are_spread_and_carry_their_own_lines(spark):
    n = 4000
    shared = [f"a passage of number {i} that both tables hold" for i in range(500)]
    rows = [(i, shared[i]) for i in range(500)] + [(None, f"{shared[i % 500]}\nits own line {i}") for i in range(n)] + [(None, "the very same row again\n" + shared[0])] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    lost = lines.repeated_lines(docs).groupBy("doc_id", "row").count()
    assert lost.agg({"count": "max"}).first()[0] == 1 and lost.count() == n + 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lines.deduplicated(docs)
        sizes = [r["count"] for r in out.filter("doc_id is null").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n + 50 and max(sizes) < n / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted([(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()], key=str)
    assert got == plain(rows)
