import hashlib
import zlib

import pytest

from sessvar.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, key int, i int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    doc_id, source, lang, n_chars = row[:4]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Digest of a tree and, of each node, the (left, right) pairs up to its top."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, a in enumerate(at):
            first = a - a % 3
            steps[j].append(("".join(nodes[first:a]), "".join(nodes[a + 1 : first + 3])))
            at[j] = a // 3
        nodes = [digest("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], steps


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inside = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is None, r[0] or 0, plain_leaf(r, r[4])))
        inside[name] = (own, *climb([plain_leaf(r, r[4]) for r in own]))
    root, above = climb([inside[n][1] for n in names])
    out = []
    for name, more in zip(names, above, strict=True):
        own, subroot, steps = inside[name]
        for row, mine in zip(own, steps, strict=True):
            path = mine + more
            spoilt = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            h = plain_leaf(row, row[4].replace("\n", "") if spoilt else row[4])
            for left, right in path:
                h = digest(left + h + right)
            out.append((row[0], plain_leaf(row, row[4]), subroot, root, digest("".join(a + b for a, b in path)), h))
    return out


def query_of(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", 7, 8) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return manifest.op12_merkle_manifest(spark, str(tmp_path))


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (40, 1, 3, 4, 9, 10, 0)])
def test_against_a_plain_tree(spark, tmp_path, sizes):
    rows, n = [], 0
    for s, size in enumerate(sizes):
        source = [None, "", "é", "b", "B", "a\nb", "z"][s]
        for _ in range(size):
            n += 1
            rows.append((n * 37 % 101, source, [None, "en"][n % 2], [None, n][n % 3 > 0], [None, "", "one\ntwo", "Ünï\n", "x" * 5000 + "\n"][n % 5]))
    rows += [(None, None, None, None, None), (None, None, None, None, "t\nu"), (3, None, "en", 1, "a\nb"), (3, None, "en", 1, "a\nb"), (3, None, "en", 1, "a\nc")] * (len(sizes) > 2)
    got = query_of(spark, rows, tmp_path).collect()
    want = plain(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert len({r.root for r in got}) == 1


def test_sources_beyond_one_level_and_a_hot_one(spark, tmp_path):
    rows = [(i, f"s{i % 30}" if i % 3 else "hot", "en", i, f"text {i}\n") for i in range(300)]
    got = query_of(spark, rows, tmp_path).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(plain(rows))
    assert {r.verified for r in got} == {True, False}


def test_a_changed_field_changes_the_leaf_and_moved_bytes_too(spark):
    docs = spark.createDataFrame([(1, "a", "b", 2, "c"), (1, "ab", None, 2, "c"), (1, "a", "b", 2, "c\n")], "doc_id long, source string, lang string, n_chars long, text string")
    assert len({r.h for r in manifest.leaves(docs).collect()}) == 3


def test_no_rows(spark, tmp_path):
    got = query_of(spark, [], tmp_path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and got.count() == 0
