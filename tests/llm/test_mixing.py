import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sessvar.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_are_reshared():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    got = mixing.targets([10, 1000, 990], [1, 2, 3])
    assert got[0] == 30 and sum(got) == pytest.approx(2000)
    assert got[1] / got[2] == pytest.approx(2 / 3)
    assert mixing.targets([0, 5], [1, 2]) == [0, 5]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000])
def test_permuted_is_a_permutation(n):
    for key in (0, 7):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(got.tolist()) == list(range(n))


def rows(n=400):
    out = [(1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (2, None, "en", "x", 0), (2, None, "en", "x", 0), (3, "", None, None, 0), (None, "no id here", "en", None, 3), (4, "w " * 9000, "de", "hot", 1)]
    return out + [(10 + i, " ".join(f"w{i}_{j}" for j in range(i * 37 % 211)), "fr", ("hot", "b", "c", None)[min(i % 7, 3)], 1) for i in range(n)]


def test_taken(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, size long")
    mix = mixing.Mix(docs)
    got = mix.taken().collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d[0], len(WORDS.findall(d[1] or ""))) for d in data)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source_no] += r.taken
    sources = mix.sources.collect()
    assert [s.source for s in sorted(sources)] == ["b", "c", "hot", "x", None]
    for s in sources:
        assert abs(taken[s.source_no] - s.target) <= 2 * mixing.BLOCK_WORDS
    again = sorted(mixing.Mix(docs.repartition(7)).taken().collect(), key=str)
    assert sorted(got, key=str) == again
    slots = mix.slots.collect()
    assert len({(r.source_no, r.turn, r.block) for r in slots}) == len(slots) == sum(s.slots for s in sources)


def test_mixed_documents_hold_what_is_taken(spark):
    data = rows(120)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed_documents(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words, texts = Counter(), {}
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        texts.setdefault(r.doc_id, set()).update(r.text.split())
    taken = Counter()
    for r in mixing.Mix(docs).taken().collect():
        taken[r.doc_id] += r.taken
    assert +taken == +words
    original = {d[0]: set((d[1] or "").split()) for d in data}
    assert all(found <= original[d] for d, found in texts.items())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.Mix(docs).taken().count() == 0
    assert mixing.mixed_documents(docs).count() == 0
    nothing = spark.createDataFrame([(1, None, "en", "a", 0)], docs.schema)
    assert [tuple(r)[:2] + (r.taken,) for r in mixing.Mix(nothing).taken().collect()] == [(1, 0, 0)]


def test_rows_of_a_null_id_are_spread_and_runs_are_cut_from_a_text_that_is_split_once(spark):
    texts = [" ".join(f"d{i}w{k}" for k in range(30 + i)) for i in range(3_000)]
    docs = spark.createDataFrame([(None, t, "en", "s0" if i % 4 else "s1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    mix = mixing.Mix(docs)
    assert mix.slots.rdd.getNumPartitions() >= 1 + 3_000 * 1_000 // 64 // mixing.TASK_SLOTS // 10
    out = mixing.mixed_documents(docs).collect()
    whole = {t: i for i, t in enumerate(texts)}
    taken = {}
    for r in out:
        words = r["text"].split()
        i = int(words[0][1:].split("w")[0])
        assert r["doc_id"] is None and " ".join(words) in texts[i] and r["n_chars"] == len(r["text"])
        taken[i] = taken.get(i, 0) + len(words)
    assert all(n <= 3 * (30 + i) for i, n in taken.items()) and len(whole) == 3_000
    assert sum(taken.values()) == mix.taken().agg({"taken": "sum"}).first()[0]
