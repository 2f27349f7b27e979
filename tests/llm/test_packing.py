import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessvar.llm import packing, tokens

PATH = public_tokenizers.path(packing.VOCABULARY)


@pytest.fixture(scope="module")
def full():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.sampled_from(["It's <|endoftext|> über", "ÉCOLE 12³½ ª", "á  x y", "don't!!!'s", "İΣ ς ΑΣ", "x\x00y \x85"]), max_size=6))
def test_word_by_word_is_the_tokenizer(texts):
    encoder = tokens.encoder(PATH)
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in encoder.full.encode_batch(texts, add_special_tokens=False)]


def test_small_memory_changes_nothing(full, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    encoder = tokens.WordEncoder(PATH)
    texts = [" ".join(random.Random(i).choices("the quick,Brown föx jumps over don't 42 lazy!! dogs é".split(), k=30)) for i in range(20)]
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_remembers_each_part_once_and_learns_none_that_recurs_again(monkeypatch):
    encoder = tokens.WordEncoder(PATH)
    encoder.encode([b"the quick brown fox"])
    held = lambda: sum(len(t) for name, t in vars(encoder).items() if isinstance(t, dict) and name != "letters")
    assert held() == 4
    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    encoder, learned, learn = tokens.WordEncoder(PATH), [], tokens.WordEncoder._learn_parts
    monkeypatch.setattr(tokens.WordEncoder, "_learn_parts", lambda self, parts: (learned.extend(parts), learn(self, parts))[1])
    for i in range(40):
        encoder.encode([f"The {'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}x".encode()])
    assert len(learned) == len(set(learned)) == 41
    assert held() <= 2 * (8 + 3)


def best_fit(lengths, capacity):
    """Piece by piece, the plain way: remaining rooms of the bins in the order they were opened."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=120), st.integers(20, 33))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    bins = {}
    for n in histogram:
        runs = [r for r in packing.plan(histogram, capacity) if r[0] == n]
        assert sorted((r[1], r[2]) for r in runs) == [(a, b) for a, b in zip(np.cumsum([0, *(r[2] for r in sorted(runs))]).tolist(), [r[2] for r in sorted(runs)], strict=False)]
        for _, first_rank, count, first, each, offset in runs:
            for i in range(count):
                bins.setdefault(first + i // each, []).append((offset + i % each * n, n))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in held) for held in bins.values()) == best_fit(lengths, capacity)


def test_whole_table(spark, full):
    long = " ".join(["word"] * 5000)
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "y"), (3, "", "z"), (None, "null id", "w"), (4, long, None)] + [(10 + i, "tok " * (i * 7 % 900), "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.packed_documents(docs).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = full.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(doc_id, i, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), 2048))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(held) == len(best_fit([r[3] for r in want], 2048))
    assert packing.packed_documents(docs.filter("doc_id = -1")).count() == 0
