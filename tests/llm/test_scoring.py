"""Language-model scores against a plain count, on small documents."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sessvar.llm import scoring

SCHEMA = "doc_id long, text string, n_bytes string, word string"


def rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(400):
        at, text = int(rng.integers(60)), []
        for _ in range(40):  # a chain: the next word mostly follows from this one
            at = (at * 7 + 3) % 60 if rng.random() < 0.9 else int(rng.integers(60))
            text.append(words[at])
        out.append((i, " ".join(text), "x", "y"))
    odd = ["", None, " \n\t ", "Zebra quagga ÉCLAIR éclair", "w1 " * 3000, "W1\x0bw1\xa0w2"]
    return out + [(1000 + i, t, None, None) for i, t in enumerate(odd)] + [(7, out[7][1], "x", "y"), (None, "w1 w2", "x", "y")]


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def toks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_scores(spark):
    data = rows()
    # a small head: some words have their counts joined, others come from the model's own list
    got = scoring.scored(spark.createDataFrame(data, SCHEMA).repartition(3), head=40, table_bits=16).collect()
    count = Counter(t for d, text, *_ in data if not held(d) for t in toks(text))
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if d is None else d, held(d), len(ts := toks(text)), sum(count[t] > 0 for t in ts), n, round(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)) for d, text, *_ in data)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    unseen = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert len(unseen) > 20
    # contexts make the chain far likelier than counts alone do
    assert sum(r["score"] for r in unseen) > 0.6 * sum(r["base_score"] for r in unseen)
    same = [r["score"] for r in got if r["doc_id"] == 7]
    assert len(same) == 2 and same[0] == same[1]
    assert [r["bits_per_byte"] for r in got if r["doc_id"] in (1000, 1001)] == [None, None]


def test_empty_table(spark):
    assert scoring.scored(spark.createDataFrame([], SCHEMA), table_bits=15).collect() == []


def test_only_held_out(spark):
    ids = [i for i in range(200) if held(i)][:5]
    got = scoring.scored(spark.createDataFrame([(i, "a b", None, None) for i in ids], SCHEMA), table_bits=15).collect()
    assert len(got) == 5 and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


def small_model():
    head = {w: i for i, w in enumerate([b"a", b"bc", b"d", b"e"])}
    coder = scoring.Coder(head, np.array([8, 4, 2, 1]), 3, 5, 15)
    speller = scoring.Speller((np.bincount(np.frombuffer(b"a bc d e ", np.uint8), minlength=256) + 1).tolist(), 15)
    models = []
    for kind, own, chunks in ((0, coder, ([b"a bc a d", b"e a a"], [b"zz a", b"a bc zzq a"])), (1, speller, ([b"zz", b"zzq"], [b"words", b"new"]))):
        tables, mixer = scoring.Tables.empty(15), scoring.Mixer()
        for texts in chunks:
            coded = own.code(texts)
            tables.learn(coded[0] if kind else coded.stream, mixer)
        models.append(scoring.Model(kind, own, list(tables.parts()), scoring.Mixer.of([mixer.packed()])))
    return models


def test_chances_add_up_to_one_at_most():
    model, spelling = small_model()
    odds = scoring.Odds.of(15, model.parts, without_own=False)
    # a text begins with its end, a word of the head, or an escape
    chances = []
    for text in (b"", *model.coder.head, b"unknown"):
        stream = model.coder.code([text]).stream
        chances.append(2.0 ** -stream.by_symbol(model.mixer.code_length(stream.bit, *odds.look(stream)))[0])
    assert sum(chances) == pytest.approx(1.0, abs=1e-4)
    spelled = spelling.coder.spelled([bytes([c]) for c in range(33, 256)], scoring.Odds.of(15, spelling.parts, without_own=False), spelling.mixer)
    assert sum(2.0**-spelled) <= 1.0


def mix32(x):
    x = x * 0xD6E8FEB86659FD93 % 2**64
    x = (x ^ x >> 31) * 0x7FB5D329728EA185 % 2**64
    x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D % 2**64
    return x >> 32


class Plain:
    """A coder and its mixer one bit at a time, from the docstring."""

    def __init__(self, coder):
        self.coder, self.counts = coder, {}
        self.weights = [[0.4] * 3 for _ in range(scoring.GATES)]

    def slot(self, k, context, root, place):
        group = (2 * root + isinstance(self.coder, scoring.Speller)) * 0x85EBCA6B % 2**32
        return (((mix32(context * 4 + k + 1) ^ group) * 0x9E3779B1 % 2**32) >> (35 - self.coder.table_bits)) * 8 + place

    def path(self, tree, symbol, contexts):
        """(bit, the keys of its slots, the depth's part of its gate)."""
        at, n = int(tree.offset[symbol]), int(tree.length[symbol])
        kind = int(isinstance(self.coder, scoring.Speller))
        out = []
        for i in range(n):
            number, bit = int(tree.step[at + i]) >> 8, int(tree.step[at + i]) & 1
            root, place = (number, 1) if i % 3 == 0 else (root, 2 * place + before)
            before = bit
            depth = (4 * kind + (i > 2) + (i > 5) + (i > 9)) * 16
            out.append((bit, [(k, number if x is None else self.slot(k, x, root, place)) for k, x in enumerate(contexts)], depth))
        return out

    def words(self, text):
        c, out, seen = self.coder, [], []
        toks = text.lower().split()
        own = [c.head.get(w, -1) for w in toks]
        symbols = [c.escape if i < 0 else i for i in own] + [c.end]
        kinds = [(i if 0 <= i < scoring.OWN_CLASS else scoring.OWN_CLASS + w[-1]) for i, w in zip(own, toks, strict=True)]
        for i, symbol in enumerate(symbols):
            recent = [seen[-k] + 1 if len(seen) >= k else 0 for k in (1, 2)]
            out += self.path(c.words, symbol, [None, kinds[i - 1] + 1 if i else 0, recent[0] * (scoring.COMMON + 1) + recent[1]])
            if symbol < min(scoring.COMMON, len(c.head)):
                seen.append(symbol)
        return out

    def letters(self, word):
        spelled, out = word + b" ", []
        for i, byte in enumerate(spelled):
            b = [spelled[i - k] if i >= k else scoring.STOP for k in (1, 2, 3, 4)]
            out += self.path(self.coder.letters, byte, [int.from_bytes(bytes(b[:k]), "big") for k in (2, 3, 4)])
        return out

    def steps(self, text):
        return self.words(text) if isinstance(self.coder, scoring.Coder) else self.letters(text)

    def odds(self, keys, less=None):
        out, gate = [], 0
        for k, key in enumerate(keys):
            zeros, ones = self.counts.get(key, (0, 0))
            zeros, ones = max(zeros - (less == 0), 0), max(ones - (less == 1), 0)
            out.append(math.log(ones + scoring.DELTA) - math.log(zeros + scoring.DELTA))
            if k:
                n = zeros + ones
                gate += ((n > 0) + (n > 2) + (n > 12)) << (2 if k == 1 else 0)
        return out, gate

    def learn(self, texts):
        """Predicts the bits of all texts with what was known before, then learns from them."""
        bits = [step for t in texts for step in self.steps(t)]
        pull, curve = {}, {}
        for bit, keys, depth in bits:
            x, gate = self.odds(keys)
            gate += depth
            mixed = max(min(sum(a * b for a, b in zip(x, self.weights[gate], strict=True)), scoring.MOST), -scoring.MOST)
            p = 1 / (1 + math.exp(-mixed))
            pull[gate] = pull.get(gate, 0) + np.array(x) * (bit - p)
            curve[gate] = curve.get(gate, 0) + np.square(x) * p * (1 - p)
        for gate in pull:
            self.weights[gate] = self.weights[gate] + scoring.RATE * np.clip(pull[gate] / (3 * curve[gate] + 30), -1, 1)
        for bit, keys, _ in bits:
            for key in keys:
                zeros, ones = self.counts.get(key, (0, 0))
                self.counts[key] = (zeros + (bit == 0), ones + (bit == 1))


@pytest.mark.parametrize("kind", [0, 1])
def test_against_a_coder_of_one_bit_at_a_time(kind):
    model = small_model()[kind]
    mixer, plain = model.mixer, Plain(model.coder)
    for texts in (([b"a bc a d", b"e a a"], [b"zz a", b"a bc zzq a"]), ([b"zz", b"zzq"], [b"words", b"new"]))[kind]:
        plain.learn(texts)
    used = [g for g in range(scoring.GATES) if mixer.used[g]]
    assert len(used) > 3
    np.testing.assert_allclose(mixer.weights[used], np.array([plain.weights[g] for g in used]), atol=1e-4)
    cases = ((b"a bc zz e", False), (b"", False), (b"new words A bc", False), (b"a bc a d", True), (b"a bc zzq a", True))
    for text, own in cases if kind == 0 else ((b"zebra", False), (b"wordsy", False), (b"zz", True), (b"new", True)):
        odds = scoring.Odds.of(15, model.parts, without_own=own)
        stream = model.coder.code([text])[0] if kind else model.coder.code([text]).stream
        got = mixer.code_length(stream.bit, *odds.look(stream))
        for bits, (bit, keys, depth) in zip(got, plain.steps(text), strict=True):
            x, gate = plain.odds(keys, bit if own else None)
            mixed = sum(a * b for a, b in zip(x, plain.weights[gate + depth], strict=True))
            near = []
            for m in (mixed - 0.06, mixed, mixed + 0.06):  # odds and mix are rounded
                cell = min(max(round(m * 2) + 16, 0), 32)
                turned = mixer.turned[gate + depth, cell]
                refined = (turned[1] + 20 / (1 + math.exp(-(cell - 16) / 2))) / (turned.sum() + 20)
                p = 0.5 / (1 + math.exp(-m)) + 0.5 * refined
                near.append(-math.log2(p if bit else 1 - p))
            assert min(near) - 0.02 <= bits <= max(near) + 0.02


def test_hashes_of_words_are_those_of_spark(spark):
    words = ["a", "é", "wörter", "x" * 70]
    got = [r["h"] % 2**64 for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w) AS h").collect()]
    assert got == [xxhash.xxh64_intdigest(w.encode(), scoring.SEED) for w in words]


def test_passages_are_alike_in_copies_and_cover_the_text_from_the_first_on():
    coder = small_model()[0].coder
    rng = np.random.default_rng(2)
    shared = " ".join(f"s{i}" for i in rng.integers(0, 50, 300))
    texts = [f"x y {shared}".encode(), f"quite another beginning {shared} and end".encode(), b"", b"a b"]
    coded = coder.code(texts)
    at, context, words = scoring.passages(coded, every=8)
    of = [[(c, w) for a, c, w in zip(at, context, words, strict=True) if coded.doc[a] == d] for d in range(4)]
    assert len(of[0]) > 15 and not of[2] and not of[3]
    assert len(set(of[0]) & set(of[1])) >= len(of[0]) - 2
    other = scoring.passages(coder.code([texts[1]]), every=8)
    assert [(c, w) for c, w in zip(*other[1:], strict=True)] == of[1]


def test_passages_followed_against_a_loop(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 5 == 0, [(int(c), int(rng.integers(1 + c % 4)), 1.0) for c in rng.integers(0, 12, 6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_key long, held_out boolean, passages array<struct<context:long,words:long,bits:float>>")
    got = {(r["row_key"], r["passage"]): (r["n"], r["total"], r["same"]) for r in scoring._followed(df).collect()}
    count = Counter((c, w) for _, held_out, ps in rows if not held_out for c, w, _ in ps)
    assert len(got) == 360
    for i, held_out, ps in rows:
        for k, (c, w, _) in enumerate(ps):
            mine = {words: n for (context, words), n in count.items() if context == c}
            top = max(mine, key=lambda x: (mine[x], x), default=None)
            n = mine[top] - (w == top and not held_out) if mine else 0
            total = sum(mine.values()) - (not held_out)
            want = (max(n, 1), total, w == top and n > 0) if mine and total > 0 else (None, None, False)
            have = got[i, k + 1]
            assert (have[0], have[2]) == (want[0], want[2]) and (want[1] is None or have[1] == want[1])


def test_copies_of_a_document_are_told_apart(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"k{i}" for i in rng.integers(0, 500, 120)) for _ in range(150)]
    rows = [(i, t, "", "") for i, t in enumerate(texts)] + [(1000 + i, texts[i], "", "") for i in range(0, 150, 10)]
    got = {r["doc_id"]: r for r in scoring.scored(spark.createDataFrame(rows, SCHEMA), table_bits=16).collect()}
    alone = [got[i]["bits_per_byte"] for i in range(150) if i % 10]
    twice = [got[i]["bits_per_byte"] for i in range(0, 150, 10) if not held(1000 + i)]
    assert max(twice) < min(alone)


def test_words_of_slices_are_those_of_python():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice([32, 9, 10, 11, 12, 13, 28, 31, 65, 97, 195, 160, 0, 133], 40).astype(np.uint8)) for _ in range(300)] + [b"", b" ", b"A"]
    for low, n in ((0, 303), (7, 50), (290, 13), (300, 2), (5, 0)):
        sizes, words = scoring.tokens(pa.array(texts, pa.binary()).slice(low, n))
        want = [t.lower().split() for t in texts[low : low + n]]
        assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [w for ws in want for w in ws]


def test_bits_of_few_tokens_at_a_time_are_those_of_the_whole_text():
    coder = small_model()[0].coder
    coded = coder.code([b"a bc zz d " * 50, b"", b"e new A"])
    parts = [coded.bits(slice(at, at + 7)) for at in range(0, len(coded.ids), 7)]
    whole = coded.stream
    assert max(len(p.starts) for p in parts) == 7 and np.array_equal(np.concatenate([p.bit for p in parts]), whole.bit)
    assert all(np.array_equal(np.concatenate([p.slots[k] for p in parts]), whole.slots[k]) for k in range(3))
