import itertools
import random

import numpy as np
import pytest

from sessvar.llm import jaccard


def plain_set(text, words=3):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def plain(rows, num=90, den=100):
    """(doc_id, size, component) of each row, by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def made():
    rng = random.Random(4)
    vocabulary = [f"w{int(1.3 ** rng.uniform(0, 30))}" for _ in range(2000)]
    rows = []
    for base in range(14):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((9, 12, 40, 120, 400)))]
        for _ in range(rng.choice((1, 2, 5, 12))):
            rows.append(edited(rng, words, rng.randrange(1 + len(words) // 40)) + " " * rng.randrange(3))
        if base % 2:
            # chains: each copy edits the one before
            for _ in range(6):
                words = edited(rng, words, 1 + len(words) // 80).split()
                rows.append(" ".join(words))
            # one inside another
            rows.append(" ".join(words[: len(words) * 19 // 20]))
    line = "a line that very many of these documents end with word by word"
    rows += [f"{line} {i} {line} {i + 1}" for i in range(40)]
    rows += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(20)]
    rows += ["", None, "one", "ONE", "one two", "One  Two", "one two three", "one\ttwo\nthree", "two one", " \n", "É é x", "é é x", "x " * 3000, "x " * 50]
    ids = list(range(1000, 1000 + len(rows)))
    rng.shuffle(ids)
    return [(d, t) for d, t in zip(ids, rows, strict=True)] + [(None, rows[0]), (None, "lone words of a null id"), (3, rows[1]), (3, rows[1]), (3, "other words under a known id")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, component_id string, n_shingles int").repartition(3)


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize(("block", "rounds"), [(jaccard.BLOCK, jaccard.ROUNDS), (3, 1), (jaccard.BLOCK, 0)])
def test_against_all_pairs(spark, block, rounds):
    rows = made()
    want = plain(rows)
    assert len({c for _, _, c in want}) < len(want) - 40
    got = jaccard.near_sets(frame(spark, rows), block=block, rounds=rounds).collect()
    assert sorted_rows(got) == sorted_rows(want)


def test_a_group_of_copies_just_short_of_the_threshold(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, edited(rng, base, 1 + i % 3)) for i in range(80)]
    want = plain(rows)
    assert 5 < len({c for _, _, c in want}) < 80
    assert sorted_rows(jaccard.near_sets(frame(spark, rows)).collect()) == sorted_rows(want)


@pytest.mark.parametrize("every", [False, True])
def test_pairs_of_groups(spark, every):
    rng = random.Random(6)
    rows = []
    for group in range(60):
        base = [rng.getrandbits(64) for _ in range(60)]
        for k in range(rng.choice((1, 2, 2, 3, 5, 9))):
            h = np.array(sorted({*base[rng.randrange(9) :], *(rng.getrandbits(64) for _ in range(rng.randrange(7)))}), np.uint64)
            rows.append((group % 7, group, 100 * group + k, len(h), rng.randrange(3), jaccard.parity(h)))
    members = spark.createDataFrame(rows, "token long, key long, id long, n int, pos int, parity binary")
    by = {r[2]: r for r in rows}
    bits = {i: np.frombuffer(r[5], np.uint64) for i, r in by.items()}

    def may(x, y):
        (a, p), (b, q) = by[x][3:5], by[y][3:5]
        least = -(-90 * (a + b) // 190)
        return 100 * min(a, b) >= 90 * max(a, b) and min(a - p, b - q) >= least and np.bitwise_count(bits[x] ^ bits[y]).sum() <= a + b - 2 * least

    want = {(x, y) for x, y in itertools.combinations(sorted(by), 2) if by[x][1] == by[y][1] and may(x, y)}
    barred, linked = sorted(want)[::9], sorted(want)[4::9]
    results = spark.createDataFrame([(*by[x][:2], x, y, pair is linked) for pair in (barred, linked) for x, y in pair], "token long, key long, a long, b long, linked boolean")
    got = [(r.a, r.b) for r in jaccard.told_pairs(members, results, every).collect()]
    joined = plain_groups(by, linked)
    left = {(x, y) for x, y in want if joined[x] != joined[y] and (x, y) not in barred}
    assert len(got) == len(set(got)) and set(got) <= left
    if every:
        assert set(got) == left
    else:
        assert plain_groups(by, [*got, *linked]) == plain_groups(by, [*left, *linked]) and len(got) < len(left)


def plain_groups(nodes, pairs):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in pairs:
        root[max(find(x), find(y))] = min(find(x), find(y))
    return {i: find(i) for i in nodes}


def test_bounds():
    for n in range(1, 300):
        smaller, larger = 100 * (n - 1) >= 90 * n, 100 * n >= 90 * (n + 1)
        assert jaccard.linkable(n) == (smaller or larger)
        least = next(i for i in range(n + 1) if 100 * i >= 90 * n)
        assert jaccard.prefix_length(n) == n - least + 1
    rng = np.random.default_rng(1)
    for d in (0, 1, 30, 900):
        a, b, c = np.split(rng.permutation(np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64)))[: 3 * 1000], 3)
        x, y = np.sort(np.concatenate([a, b[: d // 2]])), np.sort(np.concatenate([a, c[: d - d // 2]]))
        apart = np.bitwise_count(np.frombuffer(jaccard.parity(x), np.uint64) ^ np.frombuffer(jaccard.parity(y), np.uint64)).sum()
        assert apart <= d and (d > 30 or apart >= d - 6)


def test_rare_words_come_first(spark):
    docs = frame(spark, [(i, "the of and " * 30 + f"rare{i} the of and to in is it was for on") for i in range(5)])
    known, counts = jaccard.word_counts(docs)
    assert len(known) == 15 and counts.max() == 31 * 5 and (np.diff(known.astype(object)) > 0).all()
    seen = jaccard.Words(known, counts)
    h, rare = seen.grams(b"The of and rare1 the of")
    assert len(h) == 4 and sorted(rare.tolist()) == [1, 1, 1, 155]


def test_forgotten_words_change_nothing(spark, monkeypatch):
    rows = made()[:60]
    monkeypatch.setattr(jaccard, "REMEMBERED", 5)
    seen = jaccard.Words(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for _, t in rows:
        assert len(seen.grams((t or "").encode())[0]) == len(plain_set(t))


def test_no_rows(spark):
    for rows in ([], [(1, None), (2, " ")]):
        got = jaccard.near_sets(frame(spark, rows))
        assert got.columns == ["doc_id", "n_shingles", "component_id"] and sorted_rows(got.collect()) == [(d, 0, d) for d, _ in rows]
