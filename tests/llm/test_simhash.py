import itertools
import random

import pytest
import xxhash

from sessvar.llm import graph, simhash


def plain_fingerprint(text, words=4):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def plain_components(prints, radius=4):
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_masks_cover_every_small_difference():
    covering = simhash.masks(4)
    assert len(covering) == 31
    rng = random.Random(1)
    sets = [c for n in (1, 2) for c in itertools.combinations(range(64), n)] + [rng.sample(range(64), n) for n in (3, 4) for _ in range(4000)]
    for bits in sets:
        diff = sum(1 << i for i in bits)
        assert any(not diff & m for m in covering)
    assert all(24 <= m.bit_count() <= 40 for m in covering)


def test_fingerprint():
    for text in ("", " \t", "One", "A b\tC", "a b c d", "Éa b c d e f g", "x " * 40_000, "a b c d " * 9):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def clusters(n=60):
    rng, prints = random.Random(3), []
    for _ in range(n):
        at = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 3, 8))):
            prints.append(at)
            for _ in range(rng.randrange(6)):
                at ^= 1 << rng.randrange(64)
    return prints


@pytest.mark.parametrize("most", [8192, 2])
def test_links_connect_what_all_pairs_connect(spark, most):
    prints = sorted(set(clusters()))
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = {r.node: r.root for r in graph.components(simhash.links(frame, most=most)).collect()}
    want = plain_components(prints)
    groups = {}
    for p, c in zip(prints, want, strict=True):
        s = simhash._signed(p)
        groups.setdefault(c, set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(5, 5), (1, 2), (2, 1)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in [7, *range(200, 400)]} == {7} and got[2] == 1 and 5 not in got


def test_whole_table(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(50, " ".join(base)), (9, " ".join(base)), (9, " ".join(base)), (3, None), (8, ""), (None, " "), (1, "only three words")]
    for i in range(30):
        words = list(base)
        words[rng.randrange(300)] = f"edit{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))) for i in range(30)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "clash") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t or "") for _, t in rows]
    roots = plain_components(prints)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = [(d, simhash._signed(p), least[r]) for (d, _), p, r in zip(rows, prints, roots, strict=True)]
    assert sorted([tuple(r)[:2] + (r.component_id,) for r in got], key=str) == sorted(want, key=str)
    kept = simhash.representatives(docs)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(docs.filter("doc_id = -1")).count() == 0


def test_representatives_of_repeated_and_null_ids(spark):
    a, b, c, d = ("one two three four five six", "quite other words stand here now", "nothing of that is said in this", "and last comes another text again")
    rows = [(5, a, "x", "s", 1), (5, b, "x", "s", 1), (None, c, "x", "s", 1), (None, d, "x", "s", 1), (7, a, "x", "s", 1), (None, c, "x", "s", 1), (9, None, "x", "s", 1), (8, "", "x", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.representatives(docs).collect())
    assert got == sorted([(5, a), (5, b), (0, c), (0, d), (8, "")])
