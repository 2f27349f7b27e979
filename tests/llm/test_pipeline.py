"""The corpus pipeline, stage by stage, on the smallest tables."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sessvar.llm import common, lines, mixing, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text, words=5):
    found = re.findall(common.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def similar(a, b):
    both = len(a & b)
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


def test_near_copies_that_simhash_cannot_reach(spark):
    """Of planted copies at a similarity of 0.8 or more every one goes, and nothing else does; repeated rows, null ids and texts without words are told apart."""
    rng = random.Random(3)
    rows, kept, pairs = [], set(), 0
    for group in range(30):
        base = [f"w{group}x{rng.randrange(10**6)}" for _ in range(150)]
        rows.append((1000 * group, " ".join(base)))
        kept.add(1000 * group)
        for k in range(1, 6):
            words = list(base)
            for at in rng.sample(range(5, 145), rng.randrange(1, 9)):
                words[at] = f"e{rng.randrange(10**9)}"
            rows.append((1000 * group + k, " ".join(words)))
            if not similar(shingles(rows[-1][1]), shingles(rows[-k - 1][1])):
                kept.add(1000 * group + k)
            else:
                pairs += (simhash.fingerprint(rows[-1][1].encode()) ^ simhash.fingerprint(rows[-k - 1][1].encode())).bit_count() > simhash.RADIUS
    assert pairs > 20 and len(kept) > 40
    # two edited copies may link where both miss the first: those groups are worked out by all pairs
    sets = {d: shingles(t) for d, t in rows}
    prints = {d: simhash.fingerprint(t.encode()) for d, t in rows}
    for d in sorted(kept):
        group = [e for e in sets if e // 1000 == d // 1000]
        reached, queue = {d}, [d]
        while queue:
            x = queue.pop()
            for y in group:
                if y not in reached and (similar(sets[x], sets[y]) or (prints[x] ^ prints[y]).bit_count() <= simhash.RADIUS):
                    reached.add(y)
                    queue.append(y)
        if min(reached) != d:
            kept.discard(d)
    rows += [(0, rows[0][1]), (90_000, None), (90_001, " "), (None, "words of a null id alone"), (None, "words of a null id alone"), (None, "other words of a null id"), (7000, "another text under a known id")]
    docs = spark.createDataFrame([(d, t, "en", None, 1, "clash") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, near string").repartition(3)
    out = corpus_pipeline.dedup_near(spark, docs, SF)
    assert out.columns == list(common.DOCUMENT_COLUMNS)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == len(set(got))
    assert sorted(d for d, _ in got if d is not None) == sorted([*kept, 7000, 90_000])
    assert sorted(t for d, t in got if d is None) == ["other words of a null id", "words of a null id alone"]
    assert corpus_pipeline.dedup_near(spark, docs.filter("false"), SF).count() == 0


def test_odd_rows_pass_through_all_stages(spark):
    """Null ids, sources and texts, repeated rows, an extra column under a name that stages use, and no rows at all."""
    good = [r["text"] for r in common.documents(spark, SF).filter("n_chars > 300").limit(25).collect()]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)] * 2
    rows += [(None, good[0] + " and more", None, None, None), (None, good[1] + " other", "en", "s1", 5), (None, good[1] + " other", "en", "s1", 5), (7, None, "en", "s1", 0), (8, "", None, None, None), (9, "x " * 50_000, "en", "s2", 100_000)]
    for some in (rows, []):
        docs = spark.createDataFrame([(*r, "clash") for r in some], "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(3)
        for name, stage in corpus_pipeline.STAGES:
            docs = common.saved(stage(spark, docs, SF), "odd-" + name.replace(" ", "-"))
            assert name == "best-fit packing" or docs.columns == list(common.DOCUMENT_COLUMNS)
        found = docs.collect()
        assert bool(found) == bool(some)
        by = {}
        for r in found:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all(sum(n for _, n in parts) <= 2048 and sorted(parts)[0][0] == 0 for parts in by.values())


def test_stages(spark):
    docs = common.documents(spark, SF).repartition(3)
    inputs, outputs = [], []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs.collect())
        docs = common.saved(stage(spark, docs, SF), name.replace(" ", "-"))
        outputs.append(docs.collect())
    columns = list(common.DOCUMENT_COLUMNS)
    assert all(list(r.asDict()) == columns for out in outputs[:-1] for r in out)
    # quality: rows pass as they were, most of those labelled good are kept
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(outputs[0]) <= set(inputs[0])
    good = [d["doc_id"] for d in inputs[0] if label.get(d["doc_id"]) == 1]
    assert sum(d in {r["doc_id"] for r in outputs[0]} for d in good) >= 0.9 * len(good)
    # line dedup against a plain loop
    first = {}
    for r in sorted(inputs[1], key=lambda r: r["doc_id"]):
        for line in (r["text"] or "").split("\n"):
            key = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(lines.SPACE.decode()))
            if len(key) >= lines.LEAST:
                first.setdefault(key, r["doc_id"])
    for r in inputs[1]:
        kept = [x for x in (r["text"] or "").split("\n") if first.get(re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(lines.SPACE.decode())), r["doc_id"]) == r["doc_id"]]
        (out,) = [o for o in outputs[1] if o["doc_id"] == r["doc_id"]]
        assert out["text"] == "\n".join(kept) and out["n_chars"] == len(out["text"])
    # near-dedup against all pairs
    prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in inputs[2]}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    sets = {r["doc_id"]: shingles(r["text"]) for r in inputs[2]}
    for a in prints:
        for b in prints:
            if a < b and ((prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS or similar(sets[a], sets[b])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(r["doc_id"] for r in outputs[2]) == sorted({find(d) for d in prints})
    # mixing: each source near its target
    size = {}
    for rows, at in ((inputs[3], 0), (outputs[3], 1)):
        for r in rows:
            size.setdefault(r["source"], [0, 0])[at] += len(r["text"].split()) if at else len(re.findall(common.WORD, r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([size[s][0] for s in order], [1 + i % 3 for i in range(len(order))])
    for s, target in zip(order, goal, strict=True):
        assert abs(size[s][1] - target) <= max(0.05 * target, 2 * mixing.BLOCK_WORDS)
    # packing: a sequence is full from 0 without gaps
    by = {}
    for r in outputs[4]:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
