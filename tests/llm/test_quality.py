import re
import zlib

import numpy as np
import pytest

from sessvar.llm import quality, rules, stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_chars": len(text),
        "n_doubled_words": sum(a == b for a, b in zip(words, words[1:], strict=False)),
        "n_lines": len(lines),
        "n_capital_words": len([w for w in words if "A" <= w[0] <= "Z"]),
    }


TEXTS = ["", " \n\t ", "One", "a b c d e f g h " * 3, "x y\nx y\n \nX y\nx y ", "é#*$%&|<> ünï", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0", "same " * 9, "same " * 8, "A B c\x0bd", "w1 w2 w3 w4 w5 w6 w7", " ".join(map(str, range(3000))) * 2]


def test_counts():
    got = stats.count([t.encode() for t in TEXTS])
    for text, row in zip(TEXTS, got, strict=True):
        have = dict(zip(stats.COUNTS, row.tolist(), strict=True))
        want = plain(text)
        assert {k: have[k] for k in want} == want, text[:30]
    alone = np.vstack([stats.count([t.encode()]) for t in TEXTS])
    assert (alone == got).all()


def table(spark, n=400):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"{'abcdefgh'[k % 8]}{k}" for k in rng.integers(0, 5000, int(rng.integers(25, 200)))]
        good = i % 4 > 0
        text = " ".join(words) if good else " ".join(w + "###" for w in words)
        rows.append((i, text, "en", "s", len(text)))
        if i % 2 or i % 3 == 0:
            labels.append((i, int(good), 0))
    rows += [(None, "a null id " * 5, None, None, None), (5, rows[5][1], "en", "s", 1), (n, None, "en", "s", 0), (n + 1, "", "en", "s", 0)]
    labels += [(None, 1, 0), (3, 1 - (3 % 4 > 0), 0), (n + 5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_discriminant_and_rules(spark):
    docs, labels = table(spark)
    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 400:
            assert (r.score >= quality.THRESHOLD) == (r.doc_id % 4 > 0)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 400) == sorted([5, *(i for i in range(400) if i % 4)])
    # labels of held-out documents change nothing
    flipped = labels.withColumn("quality", quality.F.when(quality.common.id_crc(5) == 0, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    again = {(r.doc_id, round(r.score, 9)) for r in quality.scored(docs, flipped).collect()}
    assert again == {(r.doc_id, round(r.score, 9)) for r in got}
    verdicts = rules.judged(docs, labels).collect()
    for r in verdicts:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        if not r.base_failed and r.doc_id is not None:
            assert r.kept == (r.doc_id % 4 > 0)


def test_without_labels_or_rows(spark):
    docs, labels = table(spark, 20)
    got = quality.scored(docs, labels.limit(0)).collect()
    assert {r.score for r in got} == {0.5}
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert rules.judged(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in rules.judged(docs, labels.limit(0)).collect()} == {0.5}


def test_moments_give_the_classes():
    rng = np.random.default_rng(0)
    d = len(stats.FEATURES)
    x = [rng.normal(k, 1 + k, (5000, d)) for k in (0, 1)]
    model = quality.Discriminant.from_moments(np.ones(len(stats.SHARES)), np.array([5000.0, 5000.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    for k in (0, 1):
        s = np.cov(x[k].T, bias=True)
        pooled = sum(np.cov(v.T, bias=True) for v in x) / 2
        s = 0.9 * s + 0.1 * pooled
        s = 0.999 * s + 0.001 * np.diag(np.diag(s))
        assert np.allclose(model.inverse[k].T @ model.inverse[k], np.linalg.inv(s), atol=1e-4)


@pytest.mark.parametrize("sign", [1, -1])
def test_trees_keep_their_direction(sign):
    rng = np.random.default_rng(2)
    x = rng.random((1500, 3))
    y = (x[:, 0] + 0.4 * np.sin(12 * x[:, 1]) + rng.normal(0, 0.2, 1500) > 0.6).astype(float)
    trees = rules.grow(x, y, np.array([1, sign, 0]), trees=30)
    for j, direction in ((0, 1), (1, sign)):
        base = rng.random((200, 3))
        steps = []
        for v in np.linspace(0, 1, 25):
            base[:, j] = v
            steps.append(trees.margin(base))
        assert (direction * np.diff(np.array(steps), axis=0) >= -1e-12).all()
    free = rules.grow(x, y, np.zeros(3), trees=30)
    assert ((free.score(x) > 0.5) == y).mean() > 0.88
    # the flattened arrays against a walk from node to node
    for row in x[:50]:
        total = free.start
        for f, t, leaf in zip(free.feature, free.threshold, free.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += leaf[at - len(f)]
        assert free.margin(row[None])[0] == pytest.approx(total)
