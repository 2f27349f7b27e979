import math
import random

import numpy as np
import pytest

from sessvar.llm import whitening


def plain(vectors, scale=256, components=4):
    """Deviation and whitened values of each vector, by Python integers and one eigh."""
    xs = [[math.floor(scale * c) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, xs)))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    v = np.array([[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) / n**3 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs]
    white = (np.array(xs, float) - np.array(sums) / n) @ axes / np.sqrt(values)
    return n, deviation, white, values / np.trace(v)


def made(seed=1, rows=200, d=7):
    rng = random.Random(seed)
    out = [[rng.gauss(0.3, 0.2 * (k + 1)) for k in range(d)] for _ in range(rows)]
    return out + out[:20] + [out[0]] * 30


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, 1, "clash") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, whitened string").repartition(5)


def test_against_plain_integers(spark):
    vectors = made()
    got = {(r.vec_id, r.component): r for r in whitening.whitened(frame(spark, vectors)).collect()}
    n, deviation, white, explained = plain(vectors)
    assert len(got) == 4 * len(vectors) and {r.n for r in got.values()} == {n}
    for k in range(4):
        sign = np.sign(white[0, k] * got[0, k + 1].whitened)
        for i, d in enumerate(deviation):
            r = got[i, k + 1]
            assert r.deviation == d and r.whitened == pytest.approx(sign * white[i, k], rel=1e-8, abs=1e-9)
            assert r.explained == pytest.approx(explained[k], rel=1e-9) and r.identity_error < 1e-9


def test_what_is_dropped_and_what_is_not(spark):
    odd = [None, [0.1, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, -float("inf")], [None]]
    good = [[0.5, -0.25], [0.5], [], [0.5, 0.0], [1.0, 3.0], [-0.001, 0.0]]
    ids = [*range(100, 106), 0, 1, 2, 3, None, 5]
    got = whitening.whitened(frame(spark, odd + good, ids)).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3, None, 5} and len(got) == 12
    want = plain([[0.5, -0.25], [0.5, 0.0], [0.0, 0.0], [0.5, 0.0], [1.0, 3.0], [-0.001, 0.0]])
    assert {r.n for r in got} == {want[0]} == {5}
    assert {r.vec_id: r.deviation for r in got} == dict(zip(ids[6:], want[1], strict=True))


def test_large_entries_are_exact(spark):
    rng = random.Random(2)
    vectors = [[rng.uniform(-1, 1) * 2.0**52, rng.uniform(-1, 1) * 2.0**30, float(i)] for i in range(40)]
    got = whitening.whitened(frame(spark, vectors)).collect()
    n, deviation, white, explained = plain(vectors, components=3)
    assert all(r.deviation is None for r in got)
    assert deviation[0] > 2**63
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(2):
        assert abs(by[7, k + 1].whitened) == pytest.approx(abs(white[7, k]), rel=1e-6)
    # beyond a long: held at its ends
    assert whitening.whitened(frame(spark, [[1e300], [-1e300], [1.0]])).count() == 3


def test_no_variance_and_no_rows(spark):
    got = whitening.whitened(frame(spark, [[0.5, 1.0]] * 3)).collect()
    assert len(got) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in got)
    one_axis = whitening.whitened(frame(spark, [[0.5, 1.0], [0.75, 1.0], [2.0, 1.0]])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in one_axis) and all(r.identity_error < 1e-9 for r in one_axis)
    for rows in ([], [None, [float("nan")]]):
        none = whitening.whitened(frame(spark, rows))
        assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_remainders_give_back_integers():
    rng = random.Random(3)
    for bits, rows in ((1, 1), (10, 5000), (63, 10**9)):
        moduli = whitening.primes_for(rows, bits)
        values = [rng.randint(-rows << 2 * bits, rows << 2 * bits) for _ in range(50)] + [rows << 2 * bits, -rows << 2 * bits, 0]
        residues = np.array([[v % p for v in values] for p in moduli])
        assert whitening.remaindered(residues, moduli) == values
        assert all(p < 2**21 and all(p % d for d in range(2, 1449)) for p in moduli) and len(set(moduli)) == len(moduli)


def test_blocks_over_the_limit_of_one_product(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    vectors = made(4, rows=150, d=3)
    fit = whitening.fit_list(frame(spark, vectors).select("vec_id", "embedding"))
    moduli = whitening.primes_for(200, 20)
    rows = {r.i: list(map(int, r.entries)) for r in whitening.exact_scatter(whitening.residue_scatter(fit, 3, moduli), moduli).collect()}
    xs = [(*x, 1) for x in {tuple(math.floor(256 * c) for c in v) for v in vectors}]
    assert rows == {i: [sum(x[i] * x[j] for x in xs) for j in range(i, 4)] for i in range(4)}
