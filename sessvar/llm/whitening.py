"""Embedding whitening from an exact scatter matrix.

Vectors become integers. The scatter of the distinct integer vectors, with a column of ones that also gives their number and sums, is
computed modulo several primes: each partition multiplies residues with ordinary double-precision matrix products, which are exact as
long as a block's sums stay below 2 ** 53. Residues are summed over partitions, and each entry is put together from them by Chinese
remaindering; the product of the primes exceeds twice the largest possible entry, so nothing is rounded. The covariance is then one
exact division away from its integers, and its eigenvectors come from one double-precision eigh.

A vector that is null or holds null or non-finite entries is dropped; its row has no result. A shorter vector is continued with zeros to
the longest one's length. Entries beyond a long are held at its ends. Repeated rows are kept and all get results, but each distinct vector
counts once in the fit; a null vec_id is an ordinary value. A component without variance has null ``whitened``. ``deviation`` is null where
it exceeds a long. What reaches the driver are the (dimensions + 1) ** 2 / 2 entries of the scatter, whatever the rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Production parameters: units of 1, components returned.
SCALE = 256
COMPONENTS = 4
#: Primes lie below 2 ** PRIME_BITS and residues are centred, so a product is below 2 ** 40 and BLOCK of them below 2 ** 52.
PRIME_BITS = 21
BLOCK = 4096
_LONG = 2**63 - 1


@functools.cache
def primes(count: int) -> list[int]:
    """The largest ``count`` primes below 2 ** PRIME_BITS."""
    found: list[int] = []
    candidate = (1 << PRIME_BITS) - 1
    while len(found) < count:
        if all(candidate % d for d in range(3, math.isqrt(candidate) + 1, 2)):
            found.append(candidate)
        candidate -= 2
    return found


def primes_for(rows: int, bits: int) -> list[int]:
    """Enough primes that sums over ``rows`` of products of two numbers of ``bits`` bits are told apart, negative ones too."""
    need, count = 2 * max(rows, 1) * (1 << 2 * max(bits, 1)) + 1, 1
    while math.prod(primes(count)) <= need:
        count += 1
    return primes(count)


def fixed_point(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, integers) of the vectors of column 1 that are whole and finite."""
    lists = batch.column(1)
    values = lists.values.to_numpy(zero_copy_only=False).astype(float)
    starts, absent = np.asarray(lists.offsets), lists.is_null().to_numpy(zero_copy_only=False)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    with np.errstate(all="ignore"):
        scaled = np.where(np.isfinite(values), np.floor(values * scale), 0.0)
    whole = np.where(np.abs(scaled) < 2.0**63, scaled, 0.0).astype(np.int64)
    whole[scaled >= 2.0**63], whole[scaled <= -(2.0**63)] = _LONG, -_LONG
    for i in np.flatnonzero(~absent & (odd[starts[1:]] == odd[starts[:-1]])).tolist():
        yield i, whole[starts[i] : starts[i + 1]]


def packed(x: np.ndarray) -> tuple[bytes, int]:
    """A vector without its last zeros in the fewest bytes an entry, equal just for equal vectors, and the bits of its largest entry."""
    held = x[: int(np.flatnonzero(x)[-1]) + 1] if x.any() else x[:0]
    bits = max(int(held.max()), -int(held.min())).bit_length() if len(held) else 0
    width = next(w for w in (1, 2, 4, 8) if bits < 8 * w)
    return bytes([width]) + held.astype(f"<i{width}").tobytes(), bits


def unpacked(x: bytes, dims: int) -> np.ndarray:
    out = np.zeros(dims, np.int64)
    held = np.frombuffer(x, f"<i{x[0]}", offset=1)
    out[: len(held)] = held
    return out


def fit_list(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Each distinct vector once: ``x``, packed; ``dims``, its longest length before it lost last zeros; ``bits``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*packed(x), len(x)) for _, x in fixed_point(batch, scale)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["x", "bits", "dims"])

    return vectors.mapInArrow(work, "x binary, bits int, dims int").groupBy("x").agg(F.max("bits").alias("bits"), F.max("dims").alias("dims"))


def residue_scatter(fit: DataFrame, dims: int, moduli: list[int]) -> DataFrame:
    """(i, prime, part): of each partition, row i from its diagonal on of the scatter of (x, 1) modulo each prime."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), dims + 1, dims + 1), np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            block = np.column_stack([np.stack(held), np.ones(len(held), np.int64)])
            for k, p in enumerate(moduli):
                residues = block % p
                residues = np.where(residues > p // 2, residues - p, residues).astype(float)
                total[k] = (total[k] + (residues.T @ residues).astype(np.int64)) % p
            held.clear()

        seen = False
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(unpacked(x, dims))
                seen = True
                if len(held) == BLOCK:
                    add()
        if held:
            add()
        for i in range((dims + 1) * seen):
            part = [total[k, i, i:].tobytes() for k in range(len(moduli))]
            yield pa.record_batch([pa.array([i] * len(part), pa.int32()), pa.array(moduli, pa.int64()), pa.array(part, pa.binary())], names=["i", "prime", "part"])

    return fit.select("x").mapInArrow(work, "i int, prime long, part binary")


def remaindered(residues: np.ndarray, moduli: list[int]) -> list[int]:
    """Integers, negative ones too, from their residues: a row of ``residues`` a prime."""
    whole = math.prod(moduli)
    parts = [whole // p * pow(whole // p, -1, p) for p in moduli]
    found = [sum(int(r) * m for r, m in zip(column, parts, strict=True)) % whole for column in residues.T.tolist()]
    return [v - whole if 2 * v > whole else v for v in found]


def exact_scatter(parts: DataFrame, moduli: list[int]) -> DataFrame:
    """(i, entries): each row of the scatter from its diagonal on, exact, as decimal texts. A task adds up residues as they come and holds a row for each i it has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {p: k for k, p in enumerate(moduli)}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, p, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = np.frombuffer(part, np.int64)
                if i not in sums:
                    sums[i] = np.zeros((len(moduli), len(row)), np.int64)
                sums[i][place[p]] = (sums[i][place[p]] + row) % p
        rows = [[str(v) for v in remaindered(r, moduli)] for r in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["i", "entries"])

    return parts.repartition("i").mapInArrow(work, "i int, entries array<string>")


class Whitening:
    """The fit: ``n`` vectors, their exact ``sums``, and components as columns of ``axes``, already over n and the root of their eigenvalue."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int, bits: int):
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        trace = float(np.trace(covariance))
        # either sign is right: the largest entry is made positive, so that reruns agree
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        self.n, self.sums, self.bits = n, sums, bits
        self.valid = values > trace * len(sums) * np.finfo(float).eps
        self.explained = np.where(self.valid, values, 0.0) / trace if trace > 0 else np.zeros(len(values))
        self.axes = vectors[:, self.valid] / (n * np.sqrt(values[self.valid]))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x less the sums, exact: longs while they fit, else Python integers."""
        if self.n << self.bits + 1 < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        if centred.dtype != object and centred.shape[1] * int(np.abs(centred).max(initial=0)) ** 2 <= _LONG:
            return (centred * centred).sum(axis=1).tolist()
        found = (centred.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v <= _LONG else None for v in found]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(float) @ self.axes


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits :class:`Whitening` to a saved :func:`fit_list`; None without vectors."""
    n, dims, bits = fit.agg(F.count("*"), F.max("dims"), F.max("bits")).first()
    if not n or not dims:
        return None
    moduli = primes_for(n, bits)
    scatter: dict[int, list[int]] = {r["i"]: list(map(int, r["entries"])) for r in exact_scatter(residue_scatter(fit, dims, moduli), moduli).collect()}
    sums = [scatter[i][-1] for i in range(dims)]
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            # centred in integers, and rounded once, in the division
            covariance[i, j] = covariance[j, i] = (n * scatter[i][j - i] - sums[i] * sums[j]) / (n * n)
    return Whitening(n, sums, covariance, components, bits)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity; null without a component of variance."""
    count, dims = model.axes.shape[1], len(model.sums)
    if not count:
        return None
    names = [f"w{k}" for k in range(count)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([unpacked(b, dims) for b in batch.column(0).to_pylist()]) if batch.num_rows else np.zeros((0, dims), np.int64)
            yield pa.record_batch(list(model.whitened(model.centred(x)).T.copy()), names=names)

    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    white = fit.select("x").mapInArrow(work, ", ".join(f"{w} double" for w in names))
    found = white.agg(*(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[k] - (i == j)) for k, (i, j) in enumerate(pairs))


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """A row for each row of ``embeddings`` (vec_id, embedding) with a whole vector and each component: see the module for odd input."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = common.saved(fit_list(vectors, scale), "whitening-fit")
    model = fitted(fit, components)
    if model is None:
        common.dropped(fit)
        return spark.createDataFrame([], _RESULT)
    error, dims, count = identity_error(fit, model), len(model.sums), len(model.valid)
    common.dropped(fit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, x in fixed_point(batch, scale):
                rows.append(i)
                found.append(np.pad(x, (0, dims - len(x))))
            if not rows:
                continue
            centred = model.centred(np.stack(found))
            white = np.full((len(rows), count), np.nan)
            white[:, model.valid] = model.whitened(centred)
            m = len(rows)
            columns = [
                batch.column(0).take(pa.array(np.repeat(rows, count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                pa.array(np.full(m * count, model.n)),
                pa.array([d for d in model.deviations(centred) for _ in range(count)], pa.int64()),
                pa.array(white.ravel(), mask=np.tile(~model.valid, m)),
                pa.array(np.tile(model.explained, m)),
                pa.array([error] * (m * count), pa.float64()),
            ]
            yield pa.record_batch(columns, names=[c.split()[0] for c in _RESULT.split(", ")])

    return vectors.mapInArrow(work, _RESULT)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened by the components of their distinct fixed-point vectors."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
