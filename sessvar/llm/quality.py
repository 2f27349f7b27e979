"""Quality by regularised quadratic discriminant analysis of document statistics.

Each class has a mean and a covariance, shrunk toward the pooled covariance and toward its own
diagonal. A document's score is the logistic of the difference of the two Gaussian log densities,
taken from cached Cholesky factors, over a temperature.

Odd input is handled as :mod:`.common` states, but for what is said here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, stats

#: Production parameters: folds of which the first is held out, shares of pooled and of diagonal covariance, temperature, threshold.
FOLDS = 5
POOLED, DIAGONAL = 0.1, 0.001
TEMPERATURE = 4.0
THRESHOLD = 0.3
COUNT_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in stats.COUNTS)


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log weights; ``shares`` make features of counts."""

    shares: np.ndarray
    mean: tuple[np.ndarray, ...]
    inverse: tuple[np.ndarray, ...]
    offset: tuple[float, ...]
    rate: float = 0.5

    @classmethod
    def from_moments(cls, shares: np.ndarray, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> Discriminant:
        """From counts, sums and sums of products by class. Without both classes every score is the share of class 1, or a half."""
        if n.min() < 2:
            return cls(shares, (), (), (), float(n[1] / n.sum()) if n.sum() else 0.5)
        mean = first / n[:, None]
        covariance = second / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = np.tensordot(n, covariance, 1) / n.sum()
        inverse, offset = [], []
        for k in (0, 1):
            s = (1 - POOLED) * covariance[k] + POOLED * pooled
            s = (1 - DIAGONAL) * s + DIAGONAL * np.diag(np.diag(s)) + 1e-9 * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            inverse.append(np.linalg.inv(factor))
            offset.append(float(np.log(n[k]) - np.log(np.diag(factor)).sum()))
        return cls(shares, tuple(mean), tuple(inverse), tuple(offset))

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(counts), self.rate)
        x = stats.features(counts, self.shares)
        density = [o - 0.5 * (((x - m) @ i.T) ** 2).sum(axis=1) for m, i, o in zip(self.mean, self.inverse, self.offset, strict=True)]
        return 0.5 * (1 + np.tanh((density[1] - density[0]) / (2 * TEMPERATURE)))


def usual_shares(train: DataFrame) -> np.ndarray:
    total = train.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stats.COUNTS)).first()
    return stats.usual(np.array(total, float))


def fit(train: DataFrame) -> Discriminant:
    """From all rows of ``train`` (COUNTS and y): their moments are summed by Spark, and only those sums reach the driver."""
    shares, d = usual_shares(train), len(stats.FEATURES)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = stats.features(pdf[list(stats.COUNTS)].to_numpy(), shares), pdf["y"].to_numpy()
            for k in (0, 1):
                own = x[y == k]
                yield pd.DataFrame({"y": k, "m": [np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])]})

    parts = train.mapInPandas(moments, "y int, m array<double>")
    summed = parts.select("y", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in summed:
        total[r["y"], r["i"]] = r["v"]
    return Discriminant.from_moments(shares, total[:, 0], total[:, 1 : d + 1], total[:, d + 1 :].reshape(2, d, d))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out and score of every row. The texts are read once; labels of held-out documents are not used."""
    rows = common.saved(stats.counts(docs), "counts")
    model = fit(common.saved(stats.labelled(rows, labels, label, folds), "counts-labelled"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": model.score(pdf[list(stats.COUNTS)].to_numpy())})

    return rows.withColumn("held_out", common.id_crc(folds) == 0).mapInPandas(work, "doc_id long, held_out boolean, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label: str = "quality", folds: int = FOLDS) -> DataFrame:
    """The documents that score ``threshold`` or more, with the columns of documents, each as it was.

    The texts are counted once; counts lie beside the rows in a scratch table, and only they go to Python again to be scored.
    """
    kept = docs.select(*common.DOCUMENT_COLUMNS)
    counted = common.saved(kept.withColumn("counts", stats.counted(F.coalesce(F.col("text"), F.lit("")))), "counted")
    rows = counted.select(F.col("doc_id").cast("long").alias("doc_id"), "counts.*")
    model = fit(common.saved(stats.labelled(rows, labels, label, folds), "counts-labelled"))

    @F.arrow_udf("double")
    def score(counts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.column_stack([f.to_numpy() for f in counts.flatten()])))

    return counted.filter(score("counts") >= threshold).select(*common.DOCUMENT_COLUMNS)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    found = scored(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
