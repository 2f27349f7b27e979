"""Option prices under stochastic variance in closed form, with a clock that runs at its own speed in each piece of time.

Over a piece of weight w the variance's exponents (A, B) obey B' = c - b B + x B^2 / 2 with constant coefficients, whose solution
through any start is a Moebius map of exp(-d t). The pieces are walked from expiry back, so a flat clock is one piece of weight one.
Calls come from the integral of the characteristic function along the line of imaginary part minus a half. Each row is priced by itself
in Arrow batches: nothing is shuffled, and memory is one grid of nodes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

#: Nodes of the quadrature; its upper end, at least so much and so many over the standard deviation of the log return.
NODES, LEAST_END, END_IN_SD = 1024, 400.0, 40.0


def exponents(u: np.ndarray, pieces: list[tuple[float, float]], kappa: float, theta: float, xi: float, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """A and B of the log characteristic function A + B v0 of the log return; ``pieces`` (weight, length) in order of time."""
    total, slope = np.zeros_like(u), np.zeros_like(u)
    half = xi * xi / 2
    for weight, length in reversed(pieces):
        pull = kappa - 1j * rho * xi * math.sqrt(weight) * u
        d = np.sqrt(pull * pull + 2 * half * weight * u * (u + 1j))
        low, high = (pull - d) / (2 * half), (pull + d) / (2 * half)
        share = (slope - low) / (slope - high)
        faded = share * np.exp(-d * length)
        slope = (low - high * faded) / (1 - faded)
        total = total + kappa * theta * (low * length - np.log((1 - faded) / (1 - share)) / half)
    return total, slope


@functools.cache
def _rule(nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """A worker makes its quadrature rule once."""
    return np.polynomial.legendre.leggauss(nodes)


def call(forward: float, strike: float, pieces: list[tuple[float, float]], v0: float, kappa: float, theta: float, xi: float, rho: float, nodes: int = NODES) -> float:
    """Undiscounted call. ``xi`` must be above nought."""
    sd = math.sqrt(min(v0, theta) * sum(w * t for w, t in pieces))
    x, weight = _rule(nodes)
    end = max(LEAST_END, END_IN_SD / sd)
    u = end * (x + 1) / 2
    a, b = exponents(u - 0.5j, pieces, kappa, theta, xi, rho)
    wave = np.exp(a + b * v0 + 1j * u * math.log(forward / strike)).real
    return forward - math.sqrt(forward * strike) / math.pi * float(np.sum(weight * wave / (u * u + 0.25))) * end / 2


def priced(rows: DataFrame) -> DataFrame:
    """Adds ``call`` and ``straddle`` to rows of forward, strike, v0, kappa, theta, xi, rho, weights (array) and dt, the length of each piece in years."""
    columns = rows.columns
    schema = StructType([*rows.schema.fields, StructField("call", DoubleType()), StructField("straddle", DoubleType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [call(r.forward, r.strike, [(float(w), r.dt) for w in r.weights], r.v0, r.kappa, r.theta, r.xi, r.rho) for r in pdf.itertuples()]
            pdf["call"] = pd.Series(found, dtype=float)
            pdf["straddle"] = 2 * pdf["call"] - pdf["forward"] + pdf["strike"]
            yield pdf[[*columns, "call", "straddle"]]

    return rows.mapInPandas(work, schema)
