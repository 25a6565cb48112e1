"""Gaussian kernel features on a basis that the data choose (pivoted Cholesky, a Nyström approximation).

Landmarks are picked one by one from a bounded sample of rows: each time the row that the ones
before it describe worst, until all are described within ``tolerance`` or ``most`` are picked.
The inner product of two rows' features is the kernel's value between them, less an error of at
most ``sqrt(r r')``; ``r = 1 - |features|^2`` is known for every row without a pair of rows
(:func:`residuals`).  Landmarks are described exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Basis:
    """``points`` (one landmark per row), and what turns kernel values to them into features."""

    points: np.ndarray
    whiten: np.ndarray
    gamma: float

    @property
    def size(self) -> int:
        return len(self.points)

    def features(self, x: np.ndarray) -> np.ndarray:
        return gaussian(x, self.points, self.gamma) @ self.whiten.T


def gaussian(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """Kernel values between all rows of ``a`` and of the bounded ``b``."""
    out = np.empty((len(a), len(b)))
    for j, point in enumerate(b):
        # Differences first: rows that are far from zero but near each other keep their digits.
        out[:, j] = np.exp(-gamma * ((a - point) ** 2).sum(axis=1))
    return out


def choose(x: np.ndarray, gamma: float, most: int, tolerance: float) -> Basis:
    """Landmarks among the rows of ``x``; ties go to the earlier row."""
    left, parts, picked = np.ones(len(x)), np.zeros((min(most, len(x)), len(x))), []
    for j in range(len(parts)):
        i = int(left.argmax())
        if left[i] <= tolerance:
            break
        parts[j] = (gaussian(x, x[i : i + 1], gamma)[:, 0] - parts[:j].T @ parts[:j, i]) / np.sqrt(left[i])
        left = np.maximum(left - parts[j] ** 2, 0.0)
        left[i] = 0.0
        picked.append(i)
    lower = np.tril(parts[: len(picked), picked].T)
    # The inverse row by row; the general one is not needed for a triangle.
    whiten = np.zeros_like(lower)
    for i in range(len(lower)):
        whiten[i] = -(lower[i, :i] @ whiten[:i])
        whiten[i, i] += 1.0
        whiten[i] /= lower[i, i]
    return Basis(x[picked], whiten, gamma)


def scale(train: DataFrame) -> tuple[float, int, int]:
    """``(gamma, width, rows)``: the kernel's width is 1 / (features x variance over all cells)."""
    # Variance within rows plus variance of row means: no cell is shuffled, and no digits are lost far from zero.
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    moments = train.select(F.size("x").alias("width"), "x", mean.alias("mean")).select(
        "width", "mean", (F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean"))) / F.col("width")).alias("inner")
    )
    row = moments.agg(
        F.count(F.lit(1)).alias("n"), F.max("width").alias("width"), F.avg("inner").alias("inner"), F.var_pop("mean").alias("outer")
    ).head()
    if not row["n"]:
        return 1.0, 0, 0
    cells, variance = row["width"], row["inner"] + row["outer"]
    return (1.0 / (cells * variance) if variance > 0 else 1.0), cells, row["n"]


def fit_basis(train: DataFrame, gamma: float, most: int, candidates: int, tolerance: float) -> Basis:
    """The basis of rows ``(id, x)``, chosen among the ``candidates`` rows with the smallest id hashes."""
    sample = train.select(F.xxhash64("id").alias("place"), "id", "x").orderBy("place", "id", "x").limit(candidates).collect()
    return choose(np.array([r["x"] for r in sample]).reshape(len(sample), -1), gamma, most, tolerance)


def lift(x: Column | str, basis: Basis) -> Column:
    """Features of every row, Arrow-batched."""

    @F.pandas_udf("array<double>")
    def features(rows: pd.Series) -> pd.Series:
        return pd.Series(list(basis.features(np.stack(rows.to_numpy())))) if len(rows) else pd.Series([], dtype=object)

    return features(x)


def residuals(rows: DataFrame, basis: Basis) -> DataFrame:
    """One row: how far the features are from the kernel, over all rows.

    ``mean_kernel`` is the mean of the approximated kernel over all pairs of rows, taken from summed
    features; the kernel's own mean is larger by at most ``mean_residual``.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                f = basis.features(np.stack(batch["x"].to_numpy()))
                left = np.maximum(1 - (f * f).sum(axis=1), 0.0)
                yield pd.DataFrame({"term": range(basis.size), "n": len(f), "total": f.sum(axis=0), "r": left.sum(), "worst": left.max()})

    # One short row per landmark and Arrow batch, so an aggregate has few columns whatever the basis.
    terms = (
        rows.select("x").mapInPandas(sums, "term int, n long, total double, r double, worst double")
        .groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "total", "r")], F.max("worst").alias("worst"))
    )
    mean = F.col("total") / F.col("n")
    return terms.agg(
        F.max("n").alias("n_rows"), F.count(F.lit(1)).cast("int").alias("landmarks"), F.max(F.col("r") / F.col("n")).alias("mean_residual"),
        F.max("worst").alias("max_residual"), F.sum(mean * mean).alias("mean_kernel"),
    )
