"""Kernel features against the kernel itself, pair by pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricwatch.operators import kernel


def table(spark, x):
    return spark.createDataFrame([(f"r{i:04d}", [float(v) for v in row]) for i, row in enumerate(x)], "id string, x array<double>")


def exact(x, gamma):
    return np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    # Two clouds, and a third of all rows are copies of one point.
    return np.concatenate([np.full((60, 4), 3.0), rng.normal(size=(60, 4)), rng.normal(50, 2, size=(60, 4))])


@pytest.mark.parametrize("most,tolerance", [(5, 1e-9), (40, 1e-9), (500, 1e-2), (500, 1e-10)])
def test_error_is_within_the_residuals(points, most, tolerance):
    basis = kernel.choose(points, 0.1, most, tolerance)
    f, want = basis.features(points), exact(points, 0.1)
    left = np.maximum(1 - (f**2).sum(axis=1), 0)
    assert (np.abs(want - f @ f.T) <= np.sqrt(np.outer(left, left)) + 1e-7).all()
    # Copies are described by the first of them, and no landmark is picked twice.
    assert basis.size <= min(most, 121) and len(np.unique(basis.points, axis=0)) == basis.size
    if most == 500:
        assert left.max() <= tolerance + 1e-7
    assert np.allclose(exact(basis.points, 0.1), basis.features(basis.points) @ basis.features(basis.points).T)


def test_basis_and_residuals_in_spark(spark, points):
    rows = table(spark, points).repartition(5)
    gamma, width, n = kernel.scale(rows)
    assert (width, n) == (4, 180) and gamma == pytest.approx(1 / (4 * points.var()))
    basis = kernel.fit_basis(rows, gamma, 200, 1000, 1e-8)
    again = kernel.fit_basis(rows.repartition(3), gamma, 200, 1000, 1e-8)
    assert np.array_equal(basis.points, again.points)
    got = kernel.residuals(rows, basis).head()
    assert got.n_rows == 180 and got.landmarks == basis.size and got.max_residual <= 2e-8
    assert got.mean_kernel == pytest.approx(exact(points, gamma).mean(), abs=1e-7)
    # Landmarks from a small sample: the error is larger, and is told.
    few = kernel.fit_basis(rows, gamma, 3, 10, 1e-8)
    told = kernel.residuals(rows, few).head()
    mean = exact(points, gamma).mean()
    assert few.size == 3 and mean - told.mean_residual <= told.mean_kernel <= mean + 1e-9 and told.mean_residual > 1e-4


def test_odd_tables(spark):
    same = table(spark, np.full((9, 3), 2.0))
    gamma, _, n = kernel.scale(same)
    basis = kernel.fit_basis(same, gamma, 10, 10, 1e-4)
    assert (gamma, n, basis.size) == (1.0, 9, 1)
    assert kernel.residuals(same, basis).head().mean_kernel == pytest.approx(1.0)
    assert kernel.scale(same.where(F.lit(False))) == (1.0, 0, 0)
