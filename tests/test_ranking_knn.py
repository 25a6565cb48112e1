"""Partitioned ranks, quantiles and neighbours against brute force."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricwatch.operators import knn
from metricwatch.operators.knn import Boxes, Tree, nearest_neighbours
from metricwatch.operators.ranking import dense_ranks, quantiles, running_totals, value_counts
from metricwatch.operators.stats import correlation, describe


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    # A third of all rows share one value; the rest is heavy-tailed, with negatives.
    rows = [("a", 7.5)] * 200 + [("a", rng.lognormvariate(0, 4) - 1) for _ in range(300)]
    rows += [("b", float(rng.randrange(40))) for _ in range(100)] + [("b", None), ("b", None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", [None, 1, 20])
def test_dense_ranks(spark, values, partitions):
    df = spark.createDataFrame(values, "g string, v double")
    got = {(r.g, r.v): r.rank for r in dense_ranks(df, ["g"], "v", "rank", partitions).collect()}
    by = defaultdict(set)
    for g, v in values:
        by[g].add(float("-inf") if v is None else v)
    want = {
        (g, None if v == float("-inf") else v): i
        for g, vs in by.items() for i, v in enumerate(sorted(vs, reverse=True), 1)
    }
    assert got == want


@pytest.mark.parametrize("partitions", [None, 1, 20])
def test_running_totals(spark, values, partitions):
    df = spark.createDataFrame(values, "g string, v double").withColumn("n", F.lit(1))
    got = {(r.g, r.v): (r.n, r.n_before) for r in running_totals(df, ["g"], "v", ["n"], partitions).collect()}
    for (g, v), (n, before) in got.items():
        same = [w for h, w in values if h == g and w is not None]
        assert n == same.count(v) and before == sum(w < v for w in same)
    assert len(got) == len({(g, v) for g, v in values if v is not None})


@pytest.mark.parametrize("partitions", [None, 1, 20])
def test_quantiles(spark, values, partitions):
    df = spark.createDataFrame(values, "g string, v double")
    probabilities = {"q1": 0.25, "q2": 0.5, "q9": 0.9}
    got = {(r.g, r.stat): r.value for r in quantiles(value_counts(df, ["g"], "v", partitions), ["g"], "v", probabilities).collect()}
    for g in ("a", "b"):
        column = [v for h, v in values if h == g and v is not None]
        for stat, p in probabilities.items():
            assert got[g, stat] == pytest.approx(np.quantile(column, p))


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_odd_values_rank_exactly(spark, partitions):
    inf, nan = float("inf"), float("nan")
    rows = [(f"g{i % 40}", v) for i in range(80) for v in (None, nan, inf, -inf, 0.0, float(i))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = defaultdict(list)
    for r in dense_ranks(df, ["g"], "v", "rank", partitions).collect():
        got[r.g].append((r.rank, str(r.v)))
    for i in range(40):
        values = [nan, inf, *sorted({0.0, float(i), float(i + 40)}, reverse=True), -inf, None]
        assert sorted(got[f"g{i}"]) == [(k, str(v)) for k, v in enumerate(values, 1)]
    counted = {(r.g, str(r.v)): (r.n, r.n_before) for r in value_counts(df, ["g"], "v", partitions).collect()}
    assert counted["g5", "nan"] == (2, 8) and counted["g5", "-inf"] == (2, 0)
    big = spark.createDataFrame([("a", 2**53), ("a", 2**53 + 1)], "g string, v long")
    assert sorted((r.v, r.rank) for r in dense_ranks(big, ["g"], "v", "rank", partitions).collect()) == [(2**53, 2), (2**53 + 1, 1)]


def test_no_training_rows(spark):
    test = spark.createDataFrame([("q", [1.0, 2.0])], "id string, x array<double>")
    train = spark.createDataFrame([], "id string, x array<double>, label double")
    assert nearest_neighbours(test, train, 3).count() == 0


def test_describe_and_correlation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    rows = [(float(a), float(2 * a + b), 1) for a, b in zip(x, rng.normal(size=50))]
    df = spark.createDataFrame(rows, "x double, y double, k int")
    got = {(r.column, r.stat): r.value for r in describe(df).collect()}
    assert got["x", "std"] == pytest.approx(np.std(x, ddof=1)) and got["x", "75%"] == pytest.approx(np.quantile(x, 0.75))
    r = {(c.x, c.y): c.r for c in correlation(df).collect()}
    assert r["x", "y"] == pytest.approx(np.corrcoef(x, [b for _, b, _ in rows])[0, 1])
    assert r["x", "k"] is None


@pytest.mark.parametrize("block_rows", [10**6, 15])
def test_nearest_neighbours(spark, block_rows):
    rng = np.random.default_rng(5)
    # A third of the training rows are copies of one point.
    train = [np.array([4.0, 1.0])] * 40 + list(rng.normal(scale=[10, 1], size=(80, 2)))
    test = list(rng.normal(scale=[14, 1], size=(40, 2))) + [np.array([500.0, 0.0]), np.array([4.0, 1.0])]
    k = 5
    train_df = spark.createDataFrame(
        [(f"t{i:03d}", [float(v) for v in x], float(i % 2)) for i, x in enumerate(train)],
        "id string, x array<double>, label double",
    )
    test_df = spark.createDataFrame(
        [(f"q{i:03d}", [float(v) for v in x]) for i, x in enumerate(test)], "id string, x array<double>"
    )
    got = defaultdict(list)
    for r in nearest_neighbours(test_df, train_df, k, block_rows).collect():
        got[r.id].append((r.d, r.n_id))
    for i, q in enumerate(test):
        want = sorted((float(((q - x) ** 2).sum()), f"t{j:03d}") for j, x in enumerate(train))[:k]
        assert [n for _, n in sorted(got[f"q{i:03d}"])] == [n for _, n in want]


def test_tree_leaves_and_boxes():
    rng = np.random.default_rng(7)
    x = np.concatenate([np.full((100, 5), 1.0), rng.normal(size=(200, 5)) * [1, 9, 2, 5, 1]])
    tree = Tree.of(x[::3], 16)
    leaf = tree.leaf(x)
    assert len(tree.axes) == 15 and leaf.min() >= 0 and leaf.max() < 16 and len(set(tree.axes)) > 1
    held = np.unique(leaf)
    boxes = Boxes(held, np.array([x[leaf == i].min(axis=0) for i in held]), np.array([x[leaf == i].max(axis=0) for i in held]))
    asked = rng.normal(size=(30, 5)) * 6
    nearest = np.sqrt(((asked[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    bounds = boxes.distances(asked)
    for j, i in enumerate(held):
        assert (bounds[:, j] <= nearest[:, leaf == i].min(axis=1) + 1e-9).all()
    reach = nearest.min(axis=1) + 1e-9
    for found, row in zip(boxes.within(asked, reach), nearest):
        assert leaf[row.argmin()] in found and len(found) < len(held)
    assert len(Tree.of(np.ones((9, 2)), 4).axes) == 3 and set(Tree.of(np.ones((9, 2)), 4).leaf(np.ones((3, 2)))) == {0}
    assert list(Tree.of(x, 1).leaf(x[:2])) == [0, 0]


def test_a_block_of_neighbours_takes_little_memory():
    rng, n = np.random.default_rng(1), 2000
    trains = pd.DataFrame({"n_id": [f"t{i:05d}" for i in range(n)], "n_x": list(rng.normal(size=(n, 25))), "n_label": 0.0})
    tests = pd.DataFrame({"id": [f"q{i}" for i in range(n)], "x": list(rng.normal(size=(n, 25)))})
    tracemalloc.start()
    try:
        found = knn._nearest(5)(tests, trains)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 5 * n and peak < 25e6


@pytest.mark.parametrize("block_rows", [10**6, 15])
def test_rows_of_ones_own_group_are_no_neighbours(spark, block_rows):
    rng = np.random.default_rng(3)
    points = [[float(v) for v in x] for x in rng.integers(0, 6, (90, 3))]  # many ties
    rows = [(f"r{i:03d}", x, float(i % 2), i % 4) for i, x in enumerate(points)]
    train = spark.createDataFrame(rows, "id string, x array<double>, label double, own int")
    test = spark.createDataFrame([(i, x, g) for i, x, _, g in rows] + [("q", [1.0, 2.0, 9.0], 4)], "id string, x array<double>, own int")
    got = defaultdict(list)
    for r in nearest_neighbours(test, train, 5, block_rows).collect():
        got[r.id].append((r.d, r.n_id))
    for r in test.collect():
        want = sorted((sum((a - b) ** 2 for a, b in zip(r.x, x)), i) for i, x, _, own in rows if own != r.own)[:5]
        assert sorted(got[r.id]) == want


def test_far_pairs_are_left_out_by_a_matrix_product_and_odd_rows_stay_exact(monkeypatch):
    rng, measured, distances = np.random.default_rng(6), [], knn._distances
    monkeypatch.setattr(knn, "_distances", lambda x, q, row, col: measured.append(len(row)) or distances(x, q, row, col))
    plain = rng.normal(size=(600, 8)) * [1e5, 1, 1, 1, 1, 1, 1, 1e-4] + 1e3
    inf = plain.copy()
    inf[3, 1], inf[4] = np.inf, 1e200
    for x, q in ((plain, plain[:200] + 0.1), (inf, inf[:20]), (np.repeat(plain[:4], 20, axis=0), plain[:9]), (plain[:3], plain[:9])):
        measured.clear()
        ids = np.array([f"t{i:04d}" for i in range(len(x))])
        found = knn._found(x, q, ids, np.zeros(len(x)), np.arange(len(q)), 5)
        with np.errstate(invalid="ignore", over="ignore"):
            d = ((x[None, :, :] - q[:, None, :]) ** 2).sum(axis=2)
        for i, mine in found.groupby("id"):
            order = np.argsort(d[i], kind="stable")[:5]
            assert list(mine["n_id"]) == list(ids[order]) and list(mine["d"]) == list(d[i][order])
        if x is plain:
            assert sum(measured) < 0.05 * len(x) * len(q)
