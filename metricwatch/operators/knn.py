"""Exact k-nearest-neighbour vote as a partitioned join.

A k-d tree over a bounded sample cuts the training rows into leaves; the distance to a leaf's
box, over all features, is a lower bound of the distance to its rows.  A test row first measures
one block of the nearest leaf, which bounds its k-th distance, then visits exactly the leaves
that can hold anything nearer.  Both sides of a visit are split by size, so copies of one value
cannot overload a task, and a visit passes on k neighbours per row, not pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 5_000
MAX_LEAVES = 4096
SAMPLE_PER_LEAF = 16
CELLS = 1_000_000  # differences held at a time

_NEIGHBOURS = "id string, d double, n_id string, n_label double"


def _candidates(x: np.ndarray, q: np.ndarray, wanted: int):
    """Steps ``(at, row, col)``: for every row ``at + row`` of ``q`` all rows of ``x`` that its ``wanted`` nearest can be among.

    Distances come from one matrix product, at first; a row is left out where that is beyond the ``wanted``-th
    by more than both can be wrong.
    """
    step = max(1, CELLS // (2 * len(x)))
    if wanted == len(x) or not np.isfinite(x).all():
        for at in range(0, len(q), step):
            yield at, *np.divmod(np.arange(len(q[at : at + step]) * len(x)), len(x))
        return
    with np.errstate(over="ignore", invalid="ignore"):
        # Around the middle of the rows less is lost by cancelling.
        middle = x.mean(axis=0)
        x, q = x - middle, q - middle
        x_size, q_size = (x * x).sum(axis=1), (q * q).sum(axis=1)
        # Some units in the last place of the largest term for each summand.
        slack = 16 * (x.shape[1] + 4) * np.finfo(float).eps
        for at in range(0, len(q), step):
            near = q[at : at + step] @ x.T
            near *= -2
            near += x_size
            reach = np.partition(near, wanted - 1, axis=1)[:, wanted - 1] + slack * (x_size.max() + q_size[at : at + step])
            # Not above: whatever is not a number stays in.
            yield at, *np.nonzero(~(near > reach[:, None]))


def _distances(x: np.ndarray, q: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, some at a time."""
    step = max(1, CELLS // x.shape[1])
    parts = [((x[col[a : a + step]] - q[row[a : a + step]]) ** 2).sum(axis=1) for a in range(0, len(row), step)]
    return np.concatenate(parts)


def _nearest(k: int):
    """Pandas join of one block of test rows with one block of training rows."""

    def nearest(tests: pd.DataFrame, trains: pd.DataFrame) -> pd.DataFrame:
        if tests.empty or trains.empty:
            return pd.DataFrame({"id": [], "d": [], "n_id": [], "n_label": []})
        trains = trains.sort_values("n_id", kind="stable")
        x, q = np.stack(trains["n_x"].to_numpy()), np.stack(tests["x"].to_numpy())
        ids, labels, asked = trains["n_id"].to_numpy(), trains["n_label"].to_numpy(), tests["id"].to_numpy()
        if "own" not in tests:
            return _found(x, q, ids, labels, asked, k)
        own, out = trains["n_own"].to_numpy(), []
        for group in np.unique(tests["own"]):
            others, here = own != group, tests["own"].to_numpy() == group
            if others.any():
                out.append(_found(x[others], q[here], ids[others], labels[others], asked[here], k))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "d": [], "n_id": [], "n_label": []})

    return nearest


def _found(x: np.ndarray, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, asked: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of ``x`` for every row of ``q``."""
    wanted = min(k, len(x))
    out = []
    for at, row, col in _candidates(x, q, wanted):
        d = _distances(x, q, at + row, col)
        # Rows at equal distances compete in id order.
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < wanted
        # A row whose k-th distance is not a number has no neighbours.
        lost = row[kept][np.isnan(d[kept])]
        kept &= ~np.isin(row, lost)
        row, col = row[kept], col[kept]
        out.append((asked[at + row], d[kept], ids[col], labels[col]))
    return pd.DataFrame(dict(zip(("id", "d", "n_id", "n_label"), map(np.concatenate, zip(*out)))))


def _visit(tests: DataFrame, train: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Run test rows, already assigned to ``(slice, part)`` blocks, against those blocks.

    A block visited by many test rows is copied to several groups, one per ``block_rows``
    visitors, so the rows moved stay proportional to the visits.
    """
    visits = tests.groupBy("slice", "part").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("chunks"))
    own = [c for c in tests.columns if c == "own"]
    placed = tests.join(visits, ["slice", "part"]).select(
        "id", "x", *own, "slice", "part", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk")
    )
    # New names throughout: both sides may come from the same frame.
    copies = train.join(visits, ["slice", "part"]).select(
        F.col("id").alias("n_id"),
        F.col("x").alias("n_x"),
        F.col("label").alias("n_label"),
        *[F.col(c).alias(f"n_{c}") for c in own],
        F.col("slice").alias("n_slice"),
        F.col("part").alias("n_part"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("n_chunk"),
    )
    return (
        placed.groupBy("slice", "part", "chunk")
        .cogroup(copies.groupBy("n_slice", "n_part", "n_chunk"))
        .applyInPandas(_nearest(k), _NEIGHBOURS)
    )


@dataclass(frozen=True)
class Tree:
    """Axes and cuts of the inner nodes in heap order; rows above a node's cut go to its second child."""

    axes: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, leaves: int) -> Tree:
        """A tree of at least ``leaves`` leaves: every node halves its rows along their widest feature."""
        inner = (1 << max(leaves - 1, 0).bit_length()) - 1
        axes, cuts, rows = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), {0: sample}
        for node in range(inner):
            here = rows.pop(node, sample[:0])
            spread = here.var(axis=0) if len(here) else np.zeros(sample.shape[1])
            if spread.max(initial=0.0) > 0:
                axis = int(spread.argmax())
                values = np.sort(here[:, axis])
                # Below the largest value, so that neither side is empty however many copies there are.
                cut = min(values[(len(values) - 1) // 2], values[values < values[-1]][-1])
                axes[node], cuts[node] = axis, cut
                above = here[:, axis] > cut
                rows[2 * node + 1], rows[2 * node + 2] = here[~above], here[above]
        return cls(axes, cuts)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range((len(self.axes) + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axes[node]] > self.cuts[node])
        return node - len(self.axes)


@dataclass(frozen=True)
class Boxes:
    """Leaves that hold rows, and the least and largest value of every feature in each."""

    leaves: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distance of every row to every box."""
        out = np.zeros((len(x), len(self.leaves)))
        for j in range(x.shape[1]):
            gap = np.maximum(self.low[:, j] - x[:, j, None], x[:, j, None] - self.high[:, j])
            out += np.maximum(gap, 0.0) ** 2
        return np.sqrt(out)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        step = max(1, CELLS // len(self.leaves))
        return np.concatenate([self.leaves[self.distances(x[a : a + step]).argmin(axis=1)] for a in range(0, len(x), step)])

    def within(self, x: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        step, out = max(1, CELLS // len(self.leaves)), []
        for a in range(0, len(x), step):
            near = self.distances(x[a : a + step]) <= reach[a : a + step, None]
            out += [self.leaves[row] for row in near]
        return out


def nearest_neighbours(
    test: DataFrame, train: DataFrame, k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The k nearest training rows of each test row: ``(id, d, n_id, n_label)``.

    ``test`` has ``(id string, x array<double>)``, ``train`` also ``label``; ``d`` is the
    squared distance, ties go to the smaller id.  Where both have ``own int``, rows that
    agree in it are no neighbours.
    """
    spark = test.sparkSession
    own = ["own"] if "own" in test.columns and "own" in train.columns else []
    test, train = test.select("id", "x", *own), train.select("id", "x", "label", *own)
    n = train.count()
    if not n:
        return spark.createDataFrame([], _NEIGHBOURS)
    if n < block_rows:
        # All training rows fit one block: a single visit is the answer.
        only = test.select("*", F.lit(0).alias("slice"), F.lit(0).alias("part"))
        return _visit(only, train.withColumn("slice", F.lit(0)).withColumn("part", F.lit(0)), k, block_rows)
    leaves = min(MAX_LEAVES, n // block_rows + 1)
    sample = train.select(F.xxhash64("id").alias("place"), "id", "x").orderBy("place", "id").limit(SAMPLE_PER_LEAF * leaves).collect()
    tree = Tree.of(np.array([r["x"] for r in sample]), leaves)

    @F.pandas_udf("int")
    def leaf_of(x: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype="int32")

    train = train.withColumn("slice", leaf_of("x"))
    # One row per leaf, at most twice MAX_LEAVES: collected so that every step prunes alike.
    width = len(sample[0]["x"])
    ends = [f(F.get("x", F.lit(j))).alias(f"{name}{j}") for j in range(width) for name, f in (("lo", F.min), ("hi", F.max))]
    found = train.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("slice").collect()
    boxes = Boxes(
        np.array([r["slice"] for r in found]),
        np.array([[r[f"lo{j}"] for j in range(width)] for r in found]),
        np.array([[r[f"hi{j}"] for j in range(width)] for r in found]),
    )
    parts = spark.createDataFrame([(r["slice"], r["n"] // block_rows + 1) for r in found], "slice int, parts int")
    train = train.join(parts, "slice").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    # First visit: any k training rows bound the k-th distance from above.
    @F.pandas_udf("int")
    def nearest_leaf(x: pd.Series) -> pd.Series:
        return pd.Series(boxes.nearest(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype="int32")

    first = _visit(
        test.select("*", nearest_leaf("x").alias("slice"), F.lit(0).alias("part")), train, k, block_rows
    )
    reach = first.groupBy("id").agg(
        F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d")) * (1 + 1e-9) + 1e-12).otherwise(F.lit(float("inf"))).alias("reach")
    )

    # Second visit: every leaf whose box the reach touches, the first included.
    @F.pandas_udf("array<int>")
    def leaves_within(x: pd.Series, reach: pd.Series) -> pd.Series:
        return pd.Series(boxes.within(np.stack(x.to_numpy()), reach.to_numpy()) if len(x) else [], dtype=object)

    todo = (
        test.join(reach, "id", "left")
        .withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        .select("id", "x", *own, F.explode(leaves_within("x", "reach")).alias("slice"))
        .join(parts, "slice")
        .select("id", "x", *own, "slice", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    )
    best = Window.partitionBy("id").orderBy("d", "n_id")
    return (
        _visit(todo, train, k, block_rows)
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= k)
        .drop("_rank")
    )


def knn_scores(test: DataFrame, train: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id, score, prediction)``: share of positive neighbours and the majority label."""
    return (
        nearest_neighbours(test, train, k, block_rows)
        .groupBy("id")
        .agg(F.avg("n_label").alias("score"))
        .withColumn("prediction", F.when(F.col("score") > 0.5, 1.0).otherwise(0.0))
    )
