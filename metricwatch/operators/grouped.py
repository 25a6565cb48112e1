"""Classifiers fitted for all folds at once.

Group g below the number of folds trains on the training rows of the other folds, the last group on
all of them.  A pass over the rows adds up what every group needs, so the number of jobs does
not depend on the number of folds; only sums of a fixed size leave the tasks.  A group whose
training rows have one class has no model: it predicts that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.sources.lineage import cut_lineage

# Training rows in one partition.
ROWS_PER_PARTITION = 10_000
# Blocks whose sums the driver adds up itself.
BLOCKS_COLLECTED = 16


def members(fold: np.ndarray, groups: int) -> np.ndarray:
    """(groups, rows): which rows train which group."""
    return fold[None, :] != np.arange(groups)[:, None]


def class_counts(train: DataFrame, groups: int) -> np.ndarray:
    """(groups, 2): training rows of each label."""
    counts = np.zeros((groups, 2), np.int64)
    for r in train.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[np.arange(groups) != r["fold"], int(r["label"])] += r["n"]
    return counts


@dataclass
class GroupedModel:
    """``margins(x, group)`` are the rows' log-odds of label 1; ``only`` the groups' sole label, or -1."""

    margins: object
    only: list[int]
    detail: object = None

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` of ``(x, group)`` with ``score`` and ``prediction``.  A sole label scores 1 or -1 throughout."""
        margins, only = self.margins, np.array(self.only)

        @F.pandas_udf("double")
        def score(x: pd.Series, group: pd.Series) -> pd.Series:
            g = group.to_numpy(int)
            found = margins(np.stack(x.to_numpy()), g) if len(g) else np.zeros(0)
            return pd.Series(np.where(only[g] >= 0, 2.0 * only[g] - 1.0, found))

        return rows.withColumn("score", score("x", "group")).withColumn("prediction", (F.col("score") > 0).cast("double"))


def _sole_labels(counts: np.ndarray) -> list[int]:
    return [int(n[1] > 0) if min(n) == 0 else -1 for n in counts]


# ---- naive Bayes -----------------------------------------------------------


def _merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and variance of parts put together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[0] * (p[2] + (p[1] - mean) ** 2) for p in parts) / n


def naive_bayes(train: DataFrame, groups: int, width: int, raised: float = 1e-9) -> GroupedModel:
    """Gaussian naive Bayes from one aggregate; variances are raised by ``raised`` times a feature's largest."""
    cells = [F.get("x", F.lit(i)) for i in range(width)]
    sums = train.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n"), F.array(*map(F.avg, cells)).alias("mean"), F.array(*map(F.var_pop, cells)).alias("var")
    ).collect()
    counts = np.zeros((groups, 2), np.int64)
    means, variances = np.zeros((groups, 2, width)), np.ones((groups, 2, width))
    for g in range(groups):
        here = [(int(r["label"]), (r["n"], np.array(r["mean"]), np.array(r["var"]))) for r in sums if r["fold"] != g]
        floor = raised * _merged([p for _, p in here])[2].max() if here else 0.0
        for label in (0, 1):
            if parts := [p for c, p in here if c == label]:
                counts[g, label], means[g, label], spread = _merged(parts)
                variances[g, label] = np.maximum(spread + floor, 1e-300)
    logs = np.log(np.maximum(counts, 1))

    def margins(x: np.ndarray, group: np.ndarray) -> np.ndarray:
        v, d = variances[group], x[:, None, :] - means[group]
        each = logs[group] - 0.5 * np.sum(np.log(2 * np.pi * v) + d * d / v, axis=2)
        # Rows with equal features score alike in any order of the sums.
        return np.round(each[:, 1] - each[:, 0], 6)

    return GroupedModel(margins, _sole_labels(counts))


# ---- logistic regression ---------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def _newton_sums(beta: np.ndarray):
    """Task function: loss, gradient and cross-products of every group at its coefficients."""
    groups, width = beta.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((groups, 1 + width + width * width))
        for batch in batches:
            x = np.column_stack([np.stack(batch["x"].to_numpy()), np.ones(len(batch))])
            y, trains = batch["label"].to_numpy(), members(batch["fold"].to_numpy(), groups)
            z = beta @ x.T
            p = _sigmoid(z)
            total[:, 0] += np.sum(trains * (np.logaddexp(0.0, z) - y * z), axis=1)
            total[:, 1 : 1 + width] += (trains * (p - y)) @ x
            for g in range(groups):
                total[g, 1 + width :] += ((x.T * (trains[g] * p[g] * (1 - p[g]))) @ x).ravel()
        yield pd.DataFrame({"group": np.arange(groups), "sums": list(total)})

    return run


def logistic(train: DataFrame, groups: int, width: int, penalty: float = 1.0, rounds: int = 100) -> GroupedModel:
    """Logistic regression with ``penalty`` / 2 on the squared coefficients, the intercept left out, by Newton steps.

    Each step is one pass for all groups.  A step that does not lower a group's loss is halved.
    ``detail`` are the coefficients, the intercept last, NaN for a group with one class.
    """
    only = _sole_labels(class_counts(train, groups))
    beta = np.zeros((groups, width + 1))
    ridge = np.append(np.full(width, penalty), 0.0)
    todo = np.array(only) < 0
    step, best = np.zeros_like(beta), np.full(groups, np.inf)
    for _ in range(rounds):
        if not todo.any():
            break
        partial = train.select("x", "label", "fold").mapInPandas(_newton_sums(beta), "group int, sums array<double>")
        total = partial.select("group", F.posexplode("sums").alias("place", "v")).groupBy("group", "place").agg(F.sum("v").alias("v")).toArrow()
        sums = np.zeros((groups, 1 + (width + 1) * (width + 2)))
        sums[total["group"].to_numpy(), total["place"].to_numpy()] = total["v"].to_numpy()
        for g in np.nonzero(todo)[0]:
            loss = sums[g, 0] + 0.5 * ridge @ beta[g] ** 2
            if loss > best[g] + 1e-9 * abs(best[g]):
                step[g] /= 2
                beta[g] -= step[g]
                continue
            best[g] = min(loss, best[g])
            gradient = sums[g, 1 : width + 2] + ridge * beta[g]
            cross = sums[g, width + 2 :].reshape(width + 1, -1) + np.diag(ridge)
            # Features differ in size by many orders: the system is solved in units of its diagonal.
            unit = 1 / np.sqrt(np.maximum(np.diag(cross), 1e-300))
            move = -unit * np.linalg.lstsq(cross * unit[:, None] * unit, unit * gradient, rcond=None)[0]
            if -gradient @ move <= 1e-16 * (1 + abs(loss)):
                todo[g] = False
            else:
                step[g] = move
                beta[g] += move

    def margins(x: np.ndarray, group: np.ndarray) -> np.ndarray:
        return np.sum(x * beta[group, :-1], axis=1) + beta[group, -1]

    return GroupedModel(margins, only, np.where(np.array(only)[:, None] < 0, beta, np.nan))


def logistic_gradients(train: DataFrame, coefficients: np.ndarray, penalty: float = 1.0) -> DataFrame:
    """``(group, term, slope, size)`` of the penalised loss at ``coefficients``, from the rows by plain expressions.

    ``size`` is the sum of the absolute parts of the slope.  Groups without a model give no rows.
    """
    spark, width = train.sparkSession, coefficients.shape[1] - 1
    fitted = spark.createDataFrame(
        [(g, c.tolist()) for g, c in enumerate(coefficients) if not np.isnan(c).any()], "group int, beta array<double>"
    )
    x = F.concat("x", F.array(F.lit(1.0)))
    z = F.aggregate(F.zip_with("xs", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = train.withColumn("xs", x).join(F.broadcast(fitted), F.col("fold") != F.col("group")).withColumn(
        "error", F.lit(1.0) / (1 + F.exp(-z)) - F.col("label")
    )
    sums = rows.select("group", "beta", "error", F.posexplode("xs").alias("term", "v")).groupBy("group", "term").agg(
        F.sum(F.col("v") * F.col("error")).alias("pull"), F.sum(F.abs(F.col("v"))).alias("weight"), F.first(F.get("beta", F.col("term"))).alias("beta")
    )
    held = F.when(F.col("term") < width, F.lit(penalty) * F.col("beta")).otherwise(F.lit(0.0))
    return sums.select("group", "term", (F.col("pull") + held).alias("slope"), (F.col("weight") + F.abs(held)).alias("size"))


# ---- boosted trees ---------------------------------------------------------


@dataclass(frozen=True)
class Boosting:
    """Second-order boosting of the logistic loss over binned features."""

    rounds: int = 100
    depth: int = 6
    step: float = 0.3
    bins: int = 64
    leaf_penalty: float = 1.0
    least_curvature: float = 1.0  # of either side of a split
    pending: int = 5  # rounds after which the rows' margins are written


@dataclass
class _Trees:
    """One tree per group as heaps: node i has the children 2 i + 1 and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def stumps(groups: int, depth: int) -> _Trees:
        size = 2 ** (depth + 1) - 1
        return _Trees(np.full((groups, size), -1), np.zeros((groups, size), np.int64), np.zeros((groups, size)))

    def nodes(self, bins: np.ndarray, group: int, depth: int) -> np.ndarray:
        """The node that each row of ``bins`` reaches within ``depth`` steps."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[group, node]
            right = bins[rows, np.maximum(f, 0)] > self.cut[group, node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        return node

    def values(self, bins: np.ndarray, group: int, depth: int) -> np.ndarray:
        return self.value[group, self.nodes(bins, group, depth)]


def bin_numbers(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Per feature the number of cuts below the value; a value equal to a cut lies below it."""
    return np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.uint8)


def _binned(cuts: list[np.ndarray]):
    """Task function: a partition's rows as one block of packed columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["label"].to_numpy(np.float64), b["fold"].to_numpy(np.int32), bin_numbers(np.stack(b["x"].to_numpy()), cuts)) for b in batches if len(b)]
        if parts:
            yield pd.DataFrame({name: [np.concatenate(c).tobytes()] for name, c in zip(("label", "fold", "bins"), zip(*parts))})

    return run


# A block of rows: label, fold, bins (rows, features) and margins (rows, groups).
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _unpacked(start: np.ndarray):
    """Task function: a packed block with the margins that all rows start from."""

    def run(row) -> Block:
        label, fold = np.frombuffer(row["label"], np.float64), np.frombuffer(row["fold"], np.int32)
        return label, fold, np.frombuffer(row["bins"], np.uint8).reshape(len(label), -1), np.tile(start, (len(label), 1))

    return run


def _advanced(tree: _Trees, groups: int, depth: int):
    """Task function: a block with its margins after ``tree``."""

    def run(block: Block) -> Block:
        label, fold, bins, margins = block
        return label, fold, bins, margins + np.column_stack([tree.values(bins, g, depth) for g in range(groups)])

    return run


def _level_sums(growing: _Trees, level: int, groups: int, n_bins: int):
    """Task function: the (group, node of the level, feature, bin) cells with rows, numbered in this order, and their gradient and curvature."""

    def run(block: Block) -> tuple[np.ndarray, np.ndarray]:
        label, fold, bins, margins = block
        trains, width = members(fold, groups), bins.shape[1]
        per_group = 2**level * width * n_bins
        cell = np.arange(width) * n_bins + bins
        found = []
        for g in range(groups):
            node = growing.nodes(bins, g, level) - (2**level - 1)
            use = trains[g] & (node >= 0)
            p = _sigmoid(margins[use, g])
            at = (node[use, None] * width * n_bins + cell[use]).ravel()
            sums = np.stack([np.bincount(at, np.repeat(weight, width), per_group) for weight in (p - label[use], p * (1 - p))])
            used = np.nonzero(sums[1])[0]
            found.append((used + g * per_group, sums[:, used]))
        return np.concatenate([at for at, _ in found]), np.concatenate([sums for _, sums in found], axis=1)

    return run


def _totals(blocks: RDD, sums_of, size: int) -> np.ndarray:
    """(2, ``size``): the blocks' cells added up.  Of many blocks, tasks add up slices first, so that what reaches the driver does not grow with them."""
    parts, total = blocks.getNumPartitions(), np.zeros((2, size))
    if parts <= BLOCKS_COLLECTED:
        found = blocks.map(sums_of).collect()
    else:
        slices = min(BLOCKS_COLLECTED, size)
        ends = [size * s // slices for s in range(slices + 1)]

        def cut(block: Block):
            at, sums = sums_of(block)
            places = np.searchsorted(at, ends)
            for s, (a, b) in enumerate(zip(places, places[1:])):
                if b > a:
                    yield s, (at[a:b], sums[:, a:b])

        def added(a, b):
            at, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
            sums = np.zeros((2, len(at)))
            sums[:, place[: len(a[0])]] += a[1]
            sums[:, place[len(a[0]) :]] += b[1]
            return at, sums

        found = blocks.flatMap(cut).reduceByKey(added, slices).values().collect()
    for at, sums in found:
        total[:, at] += sums
    return total


def _split(growing: _Trees, level: int, sums: np.ndarray, cfg: Boosting, gains: np.ndarray, uses: np.ndarray) -> bool:
    """Split the level's nodes where it pays; ``sums`` are (2, groups, nodes, features, bins).  Whether any was split."""
    g, h = np.cumsum(sums, axis=4)
    whole_g, whole_h = g[:, :, :1, -1:], h[:, :, :1, -1:]
    strength = lambda a, b: a * a / (b + cfg.leaf_penalty)
    gain = strength(g, h) + strength(whole_g - g, whole_h - h) - strength(whole_g, whole_h)
    gain[(h < cfg.least_curvature) | (whole_h - h < cfg.least_curvature)] = -np.inf
    first, any_split = 2**level - 1, False
    for group, node in zip(*np.nonzero(whole_h[:, :, 0, 0] > 0)):
        f, cut = np.unravel_index(np.argmax(gain[group, node]), gain.shape[2:])
        i = first + node
        left, total = (g[group, node, f, cut], h[group, node, f, cut]), (whole_g[group, node, 0, 0], whole_h[group, node, 0, 0])
        leaf = lambda a, b: -cfg.step * a / (b + cfg.leaf_penalty)
        growing.value[group, i] = leaf(*total)
        if gain[group, node, f, cut] > 1e-6:
            any_split = True
            growing.feature[group, i], growing.cut[group, i] = f, cut
            growing.value[group, 2 * i + 1] = leaf(*left)
            growing.value[group, 2 * i + 2] = leaf(total[0] - left[0], total[1] - left[1])
            if group == len(gain) - 1:
                gains[f] += gain[group, node, f, cut]
                uses[f] += 1
    return any_split


@dataclass
class BoostedTrees:
    cuts: list[np.ndarray]
    start: np.ndarray
    trees: list[_Trees] = field(default_factory=list)
    importances: np.ndarray | None = None  # mean gain of a split by feature, of the last group, as shares


def feature_cuts(train: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 values of each feature that part its training rows evenly, within a quarter of a bin."""
    columns = [f"x{i}" for i in range(width)]
    wide = train.select(*[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    shares = [i / bins for i in range(1, bins)]
    found = wide.approxQuantile(columns, shares, 0.25 / bins)
    return [np.unique(np.array(values, np.float64)) for values in found]


def boosted_trees(train: DataFrame, groups: int, width: int, cfg: Boosting = Boosting()) -> GroupedModel:
    """Boosted trees of all groups: one aggregate per level and round, whatever the number of groups.

    Leaf weights are -gradient / (curvature + penalty).  Passes are many and short, so each is one job over blocks of
    binned rows, without a plan of its own.  The first pass of a round moves the blocks' margins on; every ``cfg.pending``
    rounds the blocks are written, so a lost executor costs no more than these.
    """
    counts = class_counts(train, groups)
    only = _sole_labels(counts)
    share = np.clip(counts[:, 1] / np.maximum(counts.sum(axis=1), 1), 1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    cuts = feature_cuts(train, width, cfg.bins)
    fitted = BoostedTrees(cuts, start)
    gains, uses = np.zeros(width), np.zeros(width)
    # Few, even partitions.
    parts = -(-int(counts[-1].sum()) // ROWS_PER_PARTITION)
    spread = train.select("x", "label", "fold")
    spread = spread.repartition(parts) if parts > 1 else spread.coalesce(1)
    packed = cut_lineage(spread.mapInPandas(_binned(cuts), "label binary, fold binary, bins binary"))
    blocks = packed.rdd.map(_unpacked(start)).persist(StorageLevel.MEMORY_AND_DISK)
    done = None
    for round_ in range(cfg.rounds):
        growing = _Trees.stumps(groups, cfg.depth)
        for level in range(cfg.depth):
            sums = _totals(blocks, _level_sums(growing, level, groups, cfg.bins), groups * 2**level * width * cfg.bins)
            if done is not None:
                done.unpersist()
                done = None
            if not _split(growing, level, sums.reshape(2, groups, 2**level, width, cfg.bins), cfg, gains, uses):
                break
        fitted.trees.append(growing)
        if round_ + 1 < cfg.rounds:
            done, blocks = blocks, blocks.map(_advanced(growing, groups, cfg.depth)).persist(StorageLevel.MEMORY_AND_DISK)
            if (round_ + 1) % cfg.pending == 0:
                blocks.checkpoint()
    blocks.unpersist()
    mean = np.divide(gains, uses, out=np.zeros(width), where=uses > 0)
    fitted.importances = mean / mean.sum() if mean.sum() > 0 else mean
    depth = cfg.depth

    def margins(x: np.ndarray, group: np.ndarray) -> np.ndarray:
        bins, out = bin_numbers(x, cuts), start[group]
        for g in np.unique(group):
            own = group == g
            for tree in fitted.trees:
                out[own] += tree.values(bins[own], g, depth)
        return out

    return GroupedModel(margins, only, fitted)


def vector_width(rows: DataFrame) -> int:
    """Number of features of the first row; 0 without rows."""
    first = rows.select(F.size("x")).first()
    return first[0] if first else 0


def group_column(folds: int) -> Column:
    """The group that judges a row: its fold's, or the last for test rows."""
    return F.when(F.col("is_test"), F.lit(folds)).otherwise(F.col("fold")).cast("int")
