"""Fits of all folds at once against plain fits of each."""

import numpy as np
import pytest

from metricwatch.operators import grouped

FOLDS = 3


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    n = 240
    x = np.column_stack([rng.normal(size=n) * 1e6, rng.integers(0, 4, n), rng.normal(size=n), np.full(n, 2.5)])
    y = (x[:, 0] / 1e6 + x[:, 1] - 1.5 + rng.normal(size=n) > 0).astype(float)
    return x, y, np.arange(n) % FOLDS


@pytest.fixture(scope="module")
def train(spark, data):
    rows = [(a.tolist(), float(b), int(c)) for a, b, c in zip(*data)]
    return spark.createDataFrame(rows, "x array<double>, label double, fold int").repartition(4).cache()


def margins_of(model, data):
    x, _, fold = data
    return {g: model.margins(x, np.full(len(x), g)) for g in range(FOLDS + 1)}


def test_naive_bayes(train, data):
    x, y, fold = data
    got = margins_of(grouped.naive_bayes(train, FOLDS + 1, 4), data)
    for g in range(FOLDS + 1):
        own_x, own_y = x[fold != g], y[fold != g]
        floor = 1e-9 * own_x.var(axis=0).max()
        odds = []
        for c in (0, 1):
            part = own_x[own_y == c]
            v = part.var(axis=0) + floor
            odds.append(np.log(len(part)) - 0.5 * np.sum(np.log(2 * np.pi * v) + (x - part.mean(axis=0)) ** 2 / v, axis=1))
        assert got[g] == pytest.approx(odds[1] - odds[0], rel=1e-6, abs=1e-5)


def test_logistic_regression_is_flat_at_its_coefficients(train, data):
    x, y, fold = data
    fit = grouped.logistic(train, FOLDS + 1, 4)
    for g, beta in enumerate(fit.detail):
        own = np.column_stack([x, np.ones(len(x))])[fold != g]
        p = 1 / (1 + np.exp(-own @ beta))
        slope = own.T @ (p - y[fold != g]) + np.append(beta[:4], 0)
        assert np.all(np.abs(slope) <= 1e-7 * np.abs(own).sum(axis=0))
    judged = grouped.logistic_gradients(train, fit.detail).collect()
    assert len(judged) == (FOLDS + 1) * 5 and all(abs(r.slope) <= 1e-6 * (1 + r["size"]) for r in judged)
    moved = grouped.logistic_gradients(train, fit.detail + 0.01).collect()
    assert sum(abs(r.slope) > 1e-6 * (1 + r["size"]) for r in moved) > 10


def plain_tree(bins, g, h, cfg, level=0):
    leaf = -cfg.step * g.sum() / (h.sum() + cfg.leaf_penalty)
    best = (1e-6, None)
    if level < cfg.depth:
        for f in range(bins.shape[1]):
            for cut in range(cfg.bins):
                left = bins[:, f] <= cut
                if h[left].sum() >= cfg.least_curvature and h[~left].sum() >= cfg.least_curvature:
                    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + cfg.leaf_penalty)
                    gain = score(left) + score(~left) - score(np.ones(len(g), bool))
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, cut, left))
    if best[1] is None:
        return lambda b: np.full(len(b), leaf)
    f, cut, left = best[1]
    low, high = plain_tree(bins[left], g[left], h[left], cfg, level + 1), plain_tree(bins[~left], g[~left], h[~left], cfg, level + 1)
    return lambda b: np.where(b[:, f] <= cut, low(b), high(b))


@pytest.mark.parametrize("pending, rows_a_task", [(2, 50_000), (10, 50)])
def test_boosted_trees(train, data, monkeypatch, pending, rows_a_task):
    monkeypatch.setattr(grouped, "ROWS_PER_PARTITION", rows_a_task)  # one task or several
    x, y, fold = data
    cfg = grouped.Boosting(rounds=5, depth=3, bins=8, pending=pending)
    model = grouped.boosted_trees(train, FOLDS + 1, 4, cfg)
    got = margins_of(model, data)
    bins = grouped.bin_numbers(x, model.detail.cuts)
    assert bins.max() < cfg.bins and len(model.detail.cuts[3]) <= 1
    for group in range(FOLDS + 1):
        own = fold != group
        share = y[own].mean()
        margin = np.full(len(x), np.log(share / (1 - share)))
        for _ in range(cfg.rounds):
            p = 1 / (1 + np.exp(-margin[own]))
            margin = margin + plain_tree(bins[own], p - y[own], p * (1 - p), cfg)(bins)
        assert got[group] == pytest.approx(margin, rel=1e-9, abs=1e-9)
    shares = model.detail.importances
    assert shares.sum() == pytest.approx(1) and shares[3] == 0 and shares[:2].min() > 0


def test_no_rows(spark):
    empty = spark.createDataFrame([], "x array<double>, label double, fold int")
    for fit in (grouped.naive_bayes, grouped.logistic):
        assert fit(empty, 2, 1).only == [0, 0]
    assert grouped.vector_width(empty) == 0


def test_a_level_is_one_job_and_many_blocks_are_summed_in_tasks(spark, train, data, monkeypatch):
    monkeypatch.setattr(grouped, "ROWS_PER_PARTITION", 25)
    cfg, passes, totals = grouped.Boosting(rounds=3, depth=2, bins=8, pending=2), [], grouped._totals

    def counted(blocks, sums_of, size):
        spark.sparkContext.setJobGroup(f"pass{len(passes)}", "one pass")
        passes.append(totals(blocks, sums_of, size))
        return passes[-1]

    monkeypatch.setattr(grouped, "_totals", counted)
    whole = margins_of(grouped.boosted_trees(train, FOLDS + 1, 4, cfg), data)
    jobs = [len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pass{i}")) for i in range(len(passes))]
    # The pass after which the blocks are written is followed by the job that writes them.
    assert len(passes) == 6 and sum(jobs) <= 7 and max(jobs) <= 2
    monkeypatch.setattr(grouped, "BLOCKS_COLLECTED", 3)
    sliced = margins_of(grouped.boosted_trees(train, FOLDS + 1, 4, cfg), data)
    for group, margins in whole.items():
        assert sliced[group] == pytest.approx(margins, rel=1e-9, abs=1e-9)
    for a, b in zip(passes[:6], passes[6:]):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)
