"""Model recovery and reproducibility of the trend model."""

import time
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricwatch.config import TrendConfig
from metricwatch.operators import trend

DAYS = 400
START = date(2021, 1, 4)


def known_signal(day: int) -> float:
    slope = 0.5 * day if day < 200 else 100 + 2.0 * (day - 200)
    return 50 + slope + 8 * np.sin(2 * np.pi * day / 7)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    rows = [("s", START + timedelta(d), float(known_signal(d) + rng.normal(scale=3))) for d in range(DAYS)]
    rows += [("gaps", START + timedelta(3 * d), 10.0 + d % 5) for d in range(60)]
    rows += [("gaps", START + timedelta(200), None)]
    rows += [("flat", START + timedelta(d), 4.0) for d in range(30)]
    rows += [("single", START, 1.0), ("nothing", START, None)]
    return spark.createDataFrame(rows, "series string, ds date, y double")


def test_recovers_trend_season_and_noise(spark, series):
    cfg = TrendConfig()
    out = trend.score_history(series, trend.fit_trend(series, cfg), cfg).where("series = 's'").orderBy("ds").collect()
    truth = np.array([known_signal(d) for d in range(DAYS)])
    error = np.array([r.yhat for r in out]) - truth
    assert np.sqrt(np.mean(error**2)) < 1.5
    covered = np.mean([r.yhat_lower <= r.fact <= r.yhat_upper for r in out])
    assert 0.74 < covered < 0.86


def test_short_empty_and_flat_series(spark, series):
    cfg = TrendConfig()
    models = {r.series: r for r in trend.fit_trend(series, cfg).collect()}
    assert set(models) == {"s", "gaps", "flat", "single", "nothing"}
    assert models["single"].status == models["nothing"].status == "too_short"
    assert models["gaps"].n_obs == 60 and models["gaps"].status == "ok"
    scored = trend.score_history(series, trend.fit_trend(series, cfg), cfg)
    # A day without a value is scored, a series without a model keeps its rows.
    assert scored.where("series = 'gaps' AND fact IS NULL AND yhat IS NOT NULL").count() == 1
    assert scored.where("series = 'single' AND yhat IS NULL").count() == 1
    flat = scored.where("series = 'flat'").collect()
    assert all(abs(r.yhat - 4.0) < 0.01 for r in flat)


def test_results_do_not_depend_on_partitions(spark, series):
    cfg = TrendConfig(yearly_order=2, draws=50)
    only = series.where("series = 's'")
    runs = []
    for parts in (1, 8):
        df = only.repartition(parts)
        runs.append(sorted(tuple(r) for r in trend.forecast(df, cfg, 20).collect()))
    for a, b in zip(*runs):
        assert a[:2] == b[:2]
        assert a[2:6] == pytest.approx(b[2:6], rel=1e-6)
    assert len(runs[0]) == DAYS + 20


def test_future_rows_and_interval_width(spark, series):
    narrow = TrendConfig(interval_width=0.5, draws=200)
    wide = replace(narrow, interval_width=0.95)
    models = trend.fit_trend(series.where("series = 's'"), narrow).cache()
    future = {
        w: trend.forecast_future(models, c, 60).orderBy("ds").collect() for w, c in (("n", narrow), ("w", wide))
    }
    assert [r.ds for r in future["n"]] == [START + timedelta(DAYS + i) for i in range(60)]
    assert all(r.fact is None for r in future["n"])
    assert all(a.yhat_lower > b.yhat_lower and a.yhat_upper < b.yhat_upper for a, b in zip(future["n"], future["w"]))
    widths = [r.yhat_upper - r.yhat_lower for r in future["w"]]
    assert np.mean(widths[-10:]) > np.mean(widths[:10])


def test_components_add_up(spark, series):
    cfg = TrendConfig(yearly_order=2)
    only = series.where("series = 's'")
    models = trend.fit_trend(only, cfg).cache()
    parts = trend.components(only, models, cfg).groupBy("ds").agg(F.sum("value").alias("total"))
    scored = trend.score_history(only, models, cfg)
    assert scored.join(parts, "ds").where(F.abs(F.col("total") - F.col("yhat")) > 1e-6).count() == 0
    assert trend.changepoints(models, cfg).count() == cfg.n_changepoints


def test_horizon_ends_before_target():
    assert trend.horizon_until(date(2022, 1, 28), date(2022, 1, 1)) == 27


def random_problem(seed):
    rng = np.random.default_rng(seed)
    n, p = int(rng.integers(2, 200)), 12
    x = rng.normal(size=(n, p)) * 10.0 ** rng.integers(-3, 2, p)
    x[:, 5] = x[:, 4]  # equal columns
    y = x[:, :3] @ rng.normal(size=3) * rng.choice([0.0, 1.0]) + rng.normal(size=n) * rng.choice([0.0, 1e-3, 1.0])
    laplace = np.arange(p) >= 4
    return x, y, np.where(laplace, 20.0, 0.04), laplace


@pytest.mark.parametrize("seed", range(12))
def test_solver_ends_at_the_optimum(seed):
    x, y, prior, laplace = random_problem(seed)
    beta, sigma, found = trend._map_solution(x.T @ x, x.T @ y, float(y @ y), len(y), prior, laplace)
    assert found

    def loss(b):
        rss = np.sum((y - x @ b) ** 2)
        return rss / (2 * sigma**2) + np.sum(np.where(laplace, prior * np.abs(b), prior * b**2 / 2))

    best, rng = loss(beta), np.random.default_rng(seed)
    for _ in range(300):  # no neighbour is better, in any direction and at any distance
        step = rng.normal(size=len(beta)) * 10.0 ** rng.integers(-6, 1) * (rng.random(len(beta)) < 0.4)
        assert loss(beta + step) >= best - 1e-7 * (1 + abs(best))


def test_gradient_is_zero_at_the_fit_and_nowhere_else(spark, series):
    cfg = TrendConfig(yearly_order=2)
    models = trend.fit_trend(series, cfg).cache()
    judged = trend.fit_gradients(series, models, cfg)
    assert judged.count() == 3 * trend.design_width(cfg)
    assert judged.where("NOT optimal").count() == 0
    moved = models.withColumn("beta", F.transform("beta", lambda b: b + 0.01))
    assert trend.fit_gradients(series, moved, cfg).where("NOT optimal AND series = 's'").count() > 20


def test_quantile_error_is_that_of_normal_draws():
    cfg = TrendConfig(interval_width=0.8, draws=400)
    draws = np.random.default_rng(7).standard_normal((2000, cfg.draws))
    assert np.quantile(draws, 0.9, axis=1).std() == pytest.approx(trend.quantile_error(cfg), rel=0.1)


@pytest.mark.parametrize("days", [30, 800])
def test_large_counts_with_little_noise_are_solved_in_few_steps(days):
    # Noise of a thousandth, as of daily counts over a million: coordinate descent took tens of thousands of sweeps.
    cfg = TrendConfig(weekly_order=0)
    rng, t = np.random.default_rng(3), np.arange(days) / (days - 1)
    y = rng.poisson(1_200_000, days) / 1.3e6
    points = np.linspace(0, cfg.changepoint_range, cfg.n_changepoints + 1)[1:]
    x = np.column_stack([np.ones(days), t, *[np.maximum(t - s, 0) for s in points]])
    prior, laplace = trend.penalties(cfg)
    started = time.process_time()
    beta, sigma, found = trend._map_solution(x.T @ x, x.T @ y, float(y @ y), days, prior, laplace)
    assert found and time.process_time() - started < 2
    # No coefficient moves: the gradient of the errors and priors is within each rate.
    pull = (x.T @ (x @ beta - y)) / sigma**2 + np.where(laplace, 0.0, prior) * beta
    size = np.abs(x.T) @ np.abs(y) / sigma**2 + prior
    off = np.where(beta == 0, np.maximum(np.abs(pull) - prior, 0), np.abs(pull + np.where(laplace, prior * np.sign(beta), 0)))
    assert (off <= 1e-6 * size).all()
