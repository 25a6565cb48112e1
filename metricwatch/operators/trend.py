"""Additive trend-plus-seasonality model over many series at once.

The maths are those of Taylor & Letham, "Forecasting at Scale" (2018): a piecewise linear
trend with Laplace-distributed slope changes plus Fourier terms.  Everything but the
linear algebra is DataFrame expressions.  Fitting adds up cross-products of the design
rows, so a task never holds a series, and solves one small system per series.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.config import TrendConfig
from metricwatch.functions import hash_uniform
from metricwatch.operators.baseline import interval_z

_EPOCH = "1970-01-01"
_PERIODS = {"weekly": 7.0, "yearly": 365.25}

MODEL_SCHEMA = (
    "series string, first_ds date, last_ds date, last_seen date, span double, y_scale double, "
    "changepoints array<double>, n_obs bigint, beta array<double>, sigma double, status string"
)
_PARTIAL_SCHEMA = (
    "series string, first_ds date, last_ds date, last_seen date, span double, y_scale double, "
    "changepoints array<double>, n_obs bigint, gram array<double>, xty array<double>, yty double"
)
_MODEL_KEYS = ["first_ds", "last_ds", "last_seen", "span", "y_scale", "changepoints"]


def _orders(cfg: TrendConfig) -> dict[str, int]:
    return {"weekly": cfg.weekly_order, "yearly": cfg.yearly_order}


def design_width(cfg: TrendConfig) -> int:
    return 2 + cfg.n_changepoints + 2 * (cfg.weekly_order + cfg.yearly_order)


# ---- design rows -----------------------------------------------------------


def fourier_terms(ds: Column, period: float, order: int) -> list[Column]:
    """sin and cos of the first ``order`` harmonics, on days since the epoch."""
    angle = F.datediff(ds, F.lit(_EPOCH).cast("date")) * F.lit(2 * np.pi / period)
    return [fn(angle * F.lit(float(k))) for k in range(1, order + 1) for fn in (F.sin, F.cos)]


def design_row(t: Column, ds: Column, changepoints: Column, cfg: TrendConfig) -> Column:
    """``[1, t, hinge at each changepoint, weekly terms, yearly terms]``.

    Unused changepoint slots are NULL and give 0.
    """
    # greatest skips NULL, so an unused slot gives 0.
    hinges = F.transform(changepoints, lambda s: F.greatest(t - s, F.lit(0.0)))
    seasonal = [
        term for name, order in _orders(cfg).items() for term in fourier_terms(ds, _PERIODS[name], order)
    ]
    parts = [F.array(F.lit(1.0), t), hinges]
    if seasonal:
        parts.append(F.array(*seasonal))
    return F.concat(*parts)


def scaled_rows(series: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Series rows with the scaling and changepoints of their series.

    A series has one row per day, so its window is bounded by the calendar, and all
    windows share one exchange on ``series``.
    """
    whole = Window.partitionBy("series")
    upto = whole.orderBy("ds").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.col("y").isNotNull()
    observed = F.when(used, F.col("ds"))
    rows = (
        series.select("series", "ds", F.col("y").cast("double").alias("y"))
        .withColumn("n_obs", F.count("y").over(whole))
        .withColumn("first_ds", F.min(observed).over(whole))
        .withColumn("last_ds", F.max(observed).over(whole))
        .withColumn("last_seen", F.max("ds").over(whole))
        .withColumn("y_max", F.max(F.abs("y")).over(whole))
        .withColumn("position", F.count("y").over(upto) - 1)
    )
    span = F.datediff("last_ds", "first_ds").cast("double")
    rows = rows.withColumn("span", F.when(span > 0, span)).withColumn(
        "y_scale", F.when(F.col("y_max") > 0, F.col("y_max")).otherwise(F.lit(1.0))
    )
    # Even positions within the first part of the observed days, without the first day.
    head = F.floor(F.col("n_obs") * F.lit(cfg.changepoint_range))
    count = F.greatest(F.least(F.lit(cfg.n_changepoints), head - 1), F.lit(0)).cast("int")
    rows = rows.withColumn("head", head).withColumn("n_cp", count)
    chosen = F.exists(
        F.sequence(F.lit(1), F.greatest(F.col("n_cp"), F.lit(1))),
        lambda j: F.rint(j * (F.col("head") - 1) / F.greatest(F.col("n_cp"), F.lit(1)))
        == F.col("position"),
    )
    t = (F.datediff("ds", "first_ds")) / F.col("span")
    points = F.sort_array(F.collect_list(F.when(used & chosen & (F.col("n_cp") > 0), F.col("t"))).over(whole))
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(cfg.n_changepoints - 1)),
        lambda i: F.get(F.col("points"), i),
    )
    return (
        rows.withColumn("t", t)
        .withColumn("points", points)
        .withColumn("changepoints", slots if cfg.n_changepoints else F.array().cast("array<double>"))
        .select("series", "ds", "y", "t", "n_obs", *_MODEL_KEYS)
    )


# ---- fit -------------------------------------------------------------------


def _cross_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per series and Arrow batch: X'X, X'y, y'y of the scaled rows."""
    for pdf in batches:
        out = []
        for _, part in pdf.groupby("series", sort=False):
            keys = part.iloc[0]
            rows = part[part["x"].notna()]
            x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, 0))
            y = rows["y_scaled"].to_numpy(dtype=float)
            out.append(
                {
                    "series": keys["series"],
                    **{k: keys[k] for k in _MODEL_KEYS},
                    "n_obs": len(y),
                    "gram": (x.T @ x).ravel(),
                    "xty": x.T @ y,
                    "yty": float(y @ y),
                }
            )
        yield pd.DataFrame(out)


def _penalised_minimum(a, b, ridge, rate, beta):
    """Minimum of x'ax/2 - b'x + sum(ridge x^2)/2 + sum(rate |x|), by an active set.

    With the signs of the coefficients fixed the minimum is one linear system.  A step goes there, or as far as
    the first coefficient that would change its sign, which becomes zero.  At a minimum the zero coefficient whose
    gradient exceeds its rate most gets a sign.  Steps lower the function, so no set of signs comes twice, and
    their number does not depend on how small the noise is.  ``beta`` is the start, and is changed.
    """
    full = a + np.diag(ridge)
    slack = 1e-9 * (np.abs(b) + rate + 1e-12)
    # Coefficients differ in size by many orders: systems are solved in units of the diagonal.
    unit = 1 / np.sqrt(np.maximum(np.diag(full), 1e-300))
    scaled = full * unit[:, None] * unit
    sign, barred = np.where(rate > 0, np.sign(beta), 0.0), np.zeros(len(b), bool)

    def lowest(used, spare):
        found, own, left = np.zeros(len(b)), scaled[np.ix_(used, used)], (b - rate * sign)[used]
        own = own + spare * np.eye(len(own))
        for _ in range(2):  # the second solution is of what rounding left
            found[used] += unit[used] * np.linalg.lstsq(own, unit[used] * left, rcond=None)[0]
            left = (b - rate * sign - full @ found)[used]
        return found

    for _ in range(100 * len(b)):
        used = (sign != 0) | (rate == 0)
        # The spare curvature keeps the minimum finite where the rows do not tell coefficients apart.
        goal = lowest(used, 1e-13)
        crossing = np.nonzero(sign * goal < 0)[0]
        if len(crossing):
            shares = beta[crossing] / (beta[crossing] - goal[crossing])
            first, share = crossing[shares.argmin()], shares.min()
            beta += share * (goal - beta)
            beta[first] = sign[first] = 0.0
            # What turns back at once was sent by rounding.
            barred = np.where(np.arange(len(b)) == first, True, barred) if share <= 0 else np.zeros(len(b), bool)
            continue
        beta = goal
        gradient = full @ beta - b
        excess = np.where(used | barred, 0.0, np.maximum(np.abs(gradient) - rate - slack, 0.0) * unit)
        if not excess.any():
            break
        sign[excess.argmax()] = -np.sign(gradient[excess.argmax()])
    exact = lowest((beta != 0) | (rate == 0), 0.0)
    if _is_optimal(full, b, rate, exact, slack):
        return exact, True
    return beta, _is_optimal(full, b, rate, beta, 1e3 * slack)


def _is_optimal(full, b, rate, beta, slack) -> bool:
    """Whether zero is a subgradient at ``beta``."""
    gradient = full @ beta - b
    at_zero = np.abs(gradient) <= rate + slack
    elsewhere = np.abs(gradient + rate * np.sign(beta)) <= slack
    return bool(np.all(np.where((beta == 0) & (rate > 0), at_zero, elsewhere)))


def _map_solution(gram, xty, yty, n, inverse_scale, laplace, rounds=2000):
    """MAP coefficients, noise scale and whether they are an optimum.

    For a given noise the coefficients are the minimum of a convex function; the noise step is the
    root of its own stationarity condition.  More noise gives more residue and more residue
    more noise, so from the largest value the noise falls to its fixed point.
    """
    ridge, rate = np.where(laplace, 0.0, inverse_scale), np.where(laplace, inverse_scale, 0.0)
    beta, found = np.zeros(len(xty)), False
    sigma2 = max((np.sqrt(n * n + 16 * yty) - n) / 8, 1e-10)
    for _ in range(rounds):
        beta, found = _penalised_minimum(gram / sigma2, xty / sigma2, ridge, rate, beta.copy())
        rss = max(yty - 2 * beta @ xty + beta @ gram @ beta, 0.0)
        last, sigma2 = sigma2, max((np.sqrt(n * n + 16 * rss) - n) / 8, 1e-10)
        if abs(last - sigma2) <= 1e-9 * last:
            return beta, float(np.sqrt(sigma2)), found
    return beta, float(np.sqrt(sigma2)), False


def penalties(cfg: TrendConfig) -> tuple[np.ndarray, np.ndarray]:
    """Prior precision of each coefficient, for slope changes the Laplace rate, and which are slope changes."""
    n_cp = cfg.n_changepoints
    seasonal = design_width(cfg) - 2 - n_cp
    inverse_scale = np.concatenate(
        [
            np.full(2, 1 / 5.0**2),
            np.full(n_cp, 1 / cfg.changepoint_prior),
            np.full(seasonal, 1 / cfg.seasonality_prior**2),
        ]
    )
    return inverse_scale, np.concatenate([np.zeros(2, bool), np.ones(n_cp, bool), np.zeros(seasonal, bool)])


def _solver(cfg: TrendConfig):
    inverse_scale, laplace = penalties(cfg)

    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        full = parts[parts["n_obs"] > 0]
        n = int(full["n_obs"].sum())
        row = parts.iloc[0][["series", *_MODEL_KEYS]].to_dict()
        row |= {"n_obs": n, "beta": None, "sigma": None, "status": "too_short"}
        if n >= 2:
            p = design_width(cfg)
            gram = np.sum(np.stack(full["gram"].to_numpy()), axis=0).reshape(p, p)
            xty = np.sum(np.stack(full["xty"].to_numpy()), axis=0)
            beta, sigma, converged = _map_solution(gram, xty, full["yty"].sum(), n, inverse_scale, laplace)
            row |= {"beta": beta, "sigma": sigma, "status": "ok" if converged else "not_converged"}
        return pd.DataFrame([row])

    return solve


def fit_trend(series: DataFrame, cfg: TrendConfig) -> DataFrame:
    """One row per series: scaling, changepoints, coefficients, noise scale and status.

    The rows are clustered by series already, so a series sends one or two partial
    cross-product rows to its solver, whatever its length.
    """
    return _fit(scaled_rows(series, cfg), cfg)


def _fit(rows: DataFrame, cfg: TrendConfig) -> DataFrame:
    usable = F.col("y").isNotNull() & F.col("span").isNotNull()
    x = design_row(F.col("t"), F.col("ds"), F.col("changepoints"), cfg)
    partial = rows.select(
        "series",
        *_MODEL_KEYS,
        F.when(usable, x).alias("x"),
        (F.col("y") / F.col("y_scale")).alias("y_scaled"),
    ).mapInPandas(_cross_products, _PARTIAL_SCHEMA)
    return partial.groupBy("series").applyInPandas(_solver(cfg), MODEL_SCHEMA)


def fit_gradients(series: DataFrame, models: DataFrame, cfg: TrendConfig) -> DataFrame:
    """How far each coefficient of a fit is from its optimum: ``(series, term, beta, slope, room, optimal)``.

    Computed from the rows, not from the fit's sums.  ``slope`` is the derivative of the squared errors and
    normal priors; a slope change adds its Laplace rate with its sign, and at zero has that rate as
    ``room``.  ``optimal`` allows a millionth of the summed sizes of the derivative's parts.
    """
    inverse_scale, laplace = penalties(cfg)
    x = design_row(F.col("t"), F.col("ds"), F.col("changepoints"), cfg)
    rows = series.select("series", "ds", F.col("y").cast("double").alias("y")).where("y IS NOT NULL").join(
        models.where(F.col("beta").isNotNull()), "series"
    )
    parts = (
        rows.withColumn("t", F.datediff("ds", "first_ds") / F.col("span"))
        .withColumn("x", x)
        .withColumn("error", _dot(F.col("x"), F.col("beta")) - F.col("y") / F.col("y_scale"))
        .withColumn("scale", F.col("sigma") * F.col("sigma"))
        .select("series", "beta", "scale", "error", (F.col("y") / F.col("y_scale")).alias("y"), F.posexplode("x").alias("term", "v"))
        .groupBy("series", "term")
        .agg(
            F.max(F.get("beta", F.col("term"))).alias("beta"),
            (F.sum(F.col("v") * F.col("error")) / F.max("scale")).alias("pull"),
            (F.sum(F.abs(F.col("v") * F.col("y"))) / F.max("scale")).alias("size"),
        )
    )
    prior = F.get(F.array(*map(F.lit, inverse_scale.tolist())), F.col("term"))
    changes = F.get(F.array(*map(F.lit, laplace.tolist())), F.col("term"))
    zero = F.lit(0.0)
    judged = parts.withColumn(
        "slope", F.col("pull") + F.when(changes, prior * F.signum("beta")).otherwise(prior * F.col("beta"))
    ).withColumn("room", F.when(changes & (F.col("beta") == 0), prior).otherwise(zero))
    slack = F.lit(1e-6) * (F.col("size") + prior)
    return judged.select("series", "term", "beta", "slope", "room", (F.abs("slope") <= F.col("room") + slack).alias("optimal"))


# ---- score -----------------------------------------------------------------


def _dot(x: Column, beta: Column) -> Column:
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _point_forecast(rows: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Add ``t``, ``trend``, ``seasonal`` and ``yhat`` to rows that carry their model."""
    width = 2 + cfg.n_changepoints
    t = F.datediff("ds", "first_ds") / F.col("span")
    x = design_row(F.col("t"), F.col("ds"), F.col("changepoints"), cfg)
    beta = F.col("beta")
    return (
        rows.withColumn("t", t)
        .withColumn("x", x)
        .withColumn("trend", _dot(F.slice("x", 1, width), F.slice(beta, 1, width)) * F.col("y_scale"))
        .withColumn(
            "seasonal",
            _dot(F.slice("x", width + 1, 10**6), F.slice(beta, width + 1, 10**6)) * F.col("y_scale"),
        )
        .withColumn("yhat", F.col("trend") + F.col("seasonal"))
    )


def score_history(series: DataFrame, models: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Forecast frame over the observed days.  Series without a model get NULL bounds."""
    noise = F.lit(interval_z(cfg.interval_width)) * F.col("sigma") * F.col("y_scale")
    rows = series.select("series", "ds", F.col("y").cast("double").alias("fact")).join(
        models, "series", "left"
    )
    return _point_forecast(rows, cfg).select(
        "series",
        "ds",
        "trend",
        "yhat",
        (F.col("yhat") - noise).alias("yhat_lower"),
        (F.col("yhat") + noise).alias("yhat_upper"),
        "fact",
    )


def future_days(models: DataFrame, horizon_days: int) -> DataFrame:
    """One row per series and day after the last seen one, carrying the model."""
    ahead = F.explode(F.sequence(F.lit(1), F.lit(horizon_days))).alias("step")
    return models.where(F.col("beta").isNotNull()).select("*", ahead).withColumn(
        "ds", F.date_add("last_seen", F.col("step"))
    )


def forecast_future(models: DataFrame, cfg: TrendConfig, horizon_days: int) -> DataFrame:
    """Forecast frame of the coming days with simulated bounds.

    Future slope changes appear at the historic rate with the historic mean size.  All
    randomness is hashed from (series, draw, step), so results do not depend on how the
    rows are partitioned.
    """
    points = _point_forecast(future_days(models, horizon_days), cfg)
    deltas = F.slice("beta", 3, cfg.n_changepoints) if cfg.n_changepoints else F.array(F.lit(0.0))
    used = F.size(F.filter("changepoints", lambda s: s.isNotNull()))
    size = F.aggregate(deltas, F.lit(0.0), lambda s, d: s + F.abs(d)) / F.greatest(used, F.lit(1)) + 1e-8
    seed = F.lit(cfg.seed)

    def jump(step: Column) -> Column:
        # Laplace by inverse transform.
        u = hash_uniform(F.col("series"), F.col("draw"), step, seed, F.lit("size")) - 0.5
        return -F.col("jump_size") * F.signum(u) * F.log1p(-2 * F.abs(u))

    # A few bytes per draw, spread before the days multiply them.  The number is explicit:
    # AQE would merge rows this small back into one task.
    tasks = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = (
        models.where(F.col("beta").isNotNull())
        .select(
            "series",
            "span",
            "sigma",
            size.alias("jump_size"),
            (used / F.col("span")).alias("rate"),
            F.explode(F.sequence(F.lit(1), F.lit(cfg.draws))).alias("draw"),
        )
        .repartition(tasks, "series", "draw")
        .withColumn(
            "jumps",
            F.filter(
                F.transform(
                    F.sequence(F.lit(1), F.lit(horizon_days)),
                    lambda i: F.when(
                        hash_uniform(F.col("series"), F.col("draw"), i, seed, F.lit("when")) < F.col("rate"),
                        F.struct(i.alias("step"), jump(i).alias("size")),
                    ),
                ),
                lambda j: j.isNotNull(),
            ),
        )
    )
    step = F.col("step")
    shift = F.aggregate(
        F.filter("jumps", lambda j: j["step"] <= step),
        F.lit(0.0),
        lambda s, j: s + j["size"] * (step - j["step"]) / F.col("span"),
    )
    u1 = hash_uniform(F.col("series"), F.col("draw"), step, seed, F.lit("radius"))
    u2 = hash_uniform(F.col("series"), F.col("draw"), step, seed, F.lit("angle"))
    normal = F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * np.pi) * u2)
    tail = (1 - cfg.interval_width) / 2
    # Deviations are simulated in scaled units and added to the point forecast afterwards,
    # so the simulated rows stay narrow.
    bounds = (
        draws.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon_days))).alias("step"))
        .select("series", "step", (shift + normal * F.col("sigma")).alias("deviation"))
        .groupBy("series", "step")
        .agg(F.percentile("deviation", [tail, 1 - tail]).alias("q"))
    )
    return points.join(bounds, ["series", "step"]).select(
        "series",
        "ds",
        "trend",
        "yhat",
        (F.col("yhat") + F.col("q")[0] * F.col("y_scale")).alias("yhat_lower"),
        (F.col("yhat") + F.col("q")[1] * F.col("y_scale")).alias("yhat_upper"),
        F.lit(None).cast("double").alias("fact"),
    )


def quantile_error(cfg: TrendConfig) -> float:
    """Standard error of a simulated bound, in parts of the noise, where only noise is simulated."""
    tail = (1 - cfg.interval_width) / 2
    density = np.exp(-interval_z(cfg.interval_width) ** 2 / 2) / np.sqrt(2 * np.pi)
    return float(np.sqrt(tail * (1 - tail) / cfg.draws) / density)


def forecast(series: DataFrame, cfg: TrendConfig, horizon_days: int, models: DataFrame | None = None) -> DataFrame:
    """History and ``horizon_days`` further days in one forecast frame."""
    models = fit_trend(series, cfg) if models is None else models
    history = score_history(series, models, cfg)
    if horizon_days <= 0:
        return history
    return history.unionByName(forecast_future(models, cfg, horizon_days))


def horizon_until(until: date, as_of: date) -> int:
    """Days to forecast from ``as_of``'s eve so that the last one precedes ``until``."""
    return (until - as_of).days


def components(rows: DataFrame, models: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Trend, weekly and yearly parts of each ``(series, ds)``: ``(series, ds, component, value)``."""
    scored = _point_forecast(rows.select("series", "ds").join(models, "series"), cfg)
    start = 3 + cfg.n_changepoints
    parts = [F.struct(F.lit("trend").alias("component"), F.col("trend").alias("value"))]
    for name, order in _orders(cfg).items():
        if order:
            part = _dot(F.slice("x", start, 2 * order), F.slice("beta", start, 2 * order)) * F.col("y_scale")
            parts.append(F.struct(F.lit(name).alias("component"), part.alias("value")))
            start += 2 * order
    return scored.select("series", "ds", F.explode(F.array(*parts)).alias("c")).select(
        "series", "ds", "c.component", "c.value"
    )


def changepoints(models: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Changepoint days of each series with their slope change per day."""
    return (
        models.where(F.col("beta").isNotNull())
        .select(
            "series", "first_ds", "span", "y_scale", "beta",
            F.posexplode("changepoints").alias("pos", "t"),
        )
        .where(F.col("t").isNotNull())
        .select(
            "series",
            F.date_add("first_ds", F.rint(F.col("t") * F.col("span")).cast("int")).alias("ds"),
            (F.get("beta", F.col("pos") + 2) * F.col("y_scale") / F.col("span")).alias("slope_change"),
        )
    )
