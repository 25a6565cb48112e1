"""Anomaly labels, alert rows and chart-ready layers of a scored series."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_anomalies(forecast: DataFrame) -> DataFrame:
    """Add ``anomaly`` (1 above the band, -1 below, 0 inside or unobserved) and ``importance``.

    Importance is the overshoot relative to the observed value; an observed 0 outside
    the band is infinitely important.
    """
    fact, upper, lower = F.col("fact"), F.col("yhat_upper"), F.col("yhat_lower")
    anomaly = F.when(fact > upper, 1).when(fact < lower, -1).otherwise(0)
    overshoot = F.when(F.col("anomaly") == 1, fact - upper).when(F.col("anomaly") == -1, lower - fact)
    importance = (
        F.when(F.col("anomaly") == 0, F.lit(0.0))
        .when(fact == 0, F.lit(float("inf")))
        .otherwise(overshoot / fact)
    )
    return forecast.withColumn("anomaly", anomaly).withColumn("importance", importance)


def alerts(
    labelled: DataFrame, as_of: date, lookback_days: int | None = None, min_importance: float = 0.0
) -> DataFrame:
    """Rows to notify about: anomalies before ``as_of``, optionally only the last days."""
    rows = labelled.where((F.col("anomaly") != 0) & (F.col("ds") < F.lit(as_of)))
    if lookback_days is not None:
        rows = rows.where(F.col("ds") >= F.lit(as_of - timedelta(days=lookback_days)))
    above = F.col("anomaly") == 1
    return rows.where(F.abs("importance") >= min_importance).select(
        "series",
        "ds",
        "fact",
        F.when(above, F.col("yhat_upper")).otherwise(F.col("yhat_lower")).alias("bound"),
        F.when(above, F.lit("above")).otherwise(F.lit("below")).alias("direction"),
        "importance",
    )


# ---- chart layers ----------------------------------------------------------


def layer_band(forecast: DataFrame) -> DataFrame:
    return forecast.select("series", "ds", "yhat_lower", "yhat_upper", "yhat", "fact")


def layer_facts(forecast: DataFrame, normal_only: bool = False) -> DataFrame:
    rows = forecast.where(F.col("anomaly") == 0) if normal_only else forecast
    return rows.select("series", "ds", "fact", "yhat_lower", "yhat_upper", "yhat")


def layer_anomalies(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("anomaly") != 0).select(
        "series", "ds", "fact", "yhat_lower", "yhat_upper", "importance"
    )


def layer_predictions(forecast: DataFrame, cutoff: date) -> DataFrame:
    return forecast.where(F.col("ds") >= F.lit(cutoff)).select(
        "series", "ds", "yhat", "yhat_lower", "yhat_upper", "fact"
    )
