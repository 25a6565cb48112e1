"""A closed-form band: straight line plus weekday means, checkable in plain SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_z(width: float) -> float:
    """Half-width of a central normal interval, in standard deviations."""
    return NormalDist().inv_cdf((1 + width) / 2)


def band_baseline(series: DataFrame, interval_width: float = 0.8) -> DataFrame:
    """Forecast frame of each series' history: regression line, weekday mean, normal band.

    A series has one row per day, so a window over a series is bounded by the calendar.
    All windows share one exchange on ``series``.
    """
    per_series = Window.partitionBy("series")
    per_weekday = Window.partitionBy("series", "weekday")
    z = interval_z(interval_width)
    day = F.datediff("ds", F.min("ds").over(per_series)).cast("double")
    return (
        series.withColumn("x", day)
        .withColumn("weekday", F.dayofweek("ds"))
        .withColumn("slope", F.regr_slope("y", "x").over(per_series))
        .withColumn("intercept", F.regr_intercept("y", "x").over(per_series))
        .withColumn("trend", F.col("intercept") + F.col("slope") * F.col("x"))
        .withColumn("seasonal", F.avg(F.col("y") - F.col("trend")).over(per_weekday))
        .withColumn("yhat", F.col("trend") + F.col("seasonal"))
        .withColumn("sigma", F.stddev_samp(F.col("y") - F.col("yhat")).over(per_series))
        .select(
            "series",
            "ds",
            "trend",
            "yhat",
            (F.col("yhat") - F.lit(z) * F.col("sigma")).alias("yhat_lower"),
            (F.col("yhat") + F.lit(z) * F.col("sigma")).alias("yhat_upper"),
            F.col("y").alias("fact"),
        )
    )
