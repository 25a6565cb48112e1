"""Summary statistics, correlations and calendar totals."""

from __future__ import annotations

from datetime import date

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricwatch.operators.selection import column_quantiles
from metricwatch.sources.lineage import cut_lineage

FORECAST_MEASURES = ("trend", "yhat", "yhat_lower", "yhat_upper", "fact")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any NULL."""
    return df.na.drop("any")


def dropna_count(df: DataFrame) -> DataFrame:
    """How many rows ``drop_incomplete`` keeps and drops."""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(complete, 1)).alias("kept"),
        F.count(F.when(~complete, 1)).alias("dropped"),
    )


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)`` in DOUBLE, one row per cell; NULL cells are left out."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("value").isNotNull())


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles and max of numeric columns: ``(column, stat, value)``.

    Quartiles are exact and interpolated; see :mod:`metricwatch.operators.selection`.  Columns without
    values give no rows.  The columns are read a few times, so they are kept while this runs;
    only counts and single values are shuffled.
    """
    columns = columns or numeric_columns(df)
    named = {f"c{i}": c for i, c in enumerate(columns)}
    cells = df.select(*[F.col(f"`{c}`").cast("double").alias(k) for k, c in named.items()]).persist(StorageLevel.MEMORY_AND_DISK)
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = cells.agg(*[F.struct(*[f(k).cast("double").alias(m) for m, f in moments.items()]).alias(k) for k in named]).head()
    counts = {k: int(one[k]["count"]) for k in named}
    rows = [(k, m, one[k][m]) for k in named if counts[k] for m in moments]
    rows += column_quantiles(cells, counts, {"25%": 0.25, "50%": 0.5, "75%": 0.75})
    cells.unpersist()
    return df.sparkSession.createDataFrame([(named[k], *r) for k, *r in rows], "column string, stat string, value double")


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair: ``(x, y, r)``; NULL where undefined.

    One distributed pass builds the covariance matrix; only columns x columns numbers
    leave it.
    """
    columns = columns or numeric_columns(df)
    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(
        df.select(*columns).na.drop("any")
    )
    matrix = Correlation.corr(vectors, "v").head()[0].toArray()
    cells = [
        (x, y, None if r != r else float(r))
        for x, row in zip(columns, matrix)
        for y, r in zip(columns, row)
    ]
    return df.sparkSession.createDataFrame(cells, "x string, y string, r double")


def monthly_resample(forecast: DataFrame, cutoff: date, measures=FORECAST_MEASURES) -> DataFrame:
    """Sums per series and month from ``cutoff`` on, labelled by month end.

    Months without rows inside a series' range give 0; NULLs are skipped.
    """
    rows = forecast.where(F.col("ds") >= F.lit(cutoff))
    sums = rows.groupBy("series", F.last_day("ds").alias("month_end")).agg(
        *[F.sum(m).alias(m) for m in measures]
    )
    # The calendar comes from the monthly sums, a few rows per series.
    months = (
        sums.groupBy("series")
        .agg(F.min("month_end").alias("first"), F.max("month_end").alias("last"))
        .select(
            "series",
            F.explode(
                F.expr("sequence(trunc(first, 'MM'), trunc(last, 'MM'), interval 1 month)")
            ).alias("month_start"),
        )
        .select("series", F.last_day("month_start").alias("month_end"))
    )
    return months.join(sums, ["series", "month_end"], "left").select(
        "series", "month_end", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in measures]
    )


def fiscal_total(forecast: DataFrame, cutoff: date, measures=FORECAST_MEASURES) -> DataFrame:
    """One row per series: sums of all measures from ``cutoff`` on."""
    rows = forecast.where(F.col("ds") >= F.lit(cutoff))
    return rows.groupBy("series").agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in measures])


def out_of_order(df: DataFrame, keys: list[Column], ascending: tuple[bool, ...]) -> DataFrame:
    """``(rows, out_of_order)``: rows of ``df``, and those that its own order puts behind a row they should precede.

    ``keys`` must not be NULL.  Rows are compared inside their partition, and each partition's first row with the
    last one of the filled partition before it.
    """
    names = [f"k{i}" for i in range(len(keys))]
    position = F.monotonically_increasing_id()
    placed = cut_lineage(df.select(*[k.alias(n) for k, n in zip(keys, names)]).select("*", F.spark_partition_id().alias("part"), position.alias("at")))
    key = F.struct(*names)
    inside = Window.partitionBy("part").orderBy("at")
    # One row per partition.
    ends = placed.groupBy("part").agg(F.min_by(key, "at").alias("key"), F.max_by(key, "at").alias("last"))
    across = ends.select("key", F.lag("last").over(Window.orderBy("part")).alias("before"))
    pairs = placed.select(key.alias("key"), F.lag(key).over(inside).alias("before")).unionByName(across)
    wrong = F.lit(False)
    for name, up in reversed(list(zip(names, ascending))):
        now, then = F.col(f"key.{name}"), F.col(f"before.{name}")
        wrong = (now < then if up else now > then) | ((now == then) & wrong)
    found = pairs.agg(F.count(F.when(F.col("before").isNotNull() & wrong, 1)).alias("out_of_order"))
    return placed.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(found))
