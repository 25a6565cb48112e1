"""Exact running totals and dense ranks over value order, for groups of any size.

A plain window puts a whole group into one task.  Here equal values are merged first and
the rest is range-partitioned by Spark, which cuts through groups; windows stay inside a
partition, and each partition adds the totals of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricwatch.sources.lineage import cut_lineage


def _running(levels: DataFrame, by: list[str], order: str, direction: Column, values: list[str], partitions: int | None) -> DataFrame:
    """Adds ``<v>_before`` to ``levels`` of distinct ``(by, order)``."""
    sort = [*by, direction]
    ranged = levels.repartitionByRange(partitions, *sort) if partitions else levels.repartitionByRange(*sort)
    # Written once: the partition of a row never changes, whatever is recomputed.
    placed = cut_lineage(ranged.sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy(*by, "_part").orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select(
        *by, order, "_part", *values,
        *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_in_{v}") for v in values],
    )
    # One row per group and partition.
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "_part")
        .agg(*[F.sum(v).alias(v) for v in values])
        .select(
            *[F.col(c).alias(f"_o_{c}") for c in by],
            F.col("_part").alias("_o_part"),
            *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_pre_{v}") for v in values],
        )
    )
    same = F.col("_part") == F.col("_o_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return inside.join(offsets, same).select(
        *by, order, *values,
        *[(F.col(f"_in_{v}") + F.col(f"_pre_{v}")).alias(f"{v}_before") for v in values],
    )


def running_totals(df: DataFrame, by: list[str], order: str, values: list[str], partitions: int | None = None) -> DataFrame:
    """Sums per distinct ``(by, order)`` and sums over all smaller ``order`` values.

    Adds ``<v>`` (sum at this value) and ``<v>_before`` (sum below it) for each of
    ``values``.  Rows with a NULL ``order`` are left out; NaN is above all numbers.
    ``partitions`` overrides the number of ranges.
    """
    levels = df.where(F.col(order).isNotNull()).groupBy(*by, order).agg(*[F.sum(v).alias(v) for v in values])
    return _running(levels, by, order, F.col(order).asc(), values, partitions)


def dense_ranks(df: DataFrame, by: list[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """``(by, value, name)``: dense rank of each distinct value per group, largest first.

    NULL values rank last, as one value; NaN ranks first.  Values keep their type.
    """
    levels = df.select(*by, value).distinct().withColumn("_one", F.lit(1))
    return _running(levels, by, value, F.col(value).desc_nulls_last(), ["_one"], partitions).select(
        *by, value, (F.col("_one_before") + 1).cast("int").alias(name)
    )


def value_counts(df: DataFrame, by: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """``(by, value, n, n_before)``: rows at and below each distinct non-NULL value."""
    return running_totals(df.withColumn("n", F.lit(1)), by, value, ["n"], partitions)


def quantiles(counted: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of :func:`value_counts` rows: ``(by, stat, value)``."""
    sizes = counted.groupBy(*[F.col(c).alias(f"_s_{c}") for c in by]).agg(F.sum("n").alias("_n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    wanted = F.explode(
        F.array(*[F.struct(F.lit(s).alias("stat"), F.lit(p).alias("p")) for s, p in probabilities.items()])
    )
    # A quantile's position lies on or between two order statistics; pick the values whose
    # counted rows cover its floor and its ceiling.
    rows = (
        counted.join(sizes, same)
        .select(*by, value, "n", "n_before", "_n", wanted.alias("_w"))
        .withColumn("_pos", (F.col("_n") - 1) * F.col("_w.p"))
        .withColumn("_stat", F.col("_w.stat"))
    )

    def covers(place):
        return (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n"))

    low, high = F.floor("_pos"), F.ceil("_pos")
    picked = rows.where(covers(low) | covers(high)).groupBy(*by, "_stat").agg(
        F.max("_pos").alias("_pos"),
        F.max(F.when(covers(low), F.col(value))).alias("_lo"),
        F.max(F.when(covers(high), F.col(value))).alias("_hi"),
    )
    return picked.select(
        *by,
        F.col("_stat").alias("stat"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))).alias("value"),
    )
