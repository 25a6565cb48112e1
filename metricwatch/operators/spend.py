"""Cost of each data model per day, from the statement log.

The report is written as aggregate-then-join: partial aggregation reduces the log to
one row per (day, database, model) on the map side, so a statement-less NULL key or one
hot model never gathers in a task.  All-time figures, ranks and totals are computed from
that small table.  Results equal those of window functions over the statements, which the
SQL twins use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.config import BUILD_SUFFIX, TABLE_BUILD_QUERY_TYPE, SpendConfig
from metricwatch.functions import (
    compute_hours,
    model_name,
    month_start,
    nice_bytes,
    warehouse_rate,
)
from metricwatch.operators.ranking import dense_ranks
from metricwatch.sources.lineage import cut_lineage

# What identifies the dearest statement of a day beyond its credits, in tie-break order.
_TIE_BREAK = ("start_time", "end_time", "query_label", "warehouse_name", "query_type")
_MODEL = ("database_name", "model_key")
_DAY = ("start_date", *_MODEL)
_ROW_COUNTS = ("rows_produced", "rows_unloaded", "rows_inserted", "rows_updated", "rows_deleted")
# Scale at which fractional cloud credits are added: decimal sums are the same in any order.
_EXACT = "decimal(28,12)"


def statements(log: DataFrame, cfg: SpendConfig) -> DataFrame:
    """Filtered statements with model key, label, rate and credits, each computed once."""
    kept = log.where(
        (F.col("database_name") == cfg.database)
        & ~F.col("query_type").isin(*cfg.excluded_query_types)
        & (F.col("warehouse_name") != cfg.excluded_warehouse)
        & (F.col("start_time") >= F.lit(cfg.since))
    )
    key = model_name("query_text", cfg.key_pattern, BUILD_SUFFIX)
    rate = warehouse_rate("warehouse_name", cfg.rates, cfg.default_rate)
    hours = compute_hours("total_elapsed_time")
    label = model_name("query_text", cfg.label_pattern, BUILD_SUFFIX)
    return kept.select(
        F.to_date("start_time").alias("start_date"),
        "start_time",
        "end_time",
        "database_name",
        key.alias("model_key"),
        label.alias("query_label"),
        "query_type",
        "warehouse_name",
        (F.col("credits_used_cloud_services") + rate * hours).alias("credits"),
        (rate * hours).alias("compute_credits"),
        (rate.cast("bigint") * F.col("total_elapsed_time")).alias("rated_ms"),
        F.col("credits_used_cloud_services").cast(_EXACT).alias("cloud_credits"),
        "total_elapsed_time",
        *_ROW_COUNTS,
        "bytes_scanned",
    )


def credits_of(rated_ms: Column | str, cloud: Column | str) -> Column:
    """Credits from summed ``rate x milliseconds`` and cloud credits.

    Both sums are exact, so the result is the same on every recomputation.
    """
    rated_ms = F.col(rated_ms) if isinstance(rated_ms, str) else rated_ms
    cloud = F.col(cloud) if isinstance(cloud, str) else cloud
    return rated_ms.cast("double") / F.lit(3600000.0) + cloud.cast("double")


def daily_costs(stmts: DataFrame) -> DataFrame:
    """One row per (day, database, model): sums, extremes and the dearest statement."""
    # A struct maximum sorts each map task's rows locally and shuffles one row per key.
    dearest = F.max(F.struct("credits", *_TIE_BREAK, "compute_credits"))
    builds = F.when(F.col("query_type") == TABLE_BUILD_QUERY_TYPE, F.col("credits"))
    return stmts.groupBy(*_DAY).agg(
        dearest.alias("top"),
        F.min(builds).alias("min_build_credits"),
        F.sum("rated_ms").alias("rated_ms"),
        F.sum("cloud_credits").alias("cloud_credits"),
        F.sum("total_elapsed_time").alias("elapsed_time"),
        *[F.sum(c).alias(c) for c in _ROW_COUNTS],
        F.max("bytes_scanned").alias("max_bytes"),
        F.sum("bytes_scanned").alias("bytes"),
    )


def alltime_costs(daily: DataFrame) -> DataFrame:
    """One row per (database, model) over all days."""
    return daily.groupBy(*_MODEL).agg(
        F.max("top.credits").alias("max_credits_alltime"),
        credits_of(F.sum("rated_ms"), F.sum("cloud_credits")).alias("credits_alltime"),
        F.sum("bytes").alias("bytes_alltime"),
    )


def total_cost(daily: DataFrame, cfg: SpendConfig) -> DataFrame:
    """One row: cost of all models and days."""
    total = credits_of(F.sum("rated_ms"), F.sum("cloud_credits"))
    return daily.agg((total * F.lit(cfg.money_per_credit)).alias("cost_all_jobs"))


def _same_model(a: str, b: str) -> Column:
    cond = F.lit(True)
    for c in _MODEL:
        cond = cond & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return cond


def ranked_models(daily: DataFrame) -> DataFrame:
    """Daily rows with their model's all-time figures beside them."""
    return (
        daily.alias("d")
        .join(alltime_costs(daily).alias("a"), _same_model("d", "a"))
        .select(
            "d.*",
            credits_of("d.rated_ms", "d.cloud_credits").alias("credits_day"),
            "a.max_credits_alltime",
            "a.credits_alltime",
            "a.bytes_alltime",
        )
    )


def spend_report(log: DataFrame, cfg: SpendConfig, partitions: int | None = None) -> DataFrame:
    """Dearest statement per model and day with daily, all-time and overall cost, ranked."""
    # The log is read once; everything below works on models x days.
    daily = cut_lineage(daily_costs(statements(log, cfg)))
    rows = ranked_models(daily).withColumn("month", month_start("start_date"))
    ranks = dense_ranks(rows, ["month"], "credits_alltime", "expensivest_ranking", partitions)
    ranked = rows.alias("r").join(
        ranks.alias("k"),
        F.col("r.month").eqNullSafe(F.col("k.month"))
        & F.col("r.credits_alltime").eqNullSafe(F.col("k.credits_alltime")),
    )
    day_credits = F.col("r.credits_day")
    money = F.lit(cfg.money_per_credit)
    return ranked.select(
        "r.start_date",
        F.to_date("r.top.end_time").alias("end_date"),
        F.col("r.top.query_label").alias("query"),
        "r.model_key",
        F.col("r.top.credits").alias("max_credits_used_daily"),
        F.col("r.min_build_credits").alias("min_credits_used_daily"),
        F.col("r.max_credits_alltime").alias("max_credits_used_alltime"),
        day_credits.alias("credits_used_daily"),
        (day_credits * money).alias("cash_money_daily"),
        (F.col("r.credits_alltime") * money).alias("cash_money_alltime"),
        (F.col("r.max_credits_alltime") == F.col("r.top.credits")).alias("most_expensivest"),
        nice_bytes("r.max_bytes").alias("max_bytes_daily"),
        nice_bytes("r.bytes_alltime").alias("sum_bytes_alltime"),
        F.col("r.elapsed_time").alias("elapsed_time_daily"),
        "r.rows_produced",
        "r.rows_deleted",
        "r.rows_updated",
        "r.rows_inserted",
        "r.rows_unloaded",
        F.col("r.top.warehouse_name").alias("warehouse_name"),
        F.col("r.top.query_type").alias("query_type"),
        F.col("r.top.compute_credits").alias("compute_credits_used"),
        "k.expensivest_ranking",
        total_cost(daily, cfg).scalar().alias("cost_all_jobs"),
        F.col("r.top.start_time").alias("start_time"),
    ).orderBy(F.desc_nulls_last("cash_money_alltime"), F.desc_nulls_last("start_time"))
