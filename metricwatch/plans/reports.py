"""The five top-level results, composed from operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.config import (
    ACTIVE_SHARE,
    ANOMALY_TREND,
    BUDGET_TREND,
    OUTLOOK_DAYS,
    POSTS_TARGET,
    PREDICTION_CUTOFFS,
    SPEND_CUTOFF,
    SPEND_UNTIL,
    YEAR_AHEAD_TREND,
    ModelSettings,
    SeriesSpec,
    SpendConfig,
    TrendConfig,
)
from metricwatch.operators import modeling, retention, spend, stats, trend
from metricwatch.operators.anomalies import alerts, label_anomalies, layer_predictions
from metricwatch.operators.series import AsOf, all_series
from metricwatch.sources import Sources, cut_lineage
from metricwatch.sources.catalog import write_alerts, write_by_series


def daily_metrics(sources: Sources, specs: tuple[SeriesSpec, ...], as_of: AsOf) -> DataFrame:
    """All configured daily series, computed once.

    The event tables are read here and nowhere after; the written rows are series x days.
    """
    return cut_lineage(all_series(sources.table, specs, as_of))


def anomaly_report(
    sources: Sources, specs: tuple[SeriesSpec, ...], as_of: AsOf, cfg: TrendConfig = ANOMALY_TREND
) -> DataFrame:
    """Every day of every series with its expected band, anomaly label and importance."""
    series = daily_metrics(sources, specs, as_of)
    return label_anomalies(trend.score_history(series, trend.fit_trend(series, cfg), cfg)).orderBy("series", "ds")


def publish_anomalies(report: DataFrame, folder: str, as_of: date, lookback_days: int | None = None, min_importance: float = 0.0) -> DataFrame:
    """Store an anomaly report by series and its alerts under the run's date; returns the alerts."""
    write_by_series(report, f"{folder}/series")
    found = alerts(report, as_of, lookback_days, min_importance)
    write_alerts(found, f"{folder}/alerts", as_of)
    return found


def spend_report(sources: Sources, cfg: SpendConfig) -> DataFrame:
    """Cost of each data model per day, ranked."""
    return spend.spend_report(sources.table("query_history"), cfg)


@dataclass
class SpendForecast:
    forecast: DataFrame
    monthly: DataFrame
    total: DataFrame


def spend_outlook(
    sources: Sources,
    spec: SeriesSpec,
    as_of: date,
    horizon_days: int = OUTLOOK_DAYS,
    cfg: TrendConfig = YEAR_AHEAD_TREND,
) -> DataFrame:
    """Spend history with its band and the coming days."""
    series = daily_metrics(sources, (spec,), as_of)
    models = cut_lineage(trend.fit_trend(series, cfg))
    return trend.forecast(series, cfg, horizon_days, models).orderBy("ds")


def forecast_layer(forecast: DataFrame, chart: str) -> DataFrame:
    """Predicted days of a forecast from the first one that the named chart shows."""
    return layer_predictions(forecast, PREDICTION_CUTOFFS[chart])


def spend_forecast(
    sources: Sources,
    spec: SeriesSpec,
    as_of: date,
    until: date = SPEND_UNTIL,
    cutoff: date = SPEND_CUTOFF,
    cfg: TrendConfig = BUDGET_TREND,
) -> SpendForecast:
    """Spend with bounds up to ``until``, its monthly sums and its total from a cutoff day on."""
    # Simulated once; the sums read the written rows.
    days = cut_lineage(spend_outlook(sources, spec, as_of, trend.horizon_until(until, as_of), cfg))
    return SpendForecast(
        days, stats.monthly_resample(days, cutoff), stats.fiscal_total(days, cutoff)
    )


def workspace_base(sources: Sources, as_of: date) -> DataFrame:
    return retention.workspaces(
        sources.table("server_fact"),
        sources.table("excludable_servers"),
        sources.table("license_server_fact"),
        as_of,
    )


def retention_report(sources: Sources, as_of: date) -> DataFrame:
    """Workspace feature table."""
    return retention.retention_features(
        workspace_base(sources, as_of),
        sources.table("server_daily_details_ext"),
        sources.table("telemetry"),
        sources.table("incident_events"),
        sources.table("plugin_events"),
        sources.table("public_domains"),
    )


def active_target(share: float = ACTIVE_SHARE) -> Column:
    return F.col("pct_active") >= share


def posts_target(posts: int = POSTS_TARGET) -> Column:
    return F.col("posts_events_alltime") >= posts


@dataclass
class EngagementStudy:
    scores: DataFrame
    best: DataFrame
    report: DataFrame
    importance: DataFrame


def engagement_study(
    features: DataFrame,
    target: Column | None = None,
    cfg: ModelSettings = ModelSettings(),
    models: tuple[str, ...] | None = None,
    importance_model: str = "XGB",
    drop_extra: tuple[str, ...] = (),
) -> EngagementStudy:
    """Compare classifiers of an active workspace and rank its features."""
    columns = modeling.feature_columns(features, drop_extra)
    rows = modeling.labelled_rows(features, active_target() if target is None else target, columns)
    scores, fitted, predictions = modeling.compare_models(cut_lineage(rows), cfg, models)
    return EngagementStudy(
        scores,
        modeling.select_best(scores),
        modeling.classification_report(predictions, by=("model",)),
        modeling.feature_importance(fitted[importance_model], columns, features.sparkSession),
    )
