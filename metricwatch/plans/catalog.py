"""Named queries over one data folder: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricwatch.config import (
    ANOMALY_TREND,
    BUDGET_TREND,
    FOLDS,
    LINE_TREND,
    ModelSettings,
    STIFF_TREND,
    YEAR_AHEAD_TREND,
)
from metricwatch.functions import nice_bytes
from metricwatch.operators import anomalies, grouped, modeling, retention, sketches, spend, stats, trend
from metricwatch.operators.baseline import band_baseline
from metricwatch.operators.knn import nearest_neighbours
from metricwatch.operators.ranking import dense_ranks
from metricwatch.operators.series import all_series, daily_series, human_visits
from metricwatch.plans import reports
from metricwatch.sources import StandInSources, cut_lineage, new_folder
from metricwatch.sources.standins import (
    EVENTS_AS_OF,
    ORDERS_AS_OF,
    STAND_IN_SERIES,
    STAND_IN_SPEND,
    as_of_for,
)

SPECS = {s.name: s for s in STAND_IN_SERIES}
# Cutoffs and thresholds that fit the test tables.
BASELINE_CUTOFF = date(2001, 1, 15)
ALERT_LOOKBACK_DAYS = 10
ACTIVE_SHARE = 0.9
POSTS_RULE = 13
# Forecast target as far after the last spend day as the established job looked ahead.
FORECAST_UNTIL = date(2002, 9, 30)
FORECAST_CUTOFF = date(2001, 8, 1)
NEIGHBOURS = ModelSettings().neighbours
LINE_AHEAD_DAYS = 365
# Standard errors that a quantile of simulated draws may be off.
QUANTILE_ERRORS = 6

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for output; the order of float additions is not part of a result."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _series(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    specs = [SPECS[n] for n in names] if names else STAND_IN_SERIES
    return all_series(StandInSources(spark, sf_dir).table, specs, as_of_for)


# ---- daily series ----------------------------------------------------------


@query
def daily_event_count(spark, sf_dir):
    events = StandInSources(spark, sf_dir).table("usage_events")
    spec = SPECS["usage_event_volume"]
    return daily_series(events, spec.ts, F.count(F.lit(1)), EVENTS_AS_OF, spec.lower)


@query
def series_sum(spark, sf_dir):
    cost = StandInSources(spark, sf_dir).table("warehouse_cost")
    spec = SPECS["warehouse_spend"]
    return rounded(daily_series(cost, spec.ts, F.sum("dollars_spent"), ORDERS_AS_OF, spec.lower), 2)


@query
def series_active_users(spark, sf_dir):
    return rounded(_series(spark, sf_dir, "usage_active_users", "usage_event_volume"), 2)


@query
def series_avg_filtered(spark, sf_dir):
    return rounded(_series(spark, sf_dir, "nps_user_score"))


@query
def series_distinct_visitors(spark, sf_dir):
    return _series(spark, sf_dir, "unique_visitors")


@query
def series_approx_visitors(spark, sf_dir):
    spec = replace(SPECS["unique_visitors"], measure="approx_distinct")
    return all_series(StandInSources(spark, sf_dir).table, [spec], as_of_for)


@query
def visitors_by_span(spark, sf_dir):
    # Distinct visitors of weeks, months and years from daily sketches, held against exact counts.
    visits = StandInSources(spark, sf_dir).table("daily_website_traffic").select("event_ts", "anonymous_id")
    days = cut_lineage(sketches.daily_sketches(visits, "event_ts", "anonymous_id"))
    exact = visits.where("anonymous_id IS NOT NULL").select(F.to_date("event_ts").alias("ds"), "anonymous_id").distinct()
    parts = []
    for span in sketches.SPANS:
        counted = exact.groupBy(F.date_trunc(span, "ds").cast("date").alias("start")).agg(F.count_distinct("anonymous_id").alias("visitors"))
        parts.append(
            sketches.distinct_by_span(days, span).join(counted, "start")
            .select(F.lit(span).alias("span"), "start", "visitors", sketches.within(F.col("distinct"), F.col("visitors")).alias("within"))
        )
    return reduce(DataFrame.unionByName, parts)


@query
def series_pageviews(spark, sf_dir):
    return _series(spark, sf_dir, "pageviews")


@query
def series_inclusive_bound(spark, sf_dir):
    # The inclusive series also holds the as-of day; the exclusive one does not.
    last_day = date(2001, 8, 1)
    sources = StandInSources(spark, sf_dir)
    pair = [SPECS["invoice_updates"], SPECS["invoice_creations"]]
    return all_series(sources.table, pair, last_day)


@query
def series_in_list(spark, sf_dir):
    return _series(
        spark, sf_dir, "mobile_events", "webapp_events_rudder", "webapp_events_segment", "portal_events"
    )


@query
def series_server_details(spark, sf_dir):
    return _series(
        spark, sf_dir, "server_details_ext", "server_details", "server_security_details", "server_server_details"
    )


@query
def series_concat_date(spark, sf_dir):
    return _series(spark, sf_dir, "downloads")


@query
def series_unused_sources(spark, sf_dir):
    return _series(spark, sf_dir, "server_telemetry", "marketing_pages", "portal_pages", "nps_feedback")


@query
def human_visits_by_agent(spark, sf_dir):
    sources = StandInSources(spark, sf_dir)
    visits = human_visits(sources.table("daily_website_traffic"), sources.table("user_agent_registry"))
    return visits.groupBy("context_useragent").agg(F.count(F.lit(1)).alias("visits"))


@query
def all_series_long(spark, sf_dir):
    return rounded(_series(spark, sf_dir), 5)


# ---- bands, anomalies, layers ----------------------------------------------


def _baseline(spark, sf_dir) -> DataFrame:
    return band_baseline(_series(spark, sf_dir))


def _labelled(spark, sf_dir) -> DataFrame:
    # Labels compare rounded numbers, so that a value on the bound falls alike everywhere.
    return anomalies.label_anomalies(rounded(_baseline(spark, sf_dir), 4))


@query
def band_baseline_all(spark, sf_dir):
    return rounded(_baseline(spark, sf_dir), 4)


@query
def anomaly_labels(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query
def alert_rows(spark, sf_dir):
    return anomalies.alerts(_labelled(spark, sf_dir), EVENTS_AS_OF, ALERT_LOOKBACK_DAYS, 0.01)


@query
def layer_band(spark, sf_dir):
    return anomalies.layer_band(rounded(_baseline(spark, sf_dir), 4))


@query
def layer_facts(spark, sf_dir):
    return anomalies.layer_facts(_labelled(spark, sf_dir), normal_only=True)


@query
def layer_anomalies(spark, sf_dir):
    return anomalies.layer_anomalies(_labelled(spark, sf_dir))


@query
def layer_predictions(spark, sf_dir):
    return anomalies.layer_predictions(rounded(_baseline(spark, sf_dir), 4), BASELINE_CUTOFF)


@query
def monthly_resample(spark, sf_dir):
    days = band_baseline(_series(spark, sf_dir, "warehouse_spend"))
    return rounded(stats.monthly_resample(days, BASELINE_CUTOFF), 2)


@query
def fiscal_total(spark, sf_dir):
    days = band_baseline(_series(spark, sf_dir, "warehouse_spend"))
    return rounded(stats.fiscal_total(days, BASELINE_CUTOFF), 2)


# ---- spend -----------------------------------------------------------------

# Milliseconds / 3.6e6 never lies halfway between two 8-digit decimals.
CREDIT_DIGITS = 8



def _credits_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, CREDIT_DIGITS)


def _statements(spark, sf_dir) -> DataFrame:
    return spend.statements(StandInSources(spark, sf_dir).table("query_history"), STAND_IN_SPEND)


@query
def spend_model_key(spark, sf_dir):
    return _statements(spark, sf_dir).groupBy("model_key", "query_label").agg(
        F.count(F.lit(1)).alias("statements")
    )


@query
def spend_statement_credits(spark, sf_dir):
    return _credits_rounded(
        _statements(spark, sf_dir).select(
            "start_date", "model_key", "warehouse_name", "query_type", "credits", "compute_credits"
        )
    )


@query
def spend_daily(spark, sf_dir):
    daily = spend.daily_costs(_statements(spark, sf_dir))
    return _credits_rounded(
        daily.select(
            "start_date", "model_key",
            spend.credits_of("rated_ms", "cloud_credits").alias("credits_day"),
            "min_build_credits", "elapsed_time",
            "rows_produced", "rows_unloaded", "rows_inserted", "rows_updated", "rows_deleted",
            "max_bytes", "bytes",
        )
    )


@query
def spend_day_top(spark, sf_dir):
    daily = spend.daily_costs(_statements(spark, sf_dir))
    return _credits_rounded(
        daily.select(
            "start_date", "model_key",
            F.col("top.credits").alias("credits"),
            F.col("top.warehouse_name").alias("warehouse_name"),
            F.col("top.query_label").alias("query_label"),
            F.col("top.query_type").alias("query_type"),
        )
    )


@query
def spend_alltime(spark, sf_dir):
    return _credits_rounded(spend.alltime_costs(spend.daily_costs(_statements(spark, sf_dir))))


@query
def spend_month_rank(spark, sf_dir):
    daily = spend.daily_costs(_statements(spark, sf_dir))
    monthly = daily.groupBy(F.trunc("start_date", "MM").alias("month"), "model_key").agg(
        spend.credits_of(F.sum("rated_ms"), F.sum("cloud_credits")).alias("credits")
    )
    return _credits_rounded(dense_ranks(monthly, ["month"], "credits", "rank"))


@query
def spend_total(spark, sf_dir):
    daily = spend.daily_costs(_statements(spark, sf_dir))
    return _credits_rounded(spend.total_cost(daily, STAND_IN_SPEND))


@query
def spend_windows(spark, sf_dir):
    daily = cut_lineage(spend.daily_costs(_statements(spark, sf_dir)))
    top = [f"top.{c}" for c in ("credits", "query_label", "warehouse_name", "query_type", "compute_credits")]
    return _credits_rounded(
        spend.ranked_models(daily).select(
            "start_date", "database_name", "model_key", *top,
            "max_credits_alltime", "credits_alltime", "bytes_alltime", "min_build_credits", "credits_day",
            "elapsed_time", "rows_produced", "rows_unloaded", "rows_inserted", "rows_updated", "rows_deleted",
            "max_bytes",
        )
    )


@query
def spend_report(spark, sf_dir):
    return _credits_rounded(reports.spend_report(StandInSources(spark, sf_dir), STAND_IN_SPEND))


@query
def nice_bytes_sizes(spark, sf_dir):
    log = StandInSources(spark, sf_dir).table("query_history")
    n = F.col("bytes_scanned")
    sizes = log.select(F.explode(F.array(n, n * 1000, F.pmod(n, F.lit(2000)))).alias("n"))
    return sizes.groupBy("n").agg(F.count(F.lit(1)).alias("statements")).withColumn("size", nice_bytes("n"))


# ---- retention -------------------------------------------------------------


def _base(spark, sf_dir) -> DataFrame:
    return reports.workspace_base(StandInSources(spark, sf_dir), EVENTS_AS_OF)


def _features(spark, sf_dir) -> DataFrame:
    return reports.retention_report(StandInSources(spark, sf_dir), EVENTS_AS_OF)


@query
def workspace_base(spark, sf_dir):
    return rounded(_base(spark, sf_dir))


@query
def days_to_threshold(spark, sf_dir):
    return retention.days_to_threshold(
        StandInSources(spark, sf_dir).table("server_daily_details_ext"), _base(spark, sf_dir)
    )


@query
def post_users(spark, sf_dir):
    telemetry = StandInSources(spark, sf_dir).table("telemetry")
    return rounded(retention.post_users(telemetry, _base(spark, sf_dir)))


@query
def post_users_minimum(spark, sf_dir):
    telemetry = StandInSources(spark, sf_dir).table("telemetry")
    return rounded(retention.post_users(telemetry, _base(spark, sf_dir), min_users=7))


@query
def incident_usage(spark, sf_dir):
    events = StandInSources(spark, sf_dir).table("incident_events")
    return retention.usage(events, _base(spark, sf_dir), "incident_mgmt", "used_incident_mgmt")


@query
def plugin_usage(spark, sf_dir):
    events = StandInSources(spark, sf_dir).table("plugin_events")
    return retention.usage(events, _base(spark, sf_dir), "plugin", "used_plugins")


@query
def private_domain(spark, sf_dir):
    return _features(spark, sf_dir).groupBy("email_domain", "private_domain").agg(
        F.count(F.lit(1)).alias("workspaces")
    )


@query
def retention_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir))


@query
def dropna_count(spark, sf_dir):
    return stats.dropna_count(_features(spark, sf_dir))


@query
def feature_describe(spark, sf_dir):
    return rounded(stats.describe(stats.drop_incomplete(_features(spark, sf_dir))))


@query
def feature_describe_active(spark, sf_dir):
    rows = stats.drop_incomplete(_features(spark, sf_dir)).where(reports.active_target(ACTIVE_SHARE))
    return rounded(stats.describe(rows))


@query
def feature_corr(spark, sf_dir):
    return rounded(stats.correlation(stats.drop_incomplete(_features(spark, sf_dir))))


# ---- model comparison ------------------------------------------------------


def _model_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    features = _features(spark, sf_dir)
    columns = modeling.feature_columns(features)
    rows = modeling.labelled_rows(features, reports.active_target(ACTIVE_SHARE), columns)
    return rows, columns


@query
def split_sizes(spark, sf_dir):
    rows = stats.drop_incomplete(_features(spark, sf_dir))
    return rows.groupBy(
        modeling.test_row("server_id").alias("is_test"), modeling.fold_of("server_id").alias("fold")
    ).agg(F.count(F.lit(1)).alias("workspaces"))


@query
def target_counts(spark, sf_dir):
    rows = stats.drop_incomplete(_features(spark, sf_dir))
    return rows.groupBy(
        reports.active_target(ACTIVE_SHARE).alias("active"), reports.posts_target(POSTS_RULE).alias("posting")
    ).agg(F.count(F.lit(1)).alias("workspaces"))


@query
def classification_report_counts(spark, sf_dir):
    # A fixed rule as prediction, so the report can be checked number by number.
    rows = stats.drop_incomplete(_features(spark, sf_dir)).select(
        reports.active_target(ACTIVE_SHARE).cast("double").alias("label"),
        reports.posts_target(POSTS_RULE).cast("double").alias("prediction"),
    )
    return rounded(modeling.classification_report(rows))


def _neighbour_pairs(spark, sf_dir) -> DataFrame:
    # Row hashes differ between engines: keep the workspace part of the ids.
    rows, _ = _model_rows(spark, sf_dir)
    rows = cut_lineage(rows.select("id", vector_to_array("features").alias("x"), "label", "is_test"))
    pairs = nearest_neighbours(
        rows.where("is_test").dropDuplicates(["id"]), rows.where("NOT is_test"), NEIGHBOURS
    )
    workspace = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    return pairs.select(workspace("id").alias("server_id"), workspace("n_id").alias("n_server_id"), "n_label", "d")


@query
def knn_neighbours(spark, sf_dir):
    return rounded(
        _neighbour_pairs(spark, sf_dir)
        .groupBy("server_id")
        .agg(F.count(F.lit(1)).alias("neighbours"), F.min("d").alias("nearest"), F.max("d").alias("farthest"))
    )


@query
def knn_neighbour_ids(spark, sf_dir):
    # Who the neighbours are; equal distances go in id order.
    pairs = _neighbour_pairs(spark, sf_dir).groupBy("server_id", "n_server_id", "n_label")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("d"), 6).alias("d"))


# The study of a data folder, kept for the queries that show its parts; all six models, full settings.
_STUDIES: dict[tuple[str, str], reports.EngagementStudy] = {}


def _study(spark, sf_dir) -> reports.EngagementStudy:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        study = reports.engagement_study(_features(spark, sf_dir), reports.active_target(ACTIVE_SHARE))
        _STUDIES[key] = replace(study, report=cut_lineage(study.report))
    return _STUDIES[key]


@query
def compare_models(spark, sf_dir):
    return _study(spark, sf_dir).scores


@query
def model_report(spark, sf_dir):
    return _study(spark, sf_dir).report


@query
def best_model(spark, sf_dir):
    return _study(spark, sf_dir).best


@query
def feature_importance(spark, sf_dir):
    rows, columns = _model_rows(spark, sf_dir)
    return modeling.boosted_importance(rows, columns)


@query
def engagement_study(spark, sf_dir):
    # Scores, report and importance of one study, as (part, model, item, measure, value).
    study = _study(spark, sf_dir)
    measures = ("precision", "recall", "f1")
    value = lambda m: F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
    scored = ("test_accuracy", "test_precision_weighted", "test_recall_weighted", "test_f1_weighted", "test_roc_auc")
    parts = [
        study.scores.select(F.lit("fold").alias("part"), "model", F.col("fold").cast("string").alias("item"), F.explode(F.array(*map(value, scored))).alias("v")),
        study.report.select(F.lit("report").alias("part"), "model", F.col("class").alias("item"), F.explode(F.array(*map(value, measures))).alias("v")),
        study.importance.select(F.lit("importance").alias("part"), F.lit("XGB").alias("model"), F.col("feature").alias("item"), F.struct(F.lit("importance").alias("measure"), F.col("importance").alias("value")).alias("v")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("part", "model", "item", "v.*")


@query
def gnb_fold_counts(spark, sf_dir):
    rows, _ = _model_rows(spark, sf_dir)
    return modeling.held_out_counts(cut_lineage(rows), "GNB")


@query
def knn_fold_counts(spark, sf_dir):
    rows, _ = _model_rows(spark, sf_dir)
    return modeling.held_out_counts(cut_lineage(rows), "KNN")


@query
def fold_scores(spark, sf_dir):
    # The classifiers that SQL can fit too: scores of every fold in one frame.
    rows, _ = _model_rows(spark, sf_dir)
    return rounded(modeling.fold_scores(modeling.held_out(cut_lineage(rows), ("KNN", "GNB"))))


@query
def logistic_optimum(spark, sf_dir):
    # Every coefficient of every fold's logistic regression stands where the penalised loss is flat.
    rows, columns = _model_rows(spark, sf_dir)
    train = cut_lineage(modeling.grouped_rows(rows).where("NOT is_test").select("x", "label", "fold"))
    fit = grouped.logistic(train, FOLDS + 1, len(columns))
    slopes = grouped.logistic_gradients(train, fit.detail)
    return slopes.select("group", "term", (F.abs("slope") <= 1e-6 * (1 + F.col("size"))).alias("flat"))


@query
def svm_kernel_error(spark, sf_dir):
    # What the support vector classifier's basis makes of the kernel: its mean over all pairs of training rows, taken
    # from summed features, and whether the mean error is within the tolerance.
    rows, _ = _model_rows(spark, sf_dir)
    error = modeling.kernel_error(rows)
    within = F.col("mean_residual") <= ModelSettings().svm_tolerance
    return error.select("n_rows", F.round("mean_kernel", 3).alias("mean_kernel"), within.alias("within"))


def _closed_study(spark, sf_dir):
    # The classifiers that SQL can fit too, through the whole comparison: folds, final fits, test predictions.
    rows, _ = _model_rows(spark, sf_dir)
    return modeling.compare_models(cut_lineage(rows), models=("KNN", "GNB"))


@query
def closed_form_report(spark, sf_dir):
    # The final fits of all training rows, judged on the test rows.
    _, _, predictions = _closed_study(spark, sf_dir)
    return rounded(modeling.classification_report(predictions, by=("model",)))


@query
def closed_form_best(spark, sf_dir):
    # Models by mean ROC area of the folds, best first.
    scores, _, _ = _closed_study(spark, sf_dir)
    return rounded(modeling.select_best(scores))


@query
def fold_support(spark, sf_dir):
    # Training rows per fold and class: what every classifier of the study is scored on.
    rows, _ = _model_rows(spark, sf_dir)
    return rows.where("NOT is_test").groupBy("fold", "label").agg(F.count(F.lit(1)).alias("support"))


# ---- trend model -----------------------------------------------------------


def _spend_series(spark, sf_dir) -> DataFrame:
    return cut_lineage(_series(spark, sf_dir, "warehouse_spend"))


@query
def design_row(spark, sf_dir):
    rows = trend.scaled_rows(_series(spark, sf_dir, "warehouse_spend", "usage_event_volume"), YEAR_AHEAD_TREND)
    x = trend.design_row(F.col("t"), F.col("ds"), F.col("changepoints"), YEAR_AHEAD_TREND)
    return rounded(rows.select("series", "ds", F.posexplode(x).alias("term", "value")))


@query
def changepoint_days(spark, sf_dir):
    rows = trend.scaled_rows(_series(spark, sf_dir), ANOMALY_TREND)
    points = rows.select("series", "first_ds", "span", "changepoints").distinct()
    return (
        points.select("series", "first_ds", "span", F.explode("changepoints").alias("t"))
        .where(F.col("t").isNotNull())
        .select("series", F.date_add("first_ds", F.rint(F.col("t") * F.col("span")).cast("int")).alias("ds"))
    )


@query
def future_days(spark, sf_dir):
    series = _spend_series(spark, sf_dir)
    models = trend.fit_trend(series, YEAR_AHEAD_TREND)
    ahead = trend.horizon_until(FORECAST_UNTIL, ORDERS_AS_OF)
    return series.select("series", "ds").unionByName(trend.future_days(models, ahead).select("series", "ds"))


@query
def trend_fit(spark, sf_dir):
    models = trend.fit_trend(cut_lineage(_series(spark, sf_dir)), ANOMALY_TREND)
    return models.select("series", "first_ds", "last_ds", "n_obs", "sigma", "status")


@query
def trend_fit_status(spark, sf_dir):
    models = trend.fit_trend(cut_lineage(_series(spark, sf_dir)), ANOMALY_TREND)
    return models.select("series", "first_ds", "last_ds", "n_obs", "status")


@query
def trend_fit_gradient(spark, sf_dir):
    # Every coefficient of every series' fit stands at its optimum.
    series = cut_lineage(_series(spark, sf_dir))
    models = cut_lineage(trend.fit_trend(series, ANOMALY_TREND))
    return trend.fit_gradients(series, models, ANOMALY_TREND).select("series", "term", "optimal")


@query
def trend_line(spark, sf_dir):
    # The plain line that remains without slope changes and seasons: closed-form but for the noise.
    series = cut_lineage(_series(spark, sf_dir))
    models = trend.fit_trend(series, LINE_TREND)
    return models.select(
        "series", "n_obs", "status",
        *[F.round(F.get("beta", F.lit(i)), 5).alias(name) for i, name in enumerate(("start", "growth"))],
        F.round("sigma", 5).alias("sigma"),
    )


@query
def trend_line_band(spark, sf_dir):
    # Expected value and band of each day around that line, in parts of the series' largest value.
    series = cut_lineage(_series(spark, sf_dir))
    models = cut_lineage(trend.fit_trend(series, LINE_TREND))
    band = trend.score_history(series, models, LINE_TREND).join(models.select("series", "y_scale"), "series", "left")
    return band.select(
        "series", "ds", F.round("fact", 4).alias("fact"), *[F.round(F.col(c) / F.col("y_scale"), 4).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")]
    )


@query
def trend_gradient_seasonal(spark, sf_dir):
    # The same test for the configurations with yearly terms: outlook, budget and the stiff alternative.
    series = _spend_series(spark, sf_dir)
    configs = {"outlook": YEAR_AHEAD_TREND, "budget": BUDGET_TREND, "stiff": STIFF_TREND}
    slopes = [
        trend.fit_gradients(series, cut_lineage(trend.fit_trend(series, cfg)), cfg).select(
            F.lit(name).alias("config"), "series", "term", "optimal"
        )
        for name, cfg in configs.items()
    ]
    return reduce(DataFrame.unionByName, slopes)


@query
def forecast_line(spark, sf_dir):
    # Every series' straight line over its days and a year more, in parts of its largest value.  Without slope changes
    # the simulated bounds are those of the noise but for the error of the draws' quantiles.
    series = cut_lineage(_series(spark, sf_dir))
    models = cut_lineage(trend.fit_trend(series, LINE_TREND))
    days = trend.forecast(series, LINE_TREND, LINE_AHEAD_DAYS, models)
    scaled = days.join(models.select("series", "sigma", "y_scale", "last_seen"), "series", "left")
    future = F.col("ds") > F.col("last_seen")
    slack = F.when(future, trend.quantile_error(LINE_TREND) * QUANTILE_ERRORS).otherwise(1e-9)
    z = trend.interval_z(LINE_TREND.interval_width)

    def near(bound: str, side: int):
        away = (F.col(bound) - F.col("yhat")) / F.col("y_scale") - side * z * F.col("sigma")
        return F.abs(away) <= slack * F.col("sigma") + 1e-9

    return scaled.select(
        "series", "ds", F.coalesce(future, F.lit(False)).alias("ahead"), F.round("fact", 4).alias("fact"),
        *[F.round(F.col(c) / F.col("y_scale"), 4).alias(c) for c in ("trend", "yhat")],
        (near("yhat_lower", -1) & near("yhat_upper", 1)).alias("bounded"),
    )


def _budget_line(spark, sf_dir) -> tuple[reports.SpendForecast, DataFrame]:
    done = reports.spend_forecast(
        StandInSources(spark, sf_dir), SPECS["warehouse_spend"], ORDERS_AS_OF, FORECAST_UNTIL, FORECAST_CUTOFF, LINE_TREND
    )
    return done, done.forecast.groupBy("series").agg(F.max(F.abs("fact")).alias("scale"))


@query
def forecast_line_monthly(spark, sf_dir):
    # Monthly sums of the line's budget forecast, in parts of the largest day.
    done, scale = _budget_line(spark, sf_dir)
    return done.monthly.join(scale, "series").select(
        "series", "month_end", *[F.round(F.col(c) / F.col("scale"), 4).alias(c) for c in ("trend", "yhat", "fact")],
        ((F.col("yhat_lower") < F.col("yhat")) & (F.col("yhat") < F.col("yhat_upper"))).alias("inside"),
    )


@query
def forecast_line_total(spark, sf_dir):
    done, scale = _budget_line(spark, sf_dir)
    return done.total.join(scale, "series").select(
        "series", *[F.round(F.col(c) / F.col("scale"), 4).alias(c) for c in ("trend", "yhat", "fact")],
        ((F.col("yhat_lower") < F.col("yhat")) & (F.col("yhat") < F.col("yhat_upper"))).alias("inside"),
    )


@query
def forecast_parts(spark, sf_dir):
    # The budget forecast, day by day: its trend, weekly and yearly parts add up to the expected value, which lies inside
    # its bounds, and only past days have facts.
    series = _spend_series(spark, sf_dir)
    models = cut_lineage(trend.fit_trend(series, BUDGET_TREND))
    days = cut_lineage(trend.forecast(series, BUDGET_TREND, trend.horizon_until(FORECAST_UNTIL, ORDERS_AS_OF), models))
    parts = trend.components(days, models, BUDGET_TREND).groupBy("series", "ds").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("value").alias("whole"),
        F.sum(F.when(F.col("component") == "trend", F.col("value"))).alias("base"),
    )
    size = F.greatest(F.abs("yhat"), F.abs("trend"), F.lit(1.0)) * 1e-9
    return days.join(parts, ["series", "ds"]).select(
        "series", "ds", "parts", F.col("fact").isNotNull().alias("observed"),
        ((F.abs(F.col("whole") - F.col("yhat")) <= size) & (F.abs(F.col("base") - F.col("trend")) <= size)).alias("adds_up"),
        ((F.col("yhat_lower") < F.col("yhat")) & (F.col("yhat") < F.col("yhat_upper"))).alias("inside"),
    )


@query
def forecast_slope_changes(spark, sf_dir):
    # The budget trend bends at each changepoint by the slope change reported there: the trend of the day before, the
    # day itself and the day after, against the table of changepoints.
    series = _spend_series(spark, sf_dir)
    models = cut_lineage(trend.fit_trend(series, BUDGET_TREND))
    points = trend.changepoints(models, BUDGET_TREND)
    around = points.select("series", F.col("ds").alias("point"), "slope_change", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("step"))
    around = cut_lineage(around.withColumn("ds", F.date_add("point", F.col("step"))))
    base = trend.components(around.select("series", "ds").distinct(), models, BUDGET_TREND).where("component = 'trend'")
    bend = F.sum(F.when(F.col("step") == 0, -2 * F.col("value")).otherwise(F.col("value")))
    bent = around.join(base, ["series", "ds"]).groupBy("series", "point").agg(
        bend.alias("bend"), F.max("slope_change").alias("slope_change"), F.max(F.abs("value")).alias("size")
    )
    return bent.select(
        "series", F.col("point").alias("ds"), (F.abs(F.col("bend") - F.col("slope_change")) <= 1e-9 * F.col("size")).alias("bends"),
    )


def _line_report(spark, sf_dir) -> DataFrame:
    return reports.anomaly_report(StandInSources(spark, sf_dir), STAND_IN_SERIES, as_of_for, LINE_TREND)


@query
def anomaly_report_line(spark, sf_dir):
    # The whole report with the model that SQL can fit too.
    return _line_report(spark, sf_dir).select("series", "ds", F.round("fact", 4).alias("fact"), "anomaly", F.round("importance", 4).alias("importance"))


@query
def published_alerts(spark, sf_dir):
    # That report and its alerts, stored and read back: the series' folders against the alerts of the run's date.
    folder = new_folder(spark, "published")
    report = cut_lineage(_line_report(spark, sf_dir))
    reports.publish_anomalies(report, folder, EVENTS_AS_OF)
    scale = spark.read.parquet(f"{folder}/series").groupBy("series").agg(F.max(F.abs("fact")).alias("scale"))
    return spark.read.parquet(f"{folder}/alerts").join(scale, "series").select(
        "as_of", "series", "ds", F.round("fact", 4).alias("fact"), F.round(F.col("bound") / F.col("scale"), 4).alias("bound"),
        "direction", F.round("importance", 4).alias("importance"),
    )


@query
def report_order(spark, sf_dir):
    # Rows of each sorted report, and how many of them come before their predecessor.
    sources = StandInSources(spark, sf_dir)
    rows, columns = _model_rows(spark, sf_dir)
    reported = {
        "anomalies": (_line_report(spark, sf_dir), [F.col("series"), F.col("ds")], (True, True)),
        "spend": (
            spend.spend_report(sources.table("query_history"), STAND_IN_SPEND),
            [F.coalesce("cash_money_alltime", F.lit(float("-inf"))), F.unix_micros(F.col("start_time").cast("timestamp"))],
            (False, False),
        ),
        "importance": (modeling.boosted_importance(rows, columns), [F.col("importance"), F.col("feature")], (False, True)),
    }
    found = [
        stats.out_of_order(df, keys, ascending).select(F.lit(name).alias("report"), "rows", "out_of_order")
        for name, (df, keys, ascending) in reported.items()
    ]
    return reduce(DataFrame.unionByName, found)


@query
def trend_fit_stiff(spark, sf_dir):
    models = trend.fit_trend(_spend_series(spark, sf_dir), STIFF_TREND)
    return models.select("series", "first_ds", "last_ds", "n_obs", "sigma", "status")


@query
def trend_history_band(spark, sf_dir):
    series = cut_lineage(_series(spark, sf_dir))
    return trend.score_history(series, trend.fit_trend(series, ANOMALY_TREND), ANOMALY_TREND)


@query
def anomaly_report(spark, sf_dir):
    return reports.anomaly_report(StandInSources(spark, sf_dir), STAND_IN_SERIES, as_of_for)


@query
def forecast_365(spark, sf_dir):
    return reports.spend_outlook(StandInSources(spark, sf_dir), SPECS["warehouse_spend"], ORDERS_AS_OF)


def _budget(spark, sf_dir) -> reports.SpendForecast:
    return reports.spend_forecast(
        StandInSources(spark, sf_dir), SPECS["warehouse_spend"], ORDERS_AS_OF, FORECAST_UNTIL, FORECAST_CUTOFF
    )


@query
def forecast_until(spark, sf_dir):
    return _budget(spark, sf_dir).forecast


@query
def forecast_monthly(spark, sf_dir):
    return _budget(spark, sf_dir).monthly


@query
def forecast_total(spark, sf_dir):
    return _budget(spark, sf_dir).total


@query
def forecast_components(spark, sf_dir):
    series = _spend_series(spark, sf_dir)
    return trend.components(series, trend.fit_trend(series, BUDGET_TREND), BUDGET_TREND)


@query
def forecast_changepoints(spark, sf_dir):
    return trend.changepoints(trend.fit_trend(_spend_series(spark, sf_dir), BUDGET_TREND), BUDGET_TREND)
