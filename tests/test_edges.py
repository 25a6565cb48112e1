"""Small frames for NULLs, ties, fan-out and other traps."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from metricwatch.config import SeriesSpec, SpendConfig
from metricwatch.functions import (
    above_floor,
    email_domain,
    model_name,
    nice_bytes,
    not_spider,
    ratio_or_zero,
    warehouse_rate,
)
from metricwatch.operators import anomalies, retention, series, sketches, spend, stats
from metricwatch.schemas import conform
from metricwatch.sources import Sources, cut_lineage
from metricwatch.sources.catalog import write_alerts, write_by_series


def values(df, column):
    return [r[column] for r in df.collect()]


def test_scalars(spark):
    row = spark.range(1).select(
        above_floor(F.lit(None).cast("int"), 3).alias("null_floor"),
        above_floor(F.lit(1), 3).alias("floor"),
        above_floor(F.lit(5), 3).alias("above"),
        ratio_or_zero(F.lit(1), F.lit(0)).alias("by_zero"),
        ratio_or_zero(F.lit(1), F.lit(4)).alias("quarter"),
        email_domain(F.lit("a@b.c")).alias("domain"),
        email_domain(F.lit("none")).alias("no_domain"),
        not_spider(F.lit(None).cast("string")).alias("unknown"),
        not_spider(F.lit("Spider")).alias("spider"),
        warehouse_rate(F.lit(None).cast("string"), {"L": 8}, 1).alias("null_rate"),
        warehouse_rate(F.lit("L"), {"L": 8}, 1).alias("rate"),
        nice_bytes(F.lit(1023)).alias("b"),
        nice_bytes(F.lit(1152)).alias("kb"),
        nice_bytes(F.lit(1024**2 - 1)).alias("carry"),
        nice_bytes(F.lit(None).cast("bigint")).alias("no_bytes"),
    ).head()
    assert row.null_floor is None and (row.floor, row.above) == (0, 2)
    assert (row.by_zero, row.quarter) == (0.0, 0.25)
    assert (row.domain, row.no_domain) == ("b.c", "")
    assert row.unknown is True and row.spider is False
    assert (row.null_rate, row.rate) == (1, 8)
    assert (row.b, row.kb, row.carry, row.no_bytes) == ("1023 B", "1.13 KB", "1024.00 KB", None)


def test_model_name_patterns(spark):
    cfg = SpendConfig()
    texts = ['create "ANALYTICS"."S"."T"', "insert into Analytics.web.page__dbt_tmp x", "select 1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        model_name("t", cfg.label_pattern, "__dbt_tmp").alias("label"),
        model_name("t", cfg.key_pattern, "__dbt_tmp").alias("key"),
    )
    # The pattern stops at the second separator, and the label needs the quoted name.
    assert [tuple(r) for r in df.collect()] == [
        ('"analytics"."s', '"analytics"."s'),
        (None, "analytics.web.page"),
        (None, None),
        (None, None),
    ]


def test_daily_series_bounds_and_gaps(spark):
    df = spark.createDataFrame(
        [
            (datetime(2020, 1, 1, 23, 59), 1.0), (datetime(2020, 1, 3), None),
            (datetime(2020, 1, 4, 0, 0), 5.0), (datetime(2020, 1, 4, 12, 0), 5.0), (datetime(2019, 12, 31), 9.0),
        ],
        "ts timestamp_ntz, v double",
    )
    spec = SeriesSpec("s", "t", "ts", "sum", "v", lower=date(2020, 1, 1))
    out = series.series_of_source(df, [spec], date(2020, 1, 4)).orderBy("ds")
    # The empty day is absent, a day of NULLs is a NULL, the as-of day is out.
    assert [(r.ds, r.y) for r in out.collect()] == [(date(2020, 1, 1), 1.0), (date(2020, 1, 3), None)]
    inclusive = SeriesSpec("s", "t", "ts", "count", lower=None, inclusive=True)
    out = series.series_of_source(df, [inclusive], date(2020, 1, 4))
    assert {r.ds: r.y for r in out.collect()}[date(2020, 1, 4)] == 2.0


def test_labels_and_importance(spark):
    rows = [
        (5.0, 1.0, 4.0), (0.5, 1.0, 4.0), (2.0, 1.0, 4.0), (None, 1.0, 4.0), (4.0, 1.0, 4.0),
        (0.0, 1.0, 4.0), (0.0, -4.0, -1.0),
    ]
    df = spark.createDataFrame(rows, "fact double, yhat_lower double, yhat_upper double")
    out = anomalies.label_anomalies(df).collect()
    assert [r.anomaly for r in out] == [1, -1, 0, 0, 0, -1, 1]
    assert out[0].importance == pytest.approx(0.2) and out[1].importance == pytest.approx(1.0)
    assert [math.isinf(r.importance) for r in out[5:]] == [True, True]
    assert all((r.importance == 0) == (r.anomaly == 0) for r in out)


def _log(spark, rows):
    names = [
        "start_time", "query_text", "query_type", "warehouse_name", "database_name",
        "credits_used_cloud_services", "total_elapsed_time",
    ]
    df = spark.createDataFrame(
        rows,
        "start_time timestamp_ntz, query_text string, query_type string, warehouse_name string, "
        "database_name string, credits_used_cloud_services double, total_elapsed_time bigint",
    )
    assert df.columns == names
    extra = [F.lit(1).cast("bigint").alias(c) for c in (
        "rows_produced", "rows_unloaded", "rows_inserted", "rows_updated", "rows_deleted", "bytes_scanned",
    )]
    return df.select("*", F.col("start_time").alias("end_time"), *extra)


def test_spend_report_on_a_small_log(spark):
    day, next_day = datetime(2021, 1, 5), datetime(2021, 1, 6)
    hour = 3600000
    log = _log(spark, [
        (day, "create analytics.a.b", "CREATE_TABLE_AS_SELECT", "TRANSFORM_L", "ANALYTICS", 0.5, hour),
        (day, "merge analytics.a.b", "MERGE", "REPORTING_M", "ANALYTICS", 0.25, hour),
        (next_day, "create analytics.a.b__dbt_tmp", "CREATE_TABLE_AS_SELECT", "OTHER", "ANALYTICS", 0.0, hour),
        (day, "call x()", "CALL", "OTHER", "ANALYTICS", 0.0, hour),
        (day, "call y()", "CALL", "OTHER", "ANALYTICS", 0.0, hour),
        (day, "create analytics.a.c", "MERGE", None, "ANALYTICS", 9.0, hour),
        (day, "create analytics.a.c", "MERGE", "STITCH", "ANALYTICS", 9.0, hour),
        (day, "select analytics.a.c", "SELECT", "OTHER", "ANALYTICS", 9.0, hour),
        (day, "create analytics.a.c", "MERGE", "OTHER", "RAW", 9.0, hour),
        (datetime(2020, 11, 30), "create analytics.a.c", "MERGE", "OTHER", "ANALYTICS", 9.0, hour),
    ])
    out = spend.spend_report(log, SpendConfig()).collect()
    got = {(r.start_date.day, r.model_key): r for r in out}
    assert set(got) == {(5, "analytics.a.b"), (6, "analytics.a.b"), (5, None)}
    top = got[5, "analytics.a.b"]
    assert top.max_credits_used_daily == 8.5 and top.min_credits_used_daily == 8.5
    assert top.credits_used_daily == 12.75 and top.most_expensivest
    assert top.cash_money_alltime == pytest.approx(13.75 * 2.58)
    assert not got[6, "analytics.a.b"].most_expensivest
    # Statements without a model share one NULL key; both hours count.
    assert got[5, None].credits_used_daily == 2.0
    assert {r.expensivest_ranking for r in out} == {1, 2}
    assert {round(r.cost_all_jobs, 9) for r in out} == {round(15.75 * 2.58, 9)}
    assert out[0].start_date == date(2021, 1, 6)


def test_spend_report_equals_window_form(spark):
    from metricwatch.sources import StandInSources
    from metricwatch.sources.standins import STAND_IN_SPEND

    log = StandInSources(spark, "/root/testdata/sf0.001").table("query_history")
    day, model = Window.partitionBy("start_date", "model_key"), Window.partitionBy("model_key")
    by_window = (
        spend.statements(log, STAND_IN_SPEND)
        .select(
            "start_date", "model_key", "credits",
            F.sum("credits").over(day).alias("credits_day"),
            F.sum("credits").over(model).alias("credits_alltime"),
            F.sum("total_elapsed_time").over(day).alias("elapsed_time"),
            F.row_number().over(day.orderBy(F.desc("credits"))).alias("day_rank"),
        )
        .where("day_rank = 1")
        .drop("day_rank")
    )
    # Few rows per task: the ranks go through value buckets.
    report = spend.spend_report(log, STAND_IN_SPEND, partitions=50)
    ours = report.select(
        "start_date", "model_key", F.col("max_credits_used_daily").alias("credits"),
        F.col("credits_used_daily").alias("credits_day"),
        (F.col("cash_money_alltime") / 2.58).alias("credits_alltime"),
        F.col("elapsed_time_daily").alias("elapsed_time"),
    )
    key = lambda r: tuple(str(v) for v in r[:2])
    a, b = sorted(by_window.collect(), key=key), sorted(ours.collect(), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:])
    plain = spend.spend_report(log, STAND_IN_SPEND)
    ranks = lambda df: sorted((r.start_date, str(r.model_key), r.expensivest_ranking) for r in df.collect())
    assert ranks(plain) == ranks(report)


def _facts(spark, rows):
    from metricwatch.config import WORKSPACE_COUNTERS

    df = spark.createDataFrame(rows, "server_id string, first_active_date date, installation_id string")
    others = [c for c in WORKSPACE_COUNTERS if c != "max_registered_users"]
    return df.select(
        "*", F.lit(date(2020, 1, 9)).alias("last_telemetry_date"), F.lit(3).alias("days_active"),
        F.lit(1).alias("days_inactive"), F.lit(1).alias("max_active_user_count"),
        F.lit(3).alias("max_registered_users"), *[F.lit(0).alias(c) for c in others],
    )


def test_workspaces_exclusion_and_licences(spark):
    d = date(2020, 1, 1)
    facts = _facts(spark, [("a", d, "i"), ("b", d, "i"), ("c", d, "i"), ("n", d, None)])
    excluded = spark.createDataFrame([("a", None), ("b", "internal")], "server_id string, reason string")
    licences = spark.createDataFrame(
        [("a", "x@one.io", date(2020, 3, 1)), ("a", "x@two.io", date(2020, 3, 1)), ("c", "x@old.io", date(2019, 1, 1))],
        "server_id string, license_email string, license_retired_date date",
    )
    out = retention.workspaces(facts, excluded, licences, date(2020, 2, 1))
    # A NULL reason keeps the workspace, two live licences double it, a retired one gives no domain.
    assert sorted((r.server_id, str(r.email_domain)) for r in out.collect()) == [
        ("a", "one.io"), ("a", "two.io"), ("c", "None"),
    ]


def test_first_and_second_day_events(spark):
    base = spark.createDataFrame([("a", date(2020, 1, 1)), ("a", date(2020, 1, 1)), ("b", date(2020, 1, 1))],
                                 "server_id string, first_active_date date")
    events = spark.createDataFrame(
        [
            (1, datetime(2020, 1, 1, 5), 7, " a ", None, None), (1, datetime(2020, 1, 1, 6), 7, None, "a", None),
            (2, datetime(2020, 1, 1, 7), 7, None, None, "a"), (3, datetime(2020, 1, 2, 7), 7, "a", None, None),
            (4, datetime(2020, 1, 2, 7), 7, "a", None, None), (5, datetime(2020, 1, 5), 8, "a", None, None),
            (6, datetime(2020, 1, 5), None, "b", None, None), (7, datetime(2020, 1, 5), 9, "other", None, None),
        ],
        "id bigint, event_ts timestamp_ntz, user_actual_id bigint, user_id string, context_server string, "
        "context_traits_server string",
    )
    out = {r.server_id: r for r in retention.post_users(events, base).collect()}
    assert set(out) == {"a", "b"}
    assert out["a"].post_users == 2 and out["b"].post_users == 0
    assert out["a"].events_per_user_first_day == 2.0
    assert out["a"].events_per_user_second_day == 1.0
    assert out["a"].events_per_user_second_day_fixed == 2.0


def test_monthly_resample_fills_empty_months(spark):
    df = spark.createDataFrame(
        [("s", date(2020, 1, 10), 1.0), ("s", date(2020, 3, 1), None), ("s", date(2020, 3, 2), 2.0), ("s", date(2019, 1, 1), 9.0)],
        "series string, ds date, fact double",
    )
    out = stats.monthly_resample(df, date(2020, 1, 1), ("fact",)).orderBy("month_end").collect()
    assert [(r.month_end, r.fact) for r in out] == [
        (date(2020, 1, 31), 1.0), (date(2020, 2, 29), 0.0), (date(2020, 3, 31), 2.0),
    ]
    assert stats.fiscal_total(df, date(2020, 1, 1), ("fact",)).head().fact == 3.0


def test_contract_names_missing_columns(spark):
    with pytest.raises(ValueError, match="dollars_spent"):
        conform(spark.range(1).select(F.current_timestamp().alias("usage_day")), "warehouse_cost")


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "series")
    df = spark.createDataFrame([("a", date(2020, 1, 1), 1.0), ("b", date(2020, 1, 1), 2.0)], "series string, ds date, y double")
    write_by_series(df, path)
    write_by_series(df.where("series = 'b'").withColumn("y", F.lit(3.0)), path)
    assert sorted(values(spark.read.parquet(path), "y")) == [1.0, 3.0]

    alerts = spark.createDataFrame([("a", 1.0)], "series string, importance double")
    out = str(tmp_path / "alerts")
    for day in (date(2020, 1, 1), date(2020, 1, 2), date(2020, 1, 2)):
        write_alerts(alerts, out, day)
    assert spark.read.parquet(out).count() == 2

    costs = str(tmp_path / "warehouse_cost")
    spark.createDataFrame([(datetime(2020, 1, 1), 2.5)], "usage_day timestamp, dollars_spent double").write.parquet(costs)
    sources = Sources(spark, {"warehouse_cost": costs})
    total = sources.query("SELECT sum(dollars_spent) AS y FROM {warehouse_cost}", "warehouse_cost")
    assert total.head().y == 2.5


def test_cut_lineage_keeps_rows(spark):
    assert sorted(values(cut_lineage(spark.range(5)), "id")) == [0, 1, 2, 3, 4]


def test_hot_workspace_is_spread(spark):
    day = datetime(2020, 1, 1, 5)
    base = spark.createDataFrame([("hot", date(2020, 1, 1)), ("cold", date(2020, 1, 1))], "server_id string, first_active_date date")
    rows = [("hot", None, None, day, f"u{i % 50}", f"e{i % 900}") for i in range(3000)] + [("cold", None, None, day, "u", "e"), ("other", None, None, day, "u", "e")]
    events = spark.createDataFrame(rows, "user_id string, context_server string, context_traits_server string, event_ts timestamp, user_actual_id string, id string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posts, used = retention.post_users(events, base), retention.usage(events, base, "x", "used_x")
        plans = [df._jdf.queryExecution().toString() for df in (posts, used)]
        got = {r.server_id: r for r in posts.collect()}
        events_of = {r.server_id: r.x_events for r in used.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # The join's partitioning by workspace alone is left before values are deduplicated.
    assert "hashpartitioning(server_id" in plans[0] and "kind#" in plans[0].split("SortMergeJoin")[0].split("Physical Plan")[-1]
    assert "id#" in plans[1]
    assert got["hot"].post_users == 50 and got["hot"].events_per_user_first_day == 900 / 50
    assert events_of == {"hot": 900, "cold": 1} and set(got) == {"hot", "cold"}


def test_spans_merge_daily_sketches(spark):
    rows = [(datetime(2020, 1, 1 + d, 3), f"v{i % (40 + d)}", "a" if i % 2 else "b") for d in range(20) for i in range(300)] + [(datetime(2020, 3, 1), None, "a")]
    events = spark.createDataFrame(rows, "ts timestamp, visitor string, site string")
    days = sketches.daily_sketches(events, "ts", "visitor", ("site",))
    assert days.count() == 40
    got = {(r.site, r.start): r["distinct"] for r in sketches.distinct_by_span(days, "month", ("site",)).collect()}
    assert set(got) == {("a", date(2020, 1, 1)), ("b", date(2020, 1, 1))}
    for site in "ab":
        exact = len({v for _, v, s in rows if s == site and v})
        assert abs(got[site, date(2020, 1, 1)] - exact) <= max(0.5, sketches.relative_error() * exact)
    with pytest.raises(ValueError):
        sketches.distinct_by_span(days, "decade")
