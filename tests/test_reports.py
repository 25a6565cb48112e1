"""The composed reports on logical tables of a lake."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from metricwatch.config import SERIES_SPECS, ModelSettings, TrendConfig
from metricwatch.operators import stats
from metricwatch.operators.anomalies import label_anomalies
from metricwatch.plans import reports
from metricwatch.sources import Sources, StandInSources
from metricwatch.sources.standins import EVENTS_AS_OF

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    stand_ins = StandInSources(spark, SF_DIR)
    for name in ("warehouse_cost", "usage_events"):
        stand_ins.table(name).write.parquet(str(root / name))
    spark.read.parquet(str(root / "usage_events")).createOrReplaceTempView("usage_events_view")
    return Sources(
        spark, {"warehouse_cost": str(root / "warehouse_cost"), "usage_events": "usage_events_view"}
    )


def test_anomaly_report_reads_paths_and_catalog_tables(sources):
    specs = [s for s in SERIES_SPECS if s.source in ("warehouse_cost", "usage_events")]
    specs = [replace(s, lower=date(1999, 1, 1)) for s in specs]
    out = reports.anomaly_report(sources, tuple(specs), EVENTS_AS_OF)
    counts = {r.series: r["n"] for r in out.groupBy("series").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {"warehouse_spend", "usage_event_volume", "usage_active_users"}
    assert counts["usage_event_volume"] == 30
    assert out.where("anomaly = 1 AND fact <= yhat_upper OR anomaly = -1 AND fact >= yhat_lower").count() == 0


def test_spend_forecast_sums_agree(sources):
    spec = replace(SERIES_SPECS[0], lower=date(1999, 1, 1))
    cfg = TrendConfig(yearly_order=2, draws=100, interval_width=0.95)
    result = reports.spend_forecast(
        sources, spec, date(2001, 8, 2), until=date(2001, 10, 1), cutoff=date(2001, 8, 1), cfg=cfg
    )
    days = result.forecast.where("fact IS NULL").orderBy("ds").collect()
    assert (days[0].ds, days[-1].ds) == (date(2001, 8, 2), date(2001, 9, 30))
    total = result.total.head()
    assert total.yhat == pytest.approx(sum(r.yhat for r in result.monthly.collect()))
    assert [r.month_end for r in result.monthly.orderBy("month_end").collect()] == [
        date(2001, 8, 31), date(2001, 9, 30),
    ]


def test_engagement_study(spark):
    features = reports.retention_report(StandInSources(spark, SF_DIR), EVENTS_AS_OF)
    study = reports.engagement_study(
        features,
        reports.active_target(0.9),
        ModelSettings(trees=5, tree_depth=3, boosting_rounds=2, boosting_depth=2),
        models=("RF", "GNB", "XGB"),
        drop_extra=("total_days",),
    )
    assert study.scores.count() == 15 and study.best.count() == 3
    assert {r.model for r in study.report.select("model").distinct().collect()} == {"RF", "GNB", "XGB"}
    named = [r.feature for r in study.importance.collect()]
    assert "total_days" not in named and "pct_active" not in named and len(named) == 32


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from metricwatch.sources.lineage import shared_folder

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Context.getCheckpointDir = staticmethod(lambda: "hdfs://shared/")
    assert shared_folder(Session()) == "hdfs://shared"


def test_published_anomalies(spark, tmp_path):
    rows = [("b", "2020-01-02", 9.0, 1.0, 2.0, 0.0, 5.0), ("a", "2020-01-03", 1.0, 1.0, 2.0, 0.0, 1.0), ("a", "2020-01-01", 1.0, 1.0, 2.0, 0.5, 0.1)]
    scored = spark.createDataFrame(rows, "series string, day string, trend double, yhat double, yhat_upper double, yhat_lower double, fact double")
    scored = scored.withColumn("ds", F.to_date("day")).drop("day")
    found = reports.publish_anomalies(label_anomalies(scored), str(tmp_path), date(2020, 1, 4))
    assert sorted((r.series, r.direction) for r in found.collect()) == [("a", "below"), ("b", "above")]
    assert spark.read.parquet(f"{tmp_path}/series").count() == 3
    assert spark.read.parquet(f"{tmp_path}/alerts").where("as_of = '2020-01-04'").count() == 2


def test_out_of_order_counts_rows_behind_a_later_one(spark):
    rows = spark.createDataFrame([(a, b) for a in (3, 1, 2, 1) for b in (1.0, 0.0)], "a int, b double")
    keys = [F.col("a"), F.col("b")]
    assert tuple(stats.out_of_order(rows.orderBy("a", "b"), keys, (True, True)).head()) == (8, 0)
    assert tuple(stats.out_of_order(rows.orderBy(F.desc("a"), "b"), keys, (False, True)).head()) == (8, 0)
    # Sorted up, read down: every step to another value of a.
    assert tuple(stats.out_of_order(rows.orderBy("a", "b"), [F.col("a")], (False,)).head()) == (8, 2)
    # One task, two pairs that fall in b and two steps that fall in a.
    assert tuple(stats.out_of_order(rows.coalesce(1), keys, (True, True)).head()) == (8, 6)
    assert tuple(stats.out_of_order(rows.where("a > 9"), keys, (True, True)).head()) == (0, 0)
    # Each task in order, the tasks against each other not.
    halves = rows.where("a = 3").orderBy("b").unionByName(rows.where("a = 1").orderBy("b"))
    assert tuple(stats.out_of_order(halves, [F.col("a")], (True,)).head()) == (6, 1)
