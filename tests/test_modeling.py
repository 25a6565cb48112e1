"""Splits, reports and classifiers."""

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from metricwatch.config import ModelSettings
from metricwatch.operators import modeling

QUICK = ModelSettings(trees=10, tree_depth=4, boosting_rounds=3, boosting_depth=3, logistic_iterations=10, svm_iterations=5)


@pytest.fixture(scope="module")
def workspaces(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(160):
        active = i % 2 == 0
        rows.append((f"w{i}", 0.95 if active else 0.3, float(rng.normal(3 if active else 0)), float(rng.normal())))
    return spark.createDataFrame(rows, "server_id string, pct_active double, signal double, noise double")


@pytest.fixture(scope="module")
def rows(workspaces):
    columns = modeling.feature_columns(workspaces)
    assert columns == ["signal", "noise"]
    return modeling.labelled_rows(workspaces, F.col("pct_active") >= 0.8, columns)


def test_splits_are_stable_and_disjoint(workspaces, rows):
    again = modeling.labelled_rows(workspaces.repartition(7), F.col("pct_active") >= 0.8, ["signal", "noise"])
    first = {r.id: (r.is_test, r.fold) for r in rows.collect()}
    assert first == {r.id: (r.is_test, r.fold) for r in again.collect()}
    assert {f for _, f in first.values()} == set(range(5))
    assert 0.1 < np.mean([t for t, _ in first.values()]) < 0.4


def test_report_equals_evaluator(spark):
    rng = np.random.default_rng(6)
    data = [(float(a), float(b)) for a, b in rng.integers(0, 2, (200, 2))] + [(1.0, 1.0)] * 100
    df = spark.createDataFrame(data, "label double, prediction double")
    report = {r["class"]: r for r in modeling.classification_report(df).collect()}
    for metric, row, column in (
        ("accuracy", "accuracy", "precision"), ("weightedPrecision", "weighted avg", "precision"),
        ("weightedRecall", "weighted avg", "recall"), ("f1", "weighted avg", "f1"),
    ):
        assert report[row][column] == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(df))


def test_compare_models(spark, rows):
    scores, fitted, predictions = modeling.compare_models(rows, QUICK)
    got = scores.collect()
    assert len(got) == 30 and {r.model for r in got} == {"LogReg", "RF", "KNN", "SVM", "GNB", "XGB"}
    for model in {r.model for r in got}:
        assert np.mean([r.test_accuracy for r in got if r.model == model]) > 0.8
        assert np.mean([r.test_roc_auc for r in got if r.model == model]) > 0.85
    test_rows = rows.where("is_test").count()
    assert {r.n for r in predictions.groupBy("model").agg(F.count("*").alias("n")).collect()} == {test_rows}
    assert modeling.select_best(scores).count() == 6
    importance = modeling.feature_importance(fitted["XGB"], ["signal", "noise"], spark).collect()
    assert importance[0].feature == "signal"


def test_roc_area_counts_pairs(spark):
    rng = np.random.default_rng(8)
    data = [(int(f), float(a), float(s)) for f, a, s in zip(rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.integers(0, 9, 400))]
    data += [(7, 1.0, 0.4), (7, 1.0, 0.6)]  # one class: no area
    df = spark.createDataFrame(data, "fold int, label double, score double")
    got = {r.fold: r.test_roc_auc for r in modeling.area_under_roc(df, ("fold",), 3).collect()}
    assert got.pop(7) is None
    for fold, area in got.items():
        pos, neg = ([s for f, a, s in data if f == fold and a == c] for c in (1.0, 0.0))
        wins = [1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg]
        assert area == pytest.approx(np.mean(wins))


@pytest.mark.parametrize("model", ["LogReg", "RF", "KNN", "SVM", "GNB", "XGB"])
def test_folds_that_lack_a_class(spark, model):
    rows = [(f"r{i}", 1.0, [float(i % 7), float(i % 3)], False, i % 2) for i in range(20)]
    rows += [("only", 0.0, [1.0, 2.0], False, 0)]  # without fold 0 all labels are 1
    df = spark.createDataFrame(rows, "id string, label double, x array<double>, is_test boolean, fold int")
    df = df.withColumn("features", array_to_vector("x")).drop("x")
    got = modeling.held_out(df, (model,), QUICK, folds=2).collect()
    assert len(got) == 21 and {r.prediction for r in got if r.fold == 0} == {1.0}
    assert all(r.score is not None for r in got)
    assert {r.prediction for r in got} <= {0.0, 1.0}


def test_linear_support_vectors(rows):
    from dataclasses import replace

    scores, _, _ = modeling.compare_models(rows, replace(QUICK, svm_features=0), ("SVM",), folds=2)
    assert all(r.test_roc_auc > 0.9 for r in scores.collect())


def test_a_forest_is_grown_in_parts_of_bounded_size(spark, rows, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    grown, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: grown.append((self.getNumTrees(), df.count())) or fit(self, df))
    whole, fitted, _ = modeling.compare_models(rows, QUICK, ("RF",), folds=2)
    assert [n for n, _ in grown] == [QUICK.trees] * 3
    grown.clear()
    monkeypatch.setattr(modeling, "TREE_ROWS", 300)
    scores, parts, predictions = modeling.compare_models(rows, QUICK, ("RF",), folds=2)
    assert sum(n for n, _ in grown) == 3 * QUICK.trees and all(n == 1 or n * m <= 300 for n, m in grown) and len(grown) > 6
    assert predictions.count() == rows.where("is_test").count()
    for a, b in zip(whole.orderBy("fold").collect(), scores.orderBy("fold").collect()):
        assert abs(a.test_roc_auc - b.test_roc_auc) < 0.1
    for found in (fitted["RF"], parts["RF"]):
        assert [r.feature for r in modeling.feature_importance(found, ["signal", "noise"], spark).collect()] == ["signal", "noise"]
        assert modeling.feature_importance(found, ["signal", "noise"], spark).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_neighbours_of_all_folds_are_one_search(rows, monkeypatch):
    asked, search = [], modeling.knn_scores
    monkeypatch.setattr(modeling, "knn_scores", lambda test, train, k: asked.append(test.count()) or search(test, train, k))
    scores, _, predictions = modeling.compare_models(rows, QUICK, ("KNN",))
    assert asked == [rows.count()] and scores.count() == 5 and predictions.count() == rows.where("is_test").count()


def test_fits_of_many_passes_take_few_tasks(rows, monkeypatch):
    from pyspark.ml.classification import LinearSVC, RandomForestClassifier

    seen = []
    for kind in (LinearSVC, RandomForestClassifier):
        monkeypatch.setattr(kind, "fit", lambda self, df, fit=kind.fit: seen.append((self, df.rdd.getNumPartitions())) or fit(self, df))
    monkeypatch.setattr(modeling.grouped, "ROWS_PER_PARTITION", 10)
    monkeypatch.setattr(modeling, "FIT_ROWS_PER_PARTITION", 60)
    modeling.compare_models(rows, QUICK, ("RF", "SVM"), folds=2)
    assert len(seen) == 6 and all(n <= 3 for _, n in seen)
    assert all(f.getCacheNodeIds() for f, _ in seen if isinstance(f, RandomForestClassifier))
