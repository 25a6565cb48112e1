"""Classifier comparison, classification report and feature importance on Spark ML."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.classification import LinearSVC, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricwatch.config import (
    FOLD_SEED,
    FOLDS,
    NON_FEATURE_COLUMNS,
    SPLIT_SEED,
    TEST_PERCENT,
    ModelSettings,
)
from metricwatch.functions import hash_percent
from metricwatch.operators import grouped, kernel
from metricwatch.operators.knn import knn_scores
from metricwatch.operators.ranking import running_totals
from metricwatch.sources.lineage import cut_lineage, new_folder

SCORE_SCHEMA = (
    "model string, fold int, fit_time double, score_time double, test_accuracy double, "
    "test_precision_weighted double, test_recall_weighted double, test_f1_weighted double, "
    "test_roc_auc double"
)


# ---- preparation -----------------------------------------------------------


def feature_columns(df: DataFrame, drop_extra: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that are neither identifier, date nor the label's source."""
    skip = {*NON_FEATURE_COLUMNS, *drop_extra}
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def labelled_rows(df: DataFrame, target: Column, features: list[str]) -> DataFrame:
    """``(id, label, features, fold, is_test)`` of complete rows.

    Split and folds are hashes of the workspace id: the same on any partitioning, and
    repeated rows of a workspace never fall on both sides.
    """
    rows = df.na.drop("any").select(
        F.col("server_id"),
        F.xxhash64(*df.columns).alias("_row"),
        target.cast("double").alias("label"),
        *[F.col(c).cast("double").alias(c) for c in features],
    )
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    return assembled.select(
        F.concat_ws("/", "server_id", F.hex("_row")).alias("id"),
        "label",
        "features",
        test_row("server_id").alias("is_test"),
        fold_of("server_id").alias("fold"),
    )


def test_row(key: str, percent: int = TEST_PERCENT, seed: int = SPLIT_SEED) -> Column:
    return hash_percent(key, seed) < percent


def fold_of(key: str, folds: int = FOLDS, seed: int = FOLD_SEED) -> Column:
    return hash_percent(key, seed, folds)


# ---- classifiers -----------------------------------------------------------
#
# A fitted classifier is a function from rows to the same rows with ``score`` (larger
# means more likely positive) and ``prediction``.


@dataclass
class Fitted:
    predict: Callable[[DataFrame], DataFrame]
    model: object


def _margin(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.get(vector_to_array("rawPrediction"), F.lit(1)))


# The driver holds the nodes of the trees it grows, and a deep tree's nodes grow with its rows: so many
# rows times trees at a time, for so many groups side by side.
TREE_ROWS = 800_000
FORESTS_AT_ONCE = 4
# Forests and support vectors are fitted in hundreds of passes, several fits side by side: few tasks for a pass, as a task
# has its own cost, and in forests sums for every node of a level.
FIT_ROWS_PER_PARTITION = 20_000


def _few_tasks(train: DataFrame, rows: int) -> DataFrame:
    return train.coalesce(rows // FIT_ROWS_PER_PARTITION + 1)


@dataclass
class Forest:
    """Parts of a forest in the shared folder, and the shares of its features' importance."""

    parts: list[str]
    importances: np.ndarray


def _forest(cfg: ModelSettings):
    """A random forest, grown and applied part by part; a part's trees leave the driver when they are written or applied."""

    def fit(train: DataFrame) -> Fitted:
        rows = train.count()
        train = _few_tasks(train, rows)
        size = min(max(TREE_ROWS // max(rows, 1), 1), cfg.trees)
        forest = Forest([], np.zeros(len(train.first()["features"])))
        for k, first in enumerate(range(0, cfg.trees, size)):
            trees = min(size, cfg.trees - first)
            # Spark's own choice for several trees, also where a part has but one.
            features = "sqrt" if cfg.trees > 1 else "auto"
            # With the rows' nodes kept beside the rows, no tree is sent to the tasks, level by level, and walked from its root.
            model = RandomForestClassifier(
                numTrees=trees, maxDepth=cfg.tree_depth, featureSubsetStrategy=features, seed=cfg.seed + 1_000_003 * k, cacheNodeIds=True
            ).fit(train)
            forest.parts.append(new_folder(train.sparkSession, "forest"))
            model.write().save(forest.parts[-1])
            forest.importances += model.featureImportances.toArray() * trees / cfg.trees
            del model

        def predict(df: DataFrame) -> DataFrame:
            votes = df.withColumn("_votes", F.array(F.lit(0.0), F.lit(0.0)))
            own = vector_to_array("rawPrediction")
            for part in forest.parts:
                judged = RandomForestClassificationModel.load(part).transform(votes)
                total = F.zip_with("_votes", own, lambda a, b: a + b)
                votes = cut_lineage(judged.select(*df.columns, total.alias("_votes")))
            no, yes = (F.get("_votes", F.lit(c)) for c in (0, 1))
            return votes.withColumn("score", yes / (no + yes)).withColumn("prediction", (yes > no).cast("double")).drop("_votes")

        return Fitted(predict, forest)

    return fit


def _neighbours(cfg: ModelSettings):
    """Votes of the nearest neighbours for all groups in one search: a row's own fold is left out of its neighbours."""

    def fit(train: DataFrame, folds: int) -> GroupFit:
        counts = grouped.class_counts(train, folds + 1)
        known = train.select("id", "x", "label", F.col("fold").alias("own"))
        only = F.array(*[F.lit(float(n[1] > 0) if n.min() == 0 else None).cast("double") for n in counts])

        def predict(rows: DataFrame) -> DataFrame:
            placed = rows.withColumn("_only", F.get(only, F.col("group")))
            # Equal ids are equal rows: ask once, answer all.
            asked = placed.where("_only IS NULL").select("id", "x", F.col("group").alias("own")).dropDuplicates(["id"])
            scores = knn_scores(asked, known, cfg.neighbours)
            sole = placed.where("_only IS NOT NULL").withColumn("score", 2 * F.col("_only") - 1).withColumn("prediction", F.col("_only"))
            return placed.join(scores, "id").unionByName(sole).drop("_only").select(*rows.columns, "score", "prediction")

        return GroupFit(predict, known)

    return fit


def _kernel_svm(cfg: ModelSettings):
    """Support vector classifier with an RBF kernel of width 1 / (features x variance), on a basis that the rows choose."""

    def fit(train: DataFrame) -> Fitted:
        known = train.select("id", vector_to_array("features").alias("x"))
        gamma, _, n_rows = kernel.scale(known)
        basis = kernel.fit_basis(known, gamma, cfg.svm_features, cfg.svm_candidates, cfg.svm_tolerance) if cfg.svm_features else None

        def lift(df: DataFrame) -> DataFrame:
            if basis is None:
                return df.withColumn("lifted", F.col("features"))
            return df.withColumn("lifted", array_to_vector(kernel.lift(vector_to_array("features"), basis)))

        estimator = LinearSVC(
            featuresCol="lifted", maxIter=cfg.svm_iterations, regParam=1.0 / (cfg.svm_c * max(n_rows, 1)), standardization=False
        )
        model = estimator.fit(lift(_few_tasks(train, n_rows)))
        return Fitted(lambda df: _margin(model.transform(lift(df))).drop("lifted"), model)

    return fit


def kernel_error(rows: DataFrame, cfg: ModelSettings = ModelSettings()) -> DataFrame:
    """:func:`kernel.residuals` of the support vector classifier's basis, over all training rows."""
    train = cut_lineage(grouped_rows(rows).where(~F.col("is_test")).select("id", "x"))
    gamma, _, n_rows = kernel.scale(train)
    if not n_rows:
        return train.sparkSession.createDataFrame([], "n_rows long, landmarks int, mean_residual double, max_residual double, mean_kernel double")
    return kernel.residuals(train, kernel.fit_basis(train, gamma, cfg.svm_features, cfg.svm_candidates, cfg.svm_tolerance))


def _per_group(fit_one: Callable[[DataFrame], Fitted], at_once: int):
    """A classifier that is fitted group by group, some side by side; a group with one class predicts that class."""

    def fit(train: DataFrame, folds: int) -> GroupFit:
        counts = grouped.class_counts(train, folds + 1)
        usable = [g for g in range(folds + 1) if counts[g].min() > 0]
        with ThreadPool(at_once) as pool:
            found = pool.map(lambda g: fit_one(train.where(F.col("fold") != g)), usable, chunksize=1)
        fitted = dict(zip(usable, found))

        def predict(rows: DataFrame) -> DataFrame:
            judged = lambda g: fitted[g].predict(rows.where(F.col("group") == g)).select(*rows.columns, "score", "prediction")
            with ThreadPool(at_once) as pool:
                parts = pool.map(judged, usable, chunksize=1)
            for g in set(range(folds + 1)) - set(usable):
                sole = float(counts[g, 1] > 0)
                parts.append(rows.where(F.col("group") == g).select("*", F.lit(2 * sole - 1).alias("score"), F.lit(sole).alias("prediction")))
            return reduce(DataFrame.unionByName, parts)

        return GroupFit(predict, fitted)

    return fit


def _together(fit_groups: Callable[[DataFrame, int, int], grouped.GroupedModel]):
    """A classifier whose groups are fitted in common passes."""

    def fit(train: DataFrame, folds: int) -> GroupFit:
        model = fit_groups(train, folds + 1, grouped.vector_width(train))
        return GroupFit(model.predict, model)

    return fit


@dataclass
class GroupFit:
    """``predict`` adds ``score`` and ``prediction`` to rows with ``(id, features, x, group)``, each by its group's model."""

    predict: Callable[[DataFrame], DataFrame]
    model: object


def _boosting(cfg: ModelSettings) -> grouped.Boosting:
    return grouped.Boosting(cfg.boosting_rounds, cfg.boosting_depth, cfg.boosting_step)


def _classifiers(cfg: ModelSettings) -> dict[str, Callable[[DataFrame, int], GroupFit]]:
    boosting = _boosting(cfg)
    return {
        "LogReg": _together(lambda t, g, w: grouped.logistic(t, g, w, 1.0 / cfg.logistic_c, cfg.logistic_iterations)),
        "RF": _per_group(_forest(cfg), min(FORESTS_AT_ONCE, cfg.parallelism)),
        "KNN": _neighbours(cfg),
        "SVM": _per_group(_kernel_svm(cfg), cfg.parallelism),
        "GNB": _together(grouped.naive_bayes),
        "XGB": _together(lambda t, g, w: grouped.boosted_trees(t, g, w, boosting)),
    }


# ---- scores ----------------------------------------------------------------


def confusion(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Row counts per label and prediction."""
    return predictions.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def classification_report(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, f1 and support per class, with macro and weighted averages.

    Classes are named by their label value.  Undefined ratios are 0.
    """
    return report_of(confusion(predictions, by), by)


def report_of(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The report of counted labels and predictions."""
    classes = F.explode(
        F.array_distinct(F.array(F.col("label").cast("double"), F.col("prediction").cast("double")))
    )
    per_class = (
        cells.select(*by, "label", "prediction", "n", classes.alias("class"))
        .groupBy(*by, "class")
        .agg(
            F.sum(F.when((F.col("label") == F.col("class")) & (F.col("prediction") == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("label") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(F.col("prediction") == F.col("class"), F.col("n")).otherwise(0)).alias("claimed"),
        )
        .withColumn("precision", _ratio("tp", "claimed"))
        .withColumn("recall", _ratio("tp", "support"))
        .withColumn("f1", F.coalesce(
            2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)),
            F.lit(0.0),
        ))
    )
    measures = ("precision", "recall", "f1")
    averages = per_class.groupBy(*by).agg(
        F.sum("support").alias("support"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in measures],
    )
    rows = [
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(m) for m in measures]),
        *[
            F.struct(F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{m}").alias(m) for m in measures])
            for kind in ("macro", "weighted")
        ],
    ]
    summary = averages.select(*by, "support", F.explode(F.array(*rows)).alias("r")).select(
        *by, "r.class", "r.precision", "r.recall", "r.f1", "support"
    )
    return per_class.select(
        *by, F.col("class").cast("string").alias("class"), *measures, "support"
    ).unionByName(summary)


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def area_under_roc(predictions: DataFrame, by: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Exact area under the ROC curve per group: ``(by, test_roc_auc)``; NULL unless both classes occur.

    It is the share of (positive, negative) pairs that the score orders rightly, ties counting half: a
    positive with this score beats the negatives below it and half of those beside it.
    """
    positive = F.col("label") == 1
    levels = running_totals(
        predictions.select(*by, "score", positive.cast("long").alias("pos"), (~positive).cast("long").alias("neg")),
        list(by), "score", ["pos", "neg"], partitions,
    )
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return levels.groupBy(*by).agg((won / F.nullif(pairs.cast("double"), F.lit(0.0))).alias("test_roc_auc"))


def fold_scores(predictions: DataFrame, partitions: int | None = None) -> DataFrame:
    """Accuracy, weighted scores and ROC area of every (model, fold), computed in one frame."""
    report = report_of(confusion(predictions, ("model", "fold")), by=("model", "fold"))

    def pick(row: str, measure: str, name: str) -> Column:
        return F.max(F.when(F.col("class") == row, F.col(measure))).alias(name)

    weighted = report.groupBy("model", "fold").agg(
        pick("accuracy", "precision", "test_accuracy"),
        *[pick("weighted avg", m, f"test_{m}_weighted") for m in ("precision", "recall", "f1")],
    )
    return weighted.join(area_under_roc(predictions, ("model", "fold"), partitions), ["model", "fold"])


# ---- comparison ------------------------------------------------------------


def grouped_rows(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Labelled rows as the fits take them: ``x`` as an array, folds below ``folds``, and the ``group`` that judges each row."""
    folded = rows.withColumn("fold", F.pmod("fold", F.lit(folds)).cast("int"))
    return folded.withColumn("x", vector_to_array("features")).withColumn("group", grouped.group_column(folds))


def held_out(rows: DataFrame, models: tuple[str, ...], cfg: ModelSettings = ModelSettings(), folds: int = FOLDS) -> DataFrame:
    """``(model, fold, id, label, prediction, score)`` of the training rows, each judged without its fold."""
    rows = grouped_rows(rows, folds)
    train = rows.where(~F.col("is_test"))
    fits = _classifiers(cfg)
    judged = [fits[m](train, folds).predict(train).select(F.lit(m).alias("model"), "fold", "id", "label", "prediction", "score") for m in models]
    return reduce(DataFrame.unionByName, judged)


def compare_models(
    rows: DataFrame,
    cfg: ModelSettings = ModelSettings(),
    models: tuple[str, ...] | None = None,
    folds: int = FOLDS,
) -> tuple[DataFrame, dict[str, GroupFit], DataFrame]:
    """Cross-validate each classifier on the training rows, and fit it on all of them.

    Returns the score frame (one row per model and fold), the fits and the test predictions of all
    models.  Classifiers run side by side; fits of the folds and of all training rows are made
    together where their sums can be, so ``fit_time`` and ``score_time`` are those of all folds.
    """
    spark: SparkSession = rows.sparkSession
    # Iterative fits run one task per partition and round: even partitions, no more than the
    # rows deserve.
    rows = cut_lineage(grouped_rows(rows.repartition(rows.count() // grouped.ROWS_PER_PARTITION + 1, "id"), folds))
    train = rows.where(~F.col("is_test"))
    fits = {m: f for m, f in _classifiers(cfg).items() if models is None or m in models}
    if not fits:
        raise ValueError(f"no classifier is named {models}")

    def one_model(name: str):
        started = time.time()
        fitted = fits[name](train, folds)
        trained = time.time()
        judged = fitted.predict(rows).select(F.lit(name).alias("model"), "group", "id", "label", "prediction", "score")
        return fitted, cut_lineage(judged), trained - started, time.time() - trained

    with ThreadPool(cfg.parallelism) as pool:
        done = dict(zip(fits, pool.map(one_model, list(fits), chunksize=1)))
    judged = reduce(DataFrame.unionByName, [j for _, j, _, _ in done.values()])
    timings = spark.createDataFrame([(m, fit, score) for m, (_, _, fit, score) in done.items()], "model string, fit_time double, score_time double")
    scored = fold_scores(judged.where(F.col("group") < folds).withColumnRenamed("group", "fold"))
    columns = [c.split()[0] for c in SCORE_SCHEMA.split(", ")]
    scores = cut_lineage(scored.join(F.broadcast(timings), "model").select(*columns))
    return scores, {m: d[0] for m, d in done.items()}, judged.where(F.col("group") == folds).drop("group")


def held_out_counts(rows: DataFrame, model: str, cfg: ModelSettings = ModelSettings(), folds: int = FOLDS) -> DataFrame:
    """``(fold, label, prediction, n)`` of one classifier on the training rows that each fold holds out."""
    return confusion(held_out(rows, (model,), cfg, folds), ("fold",)).select("fold", "label", "prediction", "n")


def select_best(scores: DataFrame, metric: str = "test_roc_auc") -> DataFrame:
    """Models by mean fold score, best first."""
    return (
        scores.groupBy("model")
        .agg(F.avg(metric).alias("score"))
        .orderBy(F.desc_nulls_last("score"), "model")
    )


def boosted_importance(rows: DataFrame, features: list[str], cfg: ModelSettings = ModelSettings()) -> DataFrame:
    """:func:`feature_importance` of boosted trees fitted on all training rows, without a study."""
    train = cut_lineage(grouped_rows(rows).where(~F.col("is_test")).select("x", "label", F.lit(-1).alias("fold")))
    model = grouped.boosted_trees(train, 1, len(features), _boosting(cfg))
    return feature_importance(GroupFit(model.predict, model), features, rows.sparkSession)


def feature_importance(fitted: GroupFit, features: list[str], spark: SparkSession) -> DataFrame:
    """``(feature, importance)`` of a tree model of all training rows, largest first.

    Boosted trees: the mean gain of a feature's splits; forests: Spark's importances; both as shares.
    """
    if isinstance(fitted.model, grouped.GroupedModel):
        shares = fitted.model.detail.importances
    else:
        shares = fitted.model[max(fitted.model)].model.importances
    return spark.createDataFrame(list(zip(features, shares.tolist())), "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
