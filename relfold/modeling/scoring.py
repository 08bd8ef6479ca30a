"""Scoring of a feature table pair against held-out labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from relfold.functions.columns import gini, quoted, score_round
from relfold.modeling.metrics import auc_by_rank
from relfold.modeling.selection import all_features
from relfold.modeling.split import FOLDS, with_exact_folds, with_folds
from relfold.modeling.training import FeatureEncoder, TreeModel, TreeSettings, boosted, top_features
from relfold.operators.labels import with_held_out_labels, with_target
from relfold.session import stored

REPORTED_FEATURES = 20
FOLD = "__fold"


@dataclass(frozen=True)
class Score:
    report: DataFrame
    top_features: DataFrame


@dataclass(frozen=True)
class FoldedRows:
    """Training rows encoded and stored once, for the models that leave out a fold each and the one of all rows."""

    encoder: FeatureEncoder
    table: DataFrame
    #: Rows of (fold, label).
    sizes: dict[tuple[int, float], int]

    def fit(self, settings: TreeSettings, left_out: int | None = None) -> TreeModel:
        """The model of all folds but one; a class weighs the rows of the largest class over its own."""
        rows = self.encoder.vectors(self.table, ["__label", FOLD], left_out)
        counts: dict[float, int] = {}
        for (fold, label), n in self.sizes.items():
            if fold != left_out:
                counts[label] = counts.get(label, 0) + n
        weight = F.lit(1.0)
        for label, n in counts.items():
            weight = F.when(F.col("__label") == label, float(max(counts.values()) / n)).otherwise(weight)
        rows = rows if left_out is None else rows.where(F.col(FOLD) != left_out)
        trees = boosted(rows.withColumn("__weight", weight), settings, "__weight")
        return TreeModel(self.encoder, trees, settings.iterations, settings.iterations)

    def auc(self, settings: TreeSettings, fold: int) -> float | None:
        """How a model of the other folds ranks the rows of one."""
        own = self.encoder.vectors(self.table.where(F.col(FOLD) == fold), ["__label"], fold)
        return auc_by_rank(self.fit(settings, fold).score(own, ["__label"]), "score", "__label").first()["auc"]


def folded_rows(
    train: DataFrame, features: Sequence[str], target: str, id_column: str, folds: int, exact_folds: bool = True, whole: bool = False
) -> FoldedRows:
    """``whole`` prepares the model of all rows, too."""
    if not features:
        raise ValueError("there are no features to train on")
    if not folds:
        placed = train.withColumn(FOLD, F.lit(0))
    else:
        placed = with_exact_folds(train, target, id_column, folds, name=FOLD) if exact_folds else with_folds(train, id_column, folds, name=FOLD)
    encoder = FeatureEncoder(list(features), target, FOLD, max(folds, 1)).fit(placed)
    models = [*([None] if whole else []), *range(folds)]
    rows = placed.withColumn("__label", quoted(target).cast("double"))
    table = stored(encoder.encode(rows, ["__label", FOLD], F.lit(True), models))
    # Boosting takes two classes, so these are two rows a fold.
    sizes = {(r[FOLD], r["__label"]): r["count"] for r in table.groupBy(FOLD, "__label").count().collect()}
    return FoldedRows(encoder, table, sizes)


def _side_by_side(spark: SparkSession, tasks: Sequence[Callable], parallelism: int) -> list:
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda task: task()), tasks, chunksize=1)


def _validated(spark: SparkSession, aucs: Sequence[float | None]) -> DataFrame:
    without = [fold for fold, auc in enumerate(aucs) if auc is None]
    if without:
        raise ValueError(f"folds {without} hold one class only; use fewer folds")
    return spark.createDataFrame(list(enumerate(aucs)), "fold int, auc double")


def cross_validate(
    train: DataFrame,
    features: Sequence[str],
    target: str = "target",
    id_column: str = "row_id",
    folds: int = FOLDS,
    settings: TreeSettings = TreeSettings(),
    exact_folds: bool = True,
    parallelism: int = 1,
) -> DataFrame:
    """(fold, auc): each fold scored by a model of the others; ``parallelism`` folds at a time, all of them from one
    encoding of the rows.

    Folds hold equal shares of every class (``exact_folds``), or follow from the id alone. A fold without one of
    the classes has no AUC and is an error: it could only be left out of the mean."""
    rows = folded_rows(train, features, target, id_column, folds, exact_folds)
    tasks = [partial(rows.auc, settings, fold) for fold in range(folds)]
    return _validated(train.sparkSession, _side_by_side(train.sparkSession, tasks, parallelism))


def score_output(
    train: DataFrame,
    test: DataFrame,
    labels: DataFrame,
    source_train: DataFrame | None = None,
    metric: str = "roc_auc",
    target: str = "target",
    id_column: str = "row_id",
    keys: Sequence[str] = (),
    exclude_keys: bool = True,
    settings: TreeSettings = TreeSettings(),
    folds: int = FOLDS,
    parallelism: int = 1,
) -> Score:
    """Train on the output, score its test side against the hidden labels, and report. Without ``folds`` there is no
    cross-validation, and its figures are null.

    Raw key columns (``keys``) are no features unless ``exclude_keys`` is off.
    """
    if source_train is not None:
        train = with_target(train, source_train, id_column, target)
    train, test, spark = stored(train), stored(test), train.sparkSession
    features = all_features(train, id_column, target, keys if exclude_keys else ())
    rows = folded_rows(train, features, target, id_column, folds, whole=True)
    labelled = with_held_out_labels(test, labels, id_column, target)

    def whole() -> tuple[TreeModel, dict]:
        model = rows.fit(settings)
        return model, auc_by_rank(model.predict(labelled, [target]), "score", target).first().asDict()

    tasks = [whole, *[partial(rows.auc, settings, fold) for fold in range(folds)]]
    (model, result), *aucs = _side_by_side(spark, tasks, parallelism)
    validated = _validated(spark, aucs).agg(
        score_round(F.avg("auc")).alias("cv_mean_auc"), score_round(F.stddev_pop("auc")).alias("cv_std_auc")
    )
    # The training rows were counted by fold and label; the test rows by the AUC, which leaves none out.
    numbers = {
        **result,
        **validated.first().asDict(),
        "train_rows": sum(rows.sizes.values()),
        "test_rows": result["positives"] + result["negatives"],
        "n_features": len(features),
    }
    report = spark.createDataFrame(
        [tuple(numbers[c] for c in ("auc", "cv_mean_auc", "cv_std_auc", "n_features", "train_rows", "test_rows"))],
        "auc double, cv_mean_auc double, cv_std_auc double, n_features int, train_rows bigint, test_rows bigint",
    )
    value = F.col("auc")
    primary = value if metric == "roc_auc" else gini(value)
    report = report.select(
        score_round(value).alias("auc"),
        score_round(gini(value)).alias("gini"),
        score_round(primary).alias("primary_score"),
        "cv_mean_auc", "cv_std_auc", "n_features", "train_rows", "test_rows",
    )
    return Score(report, top_features(model.importances(spark), REPORTED_FEATURES))
