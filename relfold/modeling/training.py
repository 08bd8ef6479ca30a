"""Boosted trees on feature tables with mixed types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relfold.functions.columns import fill_missing, quoted, split_columns
from relfold.modeling.boosting import BoostedTrees, Boosting
from relfold.operators.aggregates import Measure, aggregate_by_key
from relfold.operators.keyed import KeyedFrame, attach, keyed
from relfold.session import shared_folder, stored

# Size of the model.
ITERATIONS = 300
LEARNING_RATE = 0.05
DEPTH = 6
SEED = 42
#: Parts of the training rows for the label means of texts: a row's value comes from the other parts.
MEAN_FOLDS = 5


@dataclass(frozen=True)
class TreeSettings:
    iterations: int = ITERATIONS
    learning_rate: float = LEARNING_RATE
    depth: int = DEPTH
    seed: int = SEED


def with_class_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Weight = rows of the largest class / rows of the own class, for any number of classes."""
    counts = df.groupBy(quoted(target).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    counts = stored(counts)
    largest = counts.agg(F.max("__n")).first()[0] or 1
    weights = counts.select("__label", (F.lit(float(largest)) / F.col("__n")).alias(name))
    return attach(df, [target], [keyed(weights, ["__label"], [name])])


@dataclass
class FeatureEncoder:
    """Turns feature columns into one vector, learned from training rows.

    Numbers get -999 for null. A text becomes the smoothed mean label of its value, whatever the number of values.
    A training row gets the mean of the other parts of the training rows; parts follow from a hash of the features,
    so neither a row's own label nor those of rows like it take part.

    The rows may lie in folds (``fold``, an integer from 0 to ``folds`` - 1). Label sums are then taken once per value,
    fold and part, and the model that leaves a fold out has its means by subtraction, so that one encoding serves the
    models of all folds and the one of all rows.
    """

    features: list[str]
    target: str
    fold: str | None = None
    folds: int = 1
    numeric: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    means: dict[str, KeyedFrame] = field(default_factory=dict)
    #: (rows, sum of labels) of each fold's parts.
    cells: list[list[tuple[float, float]]] = field(default_factory=list)

    @property
    def parts(self) -> list[tuple[float, float]]:
        """(rows, sum of labels) of each part."""
        return [(sum(f[k][0] for f in self.cells), sum(f[k][1] for f in self.cells)) for k in range(MEAN_FOLDS)]

    def fit(self, train: DataFrame) -> "FeatureEncoder":
        self.numeric, self.texts = split_columns(train.select(*[quoted(c) for c in self.features]))
        if not self.texts:
            return self
        fold = quoted(self.fold) if self.fold else F.lit(0)
        filled = fill_missing(
            train.select(*[quoted(c) for c in self.features], quoted(self.target).cast("double").alias("__y"), fold.alias("__fold")), self.features
        )
        cell = F.col("__fold") * MEAN_FOLDS + self._part()
        values = filled.select(*[quoted(c) for c in self.texts], "__y", cell.alias("__cell"))
        sums = {r["__cell"]: r for r in values.groupBy("__cell").agg(F.count("__y").alias("n"), F.sum("__y").alias("s")).collect()}
        found = [(sums[k]["n"], sums[k]["s"] or 0.0) if k in sums else (0, 0.0) for k in range(self.folds * MEAN_FOLDS)]
        self.cells = [found[k : k + MEAN_FOLDS] for k in range(0, len(found), MEAN_FOLDS)]
        measures = []
        for k in range(len(found)):
            measures += [Measure("count", f"__n{k}", "__y", where=f"__cell = {k}"), Measure("sum", f"__s{k}", "__y", where=f"__cell = {k}")]
        for name in self.texts:
            grouped = aggregate_by_key(values.select(quoted(name), "__y", "__cell"), [name], measures, null_safe=False)
            # Counts and sums of all cells, of whole folds and of whole parts, as arrays in one struct.
            columns = [F.struct(*self._marginals(kind)).alias(f"__{kind}") for kind in "ns"]
            frame = grouped.frame.select(*grouped.tokens, F.struct(*columns).alias("__sums"))
            self.means[name] = KeyedFrame(frame, grouped.keys, grouped.null_safe)
        return self

    def _marginals(self, kind: str) -> list[Column]:
        zero = F.lit(0.0)
        cells = [[F.col(f"__{kind}{f * MEAN_FOLDS + k}").cast("double") for k in range(MEAN_FOLDS)] for f in range(self.folds)]
        by_fold = [sum(row, zero) for row in cells]
        by_part = [sum((row[k] for row in cells), zero) for k in range(MEAN_FOLDS)]
        flat = F.array(*[c for row in cells for c in row])
        return [flat.alias("cell"), F.array(*by_fold).alias("fold"), F.array(*by_part).alias("part"), sum(by_fold, zero).alias("all")]

    def _part(self) -> Column:
        """The part of a filled row: equal features, equal part."""
        return F.pmod(F.xxhash64(*[quoted(c) for c in self.features]), F.lit(MEAN_FOLDS)).cast("int")

    def _mean(self, own: Column, left_out: int | None) -> Column:
        """Mean label of a value over the folds but ``left_out`` and the parts that are not the row's own (null: all)."""
        zero = F.lit(0.0)

        def over(kind: str) -> Column:
            sums = F.col("__sums")[f"__{kind}"]
            outside = sums["all"] if left_out is None else sums["all"] - sums["fold"][left_out]
            mine = sums["part"][own] if left_out is None else sums["part"][own] - sums["cell"][own + left_out * MEAN_FOLDS]
            return F.coalesce(outside - F.coalesce(mine, zero), zero)

        used = [f for k, f in enumerate(self.cells) if k != left_out]
        priors = []
        for k in range(MEAN_FOLDS + 1):  # the last one for rows without a part of their own
            rows = sum(f[j][0] for f in used for j in range(MEAN_FOLDS) if j != k)
            labels = sum(f[j][1] for f in used for j in range(MEAN_FOLDS) if j != k)
            priors.append(F.lit(float(labels / rows) if rows else 0.0))
        prior = F.array(*priors)[F.coalesce(own, F.lit(MEAN_FOLDS))]
        return (over("s") + prior) / (over("n") + 1)

    def encode(self, df: DataFrame, keep: Sequence[str] = (), learned: Column | None = None, models: Sequence[int | None] = (None,)) -> DataFrame:
        """``keep`` columns, the numbers and, for each of ``models`` (the fold it leaves out, or none), the texts'
        means: the rows of all these models, to be stored once. ``learned`` marks the rows of ``df`` that the encoder
        was fitted on; a row of the fold that a model leaves out is new to it."""
        frame = df.withColumn("__learned", F.lit(False) if learned is None else learned)
        fold = [self.fold] if self.fold and self.fold in df.columns else []
        columns = dict.fromkeys([*keep, *self.features, *fold, "__learned"])
        # Columns to keep may be features, too; those stay as they are.
        frame = frame.select(*[quoted(c) for c in columns], F.struct(*[quoted(c) for c in keep], F.lit(0).alias("__0")).alias("__kept"))
        frame = fill_missing(frame, self.features)
        if self.texts:
            frame = frame.withColumn("__own", F.when(F.col("__learned"), self._part()))
        for i, name in enumerate(self.texts):
            frame = attach(frame, [name], [self.means[name]])
            means = {}
            for model in models:
                own = F.when(quoted(fold[0]) != model, F.col("__own")) if fold and model is not None else F.col("__own")
                means[_mean_name(i, model)] = self._mean(own, model)
            frame = frame.withColumns(means).drop("__sums")
        numbers = [quoted(c).cast("double").alias(f"__f{self.features.index(c)}") for c in self.numeric]
        names = [_mean_name(i, model) for i in range(len(self.texts)) for model in models]
        return frame.select(*[F.col("__kept")[c].alias(c) for c in keep], *numbers, *names)

    def vectors(self, encoded: DataFrame, keep: Sequence[str] = (), left_out: int | None = None) -> DataFrame:
        """``keep`` columns plus ``features``, the vector of one model, from encoded rows."""
        inputs = [_mean_name(self.texts.index(c), left_out) if c in self.texts else f"__f{i}" for i, c in enumerate(self.features)]
        assembled = VectorAssembler(inputCols=inputs, outputCol="__vector").transform(encoded)
        return assembled.select(*[quoted(c) for c in keep], F.col("__vector").alias("features"))

    def transform(self, df: DataFrame, keep: Sequence[str] = (), learned: Column | None = None) -> DataFrame:
        """``keep`` columns plus ``features`` as a vector, for the model of all rows."""
        return self.vectors(self.encode(df, keep, learned), keep)


def _mean_name(text: int, left_out: int | None) -> str:
    return f"__mean_{text}" if left_out is None else f"__mean_{text}_without_{left_out}"


@dataclass(frozen=True)
class TreeModel:
    """``asked`` rounds were run; ``kept`` of them did best on the holdout (all, if there is none)."""

    encoder: FeatureEncoder
    trees: BoostedTrees | GBTClassificationModel
    asked: int
    kept: int

    def predict(self, df: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
        """``keep`` columns plus the probability of class 1."""
        return self.score(self.encoder.transform(df, keep), keep, name)

    def score(self, vectors: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
        """``predict`` for rows that are vectors already."""
        scored = self.trees.transform(vectors)
        return scored.select(*[quoted(c) for c in keep], vector_to_array("probability")[1].alias(name))

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance), one row per feature; six places, as what lies below is rounding of sums."""
        values = self.trees.featureImportances.toArray()
        rows = [(name, round(float(value), 6)) for name, value in zip(self.encoder.features, values)]
        return spark.createDataFrame(rows, "feature string, importance double")


def top_features(importances: DataFrame, k: int) -> DataFrame:
    """The k most important features, ties by name."""
    return importances.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def first_rounds(trees: BoostedTrees | GBTClassificationModel, rounds: int) -> BoostedTrees | GBTClassificationModel:
    """The model of the first rounds alone. A round depends only on those before, so this is what boosting gives when
    it is stopped there."""
    if isinstance(trees, BoostedTrees):
        return trees.first(rounds)
    java, context = trees._java_obj, SparkContext._active_spark_context
    kept = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(context._jvm.double, rounds)
    for k, (tree, weight) in enumerate(zip(list(java.trees())[:rounds], trees.treeWeights)):
        kept[k], weights[k] = tree, weight
    model = context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), kept, weights, java.numFeatures(), java.numClasses())
    return GBTClassificationModel(model).setFeaturesCol(trees.getFeaturesCol())


def boosted(vectors: DataFrame, settings: TreeSettings, weight: str | None = None) -> BoostedTrees | GBTClassificationModel:
    """All rounds of boosting on rows with ``__label`` and ``features``, in one job whose tasks hold the binned rows. Where
    that job cannot be had, Spark's own boosting, which starts a job per level, gives the model."""
    boosting = Boosting.of(vectors, weight)
    if not boosting.possible:
        return _boosted_by_jobs(vectors, settings, weight)
    return boosting.run(settings.iterations, settings.learning_rate, settings.depth)


def _boosted_by_jobs(vectors: DataFrame, settings: TreeSettings, weight: str | None) -> GBTClassificationModel:
    estimator = GBTClassifier(
        labelCol="__label",
        featuresCol="features",
        maxIter=settings.iterations,
        stepSize=settings.learning_rate,
        maxDepth=settings.depth,
        seed=settings.seed,
    )
    if weight:
        estimator = estimator.setWeightCol(weight)
    context = vectors.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # boosting cuts its lineage there every few rounds
        context.setCheckpointDir(shared_folder(vectors.sparkSession))
    return estimator.fit(vectors)


def fit_trees(
    train: DataFrame,
    features: Sequence[str],
    target: str = "target",
    settings: TreeSettings = TreeSettings(),
    holdout: str | None = None,
    balanced: bool = False,
) -> TreeModel:
    """Boosted trees on the rows outside ``holdout``, all rounds, run once; the holdout then picks the round with the
    least loss, and the trees up to that round are the model.

    The encoded rows are written once, for the boosting and the holdout.
    """
    if not features:
        raise ValueError("there are no features to train on")
    fitted_on = train.where(~F.col(holdout)) if holdout else train
    encoder = FeatureEncoder(list(features), target).fit(fitted_on)
    rows = with_class_weights(train, target, "__weight") if balanced else train
    rows = rows.withColumn("__label", quoted(target).cast("double"))
    keep = ["__label", *(["__weight"] if balanced else []), *([holdout] if holdout else [])]
    learned = ~F.col(holdout) if holdout else F.lit(True)
    vectors = encoder.vectors(stored(encoder.encode(rows, keep, learned)), keep)
    trees = boosted(vectors.where(~F.col(holdout)) if holdout else vectors, settings, "__weight" if balanced else None)
    kept = settings.iterations
    if holdout:
        losses = trees.evaluateEachIteration(vectors.where(F.col(holdout)))
        kept = 1 + min(range(len(losses)), key=losses.__getitem__)
        if kept < len(losses):
            trees = first_rounds(trees, kept)
    return TreeModel(encoder, trees, settings.iterations, kept)
