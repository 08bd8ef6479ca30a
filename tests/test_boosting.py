"""Boosting in one job against Spark's own, which starts a job per level."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from relfold.modeling import boosting, training
from relfold.modeling.boosting import Boosting
from relfold.modeling.selection import rank_features
from relfold.modeling.training import TreeSettings, boosted

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def vectors(spark):
    random.seed(11)
    rows = []
    for _ in range(1200):
        a, b, c, d = random.randrange(30) / 7, float(random.randrange(12)), float(random.randrange(2)), random.randrange(32) * -3.5
        label = float(a * c + b * 0.2 + random.random() * 2 > 3.2)
        rows.append((a, b, c, d, label, 2.5 if label else 1.0))
    table = spark.createDataFrame(rows, "a double, b double, c double, d double, __label double, __weight double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(table).select("__label", "__weight", "features").cache()


def scores(model, rows):
    return np.array([r["probability"][1] for r in model.transform(rows).select("probability").collect()])


@pytest.mark.parametrize("per_task", [boosting.ROWS_PER_TASK, 400])
@pytest.mark.parametrize("weight", [None, "__weight"])
def test_the_model_is_that_of_spark(vectors, monkeypatch, weight, per_task):
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", per_task)
    monkeypatch.setattr(boosting, "BLOCK", 150)
    settings = TreeSettings(iterations=6, depth=4, learning_rate=0.3)
    mine, theirs = boosted(vectors, settings, weight), training._boosted_by_jobs(vectors, settings, weight)
    assert mine.getNumTrees == 6 and mine.treeWeights == list(theirs.treeWeights)
    assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)
    assert np.allclose(scores(mine, vectors), scores(theirs, vectors), atol=1e-9)
    assert np.allclose(mine.evaluateEachIteration(vectors), theirs.evaluateEachIteration(vectors), atol=1e-9)


def test_rounds_start_no_jobs(spark, vectors):
    """The model of 40 rounds takes as many jobs as that of two."""
    jobs = []
    for rounds in (2, 40):
        group = f"rounds-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        boosted(vectors, TreeSettings(iterations=rounds, depth=3))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] < 12


def test_a_label_that_follows_from_one_feature_needs_one_split(spark):
    rows = [(float(i % 12), random.random(), float(i % 12 >= 8)) for i in range(600)]
    table = spark.createDataFrame(rows, "band double, noise double, __label double")
    model = boosted(VectorAssembler(inputCols=["band", "noise"], outputCol="features").transform(table), TreeSettings(iterations=30))
    assert {len(t.feature) for t in model.trees} == {3} and model.borders[0][model.trees[0].cut[0]] == 7.5
    assert list(model.featureImportances) == [1.0, 0.0]


def test_borders_come_from_all_rows(spark):
    """More values than bins: borders at equal shares of all rows, whatever the batches and tasks."""
    table = spark.range(20000, numPartitions=3).selectExpr("double(id) as a", "double(id % 7) as b", "double(id % 2) as __label")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(table)
    borders = Boosting.of(rows).borders
    assert len(borders[0]) == boosting.BINS - 1 and np.allclose(borders[0], np.arange(1, 32) * 625, atol=60)
    assert list(borders[1]) == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]
    with pytest.raises(ValueError, match="no rows"):
        boosted(rows.where("false"), TreeSettings(iterations=2))
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        boosted(rows.selectExpr("features", "__label * 2 as __label"), TreeSettings(iterations=2))


def test_spark_s_boosting_where_tasks_cannot_run_side_by_side(vectors, monkeypatch):
    settings = TreeSettings(iterations=3, depth=3)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 400)
    monkeypatch.setattr(boosting, "_exchange_folder", lambda spark: None)
    model = boosted(vectors, settings)
    assert not isinstance(model, boosting.BoostedTrees) and training.first_rounds(model, 2).getNumTrees == 2


def test_the_split_is_made_once(spark):
    """What trains twice and scores twice reads the split rows from where they are stored."""
    rows = spark.range(300).selectExpr("id as row_id", "double(id % 10) as x", "double(id % 7) as z", "int(id % 10 > 6) as target")
    settings = TreeSettings(iterations=2, depth=2)
    _, split, _ = rank_features(rows, ["row_id", "target"], settings=settings, exact_split=True, keep_split=True)
    assert "/relfold-" in split.inputFiles()[0] and split.where("is_holdout").count() == 60
