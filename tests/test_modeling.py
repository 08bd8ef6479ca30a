import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from relfold.functions.columns import fill_missing
from relfold.functions.ordered import with_position
from relfold.modeling.metrics import auc_by_rank
from relfold.modeling.scoring import cross_validate, score_output
from relfold.modeling.selection import all_features, final_projection, numeric_features, select_features
from relfold.modeling.split import with_exact_folds, with_exact_holdout, with_folds, with_holdout
from relfold.modeling import training
from relfold.modeling.training import (
    MEAN_FOLDS, FeatureEncoder, TreeSettings, boosted, first_rounds, fit_trees, top_features, with_class_weights,
)
from relfold.operators.checks import failed, output_checks, require
from relfold.operators.labels import with_held_out_labels, with_target
from relfold.plans.models import Action, FeatureBuilder, TablePlan
from relfold.session import shared_folder, stored
from relfold.sources.files import load_bundle
from relfold.workflow import build_features, discover, run
from tests.conftest import rows_of

SMALL = TreeSettings(iterations=3, depth=3, learning_rate=0.3)


def brute_auc(rows):
    wins = pairs = 0
    for s1, y1 in rows:
        for s0, y0 in rows:
            if y1 == 1 and y0 == 0:
                pairs += 1
                wins += 1 if s1 > s0 else 0.5 if s1 == s0 else 0
    return wins / pairs


@pytest.mark.parametrize("slices", [1, 4, 64])
def test_auc_forms_agree(spark, frame, slices):
    random.seed(3)
    rows = [(round(random.random(), 1 if i % 2 else 6), int(random.random() < 0.3)) for i in range(200)]
    df = frame("score double, y int", *rows)
    found = auc_by_rank(df, "score", "y", slices).first()
    assert found["auc"] == pytest.approx(brute_auc(rows), abs=1e-6)
    assert found["gini"] == pytest.approx(2 * brute_auc(rows) - 1, abs=2e-6)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0)
    assert evaluator.evaluate(df) == pytest.approx(found["auc"], abs=1e-6)


@pytest.mark.parametrize("slices", [1, 2, 64])
def test_auc_refuses_what_it_could_only_leave_out(frame, slices):
    for rows in ([(None, 1), (0.2, 0), (0.5, 0), (0.9, 1)], [(float("nan"), 1), (0.2, 0)], [(0.3, None), (0.2, 0), (0.4, 1)]):
        with pytest.raises(Exception, match="is null"):
            auc_by_rank(frame("score double, y int", *rows), "score", "y", slices).collect()
    found = auc_by_rank(frame("score double, y int", (0.2, 0), (0.5, 0), (0.9, 1), (0.5, 1)), "score", "y", slices).first()
    assert (found["auc"], found["positives"], found["negatives"]) == (0.875, 2, 2)


def test_auc_of_one_class_is_null(frame):
    assert auc_by_rank(frame("score double, y int", (0.1, 0), (0.2, 0)), "score", "y").first()["auc"] is None


def test_hash_splits_repeat_and_are_close(spark):
    df = spark.range(5000).selectExpr("id as row_id", "cast(id % 10 = 0 as int) as target")
    split = with_holdout(df)
    assert rows_of(split) == rows_of(with_holdout(df.repartition(7)))
    shares = {r["target"]: r["s"] for r in split.groupBy("target").agg(F.avg(F.col("is_holdout").cast("int")).alias("s")).collect()}
    assert all(abs(s - 0.2) < 0.05 for s in shares.values())
    assert with_folds(df).select("fold").distinct().count() == 5


def test_exact_splits(spark):
    df = spark.range(1003).selectExpr("id as row_id", "cast(id % 10 = 0 as int) as target")
    counts = rows_of(with_exact_holdout(df).groupBy("target").agg(F.count_if("is_holdout").alias("n")))
    assert counts == [(0, 180), (1, 20)]
    sizes = with_exact_folds(df).groupBy("target", "fold").count().groupBy("target").agg(
        (F.max("count") - F.min("count")).alias("spread"), F.sum("count").alias("n"))
    assert all(r["spread"] <= 1 for r in sizes.collect()) and sum(r["n"] for r in sizes.collect()) == 1003


def test_positions_match_a_plain_window(spark):
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, 1, id % 20) as k", "(id * 7919) % 100 as t")
    placed = with_position(df, ["k"], F.floor(F.col("t") / 10), ["t", "id"], "pos", {"t": "before"})
    from pyspark.sql.window import Window

    w = Window.partitionBy("k").orderBy("t", "id")
    expected = df.withColumn("pos", F.row_number().over(w)).withColumn("before", F.lag("t").over(w))
    assert rows_of(placed, "id", "pos", "before") == rows_of(expected, "id", "pos", "before")


def test_position_keeps_null_keys(frame):
    df = frame("k int, t int", (None, 1), (None, 2), (1, 5))
    assert rows_of(with_position(df, ["k"], F.lit(0), ["t"], "pos"), "k", "t", "pos") == [(None, 1, 1), (None, 2, 2), (1, 5, 1)]


def test_class_weights(frame):
    df = frame("y int", *[(0,)] * 6, *[(1,)] * 2)
    assert rows_of(with_class_weights(df, "y").distinct()) == [(0, 1.0), (1, 3.0)]
    many = df.sparkSession.range(1500).selectExpr("cast(id as string) as y").unionByName(frame("y string", (None,), (None,)))
    weights = {r["y"]: r["weight"] for r in with_class_weights(many, "y").collect()}
    assert len(weights) == 1501 and weights[None] == 1.0 and weights["7"] == 2.0


def test_fill_missing(frame):
    df = frame("n int, d double, c string, b boolean", (None, float("nan"), None, None), (1, 2.0, "x", True))
    found = rows_of(fill_missing(df, df.columns))
    assert found == [(-999, -999.0, "missing", -999), (1, 2.0, "x", 1)]


@pytest.fixture(scope="module")
def labelled(spark):
    random.seed(5)
    rows = []
    for i in range(400):
        x = random.random()
        rows.append((i, int(x + random.random() * 0.3 > 0.8), x, random.random(), random.choice("abc"), f"u{i % 150}", None if i % 9 else 1.0))
    return spark.createDataFrame(rows, "row_id int, target int, x double, noise double, kind string, who string, gap double")


def test_mixed_encoding(labelled):
    features = ["x", "kind", "who", "gap"]
    encoder = FeatureEncoder(features, "target").fit(labelled)
    assert (encoder.numeric, encoder.texts) == (["x", "gap"], ["kind", "who"])
    one = encoder.transform(labelled.where("row_id = 0"), ["row_id"]).first()["features"]
    who = [r["target"] for r in labelled.where("who = 'u0'").collect()]
    prior = labelled.agg(F.avg("target")).first()[0]
    assert one[2] == pytest.approx((sum(who) + prior) / (len(who) + 1))
    assert one[3] == 1.0
    new = labelled.where("row_id = 0").withColumn("who", F.lit("stranger")).withColumn("kind", F.lit("zz"))
    assert encoder.transform(new, ["row_id"]).first()["features"][2] == pytest.approx(prior)


def test_a_row_s_own_label_does_not_reach_its_encoding(labelled):
    features = ["kind", "who"]
    for row in (0, 17, 101):
        flipped = labelled.withColumn("target", F.when(F.col("row_id") == row, 1 - F.col("target")).otherwise(F.col("target")))
        vectors = []
        for df in (labelled, flipped):
            encoder = FeatureEncoder(features, "target").fit(df)
            vectors.append(encoder.transform(df.where(F.col("row_id") == row), ["row_id"], F.lit(True)).first()["features"])
            assert len(encoder.parts) == MEAN_FOLDS and sum(n for n, _ in encoder.parts) == 400
        assert vectors[0] == vectors[1]


def test_boosting_keeps_the_best_of_all_rounds(labelled):
    split = with_holdout(labelled)
    settings = TreeSettings(iterations=25, depth=3, learning_rate=0.5)
    model = fit_trees(split, ["noise", "gap"], "target", settings, "is_holdout")
    assert model.asked == 25 and 1 <= model.kept <= 25 and model.trees.getNumTrees == model.kept
    everything = fit_trees(split, ["x"], "target", TreeSettings(iterations=4, depth=2))
    assert everything.kept == everything.trees.getNumTrees == 4


def test_training_finds_the_signal(spark, labelled):
    split = with_holdout(labelled)
    model = fit_trees(split, ["x", "noise", "kind", "who", "gap"], "target", SMALL, "is_holdout", balanced=True)
    top = [r["feature"] for r in top_features(model.importances(spark), 2).collect()]
    assert top[0] == "x"
    scored = model.predict(split.where("is_holdout"), ["target"])
    assert auc_by_rank(scored, "score", "target").first()["auc"] > 0.8


def test_ties_in_importance_go_by_name(frame):
    df = frame("feature string, importance double", ("b", 0.5), ("a", 0.5), ("c", 0.9))
    assert [r["feature"] for r in top_features(df, 2).collect()] == ["c", "a"]


def test_selection(labelled):
    test = labelled.drop("target")
    base = {"train": ["row_id", "target", "kind", "who"], "test": ["row_id", "kind", "who"]}
    found = select_features({"train": labelled, "test": test}, base, keep=2, settings=SMALL)
    assert found.selected[0] == "x" and len(found.selected) == 2
    assert found.outputs["test"].columns == ["row_id", "kind", "who", *found.selected]
    assert found.auc_all > 0.7 and found.summary().count() == 1
    with pytest.raises(ValueError, match="lacks base"):
        select_features({"train": labelled}, {"train": ["zz"]})
    with pytest.raises(ValueError, match="no rows"):
        select_features({"train": labelled.where("false")}, base)


def test_feature_rules(labelled):
    assert numeric_features(labelled, ["row_id", "target"]) == ["x", "noise", "gap"]
    assert all_features(labelled, exclude=("who",)) == ["x", "noise", "kind", "gap"]
    assert final_projection(labelled, ["row_id"], ["x", "row_id"]).columns == ["row_id", "x"]
    with pytest.raises(ValueError):
        final_projection(labelled, ["row_id"], ["zz"])


def test_score_report(labelled):
    train, test = labelled.where("row_id < 300"), labelled.where("row_id >= 300")
    score = score_output(
        train.drop("target"), test.drop("target"), test.select("row_id", "target"), source_train=train,
        keys=("who",), settings=SMALL, folds=2, metric="gini",
    )
    row = score.report.first()
    assert row["auc"] > 0.7 and row["gini"] == pytest.approx(2 * row["auc"] - 1, abs=1e-6)
    assert row["primary_score"] == row["gini"]
    assert (row["n_features"], row["train_rows"], row["test_rows"]) == (4, 300, 100)
    assert score.top_features.first()["feature"] == "x"


def test_cross_validation_folds(labelled):
    found = cross_validate(labelled, ["x"], folds=2, settings=SMALL, exact_folds=True)
    assert rows_of(found, "fold") == [(0,), (1,)]
    with pytest.raises(ValueError, match="one class only"):
        cross_validate(labelled.where("target = 0 or row_id % 80 = 0").where("target = 0"), ["x"], folds=2, settings=SMALL)


def test_labels(frame):
    source = frame("row_id int, target int", (1, 0), (2, 1))
    assert rows_of(with_target(frame("row_id int, f int", (1, 5), (3, 6)), source), "row_id", "target") == [(1, 0), (3, None)]
    assert with_target(source, source) is source
    assert rows_of(with_held_out_labels(frame("row_id int", (2,)), source)) == [(2, 1)]
    with pytest.raises(Exception, match="no held-out label for 9"):
        with_held_out_labels(frame("row_id int", (2,), (9,)), source).collect()
    with pytest.raises(ValueError):
        with_held_out_labels(source, frame("row_id int", (1,)))


def test_checks(frame):
    base = {"train": frame("id int, y int", (1, 0), (2, 1)), "test": frame("id int", (3,))}
    good = {"train": frame("id int, y int, f int", (1, 0, 1), (2, 1, None)), "test": frame("id int, f int", (3, 1))}
    require(output_checks(base, good))
    bad = {"train": frame("id int, f double", (1, float("nan"))), "test": frame("id int, g int")}
    names = {(r["check"], r["subject"]) for r in failed(output_checks(base, bad)).collect()}
    assert names == {
        ("base_columns_kept", "train"), ("same_features", "train/test"), ("feature_has_values", "train.f"),
        ("row_count_kept", "train"), ("not_empty", "test"), ("feature_has_values", "test.g"), ("row_count_kept", "test"),
    }
    with pytest.raises(ValueError, match="base_columns_kept"):
        require(output_checks(base, bad))
    many = {n: df.select("*", *[F.lit(i).alias(f"f{i}") for i in range(6)]) for n, df in base.items()}
    assert ("feature_count", "test") in {(r["check"], r["subject"]) for r in failed(output_checks(base, many)).collect()}


def test_stored_frames_lie_in_the_named_folder(spark, frame):
    df = frame("a int, `b c` string", (1, None), (2, "x")).withColumn("nothing", F.lit(None))
    kept = stored(df)
    assert kept.columns == df.columns and rows_of(kept) == rows_of(df)
    assert shared_folder(spark) in kept.inputFiles()[0].replace("file://", "")


def test_null_labels_are_a_class_of_their_own(spark):
    df = spark.range(40).selectExpr("id as row_id", "if(id % 4 = 0, null, if(id % 4 = 1, '', 'x')) as target")
    counts = rows_of(with_exact_holdout(df, share=0.5).groupBy("target").agg(F.count_if("is_holdout").alias("n")))
    assert counts == [(None, 5), ("", 5), ("x", 10)]


def test_whole_run(spark, tmp_path):
    random.seed(8)
    folder = tmp_path / "data"
    folder.mkdir()
    users = [(u, random.random()) for u in range(40)]
    (folder / "users.csv").write_text("user_id,level\n" + "\n".join(f"{u},{v}" for u, v in users))
    visits = [(random.randrange(40), random.randrange(9)) for _ in range(300)]
    (folder / "visits.csv").write_text("user_id;length\n" + "\n".join(f"{u};{v}" for u, v in visits))
    rows = [(i, i % 40, int(users[i % 40][1] > 0.5)) for i in range(200)]
    (folder / "train.csv").write_text("row_id,user_id,target\n" + "\n".join(",".join(map(str, r)) for r in rows))
    (folder / "test.csv").write_text("row_id,user_id\n" + "\n".join(f"{1000 + i},{i}" for i in range(40)))
    bundle = load_bundle(spark, str(folder))
    discovery = discover(bundle)
    assert {(e.child_table, e.requires_aggregation) for e in discovery.edges} == {("users", False), ("visits", True)}
    assert discovery.skipped == [] and ("users", "user_id") in discovery.unique_keys
    plans = [TablePlan("users", "user_id", "many_to_one", False, (Action("direct_join", "users", "user_id", ("level",)),))]
    builder = FeatureBuilder("n", ("user_id",), lambda root, tables: tables["visits"].groupBy("user_id").agg(F.count("*").alias("n_visits")))
    built = build_features(bundle, discovery, plans, builders=[builder], join_tree=True)
    assert [s[4] for s in built.statuses] == ["applied", "applied"]
    assert {"users__level", "n_visits", "visits__length__mean"} <= set(built.roots["train"].columns)
    found = run(bundle, str(tmp_path / "out"), plans, builders=[builder], settings=SMALL)
    assert found.selected[0] == "users__level"
    written = load_bundle(spark, str(tmp_path / "out"))
    assert written.train.columns == ["row_id", "user_id", "target", *found.selected]
    assert written.test.count() == 40


def test_the_first_rounds_are_what_fewer_rounds_give(labelled):
    vectors = FeatureEncoder(["x", "noise"], "target").fit(labelled).transform(labelled.withColumn("__label", F.col("target").cast("double")), ["__label"])
    many, few = boosted(vectors, TreeSettings(iterations=9, depth=3)), boosted(vectors, TreeSettings(iterations=4, depth=3))
    prefix = first_rounds(many, 4)
    assert prefix.getNumTrees == 4 and prefix.treeWeights == few.treeWeights
    assert prefix.featureImportances == few.featureImportances
    assert prefix.transform(vectors).select("probability").collect() == few.transform(vectors).select("probability").collect()


def test_boosting_is_run_once(labelled, monkeypatch):
    runs = []
    original = training.boosted
    monkeypatch.setattr(training, "boosted", lambda *a, **k: runs.append(1) or original(*a, **k))
    model = fit_trees(with_holdout(labelled), ["noise", "gap"], "target", TreeSettings(iterations=25, depth=3, learning_rate=0.5), "is_holdout")
    assert model.kept < 25 and len(runs) == 1


@pytest.mark.parametrize("fold", [0, 2])
def test_one_encoding_serves_all_folds(labelled, fold):
    """Means by subtraction equal those of an encoder that never saw the fold."""
    features = ["x", "kind", "who"]
    placed = with_exact_folds(labelled, folds=3)
    encoder = FeatureEncoder(features, "target", "fold", 3).fit(placed)
    encoded = stored(encoder.encode(placed, ["row_id", "fold"], F.lit(True), [None, 0, 1, 2]))
    alone = FeatureEncoder(features, "target").fit(placed.where(F.col("fold") != fold))
    apart = alone.transform(placed, ["row_id", "fold"], F.col("fold") != fold)
    together = encoder.vectors(encoded, ["row_id", "fold"], fold)
    mine, theirs = ({r["row_id"]: r["features"].toArray() for r in df.collect()} for df in (together, apart))
    assert len(mine) == 400 and all(np.allclose(mine[k], theirs[k]) for k in mine)
    every = FeatureEncoder(features, "target").fit(placed).transform(placed, ["row_id"], F.lit(True))
    whole = {r["row_id"]: r["features"].toArray() for r in encoder.vectors(encoded, ["row_id"]).collect()}
    assert all(np.allclose(whole[r["row_id"]], r["features"].toArray()) for r in every.collect())
