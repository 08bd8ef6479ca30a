from collections import Counter

import pytest
from pyspark.sql import functions as F

from relfold.operators.aggregates import Measure, aggregate_by_key
from relfold.operators.builders import BuilderError, merge_feature
from relfold.operators.enrich import direct_enrich, prefixed
from relfold.operators.keyed import (
    SkewPolicy,
    attach,
    attach_grouped,
    duplicate_keys,
    guarded,
    hot_hashes,
    bucketed,
    stored_with_sketch,
    without_tokens,
    is_unique,
    keyed,
    left_join_unique,
    token_columns,
)
from tests.conftest import rows_of


def test_null_matches_null(frame):
    left = frame("k int", (1,), (None,), (5,))
    right = frame("k int, v int", (1, 10), (None, 20))
    assert rows_of(left_join_unique(left, right, ["k"])) == [(None, 20), (1, 10), (5, None)]
    assert rows_of(left_join_unique(left, right, ["k"], null_safe=False)) == [(None, None), (1, 10), (5, None)]


@pytest.mark.parametrize(
    "ddl, value",
    [("k string", ""), ("k boolean", False), ("k double", 0.0), ("k decimal(5,1)", None), ("k bigint", 0)],
)
def test_null_stays_apart_from_the_stand_in(frame, ddl, value):
    if value is None:
        from decimal import Decimal

        value = Decimal("0.0")
    left = frame(ddl, (value,), (None,))
    right = frame(ddl + ", v int", (value, 1), (None, 2))
    assert sorted(r["v"] for r in left_join_unique(left, right, ["k"]).collect()) == [1, 2]


def test_date_keys_and_mixed_integer_widths(spark, frame):
    left = spark.sql("select date'2020-01-01' d union all select cast(null as date)")
    right = spark.sql("select date'2020-01-01' d, 1 v union all select cast(null as date), 2")
    assert sorted(r["v"] for r in left_join_unique(left, right, ["d"]).collect()) == [1, 2]
    assert rows_of(left_join_unique(frame("k int", (1,)), frame("k bigint, v int", (1, 7)), ["k"])) == [(1, 7)]


def test_key_types_must_agree(frame):
    with pytest.raises(TypeError):
        left_join_unique(frame("k int", (1,)), frame("k string, v int", ("1", 1)), ["k"])


def test_nan_is_a_missing_key(frame):
    left = frame("k double", (float("nan"),), (-0.0,))
    right = frame("k double, v int", (None, 1), (0.0, 2))
    assert sorted(r["v"] for r in left_join_unique(left, right, ["k"]).collect()) == [1, 2]


def test_left_column_wins(frame):
    left = frame("k int, f int", (1, 100))
    right = frame("k int, f int, g int", (1, 200, 300))
    assert rows_of(left_join_unique(left, right, ["k"])) == [(1, 100, 300)]


def test_salted_join_equals_plain_join(frame):
    rows = [(i, 7 if i % 3 else i) for i in range(300)] + [(1000 + i, None) for i in range(100)]
    left = frame("id int, k int", *rows)
    right = frame("k int, v string", *[(i, f"v{i}") for i in range(0, 300, 2)], (7, "hot"), (None, "none"))
    plain = attach(left, ["k"], [keyed(right, ["k"])], hot=[])
    policy = SkewPolicy(share=0.1, salts=5)
    salted = attach(left, ["k"], [keyed(right, ["k"])], policy)
    assert "__salt" in salted._jdf.queryExecution().analyzed().toString()
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, salted.collect()))
    assert salted.columns == plain.columns
    two = attach_grouped(left, {("k",): [keyed(right, ["k"]), prefixed("t", right, "k", null_safe=False)]}, policy)
    assert two.count() == left.count()
    assert two.where("v <=> t__v or k is null").count() == left.count()


def test_exact_copies_of_a_hot_row_survive_salting(frame):
    left = frame("k int", *[(7,)] * 500, *[(i,) for i in range(100, 200)])
    right = frame("k int, v int", (7, 1))
    joined = attach(left, ["k"], [keyed(right, ["k"])], SkewPolicy(0.1, 4))
    assert joined.count() == 600
    assert joined.where("v = 1").count() == 500


def test_hot_keys_are_found(frame):
    df = frame("k int", *[(7,)] * 500, *[(i,) for i in range(500)])
    found = hot_hashes(df, {"h": token_columns(df, ["k"])}, 0.2)["h"]
    mine = df.where("k = 7").select(F.xxhash64(*token_columns(df, ["k"]))).first()[0]
    assert found == [mine]
    assert hot_hashes(df.where("false"), {"h": token_columns(df, ["k"])}, 0.2) == {"h": []}


def test_small_shares_and_second_level_keys_are_split(spark, frame):
    """A key with 0.5 % of the rows, and half of the rows on one key that only a joined frame brings in."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        left = spark.range(4000).selectExpr("id", "cast(if(id < 20, 1, id + 100) as int) as k")
        first = spark.range(5000).selectExpr("cast(id as int) as k", "cast(if(id % 2 = 0, 7, id) as int) as second")
        other = frame("second int, name string", (7, "hot"), (9, "cold"))
        policy = SkewPolicy()
        assert policy.share_in(spark) == 1 / 256
        one = attach(left, ["k"], [keyed(first, ["k"])], policy)
        assert "__salt" in one._jdf.queryExecution().analyzed().toString()
        joined = attach_grouped(left, {("k",): [keyed(first, ["k"])], ("second",): [keyed(other, ["second"])]}, policy)
        assert joined._jdf.queryExecution().analyzed().toString().count("__right_salt") > one._jdf.queryExecution().analyzed().toString().count("__right_salt")
        plain = left.join(first, "k", "left").join(other, "second", "left")
        assert joined.count() == 4000 and joined.where("name = 'hot'").count() == plain.where("name = 'hot'").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_uniqueness_counts_null_as_a_key(frame):
    assert is_unique(frame("k int", (1,), (None,)), ["k"])
    assert not is_unique(frame("k int", (None,), (None,)), ["k"])
    assert rows_of(duplicate_keys(frame("a int, b int", (1, 1), (1, 1), (1, 2)), ["a", "b"]), "n_rows") == [(2,)]


def test_fan_out_fails_the_job(frame):
    left = frame("k int", (1,))
    right = frame("k int, v string", (1, "a"), (1, "b"))
    with pytest.raises(Exception, match="more than one row"):
        merge_feature(left, right, ["k"]).collect()
    assert rows_of(guarded(frame("k int, v string", (1, "a"), (2, None)), ["k"]).visible()) == [(1, "a"), (2, None)]


def test_merge_feature_checks_columns(frame):
    left = frame("k int, f int", (1, 1))
    with pytest.raises(BuilderError, match="both sides"):
        merge_feature(left, frame("k int, f int", (1, 2)), ["k"])
    with pytest.raises(BuilderError, match="feature side"):
        merge_feature(left, frame("j int, g int", (1, 2)), ["k"])
    with pytest.raises(BuilderError, match="base side"):
        merge_feature(left, frame("j int, g int", (1, 2)), ["j"])


def test_merge_on_composite_keys(frame):
    left = frame("a int, b string", (1, "x"), (1, None), (2, "x"))
    right = frame("a int, b string, f int", (1, "x", 5), (1, None, 6))
    assert rows_of(merge_feature(left, right, ["a", "b"])) == [(1, None, 6), (1, "x", 5), (2, "x", None)]


def test_self_join_of_a_root(frame):
    root = frame("id int, g string", (1, "a"), (2, "a"), (3, "b"))
    sizes = aggregate_by_key(root, ["g"], [Measure("size", "n")])
    assert rows_of(attach(root, ["g"], [sizes]), "id", "n") == [(1, 2), (2, 2), (3, 1)]


def test_odd_column_names(frame):
    left = frame("`my.key` int", (1,))
    right = frame("`my.key` int, `a b` int, `c``d` int", (1, 2, 3))
    assert rows_of(direct_enrich(left, "t", right, "my.key")) == [(1, 2, 3)]
    assert direct_enrich(left, "t", right, "my.key").columns == ["my.key", "t__a b", "t__c`d"]


def test_grouped_frame_is_not_shuffled_again(spark, frame):
    base = frame("k int", *[(i,) for i in range(20)])
    child = frame("k int, v int", *[(i % 5, i) for i in range(50)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stats = aggregate_by_key(child, ["k"], [Measure("size", "n")])
        more = aggregate_by_key(child, ["k"], [Measure("max", "m", "v")])
        plan = attach(base, ["k"], [stats, more], hot=[])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # One shuffle of the base and one per grouping, none between grouping and join.
    assert plan.count("Exchange hashpartitioning") == 3
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_joins_start_no_job_and_split_hot_keys_as_they_run(spark):
    """Half of the rows on one key: its partition is read in slices, also by the join that follows."""
    settings = {
        "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        base = spark.range(60000, numPartitions=8).selectExpr("if(id % 2 = 0, 7, id % 5000) as k", "xxhash64(id) as v")
        child = spark.range(20000).selectExpr("id % 5000 as k", "id")
        frames = [aggregate_by_key(child, ["k"], [Measure("sum", "a", "id")]), aggregate_by_key(child, ["k"], [Measure("max", "b", "id")])]
        tracker = spark.sparkContext.statusTracker()
        seen = set(tracker.getJobIdsForGroup(None))
        joined = attach(base, ["k"], frames)
        assert set(tracker.getJobIdsForGroup(None)) == seen
        assert _final_plan(joined).count("skew=true") >= 1
        assert joined.count() == 60000 and joined.where("b is null or a < b").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("policy", [None, SkewPolicy(salts=3)])
def test_twenty_thousand_partitions(spark, frame, policy):
    spark.conf.set("spark.sql.shuffle.partitions", "20000")
    try:
        left = spark.range(3000).selectExpr("id", "cast(if(id % 3 = 0, 7, id) as int) as k")
        right = spark.range(3000).selectExpr("cast(id as int) as k", "id * 2 as twice")
        joined = attach(left, ["k"], [keyed(right, ["k"])], policy)
        if policy:
            assert policy.share_in(spark) == 1 / 80000
            # No key is written into the plan.
            assert len(joined._jdf.queryExecution().logical().toString()) < 10_000
        assert joined.where("twice = 2 * k").count() == 3000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_sketch_rides_along_when_a_root_is_stored(spark):
    root = spark.range(9000).selectExpr("id", "cast(if(id % 3 = 0, 7, id + 100) as int) as k", "if(id % 2 = 0, null, cast(id as string)) as s")
    tracker = spark.sparkContext.statusTracker()
    seen = len(tracker.getJobIdsForGroup(None))
    table, sketch = stored_with_sketch(root, {"k": ["k"], "s": ["s"]}, 0.1)
    assert len(tracker.getJobIdsForGroup(None)) == seen + 1  # the writing
    assert sketch.total == 9000
    for name, value in (("k", "cast(7 as int)"), ("s", "cast(null as string)")):
        row = spark.range(1).selectExpr(f"{value} as {name}")
        assert sketch.hot(name, 0.1) == [row.select(F.xxhash64(*token_columns(row, [name]))).first()[0]]
    child = spark.range(9200).selectExpr("cast(id as int) as k", "id as v")
    by_text = aggregate_by_key(root, ["s"], [Measure("size", "n")])
    seen = len(tracker.getJobIdsForGroup(None))
    joined = attach(attach(table, ["k"], [keyed(child, ["k"])], hot=sketch.hot("k", 0.1)), ["s"], [by_text], hot=sketch.hot("s", 0.1))
    assert len(tracker.getJobIdsForGroup(None)) == seen
    assert joined.where("v = k").count() == 9000 and joined.where("s is null and n = 4500").count() == 4500


def test_bucketed_roots_are_not_shuffled_again(spark, frame):
    """Specs, actions and both joins on one key read the root as it lies; its hot key is known from the writing."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        root = spark.range(400).selectExpr("id", "if(id % 40 = 0, null, id % 37) as user_id", "cast(id % 3 as string) as kind")
        child = spark.range(300).selectExpr("if(id % 50 = 0, null, id % 30) as user_id", "id as v")
        first = [aggregate_by_key(child, ["user_id"], [Measure("sum", "total", "v")])]
        second = [aggregate_by_key(child, ["user_id"], [Measure("max", "most", "v")])]
        kept = bucketed(root, "user_id", share=0.3)
        joined = attach(attach(kept, ["user_id"], first), ["user_id"], second)
        own = aggregate_by_key(kept, ["user_id"], [Measure("size", "n")])
        joined = attach(joined, ["user_id"], [own])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # one for each grouping of the child
        assert plan.count("Bucketed: true") == 2 and "__right_salt" not in plan
        plain = attach(attach(attach(root, ["user_id"], first), ["user_id"], second), ["user_id"], [aggregate_by_key(root, ["user_id"], [Measure("size", "n")])])
        assert without_tokens(joined).columns == plain.columns
        assert rows_of(without_tokens(joined)) == rows_of(plain)
        hot = bucketed(root.withColumn("user_id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id"))), "user_id", share=0.3)
        salted = attach(hot, ["user_id"], first)
        assert "__right_salt" in salted._jdf.queryExecution().analyzed().toString()
        assert salted.count() == 400
        assert rows_of(attach(kept, ["user_id"], [keyed(child.where("v < 30"), ["user_id"], null_safe=False)]), "id", "v") == rows_of(
            attach(root, ["user_id"], [keyed(child.where("v < 30"), ["user_id"], null_safe=False)]), "id", "v")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
