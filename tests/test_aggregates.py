import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from relfold.operators.aggregates import (
    MORE_CANDIDATES,
    Measure,
    _candidates,
    aggregate_by_key,
    automatic_measures,
    categorical_measures,
    collect_top_values,
    numeric_measures,
    top_values,
)
from tests.conftest import rows_of


def agg(df, keys, *measures, **options):
    return rows_of(aggregate_by_key(df, keys, list(measures), **options).visible())


@pytest.fixture
def nulls(frame):
    return frame("k int, v double, c string", (1, None, "b"), (1, None, "a"), (2, 3.0, "z"), (None, 1.0, None))


def test_sum_of_nothing_is_zero_and_std_of_one_is_null(nulls):
    found = agg(nulls, ["k"], Measure("sum", "s", "v"), Measure("std", "d", "v"), Measure("size", "n"), Measure("count", "c", "v"))
    assert found == [(None, 1.0, None, 1, 1), (1, 0.0, None, 2, 0), (2, 3.0, None, 1, 1)]


def test_mode_takes_the_smallest_of_equals_and_null_for_none(nulls):
    assert agg(nulls, ["k"], Measure("mode", "m", "c")) == [(None, None), (1, "a"), (2, "z")]


def test_mode_and_its_share_against_counting(frame):
    random.seed(1)
    rows = [(random.choice([1, 2, None]), random.choice(["a", "b", "c", None]), random.choice([1, 5, 10, None])) for _ in range(400)]
    df = frame("k int, c string, n int", *rows)
    found = {
        r[0]: r[1:]
        for r in agg(
            df, ["k"], Measure("mode", "mc", "c"), Measure("mode", "mn", "n"), Measure("mode_ratio", "rc", "c"),
            Measure("nunique", "u", "c"), Measure("size", "z"), columns_per_pass=1,
        )
    }
    for key in (1, 2, None):
        mine = [r for r in rows if r[0] == key]
        texts = Counter(r[1] for r in mine if r[1] is not None)
        numbers = Counter(r[2] for r in mine if r[2] is not None)
        top = max(texts.values())
        expected_text = min(v for v, n in texts.items() if n == top)
        expected_number = min(v for v, n in numbers.items() if n == max(numbers.values()))
        assert found[key] == (expected_text, expected_number, top / sum(texts.values()), len(texts), len(mine))


def test_measures_that_follow_from_value_counts_need_one_pass(frame):
    df = frame("k int, c string, d string", (1, "a", "x"), (1, "a", None), (1, None, None), (2, None, "y"))
    measures = [
        Measure("mode", "m", "c"), Measure("size", "z"), Measure("count", "n", "c"), Measure("nunique", "u", "c"),
        Measure("freq", "f", "c", value="a"), Measure("is", "i", "c", value="b"), Measure("mode", "w", "d", where="c = 'a'"),
    ]
    built = aggregate_by_key(df, ["k"], measures).visible()
    assert rows_of(built) == [(1, "a", 3, 2, 1, 2, 0, "x"), (2, None, 1, 0, 0, 0, 0, None)]
    assert "Join" not in built._jdf.queryExecution().optimizedPlan().toString()


def test_nan_is_missing_and_zeros_are_one_value(frame):
    df = frame("k int, v double", (1, float("nan")), (1, 0.0), (1, -0.0), (1, 4.0))
    found = agg(df, ["k"], Measure("nunique", "u", "v"), Measure("mean", "m", "v"), Measure("count", "c", "v"), Measure("max", "x", "v"))
    assert found == [(1, 2, 4.0 / 3, 3, 4.0)]


def test_booleans_are_numbers(frame):
    df = frame("k int, b boolean", (1, True), (1, False), (1, None))
    assert agg(df, ["k"], Measure("mean", "m", "b"), Measure("max", "x", "b"), Measure("sum", "s", "b")) == [(1, 0.5, 1, 1)]


def test_frequency_and_one_hot_count_null_as_other(frame):
    df = frame("k int, c string", (1, "a"), (1, "a"), (1, None), (2, "b"))
    measures = categorical_measures("t", df, ["c", "absent"], ["top_k_frequency", "top_k_one_hot"], {"c": ["a", "zz"]})
    frame_ = aggregate_by_key(df, ["k"], measures).visible()
    assert frame_.columns == ["k", "t__c__freq__a", "t__c__freq__zz", "t__c__is__a", "t__c__is__zz"]
    assert rows_of(frame_) == [(1, 2, 0, 1, 0), (2, 0, 0, 0, 0)]


def test_share_of_ones_counts_null_as_not_one(frame):
    df = frame("k int, r int", (1, 1), (1, 0), (1, None), (1, 1))
    assert agg(df, ["k"], Measure("share_of_ones", "s", "r")) == [(1, 0.5)]


def test_filtered_measures_keep_every_group(frame):
    df = frame("k int, v int", (1, 1), (1, 5), (2, 1))
    found = agg(df, ["k"], Measure("count", "c", "v", where="v > 2"), Measure("sum", "s", "v", where="v > 2"),
                Measure("nunique", "u", "v", where="v > 2"), Measure("mode", "m", "v", where="v > 2"))
    assert found == [(1, 1, 5, 1, 5), (2, 0, 0, 0, None)]


def test_automatic_measures(frame):
    df = frame("k int, x int, order_id int, c string", (1, 2, 9, "a"), (1, 4, 9, "b"), (None, None, 1, None))
    measures = automatic_measures("t", df, "k")
    assert [m.alias for m in measures] == [
        "t__x__mean", "t__x__max", "t__x__min", "t__x__nunique",
        "t__order_id__mean", "t__order_id__max", "t__order_id__min", "t__order_id__nunique",
        "t__c__nunique", "t__row_count",
    ]
    assert agg(df, ["k"], *measures) == [(None, None, None, None, 0, 1.0, 1, 1, 1, 0, 1), (1, 3.0, 4, 2, 2, 9.0, 9, 9, 1, 2, 2)]
    assert len(automatic_measures("t", df, "k", exclude_ids=True)) == 6


def test_key_only_child_gives_one_row_count(frame):
    df = frame("k int", (1,), (1,), (2,))
    assert agg(df, ["k"], *automatic_measures("t", df, "k")) == [(1, 2), (2, 1)]


def test_many_distinct_counts_in_passes(frame):
    random.seed(2)
    rows = [tuple(random.choice([None, 1, 2, 3]) for _ in range(7)) for _ in range(100)]
    df = frame("k int, " + ", ".join(f"c{i} int" for i in range(6)), *rows)
    measures = [Measure("nunique", f"u{i}", f"c{i}") for i in range(6)]
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row[1:])
    expected = sorted(
        ((k, *(len({r[i] for r in g if r[i] is not None}) for i in range(6))) for k, g in groups.items()),
        key=lambda t: [(v is not None, str(v)) for v in t],
    )
    assert agg(df, ["k"], *measures, columns_per_pass=2) == expected
    assert agg(df, ["k"], *measures) == expected
    assert len(agg(df, ["k"], *measures, approx_distinct=True)) == len(expected)


def test_no_measure_leaves_the_distinct_keys(frame):
    assert agg(frame("k int, c string", (1, "a"), (1, "b"), (None, "c")), ["k"]) == [(None,), (1,)]


def test_numeric_measures_reject_unknown_and_pass_over_text(frame):
    df = frame("k int, v int, c string", (1, 1, "a"))
    with pytest.raises(ValueError, match="median"):
        numeric_measures("t", df, ["v"], ["median"])
    assert [m.alias for m in numeric_measures("t", df, ["v", "c", "absent"], ["sum"])] == ["t__v__sum"]


def test_top_values_order_and_default(frame):
    df = frame("c string, n int", *[("a", 1)] * 2, *[("b", 2)] * 2, ("c", None), ("d", None), (None, None))
    found = rows_of(top_values(df, ["c", "n"], 3), "column_name", "rank", "value", "n_rows")
    assert found == [("c", 1, "a", 2), ("c", 2, "b", 2), ("c", 3, "c", 1), ("n", 1, "1", 2), ("n", 2, "2", 2)]
    assert collect_top_values(df, ["c"], 0) == {"c": ["a", "b", "c"]}


def plain_top(df, column, k):
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).count().collect()
    ranked = sorted(((-r["count"], r["value"]) for r in counts))[:k]
    return [(column, value, -n, i + 1) for i, (n, value) in enumerate(ranked)]


@pytest.mark.parametrize("tracked", [64, 1024, 65536])
def test_top_values_from_candidates_are_exact(spark, tracked):
    """Skewed, uniform, tied, null and wholly different values; few counters force the full way."""
    df = spark.range(20000).selectExpr(
        "cast(pow(20000 / (id + 1), 1) as int) as skewed", "id % 5000 as uniform", "id % 4 as tied", "id as own",
        "if(id % 3 = 0, null, concat('v', id % 7)) as gaps", "cast(null as string) as nothing",
    )
    columns = ["skewed", "uniform", "tied", "own", "gaps", "nothing"]
    for k in (1, 3, 4):
        found = top_values(df, columns, k, tracked)
        expected = [row for c in columns for row in plain_top(df, c, k)]
        assert sorted(map(tuple, found.select("column_name", "value", "n_rows", "rank").collect())) == sorted(expected)
    assert top_values(df.limit(0), columns, 3).count() == 0


def test_only_candidates_of_a_skewed_column_are_shuffled(spark):
    df = spark.range(50000).selectExpr("if(id % 2 = 0, id % 5, id) as v")
    found = top_values(df, ["v"], 3)
    assert [tuple(r) for r in found.select("column_name", "value", "n_rows", "rank").orderBy("rank").collect()] == plain_top(df, "v", 3)
    candidates = _candidates(df.select(F.col("v").cast("string").alias("v")), ["v"], 3, 65536)["v"]
    assert candidates[1] and len(candidates[0]) <= 3 + MORE_CANDIDATES
