import pytest

from relfold.operators.profile import (
    added_columns,
    candidate_keys,
    column_profile,
    enrich_with_dictionary,
    key_profile,
    same_columns,
    table_profile,
    with_descriptions,
)
from relfold.sources.profiles import load_profile, profile_exists, save_profile
from tests.conftest import rows_of


def test_ratios(frame):
    df = frame("id int, c string, d double", (1, "a", 1.0), (2, "a", float("nan")), (3, None, -0.0), (4, "b", 0.0))
    found = rows_of(column_profile({"t": df}), "column_name", "row_count", "non_null_ratio", "unique_ratio")
    assert found == [("c", 4, 0.75, 0.5), ("d", 4, 0.75, 0.5), ("id", 4, 1.0, 1.0)]


def test_empty_table_has_null_ratios(frame):
    found = rows_of(column_profile({"t": frame("id int, c string")}), "column_name", "row_count", "non_null_ratio", "unique_ratio")
    assert found == [("c", 0, None, None), ("id", 0, None, None)]
    rough = rows_of(column_profile({"t": frame("id int")}, exact="none"), "row_count", "unique_ratio")
    assert rough == [(0, None)]


def test_estimates_are_close(spark, frame):
    df = spark.range(5000).selectExpr("id", "id % 10 as g", "cast(id % 100 as string) as s")
    found = {r["column_name"]: r["unique_ratio"] for r in column_profile({"t": df}, exact="keys").collect()}
    assert found["id"] == 1.0
    assert abs(found["g"] - 0.002) < 0.0001 and abs(found["s"] - 0.02) < 0.001


def test_key_profile_counts_exactly_where_it_matters(spark):
    df = spark.range(10000).selectExpr("id", "id % 50 as shop_id", "greatest(id, 100) as near_id", "id as other")
    found = {r["column_name"]: r["unique_ratio"] for r in key_profile({"t": df}, lambda t, c: c.endswith("id")).collect()}
    assert set(found) == {"id", "shop_id", "near_id"}
    assert found["id"] == 1.0 and found["near_id"] == 0.99
    assert found["shop_id"] < 0.01


def test_table_profile_and_keys(frame):
    profile = column_profile({"t": frame("id int, x int, shop_id int, ids int", (1, 1, 1, 1))})
    row = table_profile(profile).first()
    assert (row["row_count"], row["column_count"], row["candidate_keys"]) == (1, 4, ["id", "shop_id"])
    assert rows_of(candidate_keys(profile, lambda c: c == "x"), "column_name") == [("x",)]


def test_dictionary(frame):
    profile = column_profile({"t": frame("id int, x int, y int", (1, 1, 1))})
    words = frame(
        "table_name string, column_name string, description string, allowed_values string",
        ("t.csv", " id ", " key ", " "), ("t", "x", "", "0,1"), ("u.csv", "y", "other table", None),
    )
    enriched = enrich_with_dictionary(profile, words)
    assert rows_of(enriched, "column_name", "description", "allowed_values") == [
        ("id", "key", None), ("x", None, "0,1"), ("y", None, None)
    ]
    again = enrich_with_dictionary(enriched, words.where("column_name = 'x'"))
    assert ("id", "key", None) in rows_of(again, "column_name", "description", "allowed_values")
    noted = with_descriptions(frame("id int, x int, y int", (1, 1, 1)), "t", enriched)
    assert noted.schema["id"].metadata == {"description": "key"} and noted.schema["y"].metadata == {}


def test_repeated_and_table_entries_of_a_dictionary(frame):
    profile = column_profile({"t": frame("id int", (1,))})
    ddl = "table_name string, column_name string, description string, allowed_values string, at int"
    words = frame(ddl, ("t", "id", "first", None, 1), ("t.csv", "id", "last", None, 2), ("t", " ", "all about t", None, 3))
    found = enrich_with_dictionary(profile, words, position="at")
    assert rows_of(found, "description", "table_description") == [("last", "all about t")]
    again = enrich_with_dictionary(found, words.where("false"))
    assert rows_of(again, "description", "table_description") == [("last", "all about t")]
    with pytest.raises(Exception, match="repeated dictionary entry of t.id"):
        enrich_with_dictionary(profile, words).collect()


def test_profile_is_stored_and_read_back(spark, frame, tmp_path):
    profile = column_profile({"t": frame("id int", (1,), (2,))})
    path = str(tmp_path / "profile")
    assert not profile_exists(spark, path)
    save_profile(profile, path)
    assert profile_exists(spark, path)
    assert rows_of(load_profile(spark, path), *profile.columns) == rows_of(profile)


def test_column_sets(frame):
    train, test = frame("id int, target int", (1, 1)), frame("id int", (1,))
    assert same_columns(train, test) and not same_columns(train, test.withColumnRenamed("id", "x"))
    assert added_columns(test, train) == ["target"]
