"""What the store keeps between runs: typed copies and profiles by file."""

import os

import pytest

from relfold.operators.profile import key_profile
from relfold.sources import store as store_module
from relfold.sources.files import load_bundle, read_csv
from relfold.sources.store import TableStore
from relfold.workflow import discover, named_like_id
from tests.conftest import rows_of


@pytest.fixture
def parsed(monkeypatch):
    """Paths of the delimited files that were parsed."""
    paths, original = [], store_module.csv_texts
    monkeypatch.setattr(store_module, "csv_texts", lambda spark, path, **o: paths.append(os.path.basename(path)) or original(spark, path, **o))
    return paths


def put(path, text, at):
    path.write_text(text, encoding="utf-8")
    os.utime(path, (at, at))


@pytest.fixture
def folder(tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    put(data / "train.csv", "row_id,user_id,when,target\n" + "\n".join(f"{i},{i % 7},2020-01-0{i % 9 + 1},{i % 2}" for i in range(60)), 1000)
    put(data / "test.csv", "row_id;user_id\n" + "\n".join(f"{100 + i};{i % 7}" for i in range(20)), 1000)
    put(data / "users.csv", 'user_id,`a b`,c\n' + "\n".join(f"{i},NA,x{i}" for i in range(7)), 1000)
    return data


def test_a_delimited_file_is_parsed_once_per_change(spark, folder, tmp_path, parsed):
    first = load_bundle(spark, str(folder), store=TableStore(spark, str(tmp_path / "kept")))
    assert sorted(parsed) == ["test.csv", "train.csv", "users.csv"]
    for name in ("train", "test", "users"):
        plain = read_csv(spark, str(folder / f"{name}.csv"))
        assert first.tables[name].schema == plain.schema and rows_of(first.tables[name]) == rows_of(plain)
    assert {n: c.rows for n, c in first.counts.items()} == {"train": 60, "test": 20, "users": 7}
    del parsed[:]
    again = load_bundle(spark, str(folder), store=TableStore(spark, str(tmp_path / "kept")))
    assert parsed == [] and rows_of(again.train) == rows_of(first.train) and again.counts == first.counts
    put(folder / "users.csv", "user_id,c\n1,2.5\n", 2000)
    changed = load_bundle(spark, str(folder), store=TableStore(spark, str(tmp_path / "kept")))
    assert parsed == ["users.csv"] and rows_of(changed.tables["users"]) == [(1, 2.5)]
    given = load_bundle(spark, str(folder), schemas={"users": "c string, user_id int"}, store=TableStore(spark, str(tmp_path / "kept")))
    assert given.tables["users"].dtypes == [("c", "string"), ("user_id", "int")]


def test_discovery_through_a_store(spark, folder, tmp_path):
    plain = discover(load_bundle(spark, str(folder)))
    through = discover(load_bundle(spark, str(folder), store=TableStore(spark, str(tmp_path / "kept"))))
    assert rows_of(through.keys) == rows_of(plain.keys)
    assert through.edges == plain.edges and through.unique_keys == plain.unique_keys


def test_an_added_file_is_the_only_one_read(spark, tmp_path, monkeypatch):
    table = tmp_path / "data" / "events.parquet"
    rows = spark.range(4000).selectExpr("id as event_id", "id % 50 as user_id", "cast(id % 3 as string) as kind_id")
    for low in (0, 1000):
        rows.where(f"event_id >= {low} and event_id < {low + 1000}").coalesce(1).write.mode("append").parquet(str(table))
    read = []

    def profiled():
        kept = TableStore(spark, str(tmp_path / "kept"))
        source = store_module.SourceFile("events", str(table), "parquet")
        whole = kept.read(source)
        stored = kept.tables["events"]
        original = stored.read
        counting = store_module.StoredTable(stored.files, lambda paths: read.append(len(paths)) or original(paths))
        kept.tables["events"] = counting
        del read[:]
        profile = kept.key_profile(named_like_id, ["events"])
        expected = key_profile({"events": whole}, named_like_id)
        columns = ("column_name", "row_count", "non_null_count", "is_exact")
        assert rows_of(profile, *columns) == rows_of(expected, *columns)
        exact = profile.where("is_exact").select("column_name", "distinct_count", "unique_ratio")
        assert rows_of(exact) == rows_of(expected.where("is_exact").select("column_name", "distinct_count", "unique_ratio")) != []
        return read[1:]  # the first look is at the schema

    assert profiled() == [2, 2]  # sketches, exact counts of event_id
    assert profiled() == []
    rows.where("event_id >= 2000 and event_id < 2500").coalesce(1).write.mode("append").parquet(str(table))
    assert profiled() == [1, 1]
    # Ids that lie among those of other files: their counts do not add up, so the column is counted anew.
    rows.where("event_id % 10 = 0 and event_id < 100").coalesce(1).write.mode("append").parquet(str(table))
    assert profiled() == [1, 4]
    assert profiled() == []


def test_empty_files_and_nulls(spark, tmp_path):
    table = tmp_path / "t.parquet"
    frame = spark.createDataFrame([(None, "a"), (1, None)], "x_id bigint, y_id string")
    frame.coalesce(1).write.parquet(str(table))
    frame.limit(0).coalesce(1).write.mode("append").parquet(str(table))
    kept = TableStore(spark, str(tmp_path / "kept"))
    kept.read(store_module.SourceFile("t", str(table), "parquet"))
    rows = rows_of(kept.key_profile(named_like_id, ["t"]), "column_name", "row_count", "non_null_count", "distinct_count")
    assert rows == [("x_id", 2, 1, 1), ("y_id", 2, 1, 1)]
