"""Every registered query against its defining SQL on the smallest tables."""

import time
from dataclasses import replace

import duckdb
import pytest

from catalog.oracle import ORACLE
from catalog.queries import QUERIES, _planted, fixture_tree
from catalog.views import Views
from relfold.modeling import scoring, training
from relfold.operators.enrich import enrich_tree

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels")
# 300 rounds of boosting and more take minutes; one query stands for all, and these run with fewer rounds.
SLOW = ("top5_retrain", "score_report", "reported_features")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


def compared(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in order)) for row in cursor.fetchall())
    found = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(ORACLE) - set(SLOW)))
def test_query(spark, duck, name):
    compared(spark, duck, name)


@pytest.mark.parametrize("name", SLOW)
def test_model_query_with_fewer_rounds(spark, duck, name, monkeypatch):
    original = training.boosted
    for module in (training, scoring):
        monkeypatch.setattr(module, "boosted", lambda rows, settings, weight=None: original(rows, replace(settings, iterations=12), weight))
    compared(spark, duck, name)


@pytest.mark.parametrize("name", ["category_families", "spec_ratio"])
def test_specs_read_the_items_once(spark, name):
    """The items with their orders are stored once; nothing else reads the tables they come from."""
    files = [f.rsplit("/", 2) for f in QUERIES[name](spark, SF_DIR).inputFiles()]
    assert not {part for f in files for part in f} & {"lineitem.parquet", "orders.parquet"}


def test_model_tables_of_both_roots_are_joined_once(spark):
    """Both roots come from one stored table, and hold the rows that each would get alone."""
    views = Views(spark, SF_DIR, keep=True)
    both = _planted(views)
    assert set(both["train"].inputFiles()) == set(both["test"].inputFiles())
    assert not {part for f in both["train"].inputFiles() for part in f.rsplit("/", 2)} & {f"{t}.parquet" for t in TABLES}
    alone = _planted(views, ["train"])["train"]
    assert both["train"].columns == alone.columns and set(both["test"].columns) == set(alone.columns)
    rounded = [{str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect()} for df in (both["train"], alone)]
    assert rounded[0] == rounded[1] and len(rounded[0]) == views.train.count()


def test_a_tree_s_children_leave_no_shuffles_on_disk(spark):
    """What is discovered, aggregated and stored before the base is joined leaves nothing behind but its results."""
    views = Views(spark, SF_DIR)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f.getName() for f in (lambda all: [all.apply(i) for i in range(all.size())])(disk.getAllFiles()) if f.getName().startswith("shuffle_")}

    before = shuffles()
    wide = QUERIES["snowflake_enrich"](spark, SF_DIR)
    until = time.time() + 20  # files are removed in the background
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert any("/relfold-" in f for f in wide.inputFiles())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    lazy = enrich_tree(views.train, views.tables(), fixture_tree(spark, SF_DIR))
    assert wide.columns == lazy.columns and wide.exceptAll(lazy).isEmpty() and lazy.exceptAll(wide).isEmpty()
