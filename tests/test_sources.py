import datetime

import pytest

from relfold.sources.files import (
    MissingTableError,
    SeparatorError,
    TableSet,
    detect_separator,
    header_columns,
    list_tables,
    load_bundle,
    read_csv,
    write_table,
)
from tests.conftest import rows_of


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separators(spark, tmp_path, sep):
    path = put(tmp_path / "t.csv", "\n".join(sep.join(r) for r in (["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"])) + "\n")
    assert detect_separator(spark, path) == sep
    assert header_columns(spark, path) == ["a", "b", "c"]
    assert rows_of(read_csv(spark, path)) == [(1, 2, 3), (4, 5, 6)]


def test_separator_is_the_one_on_every_line(spark, tmp_path):
    assert detect_separator(spark, put(tmp_path / "a.csv", "a;b\n1,2;3\n\n4;5,6,7\n")) == ";"
    assert detect_separator(spark, put(tmp_path / "b.csv", "a,b;c\n1,2;3\n")) == ","
    # Only the first five lines count.
    assert detect_separator(spark, put(tmp_path / "c.csv", "a,b\n" * 5 + "x;y;z\n")) == ","


def test_one_column_file(spark, tmp_path):
    path = put(tmp_path / "t.csv", "a\n1\n2\n")
    with pytest.raises(SeparatorError):
        detect_separator(spark, path)
    assert rows_of(read_csv(spark, path, default_sep=",")) == [(1,), (2,)]


def test_types_and_null_tokens(spark, tmp_path):
    path = put(
        tmp_path / "t.csv",
        "id,d,t,n,b,e,m,big\n1,1.5,2020-01-01,NA,True,1e3,1,99999999999999999999\n2,NaN,2020-01-02,,False,2,x,1\n3,-2,null,7,True,.5,NULL,2\n",
    )
    df = read_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "string", "bigint", "boolean", "double", "string", "double"]
    assert rows_of(df.drop("big")) == [
        (1, 1.5, "2020-01-01", None, True, 1000.0, "1"), (2, None, "2020-01-02", None, False, 2.0, "x"), (3, -2.0, None, 7, True, 0.5, None)
    ]


def test_given_schema(spark, tmp_path):
    path = put(tmp_path / "t.csv", "id,d,x\n1,2020-01-01,NA\n")
    df = read_csv(spark, path, schema="d date, id int, x double")
    assert rows_of(df) == [(datetime.date(2020, 1, 1), 1, None)]
    with pytest.raises(ValueError):
        read_csv(spark, path, schema="zz int")


def test_quotes(spark, tmp_path):
    path = put(tmp_path / "t.csv", 'a,b\n"x, y",1\n"say ""hi""",2\n')
    assert rows_of(read_csv(spark, path)) == [('say "hi"', 2), ("x, y", 1)]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = put(tmp_path / "t.csv", 'a,b\n"x\ny",1\n')
    assert rows_of(read_csv(spark, path, sep=",", multi_line=True)) == [("x\ny", 1)]


def test_line_breaks_in_quotes_survive_the_folder(spark, tmp_path):
    rows = "".join(f'{i},"note {i}{chr(10) if i == 3 else ""} end"\n' for i in range(7))
    put(tmp_path / "train.csv", "row_id,note\n" + rows)
    put(tmp_path / "test.csv", "row_id,note\n1,x\n")
    train = load_bundle(spark, str(tmp_path)).train
    assert train.count() == 7 and train.dtypes == [("row_id", "bigint"), ("note", "string")]
    cut = load_bundle(spark, str(tmp_path), options={"train": {"multi_line": False}}).train
    assert cut.count() == 8


def test_a_column_without_values_is_numeric(spark, tmp_path):
    assert read_csv(spark, put(tmp_path / "t.csv", "a,b\n1,\n2,NA\n")).dtypes == [("a", "bigint"), ("b", "double")]


def test_folder(spark, tmp_path):
    put(tmp_path / "train.csv", "row_id,target\n1,0\n")
    put(tmp_path / "test.csv", "row_id;x\n1;0\n")
    put(tmp_path / "readme.txt", "no table")
    spark.range(3).write.parquet(str(tmp_path / "more.parquet"))
    assert [(t.name, t.format) for t in list_tables(spark, str(tmp_path))] == [("more", "parquet"), ("test", "csv"), ("train", "csv")]
    bundle = load_bundle(spark, str(tmp_path))
    assert list(bundle.additional) == ["more"] and bundle.test.columns == ["row_id", "x"]
    assert spark.sql("select count(*) from more").first()[0] == 3
    assert header_columns(spark, str(tmp_path / "more.parquet")) == ["id"]


def test_missing_root(spark, tmp_path):
    put(tmp_path / "train.csv", "row_id,target\n1,0\n")
    with pytest.raises(MissingTableError):
        load_bundle(spark, str(tmp_path))


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_sink_round_trip(spark, tmp_path, format):
    path = str(tmp_path / f"out.{format}")
    write_table(spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id bigint, c string"), path, format)
    table = list_tables(spark, str(tmp_path))[0]
    df = spark.read.parquet(path) if format == "parquet" else read_csv(spark, table.path)
    assert rows_of(df) == [(1, 'a "b", c'), (2, None)]
    with pytest.raises(Exception):
        write_table(df, path, format)


def test_table_set(spark):
    tables = TableSet({"a": spark.range(2), "b": spark.range(3)}).keep("a")
    assert tables["a"].storageLevel.useMemory and not tables["b"].storageLevel.useMemory
    assert len(tables) == 2 and list(tables) == ["a", "b"] and "b" in tables
    tables.register_views()
    assert spark.table("b").count() == 3
    tables.release()
    assert not tables["a"].storageLevel.useMemory
