"""Reading and writing tables: folder scan, separator detection, typed CSV, parquet."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import TYPE_CHECKING

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relfold.functions.columns import quoted

if TYPE_CHECKING:
    from relfold.operators.checks import Counts
    from relfold.sources.store import TableStore

SEPARATORS = (",", ";", "\t", "|")
SAMPLE_LINES = 5
FORMATS = ("csv", "parquet")

# Texts a CSV reader takes for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"^\s*[+-]?inf(inity)?\s*$"


class SeparatorError(ValueError):
    """No known separator occurs on every sampled line."""


class MissingTableError(ValueError):
    """A required table is not in the folder."""


@dataclass(frozen=True)
class SourceFile:
    name: str
    path: str
    format: str


def list_tables(spark: SparkSession, folder: str) -> list[SourceFile]:
    """Files (or folders of part files) ``{table}.csv`` / ``{table}.parquet``, sorted by name.

    Works on any file system Spark reads. Only the top level is listed.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in fs.listStatus(path):
        file_name = status.getPath().getName()
        stem, _, suffix = file_name.rpartition(".")
        if stem and suffix in FORMATS:
            if stem in found:
                raise ValueError(f"table {stem!r} exists in more than one format in {folder}")
            found[stem] = SourceFile(stem, status.getPath().toString(), suffix)
    return [found[name] for name in sorted(found)]


def detect_separator(spark: SparkSession, path: str, default_sep: str | None = None) -> str:
    """The separator that occurs most often on the poorest of the first lines; ties go to the earlier
    in ``SEPARATORS``. Files of one column need ``default_sep``."""
    lines = spark.read.text(path).limit(SAMPLE_LINES).where(F.length("value") > 0)
    counts = lines.agg(
        *[F.min(F.length("value") - F.length(F.replace("value", F.lit(s), F.lit("")))).alias(f"s{i}")
          for i, s in enumerate(SEPARATORS)]
    ).first()
    scores = [counts[f"s{i}"] or 0 for i in range(len(SEPARATORS))]
    best = max(scores)
    if best > 0:
        return SEPARATORS[scores.index(best)]
    if default_sep is not None:
        return default_sep
    raise SeparatorError(f"no separator of {SEPARATORS} found in {path}; pass default_sep for a one-column file")


def header_columns(spark: SparkSession, path: str, sep: str | None = None, default_sep: str | None = None) -> list[str]:
    """Column names of a table without reading its rows."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).columns
    sep = sep or detect_separator(spark, path, default_sep)
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def _cleaned(column: Column) -> Column:
    return F.when(~column.isin(*NULL_TOKENS), column)


def type_checks(texts: DataFrame) -> list[Column]:
    """Aggregates that tell, for each text column, whether every value reads as an integer, a float or a boolean."""
    checks = []
    for i, name in enumerate(texts.columns):
        value = quoted(name)
        number = value.rlike(_DECIMAL) | F.lower(value).rlike(_INFINITE)
        checks += [
            F.count(value).alias(f"n{i}"),
            F.bool_and(F.when(value.isNotNull(), value.rlike(_INTEGER) & value.try_cast("bigint").isNotNull())).alias(f"i{i}"),
            F.bool_and(F.when(value.isNotNull(), number & value.try_cast("double").isNotNull())).alias(f"d{i}"),
            F.bool_and(value.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias(f"b{i}"),
        ]
    return checks


def types_found(names: Sequence[str], found: Mapping) -> dict[str, str]:
    """The type of each column from its ``type_checks``; a column without values counts as floats."""
    kinds = {}
    for i, name in enumerate(names):
        kinds[name] = "string" if found[f"n{i}"] else "double"
        if found[f"n{i}"]:
            kinds[name] = next((t for c, t in (("i", "bigint"), ("d", "double"), ("b", "boolean")) if found[f"{c}{i}"]), "string")
    return kinds


def as_types(texts: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    return texts.select(*[(F.trim(quoted(c)).cast(k) if k != "string" else quoted(c)).alias(c) for c, k in kinds.items()])


def _typed(df: DataFrame) -> DataFrame:
    """Integers, floats and booleans where every value reads as one; anything else stays text.

    One aggregation over the whole input decides, so a late odd value is never lost. Dates stay text.
    """
    return as_types(df, types_found(df.columns, df.agg(*type_checks(df)).first().asDict()))


def leaves_quotes_open(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, so that a field goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def csv_texts(
    spark: SparkSession, path: str, sep: str | None = None, default_sep: str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """The columns of a delimited file as texts, missing values as null.

    ``multi_line`` allows line breaks inside quotes; such files cannot be split among tasks. Left open, it is found
    out by one pass over the lines: where a line leaves a quote open, the file is read so.
    """
    sep = sep or detect_separator(spark, path, default_sep)
    if multi_line is None:
        multi_line = leaves_quotes_open(spark, path)
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multi_line)
    texts = reader.csv(path)
    return texts.select(*[_cleaned(quoted(c)).alias(c) for c in texts.columns])


def declared_types(spark: SparkSession, texts: DataFrame, schema: str, path: str) -> dict[str, str]:
    """Column types of a DDL schema, all of whose columns must be there."""
    wanted = spark.createDataFrame([], schema).schema.fields
    missing = [f.name for f in wanted if f.name not in texts.columns]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    return {f.name: f.dataType.simpleString() for f in wanted}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    sep: str | None = None,
    default_sep: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """A delimited file with a header (see ``csv_texts``). With ``schema`` (DDL) no types are inferred."""
    texts = csv_texts(spark, path, sep, default_sep, multi_line)
    if schema is None:
        return _typed(texts)
    kinds = declared_types(spark, texts, schema, path)
    return texts.select(*[quoted(c).cast(k).alias(c) for c, k in kinds.items()])


def read_table(
    spark: SparkSession, source: SourceFile, schema: str | None = None, default_sep: str | None = None, **options
) -> DataFrame:
    """``options`` are those of ``read_csv``; a Parquet table needs none."""
    if source.format == "parquet":
        return spark.read.parquet(source.path)
    return read_csv(spark, source.path, **{"schema": schema, "default_sep": default_sep, **options})


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """A folder of part files, written by all tasks side by side."""
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


@dataclass
class TableSet(Mapping):
    """Named tables: DataFrames, their temporary views, and optional caching of reused ones."""

    tables: dict[str, DataFrame]
    _kept: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def __getitem__(self, name: str) -> DataFrame:
        return self._kept.get(name) if name in self._kept else self.tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)

    def keep(self, *names: str) -> "TableSet":
        """Persist tables that several features read."""
        for name in names:
            if name not in self._kept:
                self._kept[name] = self.tables[name].persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def release(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    def register_views(self) -> None:
        for name in self:
            self[name].createOrReplaceTempView(name)


@dataclass(frozen=True)
class Bundle:
    """The two roots and the tables around them."""

    tables: TableSet
    train_name: str = "train"
    test_name: str = "test"
    #: The store the tables came through, if any (``relfold.sources.store``).
    store: "TableStore | None" = None

    @property
    def counts(self) -> dict[str, "Counts"]:
        """Rows of tables that were counted as the store copied them."""
        return self.store.counts if self.store else {}

    @property
    def train(self) -> DataFrame:
        return self.tables[self.train_name]

    @property
    def test(self) -> DataFrame:
        return self.tables[self.test_name]

    @property
    def roots(self) -> dict[str, DataFrame]:
        return {self.train_name: self.train, self.test_name: self.test}

    @property
    def additional(self) -> dict[str, DataFrame]:
        return {n: self.tables[n] for n in self.tables if n not in (self.train_name, self.test_name)}


def load_bundle(
    spark: SparkSession,
    folder: str,
    schemas: Mapping[str, str] | None = None,
    default_sep: str | None = None,
    train_name: str = "train",
    test_name: str = "test",
    options: Mapping[str, Mapping] | None = None,
    store: "TableStore | None" = None,
) -> Bundle:
    """Every table of a folder; the two roots must be among them. ``options`` holds options of ``read_csv`` by
    table. With a ``store``, delimited files are parsed once per change of theirs and read from its copy since."""
    read = store.read if store else partial(read_table, spark)
    tables = {
        source.name: read(source, (schemas or {}).get(source.name), default_sep, **(options or {}).get(source.name, {}))
        for source in list_tables(spark, folder)
    }
    for name in (train_name, test_name):
        if name not in tables:
            raise MissingTableError(f"table {name!r} not found in {folder}")
    bundle = Bundle(TableSet(tables), train_name, test_name, store)
    bundle.tables.register_views()
    return bundle
