"""Column typing, quoting and cleaning rules.

Everything here returns Column expressions or reads only ``df.schema``; no helper starts a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

MISSING_TEXT = "missing"
MISSING_NUMBER = -999
NAME_SEPARATOR = "__"


def quoted(name: str) -> Column:
    """Column by exact name, also when the name holds dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def feature_name(table: str, *parts: object) -> str:
    return NAME_SEPARATOR.join([table, *(str(part) for part in parts)])


def field_of(df: DataFrame, name: str) -> T.StructField:
    for field in df.schema.fields:
        if field.name == name:
            return field
    raise ValueError(f"column {name!r} not found among {df.columns}")


def is_numeric(dtype: T.DataType) -> bool:
    """Booleans count as numbers; dates and timestamps count as categories."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def split_columns(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names in schema order."""
    skipped = set(exclude)
    fields = [f for f in df.schema.fields if f.name not in skipped]
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    categorical = [f.name for f in fields if not is_numeric(f.dataType)]
    return numeric, categorical


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing, so that one notion of null holds everywhere."""
    dtype = field_of(df, name).dataType
    column = quoted(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def number(df: DataFrame, name: str) -> Column:
    """Value usable in arithmetic aggregates: booleans become 0/1, NaN becomes null."""
    if isinstance(field_of(df, name).dataType, T.BooleanType):
        return quoted(name).cast("int")
    return present(df, name)


def distinct_value(df: DataFrame, name: str) -> Column:
    """Value usable for distinct counting: NaN is null and the two zeros are one value."""
    dtype = field_of(df, name).dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return present(df, name) + F.lit(0).cast(dtype)
    return quoted(name)


def category(column: Column) -> Column:
    return column.cast("string")


def equals_category(column: Column, value: str) -> Column:
    """0/1 indicator of a category value; null counts as 0."""
    return category(column).eqNullSafe(F.lit(value)).cast("int")


def trimmed_items(column: Column) -> Column:
    """Trim the strings of an array and drop the blank ones."""
    return F.filter(F.transform(column, lambda x: F.trim(x)), lambda x: x != F.lit(""))


def blank_to_null(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def score_round(column: Column) -> Column:
    return F.round(column, 6)


def gini(auc: Column) -> Column:
    return F.lit(2.0) * auc - F.lit(1.0)


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers: null or NaN -> -999. Everything else: text, null -> ``missing``."""
    numeric, _ = split_columns(df)
    exprs = {}
    for name in columns:
        if name in numeric:
            exprs[name] = F.coalesce(number(df, name), F.lit(MISSING_NUMBER))
        else:
            exprs[name] = F.coalesce(category(quoted(name)), F.lit(MISSING_TEXT))
    return df.withColumns(exprs) if exprs else df


def ends_with_id(column: Column) -> Column:
    """Default key-name rule: ``id`` or ``*_id``."""
    return (column == F.lit("id")) | column.endswith("_id")
