"""Column and table profiles, candidate keys, dictionary enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from relfold.functions.columns import blank_to_null, distinct_value, ends_with_id, field_of, is_integral, present, quoted

PROFILE_SCHEMA = (
    "table_name string, table_ord int, column_name string, column_ord int, dtype string, "
    "row_count bigint, non_null_count bigint, distinct_count bigint, "
    "non_null_ratio double, unique_ratio double"
)
# Distinct estimates come from sketches of 2^14 buckets, with a standard error under 1%; estimates
# near a decision are replaced by exact counts.
SKETCH_LOG_BUCKETS = 14
SKETCH_ERROR = 0.01


def as_metadata(df: DataFrame) -> DataFrame:
    """A frame of a few rows (one per column or table) computed once, for the planning steps after it."""
    return df.sparkSession.createDataFrame(df.toArrow())


def _described(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column, numbered, from the schemas."""
    rows = [
        (table, ordinal, field.name, i, field.dataType.simpleString())
        for ordinal, (table, df) in enumerate(tables.items())
        for i, field in enumerate(df.schema.fields)
    ]
    named = [(str(number), *row) for number, row in enumerate(rows)]
    names = ("column_id", "table_name", "table_ord", "column_name", "column_ord", "dtype")
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
    arrays = [pa.array(values, kind) for values, kind in zip(zip(*named), types)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(pa.table(arrays, names=list(names)))


def _value_class(dtype: T.DataType) -> str:
    """Columns of one class are counted together, in a type that keeps their values apart."""
    if is_integral(dtype):
        return "bigint"
    return "double" if isinstance(dtype, (T.FloatType, T.DoubleType)) else "string"


def _exact_counts(columns: Sequence[tuple[str, DataFrame, str]]) -> list[DataFrame]:
    """Counts of (column_id, table, column name); every column is scanned once.

    The tables are unpivoted to (column, value) and grouped twice, so rows stay narrow however many
    columns there are, repeated values are combined before the shuffle, and no value set is held
    whole anywhere.
    """
    by_class: dict[str, dict[int, list]] = {}
    for number, df, name in columns:
        kind = _value_class(field_of(df, name).dataType)
        by_class.setdefault(kind, {}).setdefault(id(df), []).append((number, df, name))
    parts = []
    for kind, by_table in by_class.items():
        unpivoted = []
        for items in by_table.values():
            typed = items[0][1].select(*[distinct_value(df, c).cast(kind).alias(n) for n, df, c in items])
            unpivoted.append(typed.unpivot([], [quoted(n) for n, _, _ in items], "column_id", "value"))
        values = reduce(DataFrame.unionAll, unpivoted)
        per_value = values.groupBy("column_id", "value").agg(F.count(F.lit(1)).alias("n"))
        present_rows = F.when(F.col("value").isNotNull(), F.col("n"))
        parts.append(
            per_value.groupBy("column_id").agg(
                F.sum("n").alias("row_count"),
                F.coalesce(F.sum(present_rows), F.lit(0)).alias("non_null_count"),
                F.count("value").alias("distinct_count"),
            )
        )
    return parts


def _estimate(df: DataFrame, name: str) -> Column:
    sketch = F.hll_sketch_agg(distinct_value(df, name).cast("string"), SKETCH_LOG_BUCKETS)
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))


def _approx_counts(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """The same columns from one aggregation without a shuffle of values."""
    per_column = [
        F.struct(
            F.lit(number).alias("column_id"),
            F.count(F.lit(1)).alias("row_count"),
            F.count(present(df, name)).alias("non_null_count"),
            _estimate(df, name).alias("distinct_count"),
        )
        for number, name in columns
    ]
    return df.agg(F.array(*per_column).alias("c")).select(F.inline("c"))


def column_profile(tables: Mapping[str, DataFrame], exact: str | Callable[[str, str], bool] = "all") -> DataFrame:
    """One row per column of every table, with non-null and unique ratios (null for an empty table).

    ``exact``: "all", "keys" (columns named ``id``/``*_id``, estimates elsewhere), "none", or a
    predicate ``(table, column) -> bool``.
    """
    rules = {
        "all": lambda table, column: True,
        "keys": lambda table, column: column == "id" or column.endswith("_id"),
        "none": lambda table, column: False,
    }
    rule = rules[exact] if isinstance(exact, str) else exact
    every = [(table, df, name) for table, df in tables.items() for name in df.columns]
    numbered = [(str(number), *item) for number, item in enumerate(every)]
    counted = _exact_counts([(n, df, c) for n, table, df, c in numbered if rule(table, c)])
    for table, df in tables.items():
        rough = [(n, c) for n, t, _, c in numbered if t == table and not rule(t, c)]
        if rough:
            counted.append(_approx_counts(df, rough))
    counts = reduce(DataFrame.unionByName, counted)
    rows = F.coalesce(F.col("row_count"), F.lit(0))
    profile = _described(tables).join(counts, "column_id", "left").select(
        "table_name",
        "table_ord",
        "column_name",
        "column_ord",
        "dtype",
        rows.alias("row_count"),
        F.coalesce(F.col("non_null_count"), F.lit(0)).alias("non_null_count"),
        F.coalesce(F.col("distinct_count"), F.lit(0)).alias("distinct_count"),
    )
    total = F.col("row_count").cast("double")
    return profile.select(
        "*",
        F.try_divide(F.col("non_null_count").cast("double"), total).alias("non_null_ratio"),
        F.try_divide(F.col("distinct_count").cast("double"), total).alias("unique_ratio"),
    )


def key_profile(tables: Mapping[str, DataFrame], is_key: Callable[[str, str], bool], threshold: float = 0.98) -> DataFrame:
    """Profile of the key columns only, counting exactly just where it can matter.

    A key whose estimated uniqueness lies well under the threshold is certain to be classified as
    repeated, so its distinct values are not shuffled; the others are counted exactly. ``is_exact`` tells
    which ratios are counts and which are estimates.
    """
    keys = {t: df.select(*[quoted(c) for c in df.columns if is_key(t, c)]) for t, df in tables.items()}
    keys = {t: df for t, df in keys.items() if df.columns}
    rough = column_profile(keys, exact="none").select("table_name", "column_name", "unique_ratio").collect()
    margin = threshold * (1 - 10 * SKETCH_ERROR)
    close = {(r["table_name"], r["column_name"]) for r in rough if (r["unique_ratio"] or 0) >= margin}
    exact = F.lit(False)
    for table, column in sorted(close):
        exact = exact | ((F.col("table_name") == table) & (F.col("column_name") == column))
    return column_profile(keys, exact=lambda t, c: (t, c) in close).withColumn("is_exact", exact)


def table_profile(profile: DataFrame, key_rule: Callable[[Column], Column] = ends_with_id) -> DataFrame:
    """One row per table: row and column counts and the candidate keys in schema order."""
    key = F.when(key_rule(F.col("column_name")), F.struct("column_ord", "column_name"))
    return profile.groupBy("table_name", "table_ord").agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.transform(F.array_sort(F.collect_list(key)), lambda k: k["column_name"]).alias("candidate_keys"),
    )


def candidate_keys(profile: DataFrame, key_rule: Callable[[Column], Column] = ends_with_id) -> DataFrame:
    """Profile rows of the columns whose name makes them a key."""
    return profile.where(key_rule(F.col("column_name")))


def enrich_with_dictionary(
    profile: DataFrame,
    dictionary: DataFrame,
    file_suffix: str = ".csv",
    position: str | None = None,
) -> DataFrame:
    """Add ``description`` and ``allowed_values`` by (table, column), and ``table_description`` where the dictionary
    describes tables (rows with a blank column name).

    Of repeated entries the last by the column ``position`` counts; without one, repeats make the job fail.

    Table names in the dictionary may carry the file suffix. Blank texts are nulls. Columns the
    dictionary does not know keep what the profile already says. Both sides hold one row per column
    of the schema, so their size does not depend on the data.
    """
    table = F.trim(F.col("table_name"))
    table = F.when(table.endswith(file_suffix), F.expr(f"left(trim(table_name), length(trim(table_name)) - {len(file_suffix)})")).otherwise(table)
    order = F.col(position) if position else F.lit(0)
    listed = dictionary.select(
        table.alias("table_name"),
        F.coalesce(blank_to_null(F.col("column_name")), F.lit("")).alias("column_name"),
        F.struct(
            order.alias("at"),
            blank_to_null(F.col("description")).alias("description"),
            blank_to_null(F.col("allowed_values")).alias("allowed_values"),
        ).alias("__entry"),
    )
    entries = listed.groupBy("table_name", "column_name").agg(F.max_by("__entry", "__entry.at").alias("__entry"), F.count(F.lit(1)).alias("__n"))
    if position is None:
        repeated = F.raise_error(F.concat(F.lit("repeated dictionary entry of "), F.col("table_name"), F.lit("."), F.col("column_name")))
        entries = entries.where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(repeated.cast("boolean")))
    entries = entries.drop("__n")
    of_tables = entries.where("column_name = ''").select("table_name", F.col("__entry.description").alias("__table_description"))
    joined = profile.join(entries, ["table_name", "column_name"], "left").join(of_tables, "table_name", "left")
    result = joined
    for name in ("description", "allowed_values"):
        old = F.col(name) if name in profile.columns else F.lit(None).cast("string")
        result = result.withColumn(name, F.when(F.col("__entry").isNotNull(), F.col(f"__entry.{name}")).otherwise(old))
    old = [F.col("table_description")] if "table_description" in profile.columns else []
    result = result.withColumn("table_description", F.coalesce("__table_description", *old))
    return result.drop("__entry", "__table_description")


def with_descriptions(df: DataFrame, table: str, enriched: DataFrame) -> DataFrame:
    """The table with descriptions and allowed values as column metadata."""
    rows = enriched.where(F.col("table_name") == table).select("column_name", "description", "allowed_values").collect()
    notes = {r["column_name"]: {k: r[k] for k in ("description", "allowed_values") if r[k]} for r in rows}
    return df.select(*[quoted(c).alias(c, metadata=notes[c]) if notes.get(c) else quoted(c) for c in df.columns])


def same_columns(train: DataFrame, test: DataFrame, ignore: Iterable[str] = ("target",)) -> bool:
    """Do both roots have the same columns, the label aside?"""
    skipped = set(ignore)
    return set(train.columns) - skipped == set(test.columns) - skipped


def added_columns(before: DataFrame, after: DataFrame) -> list[str]:
    known = set(before.columns)
    return sorted(c for c in after.columns if c not in known)
