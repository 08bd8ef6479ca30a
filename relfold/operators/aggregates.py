"""Grouped measures over a source table, one row per key.

All measures asked of one (table, key) are computed together. Plain aggregates and distinct counts
share a grouping. Measures that need the count of every value (most frequent value and its share)
use two groupings, first on (key, value) and then on key, so that no group of a hot key has to be
held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from relfold.functions.columns import (
    category,
    distinct_value,
    equals_category,
    feature_name,
    field_of,
    number,
    present,
    quoted,
    split_columns,
)
from relfold.operators.keyed import KeyedFrame, token_names, with_tokens

# Names of aggregations, which also end the names of output columns.
NUMERIC_AGGREGATIONS = ("count", "mean", "max", "min", "sum", "std", "nunique")
CATEGORICAL_AGGREGATIONS = ("nunique", "most_frequent", "top_k_frequency", "top_k_one_hot")
DEFAULT_TOP_K = 3
# Distinct counts or value counts of one pass; each adds a copy of the row before the partial
# aggregation, so wide tables are done in several passes.
COLUMNS_PER_PASS = 8


@dataclass(frozen=True)
class Measure:
    """``kind`` over ``column`` under the name ``alias``.

    Kinds: size, count, count_rows, mean, max, min, sum, std, nunique, mode, mode_ratio, freq, is,
    share_of_ones. ``value`` belongs to freq and is; ``where`` is a SQL filter on source rows.
    """

    kind: str
    alias: str
    column: str | None = None
    value: str | None = None
    where: str | None = None


_VALUE_COUNT_KINDS = ("mode", "mode_ratio")


def _when(measure: Measure, column: Column) -> Column:
    return F.when(F.expr(measure.where), column) if measure.where else column


def _plain(source: DataFrame, m: Measure, approx: bool) -> Column:
    if m.kind == "size":
        return F.count(_when(m, F.lit(1)))
    if m.kind in ("freq", "is"):
        flag = _when(m, equals_category(quoted(m.column), m.value))
        if m.kind == "freq":
            return F.coalesce(F.sum(flag), F.lit(0)).cast("bigint")
        return F.coalesce(F.max(flag), F.lit(0))
    if m.kind == "nunique":
        value = _when(m, distinct_value(source, m.column))
        return F.approx_count_distinct(value) if approx else F.count_distinct(value)
    if m.kind == "count":
        return F.count(_when(m, present(source, m.column)))
    value = number(source, m.column)
    if m.kind == "share_of_ones":
        return F.avg(_when(m, value.eqNullSafe(F.lit(1)).cast("int")))
    value = _when(m, value)
    if m.kind == "mean":
        return F.avg(value)
    if m.kind == "max":
        return F.max(value)
    if m.kind == "min":
        return F.min(value)
    if m.kind == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    if m.kind == "std":
        return F.stddev_samp(value)
    raise ValueError(f"unknown measure {m.kind!r}")


def aggregate_by_key(
    source: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Measure],
    null_safe: bool = True,
    approx_distinct: bool = False,
    columns_per_pass: int = COLUMNS_PER_PASS,
) -> KeyedFrame:
    """One row per key (null is a key) with one column per measure."""
    for m in measures:
        if m.column is not None:
            field_of(source, m.column)
    tokens = token_names(len(keys), null_safe)
    needed = dict.fromkeys(m.column for m in measures if m.column is not None)
    if any(m.where for m in measures):
        needed = dict.fromkeys(source.columns)
    tokened = with_tokens(source, keys, null_safe, [quoted(c) for c in needed])
    if not null_safe:
        tokened = tokened.dropna(subset=tokens)

    counted, plain = _by_need(tokened, measures)
    distinct = [m for m in plain if m.kind == "nunique"]
    others = [m for m in plain if m.kind != "nunique"]
    passes = [distinct[i:i + columns_per_pass] for i in range(0, len(distinct), columns_per_pass)] or [[]]
    passes[0] = others + passes[0]

    parts: list[DataFrame] = []
    for batch in passes:
        if batch:
            exprs = [_plain(tokened, m, approx_distinct).alias(m.alias) for m in batch]
            parts.append(tokened.groupBy(*tokens).agg(*exprs))
    for batch in _by_column(counted, columns_per_pass):
        parts.append(_from_value_counts(tokened, tokens, batch))
    if not parts:
        parts.append(tokened.select(*tokens).distinct())

    frame = parts[0]
    for part in parts[1:]:
        frame = frame.join(part, tokens, "inner")
    frame = frame.select(*tokens, *[quoted(m.alias) for m in measures])
    return KeyedFrame(frame, tuple(keys), null_safe)


def _by_need(source: DataFrame, measures: Sequence[Measure]) -> tuple[list[Measure], list[Measure]]:
    """(measures from value counts, measures from rows). Where a column's values are counted anyway,
    what follows from the counts is taken from them instead of from another pass over the rows."""
    sources = {(m.column, m.where) for m in measures if m.kind in _VALUE_COUNT_KINDS}
    unfiltered = any(where is None for _, where in sources)
    counted, plain = [], []
    for m in measures:
        follows = m.kind in _VALUE_COUNT_KINDS or (m.column, m.where) in sources and (
            m.kind in ("nunique", "count")
            or m.kind in ("freq", "is") and not isinstance(field_of(source, m.column).dataType, (T.FloatType, T.DoubleType))
        )
        follows = follows or (m.kind == "size" and m.where is None and unfiltered)
        (counted if follows else plain).append(m)
    return counted, plain


def _by_column(measures: Sequence[Measure], size: int) -> list[list[Measure]]:
    """Batches of at most ``size`` different (column, filter) pairs."""
    sources = list(dict.fromkeys((m.column, m.where) for m in measures if m.kind != "size"))
    sizes = [m for m in measures if m.kind == "size"]
    # The group size follows from the counts of any unfiltered column.
    open_source = next((s for s in sources if s[1] is None), None)
    batches = []
    for i in range(0, len(sources), size):
        chunk = set(sources[i:i + size])
        batch = [m for m in measures if m.kind != "size" and (m.column, m.where) in chunk]
        batches.append(batch + (sizes if open_source in chunk else []))
    return batches


def _from_value_counts(tokened: DataFrame, tokens: list[str], measures: Sequence[Measure]) -> DataFrame:
    """Measures from the counts of every (key, value)."""
    sources = list(dict.fromkeys((m.column, m.where) for m in measures if m.kind != "size"))
    open_source = next((s for s in sources if s[1] is None), None)
    names = {source: f"__v{i}" for i, source in enumerate(sources)}
    values = tokened.select(
        *tokens,
        *[_when(Measure("mode", "", c, where=w), distinct_value(tokened, c)).alias(names[c, w]) for c, w in sources],
    )
    columns = list(names.values())
    counts = (
        values.groupingSets([[*tokens, c] for c in columns], *tokens, *columns)
        .agg(F.count(F.lit(1)).alias("__n"), F.grouping_id().alias("__set"))
    )
    exprs = []
    for m in measures:
        name = names[open_source if m.kind == "size" else (m.column, m.where)]
        position = columns.index(name)
        # grouping_id has a one for every column left out of the set.
        set_id = sum(1 << (len(columns) - 1 - j) for j in range(len(columns)) if j != position)
        mine = F.col("__set") == F.lit(set_id)
        value, n = F.col(name), F.col("__n")
        exprs.append(_from_counts(m, value, n, mine, mine & value.isNotNull()).alias(m.alias))
    return counts.groupBy(*tokens).agg(*exprs)


def _from_counts(m: Measure, value: Column, n: Column, mine: Column, known: Column) -> Column:
    """``mine`` marks the rows that count this column's values, ``known`` those of them with a value."""
    if m.kind == "size":
        return F.coalesce(F.sum(F.when(mine, n)), F.lit(0))
    if m.kind == "count":
        return F.coalesce(F.sum(F.when(known, n)), F.lit(0))
    if m.kind == "nunique":
        return F.count_if(known)
    if m.kind == "freq":
        return F.coalesce(F.sum(F.when(known & (category(value) == m.value), n)), F.lit(0))
    if m.kind == "is":
        return F.coalesce(F.max((known & (category(value) == m.value)).cast("int")), F.lit(0))
    if m.kind == "mode":
        return F.min_by(F.when(known, value), F.when(known, F.struct((-n).alias("n"), value.alias("v"))))
    total = F.sum(F.when(known, n))
    return F.try_divide(F.max(F.when(known, n)).cast("double"), total.cast("double"))


def automatic_measures(table: str, source: DataFrame, key: str, exclude_ids: bool = False) -> list[Measure]:
    """mean/max/min/nunique of every number, nunique of everything else, and the group size."""
    numeric, categorical = split_columns(source, exclude=[key])
    if exclude_ids:
        numeric = [c for c in numeric if not (c == "id" or c.endswith("_id"))]
    measures = [
        Measure(kind, feature_name(table, column, kind), column)
        for column in numeric
        for kind in ("mean", "max", "min", "nunique")
    ]
    measures += [Measure("nunique", feature_name(table, c, "nunique"), c) for c in categorical]
    return measures + [Measure("size", feature_name(table, "row_count"))]


def numeric_measures(table: str, source: DataFrame, columns: Sequence[str], aggregations: Sequence[str]) -> list[Measure]:
    """Absent and non-numeric columns are passed over; an unknown aggregation is an error."""
    unknown = [a for a in aggregations if a not in NUMERIC_AGGREGATIONS]
    if unknown:
        raise ValueError(f"unsupported numeric aggregations {unknown}")
    numeric = set(split_columns(source)[0])
    return [
        Measure(kind, feature_name(table, column, kind), column)
        for column in dict.fromkeys(columns)
        if column in numeric
        for kind in dict.fromkeys(aggregations)
    ]


def categorical_measures(
    table: str,
    source: DataFrame,
    columns: Sequence[str],
    aggregations: Sequence[str],
    values: dict[str, Sequence[str]] | None = None,
) -> list[Measure]:
    """``values``: the category values that get a column of their own, per source column."""
    measures = []
    for column in dict.fromkeys(columns):
        if column not in source.columns:
            continue
        if "nunique" in aggregations:
            measures.append(Measure("nunique", feature_name(table, column, "nunique"), column))
        if "most_frequent" in aggregations:
            measures.append(Measure("mode", feature_name(table, column, "most_frequent"), column))
        for aggregation, kind in (("top_k_frequency", "freq"), ("top_k_one_hot", "is")):
            if aggregation in aggregations:
                for value in (values or {}).get(column, ()):
                    measures.append(Measure(kind, feature_name(table, column, kind, value), column, value=value))
    return measures


#: Values that a sketch of a column tracks, and how many more than asked are recounted.
TRACKED_VALUES, MORE_CANDIDATES = 1 << 16, 64


def top_values(source: DataFrame, columns: Sequence[str], k: int | None = None, tracked: int = TRACKED_VALUES) -> DataFrame:
    """(column_name, value, n_rows, rank): the k most common values of each column.

    Most frequent first, then value ascending. A sketch of every column, taken in one pass without a shuffle, names
    candidates; these alone are counted, so what is shuffled does not depend on the number of values. A column is
    counted in full where the sketch cannot prove that no other value belongs among its first k.
    """
    limit = k or DEFAULT_TOP_K
    texts = source.select(*[category(present(source, c)).alias(c) for c in columns])
    candidates = _candidates(texts, columns, limit, tracked)
    known = {c: values for c, (values, proven) in candidates.items() if proven}
    parts = []
    if known:
        wanted = [F.when(quoted(c).isin(*values), quoted(c)).alias(c) for c, values in known.items() if values]
        if wanted:
            parts.append(_value_counts(texts.select(*wanted)))
    rest = [c for c in columns if c not in known]
    if rest:
        parts.append(_value_counts(texts.select(*[quoted(c) for c in rest])))
    if not parts:
        parts.append(_value_counts(texts.where(F.lit(False))))
    order = Window.partitionBy("column_name").orderBy(F.desc("n_rows"), F.asc("value"))
    # The rank filter reaches the map side as a group limit, so each task hands on at most k values per column.
    counts = reduce(DataFrame.unionAll, parts)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _value_counts(texts: DataFrame) -> DataFrame:
    long = texts.unpivot([], [quoted(c) for c in texts.columns], "column_name", "value").where("value is not null")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def _candidates(texts: DataFrame, columns: Sequence[str], k: int, tracked: int) -> dict[str, tuple[list[str], bool]]:
    """For each column values that may be among its k most common ones, and whether there can be no others.

    A sketch of m counters overestimates a value by 3.5 / m of the rows at most. What it does not name has so many rows
    at most, twice that where it is not sure of an item, or no more than the last item it names, if it names as many as
    were asked. If the exact count of the k-th candidate lies above all that, which its estimate less the error tells
    beforehand, the candidates are complete; ties at the border are thus never decided by the sketch.
    """
    names = list(dict.fromkeys(columns))
    size = min(k + MORE_CANDIDATES, tracked)
    tops = [F.call_function("approx_top_k", quoted(c), F.lit(size), F.lit(tracked)).alias(f"t{i}") for i, c in enumerate(names)]
    filled = [F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)]
    row = texts.agg(*tops, *filled).first()
    found = {}
    for i, c in enumerate(names):
        named = row[f"t{i}"] or []
        items = [r for r in named if r["item"] is not None]
        error = 3.5 * row[f"n{i}"] / tracked
        outside = max(2 * error, named[-1]["count"] if len(named) >= size else 0)
        found[c] = [r["item"] for r in items], len(items) >= k and items[k - 1]["count"] - error > outside
    return found


def collect_top_values(source: DataFrame, columns: Sequence[str], k: int | None = None) -> dict[str, list[str]]:
    """At most k values per column reach the driver; they become column names."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in top_values(source, columns, k).orderBy("column_name", "rank").collect():
        found[row["column_name"]].append(row["value"])
    return found
