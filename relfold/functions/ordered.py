"""Positions within ordered groups that may be too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[str],
    name: str,
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Number the rows of each key from 1 in ``order``, and look up columns of the row before.

    ``segment`` must rise with ``order`` (a date's month, a number's range). Groups are cut at the
    segments: rows are numbered inside a segment and shifted by the rows of earlier segments, so a
    hot key is spread over as many tasks as it has segments. ``previous`` maps a column to the name
    under which the preceding row's value appears.
    """
    previous = previous or {}
    group = [*keys, "__segment"]
    cut = df.withColumn("__segment", segment)
    last = F.struct(*order, *[F.col(c).alias(f"__prev_{c}") for c in previous])
    segments = cut.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"), F.max(last).alias("__last"))
    by_key = Window.partitionBy(*keys).orderBy("__segment")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.select(
        *[F.col(c).alias(f"__o_{c}") for c in group],
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"),
        F.lag("__last").over(by_key).alias("__before"),
    )
    matches = [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in group]
    joined = cut.join(offsets, matches)
    inside = Window.partitionBy(*group).orderBy(*order)
    columns = {name: (F.row_number().over(inside) + F.col("__offset")).cast("int")}
    for column, alias in previous.items():
        here = F.lag(F.struct(F.col(column).alias("v"))).over(inside)
        columns[alias] = F.when(here.isNull(), F.col("__before")[f"__prev_{column}"]).otherwise(here["v"])
    return joined.withColumns(columns).drop("__segment", "__offset", "__before", *[f"__o_{c}" for c in group])
