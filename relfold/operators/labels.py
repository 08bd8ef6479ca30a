"""Label joins by identity column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relfold.functions.columns import field_of, quoted
from relfold.operators.keyed import DEFAULT_SKEW, SkewPolicy, attach, guarded


def with_target(output: DataFrame, source: DataFrame, id_column: str = "row_id", target: str = "target",
                skew: SkewPolicy | None = DEFAULT_SKEW) -> DataFrame:
    """Bring the label back from the source root; nothing to do if it is there or cannot be had."""
    if target in output.columns or not {id_column, target} <= set(source.columns):
        return output
    return attach(output, [id_column], [guarded(source.select(id_column, target), [id_column])], skew)


def with_held_out_labels(test: DataFrame, labels: DataFrame, id_column: str = "row_id", target: str = "target",
                         skew: SkewPolicy | None = DEFAULT_SKEW) -> DataFrame:
    """The test rows with their hidden labels, aligned by id. Absent labels are an error, never made up: a missing
    column at once, a row without a label when the rows are read."""
    missing = [c for c in (id_column, target) if c not in labels.columns]
    if missing:
        raise ValueError(f"held-out labels lack columns {missing}")
    rows = test.drop(target)
    joined = attach(rows, [id_column], [guarded(labels.select(id_column, target), [id_column])], skew)
    absent = F.raise_error(F.concat(F.lit("no held-out label for "), quoted(id_column).cast("string")))
    known = F.when(quoted(target).isNotNull(), quoted(target)).otherwise(absent.cast(field_of(labels, target).dataType))
    return joined.withColumn(target, known)
