"""Validation of enriched outputs. Every check is a row (check, subject, passed, detail)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from relfold.functions.columns import present
from relfold.session import stored
from relfold.sources.files import write_table

CHECK_SCHEMA = "`check` string, subject string, passed boolean, detail string"
MAX_FEATURES = 5


def new_columns(base: DataFrame, output: DataFrame) -> list[str]:
    known = set(base.columns)
    return [c for c in output.columns if c not in known]


def schema_checks(
    bases: dict[str, DataFrame],
    outputs: dict[str, DataFrame],
    max_features: int = MAX_FEATURES,
) -> list[tuple]:
    """Checks that need no data: base columns kept, features alike, their number, unique names."""
    rows = []
    features = {name: new_columns(bases[name], outputs[name]) for name in bases}
    for name, base in bases.items():
        missing = [c for c in base.columns if c not in outputs[name].columns]
        rows.append(("base_columns_kept", name, not missing, ",".join(missing)))
        repeated = [c for c, n in Counter(c.lower() for c in outputs[name].columns).items() if n > 1]
        rows.append(("unique_column_names", name, not repeated, ",".join(repeated)))
        count = len(features[name])
        rows.append(("feature_count", name, 1 <= count <= max_features, str(count)))
    names = list(features.values())
    alike = all(n == names[0] for n in names)
    rows.append(("same_features", "/".join(features), alike, ",".join(names[0])))
    return rows


def _row(check: str, subject: str, passed: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(subject).alias("subject"),
        passed.alias("passed"),
        detail.cast("string").alias("detail"),
    )


@dataclass(frozen=True)
class Counts:
    """Rows of a table, and of some of its columns the rows with a value."""

    rows: int
    filled: Mapping[str, int] = field(default_factory=dict)


def counted(df: DataFrame, columns: Sequence[str] = ()) -> tuple[DataFrame, Callable[[], Counts]]:
    """The frame, and its counts once it has been written: they are observed by the tasks that write, so nothing is
    read for them. The write must be the next thing that happens to the frame; a shuffle after it could count the rows
    of a task that is run again."""
    observed = Observation()
    values = [F.count(present(df, c)).alias(f"n_{i}") for i, c in enumerate(columns)]
    frame = df.observe(observed, F.count(F.lit(1)).alias("n_rows"), *values)

    def counts() -> Counts:
        found = observed.get
        return Counts(found["n_rows"], {c: found[f"n_{i}"] for i, c in enumerate(columns)})

    return frame, counts


def stored_counted(df: DataFrame, columns: Sequence[str] = ()) -> tuple[DataFrame, Counts]:
    """``stored``, with the counts of what was written."""
    frame, counts = counted(df, columns)
    return stored(frame), counts()


def write_counted(df: DataFrame, path: str, format: str = "parquet", columns: Sequence[str] = ()) -> Counts:
    """``write_table``, with the counts of what was written."""
    frame, counts = counted(df, columns)
    write_table(frame, path, format)
    return counts()


def _counts_now(df: DataFrame, columns: Sequence[str]) -> Column:
    return df.agg(
        F.struct(F.count(F.lit(1)).alias("n_rows"), *[F.count(present(df, c)).alias(f"n_{i}") for i, c in enumerate(columns)])
    ).scalar()


def _known_counts(counts: Counts, columns: Sequence[str]) -> Column:
    values = [F.lit(counts.filled[c]).alias(f"n_{i}") for i, c in enumerate(columns)]
    return F.struct(F.lit(counts.rows).alias("n_rows"), *values)


def data_checks(
    name: str,
    base: DataFrame | None,
    output: DataFrame,
    features: Sequence[str],
    written: Counts | None = None,
    base_counts: Counts | None = None,
) -> DataFrame:
    """Checks over the rows: not empty, no all-null feature, and the row count of the base kept. What was counted as it
    was written is not read again; otherwise the output is read once for all checks, and the base once for its count."""
    mine = written if written and set(features) <= set(written.filled) else None
    counts = output.sparkSession.range(1).select((_known_counts(mine, features) if mine else _counts_now(output, features)).alias("c"))
    rows = [_row("not_empty", name, F.col("c.n_rows") > 0, F.col("c.n_rows"))]
    rows += [_row("feature_has_values", f"{name}.{c}", F.col(f"c.n_{i}") > 0, F.col(f"c.n_{i}")) for i, c in enumerate(features)]
    if base is not None:
        before = _known_counts(base_counts, ()) if base_counts else _counts_now(base, ())
        counts = counts.withColumn("before", before["n_rows"])
        rows.append(_row("row_count_kept", name, F.col("before") == F.col("c.n_rows"), F.col("c.n_rows") - F.col("before")))
    return counts.select(F.inline(F.array(*rows)))


def output_checks(
    bases: dict[str, DataFrame],
    outputs: dict[str, DataFrame],
    max_features: int = MAX_FEATURES,
    written: Mapping[str, Counts] | None = None,
    base_counts: Mapping[str, Counts] | None = None,
) -> DataFrame:
    """All checks. ``written`` and ``base_counts`` hold counts observed while outputs and bases were written; a root
    with both is not read."""
    spark = next(iter(outputs.values())).sparkSession
    parts = [spark.createDataFrame(schema_checks(bases, outputs, max_features), CHECK_SCHEMA)]
    for name, output in outputs.items():
        features = new_columns(bases[name], output)
        parts.append(data_checks(name, bases[name], output, features, (written or {}).get(name), (base_counts or {}).get(name)))
    return reduce(DataFrame.unionAll, parts)


def failed(checks: DataFrame) -> DataFrame:
    return checks.where(~F.coalesce(F.col("passed"), F.lit(False)))


def require(checks: DataFrame) -> None:
    """Raise with the failed checks; their number is bounded by the number of columns."""
    problems = [f"{r['check']}({r['subject']}): {r['detail']}" for r in failed(checks).collect()]
    if problems:
        raise ValueError("; ".join(problems))
