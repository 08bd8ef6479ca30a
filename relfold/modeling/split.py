"""Repeatable hash splits.

A row's place depends on the seed and its id alone, so splits need no shuffle and come out the same
on every run and retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

SEED = 42
HOLDOUT_SHARE = 0.2
FOLDS = 5
_RANGE = 4294967296  # 2^32, the values of eight hex digits


def hash_number(id_column: Column, seed: int = SEED) -> Column:
    """The first eight hex digits of md5("seed|id") as a number."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), id_column.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_fraction(id_column: Column, seed: int = SEED) -> Column:
    """Uniform in [0, 1)."""
    return hash_number(id_column, seed).cast("double") / F.lit(float(_RANGE))


def with_holdout(df: DataFrame, id_column: str = "row_id", share: float = HOLDOUT_SHARE, seed: int = SEED,
                 name: str = "is_holdout") -> DataFrame:
    """Flag about ``share`` of the rows of every class; the hash does not look at the label."""
    return df.withColumn(name, hash_fraction(F.col(id_column), seed) < F.lit(share))


def with_folds(df: DataFrame, id_column: str = "row_id", folds: int = FOLDS, seed: int = SEED,
               name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.pmod(hash_number(F.col(id_column), seed), F.lit(folds)).cast("int"))


def with_class_position(df: DataFrame, target: str, id_column: str, seed: int = SEED, slices: int = 65536) -> DataFrame:
    """``position`` of a row in hash order within its class, from 0, and the size ``class_rows``.

    A class may hold nearly all rows, so it is not ordered as one group: the hash range is cut into
    slices, the slices of a class are counted, and rows are numbered inside their slice only.
    """
    hashed = df.withColumn("__h", hash_number(F.col(id_column), seed))
    sliced = hashed.withColumn("__slice", F.floor(F.col("__h") / F.lit(_RANGE // slices)).cast("int"))
    label = F.col(target).cast("string")
    # A null label is a class of its own, apart from the empty text.
    sliced = sliced.withColumn("__class", F.coalesce(F.concat(F.lit("="), label), F.lit("")))
    counts = sliced.groupBy("__class", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__class").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__class",
        "__slice",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(Window.partitionBy("__class")).alias("class_rows"),
    )
    inside = Window.partitionBy("__class", "__slice").orderBy("__h", F.col(id_column))
    return (
        sliced.join(offsets, ["__class", "__slice"])
        .withColumn("position", F.row_number().over(inside) - 1 + F.col("__offset"))
        .drop("__h", "__slice", "__class", "__offset")
    )


def with_exact_holdout(df: DataFrame, target: str = "target", id_column: str = "row_id",
                       share: float = HOLDOUT_SHARE, seed: int = SEED, name: str = "is_holdout") -> DataFrame:
    """Exactly round(share * n) rows of every class."""
    placed = with_class_position(df, target, id_column, seed)
    return placed.withColumn(name, F.col("position") < F.round(F.col("class_rows") * share)).drop("position", "class_rows")


def with_exact_folds(df: DataFrame, target: str = "target", id_column: str = "row_id", folds: int = FOLDS,
                     seed: int = SEED, name: str = "fold") -> DataFrame:
    """Fold sizes within a class differ by at most one row."""
    placed = with_class_position(df, target, id_column, seed)
    return placed.withColumn(name, (F.col("position") % folds).cast("int")).drop("position", "class_rows")
