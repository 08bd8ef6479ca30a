"""Stored column profiles, so that large tables need not be profiled again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relfold.operators.profile import PROFILE_SCHEMA

_STORED_SCHEMA = PROFILE_SCHEMA + ", description string, allowed_values string, table_description string"


def profile_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def save_profile(profile: DataFrame, path: str, mode: str = "overwrite") -> None:
    profile.write.mode(mode).json(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED_SCHEMA).json(path)
