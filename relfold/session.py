"""Session settings and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Settings the engine counts on; sizes of partitions and the number of shuffle partitions belong to
# the cluster and are left alone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot partition even if what follows the join then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Report the true size of an outsized block, so that adaptive execution can see skew in
    # shuffles with thousands of partitions.
    "spark.shuffle.accurateBlockSkewedFactor": "5.0",
    # Wide tables mean thousands of column expressions; recording a call site for each dominates the
    # time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "relfold", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Whether a query's shuffle files go when it ends; by default they go some time after the driver's memory was cleared.
_RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written or collected inside leaves no shuffle files behind, so that steps that follow each other need the
    disk of the largest and not of all. Other queries of the session that run meanwhile do the same, which changes no rows."""
    before = spark.conf.get(_RELEASED)
    spark.conf.set(_RELEASED, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASED, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, which all executors share."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return configured.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The frame computed once, written as Parquet to the shared folder and read back, so that lost executors
    cost nothing and later readers take only the columns and rows they need. The cluster clears the folder."""
    spark = df.sparkSession
    empty = {f.name: F.lit(None).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    frame = df.withColumns(empty) if empty else df
    path = f"{shared_folder(spark)}/relfold-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
