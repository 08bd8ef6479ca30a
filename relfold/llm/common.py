"""Helpers shared by the operators: stored tables, training rows, unused column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of one Arrow batch of texts; Spark's own limit of bytes per batch holds besides.
TEXT_BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch, as a text may be long; a smaller setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, TEXT_BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one named in spark.checkpoint.dir, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The frame written once as a Parquet table in the shared folder and read back: its lineage ends
    there, so a lost executor costs no more than the reading. The cluster clears that folder."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_written_order(df: DataFrame, name: str) -> DataFrame:
    """Rows read from a written table with a number ``name`` that rises in the order in which they were written: by
    the number that a task gave its file, the file's own number, and the row's place in it. Other frames stay."""
    if not df.inputFiles():
        return df
    file = F.col("_metadata.file_name")
    task = F.regexp_extract(file, r"^part-(\d+)", 1)
    again = F.regexp_extract(file, r"-c(\d+)", 1)  # a task's further files
    number = [F.coalesce(c.try_cast("bigint"), F.lit(0)) for c in (task, again)]
    return df.withColumn(name, (number[0] * 1000 + number[1]) * (1 << 36) + F.col("_metadata.row_index"))


#: Rows of a key that one task may get in a join.
SLICE = 4096


def joined_in_slices(many: DataFrame, one: DataFrame, keys: list[str], weight: str, spread: Column, total: int) -> DataFrame:
    """Inner join of many rows to one row per key. ``weight`` is a column of ``one`` with the rows of its key among
    ``many``, ``spread`` a hash of a row of ``many``. Keys of more rows than SLICE, and than a quarter of an even
    partition, are dealt in slices; there are at most four times as many of them as partitions, so their names are
    broadcast."""
    partitions = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(SLICE, total // (4 * partitions))
    slices = F.ceil(F.col(weight) / F.lit(most)).cast("int")
    hot = F.broadcast(one.where(F.col(weight) > most).select(*keys, slices.alias("__slices")))
    left = many.join(hot, keys, "left").withColumn("__slice", F.coalesce(F.pmod(spread, F.col("__slices")), F.lit(0)).cast("int")).drop("__slices")
    right = one.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.greatest(slices, F.lit(1)) - 1)))
    return left.join(right, [*keys, "__slice"]).drop("__slice")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5. A null id is held out, too: nothing is learnt from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of the frame is called so (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fraction(*columns: str | Column) -> Column:
    """A repeatable pseudo-random number in [0, 1) of the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def label_marks(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of every document outside the held-out ones. Of repeated labels for an id the largest counts;
    null labels and ids count as absent."""
    marked = labels.where(F.col(label).isNotNull() & ~held_out())
    return marked.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, *columns: Column) -> DataFrame:
    """Every document of a class (0 or 1) outside the held-out ones, with columns doc_id, label, weight (1) and part in
    [0, 1), a hash of doc_id, and the given ``columns``, which are what the join sends. Neither side is broadcast: both
    grow with the tables."""
    marks = label_marks(labels, label).where("label in (0, 1)").withColumn("weight", F.lit(1.0))
    kept = docs.where(~held_out()).select("doc_id", *columns)
    return kept.join(marks.withColumn("part", fraction(F.col("doc_id"), F.lit("part"))).hint("merge"), "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *columns: Column) -> DataFrame:
    """At most about ``per_class`` documents of each class (0 and 1) outside the held-out ones, with
    columns doc_id, text, label, weight (documents of the class for each one drawn) and part in [0, 1), and the given
    ``columns``.

    The draw is a hash of doc_id, so reruns agree. ``per_class`` bounds the rows; texts are drawn whole, whatever their
    length, so a caller takes from them inside Spark what it needs.
    """
    marks = label_marks(labels, label).withColumn("draw", fraction(F.col("doc_id"), F.lit("draw")))
    sizes = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).where("label in (0, 1)").collect()}
    rates = {c: min(1.0, per_class / n) for c, n in sizes.items()}
    rate = F.lit(0.0)
    for c, value in rates.items():
        rate = F.when(F.col("label") == c, value).otherwise(rate)
    drawn = marks.where(F.col("draw") < rate).select(
        "doc_id", "label", F.try_divide(F.lit(1.0), rate).alias("weight"), fraction(F.col("doc_id"), F.lit("part")).alias("part")
    )
    # The drawn ids are bounded by per_class, whatever the table's size.
    return docs.select("doc_id", "text", *columns).join(F.broadcast(drawn), "doc_id")
