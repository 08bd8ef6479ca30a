"""Exact duplicates by sorting content.

Sampled splitters deal the normalised texts into ranges, Spark's external sort puts equal texts next to
each other, and every text is compared in full with its neighbour. Splitters are (first characters, hash
of the whole text, id), so they stay small however long the texts are, and a group of copies of any size
is spread over as many ranges as its rows need; the ranges' border groups are then merged by whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from relfold.llm.common import small_batches, written

#: Characters of a text in its sort key; order and equality are settled by the whole text.
LEAD = 24

_RUNS = "row bigint, text_sha256 string, run string, min_id bigint, members bigint, border boolean, head string"


def normalised(text):
    """The text with every run of ASCII white space as one space; null as empty."""
    return F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(""))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one sorted range.

    Holds one batch, the open run's ids, and those runs whose sort key is that of the range's first or latest
    row, as only they can go on in another range: they are marked as border and bring their text along.
    """
    import uuid

    schema = pa.schema(
        [("row", pa.int64()), ("text_sha256", pa.string()), ("run", pa.string()), ("min_id", pa.int64()),
         ("members", pa.int64()), ("border", pa.bool_()), ("head", pa.string())]
    )
    task, number = uuid.uuid4().hex, 0
    first_key = key = None
    waiting: list[list] = []  # [ids, digest, text] of the runs with the latest sort key; the last may go on

    def flush(border: bool) -> list[pa.RecordBatch]:
        nonlocal number, waiting
        out = []
        for ids, digest, text in waiting:
            number += 1
            rows = pa.concat_arrays(ids)
            n = len(rows)
            out.append(
                pa.record_batch(
                    [rows, pa.array([digest] * n), pa.array([f"{task}-{number}"] * n), pa.array([pc.min(rows).as_py()] * n, pa.int64()),
                     pa.array([n] * n, pa.int64()), pa.array([border] * n), pa.array([text if border else None] + [None] * (n - 1), pa.string())],
                    schema=schema,
                )
            )
        waiting = []
        return out

    def inner(rows: pa.Array, digests: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        """Rows of runs that lie within this batch and share their sort key with no other place."""
        n, none = len(rows), np.iinfo(np.int64).max
        least = np.minimum.reduceat(pc.fill_null(rows, none).to_numpy(), np.cumsum(sizes) - sizes)
        least = np.repeat(least, sizes)
        return pa.record_batch(
            [rows, digests, pa.nulls(n, pa.string()), pa.array(least, mask=least == none),
             pa.array(np.repeat(sizes, sizes)), pa.array(np.zeros(n, bool)), pa.nulls(n, pa.string())],
            schema=schema,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, keys, digests, rows = (batch.column(c) for c in ("norm", "key", "sha", "doc_id"))
        differ = ~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(differ) + 1, [batch.num_rows]])
        of_run = keys.take(pa.array(cuts[:-1])).to_pylist()
        first_key = of_run[0] if first_key is None else first_key
        kept_back = {first_key, key, of_run[-1]}
        for low, high, several in _stretches(of_run, kept_back):
            if several:
                yield from flush(key == first_key)
                a, b = cuts[low], cuts[high]
                yield inner(rows[a:b], digests[a:b], np.diff(cuts[low : high + 1]))
                key = None
                continue
            here, part = texts[int(cuts[low])].as_py(), rows[cuts[low] : cuts[high]]
            if waiting and of_run[low] == key and low == 0 and waiting[-1][2] == here:
                waiting[-1][0].append(part)
                continue
            if of_run[low] != key:
                yield from flush(key == first_key)
            key = of_run[low]
            waiting.append([[part], digests[int(cuts[low])].as_py(), here])
    yield from flush(True)


def _stretches(keys: list, single: set) -> Iterator[tuple[int, int, bool]]:
    """The runs in order: those with a key in ``single`` one by one, the others in stretches."""
    low = 0
    while low < len(keys):
        high = low
        while high < len(keys) and keys[high] not in single:
            high += 1
        if high > low:
            yield low, high, True
        else:
            high = low + 1
            yield low, high, False
        low = high


def exact_duplicates(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id bigint and text; others are ignored): doc_id, keep_id (the
    smallest doc_id of the equal texts), group_size, kept, text_sha256 of the normalised text.

    Null and empty texts are equal. Null ids stay rows of their own and never win over another id; a group of
    nothing but null ids has a null keep_id and keeps them. If an id is repeated within a group, all rows with the
    group's smallest id are kept. An empty table gives an empty result. ``ranges`` is the number of sorted ranges,
    by default the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("norm")).select(
        "doc_id", "norm", F.concat(F.substring("norm", 1, LEAD), F.lit("\x00"), F.hex(F.xxhash64("norm"))).alias("key")
    )
    ordered = norm.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "norm", "doc_id")
    hashed = ordered.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    runs = written(hashed.mapInArrow(_runs, _RUNS))
    # Border runs are at most a few for each range; grouping compares whole texts.
    merged = (
        runs.where(F.col("head").isNotNull())
        .groupBy("head")
        .agg(F.min("min_id").alias("keep_id"), F.sum("members").alias("group_size"), F.collect_list("run").alias("pieces"))
        .select(F.explode("pieces").alias("piece"), "keep_id", "group_size")
    )
    border = runs.where("border").join(merged, F.col("run") == F.col("piece"))
    whole = runs.where("not border").withColumns({"keep_id": F.col("min_id"), "group_size": F.col("members")})
    columns = ["row", "keep_id", "group_size", "text_sha256"]
    return (
        whole.select(*columns)
        .union(border.select(*columns))
        .select(
            F.col("row").alias("doc_id"),
            "keep_id",
            "group_size",
            F.col("row").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )
