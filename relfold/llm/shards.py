"""Token sequences in training order, in binary shards of fixed stride.

The documents' tokens, each document closed by an end token, form one stream in the order in which the table is
read, cut into sequences of equal length. A keyed Feistel network over the smallest even number of bits, walked until it falls
into range, permutes the sequence numbers: every sequence has one slot, any slot can be computed from the key
alone, and nothing is sorted to shuffle. Slots are range-partitioned into shards; slot s lies in shard s / R at
byte (s mod R) * stride, so a reader starts anywhere and goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from relfold.llm.common import small_batches, written
from relfold.llm.pieces import SPAN, Encoder, Pieces

#: Tokens of a sequence, bytes of a token, sequences of a shard.
LENGTH, TOKEN_BYTES, PER_SHARD = 1024, 2, 512
ROUNDS = 4


def _round(half: np.ndarray, key: np.uint64, k: int, mask: np.uint64) -> np.ndarray:
    x = half + key + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def feistel(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slots of sequence numbers in [0, count): a permutation of that range for every key."""
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask, secret = np.uint64((1 << int(half)) - 1), np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in range(ROUNDS):
            left, right = right, left ^ _round(right, secret, k, mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= np.uint64(count)]
    return out.astype(np.int64)


def feistel_inverse(slots: np.ndarray, count: int, key: int) -> np.ndarray:
    """The sequence numbers of slots."""
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask, secret = np.uint64((1 << int(half)) - 1), np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    out = slots.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in reversed(range(ROUNDS)):
            left, right = right ^ _round(left, secret, k, mask), left
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= np.uint64(count)]
    return out.astype(np.int64)


def slot_of(number: Column, count: int, key: int) -> Column:
    @F.arrow_udf("bigint")
    def slots(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(feistel(column.to_numpy(), count, key))

    return slots(number)


def token_stream(docs: DataFrame, vocabulary: Pieces, end: int, text: str) -> DataFrame:
    """(task, at, tokens) for every row: little-endian ids of its whole text and the end token, and how many tokens
    the task wrote before. Written once, so that later steps see the same stream."""
    encoder = Encoder(vocabulary)  # its tables travel with the tasks

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            short = iter(encoder.encode([t for t in texts if len(t) <= SPAN]))
            last = np.array([end], np.int64)
            packed = []
            for text in texts:  # a giant text's ids are had and packed a span at a time
                spans = [next(short)] if len(text) <= SPAN else encoder.spans(text)
                packed.append(b"".join(i.astype(f"<u{TOKEN_BYTES}").tobytes() for i in chain(spans, [last])))
            sizes = np.array([len(p) // TOKEN_BYTES for p in packed], np.int64)
            begins = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.record_batch([pa.array([task] * len(texts), pa.int32()), pa.array(begins), pa.array(packed, pa.binary())], names=["task", "at", "tokens"])

    return written(docs.select(F.col(text)).mapInArrow(streamed, "task int, at bigint, tokens binary"), compression="zstd")


def training_shards(
    docs: DataFrame, vocabulary: Pieces, key: int = 2024, end: int = 2, text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD
) -> DataFrame:
    """One row per shard: shard, first_slot, slots, stride (bytes of a sequence), payload (the slots' sequences one
    after the other) and payload_sha256. Only the last sequence of the stream is filled up, with end tokens.

    The stream follows the order in which Spark reads the rows; sort them first for another one. Null and empty
    texts give an end token. Other columns are ignored, repeated rows are kept. No rows give no shards. Ids must
    fit into TOKEN_BYTES bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if max(len(vocabulary.pieces) - 1, end) >= 1 << (8 * TOKEN_BYTES):
        raise ValueError("ids do not fit into a token's bytes")
    stride = length * TOKEN_BYTES
    stream = token_stream(docs, vocabulary, end, text)
    size = (F.length("tokens") / TOKEN_BYTES).cast("bigint")
    sums = stream.groupBy("task").agg(F.max(F.col("at") + size).alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    begins = written(sums.select("task", "tokens", F.coalesce(before, F.lit(0)).alias("begin")))
    total = begins.agg(F.sum("tokens")).first()[0]
    if not total:
        return spark.createDataFrame([], "shard bigint, first_slot bigint, slots int, stride int, payload binary, payload_sha256 string")
    count = -(-total // length)
    # One row for each task that wrote tokens.
    placed = stream.join(F.broadcast(begins.select("task", "begin")), "task").select((F.col("begin") + F.col("at")).alias("at"), size.alias("size"), "tokens")
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("size") - 1) / length)

    def cut(number: Column) -> Column:
        """A sequence's share of a text, cut out here: what comes after has a sequence's tokens, never a whole text's."""
        begin, stop = F.greatest(F.col("at"), number * length), F.least(F.col("at") + F.col("size"), (number + 1) * length)
        part = F.substring("tokens", ((begin - F.col("at")) * TOKEN_BYTES + 1).cast("int"), ((stop - begin) * TOKEN_BYTES).cast("int"))
        return F.struct(number.alias("number"), begin.alias("begin"), part.alias("part"))

    parts = placed.select(F.inline(F.transform(F.sequence(first, last), cut)))
    parts = parts.select(slot_of(F.col("number"), count, key).alias("slot"), "begin", "part")
    parts = parts.withColumn("shard", F.floor(F.col("slot") / per_shard))
    # Slots are uniform, so ranges of shards are even without a sample.
    shards, ranges = -(-count // per_shard), int(spark.conf.get("spark.sql.shuffle.partitions"))
    range_ = F.floor(F.col("shard") * F.lit(min(ranges, shards)) / F.lit(shards)).cast("int")
    ordered = parts.repartitionById(min(ranges, shards), range_).sortWithinPartitions("shard", "slot", "begin")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come in order; a shard is written once the next one begins."""
        names = ["shard", "first_slot", "slots", "payload"]
        shard, begin, got, slots, parts = None, 0, 0, set(), []

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([shard]), pa.array([begin]), pa.array([len(slots)], pa.int32()), pa.array([b"".join(parts)], pa.binary())], names=names)

        filled = (total - (count - 1) * length) * TOKEN_BYTES  # bytes of the one sequence that is not full
        rest = np.full(stride // TOKEN_BYTES, end, f"<u{TOKEN_BYTES}").tobytes()[filled:]
        short = int(feistel(np.array([count - 1]), count, key)[0])
        for batch in batches:
            for s, slot, piece in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "part"))):
                if s != shard:
                    if slots:
                        yield done()
                    shard, begin, slots, parts, got = s, slot, set(), [], 0
                slots.add(slot)
                parts.append(piece)
                if slot == short:
                    got += len(piece)
                    if got == filled:
                        parts.append(rest)
        if slots:
            yield done()

    packed_shards = ordered.mapInArrow(packed, "shard bigint, first_slot bigint, slots int, payload binary")
    return packed_shards.select("shard", "first_slot", "slots", F.lit(stride).alias("stride"), "payload", F.sha2("payload", 256).alias("payload_sha256"))


def write_shards(shards: DataFrame, path: str) -> None:
    """One uncompressed file per range of shards, so that a slot's bytes lie where its number says."""
    shards.write.option("compression", "none").parquet(path)


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """(slot, payload) from slot ``start`` on, in order within a file; earlier shards are not read."""
    shards = spark.read.parquet(path)
    shards = shards.where(F.col("first_slot") + F.col("slots") > start)
    if stop is not None:
        shards = shards.where(F.col("first_slot") < stop)
    slots = shards.select("first_slot", "stride", "payload", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("k"))
    slots = slots.select((F.col("first_slot") + F.col("k")).alias("slot"), F.substring("payload", F.col("k") * F.col("stride") + 1, F.col("stride")).alias("payload"))
    return slots.where((F.col("slot") >= start) & (F.lit(True) if stop is None else F.col("slot") < stop))
