"""Null-safe, skew-safe left joins to a right side with one row per key.

A key column ``k`` is carried as two join tokens, ``coalesce(k, default)`` and ``isnull(k)``.
Grouping and joining on the tokens makes null match null while keeping plain equality. Joins leave hot keys
to adaptive execution, which wants both sides shuffled for the join itself; where a table is known to have no hot
keys (it was bucketed, or its sketch says so), a frame that was grouped on its tokens is already partitioned for
the join and is not shuffled again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from relfold.functions.columns import field_of, is_integral, quoted
from relfold.session import shared_folder, stored

# Stand-in for a null key; the isnull token keeps it apart from a real value.
_DEFAULTS = {
    T.StringType: "''",
    T.BooleanType: "false",
    T.DateType: "date'1970-01-01'",
    T.TimestampType: "timestamp'1970-01-01 00:00:00'",
    T.TimestampNTZType: "timestamp_ntz'1970-01-01 00:00:00'",
    T.BinaryType: "x''",
}


@dataclass(frozen=True)
class SkewPolicy:
    """Salting of hot keys by hand, for plans that run without adaptive execution or must keep their partitioning.

    Without a policy, joins leave hot keys to adaptive execution: both sides are shuffled for the join itself, so a
    partition that is far larger than the others is read in slices, the matching one once per slice. No job is started
    to find hot keys. With a policy, a sketch of the left side's keys (``hot_hashes``) tells the hot ones, which are
    salted at every size of input.

    ``share``: part of the rows that makes a key hot, by default 1 / (4 * shuffle partitions), so that what is not
    split is a quarter of an even partition at most. At most 1 / share keys can be hot. ``salts``: slices per hot
    key, by default the number of shuffle partitions.
    """

    share: float | None = None
    salts: int | None = None

    def share_in(self, spark: SparkSession) -> float:
        return self.share or 1 / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Hot keys are split by adaptive execution.
DEFAULT_SKEW: SkewPolicy | None = None


@dataclass(frozen=True)
class KeyedFrame:
    """Payload columns plus the join tokens of ``keys``; one row per key."""

    frame: DataFrame
    keys: tuple[str, ...]
    null_safe: bool

    @property
    def tokens(self) -> list[str]:
        return token_names(len(self.keys), self.null_safe)

    @property
    def payload(self) -> list[str]:
        hidden = set(self.tokens)
        return [c for c in self.frame.columns if c not in hidden]

    def pick(self, columns: Sequence[str]) -> "KeyedFrame":
        frame = self.frame.select(*self.tokens, *[quoted(c) for c in columns])
        return KeyedFrame(frame, self.keys, self.null_safe)

    def _key_columns(self) -> list[Column]:
        columns = []
        for i, key in enumerate(self.keys):
            token = F.col(f"__key{i}")
            columns.append((F.when(~F.col(f"__null{i}"), token) if self.null_safe else token).alias(key))
        return columns

    def visible(self) -> DataFrame:
        """The frame with ordinary key columns in place of the tokens."""
        return self.frame.select(*self._key_columns(), *[quoted(c) for c in self.payload])

    def stored(self) -> "KeyedFrame":
        """Computed once and read back, for several bases."""
        return KeyedFrame(stored(self.frame), self.keys, self.null_safe)

    def with_key_column(self) -> "KeyedFrame":
        """The key repeated in the payload."""
        return KeyedFrame(self.frame.select("*", *self._key_columns()), self.keys, self.null_safe)


def token_names(n_keys: int, null_safe: bool) -> list[str]:
    names = [f"__key{i}" for i in range(n_keys)]
    return names + [f"__null{i}" for i in range(n_keys)] if null_safe else names


def _key_value(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    dtype = field_of(df, name).dataType
    if is_integral(dtype):
        return quoted(name).cast("bigint"), T.LongType()
    if isinstance(dtype, T.FloatType):
        return quoted(name).cast("double"), T.DoubleType()
    return quoted(name), dtype


#: Names of the stored tokens of a bucketed table's key.
_VALUE, _NULL = "__token__{}", "__token_null__{}"


def bucketed(df: DataFrame, key: str, buckets: int | None = None, share: float | None = None) -> DataFrame:
    """The frame stored in buckets of a key, so that any number of later joins and groupings on it shuffle the other
    side only. The key's join tokens are stored as columns of their own (``without_tokens`` drops them), and its hot
    values, sketched while the table is written, go along as their metadata: ``attach`` salts these alone, and where
    there are none, no side of the table is touched."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = SkewPolicy(share).share_in(spark)
    value, flag = (name.format(key) for name in (_VALUE, _NULL))
    tokens = token_columns(df, [key])
    # Hash partitioning deals rows out as buckets do, so each task writes one file.
    wide = df.withColumns({value: tokens[0], flag: tokens[1]}).repartition(buckets, value, flag)
    observed = Observation()
    wide = wide.observe(observed, *_sketch_columns({"k": [F.col(value), F.col(flag)]}, share))
    name = f"relfold_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    wide.write.bucketBy(buckets, value, flag).sortBy(value, flag).option("path", path).format("parquet").saveAsTable(name)
    hot = _sketch_of(observed.get, ["k"]).hot("k", share)
    return spark.table(name).withMetadata(value, {"hot": hot})


def without_tokens(df: DataFrame) -> DataFrame:
    """A frame without the token columns of ``bucketed``."""
    prefixes = tuple(name.format("") for name in (_VALUE, _NULL))
    return df.select(*[quoted(c) for c in df.columns if not c.startswith(prefixes)])


def _stored_tokens(df: DataFrame, keys: Sequence[str]) -> list[str] | None:
    names = [name.format(k) for name in (_VALUE, _NULL) for k in keys]
    return names if set(names) <= set(df.columns) else None


def _known_hot(df: DataFrame, keys: Sequence[str]) -> list[int] | None:
    """The hot values of a bucketed table's key."""
    if len(keys) != 1 or not _stored_tokens(df, keys):
        return None
    return field_of(df, _VALUE.format(keys[0])).metadata.get("hot")


def token_columns(df: DataFrame, keys: Sequence[str], null_safe: bool = True) -> list[Column]:
    kept = _stored_tokens(df, keys)
    if kept and null_safe:
        return [quoted(c) for c in kept]
    values, nulls = [], []
    for name in keys:
        value, dtype = _key_value(df, name)
        if isinstance(dtype, T.DoubleType):
            # NaN is a missing key; adding zero folds -0.0 into 0.0.
            value = F.when(~F.isnan(value), value + F.lit(0.0))
        if null_safe:
            nulls.append(F.isnull(value))
            default = next((v for t, v in _DEFAULTS.items() if isinstance(dtype, t)), None)
            if default is not None:
                value = F.coalesce(value, F.expr(default))
            elif isinstance(dtype, T.NumericType):
                value = F.coalesce(value, F.lit(0).cast(dtype))
            else:
                raise TypeError(f"column {name!r} of type {dtype.simpleString()} cannot be a key")
        values.append(value)
    return values + nulls


def with_tokens(df: DataFrame, keys: Sequence[str], null_safe: bool, payload: Sequence[Column]) -> DataFrame:
    names = token_names(len(keys), null_safe)
    columns = token_columns(df, keys, null_safe)
    return df.select(*[c.alias(n) for c, n in zip(columns, names)], *payload)


def keyed(df: DataFrame, keys: Sequence[str], payload: Sequence[str] | None = None, null_safe: bool = True) -> KeyedFrame:
    """Wrap a frame known to hold one row per key."""
    columns = [c for c in df.columns if c not in keys] if payload is None else list(payload)
    frame = with_tokens(df, keys, null_safe, [quoted(c) for c in columns])
    return KeyedFrame(frame, tuple(keys), null_safe)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; null is a key value like any other."""
    names = token_names(len(keys), True)
    tokens = with_tokens(df, keys, True, [])
    return tokens.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def is_unique(df: DataFrame, keys: Sequence[str]) -> bool:
    return duplicate_keys(df, keys).isEmpty()


def guarded(df: DataFrame, keys: Sequence[str], null_safe: bool = True) -> KeyedFrame:
    """One row per key, or a failing job: the uniqueness test rides in the grouping that the join
    needs anyway, so nothing is computed twice."""
    payload = [c for c in df.columns if c not in keys]
    names = token_names(len(keys), null_safe)
    source = with_tokens(df, keys, null_safe, [quoted(c) for c in payload])
    rows = source.groupBy(*names).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.any_value(quoted(c)).alias(c) for c in payload]
    )
    message = F.lit(f"more than one row for a key of {list(keys)}")
    checked = rows.where(F.when(F.col("__rows") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return KeyedFrame(checked.drop("__rows"), tuple(keys), null_safe)


#: Most keys that one sketch may track, a bound of the aggregate itself.
TRACKED = 1_000_000


def _tracked(share: float) -> int:
    """Keys a sketch tracks so that none above ``share`` is missed: it is off by 3.5 of the rows over their number at most, and
    names what has surely more than that, so its error must be less than half of the share."""
    return min(TRACKED, max(64, int(8 / share)))


@dataclass(frozen=True)
class KeySketch:
    """Counters of a table's most frequent keys, one sketch per set of keys, and its rows. Taken in one pass, also
    while the table is written (``stored_with_sketch``), and merged over tasks by the aggregate itself."""

    total: int
    #: (hash of the key, estimated rows), most frequent first.
    counters: dict[str, list[tuple[int, int]]]

    def hot(self, name: str, share: float) -> list[int]:
        """Hashes of keys that hold more than ``share`` of the rows. A hash collision splits both keys: results do not
        depend on what is found."""
        return [h for h, n in self.counters[name] if n > share * self.total]


def _sketch_columns(key_sets: dict[str, list[Column]], share: float) -> list[Column]:
    # The estimate is part of the aggregate's result, so at most 1 / share counters per set reach the driver.
    size = min(_tracked(share), int(1 / share) + 1)
    tops = [F.call_function("approx_top_k", F.xxhash64(*cols), F.lit(size), F.lit(_tracked(share))).alias(name) for name, cols in key_sets.items()]
    return [F.count(F.lit(1)).alias("__total"), *tops]


def _sketch_of(values: dict, names: Sequence[str]) -> KeySketch:
    return KeySketch(values["__total"], {n: [(r["item"], r["count"]) for r in values[n] or []] for n in names})


def key_sketch(df: DataFrame, key_sets: dict[str, list[Column]], share: float) -> KeySketch:
    """The sketch of a frame's keys, in one pass."""
    return _sketch_of(df.agg(*_sketch_columns(key_sets, share)).first().asDict(), list(key_sets))


def stored_with_sketch(df: DataFrame, key_sets: dict[str, Sequence[str]], share: float) -> tuple[DataFrame, KeySketch]:
    """``stored`` with the sketch of some sets of key columns, observed while the table is written: the frame is
    computed once, and ``attach`` takes ``sketch.hot(name, share)`` for any number of joins on the stored table."""
    observed = Observation()
    columns = _sketch_columns({name: token_columns(df, keys) for name, keys in key_sets.items()}, share)
    frame = stored(df.observe(observed, *columns))
    return frame, _sketch_of(observed.get, list(key_sets))


def hot_hashes(df: DataFrame, key_sets: dict[str, list[Column]], share: float) -> dict[str, list[int]]:
    """Hashes of keys that hold more than ``share`` of the rows, from a sketch taken in one pass."""
    sketch = key_sketch(df, key_sets, share)
    return {name: sketch.hot(name, share) for name in key_sets}


def _marked(df: DataFrame, hashed: Column, hot: Sequence[int], name: str) -> DataFrame:
    """``df`` with a column that tells whether a hash is hot. The hot ones, at most 1 / share numbers, are a table."""
    table = df.sparkSession.createDataFrame(pd.DataFrame({"__hot": np.array(hot, np.int64)}), "__hot bigint")
    joined = df.join(F.broadcast(table), hashed == F.col("__hot"), "left")
    return joined.withColumn(name, F.col("__hot").isNotNull()).drop("__hot")


def _salt_source(df: DataFrame) -> Column:
    """Repeatable on task retry, and different for exact copies that sit in different splits."""
    hashable = [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*hashable, F.spark_partition_id())


def attach(
    base: DataFrame,
    base_keys: Sequence[str],
    frames: Sequence[KeyedFrame],
    skew: SkewPolicy | None = DEFAULT_SKEW,
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Left-join frames that share one base key. The base is shuffled once for all of them.

    Each frame holds one row per key, so the rows of ``base`` neither multiply nor vanish. A frame
    column already present on the base is dropped (left wins). Whether a frame is broadcast is left to Spark, which
    checks size. Hot base keys are split by adaptive execution; with a ``skew`` policy, or given their hashes as
    ``hot``, they are salted and the few matching right rows replicated. An empty ``hot`` says that there are none, so
    that a grouped frame need not be shuffled again.
    """
    if not frames:
        return base
    order = list(base.columns)
    spark = base.sparkSession
    hot = _known_hot(base, base_keys) if hot is None else hot
    adaptive = hot is None and skew is None
    if hot is None and skew is not None:
        hot = hot_hashes(base, {"h": token_columns(base, base_keys)}, skew.share_in(spark))["h"]
    salts = (skew and skew.salts) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = bool(hot) and salts > 1
    result = base
    if split:
        marked = _marked(base, F.xxhash64(*token_columns(base, base_keys)), hot, "__is_hot")
        salt = F.when(F.col("__is_hot"), F.pmod(_salt_source(base), F.lit(salts))).otherwise(F.lit(0)).cast("int")
        result = marked.withColumn("__salt", salt).drop("__is_hot")
    for item in frames:
        if len(item.keys) != len(base_keys):
            raise ValueError(f"keys {item.keys} do not pair with {list(base_keys)}")
        item = item.pick([c for c in item.payload if c not in result.columns])
        if not item.payload:
            continue
        left = token_columns(result, base_keys, item.null_safe)
        _same_types(result.select(*left), item)
        # The base may be a keyed frame itself, so the right tokens get names of their own.
        matched = {name: f"__right{name}" for name in item.tokens}
        condition = [c == F.col(n) for c, n in zip(left, matched.values())]
        right = item.frame
        if split:
            right = _replicated(item, hot, salts)
            condition.append(F.col("__salt") == F.col("__right_salt"))
        right = right.withColumnsRenamed(matched)
        if adaptive:
            # Joined by the tokens' hash first: no frame comes partitioned by it, so both sides are shuffled for this
            # join alone, which is what adaptive execution can split; and sorting compares one number.
            right = right.withColumn("__right_hash", _token_hash(item, "__right__"))
            condition.insert(0, F.xxhash64(*token_columns(result, base_keys)) == F.col("__right_hash"))
        joined = result.join(right, condition, "left")
        order += item.payload
        keep = order + ["__salt"] if split else order
        result = joined.select(*[quoted(c) for c in keep])
    return result.select(*[quoted(c) for c in order]) if split else result


def _token_hash(item: KeyedFrame, prefix: str = "__") -> Column:
    """The hash that ``xxhash64(*token_columns(...))`` gives on the base side: values, then null flags."""
    n = range(len(item.keys))
    tokens = [F.col(f"{prefix}key{i}") for i in n]
    flags = [F.col(f"{prefix}null{i}") if item.null_safe else F.isnull(F.col(f"{prefix}key{i}")) for i in n]
    return F.xxhash64(*tokens, *flags)


def _same_types(left: DataFrame, item: KeyedFrame) -> None:
    for mine, name in zip(left.schema.fields, item.tokens):
        theirs = field_of(item.frame, name)
        if mine.dataType != theirs.dataType:
            raise TypeError(
                f"cannot join keys {list(item.keys)}: {mine.dataType.simpleString()} "
                f"against {theirs.dataType.simpleString()}"
            )


def _replicated(item: KeyedFrame, hot: Sequence[int], salts: int) -> DataFrame:
    """The frame with a salt: all of them for a hot key, zero otherwise."""
    marked = _marked(item.frame, _token_hash(item), hot, "__is_hot")
    every = F.when(F.col("__is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("__right_salt", F.explode(every)).drop("__is_hot")


def attach_grouped(
    base: DataFrame,
    groups: dict[tuple[str, ...], list[KeyedFrame]],
    skew: SkewPolicy | None = DEFAULT_SKEW,
) -> DataFrame:
    """``attach`` for several base keys; with a policy, one sketch tells the hot keys of all of them."""
    found: dict[str, list[int]] = {}
    if skew is not None:
        sets = {f"h{i}": token_columns(base, keys) for i, keys in enumerate(groups) if set(keys) <= set(base.columns)}
        found = hot_hashes(base, sets, skew.share_in(base.sparkSession)) if sets else {}
    result = base
    for i, (keys, frames) in enumerate(groups.items()):
        # A key that an earlier frame brings in is sketched on the joins that lead to it; other columns are pruned.
        result = attach(result, keys, frames, skew, found.get(f"h{i}"))
    return result


def left_join_unique(
    base: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    null_safe: bool = True,
    skew: SkewPolicy | None = DEFAULT_SKEW,
) -> DataFrame:
    """Left join to a right side the caller knows to be unique on its keys."""
    frame = keyed(right, right_keys or keys, columns, null_safe)
    return attach(base, keys, [frame], skew)
