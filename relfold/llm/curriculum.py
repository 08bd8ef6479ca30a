"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a weight that changes over the training run. The integral of its weight gives its share of
all tokens; the shares are turned into token targets, none above ``repeats`` times what the source holds.
Within a source the documents queue in a fixed pseudo-random order, over and over; a document's turn is the
place of its middle token in that queue. A source's cumulative demand at time t is its target times the part
of its weight's integral up to t, so inverting that at a document's turn gives the time at which it is due.

Weights run linearly from ``start`` to ``end`` times their mean, so demand is quadratic and its inverse has a
closed form. Only ids and sizes are shuffled to plan a mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from relfold.llm.common import written

#: Bits of an item's place in the queue that name its slice; a source of any size is spread over these slices.
SLICE_BITS = 12

#: Weights at the start and the end of training as multiples of their mean, by rank of the source.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def word_count(text: Column) -> Column:
    """Number of longest runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: float = 2.0, ramps=RAMPS
) -> DataFrame:
    """From one row per source (source, source_size): its target, and its weight at the start and the end as
    multiples of the mean.

    A source's weight is its entry in ``weights`` times the integral of its ramp. Sources in order of code points, null last, take the weights in turn. Targets sum to ``share`` of all sizes
    and stop at ``repeats`` times the source's size; the excess goes to the others by weight. Sorted by the ratio
    at which a source fills up, those that stop are a prefix, so running sums settle the targets without a loop.
    One row per source meets in one task here, however many documents there are.
    """
    if not all(a >= 0 and b >= 0 and a + b > 0 for a, b in ramps):
        raise ValueError("a ramp's ends must not be negative, nor both 0")
    # Spark compares strings by their UTF-8 bytes, which is the order of code points.
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name) - 1
    pick = lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (i % len(values) + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).select(
        "source",
        "source_size",
        (pick(weights, F.col("rank")) * pick([(r[0] + r[1]) / 2 for r in ramps], F.col("rank"))).alias("weight"),
        pick([r[0] for r in ramps], F.col("rank")).alias("start"),
        pick([r[1] for r in ramps], F.col("rank")).alias("end"),
        (F.lit(repeats) * F.col("source_size")).alias("most"),
    )
    ordered = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    wanted = F.least(F.lit(float(share)), F.lit(float(repeats))) * F.sum("source_size").over(everything)
    level = (wanted - filled) / open_weight  # tokens per weight if all sources before this one stop
    stops = F.col("level") * F.col("weight") >= F.col("most")
    levels = ranked.withColumn("level", level).withColumn("stops", stops)
    # The first source that does not stop sets the level for itself and all after it, whose own levels are lower.
    final = F.max(F.when(~F.col("stops"), F.col("level"))).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    # A source of size 0 has nothing to give.
    target = F.when(F.col("stops") | F.col("final").isNull(), F.col("most")).otherwise(F.least(F.col("final") * F.col("weight"), F.col("most")))
    return levels.withColumn("final", final).select("source", "source_size", target.alias("target"), "start", "end")


def _part(source: Column, slice_: Column) -> Column:
    """One text for each source (null is one) and slice, so that joining and windowing share a partitioning."""
    return F.concat(F.coalesce(F.concat(F.lit("s"), source), F.lit("n")), F.lit("\x00"), slice_.cast("string"))


def draw(doc_id: Column) -> Column:
    """The place of an id in its source's queue: 32 bits of a digest."""
    digest = F.coalesce(F.md5(doc_id.cast("string").cast("binary")), F.lit("0"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def plan_mix(items: DataFrame, **options) -> DataFrame:
    """Add mix_source_size, mix_target, mix_turn (tokens queued before an item's middle), mix_start, mix_end,
    mix_copies and, with mix_part a key, mix_row to ``items`` (columns mix_id, mix_source, mix_size, mix_draw; others ride along).

    Copy number c of an item (from 0) is due when the queue has moved c times round; it is taken if its middle
    token lies before the target, so a source misses its target by half an item at most. Items of size 0 are
    taken once, in turn. A null source is a source.
    """
    slice_ = F.shiftright("mix_draw", 32 - SLICE_BITS)
    sliced = items.withColumn("mix_part", _part(F.col("mix_source"), slice_))
    parts = written(
        sliced.groupBy("mix_part", F.col("mix_source").alias("source"), slice_.alias("slice")).agg(F.sum("mix_size").alias("part_size"))
    )
    along = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("part_size").over(along), F.lit(0))
    sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sizes, **options).select(
        F.col("source").alias("of"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.col("start").alias("mix_start"),
        F.col("end").alias("mix_end"),
    )
    offsets = (
        parts.select(F.col("mix_part").alias("part"), "source", before.alias("mix_before"))
        .join(targets, F.col("source").eqNullSafe(F.col("of")))
        .drop("source", "of")
    )
    joined = sliced.join(offsets, F.col("mix_part") == F.col("part")).drop("part")
    queue = Window.partitionBy("mix_part").orderBy("mix_draw", "mix_id", "mix_size")
    inside = queue.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.col("mix_before") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0)) + F.col("mix_size") / 2
    # At most ``repeats`` copies, as the target is no more than that many times the source.
    copies = F.greatest(F.ceil((F.col("mix_target") - F.col("mix_turn")) / F.col("mix_source_size")), F.lit(0))
    return (
        joined.withColumns({"mix_turn": turn, "mix_row": F.row_number().over(queue)})
        .withColumn("mix_copies", F.when(F.col("mix_size") == 0, 1).otherwise(copies).cast("int"))
        .drop("mix_before")
    )


def due_time(turn: Column, target: Column, start: Column, end: Column) -> Column:
    """The t in [0, 1] at which a source's cumulative demand reaches ``turn``: with a weight running linearly from
    start to end, start * t + (end - start) / 2 * t * t = (start + end) / 2 * turn / target."""
    part = F.when(target > 0, F.least(turn / target, F.lit(1.0))).otherwise(F.lit(0.0)) * (start + end) / 2
    # The root in the form that does not cancel; right for start = end, too.
    root = start + F.sqrt(F.greatest(start * start + 2 * (end - start) * part, F.lit(0.0)))
    return F.when(root > 0, 2 * part / root).otherwise(F.lit(0.0))


def _item(text: str, source: str) -> dict[str, Column]:
    return {
        "mix_id": F.col("doc_id"),
        "mix_source": F.col(source),
        "mix_size": word_count(F.col(text)),
        "mix_draw": draw(F.col("doc_id")),
    }


def _laid_out(plan: DataFrame) -> DataFrame:
    """A row per planned item and copy, with columns copy and at (when it is due), range-sorted by that time. Items
    that are not taken come last, with nulls."""
    taken = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(0), F.col("mix_copies") - 1))
    copied = plan.select("*", F.explode_outer(taken).alias("copy"))
    turn = F.col("mix_turn") + F.col("copy") * F.col("mix_source_size")
    due = F.when(F.col("copy").isNotNull(), due_time(turn, F.col("mix_target"), F.col("mix_start"), F.col("mix_end")))
    ranges = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_last("at"), F.asc("mix_id"), F.asc("copy")]
    return copied.withColumn("at", due).repartitionByRange(ranges, *order).sortWithinPartitions(*order)


def mixed(docs: DataFrame, text: str = "text", source: str = "source", positions: str | None = None, **options) -> DataFrame:
    """doc_id, size, source_size, target (the source's) and taken (words the mix takes, repeats counted) of every
    row of ``docs`` (columns doc_id, text, source; others are ignored), in order of their first place in training.
    ``positions`` names an added column with the places of a row's copies in the training order, from 0.

    ``taken`` counts the copies that have a place. Null texts have size 0. Null ids and sources are values like
    others. Repeated rows are rows of their own; rows equal in id and size are interchangeable. An empty table gives
    an empty result.
    """
    items = written(docs.select(*[c.alias(name) for name, c in _item(text, source).items()]))
    kept = ["mix_part", "mix_row", "mix_id", "mix_size", "mix_source_size", "mix_target", "at"]
    # The id numbers the rows of a range upwards from the range's number, shifted by 33 bits.
    stamped = written(_laid_out(plan_mix(items, **options)).select(*kept, F.monotonically_increasing_id().alias("stamp")))
    range_ = F.shiftright("stamp", 33)
    sizes = stamped.where("at is not null").groupBy(range_.alias("of")).agg(F.count("*").alias("n"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = sizes.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.when(F.col("at").isNotNull(), F.col("before") + F.col("stamp").bitwiseAND((1 << 33) - 1))
    placed = stamped.withColumn("range", range_).join(F.broadcast(sizes), F.col("range") == F.col("of"), "left").withColumn("place", place)
    dealt = placed.groupBy("mix_part", "mix_row").agg(
        *[F.first(c).alias(c) for c in kept[2:6]],
        F.array_sort(F.collect_list("place")).alias("places"),
        F.coalesce(F.sum(F.when(F.col("place").isNotNull(), F.col("mix_size"))), F.lit(0)).alias("taken"),
    )
    dealt = dealt.withColumn("first", F.when(F.size("places") > 0, F.col("places")[0]))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_last("first"), F.asc("mix_id")]
    return dealt.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(
        F.col("mix_id").alias("doc_id"),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        "taken",
        *([F.col("places").alias(positions)] if positions else []),
    )


def curriculum(docs: DataFrame, text: str = "text", source: str = "source", due: str | None = None, **options) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it, range-sorted by the time at which
    it is due. The columns are those of ``docs``; ``due`` names an added column with that time.

    The whole row rides along in one struct, so columns of any name do no harm.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    items = docs.select(row, *[c.alias(name) for name, c in _item(text, source).items()])
    laid_out = _laid_out(plan_mix(items, **options).where(F.col("mix_copies") > 0))
    extra = [F.col("at").alias(due)] if due else []
    return laid_out.select(*[F.col("row")[c].alias(c) for c in docs.columns], *extra)
