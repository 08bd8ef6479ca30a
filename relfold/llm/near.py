"""N-gram Jaccard join: pairs of texts whose sets of word n-grams are similar, found by MinHash banding.

Texts with equal n-gram sets form a class with one representative, whatever their number. Representatives meet
on band hashes, in buckets; buckets connected through common texts form candidate groups. A group is dealt to tasks
in blocks of texts, every block meeting every other, or bucket by bucket, where a pair counts in its first common
bucket only: whichever sends fewer texts. Texts that are alike in part only, by common boilerplate say, can chain into
a group of any size, but each of them lies in few buckets. Within a task, pairs that share a band are verified on their
full n-gram sets and only counted: one row per text leaves the task, not one per pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from relfold.llm.common import joined_in_slices, small_batches, written
from relfold.llm.components import components
from relfold.llm.words import mix, shingles, word_hashes

#: Texts of one group that a task holds from either block, and texts dealt to one task if groups are small.
BLOCK, UNIT = 1024, 1024
#: Most MinHash values of a text.
MOST_HASHES = 100
#: n-grams hashed together; bounds memory for long texts.
SPAN = 4096


def choose_bands(similarity: float, recall: float) -> tuple[int, int]:
    """(bands, rows): the longest bands for which a pair of that similarity shares one with at least the
    probability ``recall`` within MOST_HASHES values; longer bands bring fewer false candidates."""
    best = None
    for rows in range(1, 17):
        chance = similarity**rows
        bands = 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log(1 - chance))
        if best is None or bands * rows <= MOST_HASHES:
            best = (bands, rows)
    return best


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band over the least values of ``rows`` hash functions."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factors, least = seeds | np.uint64(1), np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    shifts = mix(seeds)[:, None]
    for at in range(0, len(grams), SPAN):
        values = factors[:, None] * grams[None, at : at + SPAN]
        values += shifts
        np.minimum(least, values.min(axis=1), out=least)
    least = mix(least).reshape(bands, rows)
    total = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        total = mix(total * np.uint64(0x100000001B3) + least[:, k])
    return total.view(np.int64)


def sketch(text: Column, size: int, bands: int, rows: int) -> Column:
    """A struct (key, bands) of a whole text: key null if it has no word."""
    kind = StructType([StructField("key", BinaryType()), StructField("bands", ArrayType(LongType()))])

    @F.arrow_udf(kind)
    def sketched(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            hashes, offsets = word_hashes(column)
            keys, signatures = [], []
            for a, b in zip(offsets, offsets[1:]):
                grams = shingles(hashes[a:b], size)
                keys.append(set_key(grams) if len(grams) else None)
                signatures.append(band_hashes(grams, bands, rows) if len(grams) else None)
            yield pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(signatures, pa.list_(pa.int64()))], ["key", "bands"])

    return sketched(text)


def linked_pairs(
    grams: list[np.ndarray], bands: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float, band: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with i of ``left`` and j of ``right`` that share a band hash (``band`` being the first one
    they share, if given) and are similar on their whole sets; if left and right are the same, every pair once."""
    same = left is right
    found_a, found_b = [], []
    sizes = np.array([len(g) for g in grams])
    for low in range(0, len(left), 128):
        a = left[low : low + 128]
        share = np.zeros((len(a), len(right)), bool)
        if band is None:
            for k in range(bands.shape[1]):
                share |= bands[a, k][:, None] == bands[right, k][None, :]
        else:
            share = bands[a, band][:, None] == bands[right, band][None, :]
            for k in range(band):
                share &= bands[a, k][:, None] != bands[right, k][None, :]
        if same:
            share &= np.arange(low, low + len(a))[:, None] < np.arange(len(right))[None, :]
        # A pair can only be that similar if the sizes are.
        small, large = np.minimum(sizes[a][:, None], sizes[right][None, :]), np.maximum(sizes[a][:, None], sizes[right][None, :])
        share &= small >= similarity * large - 1e-9
        if not share.any():
            continue
        rows, columns = np.nonzero(share)
        if len(rows) <= 4 * len(a):
            common = np.array([len(np.intersect1d(grams[a[i]], grams[right[j]], assume_unique=True)) for i, j in zip(rows, columns)])
        else:
            common = _common([grams[i] for i in a], [grams[j] for j in right], share)[rows, columns]
        union = sizes[a[rows]] + sizes[right[columns]] - common
        good = common >= similarity * union - 1e-9
        found_a.append(a[rows[good]])
        found_b.append(right[columns[good]])
    none = np.empty(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _common(a: list[np.ndarray], b: list[np.ndarray], share: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of many pairs by matrix products over slices of the n-grams in both lists."""
    out = np.zeros((len(a), len(b)), np.float32)
    used = np.flatnonzero(share.any(axis=0))
    b = [b[j] for j in used]
    ga, gb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(np.unique(ga), np.unique(gb), assume_unique=True)
    if not len(both):
        return out
    spots = []
    for g, r in ((ga, ra), (gb, rb)):
        at = np.minimum(np.searchsorted(both, g), len(both) - 1)
        kept = both[at] == g
        order = np.argsort(at[kept], kind="stable")
        spots.append((at[kept][order], r[kept][order]))
    step = 2048
    part = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(both), step):
        sides = []
        for (at, r), n in zip(spots, (len(a), len(b))):
            x, y = np.searchsorted(at, [low, low + step])
            side = np.zeros((n, step), np.float32)
            side[r[x:y], at[x:y] - low] = 1
            sides.append(side)
        part += sides[0] @ sides[1].T
    out[:, used] = part
    return out


def local_roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index connected to each index."""
    root = np.arange(count)
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    return root


def meetings(sets: DataFrame) -> DataFrame:
    """Who meets whom, from ``sets`` (key, copies, first_id, first_text, bands): a row for each text of a meeting (a
    candidate group, or a bucket and its band), its block there and the meeting's blocks. A text is sent ``blocks``
    times for each of its rows: at most as often as its group has blocks, or its buckets have."""
    postings = sets.select("key", F.posexplode("bands").alias("band", "hash"))
    buckets = postings.groupBy("band", "hash").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1")
    buckets = written(buckets)
    groups = components(postings.join(buckets, ["band", "hash"]).where("key <> hub").select("key", "hub"), "key", "hub")

    # What each way of dealing a group sends: all of it as often as it has blocks, or each bucket as often as that has.
    ways = groups.groupBy("root").agg(F.count("*").alias("members"))
    of_group = buckets.join(groups, F.col("hub") == F.col("node"))
    sent = of_group.groupBy("root").agg(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK)).alias("sent"))
    ways = ways.join(sent, "root").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    ways = written(ways.withColumn("by_bucket", F.col("sent") < F.col("members") * F.col("blocks")).drop("sent"))
    placed = joined_in_slices(groups, ways, ["root"], "members", F.xxhash64("node"), groups.count())
    placed = written(placed.select(F.col("node").alias("key"), "root", "blocks", "by_bucket"))
    in_blocks = placed.where("not by_bucket").select("key", F.col("root").alias("meeting"), F.lit(None).cast("int").alias("band"), "blocks")
    bucket = F.concat(F.unhex(F.hex("hash")), F.unhex(F.hex(F.col("band").cast("bigint"))))
    theirs = sets.join(placed.where("by_bucket").select("key"), "key").select("key", F.posexplode("bands").alias("band", "hash"))
    in_buckets = theirs.join(buckets, ["band", "hash"]).select(
        "key", bucket.alias("meeting"), "band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    )
    # Small meetings go to a task together, those of several blocks as one pair of blocks each.
    found = in_blocks.union(in_buckets).join(sets, "key").select("key", "meeting", "band", "blocks", "copies", "first_id", "first_text", "bands")
    return written(found.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))


def near_duplicates(
    docs: DataFrame, text: str = "text", size: int = 5, similarity: float = 0.8, recall: float = 0.999, text_key: bool = False
) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id and text; others are ignored): doc_id, class_id (the smallest doc_id
    of all texts connected by links) and links, the number of other rows with a Jaccard similarity of at least
    ``similarity`` on runs of ``size`` words (all words, if there are fewer). ``recall`` is the probability with
    which a pair just that similar is found; more similar pairs are found more surely. What is found is exact.

    Null texts and texts without a word have no links; their class is their own id. Repeated rows are linked to each
    other. Null ids are ids of their own kind: they never name a class that has another id. With ``text_key`` the
    rows carry xxhash64 of their text, which tells rows of one id apart, and the key of their class (null without a
    word), which tells classes apart whose smallest ids are the same repeated one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = choose_bands(similarity, recall)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketched = base.select("doc_id", F.xxhash64("text").alias("text_key"), sketch(F.col("text"), size, bands, rows).alias("s"))
    all_rows = written(sketched.select("doc_id", "text_key", F.col("s")["key"].alias("key"), F.col("s")["bands"].alias("bands")))
    kept = ["doc_id", "text_key"] if text_key else ["doc_id"]

    # A class per n-gram set. Rows of a set agree in their bands, so one row stands for all.
    sample = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "bands"))
    sets = written(
        all_rows.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), sample.alias("one"))
        .select("key", "copies", F.col("one")["doc_id"].alias("first_id"), F.col("one")["text_key"].alias("first_text"), F.col("one")["bands"].alias("bands"))
    )
    candidates = meetings(sets)
    units = max(1, math.ceil(candidates.count() / UNIT))
    texts = base.withColumn("text_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_text"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = (
        texts.join(candidates, same)
        .withColumn("other", F.explode(others))
        .select(
            F.when(F.col("blocks") == 1, F.concat(F.lit("u"), F.pmod(F.xxhash64("meeting"), F.lit(units))))
            .otherwise(F.concat(F.hex("meeting"), F.coalesce(F.col("band").cast("string"), F.lit("")), F.lit("-"), low, F.lit("-"), high)).alias("unit"),
            (F.col("block") == F.col("other")).alias("inner"), "block", "meeting", "band", "key", "copies", "bands", "text",
        )
    )

    def verified(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        seen, picked = set(), []
        for i, place in enumerate(zip(part["meeting"].to_pylist(), part["band"].to_pylist(), part["key"].to_pylist())):
            if place not in seen:  # repeated rows of one id and text came along
                seen.add(place)
                picked.append(i)
        part = part.take(pa.array(picked, pa.int64())).combine_chunks()
        band = part["band"].to_pylist()
        roots, keys = list(zip(part["meeting"].to_pylist(), [-1 if b is None else b for b in band])), part["key"].to_pylist()
        block, copies = part["block"].to_numpy(), part["copies"].to_numpy()
        inner = bool(part["inner"][0].as_py())
        signatures = part["bands"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        order = sorted(range(len(keys)), key=lambda i: (roots[i], keys[i]))
        out_key, out_links, out_root = [], [], []
        at = 0
        while at < len(order):
            end = at
            while end < len(order) and roots[order[end]] == roots[order[at]]:
                end += 1
            mine = np.array(order[at:end])
            at = end
            hashes, offsets = word_hashes(part["text"].take(pa.array(mine)).combine_chunks())
            grams = [shingles(hashes[a:b], size) for a, b in zip(offsets, offsets[1:])]
            index = np.arange(len(mine))
            if inner:
                a, b = linked_pairs(grams, signatures[mine], index, index, similarity, band[mine[0]])
            else:
                first = block[mine] == block[mine].min()
                a, b = linked_pairs(grams, signatures[mine], index[first], index[~first], similarity, band[mine[0]])
            if not len(a):
                continue
            links = np.bincount(a, copies[mine[b]], len(mine)) + np.bincount(b, copies[mine[a]], len(mine))
            top = local_roots(len(mine), a, b)
            for i in np.flatnonzero(links):
                out_key.append(keys[mine[i]])
                out_links.append(int(links[i]))
                out_root.append(keys[mine[top[i]]])
        return pa.table({"key": pa.array(out_key, pa.binary()), "links": pa.array(out_links, pa.int64()), "near": pa.array(out_root, pa.binary())})

    found = written(dealt.groupBy("unit").applyInArrow(verified, "key binary, links bigint, near binary"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(found, "key", "near")
    linked = classes.join(links, F.col("node") == F.col("key")).select("key", "root", "links")
    named = linked.join(sets.select("key", "first_id"), "key")
    named = written(named)
    names = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = named.join(names, "root").select(F.col("key").alias("linked_key"), "root", "class_id", F.col("links").alias("linked"))
    whole = (
        sets.join(named, F.col("key") == F.col("linked_key"), "left")
        .select(
            "key", F.coalesce("root", "key").alias("class_key"), F.coalesce("class_id", "first_id").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"),
        )
    )
    columns = [*kept, "class_id", "links", *(["class_key"] if text_key else [])]
    with_words = all_rows.where("key is not null").select("key", *kept).join(whole, "key").select(*columns)
    alone = {"class_id": F.col("doc_id"), "links": F.lit(0).cast("bigint"), "class_key": F.lit(None).cast("binary")}
    without = all_rows.where("key is null").withColumns(alone).select(*columns)
    return with_words.union(without)


def one_of_each(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each class, in all its columns: that with the smallest id, null last, then with the
    smallest text hash. Texts without a word stay, repeated rows once."""
    found = near_duplicates(docs, text, text_key=True, **options)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("one")
    of_class = found.where("class_key is not null").groupBy("class_key").agg(least)
    stays = of_class.select(F.col("one")["doc_id"].alias("near_id"), F.col("one")["text_key"].alias("near_text"))
    stays = stays.union(found.where("class_key is null").select("doc_id", "text_key"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("near_row")
    keyed = docs.select(row, F.col("doc_id").cast("bigint").alias("near_key"), F.xxhash64(F.col(text)).alias("near_hash"))
    same = F.col("near_key").eqNullSafe(F.col("near_id")) & (F.col("near_hash") == F.col("near_text"))
    left = keyed.join(stays, same, "left_semi").dropDuplicates(["near_key", "near_hash"])
    return left.select(*[F.col("near_row")[c].alias(c) for c in docs.columns])
