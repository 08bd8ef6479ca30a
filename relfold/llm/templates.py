"""Lines that repeat across documents, found with a tree of log templates.

A line recurs as it is if enough documents hold it. Lines that differ in variable fields are led down a tree of fixed
depth: first by their number of tokens, then by the leading ones, a token with a digit or an @ counting as variable. A
leaf may hold any number of templates and much else, so its lines are clustered: each line is cut into three parts, and
lines of a leaf that agree in a whole part form a cluster. A template with fields in two parts at most thus has a
cluster that its lines share. Within a cluster a token is constant at its position if enough of the cluster's documents
have it there, else it is a field; constants and fields make a line's template. Templates that recur in several
documents are dropped from all but the first of them. How full a leaf is makes no difference.

Every step is a grouping or a join on line, cluster or template, so a cluster of any size is spread out. Lines are first
counted as they are; only clusters that several documents share are looked at token by token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from relfold.llm.common import joined_in_slices, small_batches, written

#: Stands for a variable field in a template.
FIELD = "<*>"
_WORD = (1 << 64) - 1
#: Parts of a line that clusters agree in.
PARTS = 3


def tokens_of(line: Column) -> Column:
    """The runs of a line without ASCII white space. Splitting at one plain character needs no pattern matching."""
    return F.array_remove(F.split(F.translate(line, "\t\n\v\f\r", "     "), " "), "")


def masked(token: Column) -> Column:
    """A token, or a field if it holds a digit or an @."""
    return F.when(F.translate(token, "0123456789@", "") != token, FIELD).otherwise(token)


#: Lines that leave a task together.
LINES = 1 << 16
_VARIABLE = re.compile(rb"[0-9@]")


def numbered_lines(keyed: DataFrame, leading: int, least_tokens: int, min_tokens: int, clusters: bool) -> DataFrame:
    """(doc, pos, size, line, leaf and, with ``clusters``, those of the lines that the tree takes). Line and leaf
    together name a line. Texts are cut as bytes, whose white space is ASCII's."""
    small_batches(keyed.sparkSession)
    schema = f"doc {keyed.schema['doc'].dataType.simpleString()}, pos int, size int, line bigint, leaf bigint, clusters array<bigint>"
    hashed, field = xxhash.xxh64_intdigest, FIELD.encode()

    def found(doc: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        of, pos, size, line, leaf, parts = zip(*rows)
        signed = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (line, leaf)]
        sizes = [PARTS if p else 0 for p in parts]
        flat = np.array([c for p in parts if p for c in p], np.uint64).view(np.int64)
        offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        shared = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()), mask=pa.array([not p for p in parts]))
        columns = [doc.take(pa.array(of, pa.int32())), pa.array(pos, pa.int32()), pa.array(size, pa.int32()), *signed, shared]
        return pa.record_batch(columns, names=["doc", "pos", "size", "line", "leaf", "clusters"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rows = batch.column(0), []
            for k, text in enumerate(batch.column(1).cast(pa.large_binary())):
                for pos, line in enumerate((text.as_py() or b"").split(b"\n")):
                    tokens = line.split()
                    size = len(tokens)
                    if size < least_tokens:
                        continue
                    plain = b" ".join(tokens)
                    if _VARIABLE.search(plain):
                        tokens = [field if _VARIABLE.search(t) else t for t in tokens]
                    leaf = hashed(b" ".join(tokens[:leading]), size)
                    parts = None
                    if clusters and size >= min_tokens:  # token i belongs to part i * PARTS // size
                        ends = [-(-size * p // PARTS) for p in range(PARTS + 1)]
                        parts = [hashed(b" ".join(tokens[low:high]), leaf + p & _WORD) for p, (low, high) in enumerate(zip(ends, ends[1:]))]
                    rows.append((k, pos, size, hashed(plain), leaf, parts))
                    if len(rows) == LINES:
                        yield found(doc, rows)
                        rows = []
            if rows:
                yield found(doc, rows)

    lines = keyed.select("doc", "text").mapInArrow(numbered, schema)
    return lines if clusters else lines.drop("clusters")


def lines_at(text: Column, positions: Column) -> Column:
    """The lines of a text at some positions, as an array in their order."""

    @F.arrow_udf("array<string>")
    def picked(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, wanted in columns:
            out = []
            for text, places in zip(texts, wanted):  # a text at a time
                lines = text.as_py().split("\n")
                out.append(pa.array([lines[k] for k in places.as_py()], pa.string()))
            offsets = pa.array(np.append(0, np.cumsum([len(o) for o in out])), pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.concat_arrays(out) if out else pa.array([], pa.string()))

    return picked(text, positions)


def _templates(keyed: DataFrame, counted: DataFrame, min_docs: int, min_share: float, min_constant: float) -> DataFrame:
    """(leaf, line, template) of the lines that do not recur as they are, in the clusters where a template could."""
    small_batches(keyed.sparkSession)
    voters = counted.where("clusters is not null").select("leaf", "line", "docs", "first", "pos", F.explode("clusters").alias("cluster"))
    shared = voters.groupBy("cluster").agg(F.sum("docs").alias("cluster_docs"), F.count("*").alias("kinds"), F.min("docs").alias("fewest"))
    shared = shared.where((F.col("cluster_docs") >= min_docs) & (F.col("kinds") > 1) & (F.col("fewest") < min_docs)).select("cluster", "cluster_docs", "kinds")
    total = PARTS * counted.count()
    spots = joined_in_slices(voters, written(shared), ["cluster"], "kinds", F.col("line"), total)
    # The content of each line comes from its first document, at its first place there.
    spots = spots.groupBy("first", "pos", "leaf", "line", "docs").agg(F.collect_list(F.struct("cluster", "cluster_docs", "kinds")).alias("clusters"))
    by_doc = spots.groupBy("first").agg(F.collect_list(F.struct("pos", "leaf", "line", "docs", "clusters")).alias("spots"))
    fetched = keyed.join(by_doc, F.col("doc") == F.col("first")).select("spots", lines_at(F.col("text"), F.col("spots.pos")).alias("lines"))
    fetched = fetched.select(F.inline(F.arrays_zip(F.col("spots").alias("s"), F.col("lines").alias("content"))))
    content = fetched.select("s.leaf", "s.line", "s.docs", F.explode("s.clusters").alias("c"), F.transform(tokens_of(F.col("content")), masked).alias("tokens"))
    content = written(content.select("c.cluster", "c.cluster_docs", "c.kinds", "leaf", "line", "docs", "tokens"))
    votes = content.select("cluster", "cluster_docs", "kinds", "docs", F.posexplode("tokens").alias("at", "token"))
    votes = votes.groupBy("cluster", "at", "token").agg(F.sum("docs").alias("votes"), F.first("cluster_docs").alias("cluster_docs"), F.first("kinds").alias("kinds"))
    constant = (F.col("votes") >= min_share * F.col("cluster_docs")) & (F.col("votes") >= min_docs) & (F.col("token") != FIELD)
    # At most 1 / min_share tokens are constant at a position; every position has its set, so that they lie in order.
    places = votes.groupBy("cluster", "at").agg(F.collect_set(F.when(constant, F.col("token"))).alias("tokens"), F.first("kinds").alias("kinds"))
    places = places.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "tokens")))["tokens"].alias("constants"), F.first("kinds").alias("kinds"))
    places = written(places.where(F.exists("constants", lambda t: F.size(t) > 0)))
    held = F.transform("tokens", lambda t, i: F.when(F.array_contains(F.get("constants", i), t), t).otherwise(FIELD))
    placed = joined_in_slices(content.where(F.col("docs") < min_docs).drop("kinds"), places, ["cluster"], "kinds", F.col("line"), total)
    templates = placed.select("cluster", "leaf", "line", held.alias("template"))
    templates = templates.where(F.size(F.filter("template", lambda t: t != FIELD)) >= min_constant * F.size("template"))
    return templates.select("leaf", "line", F.xxhash64("cluster", F.array_join("template", " ")).alias("template"))


def dropped_lines(
    keyed: DataFrame,
    leading: int = 3,
    min_tokens: int = 4,
    min_docs: int = 3,
    min_share: float = 0.2,
    min_constant: float = 0.6,
    passage: int = 50,
    passage_docs: int = 2,
    least_tokens: int = 1,
    templates: bool = True,
) -> DataFrame:
    """(doc, drops): for each document the positions of lines to drop, from ``keyed`` (columns doc, an orderable key
    without nulls, and text).

    A line of any length recurs as it is if it stands in at least ``min_docs`` documents, or in ``passage_docs`` if it
    has ``passage`` tokens or more; lines of fewer than ``least_tokens`` tokens are left alone. Lines of ``min_tokens``
    tokens and more also recur as one of their templates (unless ``templates`` is off): in at least ``min_docs``
    documents, with a share of ``min_constant`` constants, each of which at least ``min_share`` of a cluster's line
    counts and ``min_docs`` have at its position. The least document of a line or template keeps it.
    """
    lines = numbered_lines(keyed, leading, least_tokens, min_tokens, templates)
    thin = written(lines)
    per_doc = thin.groupBy("leaf", "line", "doc").agg(F.min("pos").alias("pos"), *[F.first(c).alias(c) for c in ("size", *(["clusters"] if templates else []))])
    held = F.struct("doc", "pos")
    counted = per_doc.groupBy("leaf", "line").agg(
        F.count("*").alias("docs"), F.min(held).alias("least"), F.max("doc").alias("last"),
        *[F.first(c).alias(c) for c in ("size", *(["clusters"] if templates else []))],
    )
    counted = written(counted.select("*", F.col("least.doc").alias("first"), F.col("least.pos").alias("pos")).drop("least"))
    recurs = (F.col("docs") >= min_docs) | ((F.col("size") >= passage) & (F.col("docs") >= passage_docs))
    repeated = counted.where(recurs).select("leaf", "line", "first", "docs")
    if templates:
        found = written(_templates(keyed, counted, min_docs, min_share, min_constant))
        # Templates count documents, not lines: a list within one document is no repetition across documents. A line in
        # two documents has a first and a last one; only with a higher threshold are there others.
        if min_docs <= 3:
            members = found.join(counted.select("leaf", "line", "first", "last"), ["leaf", "line"])
            members = members.select("template", F.explode(F.array_distinct(F.array("first", "last"))).alias("doc"))
        else:
            members = found.join(thin.select("leaf", "line", "doc"), ["leaf", "line"]).select("template", "doc")
        recurring = members.distinct().groupBy("template").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where(F.col("n") >= min_docs)
        repeated = repeated.union(found.join(recurring, "template").select("leaf", "line", "first", F.lit(1).cast("bigint")))
    # A line may recur in several ways; it stays only where it comes first in all of them.
    repeated = written(repeated.groupBy("leaf", "line").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.max("docs").alias("docs")))
    gone = joined_in_slices(thin.select("leaf", "line", "doc", "pos"), repeated, ["leaf", "line"], "docs", F.xxhash64("doc"), thin.count())
    gone = gone.where((F.col("doc") != F.col("low")) | (F.col("doc") != F.col("high")))
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def without_repeated_lines(docs: DataFrame, text: str = "text", count: str | None = None, **options) -> DataFrame:
    """The rows of ``docs`` without the lines that recur in other documents; all columns stay, and ``count`` names an
    added column with the number of dropped lines (its name must be free).

    The first document of a recurring template, by doc_id and then by a hash of its text, keeps its lines; rows
    equal in both are the same document. A null id comes first. Null texts stay null; blank lines stay, but if lines
    were dropped and no token is left, the text is empty. Long texts are read whole, an empty table gives an empty one.
    """
    if count and count.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {count!r} already")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Joined and windowed by one struct without nulls.
    number = F.col("doc_id").cast("bigint")
    key = F.struct(number.isNotNull().alias("known"), F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64(F.col(text)).alias("hash"))
    keyed = docs.select(key.alias("doc"), F.col(text).alias("text"))
    drops = dropped_lines(keyed, **options)
    left = docs.select(row, key.alias("doc")).join(drops, "doc", "left")
    whole = F.col("row")[text]
    lines = F.filter(F.split(whole, "\n"), lambda line, i: ~F.array_contains("drops", i))
    kept = F.array_join(lines, "\n")
    kept = F.when(F.col("drops").isNull(), whole).when(kept.rlike(r"[^\x20\x09-\x0D]"), kept).otherwise(F.lit(""))
    columns = [kept.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    extra = [F.coalesce(F.size("drops"), F.lit(0)).alias(count)] if count else []
    return left.select(*columns, *extra)

