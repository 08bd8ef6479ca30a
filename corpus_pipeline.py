"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next one.

Null, empty and repeated rows are defined by the operators; every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relfold.llm.common import free_name, in_written_order, written
from relfold.llm.curriculum import curriculum
from relfold.llm.language import UNDETERMINED, fit_language, has_letter, with_language
from relfold.llm.near import one_of_each
from relfold.llm.pieces import encoded, load_pieces
from relfold.llm.queries import VOCABULARY
from relfold.llm.templates import without_repeated_lines


#: Tokens of a line that counts as a passage.
PASSAGE = 50


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter, and null ones, are rejected. Where no document
    tells a language to learn from, all others stay."""
    model = fit_language(docs)
    if model is None:
        return docs.where(has_letter(F.col("text")))
    found, name, _ = with_language(docs, model)
    return found.where(F.col(name) != UNDETERMINED).select(*[f"`{c}`" for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, passage_docs: int = 3, **options) -> DataFrame:
    """Documents without the lines of recurring templates; n_chars follows. Those with nothing left go. A passage in two
    documents stays here: near duplicates, which share most of their lines, are told by them in the next stage."""
    options["passage_docs"] = passage_docs
    dropped = free_name(docs, "dropped")
    left = without_repeated_lines(docs, count=dropped, **options)
    left = left.where((F.col(dropped) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")))
    return left.select(*[f"`{c}`" for c in docs.columns])


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates. Of what is left, a line of PASSAGE
    tokens or more that stands in two documents goes from all but the first; before, it might go from the one kept."""
    return drop_lines(spark, written(one_of_each(docs), compression="zstd"), sf_dir, passage_docs=2, least_tokens=PASSAGE, templates=False)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    return curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces. ``place`` rises with the training order: that in which the mix wrote
    them, file after file and row after row; copies of a document have places of their own. Documents that were never
    written have no order to keep. Sorting by it would move every text and its ids once more, so it is left to
    whoever writes them out."""
    placed = in_written_order(docs, free_name(docs, "place"))
    return encoded(placed, load_pieces(VOCABULARY), name=free_name(docs, "ids"))


STAGES = [("language", identify), ("lines", drop_lines), ("near", join_near), ("mixing", mix), ("pieces", encode)]

#: Models, MinHash and segmentation have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
