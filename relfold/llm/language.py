"""Language of a text by string kernels.

Two texts are compared by the byte n-grams (one to four bytes, lower case) that occur in both: the blended
spectrum kernel on presence, normalised to 1 for equal texts. A few landmark texts per language span a Nyström
approximation of that kernel, kernel ridge regression learns one function per language on it, and texts are
scored in blocks as (presence matrix x landmarks) x coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from relfold.llm.common import fraction, free_name, held_out, small_batches
from relfold.llm.words import text_bytes

#: n-grams are told apart by a hash into this many slots.
SLOTS = 1 << 15
WIDTHS = (1, 2, 3, 4)
#: Texts of one presence matrix, and bytes of a text looked at together.
BLOCK, SPAN = 128, 1 << 20

UNDETERMINED = "und"


def mark_ngrams(data: np.ndarray, row: np.ndarray) -> None:
    """Set the slots of all byte n-grams of one whole text in its row."""
    shift = np.uint32(32 - (SLOTS.bit_length() - 1))
    last = max(WIDTHS) - 1
    for low in range(0, len(data), SPAN):
        part = data[low : low + SPAN + last].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for width in range(1, max(WIDTHS) + 1):
            count = len(part) - width + 1
            if count <= 0:
                break
            code = code[:count] * np.uint32(257) + part[width - 1 :] + np.uint32(1)
            if width in WIDTHS:
                row[((code + np.uint32(width)) * np.uint32(2654435761)) >> shift] = 1


def presence(column: pa.Array) -> Iterator[np.ndarray]:
    """Presence matrices of a text column, at most BLOCK texts each. Case is lowered beforehand."""
    data, offsets = text_bytes(column)
    for low in range(0, len(column), BLOCK):
        rows = np.zeros((min(BLOCK, len(column) - low), SLOTS), np.uint8)
        for i in range(len(rows)):
            mark_ngrams(data[offsets[low + i] : offsets[low + i + 1]], rows[i])
        yield rows


def kernel(rows: np.ndarray, landmarks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Normalised kernel of presence rows with the landmarks; 0 for an empty text."""
    rows = rows.astype(np.float32)
    own = np.sqrt(np.maximum(rows.sum(axis=1), 1))
    return (rows @ landmarks.T) / (own[:, None] * lengths[None, :])


@dataclass(frozen=True)
class LanguageModel:
    """Sorted languages, packed presence of the landmarks, one column of coefficients per language with the
    intercept last, and the factor that turns margins into probabilities. Its size is bounded by the landmarks."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    coefficients: np.ndarray
    sharpness: float

    def unpacked(self) -> tuple[np.ndarray, np.ndarray]:
        rows = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return rows, np.sqrt(np.maximum(rows.sum(axis=1), 1))

    def probabilities(self, rows: np.ndarray, landmarks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        margins = kernel(rows, landmarks, lengths) @ self.coefficients[:-1] + self.coefficients[-1]
        return _softmax(margins * self.sharpness)


def _softmax(margins: np.ndarray) -> np.ndarray:
    grown = np.exp(margins - margins.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


def fit_arrays(packed: np.ndarray, names: np.ndarray, per_language: int = 24, ridge: float = 1e-3) -> LanguageModel:
    """Fit on packed presence rows and their languages; landmarks are each language's first rows, and every
    fourth other row calibrates the probabilities."""
    languages = tuple(sorted(set(names)))
    of = np.array([languages.index(n) for n in names])
    rank = np.zeros(len(of), int)
    for k in range(len(languages)):
        rank[of == k] = np.arange((of == k).sum())
    chosen = rank < per_language
    landmarks = packed[chosen]
    model = LanguageModel(languages, landmarks, np.zeros((len(landmarks) + 1, len(languages)), np.float32), 1.0)
    wide, lengths = model.unpacked()
    among = kernel(wide.astype(np.uint8), wide, lengths).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])  # Nyström features are kernel rows times this
    features = np.concatenate(
        [kernel(np.unpackbits(packed[i : i + BLOCK], axis=1), wide, lengths) for i in range(0, len(packed), BLOCK)]
    ).astype(np.float64) @ root
    checks = ~chosen & (rank % 4 == 3)
    x, y = features[~checks], np.where(of[~checks, None] == np.arange(len(languages)), 1.0, -1.0)
    # Every language weighs the same, however many texts it has.
    weight = 1.0 / np.bincount(of[~checks], minlength=len(languages))[of[~checks]]
    weight /= weight.sum()
    middle, mean = weight @ x, weight @ y
    centred = (x - middle) * weight[:, None]
    solved = np.linalg.solve(centred.T @ (x - middle) + ridge * np.eye(x.shape[1]) / len(languages) ** 2, centred.T @ (y - mean))
    coefficients = np.vstack([root @ solved, mean - middle @ solved]).astype(np.float32)
    sharpness = 1.0
    if checks.any():
        margins = features[checks] @ solved + (mean - middle @ solved)
        loss = lambda s: -np.log(_softmax(margins * s)[np.arange(checks.sum()), of[checks]] + 1e-12).mean()
        sharpness = float(min((0.5 * 1.5**k for k in range(14)), key=loss))
    return LanguageModel(languages, landmarks, coefficients, sharpness)


def fit_language(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300) -> LanguageModel | None:
    """Learn from rows that are not held out and whose language and text are not null; None if there are none.

    A repeatable draw by id of at most ``per_language`` texts of each language is looked at; the executors send
    their presence rows, 4 KB each, so the driver holds no texts. The number of languages is taken as small.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col("doc_id"), F.col(lang).alias("lang"), F.lower(text).alias("text"), fraction(F.col("doc_id"), F.lit("lang")).alias("draw")
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    rates = F.create_map(*[F.lit(v) for n, c in counts.items() for v in (n, min(1.0, 1.3 * per_language / c))])

    @F.arrow_udf("binary")
    def packed_presence(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array([row.tobytes() for rows in presence(column) for row in np.packbits(rows, axis=1)], pa.binary())

    drawn = rows.where(F.col("draw") < F.element_at(rates, F.col("lang"))).select("lang", "draw", "doc_id", packed_presence("text").alias("bits"))
    found = sorted(drawn.collect(), key=lambda r: (r["draw"], r["doc_id"], bytes(r["bits"])))
    kept, seen = [], dict.fromkeys(counts, 0)
    for r in found:
        if seen[r["lang"]] < per_language:
            seen[r["lang"]] += 1
            kept.append(r)
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in kept), np.uint8).reshape(len(kept), SLOTS // 8)
    return fit_arrays(packed, np.array([r["lang"] for r in kept], object))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict_language(text: Column, model: LanguageModel | None) -> Column:
    """A struct (lang_pred, score) of every whole text: ``und`` and 0 if it is null or has no letter (or nothing was
    learnt); else the likeliest language, the first by name among equals, and its probability."""
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return nothing

    @F.arrow_udf(kind)
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        landmarks, lengths = model.unpacked()
        names = np.array(model.languages, object)
        for column in texts:
            chances = [model.probabilities(rows, landmarks, lengths) for rows in presence(column)]
            chances = np.concatenate(chances) if chances else np.empty((0, len(names)))
            best = chances.argmax(axis=1)
            top = chances[np.arange(len(best)), best].astype(np.float64)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(top)], ["lang_pred", "score"])

    return F.when(has_letter(text), scored(F.lower(text))).otherwise(nothing)


def with_language(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> tuple[DataFrame, str, str]:
    """The rows with two added columns, and these columns' names (underscores avoid a clash)."""
    small_batches(docs.sparkSession)
    both, name, score = (free_name(docs, n) for n in ("lang_both", "lang_pred", "lang_score"))
    added = docs.withColumn(both, predict_language(F.col(text), model))
    return added.withColumns({name: F.col(both)["lang_pred"], score: F.col(both)["score"]}).drop(both), name, score
