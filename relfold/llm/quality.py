"""Quality of a text by compression: how much better a dictionary of good texts packs it than one of bad texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from relfold.llm.common import free_name, labelled_sample, small_batches
from relfold.llm.words import text_bytes

#: Bytes compressed at a time, so that a long text is judged by the dictionary throughout, not by its own start.
PIECE = 512
LEVEL = 9


def compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in (good, bad):
        content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_dict_id=False))
    return out


def size_difference(column: pa.Array, packers: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """(size under bad - size under good) / own size for each whole text, pieces added up; 0 for an empty one."""
    data, offsets = text_bytes(column)
    data = data.tobytes()
    good, bad = packers
    out = np.zeros(len(column))
    for i, (low, high) in enumerate(zip(offsets, offsets[1:])):
        low, high = int(low), int(high)
        sizes = [0, 0]
        for at in range(low, high, PIECE):
            piece = data[at : min(at + PIECE, high)]
            sizes[0] += len(good.compress(piece))
            sizes[1] += len(bad.compress(piece))
        if high > low:
            out[i] = (sizes[1] - sizes[0]) / (high - low)
    return out


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration: knots of the difference and the share of good texts at them."""

    good: bytes
    bad: bytes
    knots: np.ndarray
    shares: np.ndarray

    def score(self, differences: np.ndarray) -> np.ndarray:
        return np.interp(differences, self.knots, self.shares)


def calibrate(differences: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve from difference to share of good texts: pooled adjacent violators over weighted rows,
    with one row's weight of the overall share added at either end."""
    order = np.argsort(differences, kind="stable")
    x, y, w = differences[order], labels[order].astype(float), weights[order].astype(float)
    mean = float((y * w).sum() / w.sum())
    pools: list[list[float]] = []  # weight, weighted label, weighted difference
    for a, b, c in zip(x, y, w):
        pools.append([c, c * b, c * a])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    pools = np.array(pools)
    least = w.min()
    knots, shares = pools[:, 2] / pools[:, 0], (pools[:, 1] + least * mean) / (pools[:, 0] + least)
    return knots, np.maximum.accumulate(np.clip(shares, 0.001, 0.999))


#: Bytes of a text's pieces in a dictionary, and its shortest where a dictionary has room for little of each text.
STEP, LEAST_STEP = 256, 32


def share_of(lengths: np.ndarray, size: int) -> int:
    """Bytes that each text may give to a dictionary of ``size`` bytes: as many as it has if all fit, else an equal
    share (short texts leave theirs to the others), at least LEAST_STEP."""
    if lengths.sum() <= size:
        return int(lengths.max(initial=0))
    # The share at which the texts fill the dictionary: those shorter than it are a prefix in order of length.
    ordered = np.sort(lengths)
    before = np.cumsum(ordered) - ordered
    levels = (size - before) // np.arange(len(ordered), 0, -1)
    return max(LEAST_STEP, int(levels[np.argmax(levels < ordered)]))


def dictionary(texts: list[bytes], size: int) -> bytes:
    """Raw dictionary content of at most ``size`` bytes: all of the texts if they fit, else an equal share of every
    text, in pieces drawn from its whole length."""
    share = share_of(np.array([len(t) for t in texts], np.int64), size)
    return joined([spread(t, share) for t in texts], size)


def joined(pieces: list[bytes], size: int) -> bytes:
    """What the texts give, laid end to end; with more texts than least shares, an evenly spaced part of them."""
    if sum(map(len, pieces)) <= size:
        return b"".join(pieces)
    return b"".join(pieces[i * len(pieces) * LEAST_STEP // size][:LEAST_STEP] for i in range(size // LEAST_STEP))


def spread(text: bytes, share: int) -> bytes:
    """``share`` bytes of a text in its order: the text is cut in equal sections, and each gives one piece from a
    place that a digest of the text and the section's number draws."""
    if len(text) <= share:
        return text
    pieces = max(1, -(-share // STEP))
    digest = hashlib.blake2b(text).digest()
    bounds = [len(text) * k // pieces for k in range(pieces + 1)]
    out = bytearray()
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        size = share * (k + 1) // pieces - share * k // pieces
        drawn = int.from_bytes(hashlib.blake2b(k.to_bytes(8, "big"), key=digest, digest_size=8).digest(), "big")
        at = low + drawn % (max(high - low - size, 0) + 1)
        out += text[at : at + size]
    return bytes(out)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1200, size: int = 1 << 18) -> QualityModel | None:
    """Learn from at most about ``per_class`` labelled rows of either class that are not held out (a repeatable
    draw); None unless both classes occur. Two thirds fill dictionaries of ``size`` bytes, the others calibrate."""
    rows = labelled_sample(docs, labels, label, per_class)
    texts = rows.where("part < 0.66 and text is not null")
    # The driver learns the texts' lengths, and then holds no more of them than the dictionaries do.
    lengths = texts.select("label", F.octet_length("text").alias("size")).collect()
    shares = {c: share_of(np.array([r["size"] for r in lengths if r["label"] == c], np.int64), size) for c in (1, 0)}

    @F.arrow_udf("binary")
    def pieces(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, label_ in columns:
            pairs = zip(column.to_pylist(), label_.to_pylist())
            yield pa.array([spread(t.encode(), shares[c]) for t, c in pairs], pa.binary())

    kept = texts.select("label", "part", "doc_id", pieces("text", "label").alias("piece")).collect()
    kept.sort(key=lambda r: (r["part"], r["doc_id"], bytes(r["piece"])))
    parts = [joined([bytes(r["piece"]) for r in kept if r["label"] == c], size) for c in (1, 0)]
    if not all(parts):
        return None
    checks = rows.where("part >= 0.66").select("label", "weight", "doc_id", difference(F.col("text"), *parts).alias("d")).collect()
    checks.sort(key=lambda r: (r["d"], r["doc_id"]))
    if not checks:
        return QualityModel(*parts, np.array([-0.1, 0.1]), np.array([0.0, 1.0]))
    d, y, w = (np.array([r[c] for r in checks], float) for c in ("d", "label", "weight"))
    return QualityModel(*parts, *calibrate(d, y, w))


def difference(text: Column, good: bytes, bad: bytes) -> Column:
    @F.arrow_udf("double")
    def measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packers = compressors(good, bad)
        for column in texts:
            yield pa.array(size_difference(column, packers))

    return measured(text)


def quality_score(text: Column, model: QualityModel | None) -> Column:
    """A number from 0 to 1 for every whole text, higher for good ones; null and empty texts are scored at a
    difference of 0. 0.5 if nothing was learnt."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packers = compressors(model.good, model.bad)
        for column in texts:
            yield pa.array(model.score(size_difference(column, packers)))

    return scored(text)


def with_quality(docs: DataFrame, model: QualityModel | None, name: str = "score", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the quality of their whole text added as ``name``, with underscores in front until no
    column is called so. Null, empty and repeated texts are scored like others; an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, name), quality_score(F.col(f"`{text}`"), model))
