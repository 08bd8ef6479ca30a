"""The trained scorers against plain loops over their definitions: convolution and pooling, kernels and the ridge
solution, compressed sizes and the calibration."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from relfold.llm.language import SLOTS, WIDTHS as NGRAMS, fit_arrays, fit_language, predict_language
from relfold.llm.quality import LEVEL, PIECE, calibrate, fit_quality, with_quality
from relfold.llm.queries import QUERIES
from relfold.llm.toxicity import FILTERS, SLOT_BITS, WIDTHS, fit_toxicity, with_toxicity
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
EDGES = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " . "), (10**6 + 3, "Ünïted 漢字 words 12"), (10**6 + 4, "one"), (10**6 + 5, "again and again " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame(EDGES, "doc_id bigint, text string")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang").unionByName(extra, allowMissingColumns=True).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def some(docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    return {i: t for i, t in rows.items() if i % 9 == 0 or i >= 10**6}


def word_slot(word):
    mask, total = (1 << 64) - 1, 0
    for k, byte in enumerate(word.encode()):
        total = (total + (byte + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64)) & mask
    total = ((total ^ (total >> 32)) * 0xD6E8FEB86659FD93) & mask
    return (total ^ (total >> 29)) >> (64 - SLOT_BITS)


def test_toxicity_is_convolution_and_pooling_word_by_word(docs, labels):
    model = fit_toxicity(docs, labels)
    place = {int(slot): k + 2 for k, slot in enumerate(model.slots)}
    scores = {r["doc_id"]: r["score"] for r in with_toxicity(docs, model).collect()}
    for doc, text in some(docs).items():
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())[:60_000]
        rows = [0, 0, *(place.get(word_slot(w), 1) for w in words), 0, 0]
        vectors = model.embeddings[rows].astype(np.float64)
        features = []
        for width, bank in zip(WIDTHS, model.filters):
            n = len(rows) - width + 1
            for f in range(FILTERS):
                if n < 500:
                    features.append(max(sum(float(vectors[at + k] @ bank[k, :, f]) for k in range(width)) for at in range(n)))
                else:
                    features.append(max(sum(vectors[k : k + n] @ bank[k, :, f] for k in range(width))))
        features = np.maximum(np.array(features) + model.bias, 0)
        margin = features @ model.head[:-1] + model.head[-1]
        chances = np.exp(features @ model.language_head[:-1] + model.language_head[-1])
        margin -= chances / chances.sum() @ model.thresholds
        assert scores[doc] == pytest.approx(1 / (1 + math.exp(-min(max(model.slope * margin, -40), 40))), abs=3e-3)


def slots_of_text(text):
    data, found = text.lower().encode(), set()
    for width in NGRAMS:
        for at in range(len(data) - width + 1):
            code = 0
            for byte in data[at : at + width]:
                code = (code * 257 + byte + 1) & 0xFFFFFFFF
            found.add((((code + width) * 2654435761) & 0xFFFFFFFF) >> (32 - (SLOTS.bit_length() - 1)))
    return found


def test_language_is_a_kernel_machine_over_ngrams(docs):
    model = fit_language(docs)
    found = {r["doc_id"]: r["p"] for r in docs.select("doc_id", predict_language(F.col("text"), model).alias("p")).collect()}
    landmarks = [set(np.flatnonzero(row)) for row in np.unpackbits(model.landmarks, axis=1)]
    for doc, text in some(docs).items():
        if not text or not any(c.isalpha() for c in text):
            assert tuple(found[doc]) == ("und", 0.0)
            continue
        own = slots_of_text(text)
        row = [len(own & other) / math.sqrt(len(own) * max(len(other), 1)) for other in landmarks]
        margins = [sum(k * float(c) for k, c in zip(row, column)) + float(column[-1]) for column in model.coefficients.T]
        chances = np.exp(np.array(margins) * model.sharpness)
        chances /= chances.sum()
        best = int(chances.argmax())
        assert found[doc]["score"] == pytest.approx(chances[best], abs=2e-3)
        if np.sort(chances)[-2] < chances[best] - 4e-3:
            assert found[doc]["lang_pred"] == model.languages[best]


def test_ridge_solution_by_its_equations():
    rng = np.random.default_rng(5)
    names = np.array(["aa", "bb", "cc"], object)[rng.integers(0, 3, 150)]
    rows = (rng.random((150, SLOTS)) < 0.01 + 0.02 * (np.arange(SLOTS)[None, :] % 3 == np.array(["aa bb cc".split().index(n) for n in names])[:, None])).astype(np.uint8)
    model = fit_arrays(np.packbits(rows, axis=1), names, per_language=10, ridge=1e-2)
    rank = np.zeros(150, int)
    for name in set(names):
        rank[names == name] = np.arange((names == name).sum())
    chosen = rank < 10
    marks = rows[chosen].astype(float)
    norms = np.sqrt(rows.sum(axis=1, dtype=float))
    gram = marks @ marks.T / np.outer(norms[chosen], norms[chosen])
    values, vectors = np.linalg.eigh(gram)
    kept = values > 1e-6 * values.max()
    features = rows @ marks.T / np.outer(norms, norms[chosen]) @ vectors[:, kept] / np.sqrt(values[kept])
    used = ~(~chosen & (rank % 4 == 3))
    weight = np.array([1 / (names[used] == n).sum() for n in names[used]])
    weight /= weight.sum()
    y = np.where(names[used][:, None] == np.array(sorted(set(names)))[None, :], 1.0, -1.0)
    # Weighted least squares with the penalty as further rows, the intercept free.
    size = features.shape[1]
    left = np.vstack([np.sqrt(weight)[:, None] * np.hstack([features[used], np.ones((used.sum(), 1))]), np.hstack([np.eye(size) * math.sqrt(1e-2 / 9), np.zeros((size, 1))])])
    right = np.vstack([np.sqrt(weight)[:, None] * y, np.zeros((size, 3))])
    solved = np.linalg.lstsq(left, right, rcond=None)[0]
    wide, lengths = model.unpacked()
    kernel = rows.astype(np.float32) @ wide.T / (np.sqrt(rows.sum(axis=1))[:, None] * lengths[None, :])
    assert np.allclose(kernel @ model.coefficients[:-1] + model.coefficients[-1], features @ solved[:-1] + solved[-1], atol=2e-3)


def plain_calibration(x, y, w):
    """The rising fit by its max-min formula, equal values being one pool."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    n = len(x)
    mean = lambda j, k: (y[j : k + 1] * w[j : k + 1]).sum() / w[j : k + 1].sum()
    fit = np.array([max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)])
    pools = [np.flatnonzero(np.isclose(fit, v)) for v in np.unique(np.round(fit, 12))]
    overall, least = (y * w).sum() / w.sum(), w.min()
    knots = np.array([(x[p] * w[p]).sum() / w[p].sum() for p in pools])
    shares = np.array([((y[p] * w[p]).sum() + least * overall) / (w[p].sum() + least) for p in pools])
    return knots, np.maximum.accumulate(np.clip(shares, 0.001, 0.999))


def test_calibration_is_the_rising_fit():
    rng = np.random.default_rng(6)
    for n in (1, 2, 9, 40):
        x = rng.normal(size=n)
        y, w = (rng.random(n) < 1 / (1 + np.exp(-2 * x))).astype(float), rng.choice([1.0, 2.5], n)
        for mine, theirs in zip(calibrate(x, y, w), plain_calibration(x, y, w)):
            assert np.allclose(mine, theirs)


def test_quality_is_compressed_sizes_piece_by_piece(docs, labels):
    model = fit_quality(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in with_quality(docs, model).collect()}

    def size(piece, content):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        return len(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_dict_id=False).compress(piece))

    for doc, text in some(docs).items():
        data = (text or "").encode()
        if len(data) > 20_000:
            continue
        pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
        difference = sum(size(p, model.bad) - size(p, model.good) for p in pieces) / max(len(data), 1)
        knots, shares = list(model.knots), list(model.shares)
        if difference <= knots[0]:
            expected = shares[0]
        elif difference >= knots[-1]:
            expected = shares[-1]
        else:
            k = next(i for i, v in enumerate(knots) if v > difference)
            part = (difference - knots[k - 1]) / (knots[k] - knots[k - 1])
            expected = shares[k - 1] + part * (shares[k] - shares[k - 1])
        assert scores[doc] == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("name,truth,least", [("op1_toxicity", "toxic", 0.9), ("op7_quality", "quality", 0.8)])
def test_held_out_rows_are_told_apart(spark, name, truth, least):
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r[truth] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r[truth] is not None}
    rows = [r for r in QUERIES[name](spark, sf).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    checked = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in checked) >= least * len(checked)
