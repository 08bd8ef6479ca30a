"""Classifiers, exact and near duplicates, repeated lines: edge cases and brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relfold.llm.components import components
from relfold.llm.exact_dedup import _runs, exact_duplicates
from relfold.llm.language import fit_arrays, fit_language, predict_language, presence, with_language
from relfold.llm.near import band_hashes, choose_bands, linked_pairs, near_duplicates, one_of_each
from relfold.llm.quality import calibrate, dictionary, fit_quality, with_quality
from relfold.llm.templates import without_repeated_lines
from relfold.llm.toxicity import FILTERS, SPAN, WIDTHS, ToxicityModel, best_threshold, fit_toxicity, train, with_toxicity
from relfold.llm.words import shingles, word_hashes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def grams_of(text, size=5):
    w = words_of(text)
    size = min(size, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else frozenset()


def test_words_and_shingles_follow_the_plain_definition():
    texts = ["Hello, World! hello", "", None, "a", "Çà ÉTÉ été 12x", "x" * 70, "a-b " * 3]
    hashes, offsets = word_hashes(pa.array(texts))
    seen = {}
    for i, text in enumerate(texts):
        mine = hashes[offsets[i] : offsets[i + 1]]
        assert len(mine) == len(words_of(text))
        for h, w in zip(mine, words_of(text)):
            assert seen.setdefault(w, h) == h
        assert len(shingles(mine, 5)) == len(grams_of(text))
    assert len(set(seen.values())) == len(seen)


def test_words_do_not_depend_on_where_a_long_text_is_cut(monkeypatch):
    texts = ["one two three " * 9, "y" * 50 + " z", ""]
    whole, offsets = word_hashes(pa.array(texts))
    monkeypatch.setattr("relfold.llm.words.SPAN", 16)
    again, cut = word_hashes(pa.array(texts))
    assert (whole == again).all() and (offsets == cut).all()


# Exact duplicates ------------------------------------------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 7])
def test_exact_duplicates_match_brute_force(spark, ranges):
    random.seed(1)
    texts = ["a  b", "a b", "a\tb\n", "", None, " ", "b" * 5000, "é", "a b"]
    rows = [(i, random.choice(texts)) for i in range(300)] + [(400 + i, "hot copy") for i in range(200)] + [(7, "a b"), (None, "a b"), (None, "only null")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"key": F.lit(1), "norm": F.lit("x"), "sha": F.lit(None).cast("string")})
    found = exact_duplicates(df.repartition(5), ranges)
    assert sorted((tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == brute_exact(rows)


def test_exact_duplicates_of_nothing(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_runs_with_colliding_sort_keys_are_told_apart_and_marked():
    rows = [("k", "a", 1), ("k", "a", 2), ("k", "b", 3), ("l", "c", 4), ("l", "c", 5), ("m", "d", 6), ("n", "e", 7), ("n", "f", 8)]
    columns = {"doc_id": [r[2] for r in rows], "norm": [r[1] for r in rows], "key": [r[0] for r in rows], "sha": [r[1] for r in rows]}
    for step in (1, 2, 3, 8):
        batches = pa.table(columns).to_batches(max_chunksize=step)
        out = pa.Table.from_batches(list(_runs(iter(batches)))).to_pylist()
        got = {r["row"]: (r["min_id"], r["members"], r["border"]) for r in out}
        assert got == {1: (1, 2, True), 2: (1, 2, True), 3: (3, 1, True), 4: (4, 2, False), 5: (4, 2, False), 6: (6, 1, False), 7: (7, 1, True), 8: (8, 1, True)}
        assert {r["head"] for r in out if r["head"]} == {"a", "b", "e", "f"}


# Languages ---------------------------------------------------------------------------------------------------


def invented(rng, syllables, words):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))


LANGUAGES = {"aa": ["ba", "be", "lo", "mi"], "zz": ["krz", "ü", "ost", "chv"]}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(2)
    rows = []
    for i in range(160):
        lang = rng.choice(sorted(LANGUAGES))
        rows.append((i, invented(rng, LANGUAGES[lang], rng.choice([5, 40, 3000 if i % 50 == 0 else 80])), lang, "s", 1))
    rows += [(900, None, "aa", None, None), (901, "", "zz", "s", 0), (902, "12 34 ...", "aa", "s", 9), (903, rows[0][1], None, "s", 1), (None, rows[0][1], "aa", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_languages_are_told_apart(spark, spoken):
    model = fit_language(spoken, per_language=60)
    assert model.languages == ("aa", "zz")
    found, name, score = with_language(spoken.withColumn("lang_pred", F.lit("taken")), model)
    assert (name, score) == ("_lang_pred", "lang_score") and found.count() == 165
    for r in found.collect():
        if r["doc_id"] in (900, 901, 902):
            assert (r[name], r[score]) == ("und", 0.0)
        elif r["lang"]:
            assert r[name] == r["lang"] and 0 < r[score] <= 1


def test_held_out_languages_are_not_learnt(spark, spoken):
    out = spark.createDataFrame([(i,) for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0], "doc_id bigint")
    odd = spoken.join(out, "doc_id").withColumn("lang", F.lit("odd"))
    assert fit_language(odd) is None
    none = predict_language(F.col("text"), None)
    assert {tuple(r["p"]) for r in odd.select(none.alias("p")).collect()} == {("und", 0.0)}
    assert fit_language(spoken.limit(0)) is None


def test_presence_of_ngrams_does_not_depend_on_cuts(monkeypatch):
    text = pa.array(["the quick brown fox " * 20, "", "é"])
    whole = np.concatenate(list(presence(text)))
    monkeypatch.setattr("relfold.llm.language.SPAN", 7)
    assert (np.concatenate(list(presence(text))) == whole).all()
    assert whole[1].sum() == 0


def test_one_language_only_is_always_predicted():
    packed = np.packbits(np.concatenate(list(presence(pa.array(["abc abd", "abc xyz"])))), axis=1)
    assert fit_arrays(packed, np.array(["aa", "aa"], object)).languages == ("aa",)


# Toxicity and quality ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(700):
        lang = rng.choice(sorted(LANGUAGES))
        words = invented(rng, LANGUAGES[lang], rng.choice([8, 30, 120])).split()
        bad = i % 4 == 0
        if bad:
            for w in rng.sample(["vilebad", "nastyish", "curseword"], 2):
                words.insert(rng.randrange(len(words) + 1), w)
        poor = i % 3 == 0
        text = " ".join(words)
        docs.append((i, " ".join([words[0]] * 60) if poor else text, lang, "s", 1))
        labels.append((i, 0 if poor else 1, int(bad and not poor)))
    docs += [(9000, None, None, None, None), (9001, "", "aa", "s", 0), (9002, "ba lo " * 70000 + "vilebad nastyish", "aa", "s", 1), (9003, "ba lo " * 70000, "aa", "s", 1), (5, docs[5][1], "aa", "s", 1)]
    labels += [(5, 1, 0), (None, 1, 1), (6, None, None), (99999, 1, 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def accuracy(found, labels, label):
    truth = {r["doc_id"]: r[label] for r in labels.where(F.col(label).isNotNull()).collect()}
    held = [r for r in found if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    return np.mean([(r["score"] >= 0.5) == (truth[r["doc_id"]] == 1) for r in held]), len(held)


def test_toxic_words_are_found_in_held_out_and_giant_texts(marked):
    docs, labels = marked
    model = fit_toxicity(docs, labels, per_class=400)
    assert set(model.languages) == {"aa", "zz"} and len(model.thresholds) == 2
    found = with_toxicity(docs.withColumn("label", F.lit(1)), model).collect()
    right, n = accuracy(found, labels, "toxic")
    assert right > 0.95 and n > 100
    by_id = {r["doc_id"]: r["score"] for r in found}
    assert by_id[9002] >= 0.5 > by_id[9003] and by_id[9000] == by_id[9001] < 0.5
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == docs.count()
    assert len(set(r["score"] for r in found if r["doc_id"] == 5)) == 1


def test_toxicity_without_both_classes(marked):
    docs, labels = marked
    assert fit_toxicity(docs, labels.where("toxic = 0")) is None
    assert fit_toxicity(docs, labels.limit(0)) is None and fit_toxicity(docs.limit(0), labels) is None
    assert {r["score"] for r in with_toxicity(docs, None).collect()} == {0.0}


def test_pooling_parts_of_a_giant_text_is_the_same(monkeypatch):
    rng = np.random.default_rng(0)
    filters = [rng.normal(size=(w, 12, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = ToxicityModel(np.empty(0, np.int32), rng.normal(size=(40, 12)).astype(np.float32), filters, np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS) + 1, np.float32))
    model.embeddings[0] = 0
    rows = rng.integers(1, 40, 500).astype(np.int32)
    offsets = np.array([0, 3, 3, 4, 404, 500])
    whole = model.pooled(rows, offsets)
    monkeypatch.setattr("relfold.llm.toxicity.SPAN", 17)
    assert np.allclose(model.pooled(rows, offsets), whole, atol=1e-5) and SPAN > 17


def test_toxicity_counts_and_learns_from_every_labelled_row(spark):
    """Each toxic text has one of 375 words that 16 texts share; a draw of 1,200 texts a class holds most of them too rarely."""
    rng = random.Random(5)
    plain = [f"plain{k}" for k in range(40)]
    rows = [(i, " ".join([*rng.choices(plain, k=6), f"mark{i // 2 % 375}" if i % 2 else "other", *rng.choices(plain, k=5)]), "en") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12_000)], "doc_id bigint, toxic int")
    model = fit_toxicity(docs, labels)
    hashes, _ = word_hashes(pa.array([f"mark{k}" for k in range(375)]))
    assert (model.rows(hashes) > 1).mean() > 0.9
    found = {r["doc_id"]: r["score"] >= 0.5 for r in with_toxicity(docs, model).collect()}
    held = [i for i in found if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(found[i] == (i % 2 == 1) for i in held) > 0.9 * len(held)


def test_training_and_thresholds():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 2**63, 30).astype(np.uint64) for _ in range(80)]
    special = np.uint64(12345 << 45)
    y = np.arange(80) % 2
    for t, c in zip(texts, y):
        if c:
            t[7] = special
    model = train(texts, y.astype(float), rounds=8)
    offsets = np.arange(81) * 30
    scores = model.score(model.pooled(model.rows(np.concatenate(texts)), offsets))
    assert scores[y == 1].min() > scores[y == 0].max()
    assert 0.2 < best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1]), np.ones(4)) < 0.8


def test_quality_of_held_out_texts(marked):
    docs, labels = marked
    model = fit_quality(docs, labels, per_class=300, size=1 << 14)
    found = with_quality(docs, model).collect()
    right, n = accuracy(found, labels, "quality")
    assert right > 0.95 and n > 100 and all(0 <= r["score"] <= 1 for r in found)
    by_id = {r["doc_id"]: r["score"] for r in found}
    assert by_id[9000] == by_id[9001]
    assert fit_quality(docs, labels.where("quality = 1")) is None
    assert {r["score"] for r in with_quality(docs, None).collect()} == {0.5}


def test_calibration_rises_and_dictionaries_are_bounded():
    knots, shares = calibrate(np.array([0.1, 0.1, 0.3, 0.2, 0.5]), np.array([0, 1, 0, 1, 1]), np.ones(5))
    assert (np.diff(knots) > 0).all() and (np.diff(shares) >= 0).all() and shares.min() > 0 and shares.max() < 1
    assert len(dictionary([b"x" * 9000, b"y" * 10], 1000)) == 1000 and dictionary([], 10) == b""


def test_dictionaries_learn_from_every_part_of_a_text():
    """Texts with one long opening for all; a mark tells where in its text a piece lay."""
    texts = [b"same opening " * 150 + b"".join(b"<%d:%d>" % (k, at) for at in range(400)) + b"." * (k % 7) for k in range(800)]
    for size in (1 << 18, 1 << 14):
        found = dictionary(texts, size)
        marks = [(int(k), int(at)) for k, at in re.findall(rb"<(\d+):(\d+)>", found)]
        assert len(found) <= size and len(found) > 0.9 * size and {at // 40 for _, at in marks} >= set(range(10))
        assert found.count(b"same opening") * 13 < 0.5 * len(found)
        assert len({k for k, _ in marks}) > 0.4 * min(len(texts), size // 32)
    assert dictionary(texts[:3], 1 << 18) == b"".join(texts[:3])


# N-gram join -------------------------------------------------------------------------------------------------


def brute_near(rows, similarity=0.8):
    sets = [grams_of(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and common >= similarity * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[max(top(i), top(j))] = min(top(i), top(j))
    names = defaultdict(list)
    for i in range(len(rows)):
        names[top(i)].append(rows[i][0])
    least = {k: min((v for v in ids if v is not None), default=None) for k, ids in names.items()}
    return sorted(((rows[i][0], least[top(i)], links[i]) for i in range(len(rows))), key=str)


@pytest.fixture(scope="module")
def similar():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = rng.choices(vocabulary, k=rng.choice([60, 150, 400]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    hot = rng.choices(vocabulary, k=200)
    for i in range(60):
        copy = list(hot)
        copy[i] = f"new{i}"
        rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, "..."), (503, "two words"), (504, "Two, WORDS!"), (None, "two words"), (3, rows[3][1]), (505, " ".join(vocabulary * 50))]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_match_brute_force(spark, similar, block, monkeypatch):
    monkeypatch.setattr("relfold.llm.near.BLOCK", block)
    df = spark.createDataFrame(similar, "doc_id bigint, text string").withColumns({"key": F.lit(1), "root": F.lit("x"), "bands": F.lit(None).cast("int")})
    found = near_duplicates(df.repartition(3))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_near(similar)


def test_one_of_each_keeps_one_and_all_columns(spark, similar):
    df = spark.createDataFrame(similar, "doc_id bigint, text string").withColumns({"near_row": F.lit(1), "links": F.lit(2)})
    kept = one_of_each(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c, _ in brute_near(similar)})
    assert set(kept[0].asDict()) == {"doc_id", "text", "near_row", "links"}
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    twice = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (1, one), (4, ""), (4, ""), (4, "..")]
    left = one_of_each(spark.createDataFrame(twice, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, left)) == sorted([(1, one), (1, two), (4, ""), (4, "..")])
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_bands_reach_the_recall_and_pairs_are_verified():
    bands, rows = choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 100
    rng = np.random.default_rng(5)
    grams = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in [120] * 150]
    signatures = np.zeros((150, 2), np.int64)  # all share a band: every pair is a candidate
    index = np.arange(150)
    for similarity in (0.2, 0.25):
        a, b = linked_pairs(grams, signatures, index, index, similarity)
        want = {(i, j) for i, j in combinations(range(150), 2) if len(np.intersect1d(grams[i], grams[j])) >= similarity * len(np.union1d(grams[i], grams[j]))}
        assert set(zip(a.tolist(), b.tolist())) == want and want
    assert (band_hashes(grams[0], 4, 3) == band_hashes(grams[0].copy(), 4, 3)).all()


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Line templates ----------------------------------------------------------------------------------------------


def brute_lines(rows, leading=3, min_tokens=4, min_docs=3, min_share=0.2, min_constant=0.6, passage=50, passage_docs=2, least_tokens=1, templates=True):
    def tokens(line):
        return [t for t in re.split(r"[\x20\x09-\x0D]+", line) if t]

    def mask(t):
        return "<*>" if re.search("[0-9@]", t) else t

    docs = sorted({((i is not None, i or 0), t) for i, t in rows if t is not None})
    places = defaultdict(lambda: defaultdict(set))  # line -> document -> positions
    for d, text in enumerate(docs):
        for pos, line in enumerate(text[1].split("\n")):
            t = tuple(tokens(line))
            if len(t) >= least_tokens:
                places[t][d].add(pos)
    groups = []  # lines that recur together, with the documents that hold them
    for t, ds in places.items():
        if len(ds) >= (passage_docs if len(t) >= passage else min_docs) or len(ds) >= min_docs:
            groups.append(([t], set(ds)))
    clusters = defaultdict(list)
    for t in places:
        if templates and len(t) >= min_tokens:
            masks = tuple(map(mask, t))
            for k in range(3):
                part = tuple(m for i, m in enumerate(masks) if i * 3 // len(t) == k)
                clusters[len(t), masks[:leading], k, part].append(t)
    for members in clusters.values():
        total = sum(len(places[t]) for t in members)
        votes = defaultdict(int)
        for t in members:
            for at, token in enumerate(map(mask, t)):
                votes[at, token] += len(places[t])
        good = {k for k, v in votes.items() if v >= min_share * total and v >= min_docs and k[1] != "<*>"}
        found = defaultdict(list)
        for t in members:
            held = tuple(m if (at, m) in good else "<*>" for at, m in enumerate(map(mask, t)))
            if len(members) > 1 and len(places[t]) < min_docs and sum(h != "<*>" for h in held) >= min_constant * len(held):
                found[held].append(t)
        for ts in found.values():
            holders = set().union(*(places[t] for t in ts))
            if len(holders) >= min_docs:
                groups.append((ts, holders))
    gone = defaultdict(set)
    for ts, holders in groups:
        for t in ts:
            for d in set(places[t]) - {min(holders)}:
                gone[d] |= places[t][d]
    result = {}
    for d, (key, text) in enumerate(docs):
        left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[d])
        result[key, text] = ((left if left.strip(" \t\n\v\f\r") else "") if gone[d] else text, len(gone[d]))
    return sorted(((i, *(result[(i is not None, i or 0), t] if t is not None else (None, 0))) for i, t in rows), key=str)


def lines_left(spark, rows, **options):
    found = without_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), count="n", **options)
    got = sorted(((r["doc_id"], r["text"], r["n"]) for r in found.collect()), key=str)
    assert got == brute_lines(rows, **options)
    return {i: (t, n) for i, t, n in got}


@pytest.mark.parametrize("notices", [1, 6, 60])
def test_a_leaf_holds_any_number_of_templates(spark, notices):
    """Notices of twelve tokens with one word field each, all in one leaf with as much prose."""
    rng = random.Random(notices)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rest = [[word() for _ in range(8)] for _ in range(notices)]
    rows, doc = [], 0
    for body in rest:
        for _ in range(10):
            field = [*body]
            rows.append((doc, " ".join(["please", "note", "that", *field[:3], word(), *field[3:]])))
            rows.append((doc + 1, " ".join(["please", "note", "that", *(word() for _ in range(9))])))
            doc += 2
    found = lines_left(spark, rows)
    assert sum(n for _, n in found.values()) == 9 * notices
    assert all(found[i][1] == 0 for i in range(1, doc, 2))


def test_fields_of_several_words_and_places(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(i, f"Please note that dear {word()} {word()} your parcel with the number {i} has left the depot in the town of {word()}") for i in range(30)]
    assert sum(n for _, n in lines_left(spark, rows).values()) == 29


def test_short_and_unspaced_lines_count_as_they_are(spark):
    rows = [(i, f"Of.\n漢字の行です\nonly here {i}x") for i in range(3)] + [(9, "twice.\nOf."), (10, "twice.")]
    found = lines_left(spark, rows)
    assert [found[i][1] for i in (0, 1, 2, 9, 10)] == [0, 2, 2, 1, 0]
    assert all(n == 0 for _, n in lines_left(spark, rows, least_tokens=5).values())


def test_passages_in_two_documents(spark):
    passage = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(51))
    rows = [(1, f"first\n{passage}"), (2, f"second\n{passage}\nlast"), (3, passage.rsplit(" ", 2)[0]), (4, passage.rsplit(" ", 2)[0])]
    found = lines_left(spark, rows)
    assert found[1][1] == 0 and found[2] == ("second\nlast", 1) and found[3][1] == found[4][1] == 0
    assert all(n == 0 for _, n in lines_left(spark, rows, passage_docs=3).values())


def test_hot_lines_and_clusters_are_sliced(spark, monkeypatch):
    """A line and a template that most documents hold are dealt in slices, with the same result."""
    monkeypatch.setattr("relfold.llm.common.SLICE", 1)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, f"All rights reserved here.\nplease note that the shop is closed by {word()} until next monday morning\n{word()} {word()} {word()} {word()} {word()}") for i in range(60)]
    assert sum(n for _, n in lines_left(spark, rows).values()) == 2 * 59


def test_the_counts_name_must_be_free(spark):
    with pytest.raises(ValueError, match="already"):
        without_repeated_lines(spark.createDataFrame([(1, "a", 2)], "doc_id bigint, text string, N int"), count="n")


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choices([f"p{chr(97 + k)}{chr(97 + m)}" for k in range(26) for m in range(9)], k=rng.randint(3, 12)))
    rows = []
    for i in range(40):
        lines = [prose() for _ in range(rng.randint(1, 5))]
        if i % 2:
            lines.insert(rng.randrange(len(lines) + 1), "Released under the MIT License.")
        if i % 3 == 0:
            lines.insert(0, f"Posted on 2020-01-{i:02d} by {rng.choice(['ann', 'bob', 'kim'])}{chr(97 + i % 26)} in section news of the day")
        if i % 5 == 0:
            lines += [f"Value number {i * 7 + k} was measured at the station" for k in range(3)]
        rows.append((i, "\n".join(lines)))
    rows += [(50, rows[1][1]), (51, rows[1][1]), (52, rows[1][1]), (60, None), (61, ""), (62, "\n\n"), (63, "long " * 20000), (64, "one doc only 1 x\none doc only 2 x\none doc only 3 x"), (None, "Released under the MIT License."), (1, rows[1][1]), (1, "another text with id one\nReleased under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"drops": F.lit(1), "row": F.lit("r"), "doc": F.lit(2.0)})
    found = without_repeated_lines(df.repartition(3), count="n")
    assert found.columns == ["doc_id", "text", "drops", "row", "doc", "n"]
    got = sorted(((r["doc_id"], r["text"], r["n"]) for r in found.collect()), key=str)
    assert got == brute_lines(rows)
    assert sum(n for _, _, n in got) > 40


def test_repeated_lines_of_nothing(spark):
    assert without_repeated_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_labelled_texts_of_any_length_are_learnt_from(spark):
    """Good texts of 340,000 characters, bad ones short."""
    rng = random.Random(3)
    good, bad = ["river meadow lantern harvest quiet morning"] , ["click buy cheap pills winner casino"]
    rows = [(i, " ".join(rng.choice((good if i % 2 else bad)[0].split()) for _ in range(48_000 if i % 2 else 300)), "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(8)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(100)], "doc_id bigint, quality int, toxic int")
    model = fit_quality(docs, labels)
    assert model is not None and len(model.good) > 200_000 and len(model.bad) > 30_000
    scores = {r["doc_id"]: r["score"] for r in with_quality(docs, model).collect()}
    assert min(scores[i] for i in range(1, 100, 2)) > max(scores[i] for i in range(0, 100, 2))
    toxic = {r["doc_id"]: r["score"] for r in with_toxicity(docs, fit_toxicity(docs, labels)).collect()}
    assert all((toxic[i] >= 0.5) == (i % 2 == 0) for i in range(100))


def test_added_columns_find_a_free_name(spark):
    docs = spark.createDataFrame([(1, "a text", 7)], "doc_id bigint, text string, score int")
    assert with_quality(docs, None).columns == with_toxicity(docs, None).columns == ["doc_id", "text", "score", "_score"]
    assert with_quality(docs, None).first()["score"] == 7
    assert with_quality(docs.limit(0), None).count() == with_toxicity(docs.limit(0), None).count() == 0
