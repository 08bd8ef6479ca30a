"""Mixing, encoding, shards, neighbours, the registered queries and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

import corpus_pipeline
from relfold.llm.common import shared_folder, written
from relfold.llm.curriculum import curriculum, due_time, mixed, source_targets
from relfold.llm.pieces import MARK, NEVER, UNIT, Decoder, Encoder, as_codes, border_states, combined, encoded, load_pieces, marked, round_trip
from relfold.llm.queries import ORACLE, QUERIES, VOCABULARY
from relfold.llm.shards import feistel, feistel_inverse, read_slots, training_shards, write_shards
from relfold.llm.vantage import Tree, nearest_neighbours
from tests.llm.test_texts import brute_lines, brute_near

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# Mixing ------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= repeats * sizes[s]}
        if not over:
            return {**target, **{s: left * weight[s] / total for s in open_}}
        for s in over:
            target[s] = repeats * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(["hot"] * 6 + ["b", "é", "z", None, "Z", ""]), 1) for i in range(600)]
    rows += [(1000, None, None, "b", None), (None, "a b c", "en", "b", 1), (3, rows[3][1], "en", rows[3][3], 1), (1001, "w " * 500, "en", "long", 1), (1002, "", "en", "nothing", 0)]
    return rows, spark.createDataFrame(rows, DOCS).withColumns({"mix_size": F.lit(1), "at": F.lit("x"), "copy": F.lit(2)})


def test_targets_stop_and_the_excess_is_reshared(sources):
    rows, df = sources
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    found = mixed(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], size(r[1])) for r in rows)
    of = defaultdict(set)
    for r in rows:
        of[r[0]].add(r[3])
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        source = next(iter(of[r["doc_id"]]))
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        assert r["taken"] % max(r["size"], 1) == 0 and 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for source, t in want.items():
        assert abs(taken[source] - t) <= largest[source] / 2 + 1e-6
    assert sorted(map(str, found)) == sorted(map(str, mixed(df.repartition(7)).collect()))


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 10)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in source_targets(sizes).collect()}
    assert got == brute_targets({"a": 10, "b": 100, "c": 10}) and got["a"] == 20.0
    all_full = {r["source"]: r["target"] for r in source_targets(sizes, share=9.0).collect()}
    assert all_full == {"a": 20.0, "b": 200.0, "c": 20.0}


def test_due_times_invert_the_demand(spark):
    df = spark.createDataFrame([(float(i), 10.0, s, 2 - s) for i in range(11) for s in (0.0, 0.5, 1.0, 1.5, 2.0)], "turn double, target double, s double, e double")
    for r in df.withColumn("t", due_time(F.col("turn"), F.col("target"), F.col("s"), F.col("e"))).collect():
        assert 0 <= r["t"] <= 1
        assert r["s"] * r["t"] + (r["e"] - r["s"]) / 2 * r["t"] ** 2 == pytest.approx(r["turn"] / r["target"])


def test_curriculum_order_and_copies(spark, sources):
    rows, df = sources
    out = curriculum(df, due="when").collect()
    assert out[0].asDict().keys() == {*df.columns, "when"}
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixed(df).where("size > 0 and doc_id is not null and doc_id <> 3").collect()}
    copies = Counter(r["doc_id"] for r in out)
    assert all(copies[i] == n for i, n in taken.items())
    times = [r["when"] for r in out]
    assert times == sorted(times)
    early = Counter(r["source"] for r in out[: len(out) // 4])
    late = Counter(r["source"] for r in out[-len(out) // 4 :])
    first = sorted({r[3] for r in rows} - {None})[0]  # the first source's weight falls
    assert early[first] >= late[first]
    assert curriculum(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0


def test_mixed_rows_come_from_the_training_order(spark, sources):
    rows, df = sources
    df = df.where("doc_id is not null and doc_id <> 3")
    found = mixed(df, positions="places").collect()
    order = curriculum(df, due="when").collect()
    places = {p: r["doc_id"] for r in found for p in r["places"]}
    assert sorted(places) == list(range(len(order))) and len(places) == sum(len(r["places"]) for r in found)
    assert [places[p] for p in range(len(order))] == [r["doc_id"] for r in order]
    assert all(r["taken"] == r["size"] * len(r["places"]) for r in found)
    firsts = [r["places"][0] if r["places"] else len(order) for r in found]
    assert firsts == sorted(firsts)  # the query's own rows are in that order, too
    assert [r["doc_id"] for r in mixed(df).collect() if r["taken"]] == [r["doc_id"] for r in found if r["taken"]]


def test_weights_are_integrals_of_the_ramps(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1000)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in source_targets(sizes, weights=(1,), share=0.5, ramps=((0.0, 1.0), (1.0, 2.0))).collect()}
    assert got == pytest.approx({"a": 250.0, "b": 750.0})
    df = spark.createDataFrame([(float(i),) for i in range(11)], "turn double")
    for r in df.withColumn("t", due_time(F.col("turn"), F.lit(10.0), F.lit(1.0), F.lit(2.0))).collect():
        assert r["t"] + r["t"] ** 2 / 2 == pytest.approx(1.5 * r["turn"] / 10)


# SentencePiece -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return load_pieces(VOCABULARY)


TEXTS = ["", "a", "  two  spaces   ", "tab\there\nnew\n\nline", "日本語 漢字 🎉", "x" * 400, " " * 40, "\x00\x01 <s> </s> <0x41>", "The quick brown fox, jumped over 12345 dogs."]


def total(vocabulary, ids):
    """Scores of ids; byte pieces count once for each character they spell."""
    out = 0
    data = b""
    for i in ids:
        p = vocabulary.pieces[i]
        if isinstance(p, bytes):
            data += p
        else:
            out += vocabulary.scores[i]
    return out + len(data.decode()) * vocabulary.unknown


def test_encoding_is_the_best_segmentation(vocabulary):
    """The library as a unigram model with the same pieces and scores finds no better one; it sums in floats."""
    proto = pb.ModelProto()
    proto.ParseFromString(open(VOCABULARY, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = vocabulary.scores[i] / UNIT
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = TEXTS + [r[0] for r in duckdb.sql(f"select text from '{SF_DIR}/documents.parquet'").fetchall()]
    encoder = Encoder(vocabulary)
    same = 0
    for text, mine in zip(texts, encoder.encode(texts)):
        theirs = library.encode(text)
        assert total(vocabulary, mine) >= total(vocabulary, theirs)
        same += list(mine) == theirs
    assert same > 0.9 * len(texts)


def test_decoding_gives_the_text_back(vocabulary):
    ids = Encoder(vocabulary).encode(TEXTS)
    flat, offsets = np.concatenate(ids), np.append(0, np.cumsum([len(i) for i in ids]))
    data, bounds = Decoder(vocabulary).decode(flat, offsets)
    assert [data[a:b].decode() for a, b in zip(bounds, bounds[1:])] == TEXTS
    assert Decoder(vocabulary).decode(np.array([-1, 99999, 1, 2]), np.array([0, 4]))[0] == b""


@pytest.mark.parametrize("chunk", [1, 3, 17, 100])
def test_chunks_score_like_the_whole(vocabulary, chunk):
    encoder = Encoder(vocabulary)
    for text in [*TEXTS[1:], "nospacesatall" * 9]:
        codes, _ = as_codes([marked(text)])
        codes = codes[:150]
        whole = encoder.encode_codes(codes, np.array([0]))
        parts = [(codes[a : a + chunk + encoder.longest - 1], min(chunk, len(codes) - a)) for a in range(0, len(codes), chunk)]
        matrices = [encoder.transfer(c, s) for c, s in parts]
        states = border_states(matrices)
        ids = np.concatenate([encoder.trace_chunk(c, s, states[i], states[i + 1]) for i, (c, s) in enumerate(parts)])
        assert total(vocabulary, ids) == total(vocabulary, whole[0]) == whole[2][0]
        left = matrices[0]
        for m in matrices[1:]:
            left = combined(left, m)
        assert left[0, 0] == whole[2][0]


def test_products_are_associative():
    rng = np.random.default_rng(2)
    a, b, c = (np.where(rng.random((5, 5)) < 0.3, NEVER, rng.integers(-99, 0, (5, 5))) for _ in range(3))
    assert (combined(combined(a, b), c) == combined(a, combined(b, c))).all()


def test_giant_and_odd_rows(spark, vocabulary):
    long = " ".join(random.Random(3).choices(["the", "thing", "undertaking", "é", "12"], k=3000))
    rows = [(1, "short"), (2, long), (2, long), (3, None), (4, ""), (None, "null id"), (5, f"a {MARK} b"), (6, "z" * 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit(1), "row": F.lit("x"), "digest": F.lit(0)})
    found = encoded(df, vocabulary, name="out", chunk=100)
    assert found.columns == [*df.columns, "out"] and found.count() == len(rows)
    for r in found.collect():
        assert (r["out"] is None) == (r["text"] is None)
        if r["text"]:
            assert total(vocabulary, r["out"]) == total(vocabulary, Encoder(vocabulary).encode([r["text"]])[0])
    assert all(r["restored"] for r in round_trip(df, vocabulary).collect())
    assert encoded(df.limit(0), vocabulary, name="out").count() == 0


# Shards ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("count", [1, 2, 3, 17, 1000, 4097])
def test_feistel_permutes(count):
    for key in (0, 7, 2**64 - 1):
        slots = feistel(np.arange(count), count, key)
        assert sorted(slots) == list(range(count))
        assert (feistel_inverse(slots, count, key) == np.arange(count)).all()


def test_shards_hold_the_stream_and_resume(spark, vocabulary, tmp_path):
    rows = [(1, "alpha beta"), (2, None), (3, ""), (4, "gamma " * 300), (4, "gamma " * 300), (None, "delta")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"slot": F.lit(1), "tokens": F.lit("x")})
    shards = written(training_shards(df, vocabulary, length=16, per_shard=8))
    found = shards.orderBy("shard").collect()
    count = sum(r["slots"] for r in found)
    assert [r["first_slot"] for r in found] == [8 * i for i in range(len(found))] and {r["stride"] for r in found} == {32}
    assert all(len(r["payload"]) == r["slots"] * 32 for r in found) and all(r["slots"] == 8 for r in found[:-1])
    flat = b"".join(bytes(r["payload"]) for r in found)
    order = feistel(np.arange(count), count, 2024)
    stream = np.frombuffer(b"".join(flat[s * 32 : s * 32 + 32] for s in order), "<u2")
    ends = np.flatnonzero(stream == 2)[: len(rows)]
    texts = Counter(tuple(x[:-1]) if len(x) else () for x in np.split(stream, ends + 1)[: len(rows)])
    assert texts == Counter(tuple(i) for i in Encoder(vocabulary).encode([t or "" for _, t in rows]))
    write_shards(shards, str(tmp_path / "shards"))
    rest = {r["slot"]: bytes(r["payload"]) for r in read_slots(spark, str(tmp_path / "shards"), 11, 21).collect()}
    assert rest == {s: flat[s * 32 : s * 32 + 32] for s in range(11, 21)}
    assert training_shards(df.limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError):
        training_shards(df, vocabulary, end=70000)


# Neighbours --------------------------------------------------------------------------------------------------


def brute_neighbours(ids, rows, queries, k):
    out = []
    for q in queries:
        scores = rows @ rows[ids.index(q)]
        best = sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("shard", [8192, 100])
def test_factor_one_is_exact(spark, shard, monkeypatch):
    monkeypatch.setattr("relfold.llm.vantage.SHARD", shard)
    rng = np.random.default_rng(4)
    rows = np.round(np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 150, 0)]), 2).astype(np.float32)
    data = [(i, r.tolist()) for i, r in enumerate(rows)]
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] + [1.0] * 7), (2080, [float("inf")] * 8), (2100, [1.0]), (None, [1.0] * 8), (0, rows[0].tolist()), (2120, [])]
    df = spark.createDataFrame(data + odd, "vec_id bigint, embedding array<float>").withColumns({"shard": F.lit(1), "id": F.lit("x"), "score": F.lit(0)})
    found = nearest_neighbours(df, df.where("vec_id % 20 = 0"), 20, 1.0)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    want = brute_neighbours(list(range(450)), rows.astype(np.float64), range(0, 450, 20), 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_recall_of_the_default_factor_and_small_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    found = nearest_neighbours(docs, docs.where("vec_id % 20 = 0"))
    rows = sorted((r["vec_id"], r["embedding"]) for r in docs.collect())
    ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    want = {w[:1] + w[2:3] for w in brute_neighbours(ids, vectors, [i for i in ids if i % 20 == 0], 20)}
    got = {(r["query_id"], r["vec_id"]) for r in found.collect()}
    assert len(want & got) >= 0.9 * len(want) and len(got) == len(want)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in nearest_neighbours(few, few).where("query_id = 0").collect()) == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert nearest_neighbours(few.limit(0), few.limit(0)).count() == 0 and nearest_neighbours(few, few.limit(0)).count() == 0


def test_larger_factors_prune_more():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 6)) * 5
    rows = np.repeat(centres, 50, 0) + rng.normal(size=(2000, 6)) * 0.1
    norm = float(np.sqrt((rows**2).sum(axis=1).max()))
    tree = Tree(np.arange(2000), rows, norm, 6)
    exact, _ = tree.search(np.full(50, -1), rows[:50], 5, 1.0)
    plain = np.lexsort((np.broadcast_to(np.arange(2000), (50, 2000)), -(rows[:50] @ rows.T)), axis=-1)[:, :5]
    assert (exact == plain).all()
    rough, _ = tree.search(np.full(50, -1), rows[:50], 5, 2.0)
    assert (rough == exact).mean() > 0.5


@pytest.mark.parametrize("largest, heavy", [(10, 5), (30, 5), (100, 5), (100, 600)])
def test_recall_does_not_depend_on_the_largest_norm(spark, largest, heavy):
    """Clustered unit vectors, some of them lengthened."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 64))
    rows = np.repeat(centres, 50, 0) + rng.normal(size=(3000, 64)) * 0.4
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    rows[rng.choice(3000, heavy, replace=False)] *= rng.uniform(0.5, 1, (heavy, 1)) * largest
    rows = rows.astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, embedding array<float>")
    found = nearest_neighbours(df, df.where("vec_id % 20 = 0"))
    want = {w[:1] + w[2:3] for w in brute_neighbours(list(range(3000)), rows.astype(np.float64), range(0, 3000, 20), 20)}
    got = {(r["query_id"], r["vec_id"]) for r in found.collect()}
    assert len(want & got) >= 0.9 * len(want) and len(got) == len(want)


# Registered queries and the pipeline --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "labels", "embeddings", "conversations"):
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    expected = sorted(repr(tuple(row[names.index(c)] for c in sorted(names))) for row in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_covers_its_table(spark, duck, name):
    df = written(QUERIES[name](spark, SF_DIR))
    ids = {r[0] for r in duck.execute("select doc_id from documents").fetchall()}
    if name == "op6_token_shards":
        assert df.agg(F.sum("slots")).first()[0] > 0
    elif name == "op10_neighbours":
        queries = duck.execute("select count(*) from embeddings where vec_id % 20 = 0").fetchone()[0]
        assert df.count() == 20 * queries
    elif name == "op11_whitening":
        assert df.count() == 16 * duck.execute("select count(*) from embeddings").fetchone()[0]
    else:
        assert sorted(r["doc_id"] for r in df.select("doc_id").collect()) == sorted(ids)


def test_numbers_of_the_queries():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, vocabulary):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "", "en", None, 0), (10**6 + 2, "123 ---", None, "src0", 7)], DOCS)
    docs = docs.unionByName(extra)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = written(stage(spark, before, SF_DIR))
        assert after.columns == docs.columns or k == len(corpus_pipeline.STAGES) - 1
        if name == "language":
            assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == {10**6, 10**6 + 1, 10**6 + 2}
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if name == "lines":
            want = sorted((i, t) for i, t, dropped in brute_lines(rows, passage_docs=3) if t or not dropped)
            assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == want
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["text"] != texts[r["doc_id"]])
        if name == "near":
            assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c, _ in brute_near(rows)})
        if name == "mixing":
            copies = Counter(r["doc_id"] for r in after.collect())
            assert copies == Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixed(before).collect() if r["taken"]})
        if name == "pieces":
            found = after.collect()
            best = Encoder(vocabulary).encode([r["text"] for r in found])
            assert len(found) == len(rows) and all(total(vocabulary, r["ids"]) == total(vocabulary, ids) for r, ids in zip(found, best))
        before = after
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_drops_passages_of_two_documents(spark):
    words = lambda name, n: " ".join(f"{name}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    passage, short = words("p", 50), words("s", 49)
    rows = [(i, "\n".join([words(f"own{c}", 120), passage, short]), "en", "s", 1) for i, c in enumerate("xy")]
    docs = spark.createDataFrame(rows, DOCS)
    left = {r["doc_id"]: r for r in corpus_pipeline.join_near(spark, corpus_pipeline.drop_lines(spark, docs, SF_DIR), SF_DIR).collect()}
    assert left[0]["text"] == rows[0][1] and left[1]["text"] == "\n".join([words("owny", 120), short])
    assert left[1]["n_chars"] == len(left[1]["text"])


def test_pipeline_runs_whole_and_on_nothing(spark, tmp_path):
    folder = tmp_path / "data"
    spark.createDataFrame([], DOCS).write.parquet(str(folder / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(folder))
    assert found.count() == 0 and set(found.columns) > {"doc_id", "text"}


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_giant_texts_are_encoded_span_by_span(monkeypatch):
    from relfold.llm import pieces

    vocabulary = load_pieces(VOCABULARY)
    encoder, rng = Encoder(vocabulary), random.Random(4)
    for text in ("word " * 300, "x" * 700, "".join(rng.choice("ab cdé漢 ") for _ in range(900)), "a"):
        whole = encoder.encode([text])[0]
        monkeypatch.setattr(pieces, "SPAN", 50)
        assert np.array_equal(np.concatenate(list(encoder.spans(text))), whole)
        monkeypatch.undo()


def test_a_long_text_gives_its_tokens_to_many_shards(spark):
    """The work grows with the text's length: no sequence carries the whole text along."""
    rng = random.Random(6)
    text = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "x1"]) for _ in range(400_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    shards = training_shards(docs, load_pieces(VOCABULARY), length=64, per_shard=256)
    found = shards.collect()
    assert sum(r["slots"] for r in found) > 6000
    plan = shards._jdf.queryExecution().optimizedPlan().toString()
    evaluated = next(line for line in plan.splitlines() if "ArrowEvalPython" in line)
    below = plan.split(evaluated)[1].splitlines()[1]
    assert "tokens" not in below.split("Generate")[-1].split("],")[-1] if "Generate" in below else "tokens" not in below


def test_documents_without_a_language_to_learn_from_stay(spark):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["Plain words.", "Andere Worte.", None, "12 34", ""])]
    kept = corpus_pipeline.identify(spark, spark.createDataFrame(rows, DOCS), SF_DIR)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1]


def test_the_training_order_reaches_the_result(spark):
    rows = [(i, f"text number {i} " + "word " * (i % 7), "en", "abc"[i % 3], 1) for i in range(300)]
    mixed_docs = curriculum(spark.createDataFrame(rows, DOCS).repartition(3))
    order = [r["doc_id"] for r in mixed_docs.collect()]
    stored_docs = written(mixed_docs)
    result = corpus_pipeline.encode(spark, stored_docs, SF_DIR)
    assert [r["doc_id"] for r in result.orderBy("place").collect()] == order
    assert result.select("place").distinct().count() == len(order)
    assert result.columns == [*DOCS.replace(" bigint", "").replace(" string", "").split(", "), "place", "ids"]


def test_remembered_segments_give_the_same_ids(monkeypatch):
    from relfold.llm import pieces

    monkeypatch.setattr(pieces, "ROOM", 400)
    monkeypatch.setattr(pieces, "REMEMBERED", 4)  # few places, so that segments take each other's
    vocabulary, rng = load_pieces(VOCABULARY), random.Random(8)
    words = ["".join(rng.choice("abcdeé漢\U0001f600 ") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    used = Encoder(vocabulary)
    for _ in range(40):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(3)] + ["x" * 100]
        fresh = Encoder(vocabulary)
        for mine, theirs in zip(used.encode(texts), fresh.encode(texts)):
            assert np.array_equal(mine, theirs)
        codes, begins = as_codes([marked(t) for t in texts])
        assert np.array_equal(used.encode_codes(codes, begins)[2], Encoder(vocabulary).encode_codes(codes, begins)[2])


@pytest.mark.parametrize("together", [1, 3, 1000])
def test_runs_of_chunks_are_combined_associatively(spark, vocabulary, together):
    from relfold.llm.pieces import encode_giant

    rng = random.Random(together)
    texts = ["".join(rng.choice(["abc", "d", "é", "漢", " ", "  "]) for _ in range(rng.randint(20, 400))) for _ in range(12)] + ["x" * 333, "word " * 80, "y" * 64, "z" * 63]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "row string, text string").repartition(3)
    found = {int(r["row"]): r["ids"] for r in encode_giant(df, vocabulary, chunk=32, together=together).collect()}
    best = Encoder(vocabulary).encode(texts)
    assert len(found) == len(texts)
    assert all(total(vocabulary, found[i]) == total(vocabulary, best[i]) for i in found)
    decoder = Decoder(vocabulary)
    for i, t in enumerate(texts):
        ids = np.array(found[i], np.int64)
        assert decoder.decode(ids, np.array([0, len(ids)]))[0].decode() == t
