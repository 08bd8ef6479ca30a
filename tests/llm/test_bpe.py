"""Byte-pair encoding against the public library and against merges done one by one."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relfold.llm import bpe
from relfold.llm.bpe import Decoder, Encoder, decode_column, encoded, load_byte_pairs, round_trip
from relfold.llm.queries import BYTE_PAIRS, QUERIES

SF_DIR = "/root/testdata/sf0.001"
PIECES = [
    "a", "e", "the", " the", " ", "  ", "\n", "\r\n", "'", "'s", "'ll", "'l", "!", "...", "1", "23", "é", "ß", "漢字", "՘", "Ᲊ", "࢏",
    "\U0001f600", "<|endoftext|>", "<|endoftext", "\t", "-----", " ", "\x1c", "aaaa", "\x00", " ", "²", "\U0003fc36",
]


@pytest.fixture(scope="module")
def vocabulary():
    return load_byte_pairs(BYTE_PAIRS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_PAIRS)


def merged(vocabulary, data):
    """Merges in their order, the leftmost first, until none applies."""
    ranks = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(vocabulary.merges)}
    single = {t: i for i, t in enumerate(vocabulary.tokens) if t is not None and len(t) == 1}
    ids = [single[bytes([b])] for b in data]
    while True:
        best = min((ranks[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in ranks) if any(p in ranks for p in zip(ids, ids[1:])) else None
        if best is None:
            return ids
        k = best[1]
        ids[k : k + 2] = [ranks[ids[k], ids[k + 1]][1]]


def test_random_texts_are_encoded_and_decoded_as_by_the_library(vocabulary, library):
    encoder, decoder, rng = Encoder(vocabulary), Decoder(vocabulary), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 20)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode_text(text).tolist() == ids
        assert decoder.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)
        loose = [rng.randrange(50300) for _ in range(10)]  # bytes that are no characters, ids that are none
        assert decoder.decode(np.array(loose)).decode() == library.decode(loose, skip_special_tokens=False)


def test_every_character_falls_into_the_librarys_word(vocabulary, library):
    encoder = Encoder(vocabulary)
    codes = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} x" for c in codes[at : at + 4096])
        cut = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert [w for words in encoder.words(text) for w in words] == cut


def test_words_are_merged_as_one_by_one(vocabulary):
    encoder, rng = Encoder(vocabulary), random.Random(7)
    for _ in range(300):
        data = bytes(rng.choice(b"abcdest -=\xc3\xa9\xff" if rng.random() < 0.9 else range(256)) for _ in range(rng.randint(0, 60)))
        assert encoder.backtrack(data) == merged(vocabulary, data)


def test_every_token_is_what_its_own_bytes_become(vocabulary):
    encoder = Encoder(vocabulary)
    for i in range(0, 50256, 7):
        assert encoder.backtrack(vocabulary.tokens[i]) == [i]


def test_windows_and_blocks_do_not_show(vocabulary, library, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(PIECES) for _ in range(400)) for _ in range(20)] + ["ab" * 500, " " * 333, "x'll" * 200]
    monkeypatch.setattr(bpe, "WINDOW", 13)
    monkeypatch.setattr(bpe, "BLOCK", 32)
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode_text(text).tolist() == ids
        assert decoder.decode(np.array(ids, np.int64)).decode() == text


def test_a_long_word_takes_linear_work(vocabulary):
    rng = random.Random(11)
    word = "".join(rng.choice("abcdefgh") for _ in range(400_000)).encode()
    encoder = Encoder(vocabulary)
    ids = encoder.backtrack(word)
    assert b"".join(vocabulary.tokens[i] for i in ids) == word
    assert all(encoder.compatible(a, b) for a, b in zip(ids, ids[1:]))


def test_rows_of_any_kind(spark, vocabulary):
    rows = [(1, None, "x"), (2, "", "y"), (None, " the\u0000 end", "z"), (4, "a b", "w"), (4, "a b", "w"), (5, "word " * 60_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encoded(docs, vocabulary)
    assert got.columns == ["doc_id", "text", "ids", "_ids"] and got.count() == len(rows)
    back = got.withColumn("back", decode_column(F.col("_ids"), vocabulary)).collect()
    assert all(r["back"] == r["text"] and (r["_ids"] is None) == (r["text"] is None) for r in back)
    assert sorted((len(r["_ids"] or []) for r in back)) == [0, 0, 2, 2, 3, 60_001]
    assert encoded(docs.limit(0), vocabulary).count() == 0 and round_trip(docs.limit(0), vocabulary).count() == 0
    digests = {r["doc_id"]: r for r in round_trip(docs, vocabulary).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert digests[1][1:] == digests[2][1:] == (0, empty, empty)


def test_query(spark, library):
    found = QUERIES["op12_bpe"](spark, SF_DIR).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(found) == len(docs)
    for row in found:
        ids = library.encode(docs[row["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.loads(open(BYTE_PAIRS, encoding="utf-8").read())
    spec["model"]["byte_fallback"] = True
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="no plain"):
        load_byte_pairs(str(path))
