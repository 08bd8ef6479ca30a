"""How candidate groups of near duplicates are dealt to tasks."""

import random

import pytest
from pyspark.sql import functions as F

import relfold.llm.near as near
from relfold.llm.near import near_duplicates
from tests.llm.test_texts import brute_near


def chained_texts(count, words=40, step=12):
    """Texts of which neighbours have much in common, others nothing: a window that moves on."""
    rng = random.Random(12)
    stream = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(count * step + words)]
    return [(i, " ".join(stream[i * step : i * step + words])) for i in range(count)]


@pytest.mark.parametrize("step", [1, 4, 10])
def test_chains_are_dealt_bucket_by_bucket(spark, step, monkeypatch):
    """Half-similar texts chain into one group of many blocks; each is sent as often as it has buckets at most, and the
    links between similar ones are the same."""
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr("relfold.llm.common.SLICE", 16)
    sent, original = [], near.meetings

    def counted(sets):
        found = original(sets)
        sent.append((found.agg(F.sum("blocks")).first()[0] or 0, found.where("band is not null").count(), found.agg(F.max("blocks")).first()[0]))
        return found

    monkeypatch.setattr(near, "meetings", counted)
    rows = chained_texts(250, step=step) + [(1000, "x y z"), (1001, None)]
    rows += [(2000 + i, rows[5][1]) for i in range(3)] + [(3000, rows[7][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = near_duplicates(df)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_near(rows)
    bands, _ = near.choose_bands(0.8, 0.999)
    copies, by_bucket, _ = sent[0]
    assert copies <= bands * 260 * 2
    if step == 4:
        assert by_bucket > 0
