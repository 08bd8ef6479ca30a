"""Conversation repair against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from relfold.llm.queries import ORACLE, QUERIES
from relfold.llm.repair import BLANK, DUPLICATE, ENDS, SOUND, START, STATES, TRUNCATED, damaged, edited, least_edits, repair

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain_least(initials, faults, enter, leaves):
    """Every way row by row: state -> least (cost, edits), with inserts tried again and again."""
    at = {enter: (0, "")}

    def grown(at):
        for _ in range(4):
            for state, (cost, edits) in list(at.items()):
                after = 3 if state == 2 else 2
                at[after] = min(at.get(after, (10**9, "")), (cost + 2, edits + "I"))
        return at

    # Equally cheap ways to a state are compared as whole texts, so all of them are carried along.
    ways = {enter: {""}}
    costs = {enter: 0}

    def add(costs, ways, state, cost, texts):
        if cost < costs.get(state, 10**9):
            costs[state], ways[state] = cost, set(texts)
        elif cost == costs[state]:
            ways[state] |= set(texts)

    def inserted(costs, ways):
        for _ in range(4):
            for state in list(costs):
                add(costs, ways, 3 if state == 2 else 2, costs[state] + 2, [w + "I" for w in ways[state]])

    inserted(costs, ways)
    for initial, fault in zip(initials, faults):
        new_costs, new_ways = {}, {}
        for state, cost in costs.items():
            add(new_costs, new_ways, state, cost + 3, [w + "D" for w in ways[state]])
            if fault in (SOUND, TRUNCATED):
                extra = fault == TRUNCATED
                add(new_costs, new_ways, 3 if state == 2 else 2, cost + 2 + extra, [w + "R" for w in ways[state]])
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initial))
                if kept is not None:
                    add(new_costs, new_ways, kept, cost + extra, [w + "K" for w in ways[state]])
        costs, ways = new_costs, new_ways
        inserted(costs, ways)
    least = min((costs[s] for s in leaves if s in costs), default=None)
    return None if least is None else (least, min(w for s in leaves if costs.get(s) == least for w in ways[s]))


def plain_repair(rows):
    """The contract read row by row."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(BLANK if not solid else DUPLICATE if (role, text) in seen else SOUND if solid[-1] in ".!?" else TRUNCATED)
            seen.add((role, text))
        initials = [r[1][:1] for r in kept]
        cost, audit = plain_least(initials, faults, START, ENDS)
        roles, texts = edited(audit, [r[1] for r in kept], [r[2] for r in kept], START)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in roles))
        turns = {r[0] for r in kept} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(roles, texts)).encode()).hexdigest()
        out[conv] = (gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit, sha)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def summary(found):
    rows = found.summary.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}


def some_rows(rng, conversations, longest):
    roles = ["user", "assistant", "system", "assistant", "user", "tool", "", None, "unknown", "student"]
    texts = ["A b.", "A b", "", " \t", None, "Wéll?", "x! ", "...", "Long " * 30 + "."]
    out = []
    for conv in range(conversations):
        for k in range(rng.randint(1, longest)):
            turn = rng.choice([k, k, k, None, rng.randint(0, longest)])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            out.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.randint(0, 5)}."))
    return out


def test_least_edits_against_all_ways():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(0, 9)
        initials = [rng.choice("uuaasx") for _ in range(n)]
        faults = [rng.choice([SOUND, SOUND, SOUND, TRUNCATED, BLANK, DUPLICATE]) for _ in range(n)]
        enter = rng.randrange(STATES)
        for leaves in (ENDS, *([s] for s in range(STATES))):
            assert least_edits(initials, faults, enter, leaves) == plain_least(initials, faults, enter, leaves)


def test_conversations_against_brute_force(spark):
    rows = some_rows(random.Random(2), 60, 8)
    rows += [(None, 1, "user", "No name."), (None, None, None, None), (900, None, "user", "A."), (900, None, "user", "A.")]
    rows += rows[:40]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit(1), "task": F.lit("x"), "key": F.lit(2)}).repartition(3)
    assert summary(repair(damaged(df))) == plain_repair(rows)


@pytest.mark.parametrize("chunk", [1, 2, 5])
def test_long_conversations_are_cut_without_a_trace(spark, chunk):
    rng = random.Random(chunk)
    rows = some_rows(rng, 6, 40) + [(50, t, ("user", "assistant")[t % 2], "Same.") for t in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = repair(damaged(df), chunk=chunk)
    assert summary(found) == plain_repair(rows)
    lines = defaultdict(list)
    for r in found.rows.orderBy("conv_id", "task", "chunk", "place").collect():
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, row in plain_repair(rows).items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == row[-1]


def test_many_copies_of_a_row_and_dropped_conversations(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(7, 1, "user", "Yes.")] * 3000 + [(dropped, 0, "user", "Gone.")]
    found = summary(repair(damaged(spark.createDataFrame(rows, SCHEMA).repartition(4))))
    assert found == plain_repair(rows)
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", EMPTY)


def test_empty_table(spark):
    found = repair(damaged(spark.createDataFrame([], SCHEMA)))
    assert found.summary.count() == 0 and found.rows.count() == 0


def test_a_sound_conversation_stays(spark):
    rows = [("s", 0, "system", "Be kind."), ("s", 1, "user", "Hi!"), ("s", 2, "assistant", "Hello.")]
    from relfold.llm.repair import prepared

    found = repair(prepared(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")), "string")
    row = found.summary.first()
    assert (row["conv_id"], row["cost"], row["audit"]) == ("s", 0, "KKK")


def test_query_against_brute_force_and_sql(spark):
    found = QUERIES["op13_repair"](spark, SF_DIR)
    table = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    assert got == plain_repair(rows)
    if "op13_repair" in ORACLE:
        duck = duckdb.connect()
        duck.execute(f"create view conversations as select * from '{SF_DIR}/conversations.parquet'")
        cursor = duck.execute(ORACLE["op13_repair"])
        names = [c[0] for c in cursor.description]
        assert {r[names.index("conv_id")]: tuple(r[names.index(c)] for c in COLUMNS) for r in cursor.fetchall()} == got
