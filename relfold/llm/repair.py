"""Repair of the structure of conversations: the cheapest edits after which roles alternate.

Rows of a conversation may be kept, given another role or deleted, and empty ones inserted, until the initials of the
roles read ``(s?(ua)+)?``: an optional system message, then user and assistant in turn. Row by row and state by state
(nothing yet, after system, after user, after assistant) the edits form a lattice, and a repair is a shortest path in
it. It is searched from both ends, each with a heap of its own; when the heads of the two heaps add up to more than the
best crossing, all cheapest crossings are known, and the least concatenation of the edits before and after one is taken.

Spark sorts the rows into ranges, so a conversation of any length is cut into chunks that no task has to hold
together. Conversations within one chunk are solved where they lie. For the others each chunk gives the cheapest edits
from every entering to every leaving state, these are combined along the conversation, and each chunk is then edited by
itself; only the edits, not the texts, of one conversation ever meet in one task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relfold.llm.common import small_batches, written

#: Rows of a conversation that are solved together.
CHUNK = 1024
# Costs of edits and of an undeleted truncated row, by the rules of the repair.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
USER, ASSISTANT = "user", "assistant"
#: States: nothing yet, after system, after user, after assistant; a repair ends in the first or the last.
START, SYSTEM, ASKED, ANSWERED = range(4)
STATES, ENDS = 4, (START, ANSWERED)
#: States from which a rerole or an insert leads to each state.
BEFORE = ((), (), (START, SYSTEM, ANSWERED), (ASKED,))
#: Faults of rows; the first two must be deleted.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
FOLLOWING = {"s": ("u",), "u": ("a",), "a": ("u",)}
SPACE = " \t\n\v\f\r"

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SOLVED = "cost bigint, audit string, " + ", ".join(f"`{c}` bigint" for c in _COUNTS)
CUT_SCHEMA = f"conv string, task int, chunk int, whole boolean, turns array<bigint>, roles array<string>, texts array<string>, faults array<int>, keys array<binary>, gaps bigint, sha string, {_SOLVED}"


def next_state(state: int) -> int:
    """The state after the one role, user or assistant, that a rerole or an insert may give here."""
    return ANSWERED if state == ASKED else ASKED


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept row, if it may be kept."""
    if initial == "s":
        return SYSTEM if state == START else None
    wanted = "a" if state == ASKED else "u"
    return next_state(state) if initial == wanted else None


def least_edits(initials: Sequence[str], faults: Sequence[int], enter: int, leaves: Sequence[int]) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest repair of rows from state ``enter`` to one of ``leaves``, the edits being the
    least text of D, I, K and R among equally cheap ones; None if there is none.

    Two equally cheap ways to the same node are never one the beginning of the other, as both take up the same rows
    and more inserts cost more. The lesser beginning is therefore best whatever follows.
    """
    n = len(initials)

    def onward(i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        yield INSERT, "I", i, next_state(state)
        if i < n:
            yield DELETE, "D", i + 1, state
            if faults[i] in (SOUND, TRUNCATED):
                extra = CUT_OFF if faults[i] == TRUNCATED else 0
                yield REROLE + extra, "R", i + 1, next_state(state)
                kept = kept_state(state, initials[i])
                if kept is not None:
                    yield extra, "K", i + 1, kept

    def backward(i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        for origin in BEFORE[state]:
            yield INSERT, "I", i, origin
        if i:
            yield DELETE, "D", i - 1, state
            if faults[i - 1] in (SOUND, TRUNCATED):
                extra = CUT_OFF if faults[i - 1] == TRUNCATED else 0
                for origin in BEFORE[state]:
                    yield REROLE + extra, "R", i - 1, origin
                for origin in range(STATES):
                    if kept_state(origin, initials[i - 1]) == state:
                        yield extra, "K", i - 1, origin

    # Heads of equal cost go on in the direction of the search, so that all ways of a cost to a node are known first.
    known = ({(0, enter): (0, "")}, {(n, leave): (0, "") for leave in leaves})
    heaps = ([(0, 0, "", enter)], [(0, -n, "", leave) for leave in leaves])
    heapq.heapify(heaps[1])
    settled: tuple[dict, dict] = ({}, {})
    best = None

    def step(side: int) -> None:
        nonlocal best
        cost, place, edits, state = heapq.heappop(heaps[side])
        i = place if side == 0 else -place
        if (i, state) in settled[side]:
            return
        settled[side][i, state] = cost, edits
        met = settled[1 - side].get((i, state))
        if met and (best is None or cost + met[0] < best):
            best = cost + met[0]
        for price, letter, j, other in onward(i, state) if side == 0 else backward(i, state):
            met = settled[1 - side].get((j, other))
            if met and (best is None or cost + price + met[0] < best):
                best = cost + price + met[0]
            if (j, other) in settled[side]:
                continue
            found = cost + price, (edits + letter if side == 0 else letter + edits)
            if (j, other) not in known[side] or found < known[side][j, other]:
                known[side][j, other] = found
                heapq.heappush(heaps[side], (found[0], j if side == 0 else -j, found[1], other))

    for _ in leaves:  # the ends are settled first
        step(1)
    while heaps[0] or heaps[1]:
        heads = [h[0][0] if h else None for h in heaps]
        if best is not None and (None in heads or heads[0] + heads[1] > best):
            break
        if heads[1] is None or heads[0] is not None and (heads[0], len(settled[0])) <= (heads[1], len(settled[1])):
            step(0)
        else:
            step(1)
    if best is None:
        return None
    crossings = []
    for (i, state), (cost, edits) in settled[0].items():
        met = settled[1].get((i, state))
        if met and cost + met[0] == best:
            crossings.append(edits + met[1])
        for price, letter, j, other in onward(i, state):
            met = settled[1].get((j, other))
            if met and cost + price + met[0] == best:
                crossings.append(edits + letter + met[1])
    return best, min(crossings)


def edited(audit: str, roles: Sequence[str], texts: Sequence[str], state: int) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits, which begin in ``state``."""
    out_roles, out_texts, k = [], [], 0
    for letter in audit:
        if letter != "D":
            role = ASSISTANT if state == ASKED else USER
            kept = letter == "K"
            out_roles.append(roles[k] if kept else role)
            out_texts.append("" if letter == "I" else texts[k])
            state = SYSTEM if kept and roles[k][:1] == "s" else next_state(state)
        k += letter != "I"
    return out_roles, out_texts


def fault_of(text: str) -> int:
    """Blank, truncated or sound; duplicates are told by what came before."""
    shown = text.rstrip(SPACE)
    return BLANK if not shown else SOUND if shown[-1] in ".!?" else TRUNCATED


def illegal_pairs(initials: Sequence[str]) -> int:
    return sum(b not in FOLLOWING.get(a, ()) for a, b in zip(initials, initials[1:]))


def _counts(initials: Sequence[str], faults: Sequence[int]) -> dict:
    return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": illegal_pairs(initials)}


def _gaps(turns: Sequence[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


class _Cutter:
    """Turns one task's sorted rows into solved conversations and chunks of those that may go on in another task."""

    def __init__(self, task: int, chunk: int):
        self.task, self.size = task, chunk
        self.out: list[dict] = []
        self.begun, self.first, self.number = False, True, 0

    def begin(self, conv: str | None) -> None:
        self.begun, self.conv, self.cut, self.seen = True, conv, False, set()
        self.clear()

    def clear(self) -> None:
        self.turns, self.roles, self.texts, self.faults, self.keys = [], [], [], [], []

    def add(self, turn: int | None, role: str, text: str, key: bytes, copies: int) -> None:
        own = fault_of(text)
        for k in range(copies):
            if len(self.turns) == self.size:
                self.emit()
                self.cut = True
            fault = DUPLICATE if own != BLANK and key in self.seen else own
            self.seen.add(key)
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text if k == 0 else "")  # a copy is deleted in any case
            self.faults.append(fault)
            self.keys.append(key if fault in (SOUND, TRUNCATED) else None)

    def end(self, last: bool) -> None:
        """A task's first and last conversation may have rows in other tasks."""
        if not self.begun:
            return
        if self.first or last or self.cut:
            self.emit()
        else:
            initials = [r[:1] for r in self.roles]
            cost, audit = least_edits(initials, self.faults, START, ENDS)
            roles, texts = edited(audit, self.roles, self.texts, START)
            digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(roles, texts)).encode()).hexdigest()
            self.out.append(
                {"conv": self.conv, "task": self.task, "chunk": self.number, "whole": True, "roles": roles, "texts": texts, "gaps": _gaps(self.turns), "sha": digest, "cost": cost, "audit": audit}
                | _counts(initials, self.faults)
            )
            self.number += 1
        self.begun, self.first = False, False

    def emit(self) -> None:
        self.out.append(
            {"conv": self.conv, "task": self.task, "chunk": self.number, "whole": False, "turns": self.turns, "roles": self.roles, "texts": self.texts, "faults": self.faults, "keys": self.keys}
        )
        self.number += 1
        self.clear()


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    """The Arrow form of a schema of plain columns and arrays of them; workers have no session to ask."""
    fields = []
    for column in schema.split(", "):
        name, kind = column.replace("`", "").split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append((name, pa.list_(_TYPES[inner]) if inner != kind else _TYPES[kind]))
    return pa.schema(fields)


def cut_conversations(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks (CUT_SCHEMA) of ``rows`` (conv, turn, role, text, copies). Equal rows are counted before they are sorted,
    so no range holds more than one row of each; order is by turn, nulls first, then by a digest of role and text."""
    counted = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = ["conv", "turn", "key"]
    ordered = counted.withColumn("key", key).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.select("conv", "turn", "role", "text", "copies", "key")
    arrow = _arrow(CUT_SCHEMA)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cutter = _Cutter(TaskContext.get().partitionId(), chunk)
        for batch in batches:
            for conv, turn, role, text, copies, key in zip(*(c.to_pylist() for c in batch.columns)):
                if not cutter.begun or conv != cutter.conv:
                    cutter.end(last=False)
                    cutter.begin(conv)
                cutter.add(turn, role, text, key, copies)
            if cutter.out:
                yield pa.RecordBatch.from_pylist(cutter.out, arrow)
                cutter.out = []
        cutter.end(last=True)
        if cutter.out:
            yield pa.RecordBatch.from_pylist(cutter.out, arrow)

    return written(ordered.mapInArrow(cut, CUT_SCHEMA), compression="zstd")


_MATRIX = f"costs array<bigint>, audits array<string>, rows bigint, low bigint, high bigint, kinds bigint, opening bigint, closing bigint, head string, tail string, {', '.join(f'`{c}` bigint' for c in _COUNTS)}"
_PATHS = f"conv string, task int, chunk int, enter int, audit string, total string, gaps bigint, cost bigint, {', '.join(f'`{c}` bigint' for c in _COUNTS)}"


def _with_late_copies(open_: DataFrame) -> DataFrame:
    """Chunks with the faults as they are once the conversation's earlier tasks are known. A (conversation, row) stands
    once in each task at most, as a task finds its own copies."""
    firsts = open_.select("conv", "task", "chunk", F.posexplode("keys").alias("at", "key")).where("key is not null")
    earliest = firsts.groupBy("conv", "key").agg(F.min("task").alias("least"), F.count("*").alias("n")).where("n > 1")
    earliest = earliest.select(F.col("conv").alias("c"), F.col("key").alias("k"), "least")
    late = firsts.join(earliest, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where("task > least")
    late = late.groupBy("task", "chunk").agg(F.collect_set("at").alias("late"))
    faults = F.transform("faults", lambda f, i: F.when(F.array_contains("late", i), DUPLICATE).otherwise(f))
    return open_.join(late, ["task", "chunk"], "left").withColumn("faults", F.when(F.col("late").isNull(), F.col("faults")).otherwise(faults)).drop("late")


def _matrices(open_: DataFrame) -> DataFrame:
    fields = _arrow(_MATRIX)

    @F.arrow_udf(_MATRIX)
    def solved(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for turns, roles, faults in columns:
            out = []
            for t, r, f in zip(turns.to_pylist(), roles.to_pylist(), faults.to_pylist()):
                initials = [x[:1] for x in r]
                found = [least_edits(initials, f, enter, [leave]) for enter in range(STATES) for leave in range(STATES)]
                known = sorted({x for x in t if x is not None})
                row = {"costs": [x and x[0] for x in found], "audits": [x and x[1] for x in found], "rows": len(t), "kinds": len(known)}
                if known:
                    row |= {"low": known[0], "high": known[-1]}
                if t:
                    row |= {"opening": t[0], "closing": t[-1], "head": initials[0], "tail": initials[-1]}
                out.append(row | _counts(initials, f))
            yield pa.RecordBatch.from_pylist(out, fields).to_struct_array()

    return open_.select("conv", "task", "chunk", solved("turns", "roles", "faults").alias("m")).select("conv", "task", "chunk", "m.*")


class _Chain:
    """Edits of chunks one after the other, compared without being joined."""

    def __init__(self, text: str, rest: "_Chain | None"):
        self.text, self.rest = text, rest

    def __lt__(self, other: "_Chain") -> bool:
        a, b, i, j = self, other, 0, 0
        while True:
            while a is not None and i == len(a.text):
                a, i = a.rest, 0
            while b is not None and j == len(b.text):
                b, j = b.rest, 0
            if a is None or b is None or (a is b and i == j):
                return a is None and b is not None
            size = min(len(a.text) - i, len(b.text) - j)
            x, y = a.text[i : i + size], b.text[j : j + size]
            if x != y:
                return x < y
            i, j = i + size, j + size

    def pieces(self) -> Iterator[str]:
        at: _Chain | None = self
        while at is not None:
            yield at.text
            at = at.rest


def _path(part: pa.Table) -> pa.Table:
    """The states in which the chunks of one conversation are entered, their edits, and the sums over its chunks."""
    rows = sorted(part.to_pylist(), key=lambda r: (r["task"], r["chunk"]))
    after: list[tuple[int, _Chain | None, tuple] | None] = [(0, None, ()) if s in ENDS else None for s in range(STATES)]
    for row in reversed(rows):
        before: list = []
        for enter in range(STATES):
            ways = []
            for leave in range(STATES):
                cost = row["costs"][enter * STATES + leave]
                if cost is not None and after[leave] is not None:
                    rest = after[leave]
                    ways.append((cost + rest[0], _Chain(row["audits"][enter * STATES + leave], rest[1]), (enter, rest[2])))
            least = min((w[0] for w in ways), default=None)
            before.append(min((w for w in ways if w[0] == least), key=lambda w: w[1]) if ways else None)
        after = before
    cost, chain, states = after[START]
    pieces = list(chain.pieces())
    sums = {c: sum(r[c] for r in rows) for c in _COUNTS}
    full = [r for r in rows if r["rows"]]
    sums["illegal"] += sum(b["head"] not in FOLLOWING.get(a["tail"], ()) for a, b in zip(full, full[1:]))
    dated = [r for r in full if r["kinds"]]
    kinds = sum(r["kinds"] for r in dated) - sum(a["closing"] == b["opening"] for a, b in zip(dated, dated[1:]))
    gaps = max(r["high"] for r in dated) - min(r["low"] for r in dated) + 1 - kinds if dated else 0
    out = []
    for k, (row, piece) in enumerate(zip(rows, pieces)):
        enter, states = states
        row = {"conv": row["conv"], "task": row["task"], "chunk": row["chunk"], "enter": enter, "audit": piece}
        out.append(row | (sums | {"total": "".join(pieces), "gaps": gaps, "cost": cost} if k == 0 else {}))
    return pa.Table.from_pylist(out, _arrow(_PATHS))


def _edited(open_: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv, task, chunk, roles, texts, audit) of chunks after their edits."""
    fields = pa.struct([("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    @F.arrow_udf("roles array<string>, texts array<string>")
    def apply(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for audit, roles, texts, enter in columns:
            found = [edited(*row) for row in zip(audit.to_pylist(), roles.to_pylist(), texts.to_pylist(), enter.to_pylist())]
            yield pa.array([{"roles": r, "texts": t} for r, t in found], fields)

    joined = open_.join(paths.select("task", "chunk", "enter", "audit"), ["task", "chunk"])
    return joined.select("conv", "task", "chunk", "audit", apply("audit", "roles", "texts", "enter").alias("e")).select("conv", "task", "chunk", "audit", "e.roles", "e.texts")


def _digests(chunks: DataFrame) -> DataFrame:
    """(conv, sha) of texts that span chunks, hashed as they stream by in order: a chunk is held at a time."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, digest, lead = False, None, None, b""
        names = ["conv", "sha"]
        for batch in batches:
            for of, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("conv", "roles", "texts"))):
                if not begun or of != conv:
                    if begun:
                        yield pa.record_batch([pa.array([conv], pa.string()), pa.array([digest.hexdigest()])], names=names)
                    begun, conv, digest, lead = True, of, hashlib.sha256(), b""
                for role, text in zip(roles, texts):
                    digest.update(lead + f"{role}:{text}".encode())
                    lead = b"\n"
        if begun:
            yield pa.record_batch([pa.array([conv], pa.string()), pa.array([digest.hexdigest()])], names=names)

    return chunks.repartition("conv").sortWithinPartitions("conv", "task", "chunk").select("conv", "roles", "texts").mapInArrow(hashed, "conv string, sha string")


class Repair:
    """``rows``: every row of the repaired conversations (conv_id, task, chunk, place, role, text; in order of these).
    ``summary``: one row per conversation of the input, see ``repair``."""

    def __init__(self, rows: DataFrame, summary: DataFrame):
        self.rows, self.summary = rows, summary


def prepared(conversations: DataFrame) -> DataFrame:
    """The rows as ``cut_conversations`` takes them: conv as text, null roles and texts as one space, one copy each."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"),
    )


def repair(rows: DataFrame, conv_type: str = "bigint", chunk: int = CHUNK) -> Repair:
    """Repair conversations given as ``rows`` (conv, turn, role, text, copies; see ``prepared``).

    ``summary`` has conv_id, gaps (missing turns between the least and the greatest), blank, duplicate and truncated
    (each row's first fault), illegal (neighbours that may not follow each other), cost, audit (the first letters of the
    edits, in order) and repaired_sha256 (of the repaired ``role:text`` lines). Null conv_ids are one conversation.
    Rows of equal turn are ordered by a digest of role and text; repeated rows are duplicates. A conversation whose
    copies are all 0 has zeros, no edits and the hash of the empty text; an empty table gives none.
    """
    small_batches(rows.sparkSession)
    chunks = cut_conversations(rows, chunk)
    whole = chunks.where("whole")
    open_ = _with_late_copies(chunks.where("not whole").select("conv", "task", "chunk", "turns", "roles", "texts", "faults", "keys"))
    paths = written(_matrices(open_).groupBy("conv").applyInArrow(_path, _PATHS))
    parts = written(_edited(open_, paths), compression="zstd")
    counts = ["gaps", *_COUNTS, "cost"]
    heads = paths.where("total is not null").select("conv", *counts, F.col("total").alias("audit"))
    digests = _digests(parts).withColumnRenamed("conv", "of")
    split = heads.join(digests, F.col("conv").eqNullSafe(F.col("of"))).select("conv", *counts, "audit", "sha")
    summary = whole.select("conv", *counts, "audit", "sha").union(split)
    summary = summary.select(F.col("conv").cast(conv_type).alias("conv_id"), *counts, "audit", F.col("sha").alias("repaired_sha256"))
    both = whole.select("conv", "task", "chunk", "roles", "texts").union(parts.select("conv", "task", "chunk", "roles", "texts"))
    lines = both.select("conv", "task", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row"))
    lines = lines.select(F.col("conv").cast(conv_type).alias("conv_id"), "task", "chunk", "place", F.col("row")["roles"].alias("role"), F.col("row")["texts"].alias("text"))
    return Repair(lines, summary)


def damaged(conversations: DataFrame) -> DataFrame:
    """``prepared`` rows damaged by the crc32 of ``conv_id:turn`` (nulls: one space) modulo 20: 0 drops a row, 1
    empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    A dropped row leaves its conversation's name behind."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    base = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    return base.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.when(~gone, F.col("turn").cast("bigint")).alias("turn"),
        F.when(gone, "").when(F.col("kind") == 4, USER).otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )
