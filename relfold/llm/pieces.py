"""SentencePiece encoding and decoding by best-scoring segmentation, giant texts in parallel chunks.

The lattice of a text has a node between any two characters and an edge for every piece. Encoding finds the path
with the largest sum of piece scores. No piece crosses certain places (before a space mark, around a character that
is in no longer piece), so a text falls into segments, equal segments are solved once per batch, and a batch's
different segments are solved together, one array operation per position and length.

A giant text is cut into chunks at fixed places. A piece may cross the border of two chunks, so a chunk is entered
in a state: how many of its first characters that piece has taken. In (max, +) algebra a chunk is the matrix of best
scores from each entering to each leaving state; matrices combine associatively, which tells every chunk its two
states, and then each chunk is traced back on its own. Scores are whole numbers, so sums agree in any order.

Encoding needs scores of a unigram model. A model of merges has only ranks; its pieces are then scored by Zipf's
law on the rank. Its ids are thus the best-scoring ones, not those of its merges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relfold.llm.common import small_batches, written

#: The mark that stands for a space inside pieces.
MARK = "▁"
#: Characters of a chunk; texts with more are cut.
CHUNK = 1 << 15
#: Chunks whose matrices are multiplied together.
TOGETHER = 256
#: Characters of the texts that are solved together.
SPAN = 1 << 18
#: Places of an encoder's memory of segments (as a power of two), the longest of them, and the room for their characters.
REMEMBERED, REMEMBERED_LENGTH, ROOM = 18, 64, 1 << 21
#: Units of a score: whole numbers per unit of log probability.
UNIT = 1_000_000
NEVER = -(1 << 60)
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Pieces:
    """Pieces by id (None for control pieces, bytes for byte pieces) with whole-number scores, and the score of a
    character that no piece covers, which is written as its bytes."""

    pieces: tuple
    scores: tuple[int, ...]
    unknown: int
    byte_ids: tuple[int, ...]


def load_pieces(path: str) -> Pieces:
    """Read a SentencePiece model on the driver. Its pieces travel with the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(count)]
    raw = [model.get_score(i) for i in range(count)]
    normal = [i for i in range(count) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    # A model of merges scores its pieces 0, -1, -2, ...: ranks instead of log probabilities.
    ranked = all(raw[i] == int(raw[i]) for i in normal) and len({raw[i] for i in normal if raw[i] > -1e6}) > 1
    pieces: list = [None] * count
    scores = [NEVER] * count
    byte_ids = [-1] * 256
    law = math.log(sum(1 / (k + 2) for k in range(len(normal))))
    last = max((-raw[i] for i in normal if raw[i] > -1e6), default=0)
    for i in range(count):
        if model.is_byte(i):
            value = int(names[i][3:5], 16)
            pieces[i] = bytes([value])
            byte_ids[value] = i
    for i in normal:
        pieces[i] = names[i]
        log = -math.log(min(-raw[i], last + 1) + 2) - law if ranked else raw[i]
        scores[i] = round(log * UNIT)
    unknown = min(scores[i] for i in normal) - 10 * UNIT
    return Pieces(tuple(pieces), tuple(scores), unknown, tuple(byte_ids))


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs laid end to end, and where each run begins among them."""
    begin = np.cumsum(sizes) - sizes
    return np.repeat(starts - begin, sizes) + np.arange(int(sizes.sum())), begin


class _Memory:
    """Solved segments by hash, with their characters to compare. A newer one takes an older one's place; all are
    forgotten when there is no more room for characters."""

    def __init__(self):
        places = 1 << REMEMBERED
        self.hashes = np.zeros(places, np.uint64)
        self.sizes, self.counts, self.codes_at, self.ids_at, self.scores = (np.zeros(places, np.int64) for _ in range(5))
        self.codes, self.ids = np.zeros(ROOM, np.int32), np.zeros(4 * ROOM, np.int32)  # at most four byte pieces a character
        self.used, self.ids_used = 0, 0

    def find(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which segments are known, the place of each)."""
        slot = ((hashes * _BASE) >> np.uint64(64 - REMEMBERED)).astype(np.int64)
        hit = (self.sizes[slot] == sizes) & (self.hashes[slot] == hashes)
        mine, begin = _gathered(starts[hit], sizes[hit])
        theirs, _ = _gathered(self.codes_at[slot[hit]], sizes[hit])
        if len(mine):
            hit[hit] = np.logical_and.reduceat(codes[mine] == self.codes[theirs], begin)
        return hit, slot

    def add(self, hashes, slot, codes, starts, sizes, ids, offsets, scores) -> None:
        if self.used + len(codes) > ROOM:
            self.sizes[:], self.used, self.ids_used = 0, 0, 0
            if len(codes) > ROOM:
                return
        self.codes[self.used : self.used + len(codes)] = codes
        self.ids[self.ids_used : self.ids_used + len(ids)] = ids
        short = sizes <= REMEMBERED_LENGTH
        slot = slot[short]
        self.hashes[slot], self.sizes[slot], self.scores[slot] = hashes[short], sizes[short], scores[short]
        self.counts[slot], self.codes_at[slot] = np.diff(offsets)[short], self.used + starts[short]
        self.ids_at[slot] = self.ids_used + offsets[:-1][short]
        self.used += len(codes)
        self.ids_used += len(ids)


class Encoder:
    """Look-up tables of a vocabulary for whole arrays of characters."""

    def __init__(self, vocabulary: Pieces):
        self.vocabulary = vocabulary
        self.memory: _Memory | None = None
        words = [(i, p) for i, p in enumerate(vocabulary.pieces) if isinstance(p, str)]
        self.longest = max((len(p) for _, p in words), default=1)
        #: Prefixes of pieces by rolling hash: per prefix the id of the piece it is, or -1.
        prefix: dict[int, int] = {}
        inner = np.zeros(0x110000, bool)  # characters that occur in a piece of several characters
        self.mark_leads = True  # the mark never follows another character in a piece
        for i, p in words:
            h = 0
            for k, c in enumerate(p):
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                prefix.setdefault(h, -1)
                if len(p) > 1:
                    inner[ord(c)] = True
                if k and c == MARK and p[k - 1] != MARK:
                    self.mark_leads = False
            prefix[h] = i
        self.inner = inner
        self.keys, self.values = self._table(prefix)
        self.scores = np.array(vocabulary.scores, np.int64)
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)

    def __getstate__(self):
        return {**self.__dict__, "memory": None}  # each worker remembers what it has seen itself

    def _table(self, prefix: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing with linear steps in a table of at least eight times as many places."""
        self.bits = max(10, (8 * len(prefix)).bit_length())
        size = 1 << self.bits
        keys, values = np.zeros(size, np.uint64), np.full(size, -2, np.int32)
        self.steps = 1
        for h, i in prefix.items():
            at, step = (h * int(_BASE) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits), 1
            while values[at] != -2:
                at, step = (at + 1) & (size - 1), step + 1
            keys[at], values[at] = h, i
            self.steps = max(self.steps, step)
        return keys, values

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each prefix hash, -1 for a prefix that is no piece, -2 for no prefix."""
        at = ((hashes * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(hashes), -2, np.int32)
        open_ = np.arange(len(hashes))
        for _ in range(self.steps):
            value = self.values[at]
            hit = (value != -2) & (self.keys[at] == hashes[open_])
            out[open_[hit]] = value[hit]
            more = (value != -2) & ~hit
            if not more.any():
                break
            open_, at = open_[more], (at[more] + 1) & (len(self.keys) - 1)
        return out

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """For every character, whether no piece can hold both it and the one before."""
        out = np.zeros(len(codes), bool)
        if not len(codes):
            return out
        out[0] = True
        alone = ~self.inner[codes]
        out[1:] |= alone[1:] | alone[:-1]
        if self.mark_leads:
            mark = codes == ord(MARK)
            out[1:] |= mark[1:] & ~mark[:-1]
        return out

    def edges(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length, the start places and ids of the pieces found; id -1 for a character with no piece of
        its own. ``ends`` is where each character's segment ends."""
        at = np.arange(len(codes))
        plus = codes.astype(np.uint64) + np.uint64(1)
        hashes = np.zeros(len(codes), np.uint64)
        for length in range(1, self.longest + 1):
            fits = at + length <= ends[at]
            at, hashes = at[fits], hashes[fits]
            if not len(at):
                return
            hashes = hashes * _BASE + plus[at + length - 1]
            found = self.look_up(hashes)
            if length == 1:
                yield 1, at, np.maximum(found, -1)
            else:
                whole = found >= 0
                yield length, at[whole], found[whole]
            kept = found != -2
            at, hashes = at[kept], hashes[kept]

    def solve(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best segmentations of segments laid end to end: ids (byte pieces written out), the offsets of each
        segment in them, and the segments' scores. Among equal scores the longest last piece wins."""
        n, count = len(codes), len(starts)
        lengths = np.diff(np.append(starts, n))
        of = np.repeat(np.arange(count), lengths)
        place = np.arange(n) - starts[of]
        if count and lengths.max() < 1 << 15:
            place = place.astype(np.int16)  # sorted by counting
        edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for length, at, ids in self.edges(codes, np.append(starts[1:], n)[of]):
            order = np.argsort(place[at], kind="stable")
            at, ids = at[order], ids[order]
            where = place[at]
            bounds = np.flatnonzero(np.diff(where, prepend=-1, append=-1)) if len(where) else []
            for low, high in zip(bounds[:-1], bounds[1:]):
                edges[int(where[low]), length] = (at[low:high], ids[low:high])
        # Node numbers: each segment has one more node than characters.
        node = np.arange(n) + of
        best = np.full(n + count, NEVER, np.int64)
        best[starts + np.arange(count)] = 0
        back_length, back_id = np.zeros(n + count, np.int32), np.full(n + count, -1, np.int32)
        for at_place, length in sorted(edges):
            at, ids = edges[at_place, length]
            source = node[at]
            score = best[source] + np.where(ids >= 0, self.scores[ids], self.vocabulary.unknown)
            target = source + length
            better = score > best[target]
            target, score = target[better], score[better]
            best[target], back_length[target], back_id[target] = score, length, ids[better]
        last = starts + lengths + np.arange(count)
        return *self._trace(codes, starts, last, back_length, back_id), best[last]

    def _trace(self, codes, starts, last, back_length, back_id) -> tuple[np.ndarray, np.ndarray]:
        """Follow all segments back together; then put the pieces in order and write unknown characters as bytes."""
        count = len(starts)
        at, first = last.copy(), starts + np.arange(count)
        segments, ids, places = [], [], []
        live = np.flatnonzero(at > first)
        while len(live):
            here = at[live]
            segments.append(live)
            ids.append(back_id[here])
            at[live] = here - back_length[here]
            places.append(at[live])
            live = live[at[live] > first[live]]
        if not segments:
            return np.empty(0, np.int32), np.zeros(count + 1, np.int64)
        segments, ids, places = map(np.concatenate, (segments, ids, places))
        order = np.argsort(places, kind="stable")
        segments, ids, places = segments[order], ids[order], places[order]
        unknown = ids < 0
        if unknown.any():
            character = codes[places - segments]  # a node's number is its place plus its segment's number
            sizes = np.where(unknown, 1 + (character > 0x7F) + (character > 0x7FF) + (character > 0xFFFF), 1)
            written_out = "".join(map(chr, character[unknown])).encode("utf-8", "surrogatepass")
            ids, segments = np.repeat(ids, sizes), np.repeat(segments, sizes)
            ids[ids < 0] = self.byte_ids[np.frombuffer(written_out, np.uint8)]
        return ids.astype(np.int32), np.searchsorted(segments, np.arange(count + 1)).astype(np.int64)

    def encode_codes(self, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, the offsets of each text in them, and each text's score. Equal segments
        are solved once, also those of earlier calls: they are found by a hash and compared in full."""
        cut = self.cuts(codes)
        cut[begins[begins < len(codes)]] = True
        starts = np.flatnonzero(cut)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(begins) + 1, np.int64), np.zeros(len(begins), np.int64)
        lengths = np.diff(np.append(starts, len(codes)))
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        powers = np.full(int(lengths.max()), _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        spread = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        hashes = np.add.reduceat((spread ^ (spread >> np.uint64(31))) * powers[place], starts)
        known, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        like = starts[first][inverse]
        equal = (lengths[first][inverse] == lengths).all() and (codes[np.repeat(like, lengths) + place] == codes).all()
        if not equal:  # a hash collision: solve each on its own
            first = inverse = np.arange(len(starts))
        begins_at, sizes = starts[first], lengths[first]
        if self.memory is None:
            self.memory = _Memory()
        hit, slot = self.memory.find(known, codes, begins_at, sizes) if equal else (np.zeros(len(first), bool), None)
        fresh = ~hit
        picked, solved_at = _gathered(begins_at[fresh], sizes[fresh])
        ids, offsets, solved_scores = self.solve(codes[picked], solved_at)
        scores, own, at = np.empty(len(first), np.int64), np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        scores[fresh], own[fresh], at[fresh] = solved_scores, np.diff(offsets), offsets[:-1]
        if slot is not None:
            mine = slot[hit]
            scores[hit], own[hit] = self.memory.scores[mine], self.memory.counts[mine]
            remembered, at_memory = _gathered(self.memory.ids_at[mine], own[hit])
            at[hit] = len(ids) + at_memory
            kept = np.concatenate([ids, self.memory.ids[remembered]])
            self.memory.add(known[fresh], slot[fresh], codes[picked], solved_at, sizes[fresh], ids, offsets, solved_scores)
            ids = kept
        counts = own[inverse]
        total = np.cumsum(counts)
        out = ids[np.repeat(at[inverse] - (total - counts), counts) + np.arange(int(total[-1]))]
        of_text = np.searchsorted(starts, np.append(begins, len(codes)))
        sums, ends = np.append(0, np.cumsum(scores[inverse])), np.append(0, total)
        return out, ends[of_text], np.diff(sums[of_text])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; a space is put before each text that is not empty, as the library does."""
        out: list[np.ndarray] = []
        low = 0
        while low < len(texts):
            high, size = low + 1, len(texts[low])
            while high < len(texts) and size + len(texts[high]) <= SPAN:
                size += len(texts[high])
                high += 1
            codes, begins = as_codes([marked(t) for t in texts[low:high]])
            ids, offsets, _ = self.encode_codes(codes, begins)
            out += [ids[a:b] for a, b in zip(offsets, offsets[1:])]
            low = high
        return out

    def spans(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a giant text, some SPAN characters at a time: it is cut where no piece can lie across, so the ids are
        those of the whole text. A span without such a place grows."""
        text = marked(text)
        at, size = 0, SPAN
        while at < len(text):
            codes, _ = as_codes([text[at : at + size]])
            stop = len(codes)
            if at + stop < len(text):
                stop = int(np.flatnonzero(self.cuts(codes))[-1])  # the first place is always one
                if stop == 0:
                    size *= 2
                    continue
            yield self.encode_codes(codes[:stop], np.array([0]))[0]
            at, size = at + stop, SPAN

    # Chunks of a giant text -------------------------------------------------------------------------------

    def chunk_path(self, codes: np.ndarray, size: int, enter: np.ndarray, leave: int | None):
        """Best scores of one chunk from a state vector, or the ids of its best path.

        ``codes`` are the chunk's ``size`` characters and up to longest - 1 that follow; ``enter`` holds a score for
        each entering state. Without ``leave`` the scores of all leaving states are returned, one row for each
        entering state with a score; with it, the ids of the best path from the one entering state to it."""
        width = self.longest
        of, limit = np.zeros(len(codes), np.int64), np.full(len(codes), len(codes))
        sources = np.flatnonzero(enter > NEVER)
        cut = np.append(np.flatnonzero(self.cuts(codes)[1:]) + 1, len(codes))
        limit = cut[np.searchsorted(cut, np.arange(len(codes)), "right")] if len(codes) else limit
        grown: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for length, at, ids in self.edges(codes, limit):
            inside = at < size
            for a, i in zip(at[inside].tolist(), ids[inside].tolist()):
                grown[a].append((length, i))
        best = np.full((len(codes) + width + 1, len(sources)), NEVER, np.int64)
        best[sources, np.arange(len(sources))] = enter[sources]
        back = np.zeros((len(codes) + width + 1, 2), np.int64)
        back[:, 1] = -9
        for a in range(size):
            if (best[a] <= NEVER // 2).all():
                continue
            for length, i in grown[a]:
                score = best[a] + (self.scores[i] if i >= 0 else self.vocabulary.unknown)
                better = score > best[a + length]
                if better.any():
                    best[a + length] = np.where(better, score, best[a + length])
                    back[a + length] = length, i
        if leave is None:
            return best[size : size + width].T
        path, at, stop = [], size + leave, int(sources[0])
        while at > stop:
            length, i = back[at]
            at -= int(length)
            path.append((int(i), int(codes[at])))
        out: list[int] = []
        for i, c in reversed(path):
            out += [i] if i >= 0 else [int(self.byte_ids[b]) for b in chr(c).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32)

    def _parts(self, codes: np.ndarray, size: int) -> tuple[int, int] | None:
        """The first and the last place within a chunk that no piece crosses."""
        free = np.flatnonzero(self.cuts(codes)[1 : size + 1]) + 1
        return (int(free[0]), int(free[-1])) if len(free) else None

    def transfer(self, codes: np.ndarray, size: int) -> np.ndarray:
        """The (max, +) matrix of a chunk: best score from each entering state to each leaving state. Between the
        first and the last free place every path is the same, so the states only matter outside."""
        width = self.longest
        parts = self._parts(codes, size)
        out = np.full((width, width), NEVER, np.int64)
        if parts is None:
            for i in range(min(width, size + 1)):
                enter = np.full(width, NEVER, np.int64)
                enter[i] = 0
                out[i] = self.chunk_path(codes, size, enter, None)[0]
            for i in range(size + 1, width):  # the piece takes the whole chunk and more
                out[i, i - size] = 0
            return out
        low, high = parts
        enter = np.full(width, NEVER, np.int64)
        enter[: min(low, width - 1) + 1] = 0
        head = np.full(width, NEVER, np.int64)
        if low < width:
            enter[low] = NEVER
            head[low] = 0
        head[np.flatnonzero(enter > NEVER)] = self.chunk_path(codes[:low], low, enter, None)[:, 0]
        middle = int(self.encode_codes(codes[low:high], np.array([0]))[2][0]) if high > low else 0
        start = np.full(width, NEVER, np.int64)
        start[0] = 0
        tail = self.chunk_path(codes[high:], size - high, start, None)[0]
        fits = (head[:, None] > NEVER // 2) & (tail[None, :] > NEVER // 2)
        return np.where(fits, head[:, None] + middle + tail[None, :], NEVER)

    def trace_chunk(self, codes: np.ndarray, size: int, enter: int, leave: int) -> np.ndarray:
        """The ids of the pieces that start in a chunk, between its two states."""
        state = np.full(self.longest, NEVER, np.int64)
        parts = self._parts(codes, size)
        if parts is None:
            if enter >= size:
                return np.empty(0, np.int32)
            state[enter] = 0
            return self.chunk_path(codes, size, state, leave)
        low, high = parts
        head = np.empty(0, np.int32)
        if enter < low:
            state[enter] = 0
            head = self.chunk_path(codes[:low], low, state, 0)
        middle = self.encode_codes(codes[low:high], np.array([0]))[0] if high > low else head[:0]
        start = np.full(self.longest, NEVER, np.int64)
        start[0] = 0
        return np.concatenate([head, middle, self.chunk_path(codes[high:], size - high, start, leave)])


def combined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The (max, +) product of two transfer matrices."""
    return np.maximum((left[:, :, None] + right[None, :, :]).max(axis=1), NEVER)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of matrices in their order, halves first: any grouping gives the same."""
    while len(matrices) > 1:
        pairs = [combined(*matrices[k : k + 2]) for k in range(0, len(matrices) - 1, 2)]
        matrices = pairs + matrices[len(matrices) & ~1 :]
    return matrices[0]


def border_states(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[int]:
    """The state at every border of consecutive chunks on their best path from one state to another (0 at both ends of
    a text). Forward, the states' best scores are matrix products; backward, the state that led to the next one, the
    smallest among equals."""
    width = len(matrices[0])
    reached = [np.where(np.arange(width) == enter, 0, NEVER)[None, :]]
    for matrix in matrices:
        reached.append(combined(reached[-1], matrix))
    states = [leave]
    for score, matrix in zip(reached[-2::-1], matrices[::-1]):
        states.append(int((score[0] + matrix[:, states[-1]]).argmax()))
    return states[::-1]


def marked(text: str) -> str:
    """A text as the library reads it: a space in front unless it is empty, spaces as marks."""
    return (MARK + text.replace(" ", MARK)) if text else ""


def as_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    return codes, np.cumsum(lengths) - lengths


class Decoder:
    """Texts of id sequences; ids outside the vocabulary and control ids stand for nothing."""

    def __init__(self, vocabulary: Pieces):
        plain = [p.replace(MARK, " ").encode() if isinstance(p, str) else (p or b"") for p in vocabulary.pieces]
        self.bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.sizes = np.array([len(p) for p in plain], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The UTF-8 bytes of id sequences laid end to end, each without the space in front, and their offsets."""
        valid = (ids >= 0) & (ids < len(self.sizes))
        sizes = np.where(valid, self.sizes[np.where(valid, ids, 0)], 0)
        ends = np.append(0, np.cumsum(sizes))
        starts = np.where(valid, self.starts[np.where(valid, ids, 0)], 0)
        flat = self.bytes[np.repeat(starts - ends[:-1], sizes) + np.arange(int(ends[-1]))]
        bounds = ends[offsets]
        first = bounds[:-1][(np.diff(bounds) > 0)]
        kept = np.ones(len(flat), bool)
        kept[first[flat[first] == 0x20]] = False
        return flat[kept].tobytes(), np.append(0, np.cumsum(kept))[bounds]


def encode_column(text: Column, vocabulary: Pieces) -> Column:
    """Ids of whole texts, each within one task; null for null."""

    encoder = Encoder(vocabulary)  # its tables travel with the tasks

    @F.arrow_udf("array<int>")
    def encoded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            ids = encoder.encode([t or "" for t in column.to_pylist()])
            offsets = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=column.is_null())

    return encoded(text)


def decode_column(ids: Column, vocabulary: Pieces) -> Column:
    """Texts of arrays of ids; null for null, and null elements stand for nothing."""

    decoder = Decoder(vocabulary)

    @F.arrow_udf("string")
    def decoded(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in arrays:
            lists = column.fill_null([]) if column.null_count else column
            offsets = lists.offsets.to_numpy()
            flat = lists.values.fill_null(-1).to_numpy()[offsets[0] : offsets[-1]]
            data, bounds = decoder.decode(flat, offsets - offsets[0])
            parts = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
            yield pa.array(parts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))

    return decoded(ids)


def encode_giant(rows: DataFrame, vocabulary: Pieces, chunk: int = CHUNK, together: int = TOGETHER) -> DataFrame:
    """(row, ids) for texts of any length, from ``rows`` (columns row and text). Each chunk gives its matrix; the
    matrices of ``together`` neighbouring chunks are multiplied, then these products along each text, which tells the
    states between them; from there the states inside each run of chunks follow on their own, and each chunk's ids. A
    task holds a chunk's characters, or as many matrices of 2 KB as a run has chunks or a text has runs, or a text's
    ids."""
    width = max(len(p) for p in vocabulary.pieces if isinstance(p, str))

    @F.arrow_udf("array<string>")
    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = ((marked(t), range(0, len(t) + 1, chunk)) for t in column.to_pylist())
            yield pa.array([[t[k : k + chunk + width - 1] for k in places if k < len(t)] for t, places in parts], pa.list_(pa.string()))

    pieces = rows.select("row", F.posexplode(cut("text")).alias("part", "text"), (F.length("text") + 1).alias("chars"))
    size = F.least(F.lit(chunk), F.col("chars") - F.col("part") * chunk).cast("int")
    pieces = written(pieces.select("row", "part", size.alias("size"), "text"))

    encoder = Encoder(vocabulary)

    @F.arrow_udf("binary")
    def matrix(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, sizes in texts:
            out = [encoder.transfer(as_codes([t])[0], size).tobytes() for t, size in zip(column.to_pylist(), sizes.to_pylist())]
            yield pa.array(out, pa.binary())

    def in_order(part: pa.Table, by: str) -> tuple[pa.Table, list[np.ndarray]]:
        part = part.sort_by(by)
        return part, [np.frombuffer(m, np.int64).reshape(width, width) for m in part["matrix"].to_pylist()]

    def multiplied(part: pa.Table) -> pa.Table:
        part, matrices = in_order(part, "part")
        return pa.table({"row": part["row"][:1], "run": part["run"][:1], "matrix": pa.array([product(matrices).tobytes()], pa.binary())})

    def between(part: pa.Table) -> pa.Table:
        part, matrices = in_order(part, "run")
        at = border_states(matrices)
        return pa.table({"row": part["row"], "run": part["run"], "first": pa.array(at[:-1], pa.int32()), "last": pa.array(at[1:], pa.int32())})

    def inside(part: pa.Table) -> pa.Table:
        part, matrices = in_order(part, "part")
        at = border_states(matrices, part["first"][0].as_py(), part["last"][0].as_py())
        return pa.table({"row": part["row"], "part": part["part"], "enter": pa.array(at[:-1], pa.int32()), "leave": pa.array(at[1:], pa.int32())})

    run = F.floor(F.col("part") / together).cast("int")
    matrices = written(pieces.select("row", "part", run.alias("run"), matrix("text", "size").alias("matrix")))
    products = matrices.groupBy("row", "run").applyInArrow(multiplied, "row string, run int, matrix binary")
    borders = products.groupBy("row").applyInArrow(between, "row string, run int, first int, last int")
    known = matrices.join(borders, ["row", "run"]).groupBy("row", "run").applyInArrow(inside, "row string, part int, enter int, leave int")

    @F.arrow_udf("array<int>")
    def traced(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for column, sizes, enter, leave in columns:
            rows = zip(column.to_pylist(), sizes.to_pylist(), enter.to_pylist(), leave.to_pylist())
            yield pa.array([encoder.trace_chunk(as_codes([t])[0], n, a, b) for t, n, a, b in rows], pa.list_(pa.int32()))

    ids = pieces.join(known, ["row", "part"]).select("row", "part", traced("text", "size", "enter", "leave").alias("ids"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "ids")))
    return ids.groupBy("row").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def encoded(docs: DataFrame, vocabulary: Pieces, text: str = "text", name: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` with the ids of their whole text added as ``name`` (which must be a free name).

    A null text has null ids, an empty one none. Texts of up to ``chunk`` characters are solved at once, longer
    ones by chunks; the best score is the same, and so are the ids unless there are equally good paths at a border.
    Repeated rows and columns of any name do no harm. The mark U+2581 in a text reads as a space.
    """
    small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = docs.select(row, F.col(text).alias("text"))
    giant = F.coalesce(F.length("text") >= chunk, F.lit(False))
    short = held.where(~giant).select("row", encode_column(F.col("text"), vocabulary).alias("ids"))
    # Equal giant texts are solved once, under the digest of their text.
    digest = F.sha2(F.col("text").cast("binary"), 256)
    long = written(held.where(giant).withColumn("digest", digest))
    solved = encode_giant(long.select(F.col("digest").alias("row"), "text").dropDuplicates(["row"]), vocabulary, chunk)
    solved = long.join(solved.withColumnRenamed("row", "of"), F.col("digest") == F.col("of")).select("row", "ids")
    return short.union(solved).select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("ids").alias(name))


def round_trip(docs: DataFrame, vocabulary: Pieces, text: str = "text") -> DataFrame:
    """doc_id, ids, pieces (their number) and restored (whether decoding gives the text back, the mark read as a space)
    for every row of ``docs``."""
    both = encoded(docs.select("doc_id", F.col(text).alias("text")), vocabulary)
    back = both.withColumn("back", decode_column(F.col("ids"), vocabulary))
    restored = F.col("back").eqNullSafe(F.translate("text", MARK, " "))
    return back.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("pieces"), restored.alias("restored"))
