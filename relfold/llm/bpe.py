"""Byte-pair encoding in linear time, and decoding.

A text is cut into words by the vocabulary's pattern. Within a word the encoder walks from left to right: at each place
it takes the longest token that begins there (found for all places by one Aho-Corasick pass over the reversed bytes)
and that may stand after the token before it; if none may, the place is a dead end, the token before is taken back and
a shorter one tried. A token may stand after another if merging would leave exactly these two: no merge across their
border comes before both sides have been built. Where all neighbours are compatible, the tokens are those that the
merges give, and no place is a dead end twice, so the work grows with the word's length.

Decoding looks up each id's place and size in one table of bytes and gathers them, whole columns at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import pre_tokenizers

from relfold.llm.common import free_name, small_batches

#: Characters that are cut into words together, and bytes of a word that are searched together.
WINDOW, BLOCK = 1 << 20, 1 << 16
#: Words whose ids a task remembers, and the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 1 << 18, 64
#: Matches at a window's end that may look different with the next characters: one that goes on, and a contraction.
UNSURE = 3

# The pattern of words of byte-level vocabularies, with its classes left open. What begins with a letter
# or a space comes first; no other part begins so, but for white space.
WORDS = r" ?{letter}+|'s|'t|'re|'ve|'m|'ll|'d| ?{number}+| ?{other}+|{space}+(?!{solid})|{space}+"
# The same classes among the characters below U+0100, which a plainer engine finds faster.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"

#: Rank of what is never merged into anything.
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(1)
def newer_characters() -> str:
    """Letters and numbers that ``regex`` knows and the tokenizers library does not yet, as a character class. Only
    characters that Python's own table lacks can be such, so these few are tried with the library."""
    import unicodedata

    spaces = [c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn"]
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    pairs = [(c, "a") for c in regex.findall(r"\p{L}", "".join(spaces))] + [(c, "1") for c in regex.findall(r"\p{N}", "".join(spaces))]
    codes = sorted(ord(c) for c, like in pairs if len(cut(like + c)) > 1)
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@dataclass(frozen=True)
class BytePairs:
    """``tokens``: bytes by id (None: no token); ``merges``: (left, right, result) in the order in which they apply;
    ``added``: texts that are one token wherever they stand; ``newer``: characters that count as neither letter nor
    number, as a class."""

    tokens: tuple[bytes | None, ...]
    merges: tuple[tuple[int, int, int], ...]
    added: tuple[tuple[str, int], ...]
    newer: str


def load_byte_pairs(path: str) -> BytePairs:
    """A byte-level BPE vocabulary from a tokenizers JSON file, read on the driver; it travels with the tasks."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or not plain or odd or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    alphabet = byte_alphabet()
    added = {a["content"]: a["id"] for a in spec["added_tokens"]}
    tokens: list[bytes | None] = [None] * (1 + max([*model["vocab"].values(), *added.values()]))
    for text, i in model["vocab"].items():
        tokens[i] = bytes(alphabet[c] for c in text)
    for text, i in added.items():
        tokens[i] = text.encode()
    merges = []
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((model["vocab"][left], model["vocab"][right], model["vocab"][left + right]))
    if len({m[2] for m in merges}) < len(merges):
        raise ValueError(f"{path} has tokens that are the result of two merges")
    return BytePairs(tuple(tokens), tuple(merges), tuple(added.items()), newer_characters())


class Encoder:
    """Ids of texts. Only the vocabulary travels; the tables are built where it is first used, once per task."""

    def __init__(self, vocabulary: BytePairs):
        self.vocabulary = vocabulary

    def __getstate__(self):
        return {"vocabulary": self.vocabulary}

    @cached_property
    def _tables(self):
        words = self.vocabulary
        special = {i for _, i in words.added}
        self.sizes = [len(t) if t is not None else 0 for t in words.tokens]
        self.rank_of: dict[int, dict[int, int]] = {}
        for rank, (a, b, _) in enumerate(words.merges):
            self.rank_of.setdefault(a, {})[b] = rank
        self.parts = {c: (a, b, rank) for rank, (a, b, c) in enumerate(words.merges)}
        # Tokens that no merge makes, other than single bytes, never come out of the merges.
        index = {t: i for i, t in enumerate(words.tokens) if t is not None and i not in special and (len(t) == 1 or i in self.parts)}
        if any(bytes([b]) not in index for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.longest_size = max(map(len, index))
        self.shorter = [-1] * len(words.tokens)
        automaton = ahocorasick.Automaton()
        for token, i in index.items():
            self.shorter[i] = next((index[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in index), -1)
            automaton.add_word(token[::-1].decode("latin-1"), i)
        automaton.make_automaton()
        self.edges = [[None] * len(words.tokens) for _ in range(2)]
        self.known = _Words(self)
        self.fits: dict[int, bool] = {}
        self.latin = re.compile(
            WORDS.format(letter=f"[{LETTER}]", number=f"[{NUMBER}]", other=f"[^{SPACE}{LETTER}{NUMBER}]", space=f"[{SPACE}]", solid=f"[^{SPACE}]")
        )
        space = {"space": r"\s", "solid": r"\S"}
        self.plain = regex.compile(WORDS.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]", **space))
        new = words.newer
        strict = WORDS.format(letter=rf"[\p{{L}}--[{new}]]", number=rf"[\p{{N}}--[{new}]]", other=rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])", **space)
        self.strict = regex.compile("(?V1)" + strict) if new else self.plain
        self.newer = re.compile(f"[{new}]") if new else re.compile("(?!)")
        contents = sorted((re.escape(text) for text, _ in words.added), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(contents)})") if contents else None
        self.added_ids = dict(words.added)
        return automaton

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [self.encode_text(t) for t in texts]

    def encode_text(self, text: str) -> np.ndarray:
        """The ids of a whole text. Only a window's words are held at a time, besides the ids."""
        self._tables
        if self.added is None or not any(a in text for a in self.added_ids):
            found = self._segment(text)
        else:
            found = []
            for k, part in enumerate(self.added.split(text)):
                found += [np.array([self.added_ids[part]], np.uint32)] if k % 2 else self._segment(part)
        return np.concatenate(found) if found else np.empty(0, np.uint32)

    def _segment(self, text: str) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32) for words in self.words(text)]

    def _pattern(self, text: str):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.strict if self.newer.search(text) else self.plain
        return self.latin

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, a window at a time; a word longer than a window makes the window grow."""
        self._tables
        pattern = self._pattern(text)
        at, end, span = 0, len(text), WINDOW
        while at < end:
            stop = min(at + span, end)
            found = pattern.findall(text, at, stop)
            if stop < end:
                if len(found) <= UNSURE:
                    span *= 2
                    continue
                stop -= sum(map(len, found[-UNSURE:]))
                del found[-UNSURE:]
            yield found
            at, span = stop, WINDOW

    def search(self, data: bytes) -> list[int]:
        """The longest token that begins at each place, from one pass over the reversed bytes."""
        out = [-1] * len(data)
        last, before = len(data) - 1, -1
        # Of the matches that end at one place of the reversed bytes, the longest comes first.
        for end, token in self._tables.iter(data[::-1].decode("latin-1")):
            if end != before:
                out[last - end] = token
                before = end
        return out

    def backtrack(self, data: bytes) -> list[int]:
        """The tokens that the merges make of a word's bytes. A long word is searched block by block."""
        self._tables
        first: Sequence[int] = self.search(data) if len(data) <= BLOCK else Blocks(self, data)
        size = len(data)
        out: list[int] = []
        if not size:
            return out
        sizes, shorter, fits = self.sizes, self.shorter, self.fits
        dead: set[int] = set()
        place, before, token = 0, -1, first[0]
        while place < size:
            while token >= 0:
                end = place + sizes[token]
                if end not in dead:
                    if before < 0:
                        break
                    good = fits.get(before << 32 | token)
                    if good if good is not None else self.compatible(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                place, before = end, token
                token = first[place] if place < size else -1
            else:
                dead.add(place)
                token = out.pop()
                place -= sizes[token]
                before = out[-1] if out else -1
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave two tokens as they are when their bytes stand side by side; remembered by pair."""
        self._tables
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= 4 * REMEMBERED:
                self.fits.clear()
            known = self.fits[pair] = self._compatible(left, right)
        return known

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of a token while it is built, each with the rank of the merge that takes
        it up."""
        out = self.edges[side][token]
        if out is None:
            out, until, at = [(token, NEVER)], NEVER, token
            while at in self.parts:
                until = self.parts[at][2]
                at = self.parts[at][side]
                out.append((at, until))
            self.edges[side][token] = out
        return out

    def _compatible(self, left: int, right: int) -> bool:
        rights = self._edge(right, 0)
        for a, a_until in self._edge(left, 1):
            ranks = self.rank_of.get(a)
            if ranks:
                for b, b_until in rights:
                    # Of equal merges the leftmost is done first: the one on the left's side before, that on the right's after.
                    rank = ranks.get(b)
                    if rank is not None and rank < a_until and rank <= b_until:
                        return False
        return True


class _Words(dict):
    """The packed ids of words, found when first asked for. A part is forgotten once there are many; words that come
    again soon stay, as the half that was asked for last is kept."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.encoder.backtrack(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Blocks:
    """The longest tokens of a word's places; two blocks are held at a time, as a walk goes back by a few tokens only
    and what it left can be found again."""

    def __init__(self, encoder: Encoder, data: bytes):
        self.encoder, self.data, self.held = encoder, data, {}

    def __getitem__(self, place: int) -> int:
        k, at = divmod(place, BLOCK)
        if k not in self.held:
            if len(self.held) == 2:
                del self.held[max(self.held, key=lambda b: abs(b - k))]
            part = self.data[k * BLOCK : (k + 1) * BLOCK + self.encoder.longest_size]
            self.held[k] = self.encoder.search(part)[:BLOCK]
        return self.held[k][at]


class Decoder:
    """Bytes of ids from one table; ids outside the vocabulary stand for nothing."""

    def __init__(self, vocabulary: BytePairs):
        plain = [t or b"" for t in vocabulary.tokens]
        self.bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.sizes = np.array([len(t) for t in plain], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; bytes that are no characters become U+FFFD."""
        parts = []
        for at in range(0, len(ids), WINDOW):
            some = ids[at : at + WINDOW].astype(np.int64)
            some = some[(some >= 0) & (some < len(self.sizes))]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            parts.append(self.bytes[np.repeat(self.starts[some] - (ends - sizes), sizes) + np.arange(total)].tobytes())
        data = b"".join(parts)
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode()
        return data


def encode_column(text: Column, vocabulary: BytePairs) -> Column:
    """Ids of whole texts as array<int>; null for null."""
    encoder = Encoder(vocabulary)

    @F.arrow_udf("array<int>")
    def encoded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            ids = encoder.encode([t or "" for t in column.to_pylist()])
            offsets = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=column.is_null())

    return encoded(text)


def decode_column(ids: Column, vocabulary: BytePairs) -> Column:
    """Texts of arrays of ids; null for null, and null elements stand for nothing."""
    decoder = Decoder(vocabulary)

    @F.arrow_udf("string")
    def decoded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            lists = (None if i is None else np.array([-1 if x is None else x for x in i], np.int64) for i in column.to_pylist())
            yield pa.array([None if i is None else decoder.decode(i).decode() for i in lists], pa.string())

    return decoded(ids)


def encoded(docs: DataFrame, vocabulary: BytePairs, text: str = "text", name: str = "ids") -> DataFrame:
    """The rows of ``docs`` with the ids of their whole text added as ``name`` (underscores in front until it is free).

    Null texts have null ids, empty ones none; repeated rows stay, an empty table gives an empty one. Texts are read
    in windows, so besides the text and its ids little is held.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, name), encode_column(F.col(f"`{text}`"), vocabulary))


def round_trip(docs: DataFrame, vocabulary: BytePairs, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the
    text that they decode to, in UTF-8) for every row of ``docs``. A null text is read as an empty one."""
    small_batches(docs.sparkSession)
    encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            sizes, coded, restored = [], [], []
            for value in column:
                ids = encoder.encode_text(value.as_py() or "")
                sizes.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                restored.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(v, t) for v, (_, t) in zip((sizes, coded, restored), fields)], names=[n for n, _ in fields])

    found = digests(F.col(f"`{text}`"))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.n_tokens", "found.ids_sha256", "found.decoded_sha256")
