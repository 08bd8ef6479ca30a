"""Words of texts as 64-bit hashes, whole Arrow columns at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes looked at together; bounds the working memory for texts of any length.
SPAN = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[ord("a") : ord("z") + 1] = True
    table[ord("0") : ord("9") + 1] = True
    table[0x80:] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null as empty) and where each text begins and ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[: offsets[-1]] if len(offsets) else data, offsets


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text in order, and the index at which each text's words begin, with the end.

    A word is a longest run of letters and digits after lower-casing; every character outside ASCII counts
    as a letter. Nothing else of a text matters.
    """
    column = pc.utf8_lower(column.cast(pa.large_string()))
    data, offsets = text_bytes(column)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    inside = _word_bytes()
    found, starts, at, end = [], [], int(offsets[0]) if len(offsets) else 0, len(data)
    while at < end:
        stop = min(at + SPAN, end)
        if stop < end:  # cut where no word is cut
            gaps = np.flatnonzero(~inside[data[at:stop]] | begins[at:stop])
            if len(gaps) and gaps[-1] > 0:
                stop = at + int(gaps[-1])
            else:
                more = np.flatnonzero(~inside[data[stop:]] | begins[stop:end])
                stop = stop + int(more[0]) if len(more) else end
        part = data[at:stop]
        word = inside[part]
        first = word.copy()
        first[1:] &= ~word[:-1] | begins[at + 1 : stop]
        index = np.flatnonzero(word)
        if len(index):
            first_at = np.flatnonzero(first)
            lead = np.flatnonzero(first[index])
            length = np.diff(np.append(lead, len(index)))
            position = np.arange(len(index)) - np.repeat(lead, length)
            share = (part[index].astype(np.uint64) + np.uint64(1)) * powers(_MULTIPLIER, int(length.max()))[position]
            found.append(mix(np.add.reduceat(share, lead)))
            starts.append(first_at + at)
        at = stop
    hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
    places = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return hashes, np.searchsorted(places, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words of one text; of all its words, if it has fewer."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    count = len(hashes) - size + 1
    total = np.zeros(count, np.uint64)
    for k, power in enumerate(powers(np.uint64(0xA24BAED4963EE407), size)):
        total += hashes[k : k + count] * power
    return np.unique(mix(total + np.uint64(size)))
