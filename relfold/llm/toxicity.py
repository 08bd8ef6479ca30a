"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy by the tasks.

Words are hashed to slots, slots to small vectors; filters of several widths slide over the vectors and each
filter keeps its largest response over the whole text. One head scores toxicity, a second one tells the
language, which picks the decision threshold: thresholds are calibrated for each language, and the score is
shifted so that 0.5 is the threshold of the text's own predicted language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from relfold.llm.common import free_name, labelled_rows, labelled_sample, small_batches, written
from relfold.llm.words import word_hashes

#: Bits of a word's slot. Slots without an embedding of their own share one.
SLOT_BITS = 24
WIDTHS = (1, 2, 3)
FILTERS, DEPTH = 16, 12
#: Words convolved together.
SPAN = 1 << 16
#: Texts of a step of training.
BATCH = 32
#: Labelled rows of a shard, of which each learns on its own between two averages.
SHARD = 1 << 13
#: Words that a task gathers and shuffles at a time.
BUFFER = 1 << 22
#: Words of a text convolved together in training, and rows of the embeddings averaged together.
BLOCK = 1 << 12
#: A slot gets an embedding if MIN_TEXTS of the counted texts hold it, and one in ONE_IN of them or so many that the slot
#: leans to a class by LEAN standard deviations. This bounds the size of the model, not what is counted; so does MOST.
MIN_TEXTS, ONE_IN, LEAN, MOST = 3, 1200, 5.0, 1 << 18


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


@dataclass
class ToxicityModel:
    """Sorted slots with an embedding, embeddings (row 0 pads, row 1 is every other word), filters of each width
    as (width, depth, filters), the toxicity head, the language head, thresholds and the slope of the score.
    Bounded by ONE_IN, LEAN and MOST."""

    slots: np.ndarray
    embeddings: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    head: np.ndarray
    languages: list[str] = field(default_factory=list)
    language_head: np.ndarray | None = None
    thresholds: np.ndarray | None = None
    slope: float = 1.0

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the embedding table for word hashes."""
        return self.rows_of_slots(slots_of(hashes))

    def rows_of_slots(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return np.ones(len(wanted), np.int32)
        at = np.minimum(np.searchsorted(self.slots, wanted), len(self.slots) - 1)
        return np.where(self.slots[at] == wanted, at + 2, 1).astype(np.int32)

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place in the filter, the filter's response to every embedding row."""
        return [[self.embeddings @ bank[k] for k in range(len(bank))] for bank in self.filters]

    def pooled(self, rows: np.ndarray, offsets: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        """The largest response of every filter over each whole text; texts are padded at both ends."""
        tables = tables or self.tables()
        texts = len(offsets) - 1
        out = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32)
        low = 0
        while low < texts:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SPAN, "right")) - 1)
            for i, (start, stop) in enumerate(_parts(offsets, low, high)):
                mine = offsets[low : high + 1] if high > low + 1 else np.array([start, stop])
                block = self._block(rows, mine, tables, start > offsets[low], stop < offsets[high])
                out[low:high] = np.maximum(out[low:high], block) if i else block
            low = high
        return out

    def _block(self, rows, offsets, tables, more_before: bool, more_after: bool) -> np.ndarray:
        pad = max(WIDTHS) - 1
        lengths = np.diff(offsets) + 2 * pad
        begins = np.cumsum(lengths) - lengths
        padded = np.zeros(int(lengths.sum()), np.int32)
        place = np.arange(int(offsets[-1] - offsets[0])) + np.repeat(begins + pad - (offsets[:-1] - offsets[0]), np.diff(offsets))
        padded[place] = rows[offsets[0] : offsets[-1]]
        if more_before:  # a part of one giant text: its neighbours are the words before and after
            padded[:pad] = rows[offsets[0] - pad : offsets[0]]
        if more_after:
            after = rows[offsets[-1] : offsets[-1] + pad]
            padded[len(padded) - pad : len(padded) - pad + len(after)] = after
        out = []
        for places in tables:
            n = len(padded) - len(places) + 1
            response = places[0][padded[:n]]
            for k in range(1, len(places)):
                response += places[k][padded[k : k + n]]
            response[(begins[1:, None] - np.arange(1, len(places))).ravel()] = -np.inf  # these reach into the next text
            out.append(np.maximum.reduceat(response, begins, axis=0))
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def language_chances(self, pooled: np.ndarray) -> np.ndarray:
        return _softmax(_products(pooled, self.language_head[:-1]) + self.language_head[-1])

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        return _products(pooled, self.head[:-1, None])[:, 0] + self.head[-1]

    def shifted(self, pooled: np.ndarray) -> np.ndarray:
        """Margins less the threshold of the text's language."""
        margins = self.margins(pooled)
        if self.thresholds is None:
            return margins
        return margins - _products(self.language_chances(pooled), self.thresholds[:, None])[:, 0]

    def score(self, pooled: np.ndarray) -> np.ndarray:
        margin = self.shifted(pooled)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin, -40, 40)))


def _parts(offsets: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Word ranges to convolve: all of several texts, or a giant text in parts."""
    start, stop = int(offsets[low]), int(offsets[high])
    if high > low + 1 or stop - start <= SPAN:
        yield start, stop
        return
    for at in range(start, stop, SPAN):
        yield at, min(at + SPAN, stop)


def _products(features: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Features times head in double precision, added up row by row: equal texts get equal numbers in any batch."""
    features = features.astype(np.float64)
    return np.stack([(features * column).sum(axis=1) for column in head.T], axis=1)


def _softmax(margins: np.ndarray) -> np.ndarray:
    grown = np.exp(margins - margins.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


def first_model(slots: np.ndarray, with_word: tuple[np.ndarray, np.ndarray], texts: tuple[int, int], seed: int = 1) -> ToxicityModel:
    """A model before training: ``with_word`` tells how many texts of class 0 and 1 hold each slot, ``texts`` how many there
    are. The first component of an embedding starts at how far the slot's texts lean to a class, in standard deviations,
    the rest at random."""
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (len(slots) + 2, DEPTH)).astype(np.float32)
    embeddings[0] = 0
    filters = [rng.normal(0, 0.3 / w, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
    width = FILTERS * len(WIDTHS)
    model = ToxicityModel(slots, embeddings, filters, np.zeros(width, np.float32), rng.normal(0, 0.1, width + 1).astype(np.float32))
    model.head[-1] = 0
    share, held = texts[1] / sum(texts), with_word[0] + with_word[1]
    surprise = (with_word[1] - held * share) / np.sqrt(held * share * (1 - share) + 1)
    embeddings[2:, 0] = np.clip(surprise / 6, -1, 1)
    embeddings[:2, 0] = 0
    for bank in filters:  # half of the filters start by looking for words of either class
        bank[:, 0, : FILTERS // 4] += 1.0
        bank[:, 0, FILTERS // 4 : FILTERS // 2] -= 1.0
    return model


def slot_counts(texts: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The slots of the texts' slots, sorted, and how many texts of class 0 and 1 hold each."""
    found = [[np.unique(t) for t, y in zip(texts, labels) if y == c] + [np.empty(0, np.int32)] for c in (0, 1)]
    slots = np.unique(np.concatenate([np.concatenate(f) for f in found]))
    return slots, [np.bincount(np.searchsorted(slots, np.concatenate(f)), minlength=len(slots)) for f in found]


class Learner:
    """Adam on the log loss, batch by batch, from a copy of a model; gradients pass through the one place that each
    filter's maximum came from. A text of class 1 weighs ``balance`` times one of class 0. ``touched`` counts the batches
    that moved an embedding."""

    def __init__(self, model: ToxicityModel, rate: float, seed: int | list[int], balance: float = 1.0):
        self.model = replace(
            model, embeddings=model.embeddings.copy(), filters=[b.copy() for b in model.filters], bias=model.bias.copy(), head=model.head.copy()
        )
        self.rate, self.balance, self.rng, self.step, self.texts = rate, balance, np.random.default_rng(seed), 0, 0
        self.network = [*self.model.filters, self.model.bias, self.model.head]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in [*self.network, self.model.embeddings]]
        self.touched = np.zeros(len(model.embeddings), np.float32)

    def learn(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 1) -> None:
        self.texts += len(rows)
        for _ in range(epochs):
            order = self.rng.permutation(len(rows))
            for low in range(0, len(order), BATCH):
                batch = order[low : low + BATCH]
                gradients, words, moved = _gradients(self.model, [rows[i] for i in batch], labels[batch], self.balance)
                self.step += 1
                for p, g, (m, v) in zip(self.network, gradients, self.moments):
                    p -= self._change(g, m, v, slice(None))
                self.model.embeddings[words] -= self._change(moved, *self.moments[-1], words)
                self.touched[words] += 1

    def _change(self, g: np.ndarray, m: np.ndarray, v: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        m[at] += 0.1 * (g - m[at])
        v[at] += 0.01 * (g * g - v[at])
        return self.rate * (m[at] / (1 - 0.9**self.step)) / (np.sqrt(v[at] / (1 - 0.99**self.step)) + 1e-6)


def epochs_of(texts: int, rounds: int, steps: int) -> int:
    """How often texts are gone through: few texts more often, so that there are at least ``steps`` steps."""
    return max(rounds, -(-steps * BATCH // texts))


def train(
    texts: list[np.ndarray], labels: np.ndarray, min_texts: int = 3, rounds: int = 6, rate: float = 0.02, seed: int = 1, steps: int = 300
) -> ToxicityModel:
    """Train on texts at hand, given as word hashes. A slot gets an embedding if ``min_texts`` texts hold it."""
    short = [slots_of(t) for t in texts]
    slots, with_word = slot_counts(short, labels)
    often, sizes = sum(with_word) >= min_texts, tuple(int((labels == c).sum()) for c in (0, 1))
    model = first_model(slots[often], tuple(w[often] for w in with_word), sizes, seed)
    learner = Learner(model, rate, seed, sizes[0] / sizes[1])
    learner.learn([model.rows_of_slots(t) for t in short], labels, epochs_of(len(texts), rounds, steps))
    return learner.model


def _peaks(responses: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of every filter over a padded text, and its place. ``responses`` are those of each word to
    every place of the filters, side by side."""
    best, place = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32), np.zeros(FILTERS * len(WIDTHS), np.int64)
    pad = max(WIDTHS) - 1
    for start in range(0, len(text) - min(WIDTHS) + 1, BLOCK):
        block = responses[text[start : start + BLOCK + pad]]
        column = 0
        for w, width in enumerate(WIDTHS):
            n = min(BLOCK, len(text) - width + 1 - start)
            if n > 0:
                response = block[:n, column : column + FILTERS].copy()
                for k in range(1, width):
                    response += block[k : k + n, column + k * FILTERS : column + (k + 1) * FILTERS]
                at = response.argmax(axis=0)
                peak, mine = response[at, np.arange(FILTERS)], slice(w * FILTERS, (w + 1) * FILTERS)
                place[mine] = np.where(peak > best[mine], start + at, place[mine])
                best[mine] = np.maximum(peak, best[mine])
            column += width * FILTERS
    return best, place


def _gradients(model: ToxicityModel, rows: list[np.ndarray], labels: np.ndarray, balance: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of filters, bias and head, the embedding rows that get one, and theirs."""
    pad = np.zeros(max(WIDTHS) - 1, np.int32)
    padded = [np.concatenate([pad, r, pad]) for r in rows]
    begins = np.cumsum([0] + [len(t) for t in padded[:-1]])
    text = np.concatenate(padded)
    number = np.zeros(len(model.embeddings), np.int32)
    number[text] = 1
    used = np.flatnonzero(number)
    number[used] = np.arange(len(used))
    responses = model.embeddings[used] @ np.concatenate([bank[k] for bank in model.filters for k in range(len(bank))], axis=1)
    found = [_peaks(responses, number[t]) for t in padded]
    pooled, place = np.array([f[0] for f in found]), np.array([f[1] for f in found]) + begins[:, None]
    active = pooled + model.bias > 0
    features = np.where(active, pooled + model.bias, 0)
    chance = 1 / (1 + np.exp(-np.clip(features @ model.head[:-1] + model.head[-1], -30, 30)))
    weight = np.where(labels == 1, balance, 1.0)
    error = ((chance - labels) * weight / weight.sum()).astype(np.float32)
    head = np.append(features.T @ error, error.sum()).astype(np.float32) + 1e-4 * model.head
    back = (error[:, None] * model.head[None, :-1]) * active
    banks = [np.zeros_like(b) for b in model.filters]
    words, parts = [], []
    for w, bank in enumerate(model.filters):
        mine = slice(w * FILTERS, (w + 1) * FILTERS)
        g = back[:, mine]
        for k in range(len(bank)):
            at = text[place[:, mine] + k]
            banks[w][k] = (model.embeddings[at] * g[:, :, None]).sum(axis=0).T
            moved = (g != 0) & (at != 0)
            words.append(at[moved])
            parts.append((bank[k].T[None] * g[:, :, None])[moved])
    words, inverse = np.unique(np.concatenate(words), return_inverse=True)
    embeddings = np.zeros((len(words), DEPTH), np.float32)
    np.add.at(embeddings, inverse, np.concatenate(parts))
    return [*banks, back.sum(axis=0), head], words, embeddings


def best_threshold(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest weighted errors."""
    order = np.argsort(margins, kind="stable")
    m, y, w = margins[order], labels[order], weights[order]
    errors = np.concatenate([[0], np.cumsum(w * y)]) + np.concatenate([[0], np.cumsum((w * (1 - y))[::-1])])[::-1]
    edges = np.concatenate([[m[0] - 2], m, [m[-1] + 2]])
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    gap = max(best, key=lambda i: edges[i + 1] - edges[i])
    return float((edges[gap] + edges[gap + 1]) / 2)


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    packer = zstandard.ZstdDecompressor()
    return [np.frombuffer(packer.decompress(b.as_buffer()), np.int32) for b in batch["slots"]]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(batch[name].to_pylist())


def _pooled(model: ToxicityModel, tables: list[list[np.ndarray]], batch: pa.RecordBatch) -> np.ndarray:
    texts = _texts(batch)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return model.pooled(model.rows_of_slots(np.concatenate(texts)), offsets, tables)


def added(parts: DataFrame, kind: type = np.float64) -> dict[str, np.ndarray]:
    """Sums of arrays by key. ``parts`` has columns key, shard, start (in whose order they are added, so that reruns agree)
    and values, the bytes of an array of ``kind``. One task adds up a key's arrays as they stream by."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for key, values in zip(batch["key"].to_pylist(), batch["values"]):
                values = np.frombuffer(values.as_buffer(), kind)
                if key != last:
                    if last is not None:
                        yield pa.RecordBatch.from_pydict({"key": [last], "total": [total.tobytes()]})
                    last, total = key, np.zeros(len(values))
                total += values
        if last is not None:
            yield pa.RecordBatch.from_pydict({"key": [last], "total": [total.tobytes()]})

    ordered = parts.repartition("key").sortWithinPartitions("key", "shard", "start")
    return {r["key"]: np.frombuffer(r["total"]) for r in ordered.mapInArrow(sums, "key string, total binary").collect()}


_PARTS = "key string, shard int, start double, values binary"


def _part(batch: pa.RecordBatch, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Arrays to be added, in the place of the batch's first row."""
    shard, start = batch["shard"][0].as_py(), batch["part"][0].as_py()
    columns = {"key": list(arrays), "shard": [shard] * len(arrays), "start": [start] * len(arrays), "values": [a.tobytes() for a in arrays.values()]}
    return pa.RecordBatch.from_arrays([pa.array(columns["key"]), pa.array(columns["shard"], pa.int32()), pa.array(columns["start"], pa.float64()), pa.array(columns["values"], pa.binary())], list(columns))


def lean(zero: Column, one: Column, texts: tuple[int, int]) -> Column:
    """How far the texts that hold a slot lean to a class, in standard deviations, as first_model has it."""
    held, share = zero + one, texts[1] / sum(texts)
    return F.abs(one - held * share) / F.sqrt(held * (share * (1 - share)) + 1)


def count_slots(rows: DataFrame, texts: tuple[int, int]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The slots that get an embedding, and how many of all texts of each class hold them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, (zero, one) = slot_counts(_texts(batch), _column(batch, "label"))
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(zero, pa.int64()), pa.array(one, pa.int64())], ["slot", "zero", "one"])

    parts = rows.select("label", "slots").mapInArrow(counted, "slot int, zero bigint, one bigint")
    counts = parts.groupBy("slot").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).withColumn("held", F.col("zero") + F.col("one"))
    leans = lean(F.col("zero"), F.col("one"), texts) >= LEAN
    kept = counts.where((F.col("held") >= MIN_TEXTS) & ((F.col("held") * ONE_IN >= sum(texts)) | leans))
    found = kept.orderBy(leans.desc(), F.desc("held"), "slot").limit(MOST).toArrow().sort_by("slot")
    slots, zero, one = (found[c].to_numpy() for c in ("slot", "zero", "one"))
    return slots.astype(np.int32), (zero, one)


def train_round(rows: DataFrame, model: ToxicityModel, epochs: int, balance: float, rate: float, seed: int) -> ToxicityModel:
    """Every shard learns from its own rows, beginning at ``model``; the network becomes the mean of what they learnt, by
    their texts, and an embedding the mean over the shards that moved it, by how many of their batches did."""

    def results(batch: pa.RecordBatch, learner: Learner) -> pa.RecordBatch:
        network = np.concatenate([p.ravel() for p in learner.network])
        arrays = {"network": np.append(network * learner.texts, learner.texts).astype(np.float32)}
        for low in range(0, len(learner.touched), BLOCK):
            weight = learner.touched[low : low + BLOCK, None]
            if weight.any():
                arrays[str(low)] = np.hstack([learner.model.embeddings[low : low + BLOCK] * weight, weight])
        return _part(batch, arrays)

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, first, texts, labels, words = None, None, [], [], 0
        for batch in batches:
            shards = _column(batch, "shard")
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for low, high in zip(edges, edges[1:]):
                mine = batch.slice(low, high - low)
                if learner is None or first["shard"][0] != mine["shard"][0]:
                    if learner is not None:
                        if texts:
                            learner.learn(texts, np.array(labels, float), epochs)
                        yield results(first, learner)
                    first, texts, labels, words = mine.slice(0, 1), [], [], 0
                    learner = Learner(model, rate, [seed, first["shard"][0].as_py()], balance)
                for text, label in zip(_texts(mine), mine["label"].to_pylist()):
                    texts.append(model.rows_of_slots(text))
                    labels.append(label)
                    words += len(text)
                    if words > BUFFER:
                        learner.learn(texts, np.array(labels, float), epochs)
                        texts, labels, words = [], [], 0
        if learner is not None:
            if texts:
                learner.learn(texts, np.array(labels, float), epochs)
            yield results(first, learner)

    sums = added(rows.select("shard", "part", "label", "slots").mapInArrow(learnt, _PARTS), np.float32)
    after = Learner(model, rate, seed)
    network = sums.pop("network")
    network, at = network[:-1] / network[-1], 0
    for p in after.network:
        p[...] = network[at : at + p.size].reshape(p.shape)
        at += p.size
    for low, total in sums.items():
        total = total.reshape(-1, DEPTH + 1)
        moved = total[:, -1] > 0
        after.model.embeddings[int(low) : int(low) + BLOCK][moved] = total[moved, :-1] / total[moved, -1:]
    return after.model


def learn_languages(model: ToxicityModel, rows: DataFrame) -> None:
    """A softmax head over the pooled features of all texts with a language: the chances of languages whose features are
    normal around their means with one covariance, from counts, sums and products of one pass."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, first, sums = model.tables(), None, {}
        for batch in batches:
            names = np.array(batch["lang"].to_pylist(), object)
            x = np.hstack([_pooled(model, tables, batch), np.ones((len(names), 1))])
            first = first or batch.slice(0, 1)
            sums[""] = sums.get("", 0) + x.T @ x
            for name in sorted(set(names)):
                sums[f"={name}"] = sums.get(f"={name}", 0) + x[names == name].sum(axis=0)
        if sums:
            yield _part(first, sums)

    sums = added(rows.where("lang is not null").select("shard", "part", "lang", "slots").mapInArrow(moments, _PARTS))
    width = FILTERS * len(WIDTHS)
    products = sums.pop("", np.zeros((width + 1) ** 2)).reshape(width + 1, -1)
    model.languages = sorted(key[1:] for key in sums) or ["-"]
    model.language_head = np.zeros((width + 1, len(model.languages)))
    if not sums:
        return
    totals = np.array([sums[f"={name}"] for name in model.languages])
    counts, means = totals[:, -1], totals[:, :-1] / totals[:, -1:]
    spread = (products[:-1, :-1] - (means.T * counts) @ means) / counts.sum()
    spread += np.eye(width) * (1e-3 * np.trace(spread) / width + 1e-6)
    model.language_head[:-1] = np.linalg.solve(spread, means.T)
    model.language_head[-1] = np.log(counts / counts.sum()) - (means.T * model.language_head[:-1]).sum(axis=0) / 2


def best_cuts(margins: DataFrame) -> DataFrame:
    """For each ``guess`` the threshold with the fewest weighted errors, as best_threshold tells it, and its texts of either
    class, from columns guess, bin, margin, label and weight. A bin holds the numbers that share their first 16 bits, so
    a sorted group is of at most 65,536 distinct margins; bins are counted first, and each begins where those before end."""
    one, weight = F.col("label") == 1, F.col("weight")
    sums = [F.sum(F.when(one, weight).otherwise(0.0)).alias("one"), F.sum(F.when(one, 0.0).otherwise(weight)).alias("zero")]
    counts = [F.count_if(one).alias("ones"), F.count_if(~one).alias("zeros")]
    distinct = margins.groupBy("guess", "bin", "margin").agg(*sums, *counts)
    bins = distinct.groupBy("guess", "bin").agg(*[F.sum(c).alias(c) for c in ("one", "zero", "ones", "zeros")], F.min("margin").alias("first"))
    whole, along = Window.partitionBy("guess"), Window.partitionBy("guess").orderBy("bin")
    bins = bins.select(
        "guess",
        "bin",
        (F.sum("one").over(along) - F.col("one") + F.sum("zero").over(whole) - F.sum("zero").over(along) + F.col("zero")).alias("before"),
        F.lead("first").over(along).alias("after"),
        F.sum("ones").over(whole).alias("ones"),
        F.sum("zeros").over(whole).alias("zeros"),
        (F.row_number().over(along) == 1).alias("lowest"),
        "first",
    )
    inside = Window.partitionBy("guess", "bin").orderBy("margin")
    cuts = distinct.drop("ones", "zeros").join(bins, ["guess", "bin"]).select(
        "guess",
        "ones",
        "zeros",
        (F.col("before") + F.sum(F.col("one") - F.col("zero")).over(inside)).alias("errors"),
        F.col("margin").cast("double").alias("low"),
        F.coalesce(F.lead("margin").over(inside), "after", F.col("margin") + 2).cast("double").alias("high"),
    )
    first = bins.where("lowest").select("guess", "ones", "zeros", F.col("before").alias("errors"), (F.col("first").cast("double") - 2).alias("low"), F.col("first").cast("double").alias("high"))
    best = F.min(F.struct(F.round("errors", 6).alias("errors"), (F.col("low") - F.col("high")).alias("gap"), ((F.col("low") + F.col("high")) / 2).alias("cut")))
    return cuts.unionByName(first).groupBy("guess").agg(best["cut"].alias("cut"), F.max("ones").alias("ones"), F.max("zeros").alias("zeros"))


def set_thresholds(model: ToxicityModel, rows: DataFrame, least: int = 30) -> None:
    """Calibrate one threshold for each predicted language on all ``rows``, over all texts where a language has fewer than
    ``least`` texts of either class, and the slope of the score around it."""

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            pooled = _pooled(model, tables, batch)
            m = model.margins(pooled).astype(np.float32) + np.float32(0)
            bits = m.view(np.int32)
            bins = np.where(bits < 0, bits ^ np.int32(0x7FFFFFFF), bits) >> 16  # rises with the margin
            guess = model.language_chances(pooled).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(guess, pa.int32()), pa.array(bins, pa.int32()), pa.array(m), batch["label"], batch["weight"]], ["guess", "bin", "margin", "label", "weight"])

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, first, total = model.tables(), None, np.zeros(len(slopes))
        for batch in batches:
            first = first or batch.slice(0, 1)
            pooled = _pooled(model, tables, batch)
            shifted = model.shifted(pooled)
            signed, weight = np.where(_column(batch, "label") == 1, -shifted, shifted), _column(batch, "weight")
            total += [(weight * np.logaddexp(0, s * signed)).sum() for s in slopes]
        if first:
            yield _part(first, {"": total})

    every = rows.select("label", "weight", "slots").mapInArrow(margins, "guess int, bin int, margin float, label int, weight double")
    found = {r["guess"]: r for r in best_cuts(every.withColumn("guess", F.explode(F.array("guess", F.lit(-1))))).collect()}
    model.thresholds = np.full(len(model.languages), found[-1]["cut"])
    for k, r in found.items():
        if k >= 0 and min(r["ones"], r["zeros"]) >= least:
            model.thresholds[k] = r["cut"]
    slopes = [0.25 * 1.4**k for k in range(16)]
    loss = added(rows.select("shard", "part", "label", "weight", "slots").mapInArrow(losses, _PARTS))[""]
    model.slope = float(slopes[int(loss.argmin())])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", lang: str = "lang", per_class: int | None = None, rounds: int = 6
) -> ToxicityModel | None:
    """Learn from every labelled row that is not held out; None unless both classes occur. Three quarters of them, by a
    hash of doc_id, are counted and train the network, the others calibrate; languages, which are only ever targets, are
    learnt from all. Word slots, packed text by text, are what the join to the labels sends; they are written once in
    shards of about SHARD rows, which learn side by side and are averaged after each round. The driver holds the model and
    sums of its size, no rows. ``per_class`` bounds the rows of a class by a repeatable draw, for trials."""
    small_batches(docs.sparkSession)
    name = (F.col(f"`{lang}`") if lang in docs.columns else F.lit(None)).cast("string").alias("lang")

    @F.arrow_udf("slots binary, words bigint")
    def hashed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packer = zstandard.ZstdCompressor()
        for column in texts:
            hashes, offsets = word_hashes(column)
            short = slots_of(hashes)
            packed = pa.array([packer.compress(short[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])], pa.binary())
            yield pa.StructArray.from_arrays([packed, pa.array(np.diff(offsets), pa.int64())], ["slots", "words"])

    found = hashed("text").alias("found")
    if per_class:
        rows = labelled_sample(docs, labels, label, per_class, name).select("*", found)
    else:
        rows = labelled_rows(docs, labels, label, name, found)
    fit = F.col("part") < 0.75
    tallies = {(r["label"], r["fit"]): r["n"] for r in rows.groupBy("label", fit.alias("fit")).agg(F.count("*").alias("n")).collect()}
    if {c for c, _ in tallies} != {0, 1}:
        return None
    both = {f for f in (True, False) if all((c, f) in tallies for c in (0, 1))}
    fit, check = fit if True in both else F.lit(True), ~fit if False in both else F.lit(True)
    sizes = tuple(sum(n for (c, f), n in tallies.items() if c == k and (f or True not in both)) for k in (0, 1))

    shards = -(-sum(sizes) // SHARD)
    shard = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("shard")), F.lit(shards)).cast("int").alias("shard")
    slots = rows.select(shard, "part", "doc_id", "label", "weight", "lang", "found.slots", "found.words")
    dealt = slots.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "part", "doc_id", F.xxhash64("slots"))
    rows = written(dealt, compression="zstd")
    words = rows.where(fit).agg(F.sum("words")).first()[0]

    model = first_model(*count_slots(rows.where(fit), sizes), sizes)
    epochs, meetings = epochs_of(sum(sizes), rounds, 300), 1 if shards == 1 and words <= BUFFER else rounds
    for k in range(meetings):
        model = train_round(rows.where(fit), model, -(-epochs // meetings), sizes[0] / sizes[1], 0.02, k + 1)
    learn_languages(model, rows)
    set_thresholds(model, rows.where(check))
    return model


def toxicity_score(text: Column, model: ToxicityModel | None) -> Column:
    """A number from 0 to 1 for every whole text, 0.5 being the threshold of its predicted language. Null and empty
    texts are scored as texts without words; 0 if nothing was learnt."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = model.tables()
        for column in texts:
            hashes, offsets = word_hashes(column)
            yield pa.array(model.score(model.pooled(model.rows(hashes), offsets, tables)))

    return scored(text)


def with_toxicity(docs: DataFrame, model: ToxicityModel | None, name: str = "score", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the toxicity of their whole text added as ``name``, with underscores in front until no
    column is called so. Null, empty and repeated texts are scored like others; an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, name), toxicity_score(F.col(f"`{text}`"), model))
