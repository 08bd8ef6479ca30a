"""Boosted trees of two classes, all rounds in one job.

Rows are binned once and dealt to tasks, which hold them as packed bins for all rounds. A tree grows level by level: each
task sums its rows into histograms of (node, feature, bin), the tasks hand them to each other, and all of them take the
same splits from the same sums. No job is started per level or round. Tasks of one barrier stage run side by side; as the
barrier's own messages take a second each, histograms are handed on as files in the shared folder.

Loss, splits and leaves are those of Spark's ``GBTClassifier`` without subsampling: log loss of labels -1 and 1, the first
tree on the labels themselves, then trees on the residuals with the learning rate as weight; variance as impurity, at most
32 bins a feature, no split without gain. Borders of bins come from all rows, not from a draw.
"""

from __future__ import annotations

import os
import pickle
import shutil
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession, functions as F

from relfold.session import shared_folder

# Bins of a feature, as in Spark's trees, and the values kept of one whose borders are sought.
BINS = 32
KEPT_VALUES = 1024
#: Tasks whose values are merged at a time; different weights, as those of classes, whose rows are sorted apart.
MERGED, FEW_WEIGHTS = 256, 4
#: Rows that a task gets at least, before more tasks take part; rows that are summed at a time; rows that are sorted at a time.
ROWS_PER_TASK, BLOCK, CHUNK = 1 << 18, 1 << 15, 1 << 17
#: Bits of features that are counted together: one pass over their joint bins gives the histograms of all of them.
JOINT_BITS = 10
#: Share of a node's squared sums below which a gain is the rounding of sums.
ROUNDING = 1e-10


@dataclass(frozen=True)
class Tree:
    """Nodes in order of their level; rows in bins up to ``cut`` go to ``left``, others to the node after it. Leaves have
    feature -1. ``gain`` is the loss of squared error."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The value for each row of (rows, features)."""
        node = np.zeros(len(bins), np.int64)
        flat, first = bins.reshape(-1), np.arange(len(bins)) * bins.shape[1]
        inner = self.feature >= 0
        feature, cut = np.where(inner, self.feature, 0), np.where(inner, self.cut, BINS)
        while inner[node].any():
            node = self.left[node] + (flat[first + feature[node]] > cut[node])
        return self.value[node]


@dataclass(frozen=True)
class BoostedTrees:
    """The names are those of Spark's model of boosted trees."""

    borders: list[np.ndarray]
    trees: list[Tree]
    learning_rate: float
    weight: str | None = None

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.trees)

    @property
    def treeWeights(self) -> list[float]:  # noqa: N802
        return [_tree_weight(k, self.learning_rate) for k in range(len(self.trees))]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Each feature's share of all gains."""
        gains = np.zeros(len(self.borders))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(gains, tree.feature[inner], tree.gain[inner])
        return DenseVector(gains / (gains.sum() or 1.0))

    def first(self, rounds: int) -> "BoostedTrees":
        return replace(self, trees=self.trees[:rounds])

    def _margins(self, values: pa.Array) -> Iterator[np.ndarray]:
        """The margin of each row after each round; the same array each time."""
        bins = _binned(_matrix(values, len(self.borders)), self.borders)
        margin = np.zeros(len(bins))
        for tree, weight in zip(self.trees, self.treeWeights):
            margin += weight * tree.leaves(bins)
            yield margin

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with rawPrediction, probability and prediction of its ``features``."""

        @F.arrow_udf("double")
        def margin(values: pa.Array) -> pa.Array:
            last = np.zeros(len(values))
            for last in self._margins(values):
                pass
            return pa.array(last)

        m, one = F.col("__margin"), F.lit(1.0)
        chance = one / (one + F.exp(m * -2.0))
        return df.withColumn("__margin", margin(vector_to_array("features"))).withColumns({
            "rawPrediction": array_to_vector(F.array(-m, m)),
            "probability": array_to_vector(F.array(one - chance, chance)),
            "prediction": F.when(m > 0, 1.0).otherwise(0.0),
        }).drop("__margin")

    def evaluateEachIteration(self, vectors: DataFrame) -> list[float]:  # noqa: N802
        """The mean loss of the rows after each round."""

        def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, rows = np.zeros(len(self.trees)), 0.0
            for batch in batches:
                sign, weight = _signs(batch)
                rows += weight.sum()
                for k, margin in enumerate(self._margins(batch.column(0))):
                    sums[k] += (weight * np.logaddexp(0.0, -2.0 * sign * margin)).sum() * 2.0
            yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()], "n": [rows]})

        found = _inputs(vectors, self.weight).mapInArrow(losses, "sums binary, n double").collect()
        total = sum(r["n"] for r in found)
        if not total:
            raise ValueError("there are no rows to evaluate the rounds on")
        return list(sum(np.frombuffer(r["sums"]) for r in found) / total)


def _tree_weight(k: int, learning_rate: float) -> float:
    return learning_rate if k else 1.0


def _inputs(vectors: DataFrame, weight: str | None) -> DataFrame:
    given = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return vectors.select(vector_to_array("features").alias("x"), F.col("__label").cast("double").alias("y"), given.alias("w"))


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), width)


def _signs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Labels as -1 and 1, and weights."""
    label, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
    if batch.column(1).null_count or not ((label == 0) | (label == 1)).all():
        raise ValueError("labels must be 0 or 1")
    if batch.column(2).null_count or not (np.isfinite(weight) & (weight >= 0)).all():
        raise ValueError("weights must be numbers from 0 on")
    return label * 2.0 - 1.0, weight


# Borders of bins.


@dataclass(frozen=True)
class _Values:
    """Values in order and their weights; ``whole`` if none is left out, else each stands for those before it, too."""

    values: np.ndarray
    weights: np.ndarray
    whole: bool

    @classmethod
    def of(cls, values: np.ndarray, weights: np.ndarray, whole: bool = True) -> "_Values":
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return cls._kept(values[first], np.add.reduceat(weights, first), whole)

    @classmethod
    def of_even(cls, values: np.ndarray, weight: float) -> "_Values":
        """Of rows with one weight, which are sorted by their values alone."""
        values = np.sort(values)
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return cls._kept(values[first], np.diff(first, append=len(values)) * weight, True)

    @classmethod
    def _kept(cls, values: np.ndarray, weights: np.ndarray, whole: bool) -> "_Values":
        if len(values) > KEPT_VALUES:
            place = np.cumsum(weights)
            share = np.minimum(place / (place[-1] or 1.0) * KEPT_VALUES, KEPT_VALUES - 1).astype(np.int64)
            last = np.flatnonzero(np.concatenate([share[1:] != share[:-1], [True]]))
            values, weights, whole = values[last], np.diff(place[last], prepend=0.0), False
        return cls(values, weights, whole)

    @classmethod
    def merged(cls, parts: Sequence["_Values"]) -> "_Values":
        if len(parts) == 1:
            return parts[0]
        return cls.of(np.concatenate([p.values for p in parts]), np.concatenate([p.weights for p in parts]), all(p.whole for p in parts))

    def borders(self, bins: int = BINS) -> np.ndarray:
        """Between all values, if there are no more than bins, else where the running weight is nearest to equal shares."""
        middles = self.values[:-1] / 2.0 + self.values[1:] / 2.0
        if len(self.values) <= bins:
            return middles
        stride = self.weights.sum() / bins
        found, target, current = [], stride, self.weights[0]
        for middle, weight in zip(middles, self.weights[1:]):
            before, current = current, current + weight
            if abs(before - target) < abs(current - target):
                found.append(middle)
                target += stride
        return np.array(found[: bins - 1])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: the rows and the values of each feature."""
    rows, kept, held = 0, None, []

    def closed() -> None:
        nonlocal kept, held
        matrix, weights = (np.concatenate(parts) for parts in zip(*held))
        levels, level = np.unique(weights, return_inverse=True)
        if len(levels) <= FEW_WEIGHTS:
            parts = [(matrix[level == i], weight) for i, weight in enumerate(levels)]
            columns = [_Values.merged([_Values.of_even(m[:, k], weight) for m, weight in parts]) for k in range(matrix.shape[1])]
        else:
            columns = [_Values.of(matrix[:, k], weights) for k in range(matrix.shape[1])]
        kept = columns if kept is None else [_Values.merged(pair) for pair in zip(kept, columns)]
        held = []

    for batch in batches:
        if not batch.num_rows:
            continue
        _, weights = _signs(batch)
        held.append((_matrix(batch.column(0), len(batch.column(0)[0])), weights))
        rows += batch.num_rows
        if sum(len(w) for _, w in held) >= CHUNK:
            closed()
    if held:
        closed()
    if rows:
        yield pa.RecordBatch.from_pydict({"n": [rows], "values": [pickle.dumps(kept)]})


def _merged_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = 0, []
    for batch in batches:
        rows += sum(batch.column(0).to_pylist())
        held += [pickle.loads(values) for values in batch.column(1).to_pylist()]
        if len(held) >= MERGED:
            held = [[_Values.merged(parts) for parts in zip(*held)]]
    if rows:
        yield pa.RecordBatch.from_pydict({"n": [rows], "values": [pickle.dumps([_Values.merged(parts) for parts in zip(*held)])]})


def _binned(matrix: np.ndarray, borders: Sequence[np.ndarray]) -> np.ndarray:
    bins = np.empty(matrix.shape, np.uint8)
    for k, cuts in enumerate(borders):
        bins[:, k] = np.searchsorted(cuts, matrix[:, k])
    return bins


# Growing.


class _Layout:
    """Which features are counted together, and where a feature's bits are."""

    def __init__(self, bins: Sequence[int]):
        bits = [max(1, int(n - 1).bit_length()) for n in bins]
        self.groups: list[list[int]] = [[]]
        self.sizes = [0]
        for k in sorted(range(len(bits)), key=lambda k: -bits[k]):
            home = next((g for g, size in enumerate(self.sizes) if size + bits[k] <= JOINT_BITS), None)
            if home is None:
                home = len(self.groups)
                self.groups.append([])
                self.sizes.append(0)
            self.groups[home].append(k)
            self.sizes[home] += bits[k]
        self.group, self.shift = np.zeros(len(bits), np.int64), np.zeros(len(bits), np.uint16)
        self.mask = np.array([(1 << b) - 1 for b in bits], np.uint16)
        for g, members in enumerate(self.groups):
            at = self.sizes[g]
            for k in members:
                at -= bits[k]
                self.group[k], self.shift[k] = g, at
        self.bits = bits

    def packed(self, bins: np.ndarray) -> np.ndarray:
        codes = np.zeros((len(self.groups), len(bins)), np.uint16)
        for k in range(bins.shape[1]):
            codes[self.group[k]] |= bins[:, k].astype(np.uint16) << self.shift[k]
        return codes

    def histograms(self, joint: list[np.ndarray], nodes: int) -> np.ndarray:
        """(nodes, features, bins) from the joint histograms of the groups."""
        found = np.zeros((nodes, len(self.bits), BINS))
        for members, sums in zip(self.groups, joint):
            cube = sums.reshape(nodes, *[1 << self.bits[k] for k in members])
            for i, k in enumerate(members):
                others = tuple(j + 1 for j in range(len(members)) if j != i)
                found[:, k, : 1 << self.bits[k]] = cube.sum(axis=others)
        return found


class _Block:
    """Rows in the memory of a task: packed bins, weights signed by the label, the margin so far, and of the present tree
    the node and the weighted residual."""

    def __init__(self, layout: _Layout, bins: np.ndarray, signed: np.ndarray):
        self.codes = layout.packed(bins)
        short = signed.astype(np.float32)
        self.signed = short if (short == signed).all() else signed
        self.even = bool((np.abs(signed) == 1.0).all())
        self.margin, self.pull = np.zeros(len(signed)), None
        self.node = np.zeros(len(signed), np.int16)

    def next_round(self, values: np.ndarray | None, weight: float) -> None:
        if values is None:
            self.pull = self.signed.astype(np.float64)
            return
        self.margin += (values * weight)[self.node]
        self.node[:] = 0
        power = np.where(self.signed < 0, -2.0, 2.0)
        power *= self.margin
        with np.errstate(over="ignore"):
            np.exp(power, out=power)
        power += 1.0
        np.divide(self.signed, power, out=power)
        power *= 4.0
        self.pull = power

    def route(self, layout: _Layout, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> None:
        """To the children of the nodes that were split last; others have feature -1 and stay."""
        if len(feature) == 1:
            k = feature[0]
            bins = self.codes[layout.group[k]] >> layout.shift[k] & layout.mask[k]
            self.node = (bins > cut[0]).astype(self.node.dtype)
            self.node += self.node.dtype.type(left[0])
            return
        known = np.maximum(feature, 0)
        code = self.codes.reshape(-1)[(layout.group[known] * len(self.node))[self.node] + np.arange(len(self.node))]
        bins = code >> layout.shift[known][self.node] & layout.mask[known][self.node]
        stay = feature < 0
        go = bins > np.where(stay, BINS, cut)[self.node]
        self.node = np.where(stay, np.arange(len(feature)), left).astype(self.node.dtype)[self.node] + go

    def squares(self, nodes: int) -> np.ndarray:
        """Of each node the sums of weights, weighted residuals and weighted squares."""
        weight = np.abs(self.signed)
        square = np.divide(self.pull * self.pull, weight, out=np.zeros(len(self.pull)), where=weight > 0)
        return np.stack([np.bincount(self.node, v, nodes) for v in (weight, self.pull, square)])

    def sums(self, layout: _Layout, slot: np.ndarray, active: int, weights: bool, into: list[np.ndarray]) -> None:
        codes, pull, signed = self.codes, self.pull, self.signed
        place = None
        if len(slot) > 1:
            place = slot[self.node]
            if (slot < 0).any():
                rows = np.flatnonzero(place >= 0)
                if not len(rows):
                    return
                place, codes, pull, signed = place[rows], codes[:, rows], pull[rows], signed[rows]
        weight = np.abs(signed).astype(np.float64) if weights and not self.even else None
        n = len(layout.groups)
        for g, size in enumerate(layout.sizes):
            key = codes[g].astype(np.int64)
            if place is not None:
                key += place << size
            into[g] += np.bincount(key, pull, active << size)
            if weights:
                into[n + g] += np.bincount(key, weight, active << size)


def _grow(blocks: list[_Block], layout: _Layout, rounds: int, rate: float, depth: int, gathered: Callable[[np.ndarray], np.ndarray]) -> list[Tree]:
    """All trees; each of the tasks gets the same ones, as ``gathered`` gives each the same sums."""
    if depth >= 14:
        for block in blocks:
            block.node = block.node.astype(np.int32)
    groups = len(layout.groups)
    #: Levels on which nodes without any variance were met; there they are looked for before histograms are made.
    pure_at: set[int] = set()
    root_weights = None

    def histograms(slot: np.ndarray, active: int, weights: bool) -> tuple[np.ndarray, np.ndarray | None]:
        joint = [np.zeros(active << size) for size in layout.sizes * (2 if weights else 1)]
        for block in blocks:
            block.sums(layout, slot, active, weights, joint)
        parts = [layout.histograms(joint[i : i + groups], active) for i in range(0, len(joint), groups)]
        found = gathered(np.stack(parts))
        return found[0], found[1] if weights else None

    trees: list[Tree] = []
    for k in range(rounds):
        for block in blocks:
            block.next_round(trees[-1].value if trees else None, _tree_weight(k - 1, rate))
        tree = {"feature": [-1], "cut": [0], "left": [0], "value": [0.0], "gain": [0.0]}
        active = np.array([0])
        for level in range(depth):
            slot = np.full(len(tree["feature"]), -1, np.int64)
            slot[active] = np.arange(len(active))
            sums, weights = histograms(slot, len(active), level > 0 or root_weights is None)
            if level == 0:
                root_weights = weights = root_weights if weights is None else weights
                tree["value"][0] = float(sums[0, 0].sum() / weights[0, 0].sum())
            children, gainless = _split(tree, active, sums, weights)
            if gainless:
                pure_at.add(level)
            if not children:
                break
            # Nodes that were split before have no rows any more.
            splits = [np.array(tree[c][: len(slot)]) for c in ("feature", "cut", "left")]
            for block in blocks:
                block.route(layout, *splits)
            if level + 1 in pure_at and level + 1 < depth:
                nodes = len(tree["feature"])
                weight, total, square = gathered(sum((b.squares(nodes) for b in blocks), np.zeros((3, nodes))))
                varied = [c for c in children if square[c] - total[c] * total[c] / weight[c] > ROUNDING * square[c]]
                if len(varied) == len(children):
                    pure_at.discard(level + 1)
                children = varied
            if not children:
                break
            active = np.array(children)
        trees.append(Tree(*(np.array(tree[c]) for c in ("feature", "cut", "left", "value", "gain"))))
    return trees


def _split(tree: dict[str, list], active: np.ndarray, sums: np.ndarray, weights: np.ndarray) -> tuple[list[int], bool]:
    """Splits the active nodes by their histograms; the new nodes, and whether a node had no split with gain."""
    left_sum, left_weight = np.cumsum(sums, axis=2)[:, :, :-1], np.cumsum(weights, axis=2)[:, :, :-1]
    total, weight = sums.sum(axis=2)[:, :, None], weights.sum(axis=2)[:, :, None]
    right_sum, right_weight = total - left_sum, weight - left_weight
    # What is left of a sum where nothing lies beyond the border is rounding.
    beyond = np.cumsum(weights[:, :, ::-1], axis=2)[:, :, -2::-1] > 0
    usable = (left_weight > 0) & beyond & (right_weight > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        both = left_sum * left_sum / left_weight + right_sum * right_sum / right_weight
        gain = np.where(usable, both - total * total / weight, 0.0)
    gain = np.where(usable & (gain > ROUNDING * np.nan_to_num(both)), gain, 0.0)
    children, gainless = [], False
    for i, node in enumerate(active.tolist()):
        feature, cut = divmod(int(gain[i].argmax()), gain.shape[2])
        if not gain[i, feature, cut] > 0:
            gainless = True
            continue
        first = len(tree["feature"])
        tree["feature"][node], tree["cut"][node], tree["left"][node] = feature, cut, first
        tree["gain"][node] = float(gain[i, feature, cut])
        for child, s, w in ((first, left_sum, left_weight), (first + 1, right_sum, right_weight)):
            for column, value in (("feature", -1), ("cut", 0), ("left", child), ("value", float(s[i, feature, cut] / w[i, feature, cut])), ("gain", 0.0)):
                tree[column].append(value)
            children.append(child)
    return children, gainless


class _Exchange:
    """Adds up what the tasks of a stage have found, in the order of the tasks: all get the same sums. A task writes its part
    of a turn when it has read all parts of the turn before, so its own part of that turn is no longer needed once all
    parts of this one are there."""

    def __init__(self, folder: str, task: int, tasks: int):
        self.folder, self.task, self.tasks, self.turn = folder, task, tasks, 0
        os.makedirs(folder, exist_ok=True)

    def _name(self, turn: int, task: int) -> str:
        return f"{self.folder}/{turn}-{task}"

    def __call__(self, sums: np.ndarray) -> np.ndarray:
        own, total = self._name(self.turn, self.task), np.zeros(sums.size)
        with open(f"{own}.part", "wb") as out:
            out.write(sums.tobytes())
        os.rename(f"{own}.part", own)
        for task in range(self.tasks):
            total += np.frombuffer(self._read(self._name(self.turn, task)))
        if self.turn:
            os.remove(self._name(self.turn - 1, self.task))
        self.turn += 1
        return total.reshape(sums.shape)

    @staticmethod
    def _read(name: str) -> bytes:
        while True:  # if a task fails, Spark ends all tasks of the stage
            try:
                with open(name, "rb") as found:
                    return found.read()
            except FileNotFoundError:
                time.sleep(0.0005)


def _slots(spark: SparkSession) -> int:
    """Tasks that the cluster runs at a time."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def _exchange_folder(spark: SparkSession) -> str | None:
    """A folder for the parts of one model, if the shared folder is one that Python can open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/relfold-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.toUri().getPath() if system.getUri().getScheme() == "file" else None


@dataclass(frozen=True)
class Boosting:
    """Rows to train on, the borders of their bins, and the tasks that will hold them."""

    inputs: DataFrame
    borders: list[np.ndarray]
    tasks: int
    weight: str | None

    @classmethod
    def of(cls, vectors: DataFrame, weight: str | None = None) -> "Boosting":
        """One pass over rows with ``__label`` and ``features``."""
        inputs = _inputs(vectors, weight)
        parts = inputs.mapInArrow(_summaries, "n bigint, values binary")
        found = parts.repartition(1).mapInArrow(_merged_summaries, "n bigint, values binary").collect()
        if not found:
            raise ValueError("there are no rows to train on")
        borders = [values.borders() for values in pickle.loads(found[0]["values"])]
        tasks = min(_slots(vectors.sparkSession), -(-found[0]["n"] // ROWS_PER_TASK))
        return cls(inputs, borders, tasks, weight)

    @property
    def possible(self) -> bool:
        """Several tasks must run side by side, which Spark does not promise where it adds and takes away executors by
        itself, and must share a folder."""
        spark = self.inputs.sparkSession
        settled = spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") != "true"
        return self.tasks == 1 or (settled and _exchange_folder(spark) is not None)

    def run(self, rounds: int, rate: float, depth: int) -> BoostedTrees:
        borders, tasks, width = self.borders, self.tasks, len(self.borders)
        layout = _Layout([len(cuts) + 1 for cuts in borders])
        folder = _exchange_folder(self.inputs.sparkSession) if tasks > 1 else None

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def closed() -> pa.RecordBatch:
                bins, signed = (np.concatenate(parts) for parts in zip(*held))
                held.clear()
                return pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "signed": [signed.tobytes()]})

            for batch in batches:
                sign, weights = _signs(batch)
                held.append((_binned(_matrix(batch.column(0), width), borders), sign * weights))
                if sum(len(s) for _, s in held) >= BLOCK:
                    yield closed()
            if held:
                yield closed()

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = []
            for batch in batches:
                for bins, signed in zip(batch.column(0), batch.column(1)):
                    bins = np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, width)
                    mine.append(_Block(layout, bins, np.frombuffer(signed.as_buffer())))
            task, gathered = 0, lambda sums: sums
            if folder:
                context = BarrierTaskContext.get()
                task = context.partitionId()
                # A stage that is run again must not read what its first run has left.
                gathered = _Exchange(f"{folder}/{context.allGather(uuid.uuid4().hex)[0]}", task, tasks)
            trees = _grow(mine, layout, rounds, rate, depth, gathered)
            if task == 0:
                yield pa.RecordBatch.from_pydict({"trees": [pickle.dumps(trees)]})

        dealt = self.inputs.mapInArrow(blocks, "bins binary, signed binary").repartition(tasks)
        try:
            (row,) = dealt.mapInArrow(grown, "trees binary", barrier=tasks > 1).collect()
        finally:
            if folder:
                shutil.rmtree(folder, ignore_errors=True)
        return BoostedTrees(borders, pickle.loads(row["trees"]), rate, self.weight)
