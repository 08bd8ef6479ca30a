"""Nearest neighbours by largest inner product with one vantage-point tree per shard.

With M the largest norm, every vector x gets one more component sqrt(M*M - |x|*|x|) and every query, brought to
norm M, a 0 there: then |q' - x'|^2 = 2 M^2 - 2 q'.x, so the nearest in that metric space have the largest inner
products and the triangle inequality holds. A tree splits its points at the median distance from a vantage point; a
leaf is skipped if ``factor`` times the least distance it can hold exceeds the k-th best distance so far. Factor 1
gives exact results, larger factors skip more.

Were M much larger than most norms, all points would lie about M from every query and the factor would skip nearly
all of them. A shard therefore has one tree per band of norms, each with its own M: a band's norms are within a
factor of 2, or the band is no more than one leaf.

Shards are dealt by a hash of the id, so their size does not depend on the data. Equal vectors share one place
in a tree with their smallest ids, as no more of them can be among the k nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from relfold.llm.common import written

#: Vectors of a shard, points of a leaf, queries of a block, blocks that meet one copy of a shard.
SHARD, LEAF, BLOCK, BLOCKS_PER_COPY = 8192, 64, 1024, 32

#: How much harder than the triangle inequality a leaf is judged; recall is measured in the tests.
FACTOR = 1.15


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tree:
    """A vantage-point tree over the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, keep: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order], np.float64)
        # np.unique on the bytes of rows; the rows of equal vectors stay in order of id.
        packed = vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        _, first, inverse = np.unique(packed, return_index=True, return_inverse=True)
        by_vector = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[by_vector], np.arange(len(first)))
        rank = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        kept = by_vector[rank < keep]
        self.vectors, self.norm = vectors[first], norm
        self.extra = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", self.vectors, self.vectors), 0))
        self.ids, self.owner = ids[kept], inverse[kept]
        self.centres: list[int] = []
        self.bounds: list[list[tuple[int, float, float]]] = []  # for each leaf, (node, least, most) along its path
        self.leaves: list[np.ndarray] = []
        self._split(np.arange(len(first)), [])
        counts = np.bincount(self.owner, minlength=len(first))
        begin = np.cumsum(counts) - counts
        # Places in ids for the vectors of each leaf, and which of the leaf's vectors they belong to.
        self.places = [
            (np.concatenate([np.arange(begin[p], begin[p] + counts[p]) for p in leaf]), np.repeat(np.arange(len(leaf)), counts[leaf]))
            for leaf in self.leaves
        ]

    def _split(self, points: np.ndarray, path: list[tuple[int, float, float]]) -> None:
        if len(points) <= LEAF:
            self.leaves.append(points)
            self.bounds.append(path)
            return
        centre = points[self._distance(points, points[0]).argmax()]
        distance = self._distance(points, centre)
        order = np.argsort(distance, kind="stable")
        node = len(self.centres)
        self.centres.append(int(centre))
        half = len(points) // 2
        for part in (order[:half], order[half:]):
            self._split(points[part], [*path, (node, float(distance[part[0]]), float(distance[part[-1]]))])

    def _distance(self, points: np.ndarray, centre: int) -> np.ndarray:
        apart = self.vectors[points] - self.vectors[centre]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart) + (self.extra[points] - self.extra[centre]) ** 2)

    def least_distances(self, queries: np.ndarray) -> np.ndarray:
        """For every query and leaf, the least distance that the triangle inequality allows."""
        squares = np.einsum("ij,ij->i", queries, queries)
        reach = np.sqrt(np.maximum(squares[:, None] + self.norm**2 - 2 * queries @ self.vectors[self.centres].T, 0)) if self.centres else None
        out = np.zeros((len(queries), len(self.leaves)))
        for leaf, path in enumerate(self.bounds):
            for node, least, most in path:
                np.maximum(out[:, leaf], np.maximum(reach[:, node] - most, least - reach[:, node]), out=out[:, leaf])
        return out

    def search(
        self, own: np.ndarray, queries: np.ndarray, k: int, factor: float, so_far: tuple[np.ndarray, np.ndarray] | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids and inner products of each query, best first, ties to smaller ids; -inf where there are fewer.
        ``so_far`` holds the scores and ids that other trees have found, and is filled further."""
        n = len(queries)
        scores, ids = so_far or (np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max))
        # The order of inner products does not depend on a query's length, so bounds are taken at norm M.
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        scale = np.divide(self.norm, lengths, out=np.zeros(n), where=lengths > 0)
        least = self.least_distances(queries * scale[:, None])
        slack = np.where(lengths > 0, 2e-7 * self.norm, np.inf)
        done = np.zeros(least.shape, bool)

        def look(leaf: int, rows: np.ndarray) -> None:
            done[rows, leaf] = True
            places, of = self.places[leaf]
            found = (queries[rows] @ self.vectors[self.leaves[leaf]].T)[:, of]
            found = np.where(self.ids[places][None, :] == own[rows][:, None], -np.inf, found)
            better = (found >= scores[rows, -1][:, None]) & (found > -np.inf)
            some = better.any(axis=1)
            rows, found = rows[some], np.where(better, found, -np.inf)[some]
            if not len(rows):
                return
            all_scores = np.hstack([scores[rows], found])
            all_ids = np.hstack([ids[rows], np.where(found > -np.inf, self.ids[places][None, :], np.iinfo(np.int64).max)])
            best = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
            scores[rows], ids[rows] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)

        nearest = np.argsort(least, axis=1, kind="stable")
        for turn in range(min(2, least.shape[1])):  # each query's most promising leaves first
            for leaf in np.unique(nearest[:, turn]):
                look(int(leaf), np.flatnonzero(nearest[:, turn] == leaf))
        for leaf in np.argsort(least.mean(axis=0), kind="stable"):
            # Infinite until k are found.
            worst = np.where(scores[:, -1] > -np.inf, scores[:, -1] * scale, -np.inf)
            radius = np.sqrt(np.maximum(2 * self.norm**2 - 2 * worst, 0)) + slack
            rows = np.flatnonzero(~done[:, leaf] & (factor * least[:, leaf] <= radius))
            if len(rows):
                look(int(leaf), rows)
        return ids, scores


def planted(ids: np.ndarray, vectors: np.ndarray, keep: int) -> list[Tree]:
    """The trees of a shard, one per band of norms, largest norms first."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    order = np.argsort(-norms, kind="stable")
    trees, low = [], 0
    while low < len(order):
        top = float(norms[order[low]])
        high = max(int(np.searchsorted(-norms[order], -top / 2, side="right")), min(low + LEAF, len(order)))
        trees.append(Tree(ids[order[low:high]], vectors[order[low:high]], top, keep))
        low = high
    return trees


def searched(trees: list[Tree], own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and inner products of each query over the trees of a shard, as in Tree.search."""
    ids, scores = trees[0].search(own, queries, k, factor)
    for tree in trees[1:]:
        ids, scores = tree.search(own, queries, k, factor, (scores, ids))
    return ids, scores


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, name: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For every row of ``queries`` (columns vec_id, embedding, as in ``vectors``) the k nearest rows of ``vectors``
    found, its own id apart: query_id, rank from 1, vec_id, score. Ties go to smaller ids.

    Null ids, null and zero vectors, vectors with null or non-finite components, and vectors that are not of the
    commonest length (the smallest of several) take no part. Of repeated ids the least vector counts. A query with
    fewer candidates gets them all; no candidates or queries, no rows. Other columns are ignored.
    """
    def cleaned(df: DataFrame) -> DataFrame:
        fit = df.select(F.col(name).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return fit.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))

    spark = vectors.sparkSession
    points = written(cleaned(vectors))
    lengths = points.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), "d").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if commonest is None:
        return spark.createDataFrame([], result)
    width, count = commonest["d"], commonest["n"]
    shards = max(1, math.ceil(count / SHARD))
    fit = F.size("v") == width

    def planting(part: pa.Table) -> pa.Table:
        import pickle

        trees = planted(part["id"].to_numpy(), _matrix(part["v"]), k + 1)
        return pa.table({"shard": part["shard"][:1], "trees": pa.array([pickle.dumps([vars(t) for t in trees], 5)], pa.binary())})

    index = points.where(fit).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    index = written(index.groupBy("shard").applyInArrow(planting, "shard int, trees binary"))

    asked = cleaned(queries).where(fit)
    total = asked.count()
    blocks = max(1, math.ceil(total / BLOCK))
    copies = max(1, math.ceil(blocks / BLOCKS_PER_COPY))

    def packed(part: pa.Table) -> pa.Table:
        return pa.table(
            {"block": part["block"][:1], "ids": pa.array([part["id"].to_numpy().astype(np.int64).tobytes()]), "rows": pa.array([_matrix(part["v"]).tobytes()])}
        )

    blocked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    blocked = blocked.groupBy("block").applyInArrow(packed, "block int, ids binary, rows binary")
    # Every block visits every shard once, both packed; a shard is copied once for so many blocks.
    visits = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("copy", F.col("block") % copies)
    trees = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for batch in batches:
            for i in range(batch.num_rows):
                trees = []
                for held in pickle.loads(batch.column("trees")[i].as_py()):
                    trees.append(Tree.__new__(Tree))
                    vars(trees[-1]).update(held)
                own = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                rows = np.frombuffer(batch.column("rows")[i].as_py(), np.float64).reshape(len(own), -1)
                ids, scores = searched(trees, own, rows, k, factor)
                found = scores > -np.inf
                yield pa.record_batch(
                    [pa.array(np.repeat(own, found.sum(axis=1))), pa.array(ids[found]), pa.array(scores[found])], names=["query_id", "vec_id", "score"]
                )

    met = trees.join(visits, ["shard", "copy"]).select("trees", "ids", "rows")
    found = met.mapInArrow(searching, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
