"""Joinable key pairs, their cardinality, and the join tree grown from the root table.

Input is the key profile: one row per key column. Everything here is metadata whose size depends on
the number of tables, never on the data.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

UNIQUE_THRESHOLD = 0.98
ONE_TO_ONE = "one_to_one"
ONE_TO_MANY = "one_to_many"
MANY_TO_ONE = "many_to_one"
MANY_TO_MANY = "many_to_many"


@dataclass(frozen=True)
class JoinEdge:
    parent_table: str
    child_table: str
    parent_key: str
    child_key: str
    relation_type: str
    requires_aggregation: bool
    distance: int
    path: tuple[str, ...]
    reason: str
    child_has_null_keys: bool = True


EDGE_SCHEMA = (
    "edge_ord int, parent_table string, child_table string, parent_key string, child_key string, "
    "relation_type string, requires_aggregation boolean, distance int, path array<string>, "
    "reason string, child_has_null_keys boolean"
)


def find_relationships(
    keys: DataFrame,
    root: str = "train",
    twin: str | None = "test",
    threshold: float = UNIQUE_THRESHOLD,
    strict: bool = True,
) -> DataFrame:
    """Pairs of tables that share a key name, with the cardinality of each pair.

    ``keys`` holds (table_name, table_ord, column_name, column_ord, non_null_ratio, unique_ratio).
    The root comes first on the left; its unlabelled twin takes no part. With ``strict`` a right key
    that is only nearly unique is aggregated before a join all the same, as it could add rows.
    """
    rows = keys.where(F.col("table_name") != F.lit(twin)) if twin else keys
    is_root = F.col("table_name") == F.lit(root)
    ordinal = F.when(is_root, F.lit(-1)).otherwise(F.col("table_ord"))
    rows = rows.select(
        F.col("table_name"), ordinal.alias("ord"), "column_name", "column_ord", "non_null_ratio", "unique_ratio"
    )
    left = rows.select(
        F.col("table_name").alias("left_table"),
        F.col("column_name").alias("key"),
        F.col("ord").alias("left_ord"),
        F.col("column_ord").alias("left_column_ord"),
        F.col("non_null_ratio").alias("left_non_null_ratio"),
        F.col("unique_ratio").alias("left_unique_ratio"),
    )
    right = rows.select(
        F.col("table_name").alias("right_table"),
        F.col("column_name").alias("key"),
        F.col("ord").alias("right_ord"),
        F.col("column_ord").alias("right_column_ord"),
        F.col("non_null_ratio").alias("right_non_null_ratio"),
        F.col("unique_ratio").alias("right_unique_ratio"),
    )
    pairs = left.join(right, "key").where("left_ord < right_ord")
    return (
        pairs.withColumn("is_root_related", F.col("left_table") == F.lit(root))
        .transform(lambda df: with_cardinality(df, threshold, strict))
    )


def with_cardinality(pairs: DataFrame, threshold: float = UNIQUE_THRESHOLD, strict: bool = True) -> DataFrame:
    """Uniqueness flags, relation type and the aggregate-first flag of (left, right) key pairs."""
    unique = {
        side: F.coalesce(F.col(f"{side}_unique_ratio") >= threshold, F.lit(False)) for side in ("left", "right")
    }
    relation = (
        F.when(unique["left"] & unique["right"], ONE_TO_ONE)
        .when(unique["left"], ONE_TO_MANY)
        .when(unique["right"], MANY_TO_ONE)
        .otherwise(MANY_TO_MANY)
    )
    aggregate = F.col("relation_type").isin(ONE_TO_MANY, MANY_TO_MANY)
    if strict:
        aggregate = aggregate | ~_surely_unique("right")
    return (
        pairs.withColumn("left_is_unique", unique["left"])
        .withColumn("right_is_unique", unique["right"])
        .withColumn("relation_type", relation)
        .withColumn("requires_aggregation", aggregate)
    )


def _surely_unique(side: str):
    """Every non-null key differs and at most the null rows repeat; only a null-free key is safe."""
    return F.coalesce(F.col(f"{side}_unique_ratio") == 1.0, F.lit(False))


def both_directions(relationships: DataFrame, threshold: float = UNIQUE_THRESHOLD, strict: bool = True) -> DataFrame:
    """Each pair seen from either end: from_table/to_table with the ratios turned round."""
    common = ["key", "is_root_related", "left_ord", "right_ord", "left_column_ord"]
    forward = relationships.select(
        *common,
        F.col("left_table").alias("from_table"),
        F.col("right_table").alias("to_table"),
        "left_non_null_ratio", "right_non_null_ratio", "left_unique_ratio", "right_unique_ratio",
    )
    backward = relationships.select(
        *common,
        F.col("right_table").alias("from_table"),
        F.col("left_table").alias("to_table"),
        F.col("right_non_null_ratio").alias("left_non_null_ratio"),
        F.col("left_non_null_ratio").alias("right_non_null_ratio"),
        F.col("right_unique_ratio").alias("left_unique_ratio"),
        F.col("left_unique_ratio").alias("right_unique_ratio"),
    )
    return with_cardinality(forward.unionByName(backward), threshold, strict)


def rank_candidates(
    directed: DataFrame,
    prefer: Iterable[tuple[str, str]] = (),
) -> DataFrame:
    """Order the ways out of each table: root pairs, then pairs with exactly one unique side, then
    preferred (from, to) pairs, then discovery order."""
    wanted = F.lit(False)
    for source, target in prefer:
        wanted = wanted | ((F.col("from_table") == source) & (F.col("to_table") == target))
    # Discovery order: root pairs by key position then table, the others by table pair then key.
    discovery = Window.partitionBy("from_table").orderBy(
        "root_penalty",
        "aggregation_penalty",
        "preference",
        F.when(F.col("is_root_related"), F.col("left_column_ord")).otherwise(F.lit(0)),
        "left_ord",
        "right_ord",
        "left_column_ord",
    )
    return (
        directed.withColumn("root_penalty", F.when(F.col("is_root_related"), 0).otherwise(1))
        .withColumn("aggregation_penalty", F.when(F.col("left_is_unique") != F.col("right_is_unique"), 0).otherwise(1))
        .withColumn("preference", F.when(wanted, -1).otherwise(0))
        .withColumn("rank", F.row_number().over(discovery))
    )


def with_reason(ranked: DataFrame) -> DataFrame:
    route = F.when(F.col("is_root_related"), "touches the root table").otherwise("reached through another table")
    preferred = F.when(F.col("preference") < 0, "preferred dimension; ").otherwise("")
    text = F.format_string(
        "%s; %srelation_type=%s, left_unique_ratio=%.3f, right_unique_ratio=%.3f",
        route, preferred, F.col("relation_type"), F.col("left_unique_ratio"), F.col("right_unique_ratio"),
    )
    return ranked.withColumn("reason", text)


def grow_tree(ranked: DataFrame, root: str = "train") -> list[JoinEdge]:
    """Breadth-first tree; the first edge to reach a table wins.

    The ranked pairs (at most tables squared rows) are read once and folded on the driver.
    """
    ways: dict[str, list] = {}
    for row in with_reason(ranked).orderBy("from_table", "rank").collect():
        ways.setdefault(row["from_table"], []).append(row)
    edges: list[JoinEdge] = []
    paths = {root: (root,)}
    frontier = [root]
    while frontier:
        reached = []
        for table in frontier:
            for row in ways.get(table, []):
                child = row["to_table"]
                if child in paths:
                    continue
                paths[child] = (*paths[table], child)
                reached.append(child)
                edges.append(
                    JoinEdge(
                        parent_table=table,
                        child_table=child,
                        parent_key=row["key"],
                        child_key=row["key"],
                        relation_type=row["relation_type"],
                        requires_aggregation=row["requires_aggregation"],
                        distance=len(paths[child]) - 1,
                        path=paths[child],
                        reason=row["reason"],
                        child_has_null_keys=row["right_non_null_ratio"] != 1.0,
                    )
                )
        frontier = reached
    return edges


def tree_frame(spark: SparkSession, edges: Sequence[JoinEdge]) -> DataFrame:
    rows = [
        (i, e.parent_table, e.child_table, e.parent_key, e.child_key, e.relation_type, e.requires_aggregation,
         e.distance, list(e.path), e.reason, e.child_has_null_keys)
        for i, e in enumerate(edges)
    ]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def edges_from(tree: DataFrame) -> list[JoinEdge]:
    """Edges of a tree kept as a DataFrame (one row per joined table)."""
    return [
        JoinEdge(
            r["parent_table"], r["child_table"], r["parent_key"], r["child_key"], r["relation_type"],
            r["requires_aggregation"], r["distance"], tuple(r["path"]), r["reason"], r["child_has_null_keys"],
        )
        for r in tree.orderBy("edge_ord").collect()
    ]


def unreachable(table_names: Iterable[str], edges: Sequence[JoinEdge], root: str = "train", twin: str | None = "test") -> list[str]:
    reached = {root, *(e.child_table for e in edges)}
    return sorted(t for t in table_names if t not in reached and t != twin)


def tables_to_plan(edges: Sequence[JoinEdge], exclude: Collection[str] = ("data_dictionary",)) -> list[str]:
    """Reached tables that get feature plans, in tree order, without the excluded ones."""
    return list(dict.fromkeys(e.child_table for e in edges if e.child_table not in exclude))
