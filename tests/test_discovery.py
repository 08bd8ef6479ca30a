import pytest

from relfold.operators.enrich import aggregate_enrich, direct_enrich, enrich_roots, enrich_tree, prefixed, resolve_parent_key
from relfold.operators.keyed import SkewPolicy
from relfold.operators.profile import column_profile
from relfold.operators.relationships import (
    JoinEdge,
    both_directions,
    edges_from,
    find_relationships,
    grow_tree,
    rank_candidates,
    tables_to_plan,
    tree_frame,
    unreachable,
)
from tests.conftest import rows_of


def keys_frame(frame, *rows):
    return frame(
        "table_name string, table_ord int, column_name string, column_ord int, non_null_ratio double, unique_ratio double", *rows
    )


@pytest.fixture
def keys(frame):
    return keys_frame(
        frame,
        ("departments", 0, "department_id", 0, 1.0, 1.0),
        ("items", 1, "order_id", 0, 1.0, 0.1),
        ("items", 1, "product_id", 1, 1.0, 0.2),
        ("lonely", 2, "shop_id", 0, 1.0, 1.0),
        ("orders", 3, "order_id", 0, 1.0, 1.0),
        ("orders", 3, "user_id", 1, 1.0, 0.3),
        ("products", 4, "product_id", 0, 1.0, 1.0),
        ("products", 4, "department_id", 1, 0.9, 0.05),
        ("test", 5, "user_id", 0, 1.0, 1.0),
        ("train", 6, "user_id", 0, 1.0, 0.5),
        ("train", 6, "product_id", 1, 1.0, 0.5),
        ("users", 7, "user_id", 0, 1.0, 1.0),
    )


def test_relationships(keys):
    found = rows_of(
        find_relationships(keys), "left_table", "right_table", "key", "is_root_related", "relation_type", "requires_aggregation"
    )
    assert ("train", "users", "user_id", True, "many_to_one", False) in found
    assert ("train", "orders", "user_id", True, "many_to_many", True) in found
    assert ("items", "orders", "order_id", False, "many_to_one", False) in found
    assert ("departments", "products", "department_id", False, "one_to_many", True) in found
    assert not any("test" in row for row in found)


def test_tree_order_and_paths(spark, keys):
    ranked = rank_candidates(both_directions(find_relationships(keys)), prefer=[("products", "departments")])
    edges = grow_tree(ranked)
    assert [(e.parent_table, e.child_table) for e in edges] == [
        ("train", "users"), ("train", "products"), ("train", "orders"), ("train", "items"), ("products", "departments")
    ]
    last = edges[-1]
    assert last.path == ("train", "products", "departments") and last.distance == 2
    assert last.reason == (
        "reached through another table; preferred dimension; relation_type=many_to_one, "
        "left_unique_ratio=0.050, right_unique_ratio=1.000"
    )
    assert unreachable(["train", "test", "users", "products", "orders", "items", "departments", "lonely"], edges) == ["lonely"]
    assert tables_to_plan(edges, exclude=("departments",)) == ["users", "products", "orders", "items"]
    assert edges_from(tree_frame(spark, edges)) == edges


def test_near_unique_key_is_aggregated_unless_told_otherwise(frame):
    keys = keys_frame(frame, ("train", 0, "k_id", 0, 1.0, 0.5), ("t", 1, "k_id", 0, 1.0, 0.99))
    strict = find_relationships(keys).first()
    assert strict["relation_type"] == "many_to_one" and strict["requires_aggregation"]
    assert not find_relationships(keys, strict=False).first()["requires_aggregation"]


def test_empty_table_is_not_unique(frame):
    keys = keys_frame(frame, ("train", 0, "k_id", 0, 1.0, 1.0), ("t", 1, "k_id", 0, None, None))
    assert find_relationships(keys).first()["relation_type"] == "one_to_many"


def edge(parent, child, key, aggregate=False, nulls=True):
    return JoinEdge(parent, child, key, key, "", aggregate, 1, (), "", nulls)


def test_parent_key_resolution():
    e = edge("users", "cities", "city_id")
    assert resolve_parent_key(["city_id", "users__city_id"], e) == "city_id"
    assert resolve_parent_key(["users__city_id"], e) == "users__city_id"
    assert resolve_parent_key(["id"], e) is None


@pytest.mark.parametrize("nulls", [True, False])
@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(0.2, 3)])
def test_tree_enrichment(frame, nulls, policy):
    train = frame("id int, user_id int", (1, 1), (2, 1), (3, 9), (4, None))
    tables = {
        "users": frame("user_id int, city_id int", (1, 10), (2, 20)),
        "cities": frame("city_id int, country_id int, name string", (10, 5, "x"), (20, 6, "y")),
        "countries": frame("country_id int, label string", (5, "L")),
        "visits": frame("user_id int, n int", (1, 1), (1, 3)),
    }
    edges = [
        edge("train", "users", "user_id", nulls=nulls),
        edge("train", "visits", "user_id", aggregate=True, nulls=nulls),
        edge("users", "cities", "city_id", nulls=nulls),
        edge("cities", "countries", "country_id", nulls=nulls),
        edge("visits", "unknown", "visit_id"),
        edge("visits", "countries", "visit_id"),
    ]
    wide = enrich_tree(train, tables, edges, skew=policy)
    assert wide.columns == [
        "id", "user_id", "users__city_id",
        "visits__n__mean", "visits__n__max", "visits__n__min", "visits__n__nunique", "visits__row_count",
        "cities__country_id", "cities__name", "city_id", "countries__label", "country_id",
    ]
    first = wide.where("id = 2").first().asDict()
    assert first["visits__n__mean"] == 2.0 and first["visits__row_count"] == 2
    assert (first["cities__name"], first["city_id"], first["countries__label"], first["country_id"]) == ("x", 10, "L", 5)
    missing = wide.where("id in (3, 4)").drop("id", "user_id").collect()
    assert all(v is None for row in missing for v in row)
    assert wide.count() == 4
    both = enrich_roots({"train": train, "test": train.drop("id")}, tables, edges, skew=policy)
    assert rows_of(both["train"]) == rows_of(wide) and both["test"].columns == wide.columns[1:]


def test_null_row_of_a_second_level_table_matches_on_the_base(frame):
    """A base row without a parent has a null key, and null matches null."""
    train = frame("id int, user_id int", (1, 9))
    tables = {"users": frame("user_id int, city_id int", (1, 10)), "cities": frame("city_id int, name string", (None, "nowhere"))}
    edges = [edge("train", "users", "user_id", nulls=False), edge("users", "cities", "city_id", nulls=True)]
    assert enrich_tree(train, tables, edges).first()["cities__name"] == "nowhere"


def test_direct_and_aggregate_enrichment(frame):
    base = frame("id int, k int", (1, 1), (2, 2))
    child = frame("k int, v int", (1, 3), (1, 5))
    assert rows_of(aggregate_enrich(base, "c", child, "k"), "id", "c__v__mean", "c__row_count") == [(1, 4.0, 2), (2, None, None)]
    assert direct_enrich(base, "c", child.where("v = 3"), "k").columns == ["id", "k", "c__v"]
    with pytest.raises(ValueError, match="zz"):
        prefixed("c", child, "k", ["zz"])


def test_discovery_from_data(frame):
    train = frame("row_id int, user_id int, target int", *[(i, i % 3, 0) for i in range(9)])
    users = frame("user_id int, x int", (0, 1), (1, 1), (2, 1))
    keys = column_profile({"train": train, "users": users}).where("column_name like '%_id'")
    edges = grow_tree(rank_candidates(both_directions(find_relationships(keys))))
    assert [(e.child_table, e.requires_aggregation, e.child_has_null_keys) for e in edges] == [("users", False, False)]
