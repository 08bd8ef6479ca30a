import json

import pytest
from pyspark.sql import functions as F

from relfold.operators.actions import apply_actions
from relfold.operators.aggregates import Measure, aggregate_by_key
from relfold.operators.builders import apply_builders
from relfold.operators.specs import KeyFacts, apply_specs, bring_columns, category_families
from relfold.plans.ingest import json_payload, parse_plans, parse_specs, plans_from, rejected, specs_from
from relfold.plans.models import Action, Aggregation, FeatureBuilder, FeatureSpec, TablePlan
from tests.conftest import rows_of


def plan(*actions):
    return TablePlan(actions[0].source_table, actions[0].join_key, "many_to_many", True, actions)


@pytest.fixture
def roots(frame):
    return {
        "train": frame("row_id int, user_id int, product_id int, target int", (1, 1, 7, 0), (2, 1, 8, 1), (3, 2, 7, 0)),
        "test": frame("row_id int, user_id int, product_id int", (4, 2, 8)),
    }


@pytest.fixture
def tables(frame):
    return {
        "orders": frame("order_id int, user_id int, dow int", (1, 1, 0), (2, 1, 3), (3, 2, 0)),
        "order_items": frame("order_id int, product_id int, reordered int", (1, 7, 0), (1, 8, 0), (2, 7, 1), (3, 7, 0)),
        "products": frame("product_id int, kind string", (7, "a"), (8, "b")),
    }


def test_actions_are_applied_to_both_roots(roots, tables):
    result = apply_actions(
        roots, tables,
        [
            plan(
                Action("aggregate_numeric", "orders", "user_id", ("dow", "absent"), ("mean", "count")),
                Action("aggregate_categorical", "orders", "user_id", ("dow",), ("most_frequent", "top_k_frequency"), top_k=1),
            ),
            plan(Action("direct_join", "products", "product_id", ("kind", "product_id"))),
        ],
    )
    assert [s[4] for s in result.statuses] == ["applied"] * 3
    features = ["orders__dow__mean", "orders__dow__count", "orders__dow__most_frequent", "orders__dow__freq__0", "products__kind"]
    assert rows_of(result.roots["train"], "row_id", *features) == [
        (1, 1.5, 2, 0, 1, "a"), (2, 1.5, 2, 0, 1, "b"), (3, 0.0, 1, 0, 1, "a")
    ]
    assert rows_of(result.roots["test"], "row_id", *features) == [(4, 0.0, 1, 0, 1, "b")]


def test_failing_actions_leave_both_roots_alone(roots, tables):
    result = apply_actions(
        roots, tables,
        [
            plan(Action("direct_join", "orders", "user_id", ("dow",))),
            plan(Action("direct_join", "products", "product_id", ("colour",))),
            plan(Action("aggregate_numeric", "orders", "user_id", ("dow",), ("median",))),
            plan(Action("direct_join", "nothing", "user_id", ("x",))),
            plan(Action("direct_join", "orders", "shop_id", ("x",))),
            plan(Action("direct_join", "orders", "order_id", ("dow",))),
            plan(Action("aggregate_numeric", "train", "user_id", ("target",), ("mean",))),
            plan(Action("skip", "orders", "user_id")),
        ],
    )
    assert [s[4] for s in result.statuses] == ["failed"] * 5 + ["skipped", "applied", "skipped"]
    assert "not unique" in result.statuses[0][5]
    # The root lends no label: the action on it only finds no numeric column.
    assert {n: df.columns for n, df in result.roots.items()} == {n: df.columns for n, df in roots.items()}


def test_equal_actions_make_one_grouping(roots, tables):
    action = Action("aggregate_numeric", "orders", "user_id", ("dow",), ("mean",))
    result = apply_actions(roots, tables, [plan(action), plan(action, Action("aggregate_numeric", "orders", "user_id", ("dow",), ("max",)))])
    assert result.roots["train"].columns[-2:] == ["orders__dow__mean", "orders__dow__max"]
    text = result.roots["train"]._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [") == 1


def test_bad_records():
    with pytest.raises(ValueError):
        Action("make_coffee", "t", "k")
    with pytest.raises(ValueError):
        Action("skip", " ", "k")
    with pytest.raises(ValueError):
        Aggregation("c", "median", ("k",), "f")
    with pytest.raises(ValueError):
        Aggregation("c", "count", (), "f")
    assert Action(" skip ", " t ", "k", (" a ", "")).columns == ("a",)


def test_spec_over_a_bridge(roots, tables):
    spec = FeatureSpec.from_dict(
        {
            "title": "s",
            "join_paths": [["train", "orders", "order_items", "products"]],
            "aggregations": [
                {"source_column": "product_id", "source_table": "order_items", "operation": "count", "group_by_columns": ["user_id", "kind"],
                 "feature_name": "n"},
                {"source_column": "product_id", "source_table": "order_items", "operation": "ratio", "group_by": ["user_id", "kind"], "feature_name": "share"},
                {"source_column": "reordered", "operation": "sum", "group_by": ["user_id"], "feature_name": "sundays",
                 "filter_expression": "dow = 0"},
            ],
        }
    )
    result = apply_specs(roots, tables, [spec])
    assert result.statuses[0][4] == "applied"
    assert result.roots["train"].columns == ["row_id", "user_id", "product_id", "target", "n", "share", "sundays"]
    assert rows_of(result.roots["train"], "row_id", "n", "share", "sundays") == [(1, 2, 2 / 3, 0), (2, 1, 1 / 3, 0), (3, 1, 1.0, 0)]
    assert rows_of(result.roots["test"], "row_id", "n", "share", "sundays") == [(4, None, None, 0)]


def test_category_families(roots, tables):
    result = apply_specs(roots, tables, [category_families("kind")])
    found = rows_of(
        result.roots["train"], "row_id", "user_id_kind_count", "user_id_kind_share", "user_id_kind_distinct", "user_id_kind_repeat_rate"
    )
    assert found == [(1, 2, 2 / 3, 1, 0.5), (2, 1, 1 / 3, 1, 0.0), (3, 1, 1.0, 1, 0.0)]


def test_mode_ratio_and_ratio_of_one_key(roots, tables):
    spec = FeatureSpec(
        "s",
        (
            Aggregation("product_id", "mode_ratio", ("order_id",), "m", "order_items"),
            Aggregation("product_id", "ratio", ("order_id",), "r", "order_items"),
        ),
    )
    base = {"root": tables["orders"]}
    found = apply_specs(base, {"order_items": tables["order_items"]}, [spec])
    assert rows_of(found.roots["root"], "order_id", "m", "r") == [(1, 0.5, 1.0), (2, 1.0, 1.0), (3, 1.0, 1.0)]


def test_spec_that_cannot_be_reached_fails_for_both(roots, tables):
    spec = FeatureSpec("s", (Aggregation("product_id", "count", ("user_id", "colour"), "n", "order_items"),), (("train", "orders"),))
    root_only = FeatureSpec("t", (Aggregation("target", "mean", ("user_id",), "leak"),), (("train",),))
    result = apply_specs(roots, tables, [spec, root_only])
    assert [s[4] for s in result.statuses] == ["failed", "failed"]
    assert result.roots["train"].columns == roots["train"].columns


def test_bring_columns_takes_only_needed_joins(tables, frame):
    more = {**tables, "kinds": frame("kind_id int, product_id int, z int", (1, 7, 5))}
    found = bring_columns(tables["order_items"], ["kind"], more, ["orders", "kinds", "products"], KeyFacts(more))
    assert found.columns == ["order_id", "product_id", "reordered", "kind"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def history(root, tables):
    items = tables["order_items"].join(tables["orders"], "order_id", "left")
    return aggregate_by_key(items, ["user_id", "product_id"], [Measure("size", "n")]).visible()


def test_a_builder_error_without_a_message_is_reported(roots, tables):
    def silent(train, shown):
        raise AssertionError

    result = apply_builders(roots, {**tables, **roots}, [FeatureBuilder("silent", ("user_id",), silent)])
    assert result.statuses[0][5] == "AssertionError"


def test_builders_in_turn(roots, tables):
    def user_sum(root, tables):
        assert "target" not in root.columns and "n" in root.columns
        assert "target" not in tables["train"].columns
        return root.groupBy("user_id").agg(F.sum("n").alias("user_n"))

    def twice(root, tables):
        return tables["orders"].select("user_id", "dow")

    def broken(root, tables):
        raise KeyError("no such table")

    def collides(root, tables):
        return tables["orders"].groupBy("user_id").agg(F.count("*").alias("n"))

    def empty(root, tables):
        return tables["orders"].where("false").groupBy("user_id").agg(F.count("*").alias("none"))

    builders = [
        FeatureBuilder("history", ("user_id", "product_id"), history),
        FeatureBuilder("sum", ("user_id",), user_sum),
        FeatureBuilder("twice", ("user_id",), twice),
        FeatureBuilder("broken", ("user_id",), broken),
        FeatureBuilder("collides", ("user_id",), collides),
        FeatureBuilder("not a frame", ("user_id",), lambda root, tables: 1),
        FeatureBuilder("empty", ("user_id",), empty),
    ]
    result = apply_builders(roots, {**tables, **roots}, builders)
    assert [(s[4], s[5]) for s in result.statuses][:2] == [("applied", "")] * 2
    assert [s[4] for s in result.statuses][2:6] == ["failed"] * 4
    assert (result.statuses[6][4], result.statuses[6][5]) == ("applied", "result is empty")
    assert rows_of(result.roots["train"], "row_id", "n", "user_n", "none") == [(1, 2, 3, None), (2, 1, 3, None), (3, 1, 1, None)]
    assert result.roots["test"].columns == ["row_id", "user_id", "product_id", "n", "user_n", "none"]
    with pytest.raises(KeyError):
        apply_builders(roots, tables, [FeatureBuilder("broken", ("user_id",), broken)], on_error="raise")


GOOD = {
    "source_table": " users ", "join_path": ["train", " "], "parent_table": "train", "join_key": "user_id",
    "relation_type": "many_to_one", "requires_aggregation": False, "comment": " ",
    "actions": [
        {"action_type": " direct_join ", "source_table": "users", "join_key": "user_id", "columns": [" a ", ""],
         "aggregations": [], "top_k": None, "reason": "r"}
    ],
}


def with_action(**changes):
    return {**GOOD, "actions": [{**GOOD["actions"][0], **changes}]}


def test_plan_ingestion(frame):
    texts = {
        1: "```json\n" + json.dumps(GOOD, indent=1) + "\n```",
        2: "Here:\n" + json.dumps(GOOD) + "\nthat is all",
        3: "nothing here",
        4: "{broken",
        5: "{broken}",
        6: json.dumps(with_action(action_type="make_coffee")),
        7: json.dumps(with_action(reason=" ")),
        8: json.dumps({**GOOD, "join_key": ""}),
        9: json.dumps({k: v for k, v in GOOD.items() if k != "requires_aggregation"}),
        10: json.dumps({k: v for k, v in GOOD.items() if k != "actions"}),
        11: None,
    }
    parsed = parse_plans(frame("id int, text string", *texts.items()))
    errors = dict(rows_of(parsed, "id", "error"))
    assert errors == {
        1: None, 2: None, 3: "no JSON object", 4: "no JSON object", 5: "invalid JSON", 6: "unknown action_type",
        7: "blank text in an action", 8: "blank join_key", 9: "requires_aggregation missing", 10: None, 11: "no JSON object",
    }
    plans = plans_from(parsed)
    assert len(plans) == 3
    assert plans[0].source_table == "users" and plans[0].comment is None and plans[0].join_path == ("train",)
    assert plans[0].actions[0].columns == ("a",) and plans[0].actions[0].action_type == "direct_join"
    assert [p.actions for p in plans].count(()) == 1
    assert rejected(parsed).count() == 8


def test_json_payload_is_greedy(frame):
    df = frame("t string", ("a {x{y}z} b } c",), ("none",)).select(json_payload(F.col("t")).alias("p"))
    assert [r["p"] for r in df.collect()] == ["{x{y}z} b }", None]


def test_spec_ingestion(frame):
    item = {"source_column": "c", "operation": "count", "group_by_columns": ["k"], "feature_name": "f"}
    def doc(**changes):
        return json.dumps({"compiled_feature_specs": [{"title": "t", "aggregations": [{**item, **changes}]}]})
    parsed = parse_specs(frame("id int, text string", (1, doc()), (2, doc(operation="median")), (3, "{}"), (4, doc(group_by_columns=[]))))
    assert dict(rows_of(parsed, "id", "error")) == {1: None, 2: "invalid aggregation", 3: "no compiled_feature_specs", 4: "invalid aggregation"}
    assert specs_from(parsed) == [FeatureSpec("t", (Aggregation("c", "count", ("k",), "f"),))]


def test_specs_share_one_widened_table(spark, roots, tables, monkeypatch):
    """Three groupings of two specs read the items once joined with what they need, not three times."""
    from relfold.operators import specs as module

    kept = []
    monkeypatch.setattr(module, "stored", lambda df: kept.append(df.columns) or df)
    specs = [category_families("kind"), FeatureSpec(
        "s",
        (Aggregation("product_id", "count", ("user_id",), "n_items", "order_items"), Aggregation("reordered", "mean", ("kind",), "kind_rate", "order_items")),
        (("train", "orders", "order_items", "products"),),
    )]
    result = apply_specs(roots, tables, specs)
    assert [s[4] for s in result.statuses] == ["applied", "applied"], result.statuses
    assert len(kept) == 1 and set(kept[0]) == {"user_id", "kind", "product_id", "reordered"}
    alone = apply_specs(apply_specs(roots, tables, specs[:1]).roots, tables, specs[1:])
    for name in roots:
        assert rows_of(result.roots[name]) == rows_of(alone.roots[name])
