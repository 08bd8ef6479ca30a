"""Registered queries. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.views import Views
from relfold.functions.columns import fill_missing
from relfold.modeling.metrics import auc_by_rank
from relfold.modeling.scoring import score_output
from relfold.modeling.selection import all_features, final_projection, numeric_features, rank_features, select_features
from relfold.modeling.split import hash_number, with_exact_folds, with_exact_holdout, with_folds, with_holdout
from relfold.modeling.training import top_features, with_class_weights
from relfold.operators.actions import apply_actions
from relfold.operators.aggregates import Measure, aggregate_by_key, top_values
from relfold.operators.builders import apply_builders, merge_feature
from relfold.operators.checks import new_columns, output_checks, stored_counted, write_counted
from relfold.operators.enrich import aggregate_enrich, direct_enrich, enrich_roots, enrich_tree
from relfold.operators.keyed import attach, left_join_unique
from relfold.operators.labels import with_held_out_labels, with_target
from relfold.operators.profile import added_columns, candidate_keys, column_profile, enrich_with_dictionary, same_columns, table_profile
from relfold.operators.relationships import (
    both_directions,
    find_relationships,
    grow_tree,
    rank_candidates,
    tables_to_plan,
    tree_frame,
    unreachable,
)
from relfold.operators.specs import apply_specs, category_families
from relfold.plans.ingest import parse_plans, parse_specs
from relfold.plans.models import Action, Aggregation, FeatureBuilder, FeatureSpec, TablePlan
from relfold.session import shared_folder, shuffles_released, stored
from relfold.sources.files import header_columns, load_bundle, write_table
from relfold.sources.profiles import load_profile, save_profile
from relfold.sources.store import TableStore
from relfold.workflow import discover

CSV_TABLES = ("customer", "nation", "part", "region")
RAW_TABLES = ("customer", "lineitem", "nation", "orders", "part", "region")

# Dictionary of the columns of the raw tables: table file, column, description, allowed values.
DICTIONARY = (
    ("orders.parquet", "o_orderkey", "unique order identifier", ""),
    ("orders.parquet", "o_custkey", "customer of the order", " "),
    ("orders.parquet", "o_orderstatus", "state of the order", "F,O,P"),
    ("lineitem.parquet", "l_orderkey", " order of the item ", ""),
    ("lineitem.parquet", "l_returnflag", "return state", "A,N,R"),
    ("part.parquet", "p_size", "size of the part", "1-50"),
    ("customer", "c_mktsegment", "market segment", ""),
    ("supplier.parquet", "s_name", "not profiled here", ""),
)


def _plan(table: str, key: str, *actions: Action) -> TablePlan:
    return TablePlan(table, key, "many_to_many", True, actions)


def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    profile = column_profile({t: views.raw(t) for t in RAW_TABLES})
    return profile.select(
        "table_name", "column_name", "row_count", "non_null_count", "distinct_count", "non_null_ratio", "unique_ratio"
    )


def profile_tables(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    profile = column_profile({t: views.raw(t) for t in RAW_TABLES})
    rows = table_profile(profile, lambda c: c.endswith("key"))
    return rows.select("table_name", "row_count", "column_count", F.concat_ws(",", "candidate_keys").alias("candidate_keys"))


def _key_part(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c.endswith("key")])


def key_candidates(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    profile = column_profile({t: _key_part(views.raw(t)) for t in RAW_TABLES})
    keys = candidate_keys(profile, lambda c: c.endswith("key"))
    return keys.select("table_name", "column_name", "row_count", "distinct_count", "unique_ratio")


def dictionary_enrich(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    profile = column_profile({t: views.raw(t) for t in RAW_TABLES})
    dictionary = spark.createDataFrame(
        DICTIONARY, "table_name string, column_name string, description string, allowed_values string"
    )
    enriched = enrich_with_dictionary(profile, dictionary, file_suffix=".parquet")
    return enriched.select("table_name", "column_name", "distinct_count", "description", "allowed_values")


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    found = find_relationships(Views(spark, sf).key_columns())
    return found.select(
        "left_table", "right_table", "key", "is_root_related", "left_unique_ratio", "right_unique_ratio",
        "left_is_unique", "right_is_unique", "relation_type", "requires_aggregation",
    )


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    found = find_relationships(Views(spark, sf).key_columns())
    return rank_candidates(both_directions(found), prefer=[("users", "nations")])


def ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select(
        "from_table", "to_table", "key", "root_penalty", "aggregation_penalty", "preference", "rank", "relation_type"
    )


def join_tree(spark: SparkSession, sf: str) -> DataFrame:
    edges = grow_tree(_ranked(spark, sf))
    tree = tree_frame(spark, edges).select(
        F.col("edge_ord").cast("bigint").alias("edge_ord"), "parent_table", "child_table", "parent_key",
        "relation_type", "requires_aggregation", F.col("distance").cast("bigint").alias("distance"),
        F.array_join("path", ">").alias("path"), "reason",
    )
    left_out = unreachable(["train", *Views(spark, sf).tables()], edges)
    return tree.withColumn("n_unreachable", F.lit(len(left_out)).cast("bigint"))


def direct_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    return direct_enrich(views.train, "users", views.users, "user_id", null_safe=True)


def aggregate_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    return aggregate_enrich(views.train, "orders", views.orders, "user_id")


def fixture_tree(spark: SparkSession, sf: str):
    """The tree the discovery finds on the views (see ``join_tree``)."""
    return grow_tree(_ranked(spark, sf))


def snowflake_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    with shuffles_released(spark):
        edges = fixture_tree(spark, sf)
    return enrich_tree(views.train, views.tables(), edges, store_children=True)


def tree_both_roots(spark: SparkSession, sf: str) -> DataFrame:
    """The tree joined to both roots with shared frames."""
    views = Views(spark, sf, keep=True)
    wide = enrich_roots({"train": views.train.drop("target"), "test": views.test}, views.tables(), fixture_tree(spark, sf))
    return wide["train"].withColumn("root", F.lit("train")).unionByName(wide["test"].withColumn("root", F.lit("test")))


def discovered_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The tree as the workflow finds it: exact counts only for keys that may be unique."""
    found = discover(Views(spark, sf).bundle(), prefer=[("users", "nations")])
    unique = [f"{table}.{key}" for table, key in sorted(found.unique_keys)]
    return tree_frame(spark, found.edges).select(
        F.col("edge_ord").cast("bigint").alias("edge_ord"), "parent_table", "child_table", "parent_key", "relation_type",
        "requires_aggregation", F.array_join("path", ">").alias("path"), F.lit(",".join(unique)).alias("unique_keys"),
    )


def null_key_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders joined to statistics of a partly missing attribute: null is a key like any other."""
    views = Views(spark, sf)
    orders = views.raw("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("priority"),
    )
    stats = aggregate_by_key(orders, ["priority"], [Measure("size", "same_priority"), Measure("min", "first_order", "order_id")])
    return attach(orders, ["priority"], [stats])


def numeric_actions(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    action = Action(
        "aggregate_numeric", "orders", "user_id", ("days_since_prior_order", "order_dow"),
        ("count", "mean", "max", "min", "sum", "std", "nunique"),
    )
    plan = _plan("orders", "user_id", action)
    result = apply_actions({"train": views.train}, {"orders": views.orders}, [plan]).roots["train"]
    return result.withColumns({c: F.round(c, 6) for c in result.columns if c.endswith(("__std", "__mean"))})


def _line_facts(views: Views) -> DataFrame:
    return views.raw("lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_returnflag").alias("return_flag"),
        F.date_format("l_shipdate", "yyyy-MM").alias("ship_month"),
        F.col("l_quantity").alias("quantity"),
    )


def _categorical(views: Views, *aggregations: str, columns=("return_flag",), values=None, key="product_id") -> DataFrame:
    action = Action("aggregate_categorical", "lines", key, tuple(columns), aggregations, values=values)
    products = views.products.select("product_id")
    tables = {"lines": _line_facts(views)}
    return apply_actions({"products": products}, tables, [_plan("lines", key, action)]).roots["products"]


def categorical_nunique(spark: SparkSession, sf: str) -> DataFrame:
    return _categorical(Views(spark, sf), "nunique", columns=("return_flag", "ship_month"))


def most_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return _categorical(Views(spark, sf), "most_frequent", columns=("return_flag", "ship_month", "quantity"))


def top_value_report(spark: SparkSession, sf: str) -> DataFrame:
    lines = _line_facts(Views(spark, sf))
    return top_values(lines, ["return_flag", "ship_month"], 3).select("column_name", "value", "n_rows", "rank")


def topk_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _categorical(Views(spark, sf), "top_k_frequency", values={"return_flag": ("R", "A", "N")})


def topk_frequency_open(spark: SparkSession, sf: str) -> DataFrame:
    """The values are looked up; names are made positional so that they do not depend on the data."""
    views = Views(spark, sf)
    found = _categorical(views, "top_k_frequency", columns=("ship_month",))
    features = [c for c in found.columns if c != "product_id"]
    return found.select("product_id", *[F.col(f"`{c}`").alias(f"freq_{i + 1}") for i, c in enumerate(features)])


def topk_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return _categorical(Views(spark, sf), "top_k_one_hot", values={"return_flag": ("R", "A", "N")})


def direct_action(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    action = Action("direct_join", "products", "product_id", ("product_id", "brand", "size"))
    return apply_actions({"train": views.train}, {"products": views.products}, [_plan("products", "product_id", action)]).roots["train"]


def action_status(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each action of a mixed plan, with the row counts of the joined roots."""
    views = Views(spark, sf)
    roots = {"train": views.train, "test": views.test}
    tables = {"orders": views.orders, "products": views.products, "nations": views.nations}
    result = apply_actions(
        roots,
        tables,
        [
            _plan(
                "orders", "user_id",
                Action("direct_join", "orders", "user_id", ("order_dow",)),
                Action("aggregate_numeric", "orders", "user_id", ("order_dow",), ("mean",)),
                Action("aggregate_numeric", "orders", "user_id", ("order_dow",), ("median",)),
            ),
            _plan(
                "products", "product_id",
                Action("direct_join", "products", "product_id", ("size",)),
                Action("direct_join", "products", "product_id", ("colour",)),
                Action("skip", "products", "product_id"),
            ),
            _plan("nations", "nation_id", Action("direct_join", "nations", "nation_id", ("nation",))),
            _plan("shops", "shop_id", Action("direct_join", "shops", "shop_id", ("name",))),
        ],
    )
    status = result.status_frame(spark).select("action_ord", "source_table", "action_type", "status")
    counts = [df.agg(F.count(F.lit(1)).alias(f"{name}_rows")) for name, df in result.roots.items()]
    return status.withColumns({f"{n}_rows": c.scalar() for n, c in zip(result.roots, counts)})


def spec_filtered(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    group = ("user_id",)
    spec = FeatureSpec(
        "weekend purchases",
        (
            Aggregation("product_id", "count", group, "weekend_items", "order_items", "order_dow in (0, 6)"),
            Aggregation("product_id", "nunique", group, "weekend_products", "order_items", "order_dow in (0, 6)"),
            Aggregation("add_to_cart_order", "max", group, "late_position", "order_items", "order_hour_of_day >= 18"),
        ),
        join_paths=(("train", "orders", "order_items"),),
    )
    tables = {"orders": views.orders, "order_items": views.item_keys}
    return apply_specs({"train": views.train}, tables, [spec], {("orders", "order_id")}).roots["train"]


def spec_ratio(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf, keep=True)
    group = ("user_id", "brand")
    spec = FeatureSpec.from_dict(
        {
            "title": "brand share",
            "join_paths": [["train", "orders", "order_items", "products"]],
            "aggregations": [
                {"source_table": "order_items", "source_column": "product_id", "operation": "ratio",
                 "group_by_columns": list(group), "feature_name": "brand_ratio"},
                {"source_table": "order_items", "source_column": "kind", "operation": "mode_ratio",
                 "group_by": list(group), "feature_name": "kind_mode_ratio"},
            ],
        }
    )
    tables = {"orders": views.order_users, "order_items": views.item_keys, "products": views.products}
    known = {("orders", "order_id"), ("products", "product_id")}
    return apply_specs({"train": views.train}, tables, [spec], known).roots["train"]


def category_history(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf, keep=True)
    tables = {"orders": views.order_users, "order_items": views.order_items, "products": views.products}
    known = {("orders", "order_id"), ("products", "product_id")}
    return apply_specs({"train": views.train}, tables, [category_families("kind")], known).roots["train"]


def pair_features(root: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """A builder: how often a user bought a product, and the share of repeats among those."""
    items = left_join_unique(tables["order_items"], tables["orders"], ["order_id"], columns=["user_id"])
    measures = [Measure("size", "user_product_order_count"), Measure("share_of_ones", "user_product_reorder_rate", "reordered")]
    return aggregate_by_key(items, ["user_id", "product_id"], measures).visible()


def pair_history(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf, keep=True)
    tables = {"orders": views.order_users, "order_items": views.order_items}
    return merge_feature(views.train, pair_features(views.train.drop("target"), tables), ["user_id", "product_id"])


def builder_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Two builders in turn on both roots; the second uses what the first made."""
    views = Views(spark, sf, keep=True)
    tables = {"orders": views.order_users, "order_items": views.order_items}

    def product_popularity(root: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
        measures = [Measure("size", "product_pairs"), Measure("max", "product_top_count", "user_product_order_count")]
        return aggregate_by_key(root, ["product_id"], measures).visible()

    builders = [
        FeatureBuilder("pair history", ("user_id", "product_id"), pair_features),
        FeatureBuilder("product popularity", ("product_id",), product_popularity),
    ]
    roots = apply_builders({"train": views.train, "test": views.test}, tables, builders, on_error="raise").roots
    return roots["train"].drop("target").withColumn("root", F.lit("train")).unionByName(
        roots["test"].withColumn("root", F.lit("test"))
    )


def plan_responses(orders: DataFrame) -> DataFrame:
    """One response per order: a JSON plan, fenced, in prose, bare, absent or broken by priority, with
    an action by order status."""
    action_type = F.when(F.col("o_orderstatus") == "F", "direct_join").when(
        F.col("o_orderstatus") == "O", " aggregate_numeric "
    ).otherwise("make_coffee")
    json = F.concat(
        F.lit('{"source_table": " table_'), F.col("o_custkey").cast("string"),
        F.lit('", "join_key": "user_id", "relation_type": "many_to_one", "requires_aggregation": false, "comment": "  ", '
              '"actions": [{"action_type": "'), action_type,
        F.lit('", "source_table": "users", "join_key": "user_id", "columns": [" a ", "", "b"], "reason": "'),
        F.when(F.col("o_totalprice") < 50000, " ").otherwise("useful"), F.lit('"}]}'),
    )
    priority = F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", F.concat(F.lit("```json\n"), json, F.lit("\n```")))
        .when(priority == "2-HIGH", F.concat(F.lit("Here is the plan:\n"), json, F.lit("\nDone.")))
        .when(priority == "3-MEDIUM", json)
        .when(priority == "4-NOT SPECIFIED", F.lit("no plan for this table"))
        .otherwise(F.concat(F.lit("{broken "), json))
    )
    return orders.select(F.col("o_orderkey").alias("order_id"), text.alias("text"))


def plan_ingest(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_plans(plan_responses(Views(spark, sf).raw("orders")))
    first = F.try_element_at(F.col("plan.actions"), F.lit(1))
    return parsed.select(
        "order_id", "is_valid", "error",
        F.col("plan.source_table").alias("source_table"),
        F.col("plan.comment").alias("comment"),
        first["action_type"].alias("action_type"),
        F.array_join(first["columns"], ",").alias("columns"),
    )


def spec_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Specs from one response per order; the operation comes from the status, the grouping spelling
    from the priority."""
    operation = F.when(F.col("o_orderstatus") == "P", "median").otherwise("mode_ratio")
    grouping = F.when(F.col("o_orderpriority") == "1-URGENT", "group_by").otherwise("group_by_columns")
    text = F.concat(
        F.lit('Specs: {"compiled_feature_specs": [{"title": "t'), F.col("o_custkey").cast("string"),
        F.lit('", "hypothesis": "h", "aggregations": [{"source_column": "c", "operation": "'), operation,
        F.lit('", "'), grouping, F.lit('": ["user_id", "kind"], "feature_name": "f"}]}]} end'),
    )
    responses = Views(spark, sf).raw("orders").select(F.col("o_orderkey").alias("order_id"), text.alias("text"))
    spec = F.try_element_at(F.col("specs"), F.lit(1))
    item = F.try_element_at(spec["aggregations"], F.lit(1))
    return parse_specs(responses).select(
        "order_id", "is_valid", "error", spec["title"].alias("title"), item["operation"].alias("operation"),
        F.array_join(F.coalesce(item["group_by"], item["group_by_columns"]), ",").alias("group_by"),
    )


def label_backjoin(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    output = direct_enrich(views.train.drop("target"), "products", views.products.select("product_id", "size"), "product_id")
    return with_target(output, views.train)


def held_out_labels(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf)
    return with_held_out_labels(views.test, views.test_labels)


def document_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels; most have none and stay with nulls."""
    views = Views(spark, sf)
    documents = views.raw("documents").select("doc_id", "lang", "n_chars")
    return direct_enrich(documents, "labels", views.raw("labels"), "doc_id")


def impute_mixed(spark: SparkSession, sf: str) -> DataFrame:
    orders = Views(spark, sf).orders_v.withColumn("daytime", F.when(F.col("order_hour_of_day") < 12, "morning"))
    return fill_missing(orders, ["days_since_prior_order", "daytime", "order_dow"])


def split_holdout(spark: SparkSession, sf: str) -> DataFrame:
    rows = Views(spark, sf).raw("orders").select(F.col("o_orderkey").alias("row_id"))
    return with_holdout(rows).withColumn("bucket", hash_number(F.col("row_id")))


def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return with_exact_holdout(Views(spark, sf).train).select("row_id", "target", "is_holdout")


def cv_folds(spark: SparkSession, sf: str) -> DataFrame:
    return with_folds(Views(spark, sf).train).select("row_id", "target", "fold")


def cv_folds_exact(spark: SparkSession, sf: str) -> DataFrame:
    return with_exact_folds(Views(spark, sf).train).select("row_id", "target", "fold")


def product_score(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of a plain score: how often the product was bought before."""
    views = Views(spark, sf)
    counts = aggregate_by_key(views.user_items, ["product_id"], [Measure("size", "score")])
    return auc_by_rank(attach(views.pairs, ["product_id"], [counts]), "score", "target")


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return with_class_weights(Views(spark, sf).train, "target").select("row_id", "target", "weight")


def _two_features(views: Views, roots: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Both roots with two features, the second missing for many products."""
    roots = roots or {"train": views.train, "test": views.test}
    orders = aggregate_by_key(views.order_users, ["user_id"], [Measure("size", "user_orders")])
    late = aggregate_by_key(
        views.user_items.where("add_to_cart_order >= 7"), ["product_id"], [Measure("size", "product_late")]
    )
    return {
        name: attach(attach(df, ["user_id"], [orders]), ["product_id"], [late])
        for name, df in roots.items()
    }


def checked_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The roots are stored, their outputs written; the checks follow from what was counted meanwhile."""
    views = Views(spark, sf)
    stored_roots = {name: stored_counted(df) for name, df in (("train", views.train), ("test", views.test))}
    bases = {name: df for name, (df, _) in stored_roots.items()}
    outputs = _two_features(views, bases)
    folder = f"{shared_folder(spark)}/checked-{uuid.uuid4().hex}"
    written = {name: write_counted(df, f"{folder}/{name}.parquet", columns=new_columns(bases[name], df)) for name, df in outputs.items()}
    return output_checks(bases, outputs, written=written, base_counts={name: counts for name, (_, counts) in stored_roots.items()})


def final_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Base columns and the features of both selection rules: numeric ones, and all but id and label."""
    views = Views(spark, sf)
    wide = direct_enrich(_two_features(views)["train"], "products", views.products, "product_id")
    numeric = numeric_features(wide, views.train.columns)
    everything = all_features(wide, exclude=("user_id", "product_id"))
    named = final_projection(wide, views.train.columns, numeric)
    return named.withColumns({"n_numeric": F.lit(len(numeric)).cast("bigint"), "n_all": F.lit(len(everything)).cast("bigint")})


def user_summary(spark: SparkSession, sf: str) -> DataFrame:
    history = Views(spark, sf).user_history
    ratios = ("avg_days_between_orders", "reordered_share", "avg_basket_size")
    return history.withColumns({c: F.round(c, 6) for c in ratios})


def _wide(views: Views, pairs: DataFrame) -> DataFrame:
    """Pairs with numeric features of user, product and pair, and one text feature."""
    users = aggregate_by_key(
        views.user_items, ["user_id"],
        [Measure("size", "user_items"), Measure("nunique", "user_products", "product_id"), Measure("mean", "user_position", "add_to_cart_order")],
    )
    products = aggregate_by_key(
        views.user_items, ["product_id"],
        [Measure("size", "product_items"), Measure("nunique", "product_users", "user_id"), Measure("std", "product_spread", "user_id")],
    )
    tables = {"orders": views.order_users, "order_items": views.order_items}
    wide = attach(attach(pairs, ["user_id"], [users]), ["product_id"], [products])
    wide = direct_enrich(wide, "products", views.products.select("product_id", "kind", "price"), "product_id")
    return merge_feature(wide, pair_features(pairs, tables), ["user_id", "product_id"])


def _model_table(views: Views, roots: Sequence[str] = ("train", "test")) -> dict[str, DataFrame]:
    """The roots with their features; if there are several, these are joined to the pairs of all of them once, and stored."""
    if len(roots) == 1:
        return {name: _wide(views, getattr(views, name)) for name in roots}
    wide = views.split(stored(_wide(views, views.pairs)))
    return {name: wide[name] for name in roots}


# Bands of pairs, and the first band whose pairs carry the planted label.
BANDS, PLANTED_BAND, BAND_SEED = 12, 8, 9


def _planted(views: Views, roots: Sequence[str] = ("train", "test")) -> dict[str, DataFrame]:
    """The model tables with a label that follows from one feature, so that SQL can tell what a model must find."""
    band = F.pmod(hash_number(F.col("row_id"), BAND_SEED), F.lit(BANDS)).cast("int")
    return {
        name: df.withColumn("pair_band", band).withColumn("target", (F.col("pair_band") >= PLANTED_BAND).cast("int"))
        for name, df in _model_table(views, roots).items()
    }


def feature_ranking(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf, keep=True)
    model, _, _ = rank_features(_planted(views, ["train"])["train"], views.train.columns)
    return top_features(model.importances(spark), 5)


def top5_retrain(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf, keep=True)
    base = {"train": views.train.columns, "test": views.train.columns}
    summary = select_features(_planted(views), base, exact_split=True).summary()
    return summary.select(
        F.round("validation_auc_all", 6).alias("validation_auc_all"),
        F.round("validation_auc_selected", 6).alias("validation_auc_selected"),
        F.array_join("selected", ",").alias("selected"),
    )


def score_report(spark: SparkSession, sf: str) -> DataFrame:
    views = Views(spark, sf, keep=True)
    tables = _planted(views)
    score = score_output(
        tables["train"].drop("target"), tables["test"].drop("target"), tables["test"].select("row_id", "target"),
        source_train=tables["train"], keys=("user_id", "product_id"), parallelism=6,
    )
    return score.report


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pair history on the train root, then the whole join tree."""
    views = Views(spark, sf)
    return enrich_tree(pair_history(spark, sf), views.tables(), fixture_tree(spark, sf))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Given tables written as CSV, loaded again as a folder with types found in the data, profiled, and the profile
    stored and read back."""
    views, folder = Views(spark, sf), f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    for name in CSV_TABLES:
        write_table(views.raw(name), f"{folder}/{name}.csv", "csv")
    tables = load_bundle(spark, folder, train_name="customer", test_name="nation").tables
    save_profile(column_profile(tables), f"{folder}/profile")
    return load_profile(spark, f"{folder}/profile").select(
        "table_name", "column_name", "row_count", "non_null_count", "distinct_count", "non_null_ratio", "unique_ratio"
    )


def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate_by_key(Views(spark, sf).order_items, ["order_id", "product_id"], []).visible()


def failing_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of outputs that lost rows and a base column, and whose features differ and hold no value."""
    views = Views(spark, sf)
    outputs = {
        "train": views.train.drop("target").where("product_id % 2 = 0").withColumn("a", F.lit(None).cast("double")),
        "test": views.test.where("product_id < 0").withColumn("b", F.lit(1)),
    }
    return output_checks({"train": views.train, "test": views.test}, outputs)


def table_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Which tables the join tree reaches; one that shares no key is never reached."""
    edges = grow_tree(_ranked(spark, sf))
    names = [*Views(spark, sf).tables(), "lines"]
    rows = [(t, True) for t in tables_to_plan(edges)] + [(t, False) for t in unreachable(names, edges)]
    return spark.createDataFrame(rows, "table_name string, reached boolean")


def name_collision(spark: SparkSession, sf: str) -> DataFrame:
    """A column of the base stays when a joined table brings one of the same name."""
    views = Views(spark, sf)
    base = views.train.withColumn("users__balance", F.col("product_id") * F.lit(-1.0))
    return direct_enrich(base, "users", views.users, "user_id")


def reported_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features that a score report lists, from a model of all rows without cross-validation."""
    views = Views(spark, sf, keep=True)
    tables = _planted(views)
    score = score_output(
        tables["train"].drop("target"), tables["test"].drop("target"), tables["test"].select("row_id", "target"),
        source_train=tables["train"], keys=("user_id", "product_id"), folds=0,
    )
    return score.top_features


def table_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Column names of delimited tables, read from their headers alone."""
    views, folder = Views(spark, sf), f"{shared_folder(spark)}/headers-{uuid.uuid4().hex}"
    rows = []
    for name in CSV_TABLES:
        write_table(views.raw(name), f"{folder}/{name}.csv", "csv")
        rows += [(name, i, c) for i, c in enumerate(header_columns(spark, f"{folder}/{name}.csv"))]
    return spark.createDataFrame(rows, "table_name string, column_ord int, column_name string")


def stored_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Delimited and columnar tables read through a store twice: the second time nothing is parsed or profiled, and
    the key profile comes from what the store keeps. Counts that are not exact are left open."""
    views, folder = Views(spark, sf), f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    for name in RAW_TABLES:
        write_table(views.raw(name), f"{folder}/data/{name}.{'csv' if name in CSV_TABLES else 'parquet'}", "csv" if name in CSV_TABLES else "parquet")

    def profile() -> DataFrame:
        store = TableStore(spark, f"{folder}/store")
        bundle = load_bundle(spark, f"{folder}/data", train_name="lineitem", test_name="orders", store=store)
        return store.key_profile(lambda table, column: column.endswith("key"), list(bundle.tables))

    profile()
    exact = F.when(F.col("is_exact"), F.col("distinct_count"))
    return profile().select("table_name", "column_name", "row_count", "non_null_count", "is_exact", exact.alias("distinct_count"))


def root_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Whether both roots have the same columns, before and after a join to one of them, and what the join added."""
    views = Views(spark, sf)
    wide = direct_enrich(views.train, "products", views.products, "product_id")
    rows = [("roots", same_columns(views.train, views.test), None), ("one joined", same_columns(wide, views.test), None)]
    rows += [("added", True, c) for c in added_columns(views.train, wide)]
    return spark.createDataFrame(rows, "step string, passed boolean, column_name string")


def builder_status(spark: SparkSession, sf: str) -> DataFrame:
    """What became of builders that work, repeat a key, bring a known column, lack a key and return no table, and the
    rows and columns of the roots after all of them."""
    views = Views(spark, sf, keep=True)
    tables = {"orders": views.order_users, "order_items": views.order_items}
    builders = [
        FeatureBuilder("pair history", ("user_id", "product_id"), pair_features),
        FeatureBuilder("repeated", ("user_id",), lambda root, tables: tables["orders"].select("user_id", F.lit(1).alias("one"))),
        FeatureBuilder("known column", ("user_id",), lambda root, tables: root.groupBy("user_id").agg(F.max("row_id").alias("row_id"))),
        FeatureBuilder("no key", ("shop_id",), pair_features),
        FeatureBuilder("no table", ("user_id",), lambda root, tables: 7),
        FeatureBuilder("empty", ("user_id",), lambda root, tables: root.where("false").select("user_id", F.lit(1).alias("none"))),
    ]
    result = apply_builders({"train": views.train, "test": views.test}, tables, builders)
    status = result.status_frame(spark).select("action_ord", "source_table", "join_key", "status", (F.col("detail") == "").alias("silent"))
    rows = result.roots["train"].agg(F.count(F.lit(1)).alias("n")).scalar()
    return status.withColumn("train_rows", rows).withColumn("n_columns", F.lit(len(result.roots["train"].columns)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_round_trip": csv_round_trip,
    "distinct_keys": distinct_keys,
    "failing_checks": failing_checks,
    "table_reach": table_reach,
    "name_collision": name_collision,
    "column_profile": profile_columns,
    "table_profile": profile_tables,
    "candidate_keys": key_candidates,
    "dictionary_enrich": dictionary_enrich,
    "relationships": relationships,
    "ranked_candidates": ranked_candidates,
    "join_tree": join_tree,
    "direct_enrich": direct_enrichment,
    "agg_enrich": aggregate_enrichment,
    "snowflake_enrich": snowflake_enrichment,
    "tree_both_roots": tree_both_roots,
    "discovered_tree": discovered_tree,
    "null_key_join": null_key_join,
    "numeric_actions": numeric_actions,
    "categorical_nunique": categorical_nunique,
    "most_frequent": most_frequent,
    "top_values": top_value_report,
    "topk_frequency": topk_frequency,
    "topk_frequency_open": topk_frequency_open,
    "topk_one_hot": topk_one_hot,
    "direct_action": direct_action,
    "action_status": action_status,
    "spec_filtered": spec_filtered,
    "spec_ratio": spec_ratio,
    "category_families": category_history,
    "pair_history": pair_history,
    "builder_apply": builder_apply,
    "plan_ingest": plan_ingest,
    "spec_ingest": spec_ingest,
    "label_backjoin": label_backjoin,
    "held_out_labels": held_out_labels,
    "document_labels": document_labels,
    "impute_mixed": impute_mixed,
    "split_holdout": split_holdout,
    "split_exact": split_exact,
    "cv_folds": cv_folds,
    "cv_folds_exact": cv_folds_exact,
    "auc_by_rank": product_score,
    "class_weights": class_weights,
    "output_checks": checked_outputs,
    "final_projection": final_columns,
    "user_summary": user_summary,
    "rank_features": feature_ranking,
    "top5_retrain": top5_retrain,
    "score_report": score_report,
    "reported_features": reported_features,
    "table_headers": table_headers,
    "stored_profile": stored_profile,
    "root_columns": root_columns,
    "builder_status": builder_status,
}
