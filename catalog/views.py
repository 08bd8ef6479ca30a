"""The test tables seen as a purchase-history data set: labelled user/product pairs and the tables
around them. History ends at the cutoff; labels come from what follows it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from relfold.functions.ordered import with_position
from relfold.modeling.split import hash_fraction
from relfold.operators.aggregates import Measure, aggregate_by_key
from relfold.operators.keyed import attach, keyed
from relfold.operators.profile import as_metadata, column_profile
from relfold.session import stored
from relfold.sources.files import Bundle, TableSet
from relfold.workflow import named_like_id

CUTOFF = "2000-04-01"
TEST_SHARE = 0.2
TEST_SEED = 7


class Views:
    """``keep`` stores the items with their orders once, for queries that read several tables made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = False):
        self.spark = spark
        self._dir = sf_dir.rstrip("/")
        self._keep = keep

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")

    @cached_property
    def _order_facts(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("order_date"),
            F.expr(f"o_orderdate < timestamp_ntz'{CUTOFF} 00:00:00'").alias("is_prior"),
        )

    @cached_property
    def orders_v(self) -> DataFrame:
        month = F.year("order_date") * 12 + F.month("order_date")
        placed = with_position(
            self._order_facts, ["user_id"], month, ["order_date", "order_id"], "order_number",
            previous={"order_date": "previous_date"},
        )
        return placed.select(
            "order_id",
            "user_id",
            F.when(F.col("is_prior"), "prior").otherwise("train").alias("eval_set"),
            "order_number",
            (F.dayofweek("order_date") - 1).alias("order_dow"),
            (F.col("order_id") % 24).cast("int").alias("order_hour_of_day"),
            F.date_diff(F.to_date("order_date"), F.to_date("previous_date")).alias("days_since_prior_order"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        """Orders of the history."""
        return self.orders_v.where("eval_set = 'prior'")

    @cached_property
    def order_users(self) -> DataFrame:
        """(order_id, user_id) of the history."""
        return self._orders_kept.where("is_prior").select("order_id", "user_id")

    @cached_property
    def _orders_kept(self) -> DataFrame:
        """The orders' facts; read once for the items and for themselves if they are kept."""
        return stored(self._order_facts) if self._keep else self._order_facts

    @cached_property
    def _items(self) -> DataFrame:
        items = self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").alias("add_to_cart_order"),
        )
        facts = keyed(self._orders_kept, ["order_id"], null_safe=False)
        joined = attach(items, ["order_id"], [facts]).where("user_id is not null")
        return stored(joined) if self._keep else joined

    @cached_property
    def items_all(self) -> DataFrame:
        """Items with ``reordered``: 1 unless it is the user's first purchase of the product."""
        # (date, order, position) as one number: a fixed-width minimum is kept in a hash aggregate.
        days = F.unix_date(F.to_date("order_date")).cast("decimal(38,0)")
        order = F.col("order_id").cast("decimal(38,0)")
        place = days * F.expr("1e28BD") + order * F.expr("1e9BD") + F.col("add_to_cart_order")
        first = F.min(place).over(Window.partitionBy("user_id", "product_id"))
        return self._items.withColumn("reordered", F.when(place == first, 0).otherwise(1))

    @cached_property
    def order_items(self) -> DataFrame:
        return self.items_all.where("is_prior").select("order_id", "product_id", "add_to_cart_order", "reordered")

    @cached_property
    def item_keys(self) -> DataFrame:
        """Keys and cart position of the history items, without the costlier ``reordered``."""
        return self._items.where("is_prior").select("order_id", "product_id", "add_to_cart_order")

    @cached_property
    def user_items(self) -> DataFrame:
        """History items with their user."""
        return self._items.where("is_prior").select("order_id", "user_id", "product_id", "add_to_cart_order")

    @cached_property
    def pairs(self) -> DataFrame:
        grouped = self._items.groupBy("user_id", "product_id").agg(
            F.bool_or("is_prior").alias("has_history"), F.bool_or(~F.col("is_prior")).alias("bought_later")
        )
        return grouped.where("has_history").select(
            F.concat_ws("-", "user_id", "product_id").alias("row_id"),
            "user_id",
            "product_id",
            F.col("bought_later").cast("int").alias("target"),
        )

    def _in_test(self):
        return hash_fraction(F.col("row_id"), TEST_SEED) < F.lit(TEST_SHARE)

    def split(self, pairs: DataFrame) -> dict[str, DataFrame]:
        """Pairs, with whatever columns, as the two roots."""
        return {"train": pairs.where(~self._in_test()), "test": pairs.where(self._in_test()).drop("target")}

    @cached_property
    def train(self) -> DataFrame:
        return self.split(self.pairs)["train"]

    @cached_property
    def test(self) -> DataFrame:
        return self.split(self.pairs)["test"]

    @cached_property
    def test_labels(self) -> DataFrame:
        return self.pairs.where(self._in_test()).select("row_id", "target")

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_nationkey").alias("nation_id"),
            F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("segment"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("kind"),
            F.col("p_size").alias("size"),
            F.col("p_retailprice").alias("price"),
        )

    @cached_property
    def nations(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("nation_id"),
            F.col("n_name").alias("nation"),
            F.col("n_regionkey").alias("region_id"),
        )

    @cached_property
    def regions(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region"))

    @cached_property
    def user_history(self) -> DataFrame:
        """Users with the aggregates of their history."""
        orders = aggregate_by_key(
            self.orders,
            ["user_id"],
            [
                Measure("size", "total_orders"),
                Measure("mean", "avg_days_between_orders", "days_since_prior_order"),
                Measure("mode", "favorite_day_of_week", "order_dow"),
                Measure("mode", "favorite_hour_of_day", "order_hour_of_day"),
            ],
        )
        items = self.items_all.where("is_prior")
        items = aggregate_by_key(
            items,
            ["user_id"],
            [
                Measure("size", "total_items"),
                Measure("nunique", "total_distinct_products", "product_id"),
                Measure("share_of_ones", "reordered_share", "reordered"),
            ],
        )
        joined = attach(self.users, ["user_id"], [orders, items])
        basket = F.try_divide(F.col("total_items").cast("double"), F.col("total_orders").cast("double"))
        return joined.withColumn("avg_basket_size", basket).drop("total_items")

    def tables(self) -> dict[str, DataFrame]:
        return {
            "nations": self.nations,
            "order_items": self.order_items,
            "orders": self.orders,
            "products": self.products,
            "regions": self.regions,
            "users": self.users,
        }

    def bundle(self) -> Bundle:
        return Bundle(TableSet({"train": self.train, "test": self.test, **self.tables()}))

    def key_columns(self) -> DataFrame:
        """Exact profile of the key columns of the train root and the tables around it."""
        tables = {"train": self.train, **self.tables(), "orders": self.order_users, "order_items": self.item_keys}
        keys = {n: df.select(*[c for c in df.columns if named_like_id(n, c)]) for n, df in tables.items()}
        return as_metadata(column_profile(keys))
