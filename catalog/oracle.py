"""DuckDB SQL that defines each registered query on the same tables."""

from __future__ import annotations

_BUCKET = "CAST('0x' || substr(md5('{seed}|' || {id}), 1, 8) AS BIGINT)"


def _bucket(id_column: str, seed: int = 42) -> str:
    return _BUCKET.format(id=id_column, seed=seed)


_VIEWS = f"""
WITH orders_v AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id,
         CASE WHEN o_orderdate < TIMESTAMP '2000-04-01' THEN 'prior' ELSE 'train' END AS eval_set,
         CAST(row_number() OVER u AS INTEGER) AS order_number,
         CAST(dayofweek(o_orderdate) AS INTEGER) AS order_dow,
         CAST(o_orderkey % 24 AS INTEGER) AS order_hour_of_day,
         CAST(date_diff('day', CAST(lag(o_orderdate) OVER u AS DATE), CAST(o_orderdate AS DATE)) AS INTEGER) AS days_since_prior_order
  FROM orders
  WINDOW u AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
),
orders_prior AS (SELECT * FROM orders_v WHERE eval_set = 'prior'),
items_all AS (
  SELECT l_orderkey AS order_id, o_custkey AS user_id, l_partkey AS product_id, l_linenumber AS add_to_cart_order,
         CASE WHEN rank() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderdate, l_orderkey, l_linenumber) = 1
              THEN 0 ELSE 1 END AS reordered,
         o_orderdate < TIMESTAMP '2000-04-01' AS is_prior
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
order_items AS (SELECT order_id, product_id, add_to_cart_order, reordered FROM items_all WHERE is_prior),
user_items AS (SELECT order_id, user_id, product_id, add_to_cart_order, reordered FROM items_all WHERE is_prior),
pairs AS (
  SELECT user_id || '-' || product_id AS row_id, user_id, product_id,
         CAST(max(CASE WHEN is_prior THEN 0 ELSE 1 END) AS INTEGER) AS target
  FROM items_all GROUP BY user_id, product_id HAVING bool_or(is_prior)
),
train AS (SELECT * FROM pairs WHERE {_bucket('row_id', 7)} / 4294967296.0e0 >= 0.2e0),
test AS (SELECT row_id, user_id, product_id FROM pairs WHERE {_bucket('row_id', 7)} / 4294967296.0e0 < 0.2e0),
test_labels AS (SELECT row_id, target FROM pairs WHERE {_bucket('row_id', 7)} / 4294967296.0e0 < 0.2e0),
users AS (SELECT c_custkey AS user_id, c_nationkey AS nation_id, c_acctbal AS balance, c_mktsegment AS segment FROM customer),
products AS (SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS kind, p_size AS size,
                    p_retailprice AS price FROM part),
nations AS (SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey AS region_id FROM nation),
regions AS (SELECT r_regionkey AS region_id, r_name AS region FROM region),
lines AS (
  SELECT l_partkey AS product_id, l_suppkey AS supplier_id, l_returnflag AS return_flag,
         strftime(l_shipdate, '%Y-%m') AS ship_month, l_quantity AS quantity
  FROM lineitem
)
"""

_RAW_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "region": ["r_regionkey", "r_name"],
}

_PROFILE = "profile AS (\n" + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS column_ord, CAST(count(*) AS BIGINT) AS row_count, "
    f"CAST(count({c}) AS BIGINT) AS non_null_count, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, "
    f"count({c}) * 1.0e0 / count(*) AS non_null_ratio, count(DISTINCT {c}) * 1.0e0 / count(*) AS unique_ratio FROM {t}"
    for t, columns in _RAW_COLUMNS.items() for i, c in enumerate(columns)
) + "\n)"

_KEYS = [
    ("train", -1, "row_id", 0), ("train", -1, "user_id", 1), ("train", -1, "product_id", 2),
    ("nations", 1, "nation_id", 0), ("nations", 1, "region_id", 1),
    ("order_items", 2, "order_id", 0), ("order_items", 2, "product_id", 1),
    ("orders_prior", 3, "order_id", 0), ("orders_prior", 3, "user_id", 1),
    ("products", 4, "product_id", 0), ("regions", 5, "region_id", 0),
    ("users", 6, "user_id", 0), ("users", 6, "nation_id", 1),
]

_RELATIONS = (
    ",\nkeys AS (\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{'orders' if t == 'orders_prior' else t}' AS table_name, {o} AS ord, '{c}' AS key, {i} AS key_ord, "
        f"count(DISTINCT {c}) * 1.0e0 / count(*) AS ratio FROM {t}"
        for t, o, c, i in _KEYS
    )
    + """
),
found AS (
  SELECT l.table_name AS left_table, r.table_name AS right_table, l.key, l.table_name = 'train' AS is_root_related,
         l.ratio AS left_unique_ratio, r.ratio AS right_unique_ratio, l.ord AS left_ord, r.ord AS right_ord, l.key_ord
  FROM keys l JOIN keys r ON l.key = r.key AND l.ord < r.ord
),
directed AS (
  SELECT left_table AS from_table, right_table AS to_table, key, is_root_related, left_unique_ratio AS a,
         right_unique_ratio AS b, left_ord, right_ord, key_ord FROM found
  UNION ALL
  SELECT right_table, left_table, key, is_root_related, right_unique_ratio, left_unique_ratio, left_ord, right_ord, key_ord FROM found
),
scored AS (
  SELECT *, CASE WHEN is_root_related THEN 0 ELSE 1 END AS root_penalty,
         CASE WHEN (a >= 0.98) <> (b >= 0.98) THEN 0 ELSE 1 END AS aggregation_penalty,
         CASE WHEN from_table = 'users' AND to_table = 'nations' THEN -1 ELSE 0 END AS preference,
         CASE WHEN a >= 0.98 AND b >= 0.98 THEN 'one_to_one' WHEN a >= 0.98 THEN 'one_to_many'
              WHEN b >= 0.98 THEN 'many_to_one' ELSE 'many_to_many' END AS relation_type
  FROM directed
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY from_table ORDER BY root_penalty, aggregation_penalty, preference,
            CASE WHEN is_root_related THEN key_ord ELSE 0 END, left_ord, right_ord, key_ord) AS INTEGER) AS rank
  FROM scored
)
"""
)

# Breadth-first by levels: the best way to a new table is the earliest parent, then the parent's rank.
_TREE_LEVEL = """,
level{n} AS (
  SELECT parent_ord, from_table, to_table, key, relation_type, rank, path || '>' || to_table AS path, b, a, is_root_related, preference FROM (
    SELECT p.ord AS parent_ord, r.*, p.path, row_number() OVER (PARTITION BY r.to_table ORDER BY p.ord, r.rank) AS pick
    FROM tree{m} p JOIN ranked r ON r.from_table = p.table_name
    WHERE r.to_table NOT IN (SELECT table_name FROM {seen})
  ) WHERE pick = 1
),
tree{n} AS (SELECT to_table AS table_name, row_number() OVER (ORDER BY parent_ord, rank) AS ord, path FROM level{n}),
seen{n} AS (SELECT table_name FROM {seen} UNION SELECT table_name FROM tree{n})"""


_TREE_DETAILS = """CAST(distance AS BIGINT) AS distance, path,
       CASE WHEN is_root_related THEN 'touches the root table' ELSE 'reached through another table' END || '; '
         || CASE WHEN preference < 0 THEN 'preferred dimension; ' ELSE '' END
         || format('relation_type={}, left_unique_ratio={:.3f}, right_unique_ratio={:.3f}', relation_type, a, b) AS reason,
       CAST((SELECT count(DISTINCT table_name) FROM keys) - (SELECT count(*) FROM seen3) AS BIGINT) AS n_unreachable"""


def _tree(details: str = _TREE_DETAILS) -> str:
    parts = [",\ntree0 AS (SELECT 'train' AS table_name, 1 AS ord, 'train' AS path),\nseen0 AS (SELECT table_name FROM tree0)"]
    for n in (1, 2, 3):
        parts.append(_TREE_LEVEL.format(n=n, m=n - 1, seen=f"seen{n - 1}"))
    union = " UNION ALL ".join(f"SELECT {n} AS distance, * FROM level{n}" for n in (1, 2, 3))
    return "".join(parts) + f"""
SELECT CAST(row_number() OVER (ORDER BY distance, parent_ord, rank) - 1 AS BIGINT) AS edge_ord,
       from_table AS parent_table, to_table AS child_table, key AS parent_key, relation_type,
       relation_type IN ('one_to_many', 'many_to_many') OR b < 1 AS requires_aggregation, {details}
FROM ({union})"""


def _auto(view: str, table: str, key: str, numeric: list[str], categorical: list[str] = ()) -> str:
    columns = []
    for c in numeric:
        columns += [f"avg({c}) AS {table}__{c}__mean", f"max({c}) AS {table}__{c}__max", f"min({c}) AS {table}__{c}__min",
                    f"CAST(count(DISTINCT {c}) AS BIGINT) AS {table}__{c}__nunique"]
    columns += [f"CAST(count(DISTINCT {c}) AS BIGINT) AS {table}__{c}__nunique" for c in categorical]
    columns.append(f"CAST(count(*) AS BIGINT) AS {table}__row_count")
    return f"SELECT {key}, {', '.join(columns)} FROM {view} GROUP BY {key}"


_ORDERS_AGG = _auto("orders_prior", "orders", "user_id",
                    ["order_id", "order_number", "order_dow", "order_hour_of_day", "days_since_prior_order"], ["eval_set"])
_ITEMS_AGG = _auto("order_items", "order_items", "product_id", ["order_id", "add_to_cart_order", "reordered"])


def _without(alias: str, *names: str) -> str:
    return f"{alias}.* EXCLUDE ({', '.join(names)})"


_TREE_JOIN = f"""
SELECT b.*, u.nation_id AS users__nation_id, u.balance AS users__balance, u.segment AS users__segment,
       p.product_name AS products__product_name, p.brand AS products__brand, p.kind AS products__kind,
       p.size AS products__size, p.price AS products__price,
       {_without('o', 'user_id')}, {_without('i', 'product_id')},
       CAST(n.nation_id AS BIGINT) AS nation_id, n.nation AS nations__nation, n.region_id AS nations__region_id,
       CAST(r.region_id AS BIGINT) AS region_id, r.region AS regions__region
FROM {{base}} b
LEFT JOIN users u ON b.user_id = u.user_id
LEFT JOIN products p ON b.product_id = p.product_id
LEFT JOIN ({_ORDERS_AGG}) o ON b.user_id = o.user_id
LEFT JOIN ({_ITEMS_AGG}) i ON b.product_id = i.product_id
LEFT JOIN nations n ON u.nation_id = n.nation_id
LEFT JOIN regions r ON n.region_id = r.region_id
"""

_HISTORY = """
  SELECT i.user_id, i.product_id, CAST(count(*) AS BIGINT) AS user_product_order_count,
         avg(CASE WHEN reordered = 1 THEN 1 ELSE 0 END) AS user_product_reorder_rate
  FROM user_items i GROUP BY 1, 2"""


def _mode(view: str, key: str, column: str) -> str:
    return (
        f"SELECT {key}, {column} AS v FROM (SELECT {key}, {column}, row_number() OVER (PARTITION BY {key} "
        f"ORDER BY count(*) DESC, {column}) AS pick FROM {view} WHERE {column} IS NOT NULL GROUP BY {key}, {column}) WHERE pick = 1"
    )


_TOP = (
    "SELECT column_name, value, n_rows, CAST(rank AS INTEGER) AS rank FROM (\n"
    "  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n_rows DESC, value) AS rank FROM (\n"
    + "\n    UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, CAST(count(*) AS BIGINT) AS n_rows FROM lines GROUP BY {c}"
        for c in ("return_flag", "ship_month")
    )
    + "\n  ))\nWHERE rank <= 3"
)

_PLAN_TEXT = """
  SELECT o_orderkey AS order_id, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
         '{"source_table": " table_' || o_custkey || '", "join_key": "user_id", "relation_type": "many_to_one", '
         || '"requires_aggregation": false, "comment": "  ", "actions": [{"action_type": "'
         || CASE o_orderstatus WHEN 'F' THEN 'direct_join' WHEN 'O' THEN ' aggregate_numeric ' ELSE 'make_coffee' END
         || '", "source_table": "users", "join_key": "user_id", "columns": [" a ", "", "b"], "reason": "'
         || CASE WHEN o_totalprice < 50000 THEN ' ' ELSE 'useful' END || '"}]}' AS js
  FROM orders"""

_CHECKED = """,
wide AS (
  SELECT 'train' AS root, t.row_id, o.user_orders, l.product_late FROM train t
  LEFT JOIN (SELECT user_id, count(*) AS user_orders FROM orders_prior GROUP BY 1) o ON t.user_id = o.user_id
  LEFT JOIN (SELECT product_id, count(*) AS product_late FROM user_items WHERE add_to_cart_order >= 7 GROUP BY 1) l ON t.product_id = l.product_id
  UNION ALL
  SELECT 'test', t.row_id, o.user_orders, l.product_late FROM test t
  LEFT JOIN (SELECT user_id, count(*) AS user_orders FROM orders_prior GROUP BY 1) o ON t.user_id = o.user_id
  LEFT JOIN (SELECT product_id, count(*) AS product_late FROM user_items WHERE add_to_cart_order >= 7 GROUP BY 1) l ON t.product_id = l.product_id
),
sizes AS (SELECT root, count(*) AS n, count(user_orders) AS n1, count(product_late) AS n2 FROM wide GROUP BY 1),
bases AS (SELECT 'train' AS root, count(*) AS n FROM train UNION ALL SELECT 'test', count(*) FROM test)
SELECT 'base_columns_kept' AS "check", root AS subject, true AS passed, '' AS detail FROM sizes
UNION ALL SELECT 'unique_column_names', root, true, '' FROM sizes
UNION ALL SELECT 'feature_count', root, true, '2' FROM sizes
UNION ALL SELECT 'same_features', 'train/test', true, 'user_orders,product_late'
UNION ALL SELECT 'not_empty', root, n > 0, CAST(n AS VARCHAR) FROM sizes
UNION ALL SELECT 'feature_has_values', root || '.user_orders', n1 > 0, CAST(n1 AS VARCHAR) FROM sizes
UNION ALL SELECT 'feature_has_values', root || '.product_late', n2 > 0, CAST(n2 AS VARCHAR) FROM sizes
UNION ALL SELECT 'row_count_kept', root, s.n = b.n, CAST(s.n - b.n AS VARCHAR) FROM sizes s JOIN bases b USING (root)
"""


def _per_class(expression: str, name: str) -> str:
    return f"""
SELECT row_id, target, {expression} AS {name} FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY {_bucket('row_id')}, row_id) - 1 AS position,
         count(*) OVER (PARTITION BY target) AS class_rows FROM train)"""


# A label that follows from one feature: the chance that a positive has the larger value of it is the AUC that a model
# must reach. The names are those of the numeric features; there is one text feature besides.
_PLANTED = f""",
planted AS (
  SELECT row_id, pair_band, CAST(pair_band >= 8 AS INTEGER) AS y
  FROM (SELECT row_id, CAST({_bucket('row_id', 9)} % 12 AS INTEGER) AS pair_band FROM pairs)
),
per_band AS (SELECT pair_band, sum(y) AS pos, sum(1 - y) AS neg FROM planted GROUP BY 1),
planted_auc AS (
  SELECT round(sum(a.pos * b.neg * CASE WHEN a.pair_band > b.pair_band THEN 1.0e0 WHEN a.pair_band = b.pair_band THEN 0.5e0 ELSE 0.0e0 END)
               / sum(a.pos * 1.0e0 * b.neg), 6) AS auc
  FROM per_band a, per_band b
),
named AS (
  SELECT unnest(['pair_band', 'product_items', 'product_spread', 'product_users', 'products__price', 'user_items',
                 'user_position', 'user_product_order_count', 'user_product_reorder_rate', 'user_products']) AS feature
)
"""

ORACLE: dict[str, str] = {
    "column_profile": f"WITH {_PROFILE} SELECT table_name, column_name, row_count, non_null_count, distinct_count, non_null_ratio, unique_ratio FROM profile",
    "table_profile": f"""WITH {_PROFILE}
SELECT table_name, max(row_count) AS row_count, CAST(count(*) AS BIGINT) AS column_count,
       coalesce(string_agg(CASE WHEN column_name LIKE '%key' THEN column_name END, ',' ORDER BY column_ord), '') AS candidate_keys
FROM profile GROUP BY table_name""",
    "candidate_keys": f"WITH {_PROFILE} SELECT table_name, column_name, row_count, distinct_count, unique_ratio FROM profile WHERE column_name LIKE '%key'",
    "dictionary_enrich": f"""WITH {_PROFILE},
dictionary(table_name, column_name, description, allowed_values) AS (VALUES
  ('orders', 'o_orderkey', 'unique order identifier', NULL), ('orders', 'o_custkey', 'customer of the order', NULL),
  ('orders', 'o_orderstatus', 'state of the order', 'F,O,P'), ('lineitem', 'l_orderkey', 'order of the item', NULL),
  ('lineitem', 'l_returnflag', 'return state', 'A,N,R'), ('part', 'p_size', 'size of the part', '1-50'),
  ('customer', 'c_mktsegment', 'market segment', NULL))
SELECT p.table_name, p.column_name, p.distinct_count, d.description, d.allowed_values
FROM profile p LEFT JOIN dictionary d USING (table_name, column_name)""",
    "relationships": _VIEWS + _RELATIONS + """
SELECT left_table, right_table, key, is_root_related, left_unique_ratio, right_unique_ratio,
       left_unique_ratio >= 0.98 AS left_is_unique, right_unique_ratio >= 0.98 AS right_is_unique,
       CASE WHEN left_unique_ratio >= 0.98 AND right_unique_ratio >= 0.98 THEN 'one_to_one'
            WHEN left_unique_ratio >= 0.98 THEN 'one_to_many' WHEN right_unique_ratio >= 0.98 THEN 'many_to_one'
            ELSE 'many_to_many' END AS relation_type,
       right_unique_ratio < 1 AS requires_aggregation
FROM found""",
    "ranked_candidates": _VIEWS + _RELATIONS + "SELECT from_table, to_table, key, root_penalty, aggregation_penalty, preference, rank, relation_type FROM ranked",
    "join_tree": _VIEWS + _RELATIONS + _tree(),
    "direct_enrich": _VIEWS + """
SELECT t.*, u.nation_id AS users__nation_id, u.balance AS users__balance, u.segment AS users__segment
FROM train t LEFT JOIN users u ON t.user_id IS NOT DISTINCT FROM u.user_id""",
    "agg_enrich": _VIEWS + f"SELECT t.*, {_without('o', 'user_id')} FROM train t LEFT JOIN ({_ORDERS_AGG}) o ON t.user_id = o.user_id",
    "snowflake_enrich": _VIEWS + _TREE_JOIN.format(base="train"),
    "tree_both_roots": _VIEWS + """, roots AS (
  SELECT row_id, user_id, product_id, 'train' AS root FROM train UNION ALL SELECT row_id, user_id, product_id, 'test' FROM test)"""
    + _TREE_JOIN.format(base="roots"),
    "discovered_tree": _VIEWS + _RELATIONS + _tree(
        "path, (SELECT string_agg(table_name || '.' || key, ',' ORDER BY table_name, key) FROM keys WHERE ratio = 1) AS unique_keys"
    ),
    "null_key_join": """
WITH o AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS priority FROM orders),
s AS (SELECT priority, CAST(count(*) AS BIGINT) AS same_priority, min(order_id) AS first_order FROM o GROUP BY 1)
SELECT o.*, s.same_priority, s.first_order FROM o LEFT JOIN s ON o.priority IS NOT DISTINCT FROM s.priority""",
    "numeric_actions": _VIEWS + "SELECT t.*, " + ", ".join(
        f"a.{c}_{f} AS orders__{c}__{f}"
        for c in ("days_since_prior_order", "order_dow")
        for f in ("count", "mean", "max", "min", "sum", "std", "nunique")
    ) + " FROM train t LEFT JOIN (SELECT user_id, " + ", ".join(
        f"CAST(count({c}) AS BIGINT) AS {c}_count, round(avg({c}), 6) AS {c}_mean, max({c}) AS {c}_max, min({c}) AS {c}_min, "
        f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}_sum, round(stddev_samp({c}), 6) AS {c}_std, "
        f"CAST(count(DISTINCT {c}) AS BIGINT) AS {c}_nunique"
        for c in ("days_since_prior_order", "order_dow")
    ) + " FROM orders_prior GROUP BY 1) a ON t.user_id = a.user_id",
    "categorical_nunique": _VIEWS + """
SELECT p.product_id, l.a AS lines__return_flag__nunique, l.b AS lines__ship_month__nunique FROM products p
LEFT JOIN (SELECT product_id, CAST(count(DISTINCT return_flag) AS BIGINT) AS a, CAST(count(DISTINCT ship_month) AS BIGINT) AS b
           FROM lines GROUP BY 1) l ON p.product_id = l.product_id""",
    "most_frequent": _VIEWS + f"""
SELECT p.product_id, a.v AS lines__return_flag__most_frequent, b.v AS lines__ship_month__most_frequent,
       c.v AS lines__quantity__most_frequent
FROM products p LEFT JOIN ({_mode('lines', 'product_id', 'return_flag')}) a ON p.product_id = a.product_id
LEFT JOIN ({_mode('lines', 'product_id', 'ship_month')}) b ON p.product_id = b.product_id
LEFT JOIN ({_mode('lines', 'product_id', 'quantity')}) c ON p.product_id = c.product_id""",
    "top_values": _VIEWS + _TOP,
    "topk_frequency": _VIEWS + "SELECT p.product_id, " + ", ".join(
        f"l.f_{v} AS lines__return_flag__freq__{v}" for v in "RAN"
    ) + " FROM products p LEFT JOIN (SELECT product_id, " + ", ".join(
        f"CAST(sum(CASE WHEN return_flag = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS f_{v}" for v in "RAN"
    ) + " FROM lines GROUP BY 1) l ON p.product_id = l.product_id",
    "topk_frequency_open": _VIEWS + f""",
top AS (SELECT value, rank FROM ({_TOP}) WHERE column_name = 'ship_month')
SELECT p.product_id, l.freq_1, l.freq_2, l.freq_3 FROM products p LEFT JOIN (
  SELECT product_id, """ + ", ".join(
        f"CAST(sum(CASE WHEN ship_month = (SELECT value FROM top WHERE rank = {i}) THEN 1 ELSE 0 END) AS BIGINT) AS freq_{i}"
        for i in (1, 2, 3)
    ) + " FROM lines GROUP BY 1) l ON p.product_id = l.product_id",
    "topk_one_hot": _VIEWS + "SELECT p.product_id, " + ", ".join(
        f"l.f_{v} AS lines__return_flag__is__{v}" for v in "RAN"
    ) + " FROM products p LEFT JOIN (SELECT product_id, " + ", ".join(
        f"CAST(max(CASE WHEN return_flag = '{v}' THEN 1 ELSE 0 END) AS INTEGER) AS f_{v}" for v in "RAN"
    ) + " FROM lines GROUP BY 1) l ON p.product_id = l.product_id",
    "direct_action": _VIEWS + """
SELECT t.*, p.brand AS products__brand, p.size AS products__size FROM train t LEFT JOIN products p ON t.product_id = p.product_id""",
    "action_status": _VIEWS + """
SELECT CAST(action_ord AS INTEGER) AS action_ord, source_table, action_type, status,
       (SELECT CAST(count(*) AS BIGINT) FROM train) AS train_rows, (SELECT CAST(count(*) AS BIGINT) FROM test) AS test_rows
FROM (VALUES
  (0, 'orders', 'direct_join', (SELECT CASE WHEN count(*) > count(DISTINCT user_id) THEN 'failed' ELSE 'applied' END FROM orders_prior)),
  (1, 'orders', 'aggregate_numeric', 'applied'), (2, 'orders', 'aggregate_numeric', 'failed'),
  (3, 'products', 'direct_join', (SELECT CASE WHEN count(*) > count(DISTINCT product_id) THEN 'failed' ELSE 'applied' END FROM products)),
  (4, 'products', 'direct_join', 'failed'), (5, 'products', 'skip', 'skipped'),
  (6, 'nations', 'direct_join', 'skipped'), (7, 'shops', 'direct_join', 'failed')) v(action_ord, source_table, action_type, status)""",
    "spec_filtered": _VIEWS + """
SELECT t.*, a.weekend_items, a.weekend_products, a.late_position FROM train t LEFT JOIN (
  SELECT o.user_id, CAST(count(i.product_id) FILTER (WHERE order_dow IN (0, 6)) AS BIGINT) AS weekend_items,
         CAST(count(DISTINCT i.product_id) FILTER (WHERE order_dow IN (0, 6)) AS BIGINT) AS weekend_products,
         max(i.add_to_cart_order) FILTER (WHERE order_hour_of_day >= 18) AS late_position
  FROM order_items i LEFT JOIN orders_prior o ON i.order_id = o.order_id GROUP BY 1) a ON t.user_id = a.user_id""",
    "spec_ratio": _VIEWS + """,
h AS (SELECT i.user_id, p.brand, p.kind FROM user_items i LEFT JOIN products p ON i.product_id = p.product_id),
g AS (SELECT user_id, brand, count(*) AS n FROM h GROUP BY 1, 2),
k AS (SELECT user_id, brand, max(n) * 1.0e0 / sum(n) AS kind_mode_ratio FROM (
        SELECT user_id, brand, kind, count(*) AS n FROM h WHERE kind IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT t.*, g.n * 1.0e0 / s.total AS brand_ratio, k.kind_mode_ratio
FROM train t LEFT JOIN products p ON t.product_id = p.product_id
LEFT JOIN g ON t.user_id = g.user_id AND p.brand = g.brand
LEFT JOIN (SELECT user_id, sum(n) AS total FROM g GROUP BY 1) s ON t.user_id = s.user_id AND g.n IS NOT NULL
LEFT JOIN k ON t.user_id = k.user_id AND p.brand = k.brand""",
    "category_families": _VIEWS + """,
g AS (SELECT i.user_id, p.kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT i.product_id) AS BIGINT) AS d, avg(reordered) AS r
      FROM user_items i LEFT JOIN products p ON i.product_id = p.product_id GROUP BY 1, 2)
SELECT t.*, g.n AS user_id_kind_count, g.n * 1.0e0 / s.total AS user_id_kind_share, g.d AS user_id_kind_distinct,
       g.r AS user_id_kind_repeat_rate
FROM train t LEFT JOIN products p ON t.product_id = p.product_id
LEFT JOIN g ON t.user_id = g.user_id AND p.kind = g.kind
LEFT JOIN (SELECT user_id, sum(n) AS total FROM g GROUP BY 1) s ON t.user_id = s.user_id""",
    "pair_history": _VIEWS + f"""
SELECT t.*, h.user_product_order_count, h.user_product_reorder_rate
FROM train t LEFT JOIN ({_HISTORY}) h ON t.user_id = h.user_id AND t.product_id = h.product_id""",
    "builder_apply": _VIEWS + f""",
h AS ({_HISTORY}),
pop AS (SELECT t.product_id, CAST(count(*) AS BIGINT) AS product_pairs, max(user_product_order_count) AS product_top_count
        FROM train t LEFT JOIN h ON t.user_id = h.user_id AND t.product_id = h.product_id GROUP BY 1)
SELECT r.*, h.user_product_order_count, h.user_product_reorder_rate, pop.product_pairs, pop.product_top_count
FROM (SELECT row_id, user_id, product_id, 'train' AS root FROM train UNION ALL SELECT row_id, user_id, product_id, 'test' FROM test) r
LEFT JOIN h ON r.user_id = h.user_id AND r.product_id = h.product_id
LEFT JOIN pop ON r.product_id = pop.product_id""",
    "plan_ingest": f"""
WITH t AS ({_PLAN_TEXT}),
c AS (SELECT *, CASE o_orderpriority
    WHEN '1-URGENT' THEN '```json' || chr(10) || js || chr(10) || '```'
    WHEN '2-HIGH' THEN 'Here is the plan:' || chr(10) || js || chr(10) || 'Done.'
    WHEN '3-MEDIUM' THEN js WHEN '4-NOT SPECIFIED' THEN 'no plan for this table' ELSE '{{broken ' || js END AS text FROM t),
x AS (SELECT *, nullif(regexp_extract(text, '(?s)(\\{{.*\\}})', 1), '') AS payload FROM c),
v AS (SELECT *, CASE WHEN payload IS NULL THEN 'no JSON object' WHEN NOT json_valid(payload) THEN 'invalid JSON'
                     WHEN trim(json_extract_string(payload, '$.actions[0].action_type')) NOT IN ('direct_join', 'aggregate_numeric', 'aggregate_categorical', 'skip') THEN 'unknown action_type'
                     WHEN trim(json_extract_string(payload, '$.actions[0].reason')) = '' THEN 'blank text in an action' END AS error FROM x)
SELECT order_id, error IS NULL AS is_valid, error,
       CASE WHEN error IS NULL THEN trim(json_extract_string(payload, '$.source_table')) END AS source_table,
       CASE WHEN error IS NULL THEN nullif(trim(json_extract_string(payload, '$.comment')), '') END AS comment,
       CASE WHEN error IS NULL THEN trim(json_extract_string(payload, '$.actions[0].action_type')) END AS action_type,
       CASE WHEN error IS NULL THEN 'a,b' END AS columns
FROM v""",
    "spec_ingest": """
SELECT o_orderkey AS order_id, o_orderstatus <> 'P' AS is_valid,
       CASE WHEN o_orderstatus = 'P' THEN 'invalid aggregation' END AS error,
       CASE WHEN o_orderstatus <> 'P' THEN 't' || o_custkey END AS title,
       CASE WHEN o_orderstatus <> 'P' THEN 'mode_ratio' END AS operation,
       CASE WHEN o_orderstatus <> 'P' THEN 'user_id,kind' END AS group_by
FROM orders""",
    "label_backjoin": _VIEWS + """
SELECT t.row_id, t.user_id, t.product_id, p.size AS products__size, t.target FROM train t LEFT JOIN products p ON t.product_id = p.product_id""",
    "held_out_labels": _VIEWS + "SELECT t.*, l.target FROM test t LEFT JOIN test_labels l ON t.row_id = l.row_id",
    "document_labels": """
SELECT d.doc_id, d.lang, d.n_chars, l.quality AS labels__quality, l.toxic AS labels__toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "impute_mixed": _VIEWS + """
SELECT order_id, user_id, eval_set, order_number, order_dow, order_hour_of_day,
       coalesce(days_since_prior_order, -999) AS days_since_prior_order,
       CASE WHEN order_hour_of_day < 12 THEN 'morning' ELSE 'missing' END AS daytime
FROM orders_v""",
    "split_holdout": f"""
SELECT o_orderkey AS row_id, {_bucket('o_orderkey')} AS bucket, {_bucket('o_orderkey')} / 4294967296.0e0 < 0.2e0 AS is_holdout FROM orders""",
    "split_exact": _VIEWS + _per_class("position < round(class_rows * 0.2e0)", "is_holdout"),
    "cv_folds": _VIEWS + f"SELECT row_id, target, CAST({_bucket('row_id')} % 5 AS INTEGER) AS fold FROM train",
    "cv_folds_exact": _VIEWS + _per_class("CAST(position % 5 AS INTEGER)", "fold"),
    "auc_by_rank": _VIEWS + """,
s AS (SELECT p.target, c.n AS score FROM pairs p LEFT JOIN (SELECT product_id, count(*) AS n FROM user_items GROUP BY 1) c ON p.product_id = c.product_id),
g AS (SELECT score, sum(target) AS pos, sum(1 - target) AS neg FROM s GROUP BY 1),
n AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g),
a AS (SELECT sum(pos * (nb + neg / 2.0e0)) / (sum(pos) * 1.0e0 * sum(neg)) AS auc, CAST(sum(pos) AS BIGINT) AS positives,
             CAST(sum(neg) AS BIGINT) AS negatives FROM n)
SELECT round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, positives, negatives FROM a""",
    "class_weights": _VIEWS + """
SELECT t.row_id, t.target, c.weight FROM train t JOIN (
  SELECT target, max(count(*)) OVER () * 1.0e0 / count(*) AS weight FROM train GROUP BY target) c ON t.target = c.target""",
    "output_checks": _VIEWS + _CHECKED,
    "final_projection": _VIEWS + """
SELECT t.*, o.user_orders, l.product_late, p.size AS products__size, p.price AS products__price,
       CAST(4 AS BIGINT) AS n_numeric, CAST(7 AS BIGINT) AS n_all
FROM train t
LEFT JOIN (SELECT user_id, CAST(count(*) AS BIGINT) AS user_orders FROM orders_prior GROUP BY 1) o ON t.user_id = o.user_id
LEFT JOIN (SELECT product_id, CAST(count(*) AS BIGINT) AS product_late FROM user_items WHERE add_to_cart_order >= 7 GROUP BY 1) l ON t.product_id = l.product_id
LEFT JOIN products p ON t.product_id = p.product_id""",
    "user_summary": _VIEWS + f"""
SELECT u.*, o.total_orders, o.avg_days_between_orders, d.v AS favorite_day_of_week, h.v AS favorite_hour_of_day,
       i.total_distinct_products, i.reordered_share, round(i.n * 1.0e0 / o.total_orders, 6) AS avg_basket_size
FROM users u
LEFT JOIN (SELECT user_id, CAST(count(*) AS BIGINT) AS total_orders, round(avg(days_since_prior_order), 6) AS avg_days_between_orders
           FROM orders_prior GROUP BY 1) o ON u.user_id = o.user_id
LEFT JOIN ({_mode('orders_prior', 'user_id', 'order_dow')}) d ON u.user_id = d.user_id
LEFT JOIN ({_mode('orders_prior', 'user_id', 'order_hour_of_day')}) h ON u.user_id = h.user_id
LEFT JOIN (SELECT user_id, count(*) AS n, CAST(count(DISTINCT product_id) AS BIGINT) AS total_distinct_products,
                  round(avg(reordered), 6) AS reordered_share FROM user_items GROUP BY 1) i ON u.user_id = i.user_id""",
    "rank_features": _VIEWS + _PLANTED + """
SELECT feature, CASE WHEN feature = 'pair_band' AND pure THEN 1.0e0 ELSE 0.0e0 END AS importance
FROM named, (SELECT bool_and(low = high) AS pure FROM (SELECT min(y) AS low, max(y) AS high FROM planted GROUP BY pair_band))
ORDER BY importance DESC, feature LIMIT 5""",
    "top5_retrain": _VIEWS + _PLANTED + """
SELECT auc AS validation_auc_all, auc AS validation_auc_selected,
       (SELECT string_agg(feature, ',' ORDER BY feature <> 'pair_band', feature) FROM (
          SELECT feature FROM named ORDER BY feature <> 'pair_band', feature LIMIT 5)) AS selected
FROM planted_auc""",
    "score_report": _VIEWS + _PLANTED + """
SELECT auc, 2 * auc - 1 AS gini, auc AS primary_score, auc AS cv_mean_auc, 0.0e0 AS cv_std_auc,
       CAST((SELECT count(*) + 1 FROM named) AS INTEGER) AS n_features,
       (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM test) AS test_rows
FROM planted_auc""",
    "csv_round_trip": f"""WITH {_PROFILE} SELECT table_name, column_name, row_count, non_null_count, distinct_count, non_null_ratio, unique_ratio
FROM profile WHERE table_name IN ('customer', 'nation', 'part', 'region')""",
    "distinct_keys": _VIEWS + "SELECT DISTINCT order_id, product_id FROM order_items",
    "failing_checks": _VIEWS + """,
sizes AS (SELECT 'train' AS root, count(*) AS base, count(*) FILTER (product_id % 2 = 0) AS n, 'a' AS feature, 0 AS filled FROM train
          UNION ALL SELECT 'test', count(*), count(*) FILTER (product_id < 0), 'b', count(*) FILTER (product_id < 0) FROM test)
SELECT 'base_columns_kept' AS "check", root AS subject, root <> 'train' AS passed, CASE root WHEN 'train' THEN 'target' ELSE '' END AS detail FROM sizes
UNION ALL SELECT 'unique_column_names', root, true, '' FROM sizes
UNION ALL SELECT 'feature_count', root, true, CAST(length(feature) AS VARCHAR) FROM sizes
UNION ALL SELECT 'same_features', string_agg(root, '/' ORDER BY root DESC), count(DISTINCT feature) = 1, min(feature) FROM sizes
UNION ALL SELECT 'not_empty', root, n > 0, CAST(n AS VARCHAR) FROM sizes
UNION ALL SELECT 'feature_has_values', root || '.' || feature, filled > 0, CAST(filled AS VARCHAR) FROM sizes
UNION ALL SELECT 'row_count_kept', root, n = base, CAST(n - base AS VARCHAR) FROM sizes""",
    "table_reach": _VIEWS + _RELATIONS + _tree().split("\nSELECT CAST(row_number() OVER (ORDER BY distance")[0] + """
SELECT table_name, table_name IN (SELECT table_name FROM seen3) AS reached
FROM (SELECT DISTINCT table_name FROM keys WHERE table_name <> 'train' UNION ALL SELECT 'lines')""",
    "name_collision": _VIEWS + """
SELECT t.*, t.product_id * -1.0e0 AS users__balance, u.nation_id AS users__nation_id, u.segment AS users__segment
FROM train t LEFT JOIN users u ON t.user_id = u.user_id""",
    "reported_features": _VIEWS + _PLANTED + """
SELECT feature, CASE WHEN feature = 'pair_band' AND pure THEN 1.0e0 ELSE 0.0e0 END AS importance
FROM (SELECT feature FROM named UNION ALL SELECT 'products__kind'),
     (SELECT bool_and(low = high) AS pure FROM (SELECT min(y) AS low, max(y) AS high FROM planted GROUP BY pair_band))
ORDER BY importance DESC, feature LIMIT 20""",
    "table_headers": f"WITH {_PROFILE} SELECT table_name, CAST(column_ord AS INTEGER) AS column_ord, column_name FROM profile "
    "WHERE table_name IN ('customer', 'nation', 'part', 'region')",
    "stored_profile": f"""WITH {_PROFILE} SELECT table_name, column_name, row_count, non_null_count, unique_ratio >= 0.98 * 0.9 AS is_exact,
       CASE WHEN unique_ratio >= 0.98 * 0.9 THEN distinct_count END AS distinct_count FROM profile WHERE column_name LIKE '%key'""",
    "root_columns": """SELECT step, passed, column_name FROM (VALUES ('roots', true, NULL), ('one joined', false, NULL), ('added', true, 'products__brand'),
  ('added', true, 'products__kind'), ('added', true, 'products__price'), ('added', true, 'products__product_name'), ('added', true, 'products__size')) v(step, passed, column_name)""",
    "builder_status": _VIEWS + """
SELECT CAST(action_ord AS INTEGER) AS action_ord, source_table, join_key, status, silent,
       (SELECT CAST(count(*) AS BIGINT) FROM train) AS train_rows, 7 AS n_columns
FROM (VALUES
  (0, 'pair history', 'user_id,product_id', 'applied', true),
  (1, 'repeated', 'user_id', (SELECT CASE WHEN count(*) > count(DISTINCT user_id) THEN 'failed' ELSE 'applied' END FROM orders_prior), false),
  (2, 'known column', 'user_id', 'failed', false), (3, 'no key', 'shop_id', 'failed', false),
  (4, 'no table', 'user_id', 'failed', false), (5, 'empty', 'user_id', 'applied', false)) v(action_ord, source_table, join_key, status, silent)""",
}
