"""Named queries over the driver's tables, each with SQL that gives the same rows.

Nested results are flattened, so that rows compare as scalars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..client import Client
from ..functions import spatial
from ..sources.catalog import ParquetSource
from ..sources.scratch import scratch_path
from ..sources.store import VersionedStore
from .driver_tables import driver_schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def client(spark: SparkSession, sf_dir: str) -> Client:
    return Client(driver_schema(), ParquetSource(spark, sf_dir))


def query(name: str, sql: str | None):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(client(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return function

    return register


def find(name: str, table: str, sql: str, **arguments) -> None:
    query(name, sql)(lambda db: db.table(table).find_many(**arguments))


ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
PART = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"
EVENTS = "event_id, ts, user_id, event_type, value, props"

# Scans and lookups

find("find_all_region", "region", "SELECT r_regionkey, r_name FROM region")
find("find_all_lineitem_select", "lineitem", "SELECT l_orderkey, l_quantity FROM lineitem", select=["l_orderkey", "l_quantity", "unknown"])
query("find_by_id_customer", f"SELECT {CUSTOMER} FROM customer WHERE c_custkey = 42")(lambda db: db.customer.find_by_id(42))
query("find_by_id_composite_conversation", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) AND turn = 0")(
    lambda db: db.conversations.find_by_id({"conv_id": db.conversations.aggregate(_min=["conv_id"])["_min"]["conv_id"], "turn": 0})
)
query("find_unique_nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7")(lambda db: db.nation.find_unique({"n_nationkey": 7}))

# Scalar predicates

find("where_equals", "customer", f"SELECT {CUSTOMER} FROM customer WHERE c_mktsegment = 'BUILDING'", where={"c_mktsegment": "BUILDING"})
find("where_equals_explicit_null", "customer", f"SELECT {CUSTOMER} FROM customer WHERE c_name = NULL", where={"c_name": {"equals": None}})
find("where_gt_lt", "orders", f"SELECT {ORDERS} FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 150000", where={"o_totalprice": {"gt": 100000, "lt": 150000}})
find("where_gte_lte_timestamp", "orders", f"SELECT {ORDERS} FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-06-30'", where={"o_orderdate": {"gte": "1995-01-01", "lte": "1995-06-30T00:00:00"}})
find("where_in", "part", f"SELECT {PART} FROM part WHERE p_size IN (1, 5, 9)", where={"p_size": {"in": [1, 5, 9]}})
find("where_not_in", "part", f"SELECT {PART} FROM part WHERE p_size NOT IN (1, 5, 9)", where={"p_size": {"notIn": [1, 5, 9]}})
find("where_in_empty", "part", f"SELECT {PART} FROM part WHERE 1 = 0", where={"p_size": {"in": []}})
find("where_not_in_empty", "nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation", where={"n_name": {"notIn": []}})
find("where_null_shorthand", "events", f"SELECT {EVENTS} FROM events WHERE event_type IS NULL", where={"event_type": None})
find("where_is_null_under_or", "events", f"SELECT {EVENTS} FROM events WHERE props IS NULL OR value > 99", where={"OR": [{"props": {"isNull": True}}, {"value": {"gt": 99}}]})
find("where_is_not_null", "events", f"SELECT {EVENTS} FROM events WHERE event_type IS NOT NULL AND user_id < 20", where={"event_type": {"isNotNull": True}, "user_id": {"lt": 20}})
find("where_contains_ci", "customer", f"SELECT {CUSTOMER} FROM customer WHERE c_name ILIKE '%MER#00000001%'", where={"c_name": {"contains": "MER#00000001"}})
find("where_contains_wildcard", "customer", f"SELECT {CUSTOMER} FROM customer WHERE c_name ILIKE '%1_3%'", where={"c_name": {"contains": "1_3"}})
find("where_starts_with", "part", f"SELECT {PART} FROM part WHERE p_brand ILIKE 'brand#1%'", where={"p_brand": {"startsWith": "brand#1"}})
find("where_ends_with", "part", f"SELECT {PART} FROM part WHERE p_name ILIKE '%RING'", where={"p_name": {"endsWith": "RING"}})
query("where_array_equals", "SELECT vec_id, label FROM embeddings WHERE embedding = (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)")(
    lambda db: db.embeddings.find_many({"embedding": [float(x) for x in db.embeddings.find_first(order_by={"vec_id": "asc"}).first()["embedding"]]}, select=["vec_id", "label"])
)
find("where_and_or_not", "orders", f"SELECT {ORDERS} FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 300000) AND NOT (o_orderpriority = '1-URGENT')", where={"OR": [{"o_orderstatus": "O"}, {"o_totalprice": {"gt": 300000}}], "NOT": {"o_orderpriority": "1-URGENT"}})
find("where_nested_combinators", "orders", f"SELECT {ORDERS} FROM orders WHERE (o_custkey < 50 AND (o_orderstatus = 'F' OR NOT (o_totalprice < 1000)))", where={"AND": [{"o_custkey": {"lt": 50}}, {"OR": [{"o_orderstatus": "F"}, {"NOT": {"o_totalprice": {"lt": 1000}}}]}]})
find("where_or_empty", "region", "SELECT r_regionkey, r_name FROM region", where={"OR": []})
find("where_not_three_valued", "events", f"SELECT {EVENTS} FROM events WHERE NOT (value > 50 AND event_type = 'click')", where={"NOT": {"value": {"gt": 50}, "event_type": "click"}})

# Relation predicates

find("rel_to_one", "customer", f"SELECT {CUSTOMER} FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)", where={"nation": {"n_regionkey": 1}})
find("rel_some", "customer", f"SELECT {CUSTOMER} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", where={"orders": {"some": {"o_totalprice": {"gt": 300000}}}})
find("rel_none", "customer", f"SELECT {CUSTOMER} FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", where={"orders": {"none": {"o_totalprice": {"gt": 200000}}}})
find("rel_every", "customer", f"SELECT {CUSTOMER} FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice > 20000))", where={"orders": {"every": {"o_totalprice": {"gt": 20000}}}})
find("rel_every_empty", "region", "SELECT r_regionkey, r_name FROM region", where={"nations": {"every": {}}})
find("rel_inverse_one", "documents", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)", where={"label": {"quality": 1}}, select=["doc_id", "lang"])
find("rel_inverse_one_missing", "documents", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", where={"label": None}, select=["doc_id", "lang"])
find("rel_m2m_some", "part", f"SELECT {PART} FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 9000)", where={"suppliers": {"some": {"s_acctbal": {"gt": 9000}}}})
find("rel_m2m_none", "supplier", "SELECT s_suppkey, s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND p_size > 49 AND p_retailprice > 990)", where={"parts": {"none": {"p_size": {"gt": 49}, "p_retailprice": {"gt": 990}}}}, select=["s_suppkey", "s_name"])
find("rel_m2m_every", "orders", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND NOT (p_size < 40))", where={"parts": {"every": {"p_size": {"lt": 40}}}}, select=["o_orderkey"])
find("rel_two_hop", "region", "SELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900))", where={"nations": {"some": {"customers": {"some": {"c_acctbal": {"gt": 9900}}}}}})
find("rel_two_hop_mixed", "orders", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = o_custkey AND n_name = (SELECT min(n_name) FROM nation))", where={"customer": {"nation": {"NOT": {"n_nationkey": {"lt": 0}}, "n_nationkey": 0}}}, select=["o_orderkey"])
SQL["rel_two_hop_mixed"] = "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = o_custkey AND n_nationkey = 0)"
find("rel_under_or", "customer", f"SELECT {CUSTOMER} FROM customer WHERE c_acctbal < -900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", where={"OR": [{"c_acctbal": {"lt": -900}}, {"orders": {"some": {"o_totalprice": {"gt": 400000}}}}]})
find("rel_under_not", "nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)", where={"NOT": {"suppliers": {"some": {"s_acctbal": {"gt": 5000}}}}})
find("rel_some_and_none", "customer", f"SELECT {CUSTOMER} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", where={"orders": {"some": {"o_orderstatus": "F"}, "none": {"o_totalprice": {"gt": 300000}}}})

# Aggregates

query("count_all", "SELECT count(*) AS __count FROM lineitem")(lambda db: db.lineitem.count_frame())
query("count_where", "SELECT count(*) AS __count FROM orders WHERE o_orderstatus = 'F'")(lambda db: db.orders.count_frame({"o_orderstatus": "F"}))
query("count_relation_filter", "SELECT count(*) AS __count FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size = 10)")(lambda db: db.lineitem.count_frame({"part": {"p_size": 10}}))


def rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on the order of addition."""
    return df.select(*[F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


AGGREGATES = "count(*) AS __count, round(avg(l_quantity), 2) AS _avg_l_quantity, round(sum(l_extendedprice), 2) AS _sum_l_extendedprice, min(l_shipdate) AS _min_l_shipdate, max(l_tax) AS _max_l_tax FROM lineitem"
for _name, _where, _sql in (("aggregate_all", None, ""), ("aggregate_where", {"l_returnflag": "R"}, " WHERE l_returnflag = 'R'"), ("aggregate_empty", {"l_returnflag": {"in": []}}, " WHERE 1 = 0")):
    query(_name, f"SELECT {AGGREGATES}{_sql}")(lambda db, w=_where: rounded(db.lineitem.aggregate_frame(w, _count=True, _avg=["l_quantity"], _sum=["l_extendedprice", "unknown"], _min={"l_shipdate": True}, _max=["l_tax"])))

# Order, limit, distinct, pages

find("order_limit", "orders", f"SELECT {ORDERS} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", order_by={"o_totalprice": "desc", "o_orderkey": "asc"}, limit=20)
find("order_multi", "customer", f"SELECT {CUSTOMER} FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50", order_by=[{"c_mktsegment": "asc"}, {"c_acctbal": "desc"}, {"c_custkey": "asc"}], limit=50)
find("offset_limit", "orders", f"SELECT {ORDERS} FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25", order_by={"o_orderkey": "asc"}, limit=10, offset=25)
query("find_first", f"SELECT {PART} FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 1")(lambda db: db.part.find_first({"p_size": {"gt": 10}}, {"p_retailprice": "desc", "p_partkey": "asc"}))
find("distinct_on", "orders", f"SELECT DISTINCT ON (o_custkey) {ORDERS} FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", distinct=["o_custkey"], order_by={"o_custkey": "asc", "o_totalprice": "desc", "o_orderkey": "asc"})
find("distinct_on_limit", "customer", f"SELECT DISTINCT ON (c_nationkey, c_mktsegment) {CUSTOMER} FROM customer ORDER BY c_nationkey, c_mktsegment, c_custkey LIMIT 30", distinct=["c_nationkey", "c_mktsegment"], order_by={"c_nationkey": "asc", "c_mktsegment": "asc", "c_custkey": "asc"}, limit=30)


def page(name: str, table: str, sql: str, order: dict, take: int, after: dict | None = None, where: dict | None = None) -> None:
    query(name, sql)(lambda db: db.table(table).page_frame(order, take, where, after))


page("paginate_page1", "orders", f"SELECT {ORDERS} FROM orders ORDER BY o_orderkey LIMIT 11", {"o_orderkey": "asc"}, 10)
page("paginate_page2_asc", "orders", f"SELECT {ORDERS} FROM orders WHERE (o_totalprice, o_orderkey) > (1000, 5) ORDER BY o_totalprice, o_orderkey LIMIT 11", {"o_totalprice": "asc"}, 10, {"o_totalprice": 1000, "o_orderkey": 5})
page("paginate_page2_desc", "orders", f"SELECT {ORDERS} FROM orders WHERE (o_totalprice, o_orderkey) < (200000, 99) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 11", {"o_totalprice": "desc"}, 10, {"o_totalprice": 200000, "o_orderkey": 99})
page("paginate_multi_key", "customer", f"SELECT {CUSTOMER} FROM customer WHERE c_acctbal > 0 AND (c_mktsegment, c_nationkey, c_custkey) > ('BUILDING', 10, 100) ORDER BY c_mktsegment, c_nationkey, c_custkey LIMIT 26", {"c_mktsegment": "asc", "c_nationkey": "asc"}, 25, {"c_mktsegment": "BUILDING", "c_nationkey": 10, "c_custkey": 100}, {"c_acctbal": {"gt": 0}})
page("paginate_timestamp", "events", f"SELECT {EVENTS} FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-15 00:00:00', 1) ORDER BY ts DESC, event_id DESC LIMIT 6", {"ts": "desc"}, 5, {"ts": "2024-01-15T00:00:00", "event_id": 1})

# Includes

query("include_to_one", "SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey")(
    lambda db: db.orders.find_many(include={"customer": True}).select("o_orderkey", "customer.c_name", "customer.c_nationkey")
)
query("include_inverse_one", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(
    lambda db: db.documents.find_many(include={"label": True}, select=["doc_id"]).select("doc_id", "label.quality", "label.toxic")
)
query("include_has_many", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")(
    lambda db: db.customer.find_many(include={"orders": True}).select("c_custkey", F.explode_outer("orders").alias("o")).select("c_custkey", "o.o_orderkey")
)
query("include_has_many_order_limit", "SELECT c_custkey, rn - 1 AS pos, o_orderkey FROM (SELECT c_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rn <= 3")(
    lambda db: db.customer.find_many(include={"orders": {"orderBy": {"o_totalprice": "desc"}, "limit": 3}}).select("c_custkey", F.posexplode("orders").alias("pos", "o")).select("c_custkey", "pos", "o.o_orderkey")
)
query("include_select", "SELECT n_nationkey, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey")(
    lambda db: db.nation.find_many(include={"customers": {"select": {"c_name": True}}}).select("n_nationkey", F.explode("customers").alias("c")).select("n_nationkey", "c.*")
)
query("include_where", "SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000")(
    lambda db: db.nation.find_many(include={"customers": {"where": {"c_acctbal": {"gt": 9000}}}}).select("n_nationkey", F.explode_outer("customers").alias("c")).select("n_nationkey", "c.c_custkey")
)
query("include_m2m", "SELECT p_partkey, s_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey")(
    lambda db: db.part.find_many(include={"suppliers": {"select": ["s_suppkey"]}}).select("p_partkey", F.explode("suppliers").alias("s")).select("p_partkey", "s.s_suppkey")
)
query("include_m2m_order_limit", "SELECT p_partkey, s_suppkey FROM (SELECT p_partkey, s_suppkey, row_number() OVER (PARTITION BY p_partkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey) WHERE rn <= 2")(
    lambda db: db.part.find_many(include={"suppliers": {"orderBy": {"s_acctbal": "desc"}, "limit": 2}}).select("p_partkey", F.explode("suppliers").alias("s")).select("p_partkey", "s.s_suppkey")
)
query("include_chain3", "SELECT r_name, n_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")(
    lambda db: db.region.find_many(include={"nations": {"with": {"customers": True}}}).select("r_name", F.explode("nations").alias("n")).select("r_name", "n.n_name", F.explode("n.customers").alias("c")).select("r_name", "n_name", "c.c_custkey")
)
query("include_chain_to_one", "SELECT o_orderkey, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")(
    lambda db: db.orders.find_many(include={"customer": {"with": {"nation": {"with": {"region": True}}}}}).select("o_orderkey", "customer.nation.region.r_name")
)
query("include_siblings", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")(
    lambda db: db.nation.find_many(include={"customers": True, "suppliers": True, "region": True}).select("n_nationkey", F.size("customers").cast("long").alias("customers"), F.size("suppliers").cast("long").alias("suppliers"), "region.r_name")
)
query("include_on_limited_parents", "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) JOIN orders ON o_custkey = c_custkey")(
    lambda db: db.customer.find_many(order_by={"c_acctbal": "desc", "c_custkey": "asc"}, limit=10, include={"orders": True}).select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey")
)
query("count_rel", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")(lambda db: db.customer.find_many(include={"_count": {"orders": True}}).select("c_custkey", F.col("_count.orders").alias("n")))
query("count_rel_filtered", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")(
    lambda db: db.customer.find_many(include={"_count": {"orders": {"where": {"o_orderstatus": "F"}}}}).select("c_custkey", F.col("_count.orders").alias("n"))
)
query("count_rel_multiple", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation")(
    lambda db: db.nation.find_many(include={"_count": {"customers": True, "suppliers": True}}).select("n_nationkey", F.col("_count.customers").alias("c"), F.col("_count.suppliers").alias("s"))
)
query("count_rel_m2m", "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n FROM part")(lambda db: db.part.find_many(include={"_count": {"suppliers": True}}).select("p_partkey", F.col("_count.suppliers").alias("n")))
query("count_rel_m2m_filtered", "SELECT p_partkey, (SELECT count(*) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 0) AS n FROM part")(
    lambda db: db.part.find_many(include={"_count": {"suppliers": {"where": {"s_acctbal": {"gt": 0}}}}}).select("p_partkey", F.col("_count.suppliers").alias("n"))
)
query("order_by_count", "SELECT c_custkey FROM customer ORDER BY (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) DESC, c_custkey LIMIT 15")(lambda db: db.customer.find_many(order_by={"_count": {"orders": "desc"}, "c_custkey": "asc"}, limit=15, select=["c_custkey"]))
query("count_with_include", "SELECT n_nationkey, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation JOIN region ON r_regionkey = n_regionkey")(
    lambda db: db.nation.find_many(include={"region": True, "_count": {"customers": True}}).select("n_nationkey", "region.r_name", F.col("_count.customers").alias("n"))
)
query("include_two_has_many", "SELECT n_nationkey, (SELECT round(sum(c_acctbal), 2) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT round(sum(s_acctbal), 2) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation")(
    lambda db: db.nation.find_many(include={"customers": True, "suppliers": True}).select(
        "n_nationkey", *[F.round(F.when(F.size(r) > 0, F.aggregate(F.col(f"{r}.{k}"), F.lit(0.0), lambda a, v: a + v)), 2).alias(k[0]) for r, k in (("customers", "c_acctbal"), ("suppliers", "s_acctbal"))]
    )
)

# JSON

find("json_has_key", "events", f"SELECT {EVENTS} FROM events WHERE list_contains(json_keys(props), 'k')", where={"props": {"hasKey": "k"}})
find("json_has_any", "events", f"SELECT {EVENTS} FROM events WHERE list_has_any(json_keys(props), ['z', 'k'])", where={"props": {"hasAnyKeys": ["z", "k"]}})
find("json_has_all", "events", f"SELECT {EVENTS} FROM events WHERE list_has_all(json_keys(props), ['k'])", where={"props": {"hasAllKeys": ["k"]}})
find("json_path_contains", "events", f"SELECT {EVENTS} FROM events WHERE json_extract_string(props, '$.k') = '7'", where={"props": {"path": {"segments": ["k"], "jsonContains": 7}}})
find("json_path_equals", "events", f"SELECT {EVENTS} FROM events WHERE json_extract_string(props, '$.k') = '7'", where={"props": {"path": {"segments": ["k"], "equals": 7}}})
find("json_contains", "events", f"SELECT {EVENTS} FROM events WHERE json_contains(props, '{{\"k\": 3}}')", where={"props": {"jsonContains": {"k": 3}}})

# Raw SQL and the builder

query("raw_sql_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 50000")(lambda db: db.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = {} AND o_totalprice > {}", "P", 50000))
query("raw_sql_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")(
    lambda db: db.execute("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_quantity > $1 GROUP BY l_returnflag, l_linestatus", [0])
)
query("raw_sql_window_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")(lambda db: db.sql("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)"))
query("builder_join_group", "SELECT n_name, count(*) AS n, max(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")(
    lambda db: db.select_from("customer").inner_join("nation", "customer.c_nationkey", "nation.n_nationkey").group_by("nation.n_name").agg(n="count(*)", balance="max(c_acctbal)").order_by("n_name").frame()
)
query("builder_left_join", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(lambda db: db.select_from("documents").left_join("labels", "documents.doc_id", "labels.doc_id").select("documents.doc_id", "labels.quality").frame())


# Writes: on a store of their own, which holds what the query needs of the tables


def written(name: str, tables: list[str], result: str, sql: str):
    """A query that loads ``tables``, lets ``function(db)`` write, and returns the table ``result``."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            source = client(spark, sf_dir)
            store = VersionedStore(spark, scratch_path(spark, "store"))
            store.load(source.manifest, {t: source.read(source.manifest.table(t)) for t in tables})
            db = Client(source.manifest, store)
            out = function(db)
            return out if isinstance(out, DataFrame) else db.table(result).find_many()

        QUERIES[name] = run
        SQL[name] = sql
        return function

    return register


NATION = "n_nationkey, n_name, n_regionkey FROM nation"


@written("create_many", ["region"], "region", "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (100, 'NORTH'), (101, NULL)")
def _(db):
    db.region.create_many([{"r_regionkey": 100, "r_name": "NORTH"}, {"r_regionkey": 101}])


@written("create_many_frame", ["part"], "part", f"SELECT {PART} FROM part UNION ALL SELECT p_partkey + 10000000, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(db):
    db.part.create_many(db.part.find_many().withColumn("p_partkey", F.col("p_partkey") + 10000000))


@written("create_nested", ["region", "nation"], "nation", f"SELECT {NATION} UNION ALL VALUES (900, 'A', 90), (901, 'B', 90)")
def _(db):
    db.region.create({"r_regionkey": 90, "r_name": "NEW", "nations": {"create": [{"n_nationkey": 900, "n_name": "A"}, {"n_nationkey": 901, "n_name": "B"}]}})


@written("upsert_insert", ["region"], "region", "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (50, 'made')")
def _(db):
    db.region.upsert({"r_regionkey": 50}, {"r_name": "made"}, {"r_name": "changed"})


@written("upsert_conflict", ["region"], "region", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'made' ELSE r_name END AS r_name FROM region")
def _(db):
    db.region.upsert({"r_regionkey": 1}, {"r_name": "made"}, {"r_name": "changed"})


@written("find_or_create_new", ["region"], "region", "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (51, 'made')")
def _(db):
    assert db.region.find_or_create({"r_regionkey": 51}, {"r_name": "made"})["created"]


@written("find_or_create_existing", ["region"], "region", "SELECT r_regionkey, r_name FROM region")
def _(db):
    assert not db.region.find_or_create({"r_regionkey": 2}, {"r_name": "made"})["created"]


@written("update_where", ["customer"], "customer", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def _(db):
    db.customer.update_many({"c_acctbal": 0.0}, {"c_mktsegment": "BUILDING"})


@written("update_many_relation_filter", ["customer", "orders"], "customer", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 'BIG' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(db):
    db.customer.update_many({"c_mktsegment": "BIG"}, {"orders": {"some": {"o_totalprice": {"gt": 300000}}}})


@written("delete_where", ["part"], "part", f"SELECT {PART} FROM part WHERE NOT (p_size < 25)")
def _(db):
    db.part.delete_many({"p_size": {"lt": 25}})


@written("has_many_connect", ["region", "nation"], "nation", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey IN (3, 4) THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation")
def _(db):
    db.region.update({"r_regionkey": 0}, {"nations": {"connect": [{"n_nationkey": 3}, {"n_nationkey": 4}]}})


@written("has_many_disconnect", ["region", "nation"], "nation", "SELECT n_nationkey, n_name, nullif(n_regionkey, 2) AS n_regionkey FROM nation")
def _(db):
    db.region.update({"r_regionkey": 2}, {"nations": {"disconnect": True}})


@written("has_many_set", ["region", "nation"], "nation", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey IN (0, 24) THEN 3 ELSE nullif(n_regionkey, 3) END AS n_regionkey FROM nation")
def _(db):
    db.region.update({"r_regionkey": 3}, {"nations": {"set": [{"n_nationkey": 0}, {"n_nationkey": 24}]}})


@written("to_one_connect", ["region", "nation"], "nation", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 5 THEN 4 ELSE n_regionkey END AS n_regionkey FROM nation")
def _(db):
    db.nation.update_many({"region": {"connect": {"r_regionkey": 4}}}, {"n_nationkey": {"lt": 5}})


@written("m2m_disconnect", ["orders", "part", "supplier", "lineitem"], "lineitem", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE NOT (l_partkey = 1)")
def _(db):
    db.part.update({"p_partkey": 1}, {"suppliers": {"disconnect": True}})
    return db.lineitem.find_many(select=["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"])


@written("m2m_set", ["orders", "part", "supplier", "lineitem"], "lineitem", "SELECT l_partkey, l_suppkey FROM lineitem WHERE NOT (l_partkey = 2) UNION ALL VALUES (2, 1), (2, 3)")
def _(db):
    db.part.update({"p_partkey": 2}, {"suppliers": {"set": [{"s_suppkey": 1}, {"s_suppkey": 3}]}})
    return db.lineitem.find_many(select=["l_partkey", "l_suppkey"])


@written("tx_savepoint_rollback", ["region"], "region", "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (70, 'kept')")
def _(db):
    with db.transaction():
        db.region.create({"r_regionkey": 70, "r_name": "kept"})
        try:
            with db.transaction():
                db.region.create({"r_regionkey": 71, "r_name": "undone"})
                raise RuntimeError
        except RuntimeError:
            pass


def shop(db: Client, on_delete: str) -> Client:
    """The nations and customers of ``db`` under keys with another action on delete."""
    from ..schema import bigint, define_schema, fk, int_, table, text

    schema = define_schema(naming="camelCase", nation=table("nation", n_nationkey=int_().primary(), n_name=text()), customer=table("customer", c_custkey=bigint().primary(), c_nationkey=fk("nation", as_="nation", inverse="customers", on_delete=on_delete)))
    return Client(schema, db.source)


@written("delete_cascade", ["nation", "customer"], "customer", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey IN (1, 2))")
def _(db):
    other = shop(db, "cascade")
    other.nation.delete_many({"n_nationkey": {"in": [1, 2]}})
    return other.customer.find_many()


@written("delete_set_null", ["nation", "customer"], "customer", "SELECT c_custkey, CASE WHEN c_nationkey IN (1, 2) THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def _(db):
    other = shop(db, "set null")
    other.nation.delete_many({"n_nationkey": {"in": [1, 2]}})
    return other.customer.find_many()


@written("to_one_disconnect", ["region", "nation"], "nation", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 5 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def _(db):
    db.nation.update_many({"region": {"disconnect": True}}, {"n_nationkey": {"lt": 5}})


@written("to_one_create", ["region", "nation"], "nation", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 3 THEN 90 ELSE n_regionkey END AS n_regionkey FROM nation")
def _(db):
    db.nation.update_by_id(3, {"region": {"create": {"r_regionkey": 90, "r_name": "made"}}})


@written("has_many_create", ["region", "nation"], "nation", f"SELECT {NATION} UNION ALL VALUES (90, 'made', 1), (91, 'too', 1)")
def _(db):
    db.region.update_by_id(1, {"nations": {"create": [{"n_nationkey": 90, "n_name": "made"}, {"n_nationkey": 91, "n_name": "too"}]}})


@written("has_many_delete", ["region", "nation", "customer", "supplier"], "nation", f"SELECT {NATION} UNION ALL VALUES (91, 'stays', 1)")
def _(db):
    db.region.update_by_id(1, {"nations": {"create": [{"n_nationkey": 90, "n_name": "goes"}, {"n_nationkey": 91, "n_name": "stays"}]}})
    db.region.update_by_id(1, {"nations": {"delete": [{"n_nationkey": 90}]}})


@written("has_many_connect_or_create", ["region", "nation"], "nation", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 7 THEN 2 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (90, 'made', 2)")
def _(db):
    wanted = [{"where": {"n_nationkey": key}, "create": {"n_name": "made"}} for key in (7, 90)]
    db.region.update_by_id(2, {"nations": {"connectOrCreate": wanted}})


def ends(db) -> tuple[int, int]:
    """The first and the last labelled document."""
    return tuple(db.labels.find_many(order_by={"doc_id": way}, limit=1).first()["doc_id"] for way in ("asc", "desc"))


LABELS = "quality, toxic FROM labels"
FIRST, LAST = "(SELECT min(doc_id) FROM labels)", "(SELECT max(doc_id) FROM labels)"
MOVED = f"SELECT CASE WHEN doc_id = {FIRST} THEN {LAST} WHEN doc_id = {LAST} THEN NULL ELSE doc_id END AS doc_id, {LABELS}"


@written("inverse_one_connect", ["documents", "labels"], "labels", MOVED)
def _(db):
    first, last = ends(db)
    db.documents.update_by_id(last, {"label": {"connect": {"doc_id": first}}})


@written("inverse_one_set", ["documents", "labels"], "labels", MOVED)
def _(db):
    first, last = ends(db)
    db.documents.update_by_id(last, {"label": {"set": [{"doc_id": first}]}})


@written("inverse_one_disconnect", ["documents", "labels"], "labels", f"SELECT nullif(doc_id, {FIRST}) AS doc_id, {LABELS}")
def _(db):
    db.documents.update_by_id(ends(db)[0], {"label": {"disconnect": True}})


@written("inverse_one_delete", ["documents", "labels"], "labels", f"SELECT doc_id, {LABELS} WHERE doc_id <> {LAST}")
def _(db):
    db.documents.update_by_id(ends(db)[1], {"label": {"delete": True}})


@written("inverse_one_create", ["documents", "labels"], "labels", f"SELECT doc_id, {LABELS} UNION ALL VALUES (9000001, 3, 0)")
def _(db):
    db.documents.create({"doc_id": 9000001, "text": "made", "label": {"create": {"quality": 3, "toxic": 0}}})


LINKS = "SELECT l_partkey, l_suppkey FROM lineitem"


def links(db):
    return db.lineitem.find_many(select=["l_partkey", "l_suppkey"])


@written("m2m_connect", ["orders", "part", "supplier", "lineitem"], "lineitem", f"{LINKS} UNION ALL (SELECT 2, s_suppkey FROM supplier WHERE s_suppkey < 8 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = 2 AND l_suppkey = s_suppkey))")
def _(db):
    db.part.update_by_id(2, {"suppliers": {"connect": [{"s_suppkey": key} for key in range(8)]}})
    return links(db)


@written("m2m_connect_or_create", ["nation", "orders", "part", "supplier", "lineitem"], "lineitem", f"{LINKS} UNION ALL VALUES (2, 9000001) UNION ALL (SELECT 2, 1 WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = 2 AND l_suppkey = 1))")
def _(db):
    wanted = [{"where": {"s_suppkey": key}, "create": {"s_name": "made"}} for key in (1, 9000001)]
    db.part.update_by_id(2, {"suppliers": {"connectOrCreate": wanted}})
    return links(db)


@written("m2m_create_delete", ["nation", "orders", "part", "supplier", "lineitem"], "supplier", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL VALUES (9000002, 'stays', NULL, NULL)")
def _(db):
    made = [{"s_suppkey": 9000001, "s_name": "goes"}, {"s_suppkey": 9000002, "s_name": "stays"}]
    db.part.update_by_id(1, {"suppliers": {"create": made}})
    db.part.update_by_id(1, {"suppliers": {"delete": [{"s_suppkey": 9000001}]}})


@written("create_many_and_return", ["region"], "region", "SELECT 100 AS r_regionkey, 'NORTH' AS r_name UNION ALL SELECT 101, NULL")
def _(db):
    made = db.region.create_many_and_return([{"r_regionkey": 100, "r_name": "NORTH"}, {"r_regionkey": 101}])
    return db.spark.createDataFrame([(r["r_regionkey"], r["r_name"]) for r in made], "r_regionkey int, r_name string")


@written("update_by_id", ["region", "nation"], "nation", "SELECT n_nationkey, CASE WHEN n_nationkey = 6 THEN 'renamed' ELSE n_name END AS n_name, n_regionkey FROM nation")
def _(db):
    assert db.nation.update_by_id(6, {"n_name": "renamed"}, return_updated=True)["n_name"] == "renamed"


@written("delete_by_id", ["part", "lineitem"], "part", f"SELECT {PART} FROM part UNION ALL VALUES (9000002, 'stays', NULL, NULL, NULL, NULL)")
def _(db):
    db.part.create_many([{"p_partkey": 9000001, "p_name": "goes"}, {"p_partkey": 9000002, "p_name": "stays"}])
    db.part.delete_by_id(9000001)


@written("batch_steps", ["region"], "region", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 3 UNION ALL VALUES (80, 'made')")
def _(db):
    db.batch([lambda tx: tx.region.create({"r_regionkey": 80, "r_name": "made"}), lambda tx: tx.region.delete({"r_regionkey": 3})])


def spots(db) -> Client:
    """The customers as points: nation across, thousands of balance up."""
    from ..schema import bigint, define_schema, geometry, table

    made = Client(define_schema(naming="camelCase", spots=table("spots", c_custkey=bigint().primary(), place=geometry())), db.source)
    place = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("c_nationkey").cast("string"), F.lit(","), (F.col("c_acctbal") / 1000).cast("string"), F.lit("]}"))
    made.spots.create_many(db.customer.find_many().select("c_custkey", place.alias("place")))
    return made


SQUARE = {"type": "Polygon", "coordinates": [[[4.5, 1.00005], [12.5, 1.00005], [12.5, 5.00005], [4.5, 5.00005], [4.5, 1.00005]]]}
IN_SQUARE = "SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 5 AND 12 AND c_acctbal / 1000 > 1.00005 AND c_acctbal / 1000 < 5.00005"


@written("spatial_within", ["customer"], "customer", IN_SQUARE)
def _(db):
    return spots(db).spots.find_many({"place": {"within": SQUARE}}, select=["c_custkey"])


@written("spatial_intersects", ["customer"], "customer", IN_SQUARE)
def _(db):
    return spots(db).spots.find_many({"place": {"intersects": SQUARE}}, select=["c_custkey"])


@written("spatial_dwithin", ["customer"], "customer", "SELECT c_custkey FROM customer WHERE sqrt(power(c_nationkey - 10, 2) + power(c_acctbal / 1000 - 3, 2)) <= 2.5")
def _(db):
    return spots(db).spots.find_many({"place": {"dWithin": {"geometry": {"type": "Point", "coordinates": [10, 3]}, "distance": 2.5}}}, select=["c_custkey"])


# Plugins


@query("citext_equals", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(db):
    from ..schema import bigint, citext, define_schema, table

    schema = define_schema(naming="camelCase", customer=table("customer", c_custkey=bigint().primary(), c_mktsegment=citext()))
    return Client(schema, db.source).customer.find_many({"c_mktsegment": "Building"}, select=["c_custkey"])


@query("spatial_dwithin_points", "SELECT c_custkey FROM customer WHERE sqrt(power(c_nationkey - 10, 2) + power(c_acctbal / 1000 - 3, 2)) <= 2.5")
def _(db):
    place = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("c_nationkey").cast("string"), F.lit(","), (F.col("c_acctbal") / 1000).cast("string"), F.lit("]}"))
    rows = db.customer.find_many().withColumn("place", place)
    return rows.where(spatial.d_within(F.col("place"), {"type": "Point", "coordinates": [10, 3]}, 2.5)).select("c_custkey")
