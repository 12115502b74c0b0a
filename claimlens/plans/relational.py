"""Relational coverage on the given tables: SQL that is the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SQL = {
    "rel_pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "rel_inner_join": "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "rel_left_join": "SELECT c_mktsegment, count(o_orderkey) AS n_orders, count(*) AS n_rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 GROUP BY c_mktsegment",
    "rel_full_join": "SELECT coalesce(c_nationkey, s_nationkey) AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM (SELECT * FROM customer WHERE c_nationkey < 15) c FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 8) s ON c_nationkey = s_nationkey GROUP BY 1",
    "rel_semi_join": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_mktsegment",
    "rel_anti_join": "SELECT c_nationkey, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) GROUP BY c_nationkey",
    "rel_range_join": "SELECT b.lo AS lo, count(*) AS n FROM orders JOIN (SELECT CAST(0 AS DOUBLE) AS lo, CAST(50000 AS DOUBLE) AS hi UNION ALL SELECT 50000, 150000 UNION ALL SELECT 150000, 1000000000) b ON o_totalprice >= b.lo AND o_totalprice < b.hi GROUP BY b.lo",
    "rel_cube": "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rel_rollup": "SELECT coalesce(event_type, '*') AS event_type, coalesce(CAST(user_id % 5 AS INT), -1) AS grp, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 5)",
    "rel_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "rel_window_rank": "SELECT o_custkey, o_orderkey, CAST(r AS BIGINT) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 2",
    "rel_window_running": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n5, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "rel_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "rel_union": "SELECT c_nationkey AS nation, 'c' AS side FROM customer UNION SELECT s_nationkey, 's' FROM supplier",
    "rel_intersect": "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier",
    "rel_except": "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000",
    "rel_distinct_agg": "SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "rel_json": None,
    "rel_as_of": "SELECT e.event_id, CAST(CAST(max(o.o_orderdate) AS DATE) AS STRING) AS last_order FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY e.event_id",
}
_JSON = ("SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY event_type", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")


def _run(sql: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(sql)

    return query


#: One row a nation on either side before they meet: the same counts without the product of customers and suppliers.
_FULL = (
    "SELECT coalesce(c.nation, s.nation) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers "
    "FROM (SELECT c_nationkey AS nation, count(DISTINCT c_custkey) AS customers FROM customer WHERE c_nationkey < 15 GROUP BY 1) c "
    "FULL JOIN (SELECT s_nationkey AS nation, count(DISTINCT s_suppkey) AS suppliers FROM supplier WHERE s_nationkey > 8 GROUP BY 1) s ON c.nation = s.nation"
)


def rel_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice")
    bands = spark.createDataFrame([(0.0, 50000.0), (50000.0, 150000.0), (150000.0, 1000000000.0)], "lo double, hi double")
    return joins.in_ranges(prices, bands, "o_totalprice", F.col("lo"), F.col("hi")).groupBy(F.col("q.lo").alias("lo")).agg(F.count("*").alias("n"))


def rel_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate")
    newest = joins.as_of(events, orders, ("user_id", "o_custkey"), ("ts", "o_orderdate"), "400 days").where("r is not null")
    return newest.select(F.col("l.event_id").alias("event_id"), F.col("r.o_orderdate").cast("date").cast("string").alias("last_order"))


QUERIES = {k: _run(v or _JSON[0]) for k, v in SQL.items()} | {"rel_full_join": _run(_FULL), "rel_range_join": rel_range_join, "rel_as_of": rel_as_of}
ORACLE_SQL = {k: v or _JSON[1] for k, v in SQL.items()}
