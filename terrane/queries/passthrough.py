"""Queries through the read-only SQL surface, and its relational operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.plans.sqlgate import query_frame
from terrane.tables import table

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _run(name: str, text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in _TABLES:
            table(spark, d, t).createOrReplaceTempView(t)
        return query_frame(spark, text)

    run.__name__ = name
    return run


_DAY = "CAST(l_shipdate AS DATE)"
#: Statements that both engines run as they stand.
_SHARED = {
    "sql_agg_pricing": f"""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
        round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE {_DAY} <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "sql_agg_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_agg_distinct_filter": "SELECT l_shipyear, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_discount > 0.05) AS cheap FROM (SELECT *, year(l_shipdate) AS l_shipyear FROM lineitem) t GROUP BY l_shipyear",
    "sql_agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_agg_rollup": "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "sql_agg_grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "sql_join_star": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey GROUP BY n_name""",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey",
    "sql_join_full": "SELECT coalesce(s_nationkey, c_nationkey) AS nation, count(s_suppkey) AS suppliers, max(c) AS customers FROM supplier FULL JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) x ON s_nationkey = c_nationkey GROUP BY coalesce(s_nationkey, c_nationkey)",
    "sql_join_semi": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority",
    "sql_join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_join_scalar_subquery": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.2 FROM part)",
    "sql_join_correlated": "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.9 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)",
    "sql_join_in_subquery": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))",
    "sql_window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS d FROM orders",
    "sql_window_running": "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "sql_window_lag": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM orders",
    "sql_window_ntile": "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS quarter, first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS cheapest FROM part",
    "sql_window_topk": "SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) t WHERE r <= 3",
    "sql_window_range": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events",
    "sql_setop_union": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000",
    "sql_setop_union_all": "SELECT 'c' AS t, count(*) AS n FROM customer UNION ALL SELECT 's', count(*) FROM supplier",
    "sql_setop_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "sql_setop_except": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "sql_cte_recursive": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "sql_limit_offset": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5",
    "sql_case_between_like": "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' ELSE 'large' END AS class FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'PROMO%'",
    "sql_scalar_functions": "SELECT c_custkey, upper(c_name) AS u, length(c_name) AS n, substr(c_name, 3, 4) AS s, abs(c_acctbal) AS a, round(c_acctbal / 7, 3) AS r, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS m FROM customer",
    "sql_date_functions": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS first_day FROM orders",
}


def sql_json_props(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the JSON column of events."""
    props = table(spark, d, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))
    return props.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {name: _run(name, text) for name, text in _SHARED.items()} | {"sql_json_props": sql_json_props}
SQL = dict(_SHARED) | {"sql_json_props": "SELECT key, count(*) AS n FROM (SELECT event_id, unnest(json_keys(props::JSON)) AS key FROM events) GROUP BY key"}
