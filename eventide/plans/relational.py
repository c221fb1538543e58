"""Relational operators on the star schema, as SQL text that Spark and the check read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import load

QUERIES, ORACLES = {}, {}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _add(name: str, text: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        for t in _TABLES:
            if t in text:
                load(spark, sf, t).createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name], ORACLES[name] = run, oracle or text


_add("rel_scan_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'")
_add("rel_inner_join", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_add("rel_left_join", "SELECT c_custkey, count(o_orderkey) AS orders_n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_add("rel_full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS as_customer, b.n AS as_supplier FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 8 GROUP BY 1) b ON a.k = b.k")
_add("rel_totals_join", "SELECT o_orderstatus, count(*) AS n, round(count(*) / any_value(t.total), 6) AS share FROM orders, (SELECT count(*) AS total FROM orders) t GROUP BY o_orderstatus")
_add("rel_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_add("rel_semi_join", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_add("rel_having", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 4")
_add("rel_filtered_aggregates", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY user_id")
_add("rel_median", "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS median FROM events GROUP BY event_type")
_add("rel_ordered_list", "SELECT r_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey", "SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
_add("rel_window", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, round(sum(value) OVER (PARTITION BY user_id), 4) AS total, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type FROM events")
_add("rel_top_one", "SELECT user_id, max_by(event_id, struct(value, event_id)) AS event_id FROM events GROUP BY user_id", "SELECT user_id, arg_max(event_id, (value, event_id)) AS event_id FROM events GROUP BY user_id")
_add("rel_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_add("rel_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_add("rel_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_add("rel_except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT s_suppkey FROM supplier")
_add("rel_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier")
_add("rel_recursive", "WITH RECURSIVE s(k, step) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT k + n.n_nationkey, step + 1 FROM s JOIN nation n ON n.n_nationkey = s.step + 1 WHERE step < 10) SELECT k, step FROM s")
_add("rel_lateral", "SELECT user_id, t.k AS k, t.v AS v FROM (SELECT user_id, count(*) AS n, max(value) AS m FROM events GROUP BY user_id) e, LATERAL (SELECT 'n' AS k, CAST(e.n AS DOUBLE) AS v UNION ALL SELECT 'm', e.m) t")
# a range join by bins: each range goes to the bins that it touches, so the join is by equality and the bounds are checked within a bin
_BINNED = """SELECT a.lo AS lo, a.hi AS hi, count(*) AS n
FROM (SELECT lo, hi, {bin} AS bin FROM (SELECT DISTINCT CAST(floor(p_retailprice / 130) * 130 AS DOUBLE) AS lo, CAST(floor(p_retailprice / 130) * 130 + 250 AS DOUBLE) AS hi FROM part) r) a
JOIN (SELECT p_retailprice, CAST(floor(p_retailprice / 100) AS BIGINT) AS bin FROM part) b ON a.bin = b.bin AND p_retailprice >= a.lo AND p_retailprice < a.hi GROUP BY a.lo, a.hi"""
_add(
    "rel_range_join",
    _BINNED.format(bin="explode(sequence(CAST(floor(lo / 100) AS BIGINT), CAST(floor(hi / 100) AS BIGINT)))"),
    "SELECT a.lo AS lo, a.hi AS hi, count(*) AS n FROM (SELECT DISTINCT CAST(floor(p_retailprice / 130) * 130 AS DOUBLE) AS lo, CAST(floor(p_retailprice / 130) * 130 + 250 AS DOUBLE) AS hi FROM part) a JOIN part ON p_retailprice >= a.lo AND p_retailprice < a.hi GROUP BY a.lo, a.hi",
)
