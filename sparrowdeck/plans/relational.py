"""Queries over the relational operators, written in the dialect: projection to set operations, one or more rows each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dialect

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def over_tables(sql: str, parameters: dict[str, object] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A query from a text of the dialect in which {name} is a table of the directory."""
    names = [t for t in TABLES if re.search(rf"\{{{t}\}}", sql)]
    text = re.sub(r"\{(\w+)\}", r"\1", sql)
    return lambda spark, sf_dir: dialect.query(spark, text, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}, parameters)


# name: (SQL, the oracle's SQL where it has to differ)
SQL: dict[str, tuple[str, str | None]] = {
    "pricing_summary": (
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
           FROM {lineitem} WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
           FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    ),
    "scan_table": ("SELECT * FROM {nation}", None),
    "filter_project": ("SELECT o_orderkey, o_custkey AS customer, o_totalprice FROM {orders} WHERE o_totalprice > 200000 AND NOT o_orderstatus = 'F'", None),
    "computed_columns": ("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 5) AS net, -l_linenumber AS neg, l_orderkey % 7 AS m, l_returnflag || '-' || l_linestatus AS flags FROM {lineitem}", None),
    "integer_division": ("SELECT o_orderkey, o_orderkey / 7 AS q, -o_orderkey / 7 AS nq, -o_orderkey % 7 AS nr FROM {orders}", "SELECT o_orderkey, o_orderkey // 7 AS q, -(o_orderkey // 7) AS nq, -(o_orderkey % 7) AS nr FROM {orders}"),
    "bitwise": ("SELECT o_orderkey, ~o_orderkey AS inv, o_orderkey & 255 AS low, o_orderkey | 1 AS odd FROM {orders}", None),
    "like_between_in": ("SELECT p_partkey, p_type, p_size FROM {part} WHERE p_type LIKE '%E%' AND p_size BETWEEN 10 AND 30 AND p_size IN (10, 15, 20, 25, 30) AND p_name NOT LIKE '_x%'", None),
    "three_valued_logic": ("SELECT c_custkey, (nullif(c_nationkey, 3) > 5 OR c_acctbal > 0) AS a, (nullif(c_nationkey, 3) > 5 AND c_acctbal > 0) AS b, NOT (nullif(c_nationkey, 3) = 4) AS c, nullif(c_nationkey, 3) IS NULL AS d FROM {customer}", None),
    "case_coalesce": ("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS bucket, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code, coalesce(nullif(o_orderstatus, 'P'), 'none') AS status FROM {orders}", None),
    "cast_types": ("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS price, CAST(o_orderkey AS STRING) AS key_text, CAST(o_orderdate AS DATE) AS day FROM {orders}", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS price, CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_orderdate AS DATE) AS day FROM {orders}"),
    "distinct_rows": ("SELECT DISTINCT p_brand, p_size FROM {part}", None),
    "order_limit_offset": ("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10", None),
    "order_default_nulls": ("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer} ORDER BY k, c_custkey LIMIT 15", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer} ORDER BY k ASC NULLS FIRST, c_custkey LIMIT 15"),
    "order_nulls": ("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer} ORDER BY k ASC NULLS FIRST, c_custkey LIMIT 15", None),
    "top_k": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25", None),
    "offset_only": ("SELECT n_nationkey FROM {nation} ORDER BY n_nationkey OFFSET 20", None),
    "count_star": ("SELECT count(*) FROM {orders} WHERE o_totalprice > 50000", 'SELECT count(*) AS "count" FROM {orders} WHERE o_totalprice > 50000'),
    "aggregates": ("SELECT count(*) AS n, count(nullif(c_nationkey, 3)) AS k, sum(c_custkey) AS s, round(avg(c_acctbal), 6) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(DISTINCT c_mktsegment) AS segs FROM {customer}", "SELECT count(*) AS n, count(nullif(c_nationkey, 3)) AS k, sum(c_custkey)::BIGINT AS s, round(avg(c_acctbal), 6) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(DISTINCT c_mktsegment) AS segs FROM {customer}"),
    "group_having": ("SELECT o_custkey, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey, o_orderstatus HAVING count(*) > 2 AND sum(o_totalprice) > 100000", None),
    "rollup": ("SELECT n_regionkey, n_name, count(*) AS n FROM {nation} GROUP BY ROLLUP (n_regionkey, n_name)", None),
    "grouping_sets": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())", None),
    "cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "collect_names": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey"),
    "join_inner": ("SELECT o_orderkey, c_name, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE o_totalprice > 150000", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM {customer} LEFT OUTER JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 250000", None),
    "join_right": ("SELECT o_orderkey, s_suppkey FROM {supplier} RIGHT JOIN {orders} ON s_suppkey = o_custkey", None),
    "join_full": ("SELECT c_custkey, s_suppkey FROM {customer} FULL OUTER JOIN {supplier} ON c_custkey = s_suppkey * 10", None),
    "join_cross": ("SELECT r_name, n_name FROM {region} CROSS JOIN {nation}", None),
    "join_theta": ("SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_inequality": ("SELECT a.n_name AS a, r.r_name AS b FROM {nation} a JOIN {region} r ON a.n_nationkey < r.r_regionkey", None),
    "join_using": ("SELECT doc_id, quality, source FROM {documents} JOIN {labels} USING (doc_id)", None),
    "join_natural": ("SELECT doc_id, lang, toxic FROM {documents} NATURAL JOIN {labels}", None),
    "join_comma": ("SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey", None),
    "in_subquery": ("SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)", None),
    "not_in_subquery": ("SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 250000)", None),
    "semi_exists": ("SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", None),
    "anti_not_exists": ("SELECT p_partkey FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 45)", None),
    "scalar_subquery": ("SELECT o_orderkey FROM {orders} WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM {orders})", None),
    "correlated_scalar": ("SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n FROM {customer}", None),
    "derived_table": ("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) t WHERE n >= 12", None),
    "values_rows": ("SELECT * FROM VALUES (1, 'a'), (2, NULL), (3, 'c') AS t(id, label)", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS t(id, label)"),
    "select_constant": ("SELECT 1 AS one, 'x' AS x", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}", None),
    "union_all": ("SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}", None),
    "intersect": ("SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}", None),
    "except": ("SELECT c_custkey AS k FROM {customer} EXCEPT SELECT s_suppkey FROM {supplier}", None),
    "cte": ("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 1000000) SELECT c_name, round(t, 2) AS t FROM top JOIN {customer} ON c_custkey = o_custkey", None),
    "recursive_cte": ("WITH RECURSIVE n(i, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, f * (i + 1) FROM n WHERE i < 15) SELECT i, f FROM n", None),
    "window_rank": ("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS BIGINT) AS dr, CAST(ntile(4) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS q FROM {events}", None),
    "window_lead_lag": ("SELECT event_id, lag(value, 1) OVER w AS prev, lead(value, 1, -1.0) OVER w AS nxt, first_value(value) OVER w AS fv, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "window_frame": ("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS n2, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS m FROM {events}", None),
    "string_functions": ("SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS lo, CAST(length(p_name) AS BIGINT) AS len, trim('  ' || p_brand || ' ') AS t, ltrim(' ' || p_brand) AS lt, rtrim(p_brand || ' ') AS rt, substring(p_name, 2, 3) AS sub, replace(p_type, 'A', 'aa') AS rep, concat(p_brand, '/', p_type) AS cat FROM {part}", None),
    "math_functions": ("SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, CAST(ceiling(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(l_discount * 100, 0) AS r, round(power(l_tax, 2), 8) AS p, round(sqrt(l_quantity), 8) AS s, l_orderkey % 5 AS m, sign(l_quantity - 25) AS sg, round(ln(l_quantity), 8) AS ln_q, round(exp(l_tax), 8) AS e FROM {lineitem}", "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, CAST(ceiling(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(l_discount * 100, 0) AS r, round(power(l_tax, 2), 8) AS p, round(sqrt(l_quantity), 8) AS s, l_orderkey % 5 AS m, sign(l_quantity - 25)::DOUBLE AS sg, round(ln(l_quantity), 8) AS ln_q, round(exp(l_tax), 8) AS e FROM {lineitem}"),
    "date_functions": ("SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d FROM {orders}", None),
    "nullif_fn": ("SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM {nation}", None),
    "list_functions": ("SELECT r_regionkey, size(xs) AS n, element_at(xs, 1) AS head, element_at(xs, -1) AS last_, array_join(slice(xs, 2, 100), ',') AS tail, array_join(array_distinct(array('a', r_name, 'a')), '|') AS uniq FROM (SELECT r_regionkey, r_name, split(r_name, 'A') AS xs FROM {region})", "SELECT r_regionkey, len(xs)::INTEGER AS n, xs[1] AS head, xs[-1] AS last_, array_to_string(xs[2:], ',') AS tail, CASE WHEN r_name = 'a' THEN 'a' ELSE 'a|' || r_name END AS uniq FROM (SELECT r_regionkey, r_name, string_split(r_name, 'A') AS xs FROM {region})"),
    "conversions": ("SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, try_cast(event_type AS DOUBLE) AS bad, CAST(value AS STRING) IS NOT NULL AS has FROM {events}", "SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, try_cast(event_type AS DOUBLE) AS bad, CAST(value AS VARCHAR) IS NOT NULL AS has FROM {events}"),
    "qualified_star": ("SELECT n.*, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey", None),
    "unnamed_columns": ("SELECT n_nationkey, n_regionkey + 1, upper(n_name) FROM {nation}", "SELECT n_nationkey, n_regionkey + 1 AS column2, upper(n_name) AS column3 FROM {nation}"),
    "top_rows": ("SELECT TOP 7 o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 7"),
    "fetch_next": ("SELECT o_orderkey FROM {orders} ORDER BY o_orderkey OFFSET 5 ROWS FETCH NEXT 9 ROWS ONLY", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 9 OFFSET 5"),
    "in_null_candidate": ("SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (3, NULL, nullif(c_nationkey, 7))", "SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (3) AND c_nationkey = 7"),
    "table_name_in_literal": ("SELECT n_nationkey, 'rows from nation , region' AS note FROM {nation}", None),
    "like_backslash": (r"SELECT p_partkey FROM {part} WHERE p_name || '\x' LIKE '%\_' AND p_name NOT LIKE '%\%'", r"SELECT p_partkey FROM {part} WHERE p_name NOT LIKE '%\%'"),
    "cast_colons": ("SELECT o_orderkey::VARCHAR AS k, o_totalprice::INT8 AS whole FROM {orders}", "SELECT o_orderkey::VARCHAR AS k, trunc(o_totalprice)::BIGINT AS whole FROM {orders}"),
    "now_functions": ("SELECT n_nationkey, NOW() = CURRENT_TIMESTAMP AS same, CAST(NOW() AS DATE) = CURRENT_DATE AS today, length(CURRENT_TIME) AS n FROM {nation}", "SELECT n_nationkey, TRUE AS same, TRUE AS today, 8 AS n FROM {nation}"),
}
QUERIES = {name: over_tables(sql) for name, (sql, _) in SQL.items()}
# with parameters: (text, values, the oracle's SQL)
BOUND = {
    "parameters": ("SELECT o_orderkey, o_totalprice * @f AS scaled FROM {orders} WHERE o_orderstatus = $1 AND o_totalprice > @least", {"f": 2, "1": "F", "least": 100000}, "SELECT o_orderkey, o_totalprice * 2 AS scaled FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 100000"),
    "in_null_parameter": ("SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (2, @p)", {"p": None}, "SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (2)"),
}
QUERIES |= {name: over_tables(text, values) for name, (text, values, _) in BOUND.items()}
ORACLES = {name: re.sub(r"\{(\w+)\}", r"\1", other or sql) for name, (sql, other) in [*SQL.items(), *((k, (t, o)) for k, (t, _, o) in BOUND.items())]}
