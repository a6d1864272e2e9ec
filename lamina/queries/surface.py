"""The SQL surface: windows, sorting, limits, set operations, scalar functions, subqueries."""

from __future__ import annotations

from .registry import sql_query

for _name, _sql in {
    "w_row_number": "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn FROM events",
    "w_rank": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE)) AS BIGINT) AS r FROM orders",
    "w_dense_rank": "SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE)) AS BIGINT) AS r FROM orders",
    "w_lag": "SELECT event_id, lag(event_id, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "w_lead": "SELECT event_id, lead(event_id, 2, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "w_frame_rows": "SELECT event_id, CAST(sum(user_id * 3 + event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events",
    "w_frame_range": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS n FROM orders",
    "w_topk_per_group": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) AS t WHERE rn <= 2",
    "s_sort": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey",
    "s_limit": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 17",
    "s_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 1000",
    "s_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "s_nulls_first": "SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS f FROM lineitem ORDER BY f NULLS FIRST, l_orderkey, l_linenumber, l_partkey",
    "s_nulls_last": "SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS f FROM lineitem ORDER BY f DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey",
    "s_sort_const_keys": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderstatus, o_orderkey",
    "s_sort_union_transpose": "SELECT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier) AS u ORDER BY k DESC",
    "s_sort_project_transpose": "SELECT o_orderkey, k * 2 AS d FROM (SELECT o_orderkey, o_custkey + 1 AS k FROM orders) AS t ORDER BY k DESC, o_orderkey",
    "s_sort_join_transpose": "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT n_regionkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region",
    "set_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'",
    "set_intersect_all": "SELECT o_orderpriority AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_orderpriority FROM orders WHERE o_totalprice > 200000",
    "set_except_all": "SELECT o_orderpriority AS k FROM orders EXCEPT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F'",
    "values": "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)",
    "table_function": "SELECT CAST(k AS BIGINT) AS k, count(*) AS n FROM nation, (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) AS r WHERE n_regionkey < k GROUP BY k",
    "fn_arith": "SELECT o_orderkey, o_orderkey * 2 + 1 AS a, o_orderkey - o_custkey AS b, o_totalprice / 4 AS c, o_totalprice * 0.5 AS d FROM orders",
    "fn_interval": "SELECT o_orderkey, CAST(o_orderdate + INTERVAL '3' DAY AS DATE) AS a, CAST(o_orderdate - INTERVAL '2' MONTH AS DATE) AS b, CAST(o_orderdate + INTERVAL '1' YEAR AS DATE) AS c FROM orders",
    "fn_extract_year": "SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1",
    "fn_extract_minute": "SELECT CAST(extract(minute FROM ts) AS BIGINT) AS m, count(*) AS n FROM events GROUP BY 1",
    "fn_substring": "SELECT c_custkey, substring(c_name FROM 1 FOR 2) AS s, substring(c_name FROM 10) AS t FROM customer",
    "fn_like": "SELECT p_partkey FROM part WHERE p_type LIKE 'S%' OR p_type LIKE '%MO' OR p_brand LIKE '%and#1%' OR p_name LIKE '%1%5%'",
    "fn_not_like": "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%A%' AND p_brand NOT LIKE 'Brand#2%'",
    "fn_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS c, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS d FROM orders",
    "fn_between": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000 AND o_totalprice NOT BETWEEN 52000 AND 53000",
    "fn_in_list": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('P')",
    "fn_scalar_subquery": "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)",
    "fn_scalar_subquery_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "fn_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "fn_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1997-01-01')",
    "fn_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "fn_not_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "fn_not_in_subquery_nulls": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_regionkey = 3)",
    "fn_derived_table": "SELECT n, count(*) AS c FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS t GROUP BY n",
    "fn_outer_on_filter": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY c_custkey",
    "fn_group_by_expr": "SELECT o_orderkey % 7 AS k, count(*) AS n FROM orders GROUP BY o_orderkey % 7",
    "fn_group_by_ordinal": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 1, 2",
    "fn_cast_literal_date": "SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= '1998-01-01' AND CAST(o_orderdate AS DATE) < DATE '1999-01-01'",
    "fn_length": "SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS n, upper(c_mktsegment) AS u, lower(c_mktsegment) AS l, trim(concat(' ', c_name, ' ')) AS t FROM customer",
    "fn_date_trunc": "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1",
    "fn_coalesce_nullif": "SELECT l_orderkey, coalesce(nullif(l_returnflag, 'N'), 'none') AS f, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "fn_null_logic": "SELECT count(*) AS n, count(x) AS c, count(CASE WHEN x = 'A' OR x IS NULL THEN 1 END) AS d, count(CASE WHEN NOT (x = 'A') THEN 1 END) AS e FROM (SELECT nullif(l_returnflag, 'N') AS x FROM lineitem) AS t",
    "fn_null_equality": "SELECT count(*) AS n FROM (SELECT nullif(n_regionkey, 1) AS a FROM nation) AS x JOIN (SELECT nullif(r_regionkey, 1) AS b FROM region) AS y ON a = b",
    "j_semi_exists": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
    "j_anti_not_exists": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)",
    "j_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)",
    "j_theta": "SELECT a.n_name AS x, b.r_name AS y FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey",
    "j_nested_loop": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "a_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "a_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "a_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "a_case_to_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN o_custkey ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY o_orderpriority",
    "a_within_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "a_avg_reduce": "SELECT o_orderstatus, round(avg(o_custkey), 6) AS m, round(stddev_samp(o_custkey), 4) AS s, round(var_pop(o_custkey), 2) AS v FROM orders GROUP BY o_orderstatus",
}.items():
    sql_query(_name, _sql)

sql_query(
    "fn_regexp_replace",
    r"SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', 'n') AS b, regexp_replace(p_name, '^(\w)\w*', '\1') AS p FROM part",
    r"SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', 'n') AS b, regexp_replace(p_name, '^(\\w)\\w*', '$1') AS p FROM part",
)
sql_query(
    "fn_json_value",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
)
sql_query(
    "fn_array",
    "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings",
    "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, embedding[0] AS first, element_at(embedding, -1) AS last FROM embeddings",
)
sql_query(
    "a_collect",
    "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey",
)
sql_query(
    "a_uncollect",
    "SELECT vec_id, k, embedding[k] AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) AS t",
    "SELECT vec_id, CAST(pos + 1 AS BIGINT) AS k, x FROM (SELECT vec_id, posexplode(embedding) AS (pos, x) FROM embeddings) AS t",
)
