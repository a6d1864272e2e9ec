"""The business queries that the tables at hand allow, with literals that occur in them. Money is summed as decimals, so
that no order of rows changes a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, sql_query, table


def money(expression: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({expression} AS DECIMAL(18, {scale}))) AS DOUBLE)"


REVENUE = money("l_extendedprice * (1 - l_discount)")


@query(
    "tpch_q3",
    f"""SELECT l_orderkey, {REVENUE} AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz '1998-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    line = table(spark, sf_dir, "lineitem").where("l_shipdate > timestamp_ntz '1998-03-15'").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = line.join(o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = joined.groupBy("l_orderkey", "o_orderdate").agg(F.expr(REVENUE).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", F.col("o_orderdate").cast("date").alias("o_orderdate"))


sql_query(
    "tpch_q1",
    f"""SELECT l_returnflag, l_linestatus, {money("l_quantity")} AS sum_qty, {money("l_extendedprice")} AS sum_base_price, {REVENUE} AS sum_disc_price,
{money("l_extendedprice * (1 - l_discount) * (1 + l_tax)", 6)} AS sum_charge, {money("l_quantity")} / count(*) AS avg_qty, {money("l_discount")} / count(*) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus""",
)
sql_query(
    "tpch_q4",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-07-01' + INTERVAL '3' MONTH
AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY o_orderpriority""",
)
sql_query(
    "tpch_q5",
    f"""SELECT n_name, {REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY n_name""",
)
sql_query(
    "tpch_q6",
    f"""SELECT {money("l_extendedprice * l_discount")} AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
)
sql_query(
    "tpch_q7",
    f"""SELECT supp_nation, cust_nation, l_year, {money("volume")} AS revenue FROM (
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
FROM supplier, lineitem, orders, customer, nation n1, nation n2
WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
AND n1.n_name IN ('NATION_1', 'NATION_2', 'NATION_3') AND n2.n_name IN ('NATION_4', 'NATION_5', 'NATION_6')
AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31') AS shipping GROUP BY supp_nation, cust_nation, l_year""",
)
sql_query(
    "tpch_q8",
    f"""SELECT o_year, {money("CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END")} / {money("volume")} AS mkt_share FROM (
SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') AS all_nations GROUP BY o_year""",
)
sql_query(
    "tpch_q10",
    f"""SELECT c_custkey, c_name, {REVENUE} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
sql_query(
    "tpch_q12",
    """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_linestatus IN ('F', 'O') AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_linestatus""",
)
sql_query(
    "tpch_q13",
    """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer
LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) AS c_orders GROUP BY c_count""",
)
sql_query(
    "tpch_q14",
    f"""SELECT 100.0 * {money("CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END")} / {REVENUE} AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'""",
    f"""SELECT 100.0D * {money("CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END")} / {REVENUE} AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'""",
)
sql_query(
    "tpch_q15",
    f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, {REVENUE} AS total_revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""",
)
sql_query(
    "tpch_q16",
    """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
)
sql_query(
    "tpch_q17",
    f"""SELECT {money("l_extendedprice")} / 7.0 AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    f"""SELECT {money("l_extendedprice")} / 7.0D AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity < (SELECT 0.4D * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
)
sql_query(
    "tpch_q18",
    f"""SELECT c_name, c_custkey, o_orderkey, o_totalprice, {money("l_quantity")} AS total_qty FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
sql_query(
    "tpch_q19",
    f"""SELECT {REVENUE} AS revenue FROM lineitem, part WHERE
(p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15)
OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 20)
OR (p_partkey = l_partkey AND p_brand = 'Brand#4' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 30)""",
)
sql_query(
    "tpch_q20",
    """SELECT s_name, s_acctbal FROM supplier, nation WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE '%O%')
GROUP BY l_suppkey HAVING sum(l_quantity) > 2000) AND s_nationkey = n_nationkey AND n_regionkey <= 2""",
)
sql_query(
    "tpch_q21",
    """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
AND l1.l_shipdate > o_orderdate + INTERVAL '60' DAY
AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate + INTERVAL '60' DAY)
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
)
sql_query(
    "tpch_q22",
    f"""SELECT cntrycode, count(*) AS numcust, {money("c_acctbal")} AS totacctbal FROM (
SELECT substring(c_name FROM 10 FOR 2) AS cntrycode, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-06-01')) AS custsale GROUP BY cntrycode""",
)

#: There is no table of what suppliers offer: who has sold a part offers it, at the least price seen, with all sold as stock.
OFFERS = """WITH partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice) AS ps_supplycost, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS ps_availqty
FROM lineitem GROUP BY l_partkey, l_suppkey)"""
_COST = money("ps_supplycost * ps_availqty")
sql_query(
    "tpch_q2",
    f"""{OFFERS}
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part, supplier, partsupp, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size <= 15 AND p_type LIKE '%O%' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
AND ps_supplycost = (SELECT min(ps_supplycost) FROM partsupp, supplier, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
)
sql_query(
    "tpch_q9",
    f"""{OFFERS}
SELECT nation, o_year, {money("amount")} AS sum_profit FROM (
SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - ps_supplycost AS amount
FROM part, supplier, lineitem, partsupp, orders, nation
WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey
AND p_type LIKE '%O%') AS profit GROUP BY nation, o_year""",
)
sql_query(
    "tpch_q11",
    f"""{OFFERS}
SELECT ps_partkey, {_COST} AS value FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7'
GROUP BY ps_partkey HAVING {_COST} > (SELECT {_COST} * 0.001 FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')""",
)
