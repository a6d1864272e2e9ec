"""Queries of the operator library: filters, scans, projections, joins, aggregations, exchanges."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, exchange
from ..operators.aggregates import Aggregate, aggregate
from ..operators.filters import Filter, Range, TableFilter, compare
from ..operators.joins import Join, chain, join, semi
from ..plans import planner
from ..sources.reader import Scan, file_meta, over, scan
from .registry import query, table

# Filters: name -> (table, result columns, column filters, SQL condition).
_R = Range.of
_DAY = dt.datetime(1998, 1, 1)
FILTERS = {
    "f_all": ("orders", "o_orderkey", {"o_orderkey": Filter(all=True)}, "TRUE"),
    "f_only_null": ("lineitem_n", "l_orderkey, l_linenumber", {"flag": Filter(only_null=True)}, "flag IS NULL"),
    "f_none": ("orders", "o_orderkey", {"o_orderkey": Filter(none=True)}, "FALSE"),
    "f_range": ("orders", "o_orderkey", {"o_totalprice": Filter((_R(1000.0, 50000.0, True, False),))}, "o_totalprice >= 1000 AND o_totalprice < 50000"),
    "f_range_union": ("orders", "o_orderkey", {"o_orderkey": Filter((_R(None, 100), _R(200, None, False)))}, "o_orderkey <= 100 OR o_orderkey > 200"),
    "f_in": ("orders", "o_orderkey", {"o_orderpriority": Filter(included=("1-URGENT", "5-LOW"))}, "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "f_not_in": ("lineitem_n", "l_orderkey, l_linenumber", {"flag": Filter(excluded=("A",))}, "flag NOT IN ('A')"),
    "f_in_or_notin": ("lineitem_n", "l_orderkey, l_linenumber", {"flag": Filter(included=("A",), excluded=("A", "N"))}, "flag IN ('A') OR flag NOT IN ('A', 'N')"),
    "f_allow_null": ("lineitem_n", "l_orderkey, l_linenumber", {"flag": Filter(included=("A",), allow_null=True)}, "flag = 'A' OR flag IS NULL"),
    "f_table_and": ("orders", "o_orderkey", {"o_orderstatus": Filter(included=("F",)), "o_totalprice": Filter((_R(1000.0, 200000.0, False),)), "o_orderpriority": Filter(included=("1-URGENT", "5-LOW"))}, "o_orderstatus = 'F' AND o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "f_typed_bool": ("orders_t", "o_orderkey", {"is_f": Filter(included=(True,))}, "is_f"),
    "f_typed_byte": ("orders_t", "o_orderkey", {"b": Filter((_R(3, 9, False, True),))}, "b > 3 AND b <= 9"),
    "f_typed_short": ("orders_t", "o_orderkey", {"s": Filter((_R(100, 300),))}, "s BETWEEN 100 AND 300"),
    "f_typed_int": ("orders_t", "o_orderkey", {"i": Filter((_R(None, 500, True, False),))}, "i < 500"),
    "f_typed_long": ("orders_t", "o_orderkey", {"o_custkey": Filter(included=(7, 77, 777))}, "o_custkey IN (7, 77, 777)"),
    "f_typed_timestamp": ("orders", "o_orderkey", {"o_orderdate": Filter((_R(_DAY, None),))}, "o_orderdate >= TIMESTAMP '1998-01-01'"),
    "f_typed_date": ("orders_t", "o_orderkey", {"d": Filter((_R(dt.date(1997, 1, 1), dt.date(1997, 12, 31)),))}, "d BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"),
    "f_typed_time": ("orders_t", "o_orderkey", {"ms": Filter((_R(100, 200),))}, "ms BETWEEN 100 AND 200"),
    "f_typed_decimal": ("orders_t", "o_orderkey", {"price": Filter((_R(Decimal("1000.50"), Decimal("99999.99")),))}, "price BETWEEN 1000.50 AND 99999.99"),
    "f_typed_decimal_long": ("orders_t", "o_orderkey", {"long_price": Filter((_R(Decimal("1000.5000000001"), None, False),))}, "long_price > 1000.5000000001"),
    "f_typed_double": ("orders_t", "o_orderkey", {"neg": Filter((_R(-150000.0, -100.5),))}, "neg BETWEEN -150000 AND -100.5"),
    "f_typed_bytes": ("customer", "c_custkey", {"c_name": Filter((_R("Customer#000000100", "Customer#0000002"),))}, "c_name >= 'Customer#000000100' AND c_name <= 'Customer#0000002'"),
    "f_dict_bytes": ("part", "p_partkey", {"p_brand": Filter(excluded=("Brand#1", "Brand#11"))}, "p_brand NOT IN ('Brand#1', 'Brand#11')"),
}

_VIEWS = {
    "lineitem_n": "(SELECT *, nullif(l_returnflag, 'N') AS flag FROM lineitem)",
    "orders_t": """(SELECT *, o_orderstatus = 'F' AS is_f, CAST(o_orderkey % 11 AS TINYINT) AS b, CAST(o_orderkey % 1000 AS SMALLINT) AS s, CAST(o_orderkey % 1000 AS INTEGER) AS i,
CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 300 AS INTEGER) AS ms, CAST(o_totalprice AS DECIMAL(15, 2)) AS price, CAST(o_totalprice AS DECIMAL(38, 10)) AS long_price, -o_totalprice AS neg FROM orders)""",
}


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in _VIEWS:
        return table(spark, sf_dir, name)
    base = name.split("_")[0]
    table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(f"SELECT * FROM {_VIEWS[name]}")


def _add_filters() -> None:
    for name, (source, columns, filters, condition) in FILTERS.items():

        def run(spark: SparkSession, sf_dir: str, source=source, columns=columns, filters=filters) -> DataFrame:
            return over(_source(spark, sf_dir, source), Scan(columns.split(", "), TableFilter(filters)))

        query(name, f"SELECT {columns} FROM {_VIEWS.get(source, source)} AS t WHERE {condition}")(run)


_add_filters()


@query("f_json", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND (o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate >= TIMESTAMP '2000-01-01')")
def f_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = TableFilter({"o_orderstatus": Filter(included=("F", "P")), "o_orderdate": Filter((_R(None, dt.datetime(1996, 1, 1), True, False), _R(dt.datetime(2000, 1, 1), None)))})
    return over(table(spark, sf_dir, "orders"), Scan(["o_orderkey"], TableFilter.from_json(made.to_json())))


@query("f_cpp_compare", "SELECT o_orderkey, o_custkey = 7 AS eq, o_custkey < 7 AS lt, o_custkey <= 7 AS le, o_custkey > 7 AS gt, o_custkey >= 7 AS ge FROM orders")
def f_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = {"eq": "=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[compare(F.col("o_custkey"), op, 7).alias(n) for n, op in ops.items()])


@query("f_cpp_and_or", "SELECT o_orderkey FROM orders WHERE (o_custkey > 10 AND o_custkey < 20) OR (o_custkey >= 100 AND o_custkey <= 110)")
def f_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(table(spark, sf_dir, "orders"), Scan(["o_orderkey"], TableFilter({"o_custkey": Filter((_R(10, 20, False, False), _R(100, 110)))})))


@query("f_cpp_null", "SELECT l_orderkey, l_linenumber FROM (SELECT *, nullif(l_returnflag, 'N') AS flag FROM lineitem) AS t WHERE flag IS NOT NULL AND l_quantity > 45")
def f_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(_source(spark, sf_dir, "lineitem_n"), Scan(["l_orderkey", "l_linenumber"], TableFilter({"flag": Filter((Range(),)), "l_quantity": Filter((_R(45.0, None, False),))})))


@query("f_stats_prune", "SELECT k AS part_no, CASE WHEN hi < 5000 OR lo > 9000 THEN 'none' WHEN lo >= 5000 AND hi <= 9000 THEN 'all' ELSE 'some' END AS verdict FROM (SELECT o_orderkey // 1000 AS k, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY k) AS t")
def f_stats_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which blocks of rows a filter can match, by their least and greatest values alone."""
    o = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).cast("long").alias("part_no")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    keep = Filter((_R(5000, 9000),))
    return o.select("part_no", keep.verdict(F.col("lo"), F.col("hi"), F.lit(0), F.lit(1000)).alias("verdict"))


@query("f_selectivity")
def f_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated and true shares of rows for some filters."""
    o = table(spark, sf_dir, "orders")
    low, high, n, card = o.agg(F.min("o_totalprice"), F.max("o_totalprice"), F.count("*"), F.approx_count_distinct("o_totalprice")).first()
    made = {"half": Filter((_R(None, (low + high) / 2),)), "all": Filter(all=True), "three": Filter(included=(low, high, low + 1))}
    true = o.agg(*[F.count_if(f.condition(F.col("o_totalprice"))).alias(k) for k, f in made.items()]).first()
    return spark.createDataFrame([(k, float(f.selectivity(low, high, 0.0, card)), true[k] / n) for k, f in made.items()], "name string, estimate double, truth double")


# Scans and projections.


@query("scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice <= 100000")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = planner.BaseTable("orders", table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], TableFilter({"o_totalprice": Filter((_R(None, 100000.0),))}))
    return planner.build(node)


@query("scan_filter_project", "SELECT l_orderkey AS key, l_quantity AS qty FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag = 'R'")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/lineitem.parquet", Scan([("l_orderkey", "key"), ("l_quantity", "qty")], TableFilter({"l_quantity": Filter((_R(10.0, 12.0),)), "l_returnflag": Filter(included=("R",))})))


@query("scan_worker", "SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS s, count(*) AS n FROM orders WHERE o_totalprice < 150000 GROUP BY o_orderstatus")
def scan_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_aggregate(spark, sf_dir)


@query("scan_worker_stream", "SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS s, count(*) AS n FROM orders WHERE o_totalprice < 150000 GROUP BY o_orderstatus")
def scan_worker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, dealt out by hash."""
    return exchange.partitioned(_scan_aggregate(spark, sf_dir), ["o_orderstatus"], 4)


def _scan_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = planner.BaseTable("orders", table(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey"], TableFilter({"o_totalprice": Filter((_R(None, 150000.0, True, False),))}))
    return planner.build(planner.AggregatedTable(node, Aggregate([("o_orderstatus", "o_orderstatus", True)], [("SUM", "o_custkey", "s"), ("COUNT", "*", "n")])))


@query("scan_count_star", "SELECT count(*) AS n FROM lineitem")
def scan_count_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("scan_rg_range", "SELECT o_orderkey FROM orders LIMIT 250 OFFSET 100")
def scan_rg_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/orders.parquet", Scan(["o_orderkey"], row_range=(100, 250)))


@query("scan_options", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_phone FROM customer WHERE c_nationkey = 5")
def scan_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..types import schema_of

    schema = schema_of("c_custkey:bigint,c_nationkey:int,c_phone:string")
    return scan(spark, f"{sf_dir}/customer.parquet", Scan(["c_custkey", "c_phone"], TableFilter({"c_nationkey": Filter(included=(5,))}), schema))


@query("scan_glob_duckdb", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def scan_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT r_regionkey, r_name FROM parquet.`{sf_dir}/regio*.parquet` WHERE r_regionkey > 1")


@query("reader", "SELECT count(*) AS row_count FROM customer")
def reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_meta(spark, f"{sf_dir}/customer.parquet").agg(F.sum("row_count").alias("row_count"))


@query("src_file_meta", "SELECT 'supplier.parquet' AS file_name, count(*) AS row_count FROM supplier")
def src_file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_meta(spark, f"{sf_dir}/supplier.parquet").select("file_name", "row_count")


@query("p_columns", "SELECT o_totalprice, o_orderkey FROM orders")
def p_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(table(spark, sf_dir, "orders"), Scan(["o_totalprice", "o_orderkey"]))


@query("p_mask", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def p_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(table(spark, sf_dir, "nation"), Scan([("n_nationkey", "k"), ("n_name", "name")]))


@query("p_join_alias", "SELECT n_name AS nation, r_name AS region, r_regionkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey")
def p_join_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), Join([("n_regionkey", "r_regionkey")], left=[("n_name", "nation")], right=[("r_name", "region"), ("r_regionkey", "k")]))


@query("p_agg_mask", "SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
def p_agg_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(table(spark, sf_dir, "orders"), Aggregate([("o_orderstatus", "s", False), ("o_orderpriority", "p", False)], [("COUNT", "*", "n")]))


@query("p_expr", "SELECT o_orderkey + 1 AS k, upper(o_orderstatus) AS s, o_totalprice * 2 AS p FROM orders")
def p_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey + 1 AS k", "upper(o_orderstatus) AS s", "o_totalprice * 2 AS p")


# Joins: every type by every algorithm, over whole tables for inner joins; outer ones take customers in credit and orders
# before 1998, so that both sides have rows without a match. Null keys match nothing.

_CREDIT, _DATED = "c_acctbal > 0", "o_orderdate < TIMESTAMP '1998-01-01'"


def _sql_sides(inner: bool) -> tuple[str, str]:
    c = "SELECT nullif(c_custkey, 7) AS ck, c_nationkey, c_name FROM customer"
    o = "SELECT nullif(o_custkey, 11) AS ok, o_orderkey, o_totalprice FROM orders"
    return (f"({c})", f"({o})") if inner else (f"({c} WHERE {_CREDIT})", f"({o} WHERE {_DATED})")


_SQL_TYPES = {"EQUI_INNER": "JOIN", "EQUI_LEFT": "LEFT JOIN", "EQUI_RIGHT": "RIGHT JOIN", "EQUI_FULL": "FULL JOIN"}


def _sides(spark: SparkSession, sf_dir: str, inner: bool) -> tuple[DataFrame, DataFrame]:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    if not inner:
        c, o = c.where(_CREDIT), o.where(_DATED)
    return c.selectExpr("nullif(c_custkey, 7) AS ck", "c_nationkey", "c_name"), o.selectExpr("nullif(o_custkey, 11) AS ok", "o_orderkey", "o_totalprice")


def _add_joins() -> None:
    short = {"EQUI_INNER": "j_inner", "EQUI_LEFT": "j_left", "EQUI_RIGHT": "j_right", "EQUI_FULL": "j_full"}
    for kind, stem in short.items():
        left, right = _sql_sides(kind == "EQUI_INNER")
        for algorithm in ("AUTO", "BROADCAST", "PARTITIONED", "SORTED"):

            def run(spark: SparkSession, sf_dir: str, kind=kind, algorithm=algorithm) -> DataFrame:
                c, o = _sides(spark, sf_dir, kind == "EQUI_INNER")
                return join(c, o, Join([("ck", "ok")], kind, algorithm, [("ck", "ck"), ("c_name", "c_name")], [("o_orderkey", "o_orderkey")]))

            name = stem if algorithm == "AUTO" else f"{stem}_{algorithm.lower()}"
            query(name, f"SELECT ck, c_name, o_orderkey FROM {left} AS c {_SQL_TYPES[kind]} {right} AS o ON ck = ok")(run)


_add_joins()


@query("j_flip", f"SELECT o_orderkey, c_name FROM {_sql_sides(False)[1]} AS o RIGHT JOIN {_sql_sides(False)[0]} AS c ON ck = ok")
def j_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import flip

    c, o = _sides(spark, sf_dir, False)
    return join(o, c, Join([("ok", "ck")], flip("EQUI_LEFT"), "AUTO", [("o_orderkey", "o_orderkey")], [("c_name", "c_name")]))


@query("j_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def j_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    keys = [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")]
    return join(line, line, Join(keys, left=[(c, c) for c, _ in keys], right=[("l_quantity", "l_quantity")]))


@query("j_broadcast_chain", "SELECT r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j_broadcast_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    first = Join([("n_nationkey", "s_nationkey")], algorithm="BROADCAST_CHAIN", left=[("n_name", "n_name"), ("n_regionkey", "n_regionkey")], right=[("s_name", "s_name")])
    second = Join([("r_regionkey", "n_regionkey")], algorithm="BROADCAST_CHAIN", left=[("r_name", "r_name")], right=[("n_name", "n_name"), ("s_name", "s_name")])
    return chain([(n, first), (r, second)], s)


@query("j_partitioned_chain", "SELECT n_name, c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j_partitioned_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    first = Join([("c_custkey", "o_custkey")], algorithm="PARTITIONED_CHAIN", left=[("c_custkey", "c_custkey"), ("c_nationkey", "c_nationkey")], right=[("o_orderkey", "o_orderkey")])
    second = Join([("n_nationkey", "c_nationkey")], algorithm="BROADCAST", left=[("n_name", "n_name")], right=[("c_custkey", "c_custkey"), ("o_orderkey", "o_orderkey")])
    return chain([(c, first), (n, second)], o)


@query("j_post_partition", "SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey")
def j_post_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join's result is dealt out by what is grouped next, which then needs no exchange of its own."""
    both = join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), Join([("c_custkey", "o_custkey")], left=[("c_nationkey", "c_nationkey")], right=[("o_orderkey", "o_orderkey")], partition=["c_nationkey"]))
    return both.groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("j_partial_agg", "SELECT n_name, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def j_partial_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lambda t, c: planner.BaseTable(t, table(spark, sf_dir, t), c)
    inner = planner.JoinedTable(base("customer", ["c_custkey", "c_nationkey"]), base("orders", ["o_custkey"]), [("c_custkey", "o_custkey")])
    outer = planner.JoinedTable(base("nation", ["n_nationkey", "n_name"]), inner, [("n_nationkey", "c_nationkey")], algorithm="BROADCAST")
    return planner.build(planner.AggregatedTable(outer, Aggregate([("n_name", "n_name", True)], [("COUNT", "*", "n"), ("SUM", "o_custkey", "s")])))


@query("j_multi_pipeline", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def j_multi_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both children of the last join are joins."""
    base = lambda t, c: planner.BaseTable(t, table(spark, sf_dir, t), c)
    left = planner.JoinedTable(base("region", ["r_regionkey", "r_name"]), base("nation", ["n_nationkey", "n_regionkey"]), [("r_regionkey", "n_regionkey")], algorithm="BROADCAST")
    right = planner.JoinedTable(base("customer", ["c_custkey", "c_nationkey"]), base("orders", ["o_custkey"]), [("c_custkey", "o_custkey")], algorithm="PARTITIONED")
    both = planner.JoinedTable(left, right, [("n_nationkey", "c_nationkey")])
    return planner.build(planner.AggregatedTable(both, Aggregate([("r_name", "r_name", True)], [("COUNT", "*", "n")])))


@query("j_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semi(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 300000"), [("c_custkey", "o_custkey")]).select("c_custkey")


# Aggregations.


@query("a_hash", "SELECT o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS d, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY o_custkey, o_orderstatus, CAST(o_orderdate AS DATE)")
def a_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    return aggregate(o, Aggregate([("o_custkey", "o_custkey", True), ("o_orderstatus", "o_orderstatus", True), ("d", "d", True)], [("SUM", "o_orderkey", "s")]))


@query("a_partition_out", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def a_partition_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(table(spark, sf_dir, "orders"), Aggregate([("o_custkey", "o_custkey", True)], [("COUNT", "*", "n")], partitions=aggregates.partitions_for([1_500])))


@query("a_partial_final", "SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS s, count(l_partkey) AS c, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY l_returnflag")
def a_partial_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Aggregate([("l_returnflag", "l_returnflag", True)], [("SUM", "l_orderkey", "s"), ("COUNT", "l_partkey", "c"), ("MIN", "l_suppkey", "lo"), ("MAX", "l_suppkey", "hi")])
    line = table(spark, sf_dir, "lineitem")
    return aggregates.merge(aggregates.partial(line.where("l_orderkey % 2 = 0"), spec).union(aggregates.partial(line.where("l_orderkey % 2 = 1"), spec)), spec)


_AGGS = {
    "a_sum_int": ("orders", [("o_orderstatus", "g", True)], [("SUM", "o_custkey", "s")], "SELECT o_orderstatus AS g, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus"),
    "a_count": ("lineitem_n", [("l_linestatus", "g", True)], [("COUNT", "flag", "c"), ("COUNT", "*", "n")], f"SELECT l_linestatus AS g, count(flag) AS c, count(*) AS n FROM {_VIEWS['lineitem_n']} AS t GROUP BY l_linestatus"),
    "a_min": ("orders", [("o_custkey", "g", True)], [("MIN", "o_totalprice", "m")], "SELECT o_custkey AS g, min(o_totalprice) AS m FROM orders GROUP BY o_custkey"),
    "a_max": ("orders", [("o_custkey", "g", True)], [("MAX", "o_orderpriority", "m")], "SELECT o_custkey AS g, max(o_orderpriority) AS m FROM orders GROUP BY o_custkey"),
    "a_null_group": ("lineitem_n", [("flag", "g", True)], [("COUNT", "*", "n")], f"SELECT flag AS g, count(*) AS n FROM {_VIEWS['lineitem_n']} AS t GROUP BY flag"),
    "a_one_fn_per_col": ("orders", [("o_orderstatus", "g", True)], [("MIN", "o_custkey", "lo"), ("MAX", "o_custkey", "hi"), ("COUNT", "o_custkey", "n")], "SELECT o_orderstatus AS g, min(o_custkey) AS lo, max(o_custkey) AS hi, count(o_custkey) AS n FROM orders GROUP BY o_orderstatus"),
    "a_global": ("orders", [], [("COUNT", "*", "n"), ("SUM", "o_orderkey", "s"), ("MAX", "o_orderstatus", "m")], "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, max(o_orderstatus) AS m FROM orders"),
    "a_distinct": ("orders", [("o_orderpriority", "g", True)], [("COUNT_DISTINCT", "o_custkey", "n")], "SELECT o_orderpriority AS g, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority"),
}


def _add_aggregates() -> None:
    for name, (source, keys, functions, sql) in _AGGS.items():

        def run(spark: SparkSession, sf_dir: str, source=source, keys=keys, functions=functions) -> DataFrame:
            return aggregate(_source(spark, sf_dir, source), Aggregate(keys, functions))

        query(name, sql)(run)


_add_aggregates()


@query("a_sum_decimal", "SELECT l_linestatus AS g, CAST(sum(CAST(l_extendedprice AS DECIMAL(15, 2))) AS DOUBLE) AS s FROM lineitem GROUP BY l_linestatus")
def a_sum_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice").cast("decimal(15,2)"))
    return aggregate(line, Aggregate([("l_linestatus", "g", True)], [("SUM", "p", "s")])).withColumn("s", F.col("s").cast("double"))


@query("a_sum_null", "SELECT n_regionkey AS g, CAST(sum(CASE WHEN n_regionkey > 2 THEN n_nationkey END) AS BIGINT) AS s FROM nation GROUP BY n_regionkey")
def a_sum_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of nulls only is null."""
    n = table(spark, sf_dir, "nation").withColumn("v", F.expr("CASE WHEN n_regionkey > 2 THEN n_nationkey END"))
    return aggregate(n, Aggregate([("n_regionkey", "g", True)], [("SUM", "v", "s")]))


@query("a_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def a_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(table(spark, sf_dir, "orders"), Aggregate([("o_custkey", "o_custkey", True)], [("COUNT", "*", "n")])).where("n > 15")


@query("a_cardinality_parts", "SELECT CAST(greatest(1, ceil(count(DISTINCT o_custkey) / 1280000.0)) AS BIGINT) AS partitions FROM orders")
def a_cardinality_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey")).first()[0]
    return spark.createDataFrame([(aggregates.partitions_for([n]),)], "partitions long")


# Exchanges and sorted runs.


@query("x_partition", "SELECT count(*) AS n, 8 AS parts FROM orders")
def x_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is in the partition that its key says, and no key is in two."""
    o = table(spark, sf_dir, "orders").withColumn("p", exchange.partition_of(["o_custkey"], 8))
    whole = o.groupBy("p").agg(F.count("*").alias("n")).where("p between 0 and 7")
    return whole.agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("parts"))


@query("x_partition_worker", "SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 250000")
def x_partition_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.partitioned(over(table(spark, sf_dir, "orders"), Scan(["o_custkey", "o_orderkey"], TableFilter({"o_totalprice": Filter((_R(250000.0, None, False),))}))), ["o_custkey"], 8)


@query("x_bucket", "SELECT c_custkey, CAST(('0x' || substr(sha256(length(CAST(c_custkey AS VARCHAR)) || ':' || CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 16 AS INTEGER) AS bucket FROM customer")
def x_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", exchange.bucket_of(["c_custkey"], 16).alias("bucket"))


@query("s_sort_worker", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def s_sort_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.ranged(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], 8)


@query("x_batch_vs_stream", "SELECT o_custkey, n, m AS method FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS t, (SELECT 'batch' AS m UNION ALL SELECT 'stream') AS x")
def x_batch_vs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts above an exchange of either method."""
    o = table(spark, sf_dir, "orders").select("o_custkey")
    batch, stream = (exchange.exchanged(o, ["o_custkey"], 8, m).groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("method", F.lit(m)) for m in ("batch", "stream"))
    return batch.unionByName(stream)
