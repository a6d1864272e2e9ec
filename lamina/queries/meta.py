"""Queries of sources, sinks, statistics, layouts, placement and scheduling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..plans import cost, layout, placement
from ..plans.analysis import analyse
from ..plans.scheduling import Scheduler, Slots
from ..sources import sinks
from ..sources.catalog import Catalog, Layout, Manifest, Table
from ..sources.delimited import load, load_indexed
from ..sources.workspace import stored, workspace
from ..types import conform, parse, schema_of
from .registry import query, table

_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def _text(spark: SparkSession, sf_dir: str) -> str:
    """Orders as delimited text: status P is null, status F an empty text; prices of customers under 50 are empty."""
    place = f"{workspace(spark)}/text"
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") < 50, "").otherwise(F.col("o_totalprice").cast("string")), F.when(F.col("o_orderstatus") == "P", r"\N").when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")), F.lit(""))
    _orders(spark, sf_dir).select(line.alias("value")).write.text(place)
    return place


_LOADED = "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 50 THEN NULL ELSE o_totalprice END AS o_totalprice, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN '' ELSE o_orderstatus END AS o_orderstatus FROM orders"
_SCHEMA = schema_of("o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderstatus:string")


@query("src_csv_load", _LOADED)
def src_csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, _text(spark, sf_dir), _SCHEMA)


@query("src_load_indexed", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders")
def src_load_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, entries = load_indexed(spark, _text(spark, sf_dir), _SCHEMA, ["o_orderkey"], 8)
    return rows.join(entries, ["o_orderkey", "_row_id", "_bucket"]).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))


@query("src_import", _ORDERS)
def src_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are there become a table's."""
    manifest = Manifest(spark, f"{workspace(spark)}/t")
    manifest.add([f"{sf_dir}/orders.parquet"])
    return manifest.read().select(*_SCHEMA.names)


@query("src_storage_schemes", "SELECT count(*) AS n FROM region")
def src_storage_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are URIs of whatever file system Hadoop knows."""
    path = f"{sf_dir}/region.parquet"
    return spark.read.parquet(path if "://" in path else f"file://{path}").agg(F.count("*").alias("n"))


@query("sink_write", _ORDERS)
def sink_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{workspace(spark)}/t"
    for k in range(2):
        sinks.write(_orders(spark, sf_dir).where(F.col("o_orderkey") % 2 == k), place, sort=["o_orderkey"])
    return spark.read.parquet(place)


@query("sink_write_partitioned", "SELECT count(*) AS n, 4 AS buckets FROM orders")
def sink_write_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{workspace(spark)}/t"
    sinks.write_partitioned(_orders(spark, sf_dir), place, ["o_custkey"], 4)
    return spark.read.parquet(place).agg(F.count("*").alias("n"), F.countDistinct("_bucket").cast("int").alias("buckets"))


@query("sink_encoding_level", _ORDERS)
def sink_encoding_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = workspace(spark)
    for level in (0, 1, 2):
        sinks.write(_orders(spark, sf_dir).where(F.col("o_orderkey") % 3 == level), f"{place}/t", level)
    return spark.read.parquet(f"{place}/t")


@query("sink_compact", _ORDERS)
def sink_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = workspace(spark)
    _orders(spark, sf_dir).repartition(6).write.parquet(f"{place}/small")
    sinks.compact(spark, f"{place}/small", f"{place}/large", 1, ["o_custkey"])
    return spark.read.parquet(f"{place}/large").select(*_SCHEMA.names)


@query("cli_copy", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def cli_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.copied(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 3)


@query("cli_load", _LOADED)
def cli_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded aside, then published."""
    manifest = Manifest(spark, f"{workspace(spark)}/t")
    manifest.append(load(spark, _text(spark, sf_dir), _SCHEMA))
    return manifest.read()


@query("atomic_swap", "SELECT n_nationkey, upper(n_name) AS n_name FROM nation")
def atomic_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, n = workspace(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    manifest = Manifest(spark, f"{place}/t")
    manifest.append(n)
    old = list(manifest.files())
    n.withColumn("n_name", F.upper("n_name")).write.parquet(f"{place}/new")
    manifest.swap(old, [f"{place}/new"])
    manifest.clean()
    return manifest.read()


@query("export_parquet", "SELECT o_custkey, o_totalprice FROM orders")
def export_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{workspace(spark)}/t"
    sinks.export(_orders(spark, sf_dir), ["o_custkey", "o_totalprice"], place)
    return spark.read.parquet(place)


@query("ddl_create_table", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def ddl_create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table over two paths."""
    sinks.create_table(spark, "regions_twice", "r_regionkey INT, r_name STRING", f"{sf_dir}/region.parquet;{sf_dir}/region.parquet")
    return spark.table("regions_twice")


@query("table_modify", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def table_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{workspace(spark)}/t"
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.parquet(place)
    table(spark, sf_dir, "region").selectExpr("r_regionkey + 100 AS n_nationkey", "r_name AS n_name").write.mode("append").parquet(place)
    return spark.read.parquet(place)


@query("stats_column", "SELECT 'o_custkey' AS column_name, count(*) AS row_count, count(o_custkey) AS value_count, CAST(min(o_custkey) AS VARCHAR) AS min_value, CAST(max(o_custkey) AS VARCHAR) AS max_value, CAST(sum(o_custkey) AS DOUBLE) AS sum_value, CAST(NULL AS BIGINT) AS total_length FROM orders UNION ALL SELECT 'o_orderpriority', count(*), count(o_orderpriority), min(o_orderpriority), max(o_orderpriority), NULL, CAST(sum(strlen(o_orderpriority)) AS BIGINT) FROM orders")
def stats_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_stats(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"]).select("column_name", "row_count", "value_count", "min_value", "max_value", "sum_value", "total_length")


@query("stats_merge", "SELECT 'o_custkey' AS column_name, count(*) AS row_count, CAST(min(o_custkey) AS VARCHAR) AS min_value, CAST(max(o_custkey) AS VARCHAR) AS max_value, CAST(sum(o_custkey) AS DOUBLE) AS sum_value FROM orders")
def stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the statistics of parts."""
    o = table(spark, sf_dir, "orders").withColumn("part_no", F.col("o_orderkey") % 7)
    parts = stats.column_stats(o, ["o_custkey"], by=["part_no"]).drop("part_no")
    return stats.merged(parts, {"o_custkey": "bigint"}).select("column_name", "row_count", "min_value", "max_value", "sum_value")


@query("stats_table", "SELECT 'o_custkey' AS column_name, count(*) AS row_count, count(DISTINCT o_custkey) AS cardinality, 0.0::DOUBLE AS null_fraction FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus), 0.0 FROM orders")
def stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.table_stats(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"))


@query("cli_stat", "SELECT 'r_name' AS column_name, count(*) AS row_count, count(DISTINCT r_name) AS cardinality FROM region")
def cli_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.table_stats(table(spark, sf_dir, "region").select("r_name"), exact=False).select("column_name", "row_count", "cardinality")


@query("cost_join", "SELECT * FROM (VALUES ('nation', 'orders', 'BROADCAST', 'left', 8), ('orders', 'lineitem', 'BROADCAST', 'left', 8), ('huge', 'huge', 'PARTITIONED', 'right', 2048)) AS t(l, r, algorithm, small, partitions)")
def cost_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"nation": cost.TableStats(25, 2_000), "orders": cost.TableStats(15_000, 300_000), "lineitem": cost.TableStats(60_000, 1_000_000), "huge": cost.TableStats(1_000_000_000, 1 << 39)}
    rows = []
    for a, b in (("nation", "orders"), ("orders", "lineitem"), ("huge", "huge")):
        side = cost.small_side(made[a], made[b])
        small, large = (made[a], made[b]) if side == "left" else (made[b], made[a])
        rows.append((a, b, cost.algorithm(small, large), side, cost.join_partitions(small, large)))
    return spark.createDataFrame(rows, "l string, r string, algorithm string, small string, partitions int")


@query("layout_projection", "SELECT * FROM (VALUES ('a,b', 'narrow'), ('a,b,c', 'wide'), ('z', NULL)) AS t(columns, projection)")
def layout_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"narrow": ["a", "b"], "wide": ["a", "b", "c", "d"]}
    return spark.createDataFrame([(c, layout.projection(c.split(","), known)) for c in ("a,b", "a,b,c", "z")], "columns string, projection string")


@query("layout_splits_cost", "SELECT * FROM (VALUES ('a', 32), ('a,b', 8), ('a,b,c', 1)) AS t(columns, split)")
def layout_splits_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {"a": 4.0, "b": 8.0, "c": 200.0}
    return spark.createDataFrame([(c, layout.cost_based_split(sizes, c.split(","), 128, 64)) for c in ("a", "a,b", "a,b,c")], "columns string, split int")


@query("layout_splits_inverted", "SELECT * FROM (VALUES ('a', 4), ('b,c', 8), ('z', 1)) AS t(columns, split)")
def layout_splits_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = layout.SplitsIndex()
    known.add(["a", "b"], 4)
    known.add(["b", "c"], 8)
    return spark.createDataFrame([(c, known.best(c.split(","))) for c in ("a", "b,c", "z")], "columns string, split int")


@query("compact_layout", "SELECT * FROM (VALUES ('pure', '0a 1a 0b 1b'), ('naive', '0a 0b 1a 1b')) AS t(how, chunks)")
def compact_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(how, " ".join(f"{g}{c}" for g, c in layout.compact_order(["a", "b"], 2, how))) for how in ("pure", "naive")]
    return spark.createDataFrame(rows, "how string, chunks string")


_QUESTION = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name"


@query("plan_analysis", "SELECT * FROM (VALUES ('customer', 'c_acctbal,c_nationkey'), ('nation', 'n_name,n_nationkey')) AS t(table_name, columns)")
def plan_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("customer", "nation"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    found = analyse(spark, _QUESTION).tables
    return spark.createDataFrame([(t, ",".join(c)) for t, c in found.items()], "table_name string, columns string")


@query("placement", "SELECT * FROM (VALUES ('all', 'on_prem'), ('some', 'cloud')) AS t(cached, place)")
def place(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("customer", "nation"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    needed = analyse(spark, _QUESTION).tables
    peers = {"all": {t: list(c) for t, c in needed.items()}, "some": {"nation": needed["nation"]}}
    return spark.createDataFrame([(k, placement.place(needed, {"on_prem": p})) for k, p in peers.items()], "cached string, place string")


@query("cache_plan", "SELECT * FROM (VALUES ('most_columns', 'a,b'), ('most_frequent', 'c'), ('rate_greedy', 'c'), ('most_coverage', 'a,b'), ('cost_optimal', 'c')) AS t(method, columns)")
def cache_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = lambda c: ("t", c)
    loads = [placement.Load(frozenset(map(column, "ab")), 1, 10), placement.Load(frozenset([column("c")]), 5, 100)]
    sizes = {column("a"): 3, column("b"): 3, column("c"): 9}
    methods = ("most_columns", "most_frequent", "rate_greedy", "most_coverage", "cost_optimal")
    return spark.createDataFrame([(m, ",".join(sorted(c for _, c in getattr(placement, m)(loads, sizes, 10)))) for m in methods], "method string, columns string")


@query("sched_hints", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'IMMEDIATE', 'cluster', 0), (2, 'IMMEDIATE', 'elastic', 0), (3, 'RELAXED', 'cluster', 30), (4, 'BEST_EFFORT', 'cluster', 60)) AS t(token, hint, pool, second)")
def sched_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = [0]
    s = Scheduler(Slots(1, 1), lambda: now[0])
    for hint in ("IMMEDIATE", "IMMEDIATE", "RELAXED", "BEST_EFFORT"):
        s.submit("SELECT 1", hint)
    rows = []
    for now[0] in (0, 15, 30, 60):
        if now[0] == 15:
            s.slots.give("cluster")
            s.slots.give("elastic")
            s.slots.used["cluster"] += 1  # another query holds the slot
        if now[0] == 30:
            s.slots.give("cluster")
        if now[0] == 60:
            s.slots.give("cluster")
        rows += [(q.token, q.hint, q.pool, now[0]) for q in s.step()]
    return spark.createDataFrame(rows, "token long, hint string, pool string, second int")


@query("metadata_catalog", "SELECT * FROM (VALUES ('s', 'nation', 'n_nationkey', 'integer', 0), ('s', 'nation', 'n_name', 'char(25)', 1)) AS t(schema_name, table_name, column_name, column_type, position)")
def metadata_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog()
    c.create_schema("s")
    c.create_table("s", Table("nation", {"n_nationkey": "integer", "n_name": "char(25)"}, ["n_nationkey"], [Layout(1, f"{sf_dir}/nation.parquet")]))
    return Catalog.from_json(c.to_json()).describe(spark, "s")


@query("types", "SELECT * FROM (VALUES ('decimal(15,2)', 'decimal(15,2)'), ('LONG', 'bigint'), ('varchar(25)', 'varchar(25)'), ('timestamp(6)', 'timestamp_ntz'), ('vector(64)', 'array<double>'), ('time(3)', 'int'), ('real', 'float'), ('decimal', 'decimal(38,0)')) AS t(declared, spark_type)")
def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, parse(t).simpleString()) for t in ("decimal(15,2)", "LONG", "varchar(25)", "timestamp(6)", "vector(64)", "time(3)", "real", "decimal")], "declared string, spark_type string")


@query("type_conform", "SELECT event_id, date_trunc('millisecond', ts) AS ts3, rpad(event_type, 12, ' ') AS padded, substr(props, 1, 3) AS cut FROM events")
def type_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", conform(F.col("ts"), "timestamp(3)").alias("ts3"), conform(F.col("event_type"), "char(12)").alias("padded"), conform(F.col("props"), "varchar(3)").alias("cut"))


@query("column_cache", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def column_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen columns held in memory by Spark while they are used, and given back."""
    kept = table(spark, sf_dir, "customer").select("c_mktsegment").cache()
    try:
        return stored(kept.groupBy("c_mktsegment").agg(F.count("*").alias("n")))
    finally:
        kept.unpersist()


@query("rest_api", "SELECT CAST(count(*) AS VARCHAR) AS n FROM nation")
def rest_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted, run and fetched as text."""
    from ..service import Service

    c = Catalog()
    c.create_schema("s")
    c.create_table("s", Table("nation", {"n_nationkey": "integer"}, [], [Layout(1, f"{sf_dir}/nation.parquet")]))
    service = Service(spark, c)
    service.use("s")
    columns, rows = service.result(service.submit("SELECT count(*) AS n FROM nation"))
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{x} string" for x in columns))


@query("record_reader", "SELECT batch, CAST(count(*) AS INTEGER) AS rows FROM (SELECT CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS INTEGER) AS batch FROM nation) AS t GROUP BY batch")
def record_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows pulled in batches of at most 10."""
    from ..sources.reader import batches

    return spark.createDataFrame([(k, b.num_rows) for k, b in enumerate(batches(table(spark, sf_dir, "nation"), 10))], "batch int, rows int")
