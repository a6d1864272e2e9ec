"""Queries of what the other modules leave: physical stages, streaming twins of batch operators, maintenance, edge rules
of change events and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import Aggregate
from ..operators.filters import Filter, Range, TableFilter
from ..operators.joins import Join, join
from ..plans import planner
from ..plans.scheduling import Slots
from ..service import Service
from ..sources import sinks
from ..sources.catalog import Manifest
from ..sources.workspace import workspace
from ..streaming import index, mvcc, txn
from ..streaming.cdc import VersionedTable
from ..types import schema_of
from .realtime import _AT, _SCHEMA, _changes, _logs, _table
from .registry import query, table

_JOINED = "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"


def _base(spark: SparkSession, sf_dir: str, name: str, *columns: str, **filters: Filter) -> planner.BaseTable:
    return planner.BaseTable(name, table(spark, sf_dir, name), list(columns), TableFilter(filters))


def _pair(spark: SparkSession, sf_dir: str, algorithm: str) -> planner.JoinedTable:
    return planner.JoinedTable(_base(spark, sf_dir, "customer", "c_custkey"), _base(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), [("c_custkey", "o_custkey")], algorithm=algorithm, right_columns=[("o_orderkey", "o_orderkey")])


@query("scan_operator", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def scan_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.build(_base(spark, sf_dir, "orders", "o_orderkey", o_totalprice=Filter((Range.of(300000.0, None, False),))))


@query("op_scan", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def op_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.build(_base(spark, sf_dir, "supplier", "s_suppkey", s_nationkey=Filter(included=(3,))))


@query("op_single_stage_join", _JOINED)
def op_single_stage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.build(_pair(spark, sf_dir, "BROADCAST"))


@query("op_partitioned_join", _JOINED)
def op_partitioned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.build(_pair(spark, sf_dir, "PARTITIONED"))


@query("op_sorted_join", _JOINED)
def op_sorted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.build(_pair(spark, sf_dir, "SORTED"))


@query("j_sorted", _JOINED)
def j_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides sorted by key within their partitions, then merged."""
    return planner.build(_pair(spark, sf_dir, "SORTED"))


@query("j_hash_table", _JOINED)
def j_hash_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.build(_pair(spark, sf_dir, "PARTITIONED"))


@query("op_aggregation", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def op_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.build(planner.AggregatedTable(_base(spark, sf_dir, "orders", "o_custkey"), Aggregate([("o_custkey", "o_custkey", True)], [("COUNT", "*", "n")])))


@query("op_stages", "SELECT * FROM (VALUES ('broadcast', 'SCAN SCAN BROADCAST_JOIN AGGREGATION'), ('chain', 'SCAN SCAN SCAN PARTITIONED_JOIN BROADCAST_CHAIN_JOIN')) AS t(tree, stages)")
def op_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = planner.AggregatedTable(_pair(spark, sf_dir, "BROADCAST"), Aggregate([], [("COUNT", "*", "n")]))
    two = planner.JoinedTable(_base(spark, sf_dir, "nation", "n_nationkey"), _pair(spark, sf_dir, "PARTITIONED"), [("n_nationkey", "c_custkey")], algorithm="BROADCAST")
    return spark.createDataFrame([("broadcast", " ".join(planner.operators(one))), ("chain", " ".join(planner.operators(two)))], "tree string, stages string")


@query("op_collect", "SELECT count(*) AS rows_seen, max(o_orderkey) AS last_key FROM orders WHERE o_orderstatus = 'F'")
def op_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a run, gathered while it runs."""
    seen = Observation()
    df = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").observe(seen, F.count("*").alias("rows_seen"), F.max("o_orderkey").alias("last_key"))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows_seen"], seen.get["last_key"])], "rows_seen long, last_key long")


@query("j_broadcast_no_leftouter", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') AS o ON c_custkey = o_custkey")
def j_broadcast_no_leftouter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join whose left side can't be broadcast: the hint gives way, the result stays."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return join(c, o, Join([("c_custkey", "o_custkey")], "EQUI_LEFT", "BROADCAST", [("c_custkey", "c_custkey")], [("o_orderkey", "o_orderkey")]))


def _streamed(spark: SparkSession, sf_dir: str, name: str, change) -> DataFrame:
    """What `change` makes of a table that is read as a stream, written by a streaming query to a folder."""
    place = workspace(spark)
    df = table(spark, sf_dir, name)
    df.write.parquet(f"{place}/in")
    out = change(spark.readStream.schema(df.schema).parquet(f"{place}/in"))
    out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


@query("sink_write_stream", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice < 100000")
def sink_write_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "orders", lambda s: s.where("o_totalprice < 100000").select("o_orderkey", "o_custkey"))


@query("scan_stream_reader", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def scan_stream_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "orders", lambda s: s.select("o_orderstatus")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("j_partitioned_stream", _JOINED)
def j_partitioned_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream joined to a table."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return _streamed(spark, sf_dir, "orders", lambda s: s.join(c.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey"))


@query("j_partitioned_chain_stream", "SELECT n_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j_partitioned_chain_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return _streamed(spark, sf_dir, "orders", lambda s: s.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "o_orderkey"))


@query("x_partition_stream", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders")
def x_partition_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "orders", lambda s: s.select("o_custkey").repartition(4, "o_custkey")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("keys"))


@query("cli_compact", "SELECT n_nationkey, n_name, 1 AS files FROM nation")
def cli_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's small files are compacted, and the manifest swaps them."""
    place, n = workspace(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    manifest = Manifest(spark, f"{place}/t")
    for k in range(3):
        manifest.append(n.where(F.col("n_nationkey") % 3 == k))
    small = list(manifest.files())
    sinks.compact(spark, small, f"{place}/compact")
    manifest.swap(small, [f"{place}/compact"])
    manifest.clean()
    return manifest.read().withColumn("files", F.lit(len(manifest.files())))


@query("cli_query", "SELECT CAST(4 AS BIGINT) AS runs")
def cli_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workload, with the seconds of each run."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    timed = Service(spark).workload(["SELECT count(*) FROM nation", "SELECT max(n_name) FROM nation"], 2)
    return spark.createDataFrame(timed, "statement string, seconds double").agg(F.count_if(F.col("seconds") > 0).alias("runs"))


@query("cdc_null_encoding", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), NULL), (2, ''), (3, 'x')) AS t(k, v)")
def cdc_null_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null stays null, an empty text stays empty."""
    t = VersionedTable(spark, f"{workspace(spark)}/t", schema_of("k:bigint,v:string"), ["k"])
    t.apply(spark.createDataFrame([("INSERT", 1, i, i, v) for i, v in ((1, None), (2, ""), (3, "x"))], "op string, ts long, seq long, k long, v string"), 0)
    return t.snapshot(1)


@query("cdc_validate", "SELECT 'refused' AS outcome, CAST(0 AS BIGINT) AS rows_written")
def cdc_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with a null key is refused as a whole."""
    t = VersionedTable(spark, f"{workspace(spark)}/t", schema_of("k:bigint,v:string"), ["k"])
    outcome = "applied"
    try:
        t.apply(spark.createDataFrame([("INSERT", 1, 0, 1, "a"), ("INSERT", 1, 1, None, "b")], "op string, ts long, seq long, k long, v string"), 0)
    except Exception as e:
        if "is null" not in str(e):
            raise
        outcome = "refused"
    return spark.createDataFrame([(outcome, t.rows().count())], "outcome string, rows_written long")


@query("mvcc_too_old", "SELECT * FROM (VALUES (CAST(2 AS BIGINT), 'too old'), (3, 'read'), (4, 'read')) AS t(ts, outcome)")
def mvcc_too_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, deletes = _logs(spark, sf_dir)
    out = []
    for ts in (2, 3, 4):
        try:
            mvcc.snapshot(rows, deletes, ts, gc_ts=3)
            out.append((ts, "read"))
        except mvcc.SnapshotTooOld:
            out.append((ts, "too old"))
    return spark.createDataFrame(out, "ts long, outcome string")


@query("mvcc_export_import_chain", _AT[4])
def mvcc_export_import_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are rewritten without what was deleted up to 2; later deletes move along."""
    rows, deletes = _logs(spark, sf_dir)
    kept, later = mvcc.folded(rows, deletes, 2)
    return mvcc.snapshot(kept, later, 4, gc_ts=2)


@query("storage_gc_dual_write", _AT[4])
def storage_gc_dual_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes that are logged while files are rewritten hold for the new files: row ids stay."""
    rows, deletes = _logs(spark, sf_dir)
    kept, _ = mvcc.folded(rows, deletes.where("_end_ts <= 2"), 2)
    return mvcc.snapshot(kept, deletes.where("_end_ts > 2"), 4)


@query("storage_gc_wal", _AT[4])
def storage_gc_wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection into a folder that an earlier, broken run has left: it is written anew, and only then used."""
    place, old = workspace(spark), _table(spark, sf_dir)
    old.collect_garbage(3, f"{place}/t")
    return old.collect_garbage(4, f"{place}/t").snapshot(4)


@query("recovery_checkpoint", _AT[4])
def recovery_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming query that stops half way and goes on from its checkpoint."""
    place, changes = workspace(spark), _changes(spark, sf_dir)
    t = VersionedTable(spark, f"{place}/t", _SCHEMA, ["o_orderkey"])
    for part in ((1, 2), (3, 4)):
        for ts in part:
            changes.where(F.col("ts") == ts).coalesce(1).write.mode("append").parquet(f"{place}/log")
        stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/log")
        t.follow(stream, f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.snapshot(4)


@query("txn_begin", "SELECT * FROM (VALUES ('write', CAST(1 AS BIGINT)), ('read', 0), ('read after commit', 1)) AS t(kind, ts)")
def txn_begin(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = txn.Transactions()
    a = t.begin()
    rows = [("write", a.ts), ("read", t.begin(read_only=True).ts)]
    t.commit(a)
    return spark.createDataFrame([*rows, ("read after commit", t.begin(read_only=True).ts)], "kind string, ts long")


@query("txn_lease", "SELECT 'rolled back' AS outcome, CAST(1 AS BIGINT) AS expired")
def txn_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = [0.0]
    t = txn.Transactions(5, lambda: now[0])
    a, _ = t.begin(), t.begin()
    now[0] = 6
    try:
        t.commit(a)
        outcome = "committed"
    except txn.LeaseExpired:
        outcome = "rolled back"
    return spark.createDataFrame([(outcome, len(t.expire()))], "outcome string, expired long")


@query("txn_safe_fold", "SELECT * FROM (VALUES ('writer runs', CAST(0 AS BIGINT)), ('reader runs', 1), ('none runs', 3)) AS t(step, safe_fold)")
def txn_safe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = txn.Transactions()
    a = t.begin()
    rows = [("writer runs", t.safe_fold)]
    t.commit(a)
    r = t.begin(read_only=True)
    t.commit(t.begin())
    rows.append(("reader runs", t.safe_fold))
    t.commit(r)
    return spark.createDataFrame([*rows, ("none runs", t.safe_fold)], "step string, safe_fold long")


@query("idx_main", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS places FROM orders")
def idx_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row id has one place in one file."""
    place = f"{workspace(spark)}/t"
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row_id")).repartition(3).write.parquet(place)
    return index.located(spark.read.parquet(place)).agg(F.count("*").alias("n"), F.countDistinct("file", "position").alias("places"))


@query("sched_slots", "SELECT * FROM (VALUES (1, 'cluster'), (2, 'elastic'), (3, NULL)) AS t(query, pool)")
def sched_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = Slots(1, 1)
    return spark.createDataFrame([(k, slots.take()) for k in (1, 2, 3)], "query int, pool string")
