"""Queries of the real-time layer: change events of the events table, as inserts, updates and deletes of users' last
state; snapshots, indexes, transactions, garbage collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import stored, workspace
from ..streaming import index, mvcc, txn
from ..streaming.buffer import NotReady, WriteBuffer
from ..streaming.cdc import VersionedTable, applied, current
from ..types import schema_of
from .registry import query, table

#: A change log of orders: all are inserted at 1; at 2, those with o_orderkey % 10 = 3 are updated (price + 1); at 3,
#: those with % 10 = 4 are deleted, and keys that are not there (negative ones), which does nothing; at 4, those with
#: % 20 = 4 are inserted again. Beyond a million keys `seq` comes again at another timestamp, which events may.
_KEEP = "o_orderkey, o_custkey, o_totalprice"
_CHANGES = f"""
SELECT 'INSERT' AS op, CAST(1 AS BIGINT) AS ts, o_orderkey AS seq, {_KEEP} FROM orders
UNION ALL SELECT 'UPDATE', 2, 1000000 + o_orderkey, o_orderkey, o_custkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 3
UNION ALL SELECT 'DELETE', 3, 2000000 + o_orderkey, o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 10 = 4
UNION ALL SELECT 'DELETE', 3, 3000000 + o_orderkey, -1 - o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 10 = 4
UNION ALL SELECT 'INSERT', 4, 4000000 + o_orderkey, o_orderkey, o_custkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 20 = 4"""
_SCHEMA = schema_of("o_orderkey:bigint,o_custkey:bigint,o_totalprice:double")
_AT = {
    1: f"SELECT {_KEEP} FROM orders",
    2: "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders",
    3: "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 4",
    4: "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 WHEN o_orderkey % 20 = 4 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 4 OR o_orderkey % 20 = 4",
}


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_CHANGES)


def _logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows and deletes after the whole log, applied as one batch."""
    empty = spark.createDataFrame([], "o_orderkey long, _row_id string, _commit_ts long")
    rows, deletes, _ = applied(_changes(spark, sf_dir), empty, ["o_orderkey"], _SCHEMA.names, 1)
    return stored(rows), stored(deletes)


def _table(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """The same by one batch for each timestamp."""
    out = VersionedTable(spark, f"{workspace(spark)}/t", _SCHEMA, ["o_orderkey"])
    changes = _changes(spark, sf_dir)
    for ts in (1, 2, 3, 4):
        out.apply(changes.where(F.col("ts") == ts), ts)
    return out


@query("mvcc_snapshot", _AT[3])
def mvcc_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, deletes = _logs(spark, sf_dir)
    return mvcc.snapshot(rows, deletes, 3)


@query("scan_snapshot", _AT[2])
def scan_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.reader import Scan, over

    rows, deletes = _logs(spark, sf_dir)
    return over(rows, Scan(["o_orderkey", "o_custkey", "o_totalprice"], snapshot_ts=2, deletes=deletes))


@query("scan_expose_hidden", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 = 3 THEN 2 WHEN o_orderkey % 20 = 4 THEN 4 ELSE 1 END AS BIGINT) AS _commit_ts FROM orders WHERE o_orderkey % 10 <> 4 OR o_orderkey % 20 = 4")
def scan_expose_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.reader import Scan, over

    rows, deletes = _logs(spark, sf_dir)
    return over(rows, Scan(["o_orderkey"], snapshot_ts=4, deletes=deletes, expose_hidden=True))


@query("cdc_apply", _AT[4])
def cdc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).snapshot(4)


@query("cdc_insert", _AT[1])
def cdc_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, deletes = _logs(spark, sf_dir)
    return mvcc.snapshot(rows, deletes, 1)


@query("cdc_update", "SELECT count(*) AS versions, count(DISTINCT o_orderkey) AS keys FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 20 = 4) AS t")
def cdc_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions stay in the log."""
    rows, _ = _logs(spark, sf_dir)
    return rows.agg(F.count("*").alias("versions"), F.countDistinct("o_orderkey").alias("keys"))


@query("cdc_delete", "SELECT CAST(sum(CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS by_update, CAST(sum(CASE WHEN o_orderkey % 10 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS by_delete FROM orders")
def cdc_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, deletes = _logs(spark, sf_dir)
    return deletes.agg(F.count_if(F.col("_end_ts") == 2).alias("by_update"), F.count_if(F.col("_end_ts") == 3).alias("by_delete"))


@query("cdc_stream", _AT[4])
def cdc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as files that arrive one after another, followed by a streaming query with a checkpoint."""
    place, changes = workspace(spark), _changes(spark, sf_dir)
    for ts in (1, 2, 3, 4):
        changes.where(F.col("ts") == ts).coalesce(1).write.mode("append").parquet(f"{place}/log")
    out = VersionedTable(spark, f"{place}/t", _SCHEMA, ["o_orderkey"])
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/log")
    out.follow(stream, f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out.snapshot(4)


@query("cdc_replay", _AT[4])
def cdc_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that are applied twice change nothing."""
    out, changes = _table(spark, sf_dir), _changes(spark, sf_dir)
    for ts in (3, 4):
        out.apply(changes.where(F.col("ts") == ts), ts)
    return out.snapshot(4)


@query("src_poll_cdc", "SELECT op, count(*) AS n FROM (" + _CHANGES + ") AS c WHERE ts > 1 GROUP BY op")
def src_poll_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).where("ts > 1").groupBy("op").agg(F.count("*").alias("n"))


@query("mvcc_rg_prune", "SELECT count(*) AS n FROM orders")
def mvcc_rg_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound on the commit timestamp reaches the files' reader."""
    rows, deletes = _logs(spark, sf_dir)
    return mvcc.snapshot(rows, deletes, 1).agg(F.count("*").alias("n"))


@query("mvcc_memory_gc", _AT[4])
def mvcc_memory_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, deletes = mvcc.folded(*_logs(spark, sf_dir), 3)
    return mvcc.snapshot(rows, deletes, 4, gc_ts=3)


@query("mvcc_delete_modes", _AT[3])
def mvcc_delete_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete that is logged again later, or twice, changes nothing."""
    rows, deletes = _logs(spark, sf_dir)
    again = deletes.union(deletes).union(deletes.select("_row_id", F.col("_end_ts") + 5))
    return mvcc.snapshot(rows, mvcc.ends(again), 3)


@query("storage_gc", _AT[4])
def storage_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).collect_garbage(4, f"{workspace(spark)}/t").snapshot(4)


@query("storage_gc_plan", "SELECT o_orderkey // 1000 AS file, count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 10 IN (3, 4)) AS dead FROM orders GROUP BY 1")
def storage_gc_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead rows by file, up to the deletes."""
    rows, deletes = _logs(spark, sf_dir)
    first = rows.where("_commit_ts = 1").withColumn("_file", F.floor(F.col("o_orderkey") / 1000).cast("long"))
    return mvcc.file_garbage(first, deletes, 4).select("file", "rows", "dead")


@query("write_buffer_read", _AT[2])
def write_buffer_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flushed rows and buffered ones, as one table."""
    rows, deletes = _logs(spark, sf_dir)
    return mvcc.snapshot(mvcc.unified(rows.where("_commit_ts < 2"), rows.where("_commit_ts >= 2")), deletes, 2)


@query("scan_buffer", _AT[4])
def scan_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, deletes = _logs(spark, sf_dir)
    return mvcc.snapshot(mvcc.unified(rows.where("_commit_ts < 4"), rows.where("_commit_ts >= 4")), deletes, 4)


@query("offload_snapshot", _AT[2])
def offload_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).offload(2, f"{workspace(spark)}/pinned")


# Indexes: users' events as versions of their row; a purchase deletes the entry.

_INDEX = "SELECT user_id, event_id AS ts, event_id AS row_id, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'put' END AS op FROM events"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_INDEX)


@query("idx_unique_lookup", f"WITH x AS ({_INDEX}), l AS (SELECT user_id, max(ts) FILTER (WHERE op = 'put') AS p, max(ts) FILTER (WHERE op = 'delete') AS d FROM x WHERE ts <= 5000 GROUP BY user_id) SELECT u.user_id, CAST(coalesce(CASE WHEN d IS NULL OR d < p THEN p END, -1) AS BIGINT) AS row_id FROM (SELECT DISTINCT user_id FROM events) AS u LEFT JOIN l USING (user_id)")
def idx_unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _index(spark, sf_dir)
    return index.lookup(log, log.select("user_id").distinct(), ["user_id"], 5000)


@query("idx_nonunique_lookup", f"WITH x AS ({_INDEX}), d AS (SELECT user_id, max(ts) AS d FROM x WHERE ts <= 5000 AND op = 'delete' GROUP BY user_id) SELECT x.user_id, x.row_id FROM x LEFT JOIN d USING (user_id) WHERE op = 'put' AND ts <= 5000 AND (d IS NULL OR d < ts)")
def idx_nonunique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _index(spark, sf_dir)
    return index.lookup_all(log, log, ["user_id"], 5000)


@query("idx_purge", f"WITH x AS ({_INDEX}), d AS (SELECT user_id, max(ts) AS d FROM x WHERE ts <= 5000 AND op = 'delete' GROUP BY user_id) SELECT x.user_id, x.ts, x.row_id, x.op FROM x LEFT JOIN d USING (user_id) WHERE d IS NULL OR ts > d")
def idx_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.purged(_index(spark, sf_dir), ["user_id"], 5000).select("user_id", "ts", "row_id", "op")


@query("idx_put", f"SELECT user_id, max(ts) AS row_id FROM ({_INDEX}) AS x GROUP BY user_id")
def idx_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without tombstones the newest version is found."""
    empty = spark.createDataFrame([], "user_id long, ts long, row_id long, op string")
    log = index.put(empty, _index(spark, sf_dir))
    return index.lookup(log, log.select("user_id").distinct(), ["user_id"], 1 << 40)


@query("idx_update", "SELECT user_id, CAST(max(event_id) AS BIGINT) AS row_id FROM events WHERE event_id <= 4000 GROUP BY user_id")
def idx_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row ids that updated keys had before."""
    every = _index(spark, sf_dir).withColumn("op", F.lit("put"))
    new = every.where("ts <= 4000").select("user_id").distinct().select("user_id", F.lit(4001).cast("long").alias("ts"), F.lit(0).cast("long").alias("row_id"), F.lit("put").alias("op"))
    return index.update(every.where("ts <= 4000"), new, ["user_id"], 4000)[1]


@query("idx_delete", "SELECT user_id, CAST(-1 AS BIGINT) AS row_id FROM (SELECT DISTINCT user_id FROM events) AS t")
def idx_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After their tombstones no key is found."""
    log = _index(spark, sf_dir)
    keys = log.select("user_id").distinct()
    after, _ = index.delete(log, keys, ["user_id"], 1 << 40)
    return index.lookup(after, keys, ["user_id"], 1 << 41)


@query("txn_watermark", "SELECT CAST(min(user_id + 1000) FILTER (WHERE NOT ro AND NOT e) AS BIGINT) AS high_watermark, CAST(min(user_id + 1000) FILTER (WHERE ro AND NOT e) AS BIGINT) AS low_watermark, CAST(least(min(user_id + 1000) FILTER (WHERE ro AND NOT e), min(user_id + 1000) FILTER (WHERE NOT ro AND NOT e) - 1) AS BIGINT) AS safe_fold FROM (SELECT user_id, event_type = 'view' AS ro, user_id % 3 <> 0 AS e FROM events WHERE user_id > 0) AS t")
def txn_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").where("user_id > 0").select("event_id", (F.col("user_id") + 1000).alias("ts"), (F.col("event_type") == "view").alias("read_only"), (F.col("user_id") % 3 != 0).alias("ended"))
    return txn.watermarks(log)


@query("txn_begin_commit", "SELECT * FROM (VALUES ('two writers run', CAST(1 AS BIGINT), CAST(0 AS BIGINT)), ('the younger commits', 1, 0), ('the older commits', 3, 2)) AS t(step, high_watermark, reader_ts)")
def txn_begin_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open old writer holds back what readers see."""
    t = txn.Transactions()
    a, b = t.begin(), t.begin()
    rows = [("two writers run", t.high_watermark, t.high_watermark - 1)]
    t.commit(b)
    rows.append(("the younger commits", t.high_watermark, t.high_watermark - 1))
    t.commit(a)
    rows.append(("the older commits", t.high_watermark, t.begin(read_only=True).ts))
    return spark.createDataFrame(rows, "step string, high_watermark long, reader_ts long")


@query("idx_cache", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 <> 4")
def idx_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of each key, by the index's rule."""
    rows, deletes = _logs(spark, sf_dir)
    live = current(rows.where("_commit_ts <= 3"), deletes.where("_end_ts <= 3"), ["o_orderkey"])
    return live.select("_row_id", "o_orderkey").join(rows.select("_row_id", "o_custkey"), "_row_id", "left").select("o_orderkey", "o_custkey")


def _buffer(spark: SparkSession, sf_dir: str) -> WriteBuffer:
    """Orders by status, in three appends with a flush after the second."""
    o = table(spark, sf_dir, "orders").select(*_SCHEMA.names, "o_orderstatus")
    out = WriteBuffer(spark, f"{workspace(spark)}/buffer", _SCHEMA, 1000).recover()
    for ts, status in enumerate(("F", "O", "P")):
        out.append(o.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), ts)
        if ts == 1:
            out.flush()
    return out


@query("write_buffer", "SELECT o_orderkey, o_custkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS ts FROM orders")
def write_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was appended, flushed or not, each row once."""
    return _buffer(spark, sf_dir).read(hidden=True).select(*_SCHEMA.names, F.col("_commit_ts").alias("ts"))


@query("write_buffer_files", "WITH n AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS file FROM orders), f AS (SELECT count(*) // 1000 AS flushed FROM orders WHERE o_orderstatus IN ('F', 'O')) SELECT CAST(file AS BIGINT) AS file, count(*) AS rows, file < max(flushed) AS flushed FROM n, f GROUP BY file")
def write_buffer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense row numbers fill files of 1000 rows; the full ones are flushed."""
    return _buffer(spark, sf_dir).files().withColumnRenamed("_file", "file")


@query("retina_state", "SELECT * FROM (VALUES (0, 'opened', 'RECOVERING'), (1, 'append', 'NotReady'), (2, 'recovered', 'READY'), (3, 'failed append', 'FAILED'), (4, 'append', 'NotReady'), (5, 'recovered', 'READY')) AS t(step, what, state)")
def retina_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer takes rows only between a recovery and a failure."""
    good = table(spark, sf_dir, "orders").select(*_SCHEMA.names)
    bad = good.withColumn("o_custkey", F.raise_error(F.lit("broken row")).cast("long"))
    out, seen = WriteBuffer(spark, f"{workspace(spark)}/buffer", _SCHEMA, 1000), []

    def tried(what: str, rows: DataFrame) -> None:
        try:
            out.append(rows, 1)
            seen.append((what, out.state))
        except NotReady:
            seen.append((what, "NotReady"))
        except Exception:
            seen.append((what, out.state))

    seen.append(("opened", out.state))
    tried("append", good)
    seen.append(("recovered", out.recover().state))
    tried("failed append", bad)
    tried("append", good)
    seen.append(("recovered", out.recover().state))
    return spark.createDataFrame([(k, *x) for k, x in enumerate(seen)], "step int, what string, state string")
