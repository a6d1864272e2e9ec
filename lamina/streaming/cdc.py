"""Applying change events to multiversion tables, in batches or from a stream.

An event has `op` (INSERT, UPDATE, DELETE, SNAPSHOT), `ts` (its transaction's timestamp), `seq` (its place among the
batch's events of that timestamp; never twice among its inserts, nor among its updates) and the table's columns. At one
timestamp deletes come first, then inserts, then updates. A delete of a key that isn't there does nothing; an update of
one raises, before anything is written; an insert isn't checked unless `strict` is set. Null is null, an empty text is
an empty text."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import Manifest
from ..types import COMMIT_TS
from . import mvcc

#: The order of phases within one timestamp.
PHASES = {"DELETE": 0, "INSERT": 1, "SNAPSHOT": 1, "UPDATE": 2}


class MissingKey(ValueError):
    """An update of a key that has no visible row."""


def _phase(op: Column) -> Column:
    return F.coalesce(*[F.when(op == o, p) for o, p in PHASES.items()], F.raise_error(F.concat(F.lit("no such operation: "), op)).cast("int"))


def current(rows: DataFrame, deletes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The row that each key's index entry points to: its latest version, by timestamp, phase and place in the batch,
    unless that is deleted."""
    latest = rows.groupBy(*key).agg(F.max_by("_row_id", F.struct(COMMIT_TS, "_phase", "_seq")).alias("_row_id"), F.max(COMMIT_TS).alias(COMMIT_TS))
    return latest.join(deletes.select("_row_id"), "_row_id", "left_anti")


def sequenced(batch: DataFrame, live: DataFrame, key: Sequence[str], columns: Sequence[str], commit: int | str, strict: bool = False) -> DataFrame:
    """The events of a batch with `_row_id` (never used by another commit), `_next`, `_next_ts` (what follows at the same
    key) and `_fault` (updates of missing keys; in strict mode, inserts of visible ones), and before them the rows that
    they touch. live: current() of the table, at least for the batch's keys.

    All events of a key, whatever their timestamps, stand in one sequence after the key's current row. A row that an
    insert or update makes is ended by the next event of its key, if that is a delete or an update. So one window over
    each key does the work of going through the batch in order."""
    events = batch.select(*key, *[c for c in columns if c not in key], F.col("op").alias("_op"), F.col("ts").cast("long").alias("_ts"), _phase(F.col("op")).alias("_phase"), F.col("seq").cast("long").alias("_seq"))
    events = events.withColumn("_row_id", F.concat(F.lit(f"{commit}-"), F.col("_ts").cast("string"), F.lit("-"), F.col("_phase").cast("string"), F.lit("-"), F.col("_seq").cast("string")))
    touched = live.join(events.select(*key).distinct(), list(key), "left_semi")
    before = touched.select(*key, F.lit("LIVE").alias("_op"), F.col(COMMIT_TS).alias("_ts"), F.lit(-1).alias("_phase"), F.lit(-1).cast("long").alias("_seq"), F.col("_row_id").cast("string"))
    line = Window.partitionBy(*key).orderBy(F.when(F.col("_op") == "LIVE", 0).otherwise(1), "_ts", "_phase", "_seq")
    told = events.unionByName(before, allowMissingColumns=True)
    told = told.withColumn("_next", F.lead("_op").over(line)).withColumn("_next_ts", F.lead("_ts").over(line)).withColumn("_last", F.lag("_op").over(line))
    there = F.coalesce(F.col("_last") != "DELETE", F.lit(False))
    fault = (F.col("_op") == "UPDATE") & ~there
    if strict:
        fault |= F.col("_op").isin("INSERT", "SNAPSHOT") & there
    return told.withColumn("_fault", fault)


def told_apart(told: DataFrame, key: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of sequenced events: the rows to append, the deletes to append, and the events at fault."""
    rows = told.where(F.col("_op").isin("INSERT", "SNAPSHOT", "UPDATE")).select("_row_id", F.col("_ts").alias(COMMIT_TS), "_phase", "_seq", *columns)
    deletes = told.where((F.col("_op") != "DELETE") & F.col("_next").isin("DELETE", "UPDATE")).select("_row_id", F.col("_next_ts").alias("_end_ts"))
    return rows, deletes, told.where("_fault").select(*key, F.col("_op").alias("op"), F.col("_ts").alias("ts"), F.col("_seq").alias("seq"))


def applied(batch: DataFrame, live: DataFrame, key: Sequence[str], columns: Sequence[str], commit: int | str, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    return told_apart(sequenced(batch, live, key, columns, commit, strict), key, columns)


class Overtaken(RuntimeError):
    """Another writer has committed since this one read the table; nothing was changed."""


class VersionedTable:
    """A multiversion table in a folder that all executors see. Each batch's rows and deletes are written aside, into
    folders of their own, and published together by one version of the table's manifest, which also has the batches that
    were applied and the timestamp of the last garbage collection. So readers see a batch as a whole or not at all, a
    writer that fails leaves the table as it was, and whoever opens the folder knows the same."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, list(key)
        if lacking := [k for k in key if k not in schema.names]:
            raise ValueError(f"no such key columns: {lacking}")
        self._rows = T.StructType([T.StructField("_row_id", T.StringType()), T.StructField(COMMIT_TS, T.LongType()), T.StructField("_phase", T.IntegerType()), T.StructField("_seq", T.LongType()), *schema.fields])
        self._deletes = T.StructType([T.StructField("_row_id", T.StringType()), T.StructField("_end_ts", T.LongType())])
        self._log = Manifest(spark, self.path)

    def _state(self) -> dict[str, str]:
        """The newest version: folders and what they have, `batch:` entries, and gc_ts."""
        return self._log.files()

    @property
    def gc_ts(self) -> int:
        return int(self._state().get("gc_ts", -1))

    def _read(self, state: dict[str, str], what: str) -> DataFrame:
        schema = self._rows if what == "ROWS" else self._deletes
        paths = sorted(f"{self.path}/{p}" for p, kind in state.items() if kind == what)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read(self._state(), "ROWS")

    def deletes(self) -> DataFrame:
        return self._read(self._state(), "DELETES")

    def validate(self, batch: DataFrame) -> DataFrame:
        """The batch, with an error in it wherever a key column is null."""
        for k in self.key:
            batch = batch.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"key column {k} is null")).cast(self.schema[k].dataType)).otherwise(F.col(k)))
        return batch

    def apply(self, batch: DataFrame, batch_id: int, strict: bool = False, source: str = "") -> bool:
        """Applies a batch, unless one of that number from the same source was; says whether it did. source: what counts
        the batches, such as a stream's checkpoint, so that a new stream's first batch is not an old one's."""
        state, entry, commit = self._state(), f"batch:{source}:{batch_id}", uuid.uuid4().hex
        if entry in state:
            return False
        batch, rows, deletes = self.validate(batch), self._read(state, "ROWS"), self._read(state, "DELETES")
        # Only what the batch's keys have is grouped, and the events are put in order once.
        own = rows.join(batch.select(*self.key).distinct(), self.key, "left_semi")
        told = sequenced(batch, current(own, deletes, self.key), self.key, self.schema.names, commit, strict)
        told.write.parquet(f"{self.path}/data-{commit}/told")
        told = self.spark.read.schema(told.schema).parquet(f"{self.path}/data-{commit}/told")
        new, gone, faults = told_apart(told, self.key, self.schema.names)
        try:
            if first := faults.orderBy("ts", "seq").first():
                raise MissingKey(f"{first['op']} at {first['ts']} of {[first[k] for k in self.key]}")
            new.write.parquet(f"{self.path}/data-{commit}/rows")
            gone.write.parquet(f"{self.path}/data-{commit}/deletes")
            self._publish(state, state | {f"data-{commit}/rows": "ROWS", f"data-{commit}/deletes": "DELETES", entry: commit})
        except BaseException:
            self._log.remove(f"{self.path}/data-{commit}")
            raise
        self._log.remove(f"{self.path}/data-{commit}/told")
        return True

    def _publish(self, read: dict[str, str], state: dict[str, str]) -> None:
        """Makes `state` the newest version, if `read` still is."""

        def change(now: dict[str, str]) -> dict[str, str]:
            if now != read:
                raise Overtaken("another writer has committed")
            return state

        self._log.commit(change)

    def follow(self, stream: DataFrame, checkpoint: str, strict: bool = False):
        """A writer for a stream of events; start() it. With its checkpoint it goes on where it was."""
        return stream.writeStream.foreachBatch(lambda batch, n: self.apply(batch, n, strict, checkpoint) and None).option("checkpointLocation", checkpoint)

    def snapshot(self, ts: int, hidden: bool = False) -> DataFrame:
        """What is visible at ts, by one version of the table, whatever is committed meanwhile."""
        state = self._state()
        return mvcc.snapshot(self._read(state, "ROWS"), self._read(state, "DELETES"), ts, int(state.get("gc_ts", -1)), hidden)

    def offload(self, ts: int, path: str) -> DataFrame:
        """A snapshot as a table of its own, which garbage collection doesn't touch."""
        self.snapshot(ts).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def collect_garbage(self, gc_ts: int, target: str) -> VersionedTable:
        """A table in another folder without the rows that were deleted at or before gc_ts; the old one stays as it is
        until its readers are done. What the folder had before, of a broken run or an earlier collection, is replaced
        once the new files are whole."""
        state, commit = self._state(), uuid.uuid4().hex
        rows, deletes = mvcc.folded(self._read(state, "ROWS"), self._read(state, "DELETES"), gc_ts)
        new = VersionedTable(self.spark, target, self.schema, self.key)
        before = new._state()
        rows.write.parquet(f"{new.path}/data-{commit}/rows")
        deletes.write.parquet(f"{new.path}/data-{commit}/deletes")
        batches = {k: v for k, v in state.items() if k.startswith("batch:")}
        new._publish(before, batches | {f"data-{commit}/rows": "ROWS", f"data-{commit}/deletes": "DELETES", "gc_ts": str(max(gc_ts, int(state.get("gc_ts", -1))))})
        for p in {k.split("/")[0] for k, v in before.items() if v in ("ROWS", "DELETES")}:
            new._log.remove(f"{new.path}/{p}")
        return new
