"""Versioned point indexes: which row a key pointed to at a timestamp.

A log of entries (key columns, ts, row_id, op): `put` adds a version, `delete` a tombstone for the key. A version is
visible at a snapshot if it is not newer than that and no tombstone of its key lies from its timestamp (that included)
to the snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = -1


def _latest(log: DataFrame, key: Sequence[str], until: Column) -> tuple[DataFrame, DataFrame]:
    seen = log.where(F.col("ts") <= until)
    tombs = seen.where("op = 'delete'").groupBy(*key).agg(F.max("ts").alias("_tomb"))
    return seen.where("op = 'put'"), tombs


def lookup(log: DataFrame, probes: DataFrame, key: Sequence[str], ts: int) -> DataFrame:
    """key columns and row_id for each probe of a unique index; MISSING if no version is visible."""
    puts, tombs = _latest(log, key, F.lit(ts))
    best = puts.groupBy(*key).agg(F.max(F.struct("ts", "row_id")).alias("_best")).join(tombs, list(key), "left")
    alive = best.where(F.col("_tomb").isNull() | (F.col("_tomb") < F.col("_best.ts"))).select(*key, F.col("_best.row_id").alias("row_id"))
    return probes.select(*key).join(alive, list(key), "left").select(*key, F.coalesce("row_id", F.lit(MISSING)).alias("row_id"))


def lookup_all(log: DataFrame, probes: DataFrame, key: Sequence[str], ts: int) -> DataFrame:
    """key columns and row_id, a row for each visible version of a non-unique index's probes."""
    puts, tombs = _latest(log, key, F.lit(ts))
    best = puts.groupBy(*key, "row_id").agg(F.max("ts").alias("_ts")).join(tombs, list(key), "left")
    alive = best.where(F.col("_tomb").isNull() | (F.col("_tomb") < F.col("_ts"))).select(*key, "row_id")
    return probes.select(*key).distinct().join(alive, list(key))


def put(log: DataFrame, entries: DataFrame) -> DataFrame:
    return log.unionByName(entries.select(*[c for c in log.columns if c != "op"], F.lit("put").alias("op")))


def update(log: DataFrame, entries: DataFrame, key: Sequence[str], ts: int) -> tuple[DataFrame, DataFrame]:
    """The log with the entries put, and the row ids they had before (MISSING for keys that were not there)."""
    return put(log, entries), lookup(log, entries, key, ts)


def delete(log: DataFrame, keys: DataFrame, key: Sequence[str], ts: int) -> tuple[DataFrame, DataFrame]:
    """The log with tombstones for those keys that were there, and the row ids they had."""
    before = lookup(log, keys, key, ts)
    tombs = before.where(F.col("row_id") != MISSING).select(*key, F.lit(ts).cast("long").alias("ts"), F.lit(None).cast("long").alias("row_id"), F.lit("delete").alias("op"))
    return log.unionByName(tombs), before


def purged(log: DataFrame, key: Sequence[str], ts: int) -> DataFrame:
    """Without the versions up to each key's latest tombstone at or before ts, and without those tombstones."""
    tombs = log.where((F.col("op") == "delete") & (F.col("ts") <= ts)).groupBy(*key).agg(F.max("ts").alias("_tomb"))
    return log.join(tombs, list(key), "left").where(F.col("_tomb").isNull() | (F.col("ts") > F.col("_tomb"))).drop("_tomb")


def located(rows: DataFrame) -> DataFrame:
    """A main index: row_id, file, position of the rows of a file scan that have `_row_id`."""
    return rows.select(F.col("_row_id").alias("row_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("position"))
