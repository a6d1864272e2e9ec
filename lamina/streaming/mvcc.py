"""Multiversion tables: an append-only log of rows, a log of deletes, and what a snapshot sees.

Rows have `_row_id` (never used twice), `_commit_ts` and the user's columns. Deletes have `_row_id` and `_end_ts`; a row
may be deleted more than once, and the least timestamp counts, so that replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import COMMIT_TS


#: Columns that a version log has beside the user's own.
HIDDEN = ("_row_id", COMMIT_TS, "_phase", "_seq", "_end_ts")


class SnapshotTooOld(ValueError):
    """Rows that the snapshot would see have been collected; a checkpoint has them."""


def snapshot(rows: DataFrame, deletes: DataFrame | None, ts: int, gc_ts: int = -1, hidden: bool = False) -> DataFrame:
    """The rows with `_commit_ts <= ts` that are not deleted at or before ts. The bound on `_commit_ts` reaches the
    files' reader, which skips blocks that are newer. hidden: keep `_row_id` and `_commit_ts`."""
    if ts < gc_ts:
        raise SnapshotTooOld(f"snapshot {ts} is older than {gc_ts}")
    seen = rows.where(F.col(COMMIT_TS) <= ts)
    if deletes is not None:
        seen = seen.join(deletes.where(F.col("_end_ts") <= ts).select("_row_id"), "_row_id", "left_anti")
    return seen if hidden else seen.select(*[F.col(f"`{c}`") for c in rows.columns if c not in HIDDEN])


def ends(deletes: DataFrame) -> DataFrame:
    """The deletes with one row for each row id: the least timestamp."""
    return deletes.groupBy("_row_id").agg(F.min("_end_ts").alias("_end_ts"))


def folded(rows: DataFrame, deletes: DataFrame, gc_ts: int) -> tuple[DataFrame, DataFrame]:
    """Garbage collection up to gc_ts: rows deleted at or before it are gone, and so are their deletes. Snapshots at
    gc_ts and later see the same as before; older ones can't be read any more."""
    old = ends(deletes)
    gone = old.where(F.col("_end_ts") <= gc_ts).select("_row_id")
    return rows.join(gone, "_row_id", "left_anti"), old.where(F.col("_end_ts") > gc_ts)


def unified(base: DataFrame, buffered: DataFrame) -> DataFrame:
    """Rows in files and rows not flushed yet, as one table; columns that one side lacks are null there."""
    return base.unionByName(buffered, allowMissingColumns=True)


def file_garbage(rows: DataFrame, deletes: DataFrame, gc_ts: int, file: str = "_file") -> DataFrame:
    """For each file: file, rows, dead (deleted at or before gc_ts), ratio."""
    marked = rows.join(ends(deletes).where(F.col("_end_ts") <= gc_ts).withColumn("_dead", F.lit(1)), "_row_id", "left")
    counted = marked.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("rows"), F.count("_dead").alias("dead"))
    return counted.withColumn("ratio", F.col("dead") / F.col("rows"))


def collection_plan(garbage: DataFrame, group: str = "group", threshold: float = 0.5, files: int = 20, groups: int = 10) -> DataFrame:
    """Which files to rewrite together: those with a ratio above the threshold, by group (such as table and node), worst
    first; at most so many files of a group, and so many groups, those with the worst files."""
    from pyspark.sql import Window

    bad = garbage.where(F.col("ratio") > threshold)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("ratio"), "file"))
    bad = bad.withColumn("place", place).where(F.col("place") <= files)
    worst = bad.groupBy(F.col(group).alias("_g")).agg(F.max("ratio").alias("_worst")).orderBy(F.desc("_worst"), "_g").limit(groups)
    return bad.join(worst, F.col(group) == F.col("_g"), "left_semi")
