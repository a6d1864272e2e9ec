"""A write buffer in front of a table's files: rows are appended in batches, get dense row numbers and places in files of
a fixed number of rows, can be read at once, and are flushed to those files when they are full."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import Manifest
from ..types import COMMIT_TS


class NotReady(RuntimeError):
    """The buffer hasn't recovered yet, or an append has failed."""


class WriteBuffer:
    """Batches and files are folders that one version of a manifest names, so that an append and a flush happen as a
    whole or not at all, and readers never see a row twice or miss one.

    `state` is RECOVERING until recover() has deleted what broken runs left, then READY; an append or flush that fails
    makes it FAILED, which only another recover() ends. rows: the capacity of a file."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, rows: int):
        if rows < 1:
            raise ValueError("a file has one row at least")
        self.spark, self.path, self.schema, self.rows, self.state = spark, path.rstrip("/"), schema, rows, "RECOVERING"
        self._log = Manifest(spark, self.path)
        self._stored = T.StructType([*schema.fields, T.StructField(COMMIT_TS, T.LongType()), T.StructField("_row_id", T.LongType())])

    def recover(self) -> WriteBuffer:
        """Deletes folders that no version names and readers of the newest one don't need."""
        known = {p.split("/")[0] for p in self._log.files()}
        for f in self._log._fs.listStatus(self._log._path(self.path)):
            name = str(f.getPath().getName())
            if name.startswith(("batch-", "file-")) and name not in known:
                self._log.remove(f"{self.path}/{name}")
        self.state = "READY"
        return self

    def _counts(self, state: dict[str, str]) -> tuple[int, int]:
        """Rows appended, and rows that are in files."""
        return int(state.get("rows", 0)), int(state.get("flushed", 0))

    def _named(self, state: dict[str, str], kind: str) -> list[str]:
        return sorted(f"{self.path}/{p}" for p, k in state.items() if k.split(":")[0] == kind)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(*paths) if paths else self.spark.createDataFrame([], self._stored)

    def _guarded(self, change) -> None:
        if self.state != "READY":
            raise NotReady(f"the buffer is {self.state}")
        made = []
        try:
            change(made)
        except BaseException:
            self.state = "FAILED"
            for p in made:
                self._log.remove(f"{self.path}/{p}")
            raise

    def append(self, batch: DataFrame, ts: int) -> None:
        """Appends rows of one commit. Row numbers are dense: rows are stored with their partition and their place in it,
        and the partitions' sizes, which are all that is collected, say where each begins."""

        def change(made: list[str]) -> None:
            state, name = self._log.files(), uuid.uuid4().hex
            made += [f"batch-{name}", f"batch-{name}-draft"]
            place = F.monotonically_increasing_id()
            batch.select(*self.schema.names, F.lit(ts).cast("long").alias(COMMIT_TS), F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).write.parquet(f"{self.path}/{made[1]}")
            draft = self.spark.read.parquet(f"{self.path}/{made[1]}")
            begin, n = [], self._counts(state)[0]
            for r in draft.groupBy("_part").count().orderBy("_part").collect():
                begin.append((r["_part"], n))
                n += r["count"]
            starts = F.broadcast(self.spark.createDataFrame(begin, "_p long, _begin long"))
            numbered = draft.join(starts, F.col("_part") == F.col("_p")).select(*self.schema.names, COMMIT_TS, (F.col("_begin") + F.col("_at")).alias("_row_id"))
            numbered.write.parquet(f"{self.path}/{made[0]}")
            self._publish(state, state | {made[0]: f"BATCH:{n}", "rows": str(n)})
            self._log.remove(f"{self.path}/{made[1]}")

        self._guarded(change)

    def _publish(self, read: dict[str, str], state: dict[str, str]) -> None:
        def change(now: dict[str, str]) -> dict[str, str]:
            if now != read:
                raise RuntimeError("another writer has committed")
            return state

        self._log.commit(change)

    def flush(self) -> int:
        """Writes the rows of full files out of the batches, publishes the files, and forgets batches that are wholly in
        files; recover() deletes their folders. Returns how many rows were flushed."""
        moved = [0]

        def change(made: list[str]) -> None:
            state = self._log.files()
            n, before = self._counts(state)
            full = n // self.rows * self.rows
            if full == before:
                return
            name = f"file-{uuid.uuid4().hex}"
            made.append(name)
            rows = self._read(self._named(state, "BATCH")).where((F.col("_row_id") >= before) & (F.col("_row_id") < full))
            rows.withColumn("_file", self._file()).repartition("_file").sortWithinPartitions("_row_id").drop("_file").write.parquet(f"{self.path}/{name}")
            rest = {p: k for p, k in state.items() if not (k.startswith("BATCH:") and int(k.split(":")[1]) <= full)}
            self._publish(state, rest | {name: "FILE", "flushed": str(full)})
            moved[0] = full - before

        self._guarded(change)
        return moved[0]

    def _file(self) -> Column:
        return F.floor(F.col("_row_id") / self.rows).cast("long")

    def read(self, hidden: bool = False) -> DataFrame:
        """All rows of one version, flushed or not. hidden: with their commit's timestamp, _row_id, _file and _offset."""
        state = self._log.files()
        flushed = self._counts(state)[1]
        out = self._read(self._named(state, "FILE")).unionByName(self._read(self._named(state, "BATCH")).where(F.col("_row_id") >= flushed))
        return out.withColumn("_file", self._file()).withColumn("_offset", F.col("_row_id") % self.rows) if hidden else out.select(*self.schema.names)

    def files(self) -> DataFrame:
        """_file, rows and whether it is flushed, of every file, the one that is being filled included."""
        flushed = self._counts(self._log.files())[1]
        return self.read(hidden=True).groupBy("_file").agg(F.count("*").alias("rows")).withColumn("flushed", F.col("_file") < F.lit(flushed // self.rows))
