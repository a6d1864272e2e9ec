"""Table scans: columns, filters, snapshots, row group ranges, globs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import TableFilter
from ..streaming.mvcc import HIDDEN, snapshot
from ..types import COMMIT_TS


@dataclass(frozen=True)
class Scan:
    """columns: in the order wanted, (column, alias) or a name; None for all. tolerant: columns that a file lacks are
    null, as the declared `schema` has them; else they are an error. snapshot_ts: for multiversion tables, the rows
    visible at that timestamp, with `deletes` as the log of deleted rows. row_range: (first row, rows), -1 for all the
    rest, within each file, by the position of the row in it. expose_hidden: give the commit timestamp, too."""

    columns: Sequence[str | tuple[str, str]] | None = None
    filter: TableFilter = field(default_factory=TableFilter)
    schema: T.StructType | None = None
    tolerant: bool = True
    snapshot_ts: int | None = None
    deletes: DataFrame | None = None
    row_range: tuple[int, int] | None = None
    expose_hidden: bool = False


def scan(spark: SparkSession, path: str | Sequence[str], options: Scan = Scan()) -> DataFrame:  # noqa: B008
    """A scan of Parquet files, folders or globs. Filters and columns reach the files' reader."""
    paths = [path] if isinstance(path, str) else list(path)
    schema = options.schema
    if schema is not None and not options.tolerant:
        there = set(spark.read.parquet(*paths).columns)
        if lacking := [f.name for f in schema if f.name not in there]:
            raise ValueError(f"columns that the files lack: {', '.join(lacking)}")
    df = spark.read.schema(schema).parquet(*paths) if schema is not None else spark.read.parquet(*paths)
    if options.row_range:
        first, rows = options.row_range
        at = F.col("_metadata.row_index")
        df = df.where((at >= first) & (at < first + rows) if rows >= 0 else at >= first)
    return over(df, options)


def over(df: DataFrame, options: Scan) -> DataFrame:
    """The same for what is a DataFrame already."""
    if options.snapshot_ts is not None:
        df = snapshot(df, options.deletes, options.snapshot_ts, hidden=True)
    df = options.filter.apply(df)
    names = [(c, c) if isinstance(c, str) else c for c in options.columns] if options.columns is not None else [(c, c) for c in df.columns if c not in HIDDEN]
    if options.expose_hidden and COMMIT_TS in df.columns:
        names = [*names, (COMMIT_TS, COMMIT_TS)]
    return df.select(*[F.col(f"`{c}`").alias(a) for c, a in names])


def count(spark: SparkSession, path: str) -> int:
    """The number of rows; no column is read."""
    return spark.read.parquet(path).count()


def file_meta(spark: SparkSession, path: str) -> DataFrame:
    """file_name, file_size, row_count and first_row, last_row of each file."""
    meta = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.row_index").alias("at"))
    return meta.groupBy("file_name", "file_size").agg(F.count("*").alias("row_count"), F.min("at").alias("first_row"), F.max("at").alias("last_row"))


def batches(df: DataFrame, size: int, skip: int = 0):
    """Pulls the rows to the driver in Arrow tables of at most `size` rows, in order, from row `skip` on. Executors make
    Arrow data of a partition at a time, in slices of `size` rows, so that the driver has one partition's at most."""
    import pyarrow as pa

    schema = df.limit(0).toArrow().schema

    def sliced(parts):
        for part in parts:
            for at in range(0, part.num_rows, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part.slice(at, size))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

    kept, rows = [], 0
    for row in df.mapInArrow(sliced, "data binary").toLocalIterator():
        table = pa.ipc.open_stream(pa.py_buffer(bytes(row["data"]))).read_all().cast(schema)
        lost = min(skip, table.num_rows)
        skip, table = skip - lost, table.slice(lost)
        kept, rows = [*kept, table], rows + table.num_rows
        while rows >= size:
            whole = pa.concat_tables(kept)
            yield whole.slice(0, size).combine_chunks()
            kept, rows = [whole.slice(size)], rows - size
    if rows:
        yield pa.concat_tables(kept).combine_chunks()
