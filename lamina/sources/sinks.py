"""Writing tables, and what is done to their files: compaction, copies, swaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Writer options for each encoding level: none; dictionaries; dictionaries and dense compression.
ENCODINGS = {
    0: {"parquet.enable.dictionary": "false", "compression": "uncompressed"},
    1: {"parquet.enable.dictionary": "true", "compression": "snappy"},
    2: {"parquet.enable.dictionary": "true", "compression": "zstd"},
}


def write(df: DataFrame, path: str, level: int = 1, mode: str = "append", sort: Sequence[str] = ()) -> None:
    """Appends the rows. sort: columns that each file is sorted by, so that its blocks' least and greatest values tell
    what they hold."""
    (df.sortWithinPartitions(*sort) if sort else df).write.options(**ENCODINGS[level]).mode(mode).parquet(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], n: int, level: int = 1, mode: str = "append") -> None:
    """One folder for each of n hash buckets of the keys."""
    bucket = F.pmod(F.hash(*[F.col(k) for k in keys]), F.lit(n))
    df.withColumn("_bucket", bucket).repartition(n, "_bucket").write.options(**ENCODINGS[level]).mode(mode).partitionBy("_bucket").parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], n: int, mode: str = "overwrite") -> None:
    """A catalog table whose later joins and groupings on the keys need no exchange."""
    df.write.mode(mode).bucketBy(n, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def compact(spark: SparkSession, source: str | Sequence[str], target: str, files: int = 1, columns: Sequence[str] = ()) -> None:
    """The rows of many small files, of one folder or several, in `files` larger ones, without an exchange. columns: an
    order of columns."""
    df = spark.read.parquet(*([source] if isinstance(source, str) else source))
    df = df.select(*columns, *[c for c in df.columns if c not in columns]) if columns else df
    df.coalesce(files).write.mode("overwrite").parquet(target)


def copied(df: DataFrame, n: int) -> DataFrame:
    """Every row n times."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("_copy") if n > 0 else df.limit(0)


def export(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Selected columns as Parquet."""
    df.select(*columns).write.mode("overwrite").parquet(path)


def create_table(spark: SparkSession, name: str, schema: str, paths: str) -> None:
    """A table over files that are there or will be: one path, or several, separated by semicolons (a view then)."""
    places = [p for p in paths.split(";") if p]
    if len(places) == 1:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet LOCATION '{places[0]}'")
        return
    spark.read.schema(schema).parquet(*places).createOrReplaceTempView(name)
