"""Loading delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.exchange import bucket_of

#: What stands for null in the files.
NULL = r"\N"


def _value(text: Column, kind: T.DataType) -> Column:
    """`\\N` is null; empty text is empty for text and null for other types; what can't be read raises."""
    if isinstance(kind, T.StringType | T.VarcharType | T.CharType):
        return F.when(text == NULL, None).otherwise(text).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.when(text == NULL, None).otherwise(F.encode(text, "UTF-8"))
    plain = F.when((text == NULL) | (text == ""), None).otherwise(F.trim(text))
    if isinstance(kind, T.BooleanType):
        return F.when(plain.isin("1", "t", "true", "T", "TRUE"), True).when(plain.isNotNull(), False)
    return plain.cast(kind)


def load(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = "|") -> DataFrame:
    """The delimiter is literal and may be of several characters; empty fields at the end of a line are fields. A line
    may have more fields than the schema, which are left out; one with fewer has nulls for the rest. There is no
    quoting: a line is a row."""
    parts = F.split(F.col("value"), "".join("\\" + c if not c.isalnum() else c for c in delimiter), -1)
    lines = spark.read.text(path).select(parts.alias("_p"))
    return lines.select(*[_value(F.get("_p", F.lit(k)), f.dataType).alias(f.name) for k, f in enumerate(schema)])


def load_indexed(spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int, delimiter: str = "|") -> tuple[DataFrame, DataFrame]:
    """The rows, dealt out by the bucket of their primary key, with `_row_id` and `_bucket`; and the index rows (key
    columns, _row_id, _bucket). A null key part raises."""
    rows = load(spark, path, schema, delimiter)
    for k in key:
        rows = rows.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"primary key column {k} is null")).cast(schema[k].dataType)).otherwise(F.col(k)))
    rows = rows.withColumn("_row_id", F.monotonically_increasing_id()).withColumn("_bucket", bucket_of(key, buckets)).repartition(buckets, "_bucket")
    return rows, rows.select(*key, "_row_id", "_bucket")
