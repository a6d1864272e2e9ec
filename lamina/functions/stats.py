"""Column and table statistics, mergeable, each gathered in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a column's statistics are made of; null where the column's type has no such figure.
FIGURES = "column_name string, row_count long, value_count long, has_null boolean, min_value string, max_value string, sum_value double, total_length long, true_count long"


def _figures(name: str, kind: T.DataType) -> Column:
    c, none = F.col(f"`{name}`"), F.lit(None)
    ordered = not isinstance(kind, T.ArrayType | T.StructType | T.MapType | T.BinaryType | T.BooleanType)
    numeric, text = isinstance(kind, T.NumericType), isinstance(kind, T.StringType | T.BinaryType)
    return F.struct(
        F.lit(name).alias("column_name"),
        F.count("*").alias("row_count"),
        F.count(c).alias("value_count"),
        (F.count("*") > F.count(c)).alias("has_null"),
        (F.min(c).cast("string") if ordered else none.cast("string")).alias("min_value"),
        (F.max(c).cast("string") if ordered else none.cast("string")).alias("max_value"),
        (F.sum(c.cast("double")) if numeric else none.cast("double")).alias("sum_value"),
        (F.sum(F.octet_length(c)) if text else none.cast("long")).cast("long").alias("total_length"),
        (F.count_if(c) if isinstance(kind, T.BooleanType) else none.cast("long")).alias("true_count"),
    )


def column_stats(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """A row of FIGURES for each column, in one scan; by: for each group (such as a file) besides."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = columns or [c for c in df.columns if c not in (by or [])]
    rows = F.array(*[_figures(n, kinds[n]) for n in names])
    out = df.groupBy(*[F.col(b) for b in by]).agg(rows.alias("_f")) if by else df.agg(rows.alias("_f"))
    return out.select(*(by or []), F.inline("_f"))


def merged(parts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """FIGURES for each column from those of its parts. kinds: the type of each column, to compare least and greatest
    values by."""
    compared = F.coalesce(*[F.when(F.col("column_name") == n, F.lit(k)) for n, k in kinds.items()])
    parts = parts.withColumn("_kind", compared)
    least, most = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind in sorted(set(kinds.values())):
        own = F.col("_kind") == kind
        least = F.coalesce(F.min(F.when(own, F.expr(f"try_cast(min_value AS {kind})"))).cast("string"), least)
        most = F.coalesce(F.max(F.when(own, F.expr(f"try_cast(max_value AS {kind})"))).cast("string"), most)
    return parts.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("value_count").alias("value_count"), F.max("has_null").alias("has_null"),
        least.alias("min_value"), most.alias("max_value"), F.sum("sum_value").alias("sum_value"), F.sum("total_length").alias("total_length"), F.sum("true_count").alias("true_count"),
    )


def table_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """column_name, row_count, cardinality, null_fraction of each column; approximate cardinalities take one pass with
    bounded memory, exact ones an exchange of the distinct values."""
    if not exact:
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count("*").alias("row_count"), F.approx_count_distinct(F.col(f"`{c}`")).alias("cardinality"), (1 - F.count(F.col(f"`{c}`")) / F.count("*")).alias("null_fraction")) for c in df.columns])
        return df.agg(rows.alias("_r")).select(F.inline("_r"))
    parts = [df.agg(F.lit(c).alias("column_name"), F.count("*").alias("row_count"), F.countDistinct(F.col(f"`{c}`")).alias("cardinality"), (1 - F.count(F.col(f"`{c}`")) / F.count("*")).alias("null_fraction")) for c in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
