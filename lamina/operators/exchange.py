"""Dealing rows out to partitions and buckets, and sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import stored


def partition_of(keys: Sequence[str], n: int) -> Column:
    """0 to n - 1, equal for equal keys; never negative."""
    return F.pmod(F.hash(*[F.col(k) for k in keys]), F.lit(n))


def partitioned(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return df.repartition(n, *[F.col(k) for k in keys])


def bucket_of(keys: Sequence[str], n: int) -> Column:
    """The bucket of a primary key by its SHA-256, the same on every system. Null key parts give null."""
    text = F.concat(*[F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")) for k in keys])
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def ranged(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Partitions of ascending ranges of the keys, each sorted, nulls first."""
    return df.repartitionByRange(n, *[F.col(k) for k in keys]).sortWithinPartitions(*keys)


def sorted_within(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Dealt out by key and sorted, as a merge join wants it."""
    return partitioned(df, keys, n).sortWithinPartitions(*keys)


def exchanged(df: DataFrame, keys: Sequence[str], n: int, method: str = "stream") -> DataFrame:
    """Rows dealt out by key: `stream` by Spark's own shuffle; `batch` through files in the folder that all executors
    share, which stay when the executor that wrote them is lost. Both have the same rows."""
    if method not in ("batch", "stream"):
        raise ValueError(f"no such exchange: {method}")
    dealt = partitioned(df, keys, n)
    return stored(dealt) if method == "batch" else dealt
