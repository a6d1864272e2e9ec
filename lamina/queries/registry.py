"""The named queries, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shipped

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sql_query(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query of the SQL surface: the text runs as it is; spark_sql: where dialects differ."""
    text = spark_sql or sql

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    query(name, sql)(run)
