"""Grouped and global aggregation by a declaration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {
    "SUM": F.sum, "COUNT": F.count, "MIN": F.min, "MAX": F.max, "AVG": F.avg, "COUNT_DISTINCT": F.countDistinct,
    "STDDEV": F.stddev_samp, "VARIANCE": F.var_samp, "COLLECT": F.collect_list,
}
#: Groups that one partition of the result is planned for.
GROUPS_PER_PARTITION = 1_280_000


@dataclass(frozen=True)
class Aggregate:
    """keys: (column, alias, whether it is part of the result). functions: (name, column or `*`, alias); a column may
    have several. An empty list of keys gives one row. Sums of nulls only are null; sums that overflow raise."""

    keys: Sequence[tuple[str, str, bool]]
    functions: Sequence[tuple[str, str, str]]
    partitions: int | None = None

    def columns(self) -> list[Column]:
        out = []
        for name, column, alias in self.functions:
            if name not in FUNCTIONS:
                raise ValueError(f"no such function: {name}")
            out.append(FUNCTIONS[name]("*" if column == "*" else F.col(column)).alias(alias))
        return out


def aggregate(df: DataFrame, spec: Aggregate) -> DataFrame:
    """Partial sums are made where the rows are, then dealt out by the keys and made final. Null keys are one group."""
    if not spec.keys:
        return df.agg(*spec.columns())
    grouped = df.groupBy(*[F.col(c).alias(a) for c, a, _ in spec.keys]).agg(*spec.columns())
    out = grouped.select(*[F.col(f"`{a}`") for _, a, shown in spec.keys if shown], *[F.col(f"`{a}`") for _, _, a in spec.functions])
    return out.repartition(spec.partitions, *[F.col(f"`{a}`") for _, a, shown in spec.keys if shown]) if spec.partitions and any(k[2] for k in spec.keys) else out


def partitions_for(cardinalities: Sequence[int]) -> int:
    """Partitions for a result grouped by keys with these numbers of different values."""
    return max(1, -(-max(cardinalities, default=1) // GROUPS_PER_PARTITION))


def partial(df: DataFrame, spec: Aggregate) -> DataFrame:
    """Sums and counts by group of a part of the rows, for merge()."""
    if {f for f, _, _ in spec.functions} - {"SUM", "COUNT", "MIN", "MAX"}:
        raise ValueError("only sums, counts, least and greatest values can be merged")
    return aggregate(df, Aggregate([(c, a, True) for c, a, _ in spec.keys], spec.functions))


def merge(parts: DataFrame, spec: Aggregate) -> DataFrame:
    """The final result from the union of partial ones: counts are summed."""
    final = [("SUM" if f == "COUNT" else f, a, a) for f, _, a in spec.functions]
    return aggregate(parts, Aggregate([(a, a, shown) for _, a, shown in spec.keys], final))
