"""Equi joins of four types, with a chosen algorithm that never changes the result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What each join type is called in Spark.
TYPES = {"EQUI_INNER": "inner", "EQUI_LEFT": "left", "EQUI_RIGHT": "right", "EQUI_FULL": "full"}
#: The hint that asks for an algorithm. Where Spark can't follow one (such as a broadcast for a full join), it sorts.
HINTS = {"BROADCAST": "broadcast", "BROADCAST_CHAIN": "broadcast", "PARTITIONED": "shuffle_hash", "PARTITIONED_CHAIN": "shuffle_hash", "SORTED": "merge"}
#: Largest size in bytes of a side that may be broadcast because a caller asks for it.
BROADCAST_LIMIT = 256 << 20


def flip(kind: str) -> str:
    """The type of the join that is the same with its sides swapped."""
    return {"EQUI_LEFT": "EQUI_RIGHT", "EQUI_RIGHT": "EQUI_LEFT"}.get(kind, kind)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@dataclass(frozen=True)
class Join:
    """keys: pairs of a left and a right column. left, right: what each side gives to the result, as (column, alias);
    None gives all columns by their names. partition: columns (aliases) that the result is dealt out by for what
    follows it."""

    keys: Sequence[tuple[str, str]]
    kind: str = "EQUI_INNER"
    algorithm: str = "AUTO"
    left: Sequence[tuple[str, str]] | None = None
    right: Sequence[tuple[str, str]] | None = None
    partition: Sequence[str] = ()

    def __post_init__(self):
        if self.kind not in TYPES:
            raise ValueError(f"no such join type: {self.kind}")
        if self.algorithm != "AUTO" and self.algorithm not in HINTS:
            raise ValueError(f"no such join algorithm: {self.algorithm}")
        if not self.keys:
            raise ValueError("an equi join needs keys")


def _hinted(df: DataFrame, algorithm: str, limit: int) -> DataFrame:
    if algorithm == "AUTO":
        return df
    hint = HINTS[algorithm]
    if hint == "broadcast" and estimated_bytes(df) > limit:
        hint = "shuffle_hash"
    return df.hint(hint)


def join(small: DataFrame, large: DataFrame, spec: Join, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The small side is the left one. Null keys match nothing. A side larger than `limit` is never broadcast."""
    a = small.select(*[F.col(c).alias(f"_l_{k}") for k, (c, _) in enumerate(spec.keys)], *[F.col(c).alias(f"_la_{n}") for c, n in spec.left or [(c, c) for c in small.columns]])
    b = large.select(*[F.col(c).alias(f"_r_{k}") for k, (_, c) in enumerate(spec.keys)], *[F.col(c).alias(f"_rb_{n}") for c, n in spec.right or [(c, c) for c in large.columns]])
    on = [F.col(f"_l_{k}") == F.col(f"_r_{k}") for k in range(len(spec.keys))]
    out = _hinted(a, spec.algorithm, limit).join(b, on, TYPES[spec.kind])
    names = [n for _, n in spec.left or [(c, c) for c in small.columns]], [n for _, n in spec.right or [(c, c) for c in large.columns]]
    out = out.select(*[F.col(f"`_la_{n}`").alias(n) for n in names[0]], *[F.col(f"`_rb_{n}`").alias(n) for n in names[1]])
    return out.repartition(*[F.col(c) for c in spec.partition]) if spec.partition else out


def chain(smalls: Sequence[tuple[DataFrame, Join]], large: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Several small tables, each joined to what has come of the large one so far; with broadcasts, all in one stage.
    Each join's left columns are its small table's."""
    for small, spec in smalls:
        large = join(small, large, spec, limit)
    return large


def semi(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """EXISTS, IN."""
    return _half(left, right, keys, "left_semi")


def anti(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """NOT EXISTS: rows with null keys stay."""
    return _half(left, right, keys, "left_anti")


def _half(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], kind: str) -> DataFrame:
    b = right.select(*[F.col(c).alias(f"_r_{k}") for k, (_, c) in enumerate(keys)])
    return left.join(b, [F.col(c) == F.col(f"_r_{k}") for k, (c, _) in enumerate(keys)], kind)
