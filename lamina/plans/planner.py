"""Logical trees of scans, joins and aggregations, and the DataFrames that they become."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.aggregates import Aggregate, aggregate
from ..operators.filters import TableFilter
from ..operators.joins import Join, estimated_bytes, flip, join
from ..sources.reader import Scan, over
from . import cost


@dataclass
class BaseTable:
    """A table, or its narrower variants (frames by the columns they have), with a filter for each column."""

    name: str
    source: DataFrame
    columns: Sequence[str | tuple[str, str]]
    filter: TableFilter = field(default_factory=TableFilter)
    stats: cost.TableStats | None = None
    variants: Sequence[DataFrame] = ()


@dataclass
class JoinedTable:
    """keys, left, right as in Join: the sides' own columns and the result's names. algorithm: AUTO decides by cost."""

    left: Node
    right: Node
    keys: Sequence[tuple[str, str]]
    kind: str = "EQUI_INNER"
    algorithm: str = "AUTO"
    left_columns: Sequence[tuple[str, str]] | None = None
    right_columns: Sequence[tuple[str, str]] | None = None


@dataclass
class AggregatedTable:
    child: Node
    spec: Aggregate


Node = BaseTable | JoinedTable | AggregatedTable


def narrowest(needed: set[str], whole: DataFrame, variants: Sequence[DataFrame]) -> DataFrame:
    """Of the variants that have all columns needed, the one with the fewest; the whole table, if none has."""
    fit = [v for v in variants if needed <= set(v.columns)]
    return min(fit, key=lambda v: len(v.columns), default=whole)


def stats_of(node: Node) -> cost.TableStats:
    if isinstance(node, BaseTable):
        known = node.stats or cost.TableStats(0, estimated_bytes(node.source))
        return cost.TableStats(known.rows, known.size, known.columns, cost.selectivity(node.filter, known))
    if isinstance(node, JoinedTable):
        return cost.joined(stats_of(node.left), stats_of(node.right))
    return stats_of(node.child)


def build(node: Node) -> DataFrame:
    """Declares the whole tree; nothing runs. Trees may be bushy. A join of AUTO follows the cost model where it has
    statistics; what it decides is a hint, which Spark follows as far as the join type allows."""
    if isinstance(node, BaseTable):
        needed = {c if isinstance(c, str) else c[0] for c in node.columns} | set(node.filter.columns)
        return over(narrowest(needed, node.source, node.variants), Scan(columns=node.columns, filter=node.filter))
    if isinstance(node, AggregatedTable):
        return aggregate(build(node.child), node.spec)
    chosen, left, right = node.algorithm, stats_of(node.left), stats_of(node.right)
    if chosen == "AUTO" and left.rows and right.rows:
        # The left side is the one that is hinted; swapped sides keep the result by a flipped type.
        swap = cost.small_side(left, right) == "right"
        small, large = (right, left) if swap else (left, right)
        chosen = cost.algorithm(small, large, node.kind)
        if swap:
            turned = Join([(b, a) for a, b in node.keys], flip(node.kind), cost.algorithm(small, large, flip(node.kind)), node.right_columns, node.left_columns)
            a, b = build(node.left), build(node.right)
            names = [n for _, n in node.left_columns or [(c, c) for c in a.columns]] + [n for _, n in node.right_columns or [(c, c) for c in b.columns]]
            return join(b, a, turned).select(*[f"`{n}`" for n in names])
    return join(build(node.left), build(node.right), Join(node.keys, node.kind, chosen, node.left_columns, node.right_columns))


def operators(node: Node) -> list[str]:
    """The physical stages that the tree asks for, bottom up."""
    if isinstance(node, BaseTable):
        return ["SCAN"]
    if isinstance(node, AggregatedTable):
        return [*operators(node.child), "AGGREGATION"]
    chosen = node.algorithm if node.algorithm != "AUTO" else cost.algorithm(stats_of(node.left), stats_of(node.right), node.kind)
    if chosen in ("BROADCAST", "PARTITIONED") and isinstance(node.right, JoinedTable):
        chosen += "_CHAIN"
    return [*operators(node.left), *operators(node.right), f"{chosen}_JOIN"]
