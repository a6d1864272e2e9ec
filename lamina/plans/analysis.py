"""What a SQL text would do: nodes, depth, tables and their columns, filters, joins, aggregations."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class PlanAnalysis:
    nodes: int = 0
    depth: int = 0
    operators: list[str] = field(default_factory=list)
    tables: dict[str, list[str]] = field(default_factory=dict)
    filters: list[str] = field(default_factory=list)
    joins: list[str] = field(default_factory=list)
    aggregates: list[str] = field(default_factory=list)


def _children(plan):
    it = plan.children().iterator()
    while it.hasNext():
        yield it.next()


def analyse(spark: SparkSession, sql: str) -> PlanAnalysis:
    """Parses, resolves and optimizes the text; nothing runs. A table's columns are those that the plan reads, in the
    order of their names. Tables go by the view or table names in the resolved plan."""
    execution = spark.sql(sql)._jdf.queryExecution()
    out, names = PlanAnalysis(), {}

    def resolved(plan, alias: str | None) -> None:
        kind = plan.nodeName()
        if kind in ("SubqueryAlias", "View"):
            alias = re.split(r"[ .]", str(plan.simpleString(100)).split("SubqueryAlias ")[-1])[-1] if kind == "SubqueryAlias" and alias is None else alias
        kids = list(_children(plan))
        if not kids and alias:
            it = plan.output().iterator()
            while it.hasNext():
                a = it.next()
                names[int(a.exprId().id())] = alias, str(a.name())
        for kid in kids:
            resolved(kid, alias if kind in ("SubqueryAlias", "View", "Project") else None)

    columns = defaultdict(set)

    def walk(plan, depth: int) -> None:
        out.nodes += 1
        out.depth = max(out.depth, depth)
        kind = str(plan.nodeName())
        out.operators.append(kind)
        text = re.sub(r"#\d+L?", "", str(plan.simpleString(1000)))
        for name, into in (("Filter", out.filters), ("Join", out.joins), ("Aggregate", out.aggregates)):
            if kind == name:
                into.append(text)
        kids = list(_children(plan))
        used = plan.references() if kids else None
        if kids or depth == 1:
            it = (used if kids else plan.output()).iterator()
            while it.hasNext():
                a = it.next()
                table, column = names.get(int(a.exprId().id()), (None, None))
                if table:
                    columns[table].add(column)
        for kid in kids:
            walk(kid, depth + 1)

    resolved(execution.analyzed(), None)
    walk(execution.optimizedPlan(), 1)
    out.tables = {t: sorted(c) for t, c in sorted(columns.items())}
    return out
