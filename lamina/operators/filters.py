"""Column filters: ranges or discrete values of one column, and conjunctions of them over columns.

Spark's comparisons are the semantics: numbers by value (negative floating point numbers in order, NaN largest), text
by bytes, decimals of any precision. Bounds that exclude their value are compared as such, never by adding one."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNBOUNDED, INCLUDED, EXCLUDED = "UNBOUNDED", "INCLUDED", "EXCLUDED"


@dataclass(frozen=True)
class Bound:
    kind: str = UNBOUNDED
    value: Any = None

    def __post_init__(self):
        if self.kind not in (UNBOUNDED, INCLUDED, EXCLUDED):
            raise ValueError(f"no such kind of bound: {self.kind}")
        if (self.kind == UNBOUNDED) != (self.value is None):
            raise ValueError("a bound has a value unless it is unbounded")


@dataclass(frozen=True)
class Range:
    lower: Bound = Bound()
    upper: Bound = Bound()

    @staticmethod
    def of(low: Any = None, high: Any = None, low_in: bool = True, high_in: bool = True) -> Range:
        """None leaves a side open."""
        bound = lambda v, inside: Bound() if v is None else Bound(INCLUDED if inside else EXCLUDED, v)
        return Range(bound(low, low_in), bound(high, high_in))

    def condition(self, column: Column) -> Column:
        parts = [column.isNotNull()]
        if self.lower.kind != UNBOUNDED:
            parts.append(column >= F.lit(self.lower.value) if self.lower.kind == INCLUDED else column > F.lit(self.lower.value))
        if self.upper.kind != UNBOUNDED:
            parts.append(column <= F.lit(self.upper.value) if self.upper.kind == INCLUDED else column < F.lit(self.upper.value))
        return reduce(lambda a, b: a & b, parts[1:] or parts)


@dataclass(frozen=True)
class Filter:
    """What a column's values must be. First of these that applies decides: `all` (every row, nulls too), `only_null`,
    `none`. Then ranges, if there are any: one of them must hold. Else the discrete values: included ones (IN) or
    excluded ones (NOT IN); with both, either suffices. `allow_null` lets nulls pass besides."""

    ranges: tuple[Range, ...] = ()
    included: tuple[Any, ...] = ()
    excluded: tuple[Any, ...] = ()
    all: bool = False
    none: bool = False
    only_null: bool = False
    allow_null: bool = False

    def condition(self, column: Column) -> Column:
        if self.all:
            return F.lit(True)
        if self.only_null:
            return column.isNull()
        if self.none:
            return F.lit(False)
        if self.ranges:
            parts = [r.condition(column) for r in self.ranges]
        else:
            parts = [column.isin(list(self.included))] if self.included else []
            if self.excluded:
                parts.append(~column.isin(list(self.excluded)))
        if not parts:
            return column.isNull() if self.allow_null else F.lit(False)
        whole = reduce(lambda a, b: a | b, parts)
        return whole | column.isNull() if self.allow_null else whole

    def matches(self, low: Any, high: Any, nulls: int, rows: int) -> str:
        """'all', 'none' or 'some' of a block of rows can match, by the block's least and greatest value (None if it
        has no value) and its counts of nulls and of rows."""
        if self.all:
            return "all" if rows else "none"
        if self.none or not rows:
            return "none"
        if self.only_null:
            return "all" if nulls == rows else "some" if nulls else "none"
        null_part = bool(nulls) and self.allow_null
        if low is None:
            return "all" if null_part and nulls == rows else "some" if null_part else "none"
        inside = [self._range(r, low, high) for r in self.ranges]
        if not self.ranges:
            inside = ["all" if low == high == v else "some" for v in self.included if low <= v <= high]
            if self.excluded:
                hit = [v for v in self.excluded if low <= v <= high]
                inside.append("all" if not hit else "none" if low == high else "some")
        values = "all" if "all" in inside else "some" if "some" in inside else "none"
        if values == "all" and (not nulls or null_part):
            return "all"
        return "some" if values != "none" or null_part else "none"

    def verdict(self, low: Column, high: Column, nulls: Column, rows: Column) -> Column:
        """matches() for a table of blocks, as an expression."""
        if self.all:
            return F.when(rows > 0, "all").otherwise("none")
        if self.none:
            return F.lit("none")
        if self.only_null:
            return F.when((nulls == rows) & (rows > 0), "all").when(nulls > 0, "some").otherwise("none")
        full, part = F.lit(False), F.lit(False)
        for r in self.ranges:
            a, b = (F.lit(x.value) for x in (r.lower, r.upper))
            above = F.lit(True) if r.lower.kind == UNBOUNDED else low >= a if r.lower.kind == INCLUDED else low > a
            below = F.lit(True) if r.upper.kind == UNBOUNDED else high <= b if r.upper.kind == INCLUDED else high < b
            reach = F.lit(True) if r.lower.kind == UNBOUNDED else high >= a if r.lower.kind == INCLUDED else high > a
            start = F.lit(True) if r.upper.kind == UNBOUNDED else low <= b if r.upper.kind == INCLUDED else low < b
            full, part = full | (above & below), part | (reach & start)
        if not self.ranges:
            for v in map(F.lit, self.included):
                full, part = full | ((low == v) & (high == v)), part | ((low <= v) & (high >= v))
            if self.excluded:
                clear = reduce(lambda x, y: x & y, [(low > F.lit(v)) | (high < F.lit(v)) for v in self.excluded])
                full, part = full | clear, part | clear | (low != high)
        full, part = F.coalesce(full, F.lit(False)), F.coalesce(part, F.lit(False))
        null_part = (nulls > 0) & F.lit(self.allow_null)
        empty = F.when(null_part & (nulls == rows), "all").when(null_part, "some").otherwise("none")
        whole = F.when(full & ((nulls == 0) | null_part), "all").when(part | full | null_part, "some").otherwise("none")
        return F.when(rows == 0, "none").when(low.isNull(), empty).otherwise(whole)

    @staticmethod
    def _range(r: Range, low: Any, high: Any) -> str:
        above = r.lower.kind == UNBOUNDED or (low >= r.lower.value if r.lower.kind == INCLUDED else low > r.lower.value)
        below = r.upper.kind == UNBOUNDED or (high <= r.upper.value if r.upper.kind == INCLUDED else high < r.upper.value)
        if above and below:
            return "all"
        misses = r.lower.kind != UNBOUNDED and (high < r.lower.value if r.lower.kind == INCLUDED else high <= r.lower.value)
        misses |= r.upper.kind != UNBOUNDED and (low > r.upper.value if r.upper.kind == INCLUDED else low >= r.upper.value)
        return "none" if misses else "some"

    def selectivity(self, low: Any, high: Any, null_fraction: float, cardinality: int) -> float:
        """The share of rows expected to pass, from 0 to 1, or -1 if the figures don't tell. Ranges count by their
        overlap with the column's, discrete values by the number of different ones."""
        if self.all:
            return 1.0
        if self.only_null:
            return null_fraction
        if self.none:
            return 0.0
        null_part = null_fraction if self.allow_null else 0.0
        if self.ranges:
            try:
                width = _number(high) - _number(low)
            except (TypeError, ValueError):
                return -1.0
            total = 0.0
            for r in self.ranges:
                a = _number(low) if r.lower.kind == UNBOUNDED else max(_number(low), _number(r.lower.value))
                b = _number(high) if r.upper.kind == UNBOUNDED else min(_number(high), _number(r.upper.value))
                if width > 0 and b > a:
                    total += (b - a) / width
                elif b == a and self._range(r, low, high) != "none" or width == 0 and b >= a:
                    total += 1.0 / max(1, cardinality)
            return min(1.0, total * (1 - null_fraction) + null_part)
        if cardinality <= 0:
            return -1.0
        share = len(set(self.included)) / cardinality
        if self.excluded:
            share += max(0.0, 1 - len(set(self.excluded)) / cardinality)
        return min(1.0, min(1.0, share) * (1 - null_fraction) + null_part)


def _number(value: Any) -> float:
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).timestamp() if value.tzinfo else (value - dt.datetime(1970, 1, 1)).total_seconds()
    if isinstance(value, dt.date):
        return float((value - dt.date(1970, 1, 1)).days)
    if isinstance(value, str | bytes) or value is None:
        raise TypeError("no number")
    return float(value)


@dataclass
class TableFilter:
    """One filter for each of some columns; a row passes if it passes all."""

    columns: dict[str, Filter] = field(default_factory=dict)

    def condition(self) -> Column:
        parts = [f.condition(F.col(f"`{c}`")) for c, f in self.columns.items()]
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition()) if self.columns else df

    def to_json(self) -> str:
        bound = lambda b: [b.kind] if b.kind == UNBOUNDED else [b.kind, _plain(b.value)]
        out = {}
        for c, f in self.columns.items():
            out[c] = {k: v for k, v in (("all", f.all), ("none", f.none), ("only_null", f.only_null), ("allow_null", f.allow_null)) if v}
            out[c] |= {"ranges": [[bound(r.lower), bound(r.upper)] for r in f.ranges]} if f.ranges else {}
            out[c] |= {"included": [_plain(v) for v in f.included]} if f.included else {}
            out[c] |= {"excluded": [_plain(v) for v in f.excluded]} if f.excluded else {}
        return json.dumps(out)

    @staticmethod
    def from_json(text: str) -> TableFilter:
        bound = lambda b: Bound(b[0], _value(b[1]) if len(b) > 1 else None)
        columns = {}
        for c, f in json.loads(text).items():
            flags = {k: f.get(k, False) for k in ("all", "none", "only_null", "allow_null")}
            columns[c] = Filter(tuple(Range(bound(a), bound(b)) for a, b in f.get("ranges", ())), tuple(map(_value, f.get("included", ()))), tuple(map(_value, f.get("excluded", ()))), **flags)
        return TableFilter(columns)


def _plain(value: Any) -> Any:
    """Dates, timestamps, decimals and bytes as one-entry objects that name their kind."""
    if isinstance(value, dt.datetime):
        return {"timestamp": value.isoformat()}
    if isinstance(value, dt.date):
        return {"date": value.isoformat()}
    if isinstance(value, Decimal):
        return {"decimal": str(value)}
    return {"bytes": value.hex()} if isinstance(value, bytes) else value


def _value(plain: Any) -> Any:
    if not isinstance(plain, dict):
        return plain
    ((kind, v),) = plain.items()
    return {"timestamp": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "decimal": Decimal, "bytes": bytes.fromhex}[kind](v)


def compare(column: Column, op: str, value: Any) -> Column:
    """`=`, `<`, `<=`, `>`, `>=` with a constant; null compares to nothing."""
    return {"=": column == F.lit(value), "<": column < F.lit(value), "<=": column <= F.lit(value), ">": column > F.lit(value), ">=": column >= F.lit(value)}[op]
