"""Type strings, as they stand in table declarations, and Spark's types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the types; all of a line mean the same (fixed values).
NAMES = (
    ("boolean",),
    ("tinyint", "byte"),
    ("smallint", "short"),
    ("integer", "int"),
    ("bigint", "long"),
    ("float", "real"),
    ("double",),
    ("decimal",),
    ("string",),
    ("varchar",),
    ("char",),
    ("binary",),
    ("varbinary",),
    ("date",),
    ("time",),
    ("timestamp",),
    ("struct",),
    ("vector", "array"),
)
_FIRST = {n: names[0] for names in NAMES for n in names}

MAX_PRECISION, MAX_SCALE = 38, 38
MAX_DIMENSION = 4096
#: The column that holds a row's commit timestamp; not part of the schema that users see.
COMMIT_TS = "_commit_ts"


class TypeStringError(ValueError):
    """A type string that can't be read."""


def _split(text: str) -> list[str]:
    """At commas outside of parentheses and angle brackets."""
    parts, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "(<") - (c in ")>")
        if c == "," and not depth:
            parts.append(text[at:k])
            at = k + 1
    return [*parts, text[at:]] if text.strip() else []


def _numbers(args: str | None, name: str, least: int, most: int, default: tuple[int, ...]) -> tuple[int, ...]:
    if args is None:
        return default
    found = tuple(int(x) for x in args.split(",") if re.fullmatch(r"\s*\d+\s*", x))
    if not least <= len(found) <= most or len(found) != len(args.split(",")):
        raise TypeStringError(f"bad arguments for {name}: ({args})")
    return found + default[len(found) :]


def parse(text: str) -> T.DataType:
    """`decimal(15,2)`, `varchar(25)`, `vector(64)`, `struct<a:int,b:string>`... Case doesn't matter."""
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(?:\((.*)\)|<(.*)>)?\s*", text, re.S)
    name = m and _FIRST.get(m[1].lower())
    if not name:
        raise TypeStringError(f"no such type: {text!r}")
    args, inner = m[2], m[3]
    if (inner is not None) != (name == "struct") or args is not None and name in ("boolean", "tinyint", "smallint", "integer", "bigint", "float", "double", "string", "date", "struct"):
        raise TypeStringError(f"bad arguments: {text!r}")
    if name == "struct":
        return schema_of(inner)
    if name == "decimal":
        p, s = _numbers(args, name, 1, 2, (MAX_PRECISION, 0))
        if not 0 < p <= MAX_PRECISION or not 0 <= s <= min(p, MAX_SCALE):
            raise TypeStringError(f"bad precision or scale: {text!r}")
        return T.DecimalType(p, s)
    if name in ("time", "timestamp"):
        (p,) = _numbers(args, name, 1, 1, (3,))
        if p > (3 if name == "time" else 6):
            raise TypeStringError(f"bad precision: {text!r}")
        return T.IntegerType() if name == "time" else T.TimestampNTZType()
    if name == "vector":
        (d,) = _numbers(args, name, 1, 1, (2,))
        if not 0 < d <= MAX_DIMENSION:
            raise TypeStringError(f"bad dimension: {text!r}")
        return T.ArrayType(T.DoubleType())
    if name in ("varchar", "char", "binary", "varbinary"):
        (n,) = _numbers(args, name, 1, 1, (1 if name == "char" else 65535,))
        if n < 1:
            raise TypeStringError(f"bad length: {text!r}")
        return {"varchar": T.VarcharType(n), "char": T.CharType(n)}.get(name, T.BinaryType())
    simple = {"boolean": T.BooleanType, "tinyint": T.ByteType, "smallint": T.ShortType, "integer": T.IntegerType, "bigint": T.LongType, "float": T.FloatType, "double": T.DoubleType, "string": T.StringType, "date": T.DateType}
    return simple[name]()


def schema_of(text: str) -> T.StructType:
    """`name:type,...`, or what stands inside of `struct<...>`."""
    text = text.strip()
    if text.lower().startswith("struct<") and text.endswith(">"):
        text = text[7:-1]
    fields = []
    for part in _split(text):
        name, colon, kind = part.partition(":")
        if not colon or not name.strip():
            raise TypeStringError(f"a field needs a name and a type: {part!r}")
        fields.append(T.StructField(name.strip(), parse(kind)))
    if len({f.name for f in fields}) < len(fields):
        raise TypeStringError("field names are repeated")
    return T.StructType(fields)


def conform(column: Column, text: str) -> Column:
    """`column` as a value of the type: cast, cut to precision, padded, checked for its dimension."""
    name = _FIRST[re.match(r"\s*([A-Za-z]+)", text)[1].lower()]
    kind = parse(text)
    args = re.search(r"\((.*)\)", text)
    if name == "time":
        unit = 10 ** (3 - int(args[1] if args else 3))
        return (F.floor(column.cast("int") / unit) * unit).cast("int")
    if name == "timestamp":
        unit = 10 ** (6 - int(args[1] if args else 3))
        micros = F.unix_micros(column.cast("timestamp"))
        return F.timestamp_micros(micros - F.pmod(micros, F.lit(unit))).cast("timestamp_ntz")
    if name == "vector":
        size = int(args[1]) if args else 2
        cast = column.cast("array<double>")
        return F.when(column.isNull() | (F.size(cast) == size), cast).otherwise(F.raise_error(F.lit(f"a vector of {size} is expected")).cast("array<double>"))
    if name == "char":
        return F.rpad(column.cast("string"), kind.length, " ")
    if name == "varchar":
        return F.substring(column.cast("string"), 1, kind.length)
    return column.cast(kind)
