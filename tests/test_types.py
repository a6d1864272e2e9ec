import pytest
from pyspark.sql import functions as F

from lamina.types import TypeStringError, conform, parse, schema_of


@pytest.mark.parametrize(("text", "kind"), [("BOOLEAN", "boolean"), ("byte", "tinyint"), ("short", "smallint"), ("Int", "int"), ("long", "bigint"), ("real", "float"), ("decimal(10)", "decimal(10,0)"), ("char", "char(1)"), ("varbinary(7)", "binary"), ("struct<a:int,b:decimal(5,2)>", "struct<a:int,b:decimal(5,2)>"), ("array", "array<double>")])
def test_parse(text, kind):
    assert parse(text).simpleString() == kind


@pytest.mark.parametrize("text", ["", "map<int,int>", "decimal(39,1)", "decimal(5,6)", "timestamp(7)", "time(4)", "vector(5000)", "int(3)", "varchar(0)", "struct<a>", "struct<a:int,a:int>", "varchar(x)"])
def test_bad(text):
    with pytest.raises(TypeStringError):
        parse(text)


def test_schema():
    assert schema_of("a:bigint, b:varchar(3),c:vector(4)").names == ["a", "b", "c"]


def test_conform(spark):
    df = spark.createDataFrame([("abcdef", 1234, [1.0, 2.0])], "s string, ms int, v array<double>")
    r = df.select(conform(F.col("s"), "char(8)"), conform(F.col("s"), "varchar(2)"), conform(F.col("ms"), "time(1)"), conform(F.col("v"), "vector(2)")).first()
    assert list(r) == ["abcdef  ", "ab", 1200, [1.0, 2.0]]
    with pytest.raises(Exception, match="vector of 3"):
        df.select(conform(F.col("v"), "vector(3)")).collect()
