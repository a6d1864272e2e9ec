"""Every query against its SQL on the smallest tables."""

import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline", n)]


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, bool) or str(v) in ("True", "False"):
        return str(bool(v))
    try:
        return repr(float(v))
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = entry.oracle_sql().get(name)
    if want:
        assert rows(got) == rows(sql.sql(want).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_orderkey", "revenue", "o_orderdate"]


@pytest.fixture(scope="module")
def far_apart(tmp_path_factory):
    """Orders whose keys differ by what the change log adds to them for `seq`."""
    place = tmp_path_factory.mktemp("far")
    duckdb.sql(f"COPY (SELECT o.* REPLACE (o_orderkey + s AS o_orderkey) FROM '{DATA}/orders.parquet' AS o, (VALUES (0), (1000000), (4000000)) AS t(s) WHERE o_orderkey < 60) TO '{place}/orders.parquet' (FORMAT parquet)")
    return str(place)


@pytest.mark.parametrize("name", ["idx_cache", "mvcc_delete_modes", "mvcc_export_import_chain", "mvcc_memory_gc", "mvcc_snapshot", "scan_buffer", "scan_expose_hidden", "scan_snapshot", "storage_gc_dual_write", "write_buffer_read"])
def test_keys_far_apart(spark, far_apart, name):
    """An update's or a later insert's `seq` may be that of another order's first insert."""
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{far_apart}/orders.parquet'")
    want = rows(c.sql(entry.oracle_sql()[name]).df())
    assert want[1] and rows(entry.queries()[name](spark, far_apart).toPandas()) == want
