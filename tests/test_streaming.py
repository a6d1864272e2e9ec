"""The real-time layer against plain Python models."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.streaming import index, mvcc
from lamina.streaming.buffer import NotReady, WriteBuffer
from lamina.streaming.cdc import MissingKey, Overtaken, VersionedTable
from lamina.streaming.txn import LeaseExpired, Transactions
from lamina.types import schema_of

SCHEMA = schema_of("k:bigint,v:string")
EVENTS = "op string, ts long, seq long, k long, v string"


class Model:
    """Rows as [key, value, commit, end]; the index points to a key's last row unless that has ended."""

    def __init__(self):
        self.rows = []

    def live(self, k):
        own = [r for r in self.rows if r[0] == k]
        return own[-1] if own and own[-1][3] is None else None

    def apply(self, events):
        phases = {"DELETE": 0, "INSERT": 1, "UPDATE": 2}
        for op, ts, _, k, v in sorted(events, key=lambda e: (e[1], phases[e[0]], e[2])):
            row = self.live(k)
            if op == "UPDATE" and row is None:
                raise KeyError(k)
            if op in ("DELETE", "UPDATE") and row is not None:
                row[3] = ts
            if op != "DELETE":
                self.rows.append([k, v, ts, None])

    def snapshot(self, ts):
        return sorted(((k, v or "") for k, v, c, e in self.rows if c <= ts and (e is None or e > ts)))


def events(rng, model_keys, ts_from, n):
    out, keys = [], set(model_keys)
    for s in range(n):
        ts, k = ts_from + s // 3, rng.randint(0, 6)
        op = rng.choice(["DELETE", "INSERT", "UPDATE"])
        out.append((op, ts, s, k, rng.choice([None, "", "x", f"v{s}"])))
    return out, keys


@pytest.mark.parametrize("seed", range(4))
def test_cdc_against_model(spark, tmp_path, seed):
    rng, model = random.Random(seed), Model()
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    for batch in range(3):
        while True:
            made, _ = events(rng, [], 1 + batch * 10, 9)
            trial = Model()
            trial.rows = [list(r) for r in model.rows]
            try:
                trial.apply(made)
            except KeyError:
                continue
            break
        model = trial
        df = spark.createDataFrame(made, EVENTS)
        t.apply(df, batch)
        if batch == 1:
            t.apply(df, batch)
    for ts in (0, 1, 2, 3, 11, 12, 22, 30):
        assert sorted((r.k, r.v or "") for r in t.snapshot(ts).collect()) == model.snapshot(ts)
    kept = t.collect_garbage(12, str(tmp_path / "g"))
    for ts in (12, 22, 30):
        assert sorted((r.k, r.v or "") for r in kept.snapshot(ts).collect()) == model.snapshot(ts)
    with pytest.raises(mvcc.SnapshotTooOld):
        kept.snapshot(11)


def test_update_of_missing_key_writes_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    t.apply(spark.createDataFrame([("INSERT", 1, 0, 1, "a")], EVENTS), 0)
    with pytest.raises(MissingKey):
        t.apply(spark.createDataFrame([("INSERT", 2, 0, 5, "b"), ("UPDATE", 2, 1, 9, "c")], EVENTS), 1)
    assert t.snapshot(9).count() == 1
    with pytest.raises(MissingKey, match="INSERT"):
        t.apply(spark.createDataFrame([("INSERT", 3, 0, 1, "b")], EVENTS), 1, strict=True)
    with pytest.raises(Exception, match="null"):
        t.apply(spark.createDataFrame([("INSERT", 3, 0, None, "b")], EVENTS), 1)


def test_same_timestamp(spark, tmp_path):
    """Delete, insert and update of one key at one timestamp leave the updated row alone."""
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    t.apply(spark.createDataFrame([("INSERT", 1, 0, 1, "a")], EVENTS), 0)
    t.apply(spark.createDataFrame([("UPDATE", 2, 0, 1, "c"), ("INSERT", 2, 1, 1, "b"), ("DELETE", 2, 2, 1, None), ("DELETE", 2, 3, 77, None)], EVENTS), 1)
    assert [(r.k, r.v) for r in t.snapshot(2).collect()] == [(1, "c")]
    assert [(r.k, r.v) for r in t.snapshot(1).collect()] == [(1, "a")]


@pytest.mark.parametrize("seed", range(3))
def test_index_against_model(spark, seed):
    rng = random.Random(seed)
    log = [(rng.randint(0, 4), rng.randint(1, 12), i, rng.choice(["put", "put", "delete"])) for i in range(40)]
    df = spark.createDataFrame([(k, t, None if o == "delete" else r, o) for k, t, r, o in log], "k long, ts long, row_id long, op string")
    probes = spark.createDataFrame([(k,) for k in range(6)], "k long")
    for ts in (0, 3, 7, 20):
        for k in range(6):
            pass
        got = {r.k: r.row_id for r in index.lookup(df, probes, ["k"], ts).collect()}
        many = {(r.k, r.row_id) for r in index.lookup_all(df, probes, ["k"], ts).collect()}
        want, wide = {}, set()
        for k in range(6):
            puts = [(t, r) for q, t, r, o in log if q == k and o == "put" and t <= ts]
            tomb = max((t for q, t, r, o in log if q == k and o == "delete" and t <= ts), default=None)
            best = max(puts, default=None)
            want[k] = best[1] if best and (tomb is None or tomb < best[0]) else -1
            wide |= {(k, r) for t, r in puts if tomb is None or tomb < t}
        assert got == want and many == wide
    purged = index.purged(df, ["k"], 7)
    for ts in (7, 9, 20):
        assert {tuple(r) for r in index.lookup(purged, probes, ["k"], ts).collect()} == {tuple(r) for r in index.lookup(df, probes, ["k"], ts).collect()}


def test_index_changes(spark):
    empty = spark.createDataFrame([], "k long, ts long, row_id long, op string")
    one = spark.createDataFrame([(1, 5, 10, "put")], empty.schema)
    log, before = index.update(empty, one, ["k"], 4)
    assert [r.row_id for r in before.collect()] == [-1]
    log, before = index.delete(log, spark.createDataFrame([(1,), (2,)], "k long"), ["k"], 5)
    assert {r.k: r.row_id for r in before.collect()} == {1: 10, 2: -1}
    assert log.where("op = 'delete'").count() == 1
    assert index.lookup(log, one, ["k"], 5).first().row_id == -1


def test_transactions():
    now = [0.0]
    t = Transactions(lease_s=10, clock=lambda: now[0])
    a, r, b = t.begin(), t.begin(read_only=True), t.begin()
    assert (a.ts, r.ts, b.ts, t.high_watermark, t.safe_fold) == (1, 0, 3, 1, 0)
    t.commit(b)
    assert t.high_watermark == 1
    t.commit(a)
    assert (t.high_watermark, t.low_watermark, t.safe_fold) == (4, 0, 0)
    t.rollback(r)
    assert t.safe_fold == 3
    c = t.begin()
    now[0] = 11
    with pytest.raises(LeaseExpired):
        t.commit(c)
    d = t.begin()
    now[0] = 30
    assert t.expire() == [d.id]


def test_collection_plan(spark):
    files = [("t1", f"f{k}", 10, k) for k in range(10)] + [("t2", "g", 10, 9), ("t3", "h", 10, 5)]
    df = spark.createDataFrame(files, "group string, file string, rows long, dead long").withColumn("ratio", F.col("dead") / F.col("rows"))
    got = {(r.group, r.file) for r in mvcc.collection_plan(df, files=2, groups=5).collect()}
    assert got == {("t1", "f9"), ("t1", "f8"), ("t2", "g")}


EVENTS = "op string, ts long, seq long, k long, v string, _own string"


def versioned(spark, path):
    return VersionedTable(spark, f"file://{path}", schema_of("k:bigint,v:string,_own:string"), ["k"])


def events(spark, *rows):
    return spark.createDataFrame([(op, ts, i, k, v, "mine") for i, (op, ts, k, v) in enumerate(rows)], EVENTS)


def test_gc_is_known_to_whoever_opens(spark, tmp_path):
    t = versioned(spark, tmp_path / "t")
    t.apply(events(spark, ("INSERT", 1, 1, "a"), ("INSERT", 1, 2, "b")), 0)
    t.apply(events(spark, ("DELETE", 2, 1, None)), 1)
    t.collect_garbage(3, f"file://{tmp_path}/new")
    again = versioned(spark, tmp_path / "new")
    with pytest.raises(mvcc.SnapshotTooOld):
        again.snapshot(1)
    assert [tuple(r) for r in again.snapshot(3).collect()] == [(2, "b", "mine")]


def test_new_source_keeps_old_rows(spark, tmp_path):
    """Batch 0 of another stream is a batch of its own; the same one again does nothing; own columns with an underscore stay."""
    t = versioned(spark, tmp_path / "t")
    assert t.apply(events(spark, ("INSERT", 1, 1, "a"), ("INSERT", 1, 2, "b")), 0, source="one")
    assert t.apply(events(spark, ("DELETE", 2, 1, None)), 1, source="one")
    again = versioned(spark, tmp_path / "t")
    assert again.apply(events(spark, ("INSERT", 3, 3, "c")), 0, source="two")
    assert not again.apply(events(spark, ("INSERT", 3, 3, "c")), 0, source="two")
    assert sorted(tuple(r) for r in again.snapshot(3).collect()) == [(2, "b", "mine"), (3, "c", "mine")]
    assert len(set(r[0] for r in t.rows().select("_row_id").collect())) == 3


def test_failed_commit_changes_nothing(spark, tmp_path, monkeypatch):
    """A writer that dies between its files and the commit, one that was overtaken, and a reader in between."""
    t = versioned(spark, tmp_path / "t")
    t.apply(events(spark, ("INSERT", 1, 1, "a")), 0)
    seen = []

    def die(read, state):
        seen.append([tuple(r) for r in versioned(spark, tmp_path / "t").snapshot(9).collect()])
        raise OSError("died")

    with monkeypatch.context() as m:
        m.setattr(t, "_publish", die)
        with pytest.raises(OSError):
            t.apply(events(spark, ("UPDATE", 2, 1, "b")), 1)
    publish = t._publish

    def late(read, state):
        versioned(spark, tmp_path / "t").apply(events(spark, ("INSERT", 2, 7, "x")), 5)
        publish(read, state)

    with monkeypatch.context() as m:
        m.setattr(t, "_publish", late)
        with pytest.raises(Overtaken):
            t.apply(events(spark, ("UPDATE", 2, 1, "b")), 1)
    assert seen == [[(1, "a", "mine")]]
    assert t.apply(events(spark, ("UPDATE", 2, 1, "b")), 1)
    assert sorted(tuple(r) for r in t.snapshot(2).collect()) == [(1, "b", "mine"), (7, "x", "mine")]


def test_record_batches(spark):
    from lamina.sources.reader import batches

    df = spark.range(0, 103, 1, 4).selectExpr("id", "cast(id as string) as s")
    got = list(batches(df, 10))
    assert [b.num_rows for b in got] == [10] * 10 + [3] and [x for b in got for x in b.column("id").to_pylist()] == list(range(103))
    assert [x for b in batches(df, 50, skip=27) for x in b.column("s").to_pylist()] == [str(k) for k in range(27, 103)]
    assert list(batches(df.limit(0), 5)) == []


def test_write_buffer(spark, tmp_path):
    """Rows are numbered densely across batches, straddle files, and are read once, before and after flushes, by a
    reader who opens the folder anew, and after a batch that failed."""
    schema = schema_of("k:bigint")
    path = str(tmp_path / "b")
    out = WriteBuffer(spark, path, schema, 10)
    with pytest.raises(NotReady):
        out.append(spark.range(1).toDF("k"), 0)
    out.recover()
    begin = 0
    for ts, n in enumerate((7, 0, 8, 25)):
        out.append(spark.range(begin, begin + n, 1, 3).toDF("k"), ts)
        begin += n
        before = sorted(map(tuple, out.read(hidden=True).select("k", "_row_id", "_file", "_offset", "_commit_ts").collect()))
        out.flush()
        again = WriteBuffer(spark, path, schema, 10).recover()
        assert before == sorted(map(tuple, again.read(hidden=True).select("k", "_row_id", "_file", "_offset", "_commit_ts").collect()))
        assert [r[0] for r in before] == list(range(begin)) and sorted(r[1] for r in before) == list(range(begin))
        assert all(r[2] * 10 + r[3] == r[1] for r in before)
    assert out.flush() == 0 and all(r["flushed"] for r in out.files().collect())
    bad = spark.range(3).select(F.when(F.col("id") > 0, F.raise_error(F.lit("x")).cast("long")).alias("k"))
    with pytest.raises(Exception):
        out.append(bad, 9)
    assert out.state == "FAILED" and out.read().count() == begin
    with pytest.raises(NotReady):
        out.flush()
    assert out.recover().state == "READY" and out.read().count() == begin


def test_seq_comes_again_at_other_timestamps(spark, tmp_path):
    """Places count within a timestamp and a phase: a deleted row takes no other with it."""
    t = versioned(spark, tmp_path / "t")
    log = [("INSERT", 1, 0, 1, "a"), ("INSERT", 1, 1, 2, "b"), ("DELETE", 2, 0, 1, None), ("INSERT", 2, 0, 3, "c"), ("UPDATE", 2, 0, 2, "d")]
    assert t.apply(spark.createDataFrame([(*x, "mine") for x in log], EVENTS), 0)
    assert len({r[0] for r in t.rows().select("_row_id").collect()}) == 4
    assert sorted(map(tuple, t.snapshot(1).collect())) == [(1, "a", "mine"), (2, "b", "mine")]
    assert sorted(map(tuple, t.snapshot(2).collect())) == [(2, "d", "mine"), (3, "c", "mine")]
