"""Operators over whole collections, against brute force."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import ann, line_dedup, lm_scoring, near_dedup
from lamina.llm.common import remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# Line dedup.


def brute_lines(rows, words=10):
    """rows: (doc_id, text) in order. All runs of lines, by definition, against all earlier positions."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    seqs = {}
    for r in order:
        lines = (rows[r][1] or "").split("\n")
        seqs[r] = [(k, x, x.strip(" ").count(" ") + 1) for k, x in enumerate(lines) if x.strip(" ")]
    lost = {r: set() for r in seqs}
    for a, r in enumerate(order):
        for i in range(len(seqs[r])):
            for q in order[: a + 1]:
                for j in range(len(seqs[q])):
                    if q == r and j >= i:
                        break
                    n = total = 0
                    while i + n < len(seqs[r]) and j + n < len(seqs[q]) and seqs[r][i + n][1] == seqs[q][j + n][1]:
                        total += seqs[r][i + n][2]
                        n += 1
                    if total >= words:
                        lost[r] |= {seqs[r][i + k][0] for k in range(n)}
    out = []
    for r, (doc, text) in enumerate(rows):
        if not lost[r]:
            out.append((doc, 0, text))
        else:
            out.append((doc, len(lost[r]), "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lost[r])))
    return out


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = [" ".join(rng.choices("abcdefgh", k=n)) for n in (1, 1, 2, 3, 4, 6, 9, 12, 60)] + ["", "  "]
    rows = [(rng.choice([None, *range(12)]), "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for _ in range(40)] + [(3, None), (4, ""), (5, "\n"), (6, "x " * 3000)] + [(7, pool[8])] * 3
    got = line_dedup.deduplicated(frame(spark, rows).coalesce(1).withColumn("_row", F.lit("mine"))).collect()
    assert sorted(map(str, ((r.doc_id, r.lines_lost, r.text) for r in got))) == sorted(map(str, brute_lines(rows)))
    assert {r._row for r in got} == {"mine"}
    assert line_dedup.deduplicated(frame(spark, [])).count() == 0


def test_line_dedup_sql(spark):
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = line_dedup.op1_line_dedup(spark, "/root/testdata/sf0.001").collect()
    want = c.sql(f"SELECT doc_id, lines_lost, text FROM ({line_dedup.SQL}) AS t").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_line_dedup_keeps_short_and_first(spark):
    passage = " ".join(f"w{k}" for k in range(55))
    got = line_dedup.deduplicated(frame(spark, [(1, f"Of.\n{passage}\nend one"), (2, f"Of.\n{passage}\nend two"), (3, "Of.\nown words")])).collect()
    assert {r.doc_id: r.text for r in got} == {1: f"Of.\n{passage}\nend one", 2: "end two", 3: "Of.\nown words"} or {r.doc_id: r.text for r in got}[2] in ("Of.\nend two", "end two")


# Near duplicates.


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    z = []
    for _ in range(60):
        n = int(rng.integers(2, 150))
        keys = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        a = rng.integers(0, 9, n)
        b = np.where(rng.random(n) < 0.7, a, rng.integers(0, 9, n))
        one, two = (keys[a > 0], a[a > 0]), (keys[b > 0], b[b > 0])
        j = near_dedup.similarity(one, two)
        same = (near_dedup.signature(*one, rows=1500) == near_dedup.signature(*two, rows=1500)).mean()
        if 0 < j < 1:
            z.append((same - j) / math.sqrt(j * (1 - j) / 1500))
    assert abs(np.mean(z)) < 4 / math.sqrt(len(z)) and np.std(z) < 1.4


def brute_classes(rows):
    def shingles(t):
        w = (t or "").encode().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets, words = [shingles(t) for _, t in rows], [tuple((t or "").encode().split()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            union = sum(sets[i].values()) + sum(sets[j].values()) - both
            if words[i] == words[j] or union and both / union >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for group in range(8):
        base = rng.choices(vocabulary, k=rng.choice([2, 4, 7, 30, 120]))
        for _ in range(rng.choice([1, 3, 12])):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(6)}"
            rows.append((rng.choice([None, rng.randrange(500)]), " ".join(own)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a"), (904, " a "), (905, "a " * 50), (906, "a " * 52), rows[0], rows[0], (907, " ".join(rng.choices(vocabulary, k=30_000)))]
    docs = frame(spark, rows).coalesce(1).withColumn("node", F.lit(1)).withColumn("_row", F.monotonically_increasing_id())
    got = near_dedup.classes(docs).orderBy("_row").collect()
    assert [r.class_id for r in got] == brute_classes(rows)
    kept = near_dedup.deduplicated(frame(spark, rows).coalesce(1).withColumn("_row", F.lit("mine"))).collect()
    want = brute_classes([(i, t) for i, (_, t) in enumerate(rows)])
    assert len(kept) == len(set(want)) and {r._row for r in kept} == {"mine"}


def test_near_dedup_many_copies(spark):
    """Many copies of one text, each with edits of its own: classes are whole, though most are far from each other."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        own = list(base)
        for k in range(i % 7):
            own[rng.randrange(100)] = f"u{i}x{k}"
        rows.append((i, " ".join(own)))
    got = near_dedup.classes(frame(spark, rows).coalesce(1).withColumn("_row", F.monotonically_increasing_id())).orderBy("_row").collect()
    assert [r.class_id for r in got] == brute_classes(rows)


def test_near_dedup_different_homes(spark, monkeypatch):
    """Many copies of one text, whose edits are others' too and whose homes differ: all links, and few pairs for them."""
    rng = random.Random(4)
    texts = []
    for i in range(150):
        own = [f"b{k}" for k in range(120)]
        for k in rng.sample(range(120), 1 if i < 30 else 10):
            own[k] = f"z{k}x{rng.randrange(2)}"
        texts.append(" ".join(own))
    sets = [Counter(tuple(t.split()[k : k + 5]) for k in range(116)) for t in texts]
    overlap = {(i, j): sum((sets[i] & sets[j]).values()) for j in range(150) for i in range(j)}
    nodes = spark.createDataFrame([(i, i, None if i % 3 else i, True) for i in range(150)], "node long, label long, home long, stray boolean")
    similar, tried = near_dedup._similar, []

    def counted(pairs, *more):
        tried.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(near_dedup, "_similar", counted)
    got = near_dedup._rest(nodes, spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()
    want = {p for p, both in overlap.items() if both / (232 - both) >= 0.8}
    assert len(want) > 50 and sum(tried) < 800  # 1,246 if places do not count
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_near_dedup_empty(spark):
    assert near_dedup.deduplicated(frame(spark, [])).count() == 0
    assert near_dedup.deduplicated(frame(spark, [(1, None)])).count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (101, 103), (102, 101)]
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 103: 100}


# Language model.


def brute_scores(rows, held, mu=lm_scoring.MU):
    tokens = [[*(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split(), "<end>"] for _, t in rows]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    c = Counter()
    for t in train:
        line = ["<end>", *t]
        for k in range(1, len(line)):
            for n in (1, 2, 3):
                if k - n + 1 >= 0:
                    c[tuple(line[k - n + 1 : k + 1])] += 1
    n, v = sum(k for g, k in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    once = sum(1 for g, k in c.items() if len(g) == 1 and k == 1 and g != ("<end>",))
    unseen = (once + 0.5) / (n + 1)
    out = []
    for t in tokens:
        score, line = 0.0, ["<end>", *t]
        for k in range(1, len(line)):
            w, state = line[k], tuple(line[max(0, k - 2) : k])
            while state and not c[*state, w]:
                score += math.log10(mu[len(state) + 1] / (c[state] + mu[len(state) + 1]))
                state = state[1:]
            p = (1 - unseen) * c[w,] / n if c[w,] else unseen
            for h in (state[1:], state) if len(state) == 2 else (state,) if state else ():
                p = (c[*h, w] + mu[len(h) + 1] * p) / (c[h] + mu[len(h) + 1])
            score += math.log10(p)
        base = sum(math.log10((c[w,] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((len(t), sum(c[w,] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("block", [200, 4 << 20])
def test_lm(spark, block, monkeypatch):
    for name, value in (("SHARD", block), ("TASK", 16 * block)):
        monkeypatch.setattr(lm_scoring, name, value)
    rng = random.Random(2)
    vocabulary = [f"W{k}" for k in range(12)] + [f"r{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[20] * 12 + [1] * 60, k=rng.choice([0, 1, 20, 200])))) for i in range(60)] + [(None, None), (60, None), (61, ""), (5, "W1 W2"), (5, "W1 W2"), (62, "never\x0bseen \u00c4"), (63, "W1 " * 20000), (64, "x" * 50000)]
    docs = frame(spark, rows).coalesce(2).withColumn("block", F.lit("clash"))
    order = [(r.doc_id, r.text) for r in docs.collect()]
    held = [zlib.crc32(str(d).encode()) % 5 == 1 if d is not None else False for d, _ in order]
    got = sorted(map(tuple, lm_scoring.scored(docs, remainder(F.col("doc_id"), 5) == 1, block).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    want = sorted(((d, h, *s) for (d, _), h, s in zip(order, held, brute_scores(order, held), strict=True)), key=lambda r: (str(r[0]), r[2], r[5]))
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)
    assert sum(r[6] for r in got) > sum(r[5] for r in got)


def test_lm_learns_rare_pairs(spark):
    """Words seen seven times or once have arcs of their own: a pair seen scores above one of as frequent words that isn't."""
    train = [(i * 5, "ann bell dove said so") for i in range(7)] + [(50, "eve fox"), (51, "gil")]
    test = [(100, "ann bell"), (101, "ann dove"), (102, "eve fox"), (103, "eve gil")]
    docs = frame(spark, train + test)
    got = {r.doc_id: r.score for r in lm_scoring.scored(docs, F.col("doc_id") >= 100).collect()}
    assert got[100] > got[101] + 0.1 and got[102] > got[103]


def test_lm_edges(spark):
    all_held = F.lit(True)
    got = lm_scoring.scored(frame(spark, [(1, "a b"), (2, None)]), all_held).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got) and len(got) == 2
    assert lm_scoring.scored(frame(spark, []), all_held).count() == 0


def test_lm_probabilities_sum_to_one():
    """From every state: over all words, END, and words not seen as one."""
    texts = ["a b a c", "b", "a b a b d", "", "c c"]
    train = lm_scoring.Block.of(pa.array(texts), np.zeros(len(texts), bool))
    figures = [float(len(train.codes)), float(len(train.hashes)), 1.0, float(len(train.codes))]
    words = ["a", "b", "c", "d", "unseen"]
    for history in ("", "a", "b", "d", "a b", "b a", "c c", "unseen", "unseen a", "b unseen"):
        probes = [f"{history} {w}" for w in words] + [history]
        block = lm_scoring.Block.of(pa.array(texts + probes), np.array([False] * len(texts) + [True] * len(probes)))
        counts = {}
        for order in (1, 2, 3):
            hashes, place = block.grams(order)
            each = np.bincount(place[block.training], minlength=len(hashes) + 1)
            each[-1] = 0
            counts[order] = each[place]
        automaton = lm_scoring.Automaton(figures)
        automaton.ends = float(len(texts))
        score, n = automaton.traverse(block, counts), len(history.split())
        total = sum(10 ** score[block.starts[len(texts) + k] + n] for k in range(len(probes)))
        assert total == pytest.approx(1)


# Nearest neighbours.


def brute_nearest(vectors, k=20):
    out = {}
    for q, x in vectors.items():
        if q % 20 == 0:
            scored = sorted(((-float(np.dot(np.float64(x), np.float64(y))), i) for i, y in vectors.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def recall(got, ids, v, k=20):
    """Mean and least share of the true nearest that each query found, by scores: ties count as found."""
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.score)
    place = {int(i): n for n, i in enumerate(ids)}
    out = []
    for q, scores in found.items():
        p = v @ v[place[q]]
        p[place[q]] = -np.inf
        out.append(sum(s >= np.sort(p)[-k] - 1e-9 for s in scores) / k)
    return np.mean(out), min(out)


@pytest.mark.parametrize("norms", ["unit", "uneven"])
def test_ann_recall(spark, norms):
    """50,000 rows in clusters, with more leaves than are visited at first; queries are held out of nothing."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 24))
    v = centres[rng.integers(0, 300, 50_000)] + 0.6 * rng.normal(size=(50_000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if norms == "uneven":
        v *= rng.lognormal(0, 0.5, (50_000, 1))
    v = v.astype(np.float32).astype(np.float64)
    table = pa.table({"vec_id": pa.array(np.arange(50_000)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 24).cast(pa.list_(pa.float64()))})
    got = ann.nearest(spark.createDataFrame(table), F.col("vec_id") % 100 == 0).collect()
    mean, least = recall(got, np.arange(50_000), v)
    print(f"recall of {norms} vectors: {mean:.4f}, at least {least:.2f} for each query")
    assert len(got) == 500 * 20 and mean >= 0.93 and least > 0.3


def test_ann_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0, least=1000).collect()
    want = brute_nearest({r.vec_id: r.embedding for r in vectors.collect()})
    hits = sum(any(i == r.vec_id for i, _ in want[r.query_id]) for r in got)
    assert hits / sum(map(len, want.values())) >= 0.95
    assert Counter(r.query_id for r in got) == {q: 20 for q in want}


def test_ann_every_row_takes_part(spark):
    """Rows of other lengths and with a repeated vec_id are candidates; exact repetitions count once."""
    rows = [(20, [1.0, 0.0]), (1, [5.0]), (2, [4.0, 9.0, 9.0]), (3, [3.0, 1.0]), (3, [2.0, 1.0]), (3, [3.0, 1.0]), (20, [0.5, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    by = Counter((r.query_id, r.vec_id, r.score) for r in got)
    assert by == Counter({(20, 1, 5.0): 1, (20, 2, 4.0): 1, (20, 3, 3.0): 1, (20, 3, 2.0): 1, (20, 1, 2.5): 1, (20, 2, 2.0): 1, (20, 3, 1.5): 1, (20, 3, 1.0): 1})


def test_ann_exact_and_odd(spark):
    """Few vectors: all leaves are visited. Unusable ones and ties."""
    rng = np.random.default_rng(1)
    good = {i: rng.normal(size=4).astype(np.float32).tolist() for i in range(50)} | {i: [1.0, 2.0, 0.0, -1.0] for i in range(100, 140)}
    good |= {320: [1.0] * 3}
    bad = [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 1.0, 1.0]), (280, [float("nan")] * 4), (300, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows = spark.createDataFrame([(i, v, "x") for i, v in [*good.items(), *bad, (100, [1.0, 2.0, 0.0, -1.0])]], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(good | {320: [1.0, 1.0, 1.0, 0.0]})
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    assert ann.nearest(rows.limit(0), F.lit(True)).count() == 0
    few = ann.nearest(rows.where("vec_id in (20, 21, 22)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.rank, r.query_id) for r in sorted(few, key=lambda r: r.rank)] == [(1, 20), (2, 20)]


# The pipeline.


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = dict(docs.dtypes)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf).cache()
        assert dict(out.dtypes) == kinds
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and (k != 2 or now == ids)
        docs, ids = out, now
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == ids
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in ids for i in clean) / len(clean) > 0.75


def test_pipeline_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_pipeline_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and columns with clashing names pass all stages."""
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(120_000))
    texts = [None, "", " ", "\n\n\t", "plain words of no interest to anyone at all", long, long, "line one has more than ten words in it so that it is a window\n" * 3]
    rows = [(k, x, "en", "s", len(x or "")) for k, x in enumerate(texts)] + [(None, "a null id", None, None, None), (None, None, None, None, None), (4, texts[4], "en", "s", 44), (4, texts[4], "en", "s", 44)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_row", F.lit("clash")).withColumn("_p", F.lit("x")).withColumn("class_id", F.lit(1)).withColumn("kept", F.lit(False))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns
    left = docs.collect()
    got = {}
    for r in left:
        got.setdefault(r.doc_id, []).append(r.text)
    assert 0 not in got or got[0] == [None]
    assert sum(len(x) for x in got.values()) == len(left) <= len(rows)
    assert len(got.get(4, [])) <= 1 and len(got.get(5, []) + got.get(6, [])) <= 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in pieces} == set(got)
