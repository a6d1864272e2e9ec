"""Row-by-row operators: tokens, rules, toxicity, urls, packing; and what all do with odd rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import bpe, hashed, packing, quality_rules, site_quality, toxicity, url_filters
from lamina.llm.common import Words, label_share, labelled, remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n \t", "a", "word " * 30, "x" * 5000, "äöü ßé, naïve. Œuvre", "a\u00a0b\u2003c", "don't it's 12,34 #!? <|endoftext|>", "  two  spaces\n\n\nlines ", "e\u0301 combining", "日本語 text\x1fsep", "🙂🙂 ok", "tab\tand\x0bvt\x0cff", "İSTANBUL ΣΑΣ ǅ", "\u0345\u0301"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD)] + [(None, "null id", None, None, None), (3, "\n\n \t", "en", "s", 5), (7, "äöü ßé, naïve. Œuvre", "xx", None, 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("_row", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("_p", F.lit("x"))


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


def test_words():
    w = Words(pa.array([" a  b\u00a0c\x0b", None, "", "a"]))
    assert w.counts.tolist() == [2, 0, 0, 1] and w.vocabulary.to_pylist() == ["a", "b\u00a0c"] and w.codes.tolist() == [0, 1, 0]


def test_bpe(odd, none):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    plain = bpe.Codec(ranks).encoding
    got = bpe.digests(odd, ranks).collect()
    assert len(got) == odd.count() and bpe.digests(none, ranks).count() == 0
    texts = [r.text for r in odd.collect()]
    for r, t in zip(got, texts, strict=True):
        ids = plain.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    pairs = bpe.decoded(bpe.encoded(odd, ranks, keep=("doc_id", "text")), ranks, keep=("doc_id", "text")).collect()
    assert all(r.bytes == bytearray((r.text or "").encode()) for r in pairs)


def test_bpe_pieces():
    rng = random.Random(3)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "'s", "1", ".", "\u00a0", "!", "日"]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        plain = bpe.Codec(f.read()).encoding
    for _ in range(300):
        t = "".join(rng.choices(alphabet, k=rng.randint(1, 80)))
        parts = list(bpe.pieces(t, 5))
        assert "".join(parts) == t
        assert [i for p in parts for i in plain.encode_ordinary(p)] == plain.encode_ordinary(t)


def test_bpe_long_blanks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read())
    rng = random.Random(4)
    units = ["ab", " ", "\n", "\u3000", "\x1c", "\x85", "1", "!", "\u00e9 ", " " * 4097, "\n" * 4096, "\t \n" * 1500, "word, " * 20000]
    for _ in range(150):
        t = "".join(rng.choices(units, k=rng.randint(1, 6)))
        assert codec.encode(t).tolist() == codec.encoding.encode_ordinary(t)
    # Beyond what the library takes at once: a run before something visible gives its last character away.
    for blank in (" ", "\n", " \n\t"):
        run = blank * (2_000_000 // len(blank))
        ids = codec.encode(f"a{run}b")
        alone = [i for part in ("a", run[:-1], run[-1] + "b") for i in (codec.whole if len(part) > 9 else codec.encoding).encode_ordinary(part)]
        assert ids.tolist() == alone and codec.decode(ids) == f"a{run}b".encode()
        assert codec.decode(codec.encode(run)) == run.encode()


def whole_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    spec = packing.tokenizer_spec()
    tokenizer = Tokenizer.from_str(spec)
    rng = random.Random(5)
    rows = [(100 + i, " ".join(rng.choices(["alpha", "Beta,", "gamma.", "ünder", "x1y"], k=rng.choice([0, 3, 50, 400, 3000]))), "en", "s", 0) for i in range(60)]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(rows, DOCS)).repartition(3).cache()
    for size in (4096, 64):
        got = packing.packed(docs, spec, size, windows=4).collect()
        by, want = {}, {}
        for r in docs.collect():
            ids = whole_ids(tokenizer, r.text)
            want.setdefault(r.doc_id, []).append(ids)
        for r in sorted(got, key=lambda r: (str(r.doc_id), r.start)):
            by.setdefault(r.doc_id, []).append(r)
        assert sum(r.length for r in got) == sum(len(x) for v in want.values() for x in v)
        for doc, ids in want.items():
            if len(ids) == 1:
                at = 0
                for r in by[doc]:
                    assert r.start == at and r.doc_tokens == len(ids[0])
                    assert r.ids_crc32 == zlib.crc32(np.array(ids[0][at : at + r.length], "<u4").tobytes())
                    at += r.length
                assert at == len(ids[0])
        sequences = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == sequences.get(r.sequence_id, 0)
            sequences[r.sequence_id] = r.offset + r.length
        assert all(n == size or n & (n - 1) == 0 for n in sequences.values()) and max(sequences.values()) <= size
    assert packing.packed(none, spec).count() == 0


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_packing_short_sequences(spark, partitions):
    """However many partitions there are, the rest of one group is all that is cut into powers of two."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta,", "gamma."], k=rng.randint(1, 300)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = packing.packed(docs, packing.tokenizer_spec(), 256, windows=4, together=4).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    short = [n for n in sizes if n < 256]
    assert len(short) <= 8 and all(n & (n - 1) == 0 for n in sizes)
    ids = {}
    for r in got:
        ids.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for parts in ids.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total


def test_packing_other_rules(spark):
    """A tokenizer with other rules encodes whole texts."""
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    tokens, texts = packing.Tokens(spec), ["a b  c\n d", None, "", "\u00e9 " * 3000]
    assert not tokens.by_words
    ids, starts = tokens.batch(pa.array(texts), 2)
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == [*Tokenizer.from_str(spec).encode(t or "", add_special_tokens=False).ids, 2]


def test_words_table_is_bounded():
    tokens = packing.Tokens(packing.tokenizer_spec(), kept=50)
    for k in range(30):
        texts = [" ".join(f"word{j}" for j in range(k, k + 30)), "word1 word2"]
        ids, starts = tokens.batch(pa.array(texts), 2)
        assert len(tokens.words) <= 50
        assert ids[: starts[1]].tolist() == whole_ids(tokens.tokenizer, texts[0])


def test_best_fit():
    p = packing.Packer(8, windows=2)
    for doc, n in enumerate((5, 3, 6, 2, 7)):
        p.add(doc, np.zeros(n, np.uint32))
    p.finish()
    sequences = {}
    for doc, start, n, _, _, s, at in p.rows:
        sequences.setdefault(s, []).append((doc, start, n))
    assert sorted(map(sorted, sequences.values())) == [[(0, 0, 5), (1, 0, 3)], [(2, 0, 6), (3, 0, 2)], [(4, 0, 4)], [(4, 4, 2)], [(4, 6, 1)]]


def brute_counts(text):
    t = text or ""
    words = t.encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(cover)


def test_quality_counts(spark, odd, none):
    rng = random.Random(8)
    more = [" ".join(rng.choices("abc", k=n)) + "\n#|" * (n % 3) for n in range(40)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(500 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    model = hashed.fit([])
    got, texts = quality_rules.judged(docs, model).collect(), [r.text for r in docs.collect()]
    for r, t in zip(got, texts, strict=True):
        want = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality_rules.judged(none, model).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(remainder(F.col("doc_id"), 2) == 0)
    out = quality_rules.judged(docs, hashed.fit(labelled(docs, known, "quality", 300), prior=0.8))
    held = out.join(labels.where(remainder(F.col("doc_id"), 2) == 1).withColumnRenamed("quality", "y"), "doc_id").where("not base_failed").select("y", "kept").collect()
    assert sum(r.kept == (r.y == 1) for r in held) / len(held) > 0.97


def test_quality_prior_is_the_labels_share(spark, tmp_path):
    """Texts that say nothing are as good as labelled documents are: a fifth here, under the threshold."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.sample(range(500), 60)), "s", "en") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(rng.random() < 0.2)) for i in range(200)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    fresh = lambda df, c: [r[c] for r in df.where("doc_id >= 200").collect()]
    for df, column in ((quality_rules.op7_quality_rules(spark, str(tmp_path)), "quality"), (site_quality.op9_site_quality(spark, str(tmp_path)), "evidence")):
        p = fresh(df, column)
        assert len(p) == 100 and np.mean(p) == pytest.approx(0.2, abs=0.1) and np.mean(fresh(df, "kept")) < 0.2


def test_labels_at_odds(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (None, 1), (2, None), (9, 1)], "doc_id long, quality int")
    assert labelled(docs, labels, "quality", 10) == [("b", 1), ("", 0)]
    assert labelled(docs, labels.limit(0), "quality", 10) == []


def brute_segments(scores, drift):
    """All maximal scoring segments by their recursive definition."""
    s = [x - drift for x in scores]
    best, most = None, 1e-12
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            total = sum(s[i:j])
            if total > most + 1e-12 or best and abs(total - most) <= 1e-12 and j - i < best[1] - best[0]:
                best, most = (i, j), total
    if not best:
        return []
    i, j = best
    return brute_segments(scores[:i], drift) + [best] + [(a + j, b + j) for a, b in brute_segments(scores[j:], drift)]


def test_segments():
    rng = random.Random(4)
    for _ in range(200):
        scores = [rng.choice([0.0, 0.0, 1.13, 2.71, -0.37]) * rng.uniform(0.5, 1.5) for _ in range(rng.randint(0, 14))]
        assert [(b, e) for b, e, _ in toxicity.segments(np.array(scores), 0.4)] == brute_segments(scores, 0.4)


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    eligible = remainder(F.col("doc_id"), 5) != 0
    model = toxicity.fit(labelled(docs, labels, "toxic", 400, eligible), label_share(labels, "toxic", eligible))
    out = toxicity.scored(docs.where(remainder(F.col("doc_id"), 5) == 0), model).join(labels, "doc_id").where("toxic is not null").select("toxic", "score").collect()
    wrong = sum((r.score >= 0.5) != (r.toxic == 1) for r in out)
    assert wrong / len(out) < 0.05
    assert sum(r.score >= 0.5 for r in out if not r.toxic) / len(out) < 0.02
    got = toxicity.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.scored(none, model).count() == 0
    assert odd.where(~toxicity.rejected(model)).count() == odd.count()
    assert all(r.score < 1e-6 for r in toxicity.scored(odd, toxicity.fit([])).collect())


def test_site_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = site_quality.document_model(docs, labels)
    got = site_quality.judged(docs, model)
    assert got.count() == docs.count()
    right = got.join(labels, "doc_id").select("quality", "kept").collect()
    assert sum(r.kept == (r.quality == 1) for r in right) / len(right) > 0.95
    kept = site_quality.kept(docs, model)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert site_quality.judged(odd, model).count() == odd.count()
    assert site_quality.kept(odd, hashed.fit([])).columns == odd.columns
    assert site_quality.judged(none, model).count() == 0 and site_quality.kept(none, model).count() == 0


def test_site_shrinkage(spark):
    """Sparse sites stay near the global share; a site with many poor documents pulls its doubtful ones down."""
    rows = [("bad", "p", 0.05)] * 200 + [("bad", "p", 0.55)] + [("good", "p", 0.95)] * 200 + [("rare", "p", 0.55)]
    scores = spark.createDataFrame(rows, "_host string, _path string, _p double")
    known = site_quality.sites(scores)
    joined = scores.join(known.table.withColumnRenamed("_host", "_h").withColumnRenamed("_path", "_t"), F.col("_host") == F.col("_h")).where("_p = 0.55").select("_host", known.posterior(F.col("_p")).alias("q"))
    got = {r._host: r.q for r in joined.collect()}
    assert got["bad"] < 0.2 and 0.4 < got["rare"] < 0.7


def brute_posteriors(rows):
    """(host, path, p) of every document to its posterior, document by document: the share of good ones among the
    path's others, shrunk toward its host and that toward all, by beta priors of the method of moments."""

    def strength(groups):
        """groups: (probabilities, prior)."""
        n, k = sum(len(g) for g, _ in groups), len(groups)
        within = sum(max(0.0, sum(x * x for x in g) - sum(g) ** 2 / len(g)) for g, _ in groups) / max(1, n - k)
        between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in groups) - within * k
        return min(1e4, max(2.0, sum(len(g) * m * (1 - m) for g, m in groups) / max(1, n) / max(1e-6, between / max(1, n)) - 1))

    hosts, paths = {}, {}
    for h, t, p in rows:
        hosts.setdefault(h or "", []).append(p)
        paths.setdefault((h or "", t or ""), []).append(p)
    mean = min(max(sum(p for *_, p in rows) / len(rows), 1e-4), 1 - 1e-4)
    strong = strength([(g, mean) for g in hosts.values()])
    prior = {h: (sum(g) + strong * mean) / (len(g) + strong) for h, g in hosts.items()}
    narrow = strength([(g, prior[h]) for (h, _), g in paths.items()])
    out = []
    for h, t, p in rows:
        own = paths[h or "", t or ""]
        site = min(1 - 1e-4, max(1e-4, (sum(own) - p + narrow * prior[h or ""]) / (len(own) - 1 + narrow)))
        odds = max(1e-9, p) / max(1e-9, 1 - p) * site / (1 - site) * (1 - mean) / mean
        out.append(odds / (1 + odds))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_site_quality_against_brute_force(spark, odd, seed):
    """Every posterior and verdict, with null and sparse sites, equal rows and a site that holds a third."""
    r, docs = random.Random(seed), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = site_quality.document_model(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = [x.text for x in docs.select("text").limit(60).collect()]
    rows = [(i, r.choice([*texts, None, "", "word " * 3000]), r.choice(["en", None, "", "de"]), r.choice(["hot", *(f"s{k}" for k in range(8)), None]) if i % 3 else "hot", 0) for i in range(240)]
    own = spark.createDataFrame(rows + rows[:5], DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    got = site_quality.judged(own, model).collect()
    want = brute_posteriors([(x.host, x.path, x.evidence) for x in got])
    assert len(got) == own.count() and np.allclose([x.posterior for x in got], want, rtol=1e-7, atol=1e-9)
    assert [x.kept for x in got] == [x.posterior >= site_quality.THRESHOLD for x in got]
    assert sorted(map(str, (x.doc_id for x in got if x.kept))) == sorted(str(x.doc_id) for x in site_quality.kept(own, model).collect())


def brute_url(url, rules, default="allow"):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].translate(lower), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_urls(spark):
    rng = random.Random(6)
    urls = [None, "", "nothing", "http://", "://", "http://a.com", "http://A.B.example.COM/en/x?y#z", "http://x.net?/es/", "http://example.com#/en/", "a://b://c/d", "http://example.com/en", "http://.com/", "http://com./", "http://www.example.com/en/" + "a/" * 500, "http://" + "a." * 200 + "net/es/x", "HTTP://ÄÖ.NET/fr/"]
    urls += [f"http://{'.'.join(rng.choices(['www', 'example', 'com', 'net', 'm'], k=rng.randint(1, 4)))}/{'/'.join(rng.choices(['en', 'es', 'fr', 'x'], k=rng.randint(0, 3)))}" for _ in range(150)]
    pages = spark.createDataFrame([(i % 20, u, "h") for i, u in enumerate(urls + urls[:5])], "page_id long, url string, host string")
    more = [*url_filters.RULES, ("example.com", "/e", "block"), ("com", "/en", "allow"), ("net", "/", "block"), ("net", "/", "allow"), ("m", "", "block"), (None, "/", "block")]
    for rules in (list(url_filters.RULES), more):
        got = url_filters.filtered(pages, url_filters.rules_table(spark, rules)).collect()
        want = [(i % 20, *brute_url(u, [r for r in rules if r[0] is not None])) for i, u in enumerate(urls + urls[:5])]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert url_filters.filtered(pages.limit(0), url_filters.rules_table(spark)).count() == 0
    empty = url_filters.rules_table(spark).limit(0)
    assert {r.verdict for r in url_filters.filtered(pages, empty, default="block").collect()} == {"block"}


def test_url_sql(spark):
    c = duckdb.connect()
    c.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    got = url_filters.op2_url_filters(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, c.sql(url_filters.SQL).fetchall()))
