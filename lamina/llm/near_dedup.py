"""MinHash near-dedup: BagMinHash signatures, banding, verified multiset overlap, classes of linked documents."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, Words, apart, in_arrow, mix, numbered, read, slices, stored, tidy

#: Words in a shingle, and the weighted Jaccard similarity from which on two documents are linked.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands, and signature rows in each: a pair of similarity 0.8 meets in some band but for one time in 40,000.
BANDS, ROWS = 20, 4
#: Signatures that agree in fewer of the 80 rows than this are not verified: a pair of similarity 0.8 falls below it
#: about one time in 100,000.
AGREE = 48
#: Similarity to a pivot from which on it can be a node's home.
NEAR = 0.5


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a sequence of word hashes, and how often each occurs. A text of fewer words than a
    shingle has one, all its words; a text without words has none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(SHINGLE, n)
    h = mix(words[: n - k + 1] + np.uint64(k))
    for j in range(1, k):
        h = mix(h * np.uint64(3) ^ words[j : n - k + 1 + j])
    h.sort()
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[new], np.diff(np.append(new, n - k + 1))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signature(keys: np.ndarray, weights: np.ndarray, rows: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash of a weighted set with whole weights: for two such sets, each entry is equal with a chance of their
    weighted Jaccard similarity. Each key has a Poisson process of points (time, weight, entry) of unit rate per entry,
    time and weight. The weight axis is cut into levels [0,1), [1,2), [2,4), [4,8)...; each is a process of its own,
    drawn from the key and the level alone, and needed only if the key's weight reaches into it. An entry is the least
    time of its points below their key's weight. Points are drawn in order of time, only until none can count."""
    k, level, most = keys, np.zeros(len(keys), np.int64), weights.astype(np.float64)
    if len(keys) and weights.max() > 1:
        depth = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1
        k, most = np.repeat(keys, depth), np.repeat(most, depth)
        level = np.arange(int(depth.sum())) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    best = np.full(rows, np.inf)
    seed = mix(k ^ mix(level.astype(np.uint64) * GOLDEN))
    time, drawn = np.zeros(len(k)), 0
    while len(k):
        step = int(np.clip(6 * rows / len(k), 1, 512))
        count = np.arange(drawn + 1, drawn + step + 1, dtype=np.uint64) * GOLDEN
        one = mix(seed[:, None] + count[None, :])
        two = mix(one ^ np.uint64(0xA0761D6478BD642F))
        times = time[:, None] + np.cumsum(-np.log(_uniform(one)), axis=1) / (rows * width[:, None])
        valid = low[:, None] + width[:, None] * _uniform(mix(two + GOLDEN)) < most[:, None]
        np.minimum.at(best, (two % np.uint64(rows)).astype(np.int64)[valid], times[valid])
        time, drawn = times[:, -1], drawn + step
        on = time < best.max()
        k, seed, time, low, width, most = k[on], seed[on], time[on], low[on], width[on], most[on]
    return best


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets of shingles; 0 if one is empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def signatures(docs: DataFrame) -> DataFrame:
    """_row, doc_id, key binary (equal for equal sequences of words), bands array<long> and rows binary (a byte of each
    signature entry) of every row; a text without words has no bands. Nothing is shuffled."""

    def run(batches):
        for b in batches:
            for stretch in slices(b.column(2)):
                part = b.slice(*stretch)
                words = Words(part.column(2))
                each = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
                keys, bands, rows, done = [], [], [], {}
                for i, j in zip(words.starts[:-1], words.starts[1:], strict=True):
                    own = each[i:j]
                    key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    if key not in done:
                        if i == j:
                            done[key] = None, None
                        else:
                            bits = signature(*shingles(own)).view(np.uint64)
                            band = bits.reshape(BANDS, ROWS)
                            h = np.arange(BANDS, dtype=np.uint64)
                            for r in range(ROWS):
                                h = mix(h * np.uint64(3) ^ band[:, r])
                            done[key] = h.view(np.int64).tolist(), (mix(bits) >> np.uint64(56)).astype(np.uint8).tobytes()
                    keys.append(key)
                    bands.append(done[key][0])
                    rows.append(done[key][1])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(rows, pa.binary())], ["_row", "doc_id", "key", "bands", "rows"])
            tidy()

    return in_arrow(docs.select("_row", "doc_id", "text"), run, f"_row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, bands array<long>, rows binary")


def _alike(x: str, y: str) -> Column:
    """Whether the signatures in two columns agree well enough to be verified."""

    @F.arrow_udf("boolean")
    def agree(p: pa.Array, q: pa.Array) -> pa.Array:
        one, two = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(len(s), BANDS * ROWS) for s in (p, q))
        return pa.array((one == two).sum(axis=1) >= AGREE)

    return agree(F.col(x), F.col(y))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, _ta, _tb: distinct pairs with both texts."""
    left, right = (texts.select(F.col("node").alias(f"_{c}"), F.col("text").alias(f"_t{c}")) for c in "ab")
    return pairs.join(left.hint("merge"), F.col("a") == F.col("_a")).join(right.hint("merge"), F.col("b") == F.col("_b")).select("a", "b", "_ta", "_tb")


class _Sets:
    """The multisets of nodes' shingles, kept while a node comes again and again, `most` bytes of them."""

    def __init__(self, most: int = 16 << 20):
        self.kept, self.size, self.most = {}, 0, most

    def of(self, nodes: list[int], texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.size > self.most:
            self.kept, self.size = {}, 0
        new = {node: i for i, node in enumerate(nodes) if node not in self.kept}
        if new:
            words = Words(texts.take(pa.array(list(new.values()))))
            each = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
            self.kept |= {node: shingles(each[words.starts[k] : words.starts[k + 1]]) for k, node in enumerate(new)}
            self.size += 16 * len(each) + 500 * len(new)
        return [self.kept[node] for node in nodes]


def _similar(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """a, b, j: of distinct pairs (a, b), those with a similarity of `least` or more, by the whole texts."""

    def run(batches):
        sets = _Sets()
        for batch in batches:
            for stretch in slices(batch.column(2), 1 << 20, batch.column(3)):
                part = batch.slice(*stretch)
                both = [sets.of(part.column(c).to_pylist(), part.column(c + 2)) for c in (0, 1)]
                j = np.array([similarity(x, y) for x, y in zip(*both, strict=True)], np.float64)
                fit = pa.array(j >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(fit), part.column(1).filter(fit), pa.array(j).filter(fit)], ["a", "b", "j"])
        tidy()

    return in_arrow(_with_texts(pairs, texts), run, "a long, b long, j double")


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of `edges` (a, b): the least node it is linked to, directly or not. Labels spread
    along edges, and a label is replaced by what its own node has learnt; each round is stored, and their number grows
    with the logarithm of the longest chain."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "_n"), F.col("b") == F.col("_n")).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("_was"))
        spread = near.union(labels.select("node", "label", F.col("label").alias("_was"))).groupBy("node").agg(F.min("label").alias("label"), F.max("_was").alias("_was"))
        learnt = spread.groupBy(F.col("_was").alias("_old")).agg(F.min("label").alias("_to"))
        moved = stored(spread.join(learnt, F.col("_was") == F.col("_old")).select("node", F.least("label", "_to").alias("label"), "_was"))
        if not moved.where("label <> _was").limit(1).count():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def _members(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A multiset's elements: the second, third... of equal shingles are elements of their own."""
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(keys, counts) + nth.astype(np.uint64) * GOLDEN).view(np.int64)


def _elements(texts: DataFrame) -> DataFrame:
    """node, n, element: the elements of each text, n in all."""

    def run(batches):
        sets = _Sets(0)
        for batch in batches:
            for stretch in slices(batch.column(1), 1 << 20):
                part = batch.slice(*stretch)
                nodes = part.column(0).to_pylist()
                own = [_members(*x) for x in sets.of(nodes, part.column(1))]
                sizes = np.array([len(x) for x in own], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, sizes), pa.int64()), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(own))], ["node", "n", "element"])
        tidy()

    return in_arrow(texts.select("node", "text"), run, "node long, n long, element long")


def _differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, n, m, d, element: for pairs (node a, pivot b) of n and m elements, the d elements that one of the two has
    and the other hasn't."""

    def run(batches):
        sets = _Sets()
        for batch in batches:
            for stretch in slices(batch.column(2), 1 << 20, batch.column(3)):
                part = batch.slice(*stretch)
                both = [sets.of(part.column(c).to_pylist(), part.column(c + 2)) for c in (0, 1)]
                own = [tuple(_members(*x) for x in two) for two in zip(*both, strict=True)]
                apart_ = [np.setxor1d(x, y, assume_unique=True) for x, y in own]
                sizes = np.array([len(x) for x in apart_], np.int64)
                columns = [part.column(0).to_numpy(), part.column(1).to_numpy(), np.array([len(x) for x, _ in own]), np.array([len(y) for _, y in own]), sizes]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(c, sizes), pa.int64()) for c in columns], pa.array(np.concatenate(apart_))], ["a", "b", "n", "m", "d", "element"])
        tidy()

    return in_arrow(_with_texts(pairs, texts), run, "a long, b long, n long, m long, d long, element long")


def _ranked(rows: DataFrame, keys: list[str], *figures: str) -> DataFrame:
    """Of rows (node, keys, element, figures), each node's elements as `all`, in order of how few nodes have them."""
    common = rows.groupBy(*keys).agg(F.count("*").alias("df")).select(apart(F.struct(*keys)).alias("_key"), *[F.col(k).alias(f"_k_{k}") for k in keys], "df")
    on = (F.col("_own") == F.col("_key")) & reduce(lambda p, q: p & q, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    counted = rows.withColumn("_own", apart(F.struct(*keys))).join(common.hint("merge"), on)
    return counted.groupBy("node").agg(*[F.first(f).alias(f) for f in figures], F.array_sort(F.collect_list(F.struct("df", "element"))).alias("all"))


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    x, y = (rows.select([F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "xy")
    return x, y


def _rest(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: all pairs of nodes of different classes that are similar enough, in `nodes` (node, label, home, stray). Two
    exact similarity joins by prefixes: sets that overlap enough share one of the elements that come first
    in each, in order of how few nodes have them; what can overlap at most then bounds what is left.

    Of two nodes with the same home, one is a stray, and their differences from the home are compared. The difference
    of two sets is that of their differences from a third; a stray's is large, so that it must share much of it with
    any node that it is similar to. Of the many copies of a text that each have words of their own, no pair is made,
    since their differences have those words first. Pairs of different homes, or without, are compared by all elements.
    A pair's first common element stands where what is left of both sets, from it on, still overlaps enough; copies that
    meet only in later ones are no pair, whatever their homes. In the smaller set that is a place among the first ninth,
    before most of the elements that many copies share."""
    share = (1 - SIMILARITY) / (1 + SIMILARITY)  # similar sets of n and m elements differ in share * (n + m) at most
    near = nodes.where("home is not null and home <> node").select(F.col("node").alias("a"), F.col("home").alias("b"))
    rows = stored(_differences(near, texts).withColumnsRenamed({"a": "node", "b": "home"}))
    placed = _ranked(rows, ["home", "element"], "n", "m", "d").join(nodes.hint("merge"), "node")
    # How much a stray must share with any node; how much a node with any stray, whose difference is over its share.
    as_x = F.when(F.col("stray"), F.col("d") - F.greatest(F.lit(1.0), F.ceil(F.col("d") - share * (1 + 1 / SIMILARITY) * F.col("n") - 1e-9)) + 1).otherwise(F.lit(0.0))
    as_y = F.col("d") - (F.floor((F.col("d") + share * (F.col("m") - F.col("n"))) / 2 - 1e-9) + 1) + 1
    placed = placed.withColumn("as_x", as_x).withColumn("as_y", as_y.cast("double"))
    first = placed.select("node", "label", "home", "stray", "n", "d", "as_x", "as_y", F.posexplode(F.slice("all", F.lit(1), F.greatest(F.lit(0), F.greatest("as_x", "as_y").cast("int")))).alias("at", "e"))
    first = stored(first.select("node", "label", "home", "stray", "n", "d", "as_x", "as_y", F.col("at").cast("double").alias("at"), F.col("e.element").alias("element")))
    x, y = _sides(first)
    must = (F.col("d_x") + F.col("d_y") - share * (F.col("n_x") + F.col("n_y"))) / 2 - 1e-9
    can = F.least(F.col("d_x") - F.col("at_x"), F.col("d_y") - F.col("at_y"))
    on = (F.col("home_x") == F.col("home_y")) & (F.col("element_x") == F.col("element_y")) & (F.col("label_x") != F.col("label_y"))
    once = ~F.col("stray_y") | (F.col("node_x") < F.col("node_y"))
    one = x.where("stray_x and at_x < as_x_x").join(y.where("at_y < as_y_y"), on & once & (can >= must)).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))

    rows = stored(_elements(texts.join(nodes.select("node").hint("merge"), "node")))
    ranked = _ranked(rows, ["element"], "n")
    first = ranked.select("node", "n", F.posexplode(F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1).cast("int"))).alias("at", "e")).where("e.df > 1")
    x, y = _sides(stored(first.select("node", "n", "at", F.col("e.element").alias("element")).join(nodes.hint("merge"), "node")))
    over = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    able = over >= SIMILARITY * (F.col("n_x") + F.col("n_y") - over) - 1e-9
    other = ~F.coalesce(F.col("home_x") == F.col("home_y"), F.lit(False))
    x = x.where(F.col("at_x") < F.col("n_x") - F.ceil(F.col("n_x") * (1 - share) - 1e-9) + 1)
    smaller = F.struct("n_x", "node_x") < F.struct("n_y", "node_y")
    two = x.join(y, (F.col("element_x") == F.col("element_y")) & (F.col("label_x") != F.col("label_y")) & smaller & other & able).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
    return _similar(one.union(two).distinct(), texts).select("a", "b")


def classes(docs: DataFrame) -> DataFrame:
    """_row, doc_id, class_id, class_row, copies: for each row of `docs` (_row long, doc_id long, text), the least
    doc_id in its class, the least _row among rows with that id, and the number of rows with the same words.

    Documents are linked if their multisets of five-word shingles have a weighted Jaccard similarity of 0.8 or more, or
    if they have the same words in the same order; classes are what links connect. Texts without words (null, empty,
    blank) are copies of each other. Documents with null ids have classes like others; a class of such only has a null
    class_id.

    Copies are put together first, whatever their number, and one of each stands for them (a node). Nodes that share a
    band's hash form a bucket, and its pivot, the member with the most bucket mates, is compared to all others in it.
    What is linked forms classes, and a node's home is a pivot that is near it, and near many others. In buckets whose members
    are not of one class then, _rest() finds all other links. So any two that share a bucket are compared, or proven
    too different, or connected by others: no link is lost, and a large group of near copies doesn't take all its
    pairs."""
    all_rows = stored(signatures(docs))
    reps = all_rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "_row")).alias("_least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("rows").alias("rows"))
    reps = stored(reps.select("key", F.col("_least._row").alias("node"), F.col("_least.doc_id").alias("doc_id"), "copies", "bands", "rows"))
    member = reps.select("node", F.posexplode("bands").alias("band", "hash")).withColumn("bucket", F.xxhash64("band", "hash"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select(apart(F.col("bucket")).alias("_key"), F.col("bucket").alias("_b"), "size")
    member = stored(member.withColumn("_own", apart(F.col("bucket"))).join(sizes.hint("merge"), (F.col("_own") == F.col("_key")) & (F.col("bucket") == F.col("_b"))).select("node", "bucket", "size"))
    mates = member.groupBy("node").agg(F.sum("size").alias("mates")).join(reps.select("node", "rows").hint("merge"), "node")
    active = stored(member.join(mates.hint("merge"), "node").select("node", "bucket", "rows", F.struct(-F.col("mates"), F.xxhash64("node"), "node").alias("rank"), F.col("node").alias("label")))
    texts = stored(docs.select(F.col("_row").alias("node"), "text").join(active.select("node").distinct().hint("merge"), "node"))
    bucket = F.struct(F.col("rank").alias("r"), F.col("node").alias("p"), F.col("rows").alias("s"))
    pivot = active.groupBy("bucket").agg(F.min(bucket).alias("_pivot")).select(apart(F.col("bucket")).alias("_key"), F.col("bucket").alias("_bucket"), "_pivot")
    pairs = active.withColumn("_own", apart(F.col("bucket"))).join(pivot.hint("merge"), (F.col("_own") == F.col("_key")) & (F.col("bucket") == F.col("_bucket"))).where(F.col("node") != F.col("_pivot.p"))
    pairs = pairs.where(_alike("rows", "_pivot.s")).select(F.col("node").alias("a"), F.col("_pivot.p").alias("b")).distinct()
    close = stored(_similar(pairs, texts, NEAR))
    labels = components(close.where(F.col("j") >= SIMILARITY))
    mine = labels.withColumnRenamed("node", "_n").hint("merge")
    active = active.select("node", "bucket").join(mine, F.col("node") == F.col("_n"), "left").select("node", "bucket", F.coalesce("label", "node").alias("label"))
    held = active.groupBy("bucket").agg(F.min("label").alias("_one"), F.max("label").alias("_two")).where("_one <> _two").select(apart(F.col("bucket")).alias("_key"), F.col("bucket").alias("_bucket"))
    rest = active.withColumn("_own", apart(F.col("bucket"))).join(held.hint("merge"), (F.col("_own") == F.col("_key")) & (F.col("bucket") == F.col("_bucket"))).select("node", "label").distinct()
    # Of the pivots near a node, and itself if it is one, the home is the one near the most nodes.
    many = close.groupBy("b").agg(F.count("*").alias("near")).select(apart(F.col("b")).alias("_key"), F.col("b").alias("_b"), "near")
    homes = close.select("a", "b", "j").union(close.select(F.col("b").alias("a"), "b", F.lit(1.0).alias("j")).distinct()).withColumn("_own", apart(F.col("b")))
    homes = homes.join(many.hint("merge"), (F.col("_own") == F.col("_key")) & (F.col("b") == F.col("_b")))
    homes = homes.groupBy("a").agg(F.max(F.struct("near", "j", F.col("b").alias("home"))).alias("_h")).select(F.col("a").alias("_n"), F.col("_h.home").alias("home"))
    rest = rest.join(homes.hint("merge"), F.col("node") == F.col("_n"), "left").drop("_n").join(labels.select(F.col("node").alias("_n"), F.col("label").alias("_class")).hint("merge"), F.col("home") == F.col("_n"), "left")
    # A stray is not of its home's class; of two nodes with one home and different classes, one is.
    rest = stored(rest.select("node", "label", "home", (F.col("home").isNull() | (F.col("label") != F.coalesce("_class", "home"))).alias("stray")))
    found = stored(_rest(rest, texts))
    # Links of classes: each node stands under the label it has by now.
    for end in "ab":
        found = found.join(labels.withColumnRenamed("node", "_n").hint("merge"), F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("label", end)).select("a", "b")
    merged = components(found).select(F.col("node").alias("_from"), F.col("label").alias("_to"))
    named = reps.select("key", "node", "doc_id", "copies").join(labels.withColumnRenamed("node", "_n").hint("merge"), F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(merged.hint("merge"), F.col("label") == F.col("_from"), "left").select("key", "node", "doc_id", "copies", F.coalesce("_to", "label").alias("label"))
    heads = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "node")).alias("_head")).select(F.col("label").alias("_l"), F.col("_head.doc_id").alias("class_id"), F.col("_head.node").alias("class_row"))
    named = stored(named.join(heads, F.col("label") == F.col("_l")).select(apart(F.col("key")).alias("_key"), F.col("key").alias("_k"), "class_id", "class_row", "copies"))
    return all_rows.select("_row", "doc_id", "key").withColumn("_own", apart(F.col("key"))).join(named.hint("merge"), (F.col("_own") == F.col("_key")) & (F.col("key") == F.col("_k"))).select("_row", "doc_id", "class_id", "class_row", "copies")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Of each class of `docs` (see classes), the row that stands for it; all columns as they are, whatever they are
    called."""
    own = numbered(docs)
    gone = classes(own.select("_row", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.text").alias("text"))).where("_row <> class_row").select("_row")
    return own.join(stored(gone).hint("merge"), "_row", "left_anti").select("_doc.*")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return classes(docs).select("doc_id", "class_id", "copies")
