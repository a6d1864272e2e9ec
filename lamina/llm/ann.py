"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, prepared, read, stored

#: Vectors that the tree is fitted on: one in SHARE, at least and at most so many. Every vector is filed and searched.
SHARE, LEAST, MOST = 10, 20_000, 100_000
#: Children of a node; vectors of the table in a leaf, about; vectors in a block of a leaf, and queries in a group, about.
BRANCHES, LEAF, BLOCK, QUERIES = 8, 1024, 4096, 1024
#: Leaves that are searched first, and how many times as many leaves each round of widening goes up to; what a query's
#: k best have so far bounds what further leaves give, so that a round gives WIDER * k rows for a query, about.
FIRST, WIDER = 6, 8
#: Recall that bounds are calibrated to, on PROBES vectors that the tree isn't fitted on.
RECALL, PROBES = 0.95, 300


class Tree:
    """centres: of all nodes; radii: the distance of the farthest fitted vector; children: of each, empty for leaves;
    leaf: each node's number among the leaves, or -1; reach: the share of a node's radius that its bound has."""

    reach = 1.0

    def __init__(self, vectors: np.ndarray, leaf_size: int, seed: int = 7):
        self.centres, self.radii, self.children, self.parents, self.leaf = [vectors.mean(axis=0)], [0.0], [[]], [-1], [-1]
        rng, todo = np.random.default_rng(seed), [(0, np.arange(len(vectors)))]
        self.leaves = 0
        while todo:
            node, rows = todo.pop()
            apart = vectors[rows] - self.centres[node]
            self.radii[node] = float(np.sqrt((apart * apart).sum(axis=1).max()))
            groups = self._split(vectors, rows, rng) if len(rows) > leaf_size else []
            if len(groups) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for centre, own in groups:
                self.children[node].append(len(self.centres))
                self.centres.append(centre)
                self.radii.append(0.0)
                self.children.append([])
                self.parents.append(node)
                self.leaf.append(-1)
                todo.append((len(self.centres) - 1, own))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    @staticmethod
    def _split(vectors: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        own = vectors[rows]
        centres = own[rng.choice(len(rows), min(BRANCHES, len(rows)), replace=False)]
        for _ in range(12):
            near = (own @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
            new = np.array([own[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
            if np.allclose(new, centres):
                break
            centres = new
        near = (own @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        return [(centres[k], rows[near == k]) for k in range(len(centres)) if (near == k).any()]

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: from the root down, to the nearest child."""
        at, out = [(0, np.arange(len(vectors)))], np.zeros(len(vectors), np.int32)
        while at:
            node, rows = at.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = (vectors[rows] @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            at += [(kid, rows[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What a vector in each node can have as its inner product with each query, as far as `reach` goes."""
        return queries @ self.centres.T + self.reach * np.sqrt((queries * queries).sum(axis=1))[:, None] * self.radii

    def visit(self, bounds: np.ndarray, most: int | None = None, floor: float = -np.inf) -> list[int]:
        """Leaves, best bin first: the open node with the largest bound is opened next, wherever it is in the tree,
        until `most` leaves are found, or no open node's bound reaches `floor`. bounds: the query's, of all nodes."""
        queue, found = [(-float(bounds[0]), 0)], []
        while queue and len(found) != most:
            best, node = heapq.heappop(queue)
            if -best < floor:
                break
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
            for kid in self.children[node]:
                heapq.heappush(queue, (-float(bounds[kid]), kid))
        return found

    def first(self, query: np.ndarray, bounds: np.ndarray) -> list[int]:
        """The leaves searched first: best bins first by distance, where copies of the query are, and by bound."""
        away = 2 * (self.centres @ query) - (self.centres * self.centres).sum(axis=1)
        return list(dict.fromkeys(self.visit(away, FIRST // 2) + self.visit(bounds, FIRST - FIRST // 2)))


def calibrated(tree: Tree, vectors: np.ndarray, probes: np.ndarray, k: int, rows: int) -> float:
    """The least reach, to a hundredth, with which probes find RECALL of their nearest among `vectors`, none of which the
    tree was fitted on, when they search as queries do; and a twentieth more, as the table is larger: FIRST leaves, then all whose bounds reach the k-th best found there. Of the k nearest in a table of
    `rows`, a sample has fewer: so many count here as k, one at least."""
    near = max(1, min(len(vectors), round(k * len(vectors) / max(rows, 1))))
    leaf = tree.file(vectors)
    asked = []
    for q in probes:
        product = vectors @ q
        best = np.argpartition(-product, near - 1)[:near]
        asked.append((q, product, Counter(leaf[best].tolist())))

    def recall(reach: float) -> float:
        tree.reach, found = reach, 0
        for q, product, wanted in asked:
            bounds = tree.bounds(q[None])[0]
            first = tree.first(q, bounds)
            there = product[np.isin(leaf, first)]
            floor = np.partition(there, len(there) - near)[len(there) - near] if len(there) >= near else -np.inf
            found += sum(wanted[x] for x in {*first, *tree.visit(bounds, None, floor)})
        return found / max(1, near * len(asked))

    low, high = 0, 100
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if recall(middle / 100) >= RECALL else (middle + 1, high)
    return 1.05 * high / 100


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, and not all zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(whole, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of `width` numbers, the longest row's if None: shorter ones have zeros after their end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=1)) if width is None else width
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, inside = np.zeros((len(column), width)), at < width
    out[np.repeat(np.arange(len(column)), sizes)[inside], at[inside]] = flat[inside]
    return out


def _distinct(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The places of all rows but exact repetitions."""
    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    return np.array(sorted({(i, v.tobytes()): k for k, (i, v) in enumerate(zip(ids.tolist(), vectors, strict=True))}.values()))


def _best(k: int):
    """The k best of a block of rows for each of a group of queries, none below its floor, by exact scores."""

    def run(key, block, queries):
        out = []
        if len(block) and len(queries):
            width = max(int(pc.max(pc.list_value_length(block.column("v"))).as_py()), int(pc.max(pc.list_value_length(queries.column("q"))).as_py()))
            ids, p = block.column("vec_id").to_numpy(), _matrix(block.column("v"), width)
            one = _distinct(ids, p)
            ids, p = ids[one], p[one]
            names, marks, q, floor = queries.column("query_id").to_numpy(), queries.column("mark").to_numpy(), _matrix(queries.column("q"), width), queries.column("floor").to_numpy()
            for at in range(0, len(names), 256):
                for i, row in enumerate(q[at : at + 256] @ p.T, at):
                    edge = floor[i]
                    if len(ids) > k + 1:
                        edge = max(edge, np.partition(row, len(row) - k - 1)[len(row) - k - 1])
                    rough = np.flatnonzero(row >= edge - 1e-9 * (1 + abs(edge))) if np.isfinite(edge) else np.arange(len(ids))
                    score = np.einsum("ij,j->i", p[rough], q[i])
                    keep = (ids[rough] != names[i]) & (score >= floor[i])
                    rough, score = rough[keep], score[keep]
                    order = np.lexsort((ids[rough], -score))[:k]
                    out.append((np.full(len(order), names[i]), np.full(len(order), marks[i]), ids[rough[order]], score[order]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        return pa.table([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int64, np.float64), strict=True)], names=["query_id", "mark", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, least: int = LEAST, most: int = MOST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by inner product, ties to the smaller vec_id.

    vectors: vec_id long, embedding array; is_query: a condition on vec_id. Every row is filed in the tree and searched.
    Rows with null vec_id or unusable vectors (see usable) take no part. A vector that is shorter than another counts as
    having zeros after its end. Exact repetitions of a row count once; rows with equal vec_id and different vectors are
    candidates, and queries, of their own. A query's own vec_id is left out of its result; with fewer than k others, all
    are in it. An empty table gives no rows.

    The tree is fitted on the driver, on one vector in SHARE, `least` to `most` of them; a leaf is meant to have LEAF
    rows of the table as long as `most` vectors make so many leaves. Rows are dealt by leaf, and a leaf with many rows,
    such as copies of one vector, in blocks; queries of a leaf in groups. Each block gives each query its k best. The
    FIRST leaves are searched before the others; then each query widens its visits in rounds, until no open node's bound
    reaches the k-th best it has (see calibrated). The number of rounds grows with the logarithm of the leaves'."""
    spark = prepared(vectors.sparkSession)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v").cast("array<double>")))
    kind = own.schema["v"].dataType.simpleString()
    if kind not in ("array<float>", "array<double>"):
        own, kind = own.withColumn("v", F.col("v").cast("array<double>")), "array<double>"
    sizes = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n")
    rows, width = sizes.agg(F.sum("count")).first()[0], sizes.first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = min(max(least, rows // SHARE), most) + PROBES
    picked = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(rows)) < int(wanted * 1.1)).limit(wanted).select("v").toArrow()
    picked = _matrix(picked.column("v"), width["n"])
    if not len(picked):
        picked = _matrix(own.limit(PROBES).select("v").toArrow().column("v"), width["n"])
    np.random.default_rng(11).shuffle(picked)
    probes, rest = np.split(picked, [min(PROBES, len(picked) // 10)])
    fitted, others = np.split(rest, [-(-2 * len(rest) // 3)])
    tree = Tree(fitted, max(16, LEAF * len(fitted) // rows))
    tree.reach = calibrated(tree, others, probes, k, rows) if len(others) else 1.0

    def file(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.file(_matrix(b.column(1), width["n"])), pa.int32())], ["vec_id", "v", "leaf"])

    def route(before: int, upto: int):
        """Leaves of a round: the first ones for upto = 0, then those from the before-th to the upto-th by bound."""

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    floors = part.column("floor").to_numpy(zero_copy_only=False)
                    bins = []
                    q = _matrix(part.column("q"), width["n"])
                    for own, bounds, floor in zip(q, tree.bounds(q), floors, strict=True):
                        first = tree.first(own, bounds)
                        bins.append([x for x in tree.visit(bounds, upto, floor - 1e-9 * (1 + abs(floor)) if np.isfinite(floor) else floor)[before:] if x not in first] if upto else first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bins, pa.list_(pa.int32()))], [*part.schema.names, "leaves"])

        return run

    filed = stored(in_arrow(own, file, f"vec_id long, v {kind}, leaf int"))
    # As many rows as leaves, which `most` bounds.
    blocks = stored(filed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))

    def searched(queries: DataFrame, before: int, upto: int) -> DataFrame:
        """The k best of each query (query_id, mark, q, floor) in each of its leaves of a round."""
        asked = stored(in_arrow(queries, route(before, upto), f"query_id long, mark long, q {kind}, floor double, leaves array<int>"))
        groups = asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        dealt = stored(blocks.join(groups, "leaf"))
        left = filed.join(F.broadcast(dealt), "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "vec_id", "v")
        right = asked.select("query_id", "mark", "q", "floor", F.explode("leaves").alias("leaf")).join(F.broadcast(dealt), "leaf")
        right = right.select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id", "mark"), F.col("groups")).cast("int").alias("group"), "query_id", "mark", "q", "floor")
        keys = ["leaf", "block", "group"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), "query_id long, mark long, vec_id long, score double")

    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    queries = stored(own.where(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("mark"), F.col("v").alias("q")).distinct())
    near = stored(ranked(searched(queries.withColumn("floor", F.lit(float("-inf"))), 0, 0)).drop("rank"))
    before, upto = 0, FIRST * WIDER
    while before < tree.leaves:
        floors = near.groupBy("query_id", "mark").agg(F.min("score").alias("worst"), F.count("*").alias("n")).select(F.col("query_id").alias("_id"), F.col("mark").alias("_mark"), F.when(F.col("n") == k, F.col("worst")).alias("_floor"))
        open_ = queries.join(floors, (F.col("query_id") == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("query_id", "mark", "q", F.coalesce("_floor", F.lit(float("-inf"))).alias("floor"))
        near = stored(ranked(near.union(searched(open_, before, upto))).drop("rank"))
        before, upto = upto, upto * WIDER
    return ranked(near).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: The exact result; the query's recall against it is measured in the tests.
EXACT_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id)::INTEGER AS rank
FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20
"""
