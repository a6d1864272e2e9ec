"""LM scoring: a weighted backoff automaton over smoothed n-grams, its counts kept in shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, in_arrow, mix, read, remainder, segment_sums, slices, tidy

#: The token at the end of each text; also the state that each text starts in.
END = np.uint64(0xE4D0F7E87E4D0F7E)
#: Words in the longest n-gram.
ORDER = 3
#: Weight of the next lower order, by the order of the n-gram: as many occurrences of its history. Chosen by the
#: probability of texts held out.
MU = {2: 320.0, 3: 5.0}
#: Bytes of text in a block, about; bytes of hashes in a shard, about; bytes that a task reads, about.
BLOCK, SHARD, TASK = 8 << 20, 2 << 20, 32 << 20
#: Distinct n-grams of a block for each token in it, by their order, about.
SHARE = {1: 0.2, 2: 0.7, 3: 1.0}


def bits(tokens: float) -> int:
    """Bits of a hash, for so many tokens: the counts of one n-gram in 16,000, at most, are mixed with another's."""
    return min(64, max(40, int(np.ceil(np.log2(max(tokens, 1.0)))) + 14))


class Block:
    """The tokens of one block's texts: `codes` into `hashes` (sorted, of the given width; END, at `end`, among them),
    text after text, an end after each; `starts`; `training`, whether each token is of a training text."""

    def __init__(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray | None, held: np.ndarray, width: int = 64):
        self.hashes, self.codes, self.held, self.width = hashes, codes, held, np.uint64(64 - width)
        self.end = int(np.searchsorted(hashes, END >> self.width))
        self.starts = np.concatenate(([0], np.flatnonzero(codes == self.end) + 1)) if starts is None else starts
        self.training = np.repeat(~held, np.diff(self.starts))

    @classmethod
    def of(cls, texts: pa.Array, held: np.ndarray, width: int = 64) -> Block:
        words = Words(texts, lower=True)
        last = END >> np.uint64(64 - width)
        raw = words.hashes() >> np.uint64(64 - width)
        raw[raw == last] ^= np.uint64(1)
        hashes = np.unique(np.append(raw, last))
        starts = words.starts + np.arange(len(words.starts))
        codes = np.full(int(starts[-1]), np.searchsorted(hashes, last), np.int64)
        inner = np.ones(len(codes), bool)
        inner[starts[1:] - 1] = False
        codes[inner] = np.searchsorted(hashes, raw)[words.codes]
        return cls(hashes, codes, starts, held, width)

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted hashes of the n-grams of an order, and each token's place among them: of the n-gram that ends with
        it. Before a text's first word stands one END. A token with fewer before it has none: the number of hashes."""
        if order == 1:
            return self.hashes, self.codes
        h, has = mix(self.hashes)[self.codes], np.arange(len(self.codes)) - np.repeat(self.starts[:-1], np.diff(self.starts)) >= order - 2
        key = h
        for back in range(1, order):
            before = np.empty_like(h)
            before[back:] = h[:-back] if back < len(h) else h[:0]
            at = self.starts[:-1] + back - 1
            before[at[at < self.starts[1:]]] = mix(self.hashes[[self.end]])[0]
            key = mix(key * np.uint64(3) ^ before)
        both, found = np.unique(key[has] >> self.width, return_inverse=True)
        place = np.full(len(self.codes), len(both), np.int64)
        place[has] = found
        return both, place


def _bytes(values: np.ndarray, kind: str) -> bytes:
    """The numbers' first bytes, then their second ones and so on, compressed: high bytes are mostly 0 and take next to
    no space."""
    return zstandard.compress(values.astype(kind).view("u1").reshape(len(values), -1 if len(values) else 1).T.tobytes(), 1)


def _numbers(data: bytes, kind: str) -> np.ndarray:
    plain, size = zstandard.decompress(data), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(plain, "u1").reshape(size, len(plain) // size).T).view(kind).ravel()


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the steps from each to the next."""
    return _bytes(np.diff(hashes, prepend=np.uint64(0)), "<u8")


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, "<u8"), dtype=np.uint64)


def _split(hashes: np.ndarray, shards: int, drop: np.uint64) -> list[tuple[int, slice]]:
    """The shards that have any of the sorted `hashes`, in order, and where theirs are: a shard is a range of hashes.
    drop: how many of 64 bits the hashes don't have."""
    shard = ((hashes >> (np.uint64(32) - drop)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    return [(int(shard[a]), slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


#: Rows on their way. key: where a row goes, a shard of an order, or for texts (kind 0) a place of their own. kind: the
#: n-grams' order. data: packed hashes and counts; of texts, hashes, ranks of tokens, doc_ids and flags.
PARTS = "key long, block long, kind int, shard int, a binary, b binary, c binary, d binary"
_NAMES = [x.split()[0] for x in PARTS.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _asked(number: int, block: Block, kind: int, shards: int) -> list[tuple]:
    """A row for each shard that the block's n-grams of an order belong to: their hashes, and their training counts."""
    hashes, place = block.grams(kind)
    counts = np.bincount(place[block.training], minlength=len(hashes) + 1)
    return [((kind << 40) + s, number, kind, s, _packed(hashes[x]), _bytes(counts[:-1][x], "<u4"), None, None) for s, x in _split(hashes, shards, block.width)]


def _texts(number: int, block: Block, ids: pa.Array) -> tuple:
    """The row of a block's texts: words by rank of frequency, most of which take one byte."""
    order = np.argsort(-np.bincount(block.codes, minlength=len(block.hashes)), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    known = np.asarray(ids.is_valid())
    flags = block.held.astype("u1") | (~known).astype("u1") << 1
    return (-1 - number, number, 0, 0, _bytes(block.hashes[order], "<u8"), _bytes(rank[block.codes], "<u4"), _bytes(ids.fill_null(0).to_numpy(zero_copy_only=False), "<i8"), flags.tobytes())


def _block(row: dict, width: int) -> tuple[Block, pa.Array]:
    """What _texts() has put away."""
    flags, hashes = np.frombuffer(row["d"], "u1"), _numbers(row["a"], "<u8")
    order = np.argsort(hashes)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    codes = place[_numbers(row["b"], "<u4")]
    return Block(hashes[order], codes, None, (flags & 1).astype(bool), width), pa.array(_numbers(row["c"], "<i8"), mask=(flags & 2).astype(bool))


def _blocks(batches, width: int, block_size: int):
    """Number, tokens and ids of the blocks of a partition: as many texts in a row as have `block_size` bytes."""
    from pyspark import TaskContext

    number, parts, size = TaskContext.get().partitionId() << 32, [], 0

    def block():
        own = pa.Table.from_batches(parts).combine_chunks()
        return number, Block.of(own.column("text"), own.column("held").to_numpy().astype(bool), width), own.column("doc_id").combine_chunks()

    for b in batches:
        for stretch in slices(b.column(2), max(1, block_size // 4)):
            parts.append(b.slice(*stretch))
            size += int(pc.sum(pc.binary_length(parts[-1].column(2))).as_py() or 0)
            if size >= block_size:
                yield block()
                number, parts, size = number + 1, [], 0
                tidy()
    if parts:
        yield block()
    tidy()


def _sum(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of rows of one shard: the distinct hashes, their total counts, the place of each row's hashes among them, and how
    many each row has."""
    asked = [_unpacked(r["a"]) for r in rows]
    everything, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([_numbers(r["b"], "<u4") for r in rows]), minlength=len(everything)).astype(np.int64)
    return everything, total, place, [len(x) for x in asked]


TOTALS = "tokens double, types double, once double, n_all double"


def totals(own: DataFrame, shards: int, width: int, block_size: int) -> list[float]:
    """Of the training texts: tokens, types, types seen once (END aside); of all texts: tokens."""

    def ask(batches):
        for number, block, _ in _blocks(batches, width, block_size):
            rows = _asked(number, block, 1, shards)
            yield _table([(*r[:6], np.int64(len(block.codes) if not k else 0).tobytes(), None) for k, r in enumerate(rows)])

    def add(key, rows):
        rows = rows.to_pylist()
        hashes, total, *_ = _sum(rows)
        found = [total.sum(), (total > 0).sum(), (total[hashes != END >> np.uint64(64 - width)] == 1).sum(), sum(int(np.frombuffer(r["c"], np.int64)[0]) for r in rows)]
        return pa.table([pa.array([float(x)]) for x in found], names=[x.split()[0] for x in TOTALS.split(", ")])

    sums = in_arrow(own, ask, PARTS).groupBy("key").applyInArrow(add, TOTALS).groupBy().sum().first()
    return [float(x or 0) for x in sums]


class Automaton:
    """The backoff automaton over one block's n-grams. States are the histories seen in training, of up to two words,
    and the empty one; texts start in the state END. An arc from state h reads w, if the n-gram hw was seen, with weight
    log10 P(w|h), where P(w|h) = (c(hw) + mu * P(w|h')) / (c(h) + mu), h' being h without its first word, and mu that of
    the order. For other w, the failure arc of h leads to h', with weight log10(mu / (c(h) + mu)), where w is tried
    again; of a history that wasn't seen, it weighs nothing. The empty state has an arc for every w: P(w) is
    (1 - u) * c(w) / N, and u for a word not seen in training, u being the share of words seen once. For each state the
    probabilities of all words and END sum to 1, words not seen counting as one."""

    def __init__(self, figures: list[float], mu: dict[int, float] = MU):
        n, _, once, *_ = figures
        self.unseen, self.n, self.mu = (once + 0.5) / (n + 1.0), n, mu

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.maximum(np.where(counts > 0, (1 - self.unseen) * counts / max(self.n, 1.0), self.unseen), 1e-300)

    def traverse(self, block: Block, counts: dict[int, np.ndarray]) -> np.ndarray:
        """Log10 of each token's probability. counts: by order, of the n-gram that ends with each token, and 0 where
        there is none. Texts are read from left to right. The state that a token is read in follows from the one before
        it: the longest history that ends there; so the first step of all tokens can be taken at once, and then their
        failure arcs, one order after another."""
        before = {order: np.zeros(len(block.codes)) for order in range(1, ORDER)}
        for order, c in before.items():
            c[1:] = counts[order][:-1]
            c[block.starts[:-1]] = 0
        before[1][block.starts[:-1]] = self.ends
        p = {1: self.unigram(counts[1])}
        for order in range(2, ORDER + 1):
            p[order] = (counts[order] + self.mu[order] * p[order - 1]) / (before[order - 1] + self.mu[order])
        score, reading = np.zeros(len(block.codes)), np.ones(len(block.codes), bool)
        for order in range(ORDER, 1, -1):
            arc = reading & (counts[order] > 0)
            score[arc] += np.log10(p[order][arc])
            reading &= ~arc
            score[reading] += np.log10(self.mu[order] / (before[order - 1][reading] + self.mu[order]))
        score[reading] += np.log10(p[1][reading])
        return score

    ends: float = 0.0


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(figures: list[float], width: int):
    def run(key, rows):
        rows = rows.to_pylist()
        block, ids = _block(next(r for r in rows if r["kind"] == 0), width)
        counts = {}
        automaton = Automaton(figures)
        for order in range(1, ORDER + 1):
            found = [_numbers(r["b"], "<u4") for r in sorted((r for r in rows if r["kind"] == order), key=lambda r: r["shard"])]
            hashes, place = block.grams(order)
            each = np.append(np.concatenate(found) if found else np.empty(0, np.int64), 0).astype(np.int64)
            if len(each) != len(hashes) + 1:
                raise RuntimeError("counts are missing")
            counts[order] = each[place]
            if order == 1:
                automaton.ends = float(each[block.end])
        n, types, *_ = figures
        base = np.log10((counts[1] + 0.5) / (n + 0.5 * (types + 1)))
        score = automaton.traverse(block, counts)
        known = (counts[1] > 0).astype(np.int64)
        columns = [ids, pa.array(block.held), pa.array(np.diff(block.starts)), pa.array(segment_sums(known, block.starts)), pa.array(np.full(len(ids), int(n), np.int64)), pa.array(segment_sums(base, block.starts)), pa.array(segment_sums(score, block.starts))]
        return pa.table(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def _added(key, rows):
    """Of one shard: the total count of each hash, sent back to each block that asked, in its own order. Texts pass."""
    if key[0].as_py() < 0:
        return rows.select(_NAMES)
    rows, out, at = rows.to_pylist(), [], 0
    _, total, place, sizes = _sum(rows)
    for r, n in zip(rows, sizes, strict=True):
        out.append((r["key"], r["block"], r["kind"], r["shard"], None, _bytes(total[place[at : at + n]], "<u4"), None, None))
        at += n
    return pa.Table.from_batches([_table(out)])


def scored(docs: DataFrame, held_out: Column, block_size: int = BLOCK) -> DataFrame:
    """RESULT for every row of `docs` (doc_id, text): a trigram model and an add-half unigram base are learned from the
    rows where `held_out` is not true, and score all rows, whole texts. A null text counts as empty: its one token is
    the end. Repeated rows are learned and scored as often as they occur. All n-grams seen in training count, whatever
    how often. An empty table gives no rows.

    The model never stands in one place. Each task reads its texts in blocks of `block_size` bytes; a block asks, for its own
    distinct n-grams, the shards that the hashes belong to for their counts in all blocks, and walks the automaton with
    what comes back; its tokens travel along. A block is one row, and a word counts once in it, so that neither a long
    text nor a frequent word makes a group large. Shards and tasks are as many as the tokens call for, at every size; so
    are the bits of a hash (see bits)."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).cast("int").alias("held"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size, n = own.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    guess = (size or 0) / 4 + n
    width = bits(guess)
    figures = totals(own, max(8, int(np.ceil(guess * SHARE[1] * 8 / SHARD))), width, block_size)
    shards = {k: max(8, int(np.ceil(figures[3] * x * 8 / SHARD))) for k, x in SHARE.items()}
    tasks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 64), int(np.ceil(figures[3] * 9 / TASK)))

    def ask(batches):
        for number, block, ids in _blocks(batches, width, block_size):
            yield _table([_texts(number, block, ids)])
            for kind in range(1, ORDER + 1):
                yield _table(_asked(number, block, kind, shards[kind]))

    parts = in_arrow(own, ask, PARTS).repartition(tasks, "key").groupBy("key").applyInArrow(_added, PARTS)
    return parts.repartition(tasks, "block").groupBy("block").applyInArrow(_scores(figures, width), RESULT)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 1)
