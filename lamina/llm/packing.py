"""Packing token ids into training sequences: bounded-space online best-fit."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, in_arrow, read, slices, stored, tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Words of Latin letters, with one comma or full stop at most: they are one run of letters (and one mark) for the
#: pre-tokenizer, are in normal form already, and have one lower-case letter for each letter.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")

#: The rules of normalizing and splitting under which the ids of a text are those of its words (fixed values).
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_letters() -> dict[int, str]:
    """The public byte-to-letter table of byte-level BPE: visible bytes stand for themselves, the others for 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Tokens:
    """Ids of texts. By a tokenizer with the rules BY_WORDS, the ids of a text are those of its words, each by itself:
    words are encoded once and kept in a bounded table, `words` with their ids end to end. By any other tokenizer, whole
    texts are encoded."""

    _made: dict[int, Tokens] = {}

    def __init__(self, spec: str, kept: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(spec), kept
        rules = json.loads(spec)
        self.by_words = all(rules.get(k) == v for k, v in BY_WORDS.items())
        self.words, self.sizes, self.ids = pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, "<u4")
        self.letters = _byte_letters()

    @classmethod
    def of(cls, spec: str) -> Tokens:
        key = hash(spec)
        if key not in cls._made:
            cls._made = {key: cls(spec)}
        return cls._made[key]

    def word(self, w: str) -> bytes:
        """The model is asked directly for plain words, which spares the library's normalizer and regex."""
        m = PLAIN.fullmatch(w)
        if not m:
            return np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        core = m[1].lower()
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(core)]
        if m[2]:
            ids += [t.id for t in self.tokenizer.model.tokenize(m[2])]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, new: pa.Array) -> None:
        if len(self.words) + len(new) > self.most:
            self.words, self.sizes, self.ids = self.words[:0], self.sizes[:0], self.ids[:0]
        found = [self.word(w) for w in new.to_pylist()]
        self.words = pa.concat_arrays([self.words, new])
        self.sizes = np.append(self.sizes, np.fromiter(map(len, found), np.int64, len(found)) >> 2)
        self.ids = np.append(self.ids, np.frombuffer(b"".join(found), "<u4"))

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by `end`, and where each text starts (with a last entry)."""
        if not self.by_words:
            own = [np.asarray([*x.ids, end], np.uint32) for x in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate(own) if own else np.empty(0, np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        words = Words(texts)
        vocabulary = words.vocabulary
        place = pc.index_in(vocabulary, value_set=self.words)
        if place.null_count:
            self._learn(vocabulary.filter(pc.is_null(place)))
            place = pc.index_in(vocabulary, value_set=self.words)
            if place.null_count:  # the table was cleared
                self._learn(vocabulary.filter(pc.is_null(place)))
                place = pc.index_in(vocabulary, value_set=self.words)
        place = place.to_numpy(zero_copy_only=False)[words.codes] if len(words.codes) else np.empty(0, np.int64)
        begins = np.cumsum(self.sizes) - self.sizes
        n = self.sizes[place]
        ends = np.cumsum(n)
        at = np.repeat(begins[place] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        total = np.concatenate(([0], ends))
        starts = total[words.starts]
        out = np.full(len(at) + len(words.counts), end, np.uint32)
        doc = np.repeat(np.arange(len(words.counts)), np.diff(starts))
        out[np.arange(len(at)) + doc] = self.ids[at]
        return out, starts + np.arange(len(starts))


class Packer:
    """Bounded-space best-fit: a fixed number of open windows. A piece goes to the fullest window that it fits in. When
    it fits in none, the fullest window is filled with the head of the piece and emitted, and the rest is placed anew.
    What is open at the very end is joined end to end, cut into full windows, and the last one into powers of two, which
    need no padding."""

    def __init__(self, size: int = 4096, windows: int = 32, first_id: int = 0):
        self.size, self.windows, self.next, self.open, self.rows = size, windows, first_id, [], []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        """ids: of a document from `start` on, to its end or not; total: the whole document's number of ids."""
        first, total = start, len(ids) if total is None else total
        while start < first + len(ids):
            rest = ids[start - first :]
            if len(rest) >= self.size:
                self.emit([(doc, start, rest[: self.size], total)])
                start += self.size
                continue
            fits = [w for w in self.open if w[0] + len(rest) <= self.size]
            if fits:
                w = max(fits, key=lambda w: w[0])
                w[0] += len(rest)
                w[1].append((doc, start, rest, total))
                if w[0] == self.size:
                    self.open.remove(w)
                    self.emit(w[1])
                return
            if len(self.open) < self.windows:
                self.open.append([len(rest), [(doc, start, rest, total)]])
                return
            w = max(self.open, key=lambda w: w[0])
            head = rest[: self.size - w[0]]
            self.open.remove(w)
            self.emit([*w[1], (doc, start, head, total)])
            start += len(head)

    def finish(self) -> None:
        line = [p for w in self.open for p in w[1]]
        left, self.open = sum(len(p[2]) for p in line), []
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                doc, start, ids, total = line[0]
                taken.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    line[0] = (doc, start + room, ids[room:], total)
                else:
                    line.pop(0)
                room -= len(taken[-1][2])
            self.emit(taken)

    def taken(self) -> Iterator[pa.RecordBatch]:
        """The rows of what was emitted."""
        if self.rows:
            yield _batch([(*row, None, None) for row in self.rows])
            self.rows = []

    def left(self, group: int) -> Iterator[pa.RecordBatch]:
        """The rows of what is still open, with its ids, under the number of a group."""
        if self.open:
            yield _batch([(doc, start, len(ids), None, total, None, None, group, ids.astype("<u4").tobytes()) for w in self.open for doc, start, ids, total in w[1]])


#: Rows on their way: those with `_ids` are not in a sequence yet; `_group` is where they were left.
OPEN = f"{SCHEMA}, _group long, _ids binary"


COLUMNS = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in OPEN.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(COLUMNS, zip(*rows, strict=True), strict=True)], schema=COLUMNS)


def packed(docs: DataFrame, spec: str, size: int = 4096, end: int = 2, windows: int = 32, together: int = 64) -> DataFrame:
    """Packs all documents; see SCHEMA for the columns, one row for each piece. spec: the content of the tokenizer's
    JSON file. A null text counts as empty: its only id is `end`. Repeated rows are packed as often as they occur; a
    null doc_id stays null; an empty table gives no pieces. size: a power of two.

    Each partition packs what it reads, with `windows` open windows and one batch of texts in memory. The windows that
    are open at its end, `windows` at most, are merged: of `together` partitions in one task, then of as many such
    groups, until one is left. Only that one's rest is cut into powers of two, so that the number of short sequences
    doesn't depend on how many partitions there are. Only open windows are exchanged.

    sequence_id: the level of merging times 2^56, the partition's or group's number times 2^24, and a count."""

    def run(batches):
        from pyspark import TaskContext

        group = TaskContext.get().partitionId()
        tokens, packer = Tokens.of(spec), Packer(size, windows, group << 24)
        for b in batches:
            for stretch in slices(b.column(1)):
                part = b.slice(*stretch)
                ids, starts = tokens.batch(part.column(1), end)
                for k, doc in enumerate(part.column(0).to_pylist()):
                    packer.add(doc, ids[starts[k] : starts[k + 1]])
                yield from packer.taken()
            tidy()
        yield from packer.left(group)

    def merge(level: int, last: bool):
        def one(key, rows):
            group = key[0].as_py()
            packer = Packer(size, windows, (level << 56) + (group << 24))
            rows = rows.sort_by([("length", "descending"), ("_group", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
            for doc, start, total, ids in zip(*[rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "_ids")], strict=True):
                packer.add(doc, np.frombuffer(ids, "<u4"), start, total)
            if last:
                packer.finish()
            return pa.Table.from_batches([*packer.taken(), *packer.left(group)], COLUMNS)

        return one

    rows = stored(in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")), run, OPEN))
    out, level = rows.where("_ids is null").drop("_group", "_ids"), 0
    while True:
        open_ = rows.where("_ids is not null").withColumn("_next", F.floor(F.col("_group") / together))
        groups = open_.select("_next").distinct().limit(2).count()
        if not groups:
            return out
        level += 1
        rows = stored(open_.groupBy("_next").applyInArrow(merge(level, groups == 1), OPEN))
        out = out.union(rows.where("_ids is null").drop("_group", "_ids"))


def tokenizer_spec() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), tokenizer_spec())
