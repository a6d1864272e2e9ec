"""Byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, read

#: The GPT-2 pre-tokenization pattern (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Between a visible ASCII character and a blank, no match of the pattern goes on: what follows starts a new one.
BOUNDARY = re.compile(r"(?<=[!-~])(?=[ \n])")

#: Long runs of white space, by Unicode's White_Space as the library's pattern has it (fixed values). The library's
#: regex takes as many steps back as such a run is long, and gives up near a million.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def parts(text: str, size: int = 1 << 16) -> Iterator[tuple[str, bool]]:
    """`text` in parts, and whether a part is one match of the pattern by itself. Encoding each part alone gives the ids
    of the whole. Parts have about `size` characters and are cut at safe boundaries only; where there is none, a part
    gets as long as it has to. A long run of white space is a part of its own: all of it at the text's end, all but the
    last character before something visible, which that character may belong to."""
    at = 0
    for run in BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((x, False) for x in pieces(text, size, at, run.start()))
        yield text[run.start() : end], True
        at = end
    yield from ((x, False) for x in pieces(text, size, at))


def pieces(text: str, size: int = 1 << 16, at: int = 0, end: int | None = None) -> Iterator[str]:
    """`text` from `at` to `end` in parts of about `size` characters, cut at safe boundaries only."""
    end = len(text) if end is None else end
    while end - at > size:
        cut = BOUNDARY.search(text, at + size, end)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if end > at:
        yield text[at:end]


class Codec:
    """The tiktoken library over a rank table. Built once in each worker."""

    _made: dict[tuple[int, str], Codec] = {}

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        table = parse_ranks(ranks)
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        #: For parts that are one match already: matches everything.
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=table, special_tokens={})
        self.cuts = pattern == PATTERN

    @classmethod
    def of(cls, ranks: bytes, pattern: str = PATTERN) -> Codec:
        key = hash(ranks), pattern
        if key not in cls._made:
            cls._made[key] = cls(ranks, pattern)
        return cls._made[key]

    def encode(self, text: str) -> np.ndarray:
        """Texts are cut only where that is known to be safe, under PATTERN; others are encoded whole."""
        if not self.cuts or len(text) < 4096:
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        found = [(self.whole if one else self.encoding).encode_to_numpy(p, disallowed_special=()) for p, one in parts(text)]
        return np.concatenate(found).astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


def encoded(docs: DataFrame, ranks: bytes, pattern: str = PATTERN, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, then ids array<int>: each whole text as the tiktoken library encodes it without special tokens.
    A null text counts as empty and gives no ids. One row in, one row out; nothing is shuffled. ranks: the content of
    a .tiktoken file, read on the driver, so that executors need no file of their own."""

    def run(batches):
        codec = Codec.of(ranks, pattern)
        for b in batches:
            ids = [codec.encode(t or "") for t in b.column(len(keep)).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.ListArray.from_arrays(offsets, flat)], [*keep, "ids"])

    own = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return in_arrow(own, run, f"{schema}, ids array<int>")


def decoded(rows: DataFrame, ranks: bytes, pattern: str = PATTERN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, then bytes binary: the raw bytes of each row's `ids`; null ids give null."""

    def run(batches):
        codec = Codec.of(ranks, pattern)
        for b in batches:
            raw = [None if x is None else codec.decode(np.asarray(x, np.uint32)) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(raw, pa.binary())], [*keep, "bytes"])

    own = rows.select(*[F.col(c) for c in keep], "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return in_arrow(own, run, f"{schema}, bytes binary")


def digests(docs: DataFrame, ranks: bytes, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text: encodes, then decodes the ids, in one pass that
    keeps one document's ids at a time, so that neither ids nor bytes travel. One row in, one row out: a null text
    counts as empty, whose digests are those of no bytes; repeated rows and null ids stay; an empty table gives none."""

    def run(batches):
        codec = Codec.of(ranks, pattern)
        for b in batches:
            n, one, two = [], [], []
            for t in b.column(1).to_pylist():
                ids = codec.encode(t or "")
                n.append(len(ids))
                one.append(hashlib.sha256(ids.tobytes()).hexdigest())
                two.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return digests(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
