"""What several operators share: reading, tables in the shared folder, words as arrays, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shipped

#: Words are runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


#: What Spark gathers for a Python worker before it sends it, in bytes, unless the session says otherwise.
BATCH = 4 << 20
DEFAULT_BATCH = "67108864b"


def prepared(spark: SparkSession) -> SparkSession:
    """Makes the package known to workers, and bounds what they are sent at once by bytes instead of rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(key, f"{BATCH}b")
    return shipped(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, for any caller's frame."""
    prepared(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; one of our own only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="lamina-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: its lineage is cut, its size is known to the
    optimizer, and it survives the loss of any executor. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lamina-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Logical nodes whose rows come in the same order whenever they are read.
_STEADY = {"LogicalRelation", "LogicalRDD", "Project", "Filter", "SubqueryAlias", "View", "LocalRelation", "Range"}


def _steady(plan) -> bool:
    if str(plan.nodeName()).split(" ")[0] not in _STEADY:
        return False
    below = plan.children()
    return all(_steady(below.apply(k)) for k in range(below.size()))


def numbered(docs: DataFrame) -> DataFrame:
    """_doc, all columns of a row; _row, its number. What isn't a plain scan, whose rows come in the same order each
    time, is stored first, so that a row keeps its number when the frame is read again."""
    docs = docs if _steady(docs._jdf.queryExecution().analyzed()) else stored(docs)
    return docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row"))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def apart(key: Column) -> Column:
    """A join key of the same value classes as `key` that the planner doesn't take for it: both sides of the join get
    an exchange of their own, so that adaptive execution can split a hot key's partitions."""
    return F.xxhash64(key, F.lit("apart"))


def slices(texts: pa.Array, size: int = 4 << 20, *more: pa.Array) -> Iterator[tuple[int, int]]:
    """(begin, length) of stretches of an array of texts (or several in step) with about `size` bytes each; a longer
    text has its own."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (texts, *more)))
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
        yield begin, end - begin
        begin = end


def tidy() -> None:
    """Gives freed memory back to the system. Python workers live on from stage to stage; what one stage has freed
    would still count against the executor in the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Words:
    """The words of an array of texts: `codes` into `vocabulary`, `counts` words for each text, in order."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not filled.all():
            counts = np.bincount(np.repeat(np.arange(len(texts)), counts)[filled], minlength=len(texts)).astype(np.int64)
            flat = flat.filter(pa.array(filled))
        coded = flat.dictionary_encode()
        self.vocabulary: pa.Array = coded.dictionary
        self.codes: np.ndarray = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts: np.ndarray = counts
        self.starts: np.ndarray = np.concatenate(([0], np.cumsum(counts)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each entry of the vocabulary, the same in every process."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a fixed bijection that scatters the bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]]; 0 for empty segments."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[starts[1:]] - total[starts[:-1]]


def label_share(labels: DataFrame, label: str, eligible: Column | None = None) -> float:
    """The share of label 1 among all rows with a 0 or a 1; a half, if there are none."""
    own = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("_y")).where("_y in (0, 1)")
    share = (own if eligible is None else own.where(eligible)).agg(F.avg("_y")).first()[0]
    return 0.5 if share is None else float(share)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, eligible: Column | None = None, longest: int = 30_000) -> list[tuple[str, int]]:
    """Whole texts of at most `most` labelled documents of each class, (text, 0 or 1), the same ones each time: those
    whose ids hash lowest. Conflicting labels of one id are left out, as are texts of over `longest` characters, so that
    what reaches the driver is bounded.
    eligible: a condition on `doc_id`. The ids picked are at most 2 * most, so that they may be broadcast."""
    own = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("_y")).where("doc_id is not null and _y in (0, 1)")
    own = own.groupBy("doc_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z")
    if eligible is not None:
        own = own.where(eligible)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [(r["doc_id"], r["_y"]) for y in (0, 1) for r in own.where(F.col("_y") == y).orderBy(*order).limit(most).select("doc_id", "_y").collect()]
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, _y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.length("text") <= longest)
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    return list(zip(rows.column("text").to_pylist(), rows.column("_y").to_pylist(), strict=True))
