"""Helpers that the operators share: shared storage, tables and word hashing."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators and lower-casing of the byte-level word rule: words are runs of
#: digits, ASCII letters (lower-cased) and any byte of a non-ASCII character.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


#: Rows of an Arrow batch. Texts may be long; 10,000 of them, Spark's default, and
#: the copies that a worker makes are some 200 MB at once.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Have the session hand rows to Python workers in batches of bounded memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a session on one machine has none, as in tests, a temporary one is set;
    a cluster without one is an error, since a local folder is not shared there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        if java.isDefined():
            found = java.get().rsplit("/", 1)[0]
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, below one that is deleted when the application ends."""
    root = f"{shared_dir(spark)}/quillstream-{spark.sparkContext.applicationId}"
    fs, where = _at(spark, root)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{root}/{label}-{uuid.uuid4().hex}"


#: Bytes of a row group of a stored table, which a task holds before it is written.
ROW_GROUP = 32 << 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and
    an executor that is lost costs nothing but the tasks it was running.

    forget() deletes the table once nothing reads it; what is left goes with the
    application."""
    spark = df.sparkSession
    path = new_path(spark, label)
    # Such tables hold hashes and texts, seldom the same value twice: dictionaries
    # would only be built up and thrown away, a few MB for each column and task.
    df.write.option("parquet.enable.dictionary", "false").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        fs, where = _at(df.sparkSession, path)
        fs.delete(where, True)


#: Least bytes of input for each task of a stage; more where the session reads files in larger parts.
TASK_BYTES = 16 << 20


def task_bytes(spark: SparkSession) -> int:
    return max(TASK_BYTES, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))


def bytes_of(df: DataFrame) -> int:
    """What the optimizer expects df to hold: of a table, the size of its files; 0 where it can't tell."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else 0


def tasks_for(df: DataFrame, each: int | None = None) -> int:
    """Partitions for a shuffle of df that feeds Python: as many as its size asks
    for, and at least the session's setting."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(bytes_of(df) / (each or task_bytes(df.sparkSession))))


def compact(df: DataFrame, size_of: DataFrame | None = None) -> DataFrame:
    """df in no more partitions than the size of its source and the cores ask for,
    so that a table is not written as very many small files. No shuffle."""
    size = bytes_of(df if size_of is None else size_of)
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / task_bytes(df.sparkSession)))) if size else df


#: Bits of the filter of keys: at most 4 MB.
FILTER_BITS = 1 << 25


def bit_filter(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of keys (k1, k2), as bits; its size is bounded whatever their number."""
    n = keys.count()
    bits = 1 << 13
    while bits < min(16 * n, FILTER_BITS):
        bits <<= 1
    at = F.explode(F.array(*[F.col(k).bitwiseAND(F.lit(bits - 1)) for k in ("k1", "k2")]))
    words = keys.select(at.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out, bits


def in_filter(words: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which keys (a row of two halves each) may be in the filter."""
    at = keys & (bits - 1)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


_state: dict = {}


def worker_state(owner, make):
    """What an operator keeps in a Python worker from task to task, such as a memo.

    Workers live on and serve one operator after another; each keeps the state
    of the last one alone, and what the others held goes back to the system, so
    that memory does not add up over a pipeline.
    """
    if owner not in _state:
        let_go()
        _state[owner] = make()
    return _state[owner]


def let_go() -> None:
    """Drop every operator's state in this worker and hand free memory back."""
    _state.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
