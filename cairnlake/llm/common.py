"""Shared pieces: written intermediate tables, Arrow batches as byte arrays, vectorised hashing of words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bounded  # noqa: F401

U64 = np.uint64
_OWN: list[str] = []
_WRITTEN: list[str] = []

#: Rows and text bytes handled at once by a Python worker; one longer text is handled alone.
SHARD_BYTES = 2 << 20
SHARD_ROWS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only in local mode, where it may be unset, a temporary one."""
    if path := spark.conf.get("spark.checkpoint.dir", ""):
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="cairnlake-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def new_folder(spark: SparkSession, kind: str = "t") -> str:
    """A path in the shared folder that nothing has used; drop_written() deletes it."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors cost nothing. See discard()."""
    path = new_folder(bounded(df).sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables that written() has returned, or folders of new_folder(), which nothing will read again."""
    for t in tables:
        path = t if isinstance(t, str) else t.written_path
        _WRITTEN.remove(path)
        _delete(spark, path)


def drop_written(spark: SparkSession) -> None:
    """Deletes all that is left of this session's written() tables; call it when no result that reads them is needed any more."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame, **more) -> DataFrame:
    """All columns of docs, whatever they are called, in the struct `_row`, and the columns `more` beside it. See uncarried()."""
    return bounded(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(name) for name, c in more.items()])


def uncarried(df: DataFrame, columns: list[str], **instead) -> DataFrame:
    """The columns that carried() has put into `_row`, some of them replaced."""
    return df.select(*[instead[c].alias(c) if c in instead else F.col(f"_row.`{c}`").alias(c) for c in columns])


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators read; whatever else the table holds is ignored."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as UTF-8 bytes and row offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, ends, data = col.buffers()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(ends, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if ends else np.zeros(len(col) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


#: What workers keep from task to task, by operator, and how to drop it.
_HELD: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Gives freed memory back to the system, as a worker waits between its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries without it
        ctypes.CDLL(None).malloc_trim(0)


def relieve(spark: SparkSession) -> None:
    """Gives back what the driver, Python and JVM, holds without need: garbage, broadcasts that nothing refers to, free pages.

    A JVM lets its heap grow up to its limit before it does so by itself."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def past_driver(spark: SparkSession) -> Iterator[None]:
    """Joins that are run inside are broadcast only where a hint says so: the driver builds each broadcast table in pages of its own
    heap, in a thread that then stays for a minute, and a plan of many joins of small tables has many at once."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        yield
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def hold(name: str, drop: Callable[[], None]) -> None:
    _HELD[name] = drop


def release(but: str = "") -> None:
    """Drops what other operators have left in this worker, which outlives its tasks."""
    for name in [n for n in _HELD if n != but]:
        _HELD.pop(name)()


def shards(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SHARD_BYTES, rows: int = SHARD_ROWS, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most so many text bytes and rows (or one row)."""
    release(keep)
    for b in batches:
        _, off = flat(b.column(column))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(off, off[at] + most, "right")) - 1
            to = min(max(to, at + 1), at + rows, b.num_rows)
            yield b.slice(at, to - at)
            at = to
    trim()


def byte_table(word: bytes) -> np.ndarray:
    """A table from byte to word byte (A-Z lower-cased), 0 for separators; word: the ASCII bytes of words. Other bytes belong to words."""
    t = np.zeros(256, np.uint8)
    for c in range(256):
        low = c + 32 if 65 <= c <= 90 else c
        if c >= 128 or low in word:
            t[c] = low
    return t


#: Words [0-9a-z and beyond ASCII], and words between ASCII white space (a NUL byte stands for 1 there, as 0 marks separators).
ALNUM = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz")
SPACED = byte_table(bytes(c for c in range(1, 128) if c not in b" \t\n\x0b\x0c\r"))
SPACED[0] = 255


def words(buf: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, first): word i is low[starts[i]:ends[i]]; the words of row r are first[r]:first[r + 1]."""
    low = lut[buf]
    inside = low != 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    at = off[:-1]
    at = at[at < len(buf)]
    opens[at] = inside[at]
    before = at[at > 0] - 1
    closes[before] = inside[before]
    starts = np.flatnonzero(opens)
    return low, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: What is left of eight bytes where a span has only so many; a step between the pieces of one span.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_STEP = U64(0x9E3779B97F4A7C15)


def span_hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, check: bool = False):
    """64-bit hashes of low[start:end], independent of place; no byte of a span is 0.

    Spans of up to 8 bytes are mixed as they are, so no two of them collide. Longer ones add up their 8-byte pieces, each mixed with
    its number before, so no pattern of equal pieces cancels out. check: also a second sum of the pieces, not mixed, to tell collisions."""
    data = np.zeros(len(low) + 8, np.uint8)
    data[: len(low)] = low
    eight = np.ndarray(len(low) + 1, "<u8", data, strides=(1,))  # at every byte
    n = ends - starts
    first = eight[starts] & _FIRST[np.minimum(n, 8)]
    h = mix(first + _STEP)
    plain = first
    long = np.flatnonzero(n > 8)
    if len(long):
        count = (n[long] + 7) >> 3
        head = np.cumsum(count) - count
        inner = np.arange(int(count.sum())) - np.repeat(head, count)
        at = np.repeat(starts[long], count) + 8 * inner
        piece = eight[at] & _FIRST[np.minimum(np.repeat(ends[long], count) - at, 8)]
        number = inner.astype(U64)
        h[long] = mix(np.add.reduceat(mix(piece + (number + U64(2)) * _STEP), head) + n[long].astype(U64))
        if check:
            plain[long] = np.add.reduceat(piece * (U64(2) * number + U64(1)), head) + (n[long].astype(U64) << U64(40))
    return (h, plain) if check else h


#: Odd multipliers for hashes of sequences.
ODD = mix(np.arange(1, 65, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def ranges(docs: DataFrame, each: int = 64 << 20) -> int:
    """How many ranges to sort docs into: as many as shuffles have partitions, and more if one would hold over `each` bytes of what is read."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, size // each if size < 1 << 60 else 0)


def in_memory(n_rows: int, most: int = 2_000_000) -> bool:
    """Whether a table of so many ids (16 bytes each) is small enough to be broadcast."""
    return n_rows <= most
