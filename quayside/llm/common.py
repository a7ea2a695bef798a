"""Shared pieces of the training-data operators: scratch tables, Arrow access, vectorised tokenising and hashing.

Everything that works on text here works on UTF-8 bytes held in one numpy buffer for a bounded chunk of whole documents,
so memory is set by the chunk size (or by the longest single document) and not by the partition.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are expanded into numpy arrays at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18
#: Most rows that any operator here broadcasts; larger sides are shuffled instead.
BROADCAST_ROWS = 500_000


# --- session and scratch ------------------------------------------------------------------------------------------


def tune(spark: SparkSession, megabytes: int = 2) -> None:
    """Bound the Arrow batches that Python workers receive by bytes, as documents vary in length by orders of magnitude. A bound that
    the session has of its own is left. It stays set, since results are lazy plans that run later."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(1 << 26), "64MB", str((1 << 63) - 1), "-1"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


#: Folders of intermediate tables that this process has made.
_folders: list[str] = []


def scratch_folders() -> list[str]:
    return list(_folders)


def remove_folders(spark: SparkSession, folders: list[str]) -> None:
    """Remove intermediate tables, when what was computed from them is written or no longer wanted."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _folders:
            _folders.remove(folder)


def unused(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` doesn't have."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name += "_"
    return name


class Scratch:
    """Intermediate tables of one operator call, in the folder that all executors share.

    The folder is ``spark.checkpoint.dir``; only where Spark runs in one process and names none (tests), a temporary one is used.
    Tables are plain Parquet, so they outlive lost executors and cut the lineage of what reads them. Results are lazy plans over
    them, so they stay until :func:`remove_folders`.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = os.path.join(tempfile.gettempdir(), "quayside")
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _folders.append(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing will read again."""
        remove_folders(self.spark, [f"{self.root}/{name}" for name in names])

    def settle(self) -> None:
        """Collect garbage on the driver: Spark removes the shuffle files of what is written only when their plans are collected,
        which on a driver with little to do can take longer than the whole call."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()


def sized(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` only if its counted rows are at most ``most``; otherwise the join shuffles."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def give_back() -> None:
    """Return freed memory to the system."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back at the end of a task: idle workers live on and would hold it."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


# --- Arrow --------------------------------------------------------------------------------------------------------


def byte_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunked(docs: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together."""
    lo = total = 0
    for i, doc in enumerate(docs):
        if total and total + len(doc) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(doc) + 1
    if lo < len(docs):
        yield lo, len(docs)


# --- hashing ------------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted: by sorting, which on large arrays of integers is many times faster than numpy's hash table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64; kept, up to a bound, between calls."""
    out = []
    for i, base in enumerate((_BASE, _INVERSE)):
        p = _POWERS[i]
        while len(p) < n:
            p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
        if len(p) <= 1 << 21:
            _POWERS[i] = p
        out.append(p[:n])
    return out[0], out[1]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` gets the hash of any span of ``codes`` (64-bit values)."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal content gives equal hashes wherever it stands."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


# --- words --------------------------------------------------------------------------------------------------------

#: ASCII lower-casing as a byte table.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, ASCII letters (after lower-casing) and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Bytes of tokens: all but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


class Words:
    """The words of a chunk of documents: where they stand, which document they belong to, and their 64-bit hashes.

    Documents are joined by a space, which no word holds. ``first[d]:first[d + 1]`` are the words of document ``d``.
    """

    def __init__(self, docs: list[bytes], kind: np.ndarray = WORD) -> None:
        self.buffer = LOWER[np.frombuffer(b" ".join([b"", *docs, b""]), np.uint8)]
        self.begin = np.cumsum([1, *(len(x) + 1 for x in docs)])
        edge = np.flatnonzero(np.diff(kind[self.buffer].view(np.int8)))
        self.start, self.end = edge[0::2] + 1, edge[1::2] + 1
        self.hash = span_hash(prefix_hash(_BYTE[self.buffer]), self.start, self.end)
        self.first = np.searchsorted(self.start, self.begin)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(docs)), self.count)

    def __len__(self) -> int:
        return len(self.start)


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a document and the document of each. A document of fewer words, but not
    none, has its whole word sequence as its only shingle; one of no words has none."""
    h, doc = words.hash, words.doc
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = max(0, len(h) - n + 1)
    key = np.zeros(full, np.uint64)
    for j in range(n):
        key = key * U(0xC2B2AE3D27D4EB4F) + h[j : j + full]
    inside = doc[:full] == doc[n - 1 : n - 1 + full]
    key, owner = mix(key[inside] + U(n)), doc[:full][inside]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = words.count[short] > j
            extra[has] = extra[has] * U(0xC2B2AE3D27D4EB4F) + h[words.first[short[has]] + j]
        key = np.concatenate([key, mix(extra + words.count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        key, owner = key[order], owner[order]
    return key, owner


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions ``s, s + 1, .. s + n - 1`` of each (s, n), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total)
