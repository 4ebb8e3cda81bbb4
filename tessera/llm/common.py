"""Shared pieces: the shared work folder, written intermediate tables, words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shared import shared_dir

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of 16 MB between Spark and Python, if the session says nothing of its own: texts are long."""
    if spark.conf.get(BATCH) == "67108864b":  # Spark's default
        spark.conf.set(BATCH, "16m")


class Work:
    """Written tables of one operator run, under the shared folder.

    ``cut`` writes a DataFrame as Parquet and reads it back: lineage ends there
    and a lost executor costs no more than the tasks that it ran.  ``drop``
    removes a table that nothing needs any more; the rest goes when the
    application ends, because returned DataFrames still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        small_batches(spark)
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch
            if name:
                raise


_held: dict = {}


def held(key, make):
    """What a Python worker keeps over batches and tasks, made at first use: one object only, so that a
    worker that serves one operator after another doesn't gather what each of them keeps."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    if _held:
        _held.clear()
        give_back()


def give_back() -> None:
    """Hands memory that nothing uses any more back to the machine: workers live on from operator to operator."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    values = batch.column(column).cast(pa.binary()).to_pylist()
    return [v or b"" for v in values]


def words_of(texts, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a string array: each text's number of words ``[^\\x20\\x09-\\x0D]+`` (null: none), the
    words of all texts end to end as indices, and the distinct words that these point to."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    lens = np.asarray(pc.fill_null(pc.list_value_length(split), 0)).astype(np.int64)
    flat = pc.list_flatten(split)
    full = np.asarray(pc.not_equal(flat, ""))
    if not full.all():  # white space at either end leaves an empty string
        at = np.concatenate([[0], np.cumsum(full)])
        ends = np.cumsum(lens)
        lens = at[ends] - at[ends - lens]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return lens, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashes_of(words) -> np.ndarray:
    return hash_words(words.cast(pa.binary()).to_pylist())


def words_lower(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: bytes methods do just that."""
    return text.lower().split()


def hash_words(words: list[bytes]) -> np.ndarray:
    release()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; empty if there are fewer."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out + words[i : len(words) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return out


def slices_of(texts: pa.Array, most: int = 4_000_000):
    """The same array in slices of at most `most` bytes of text, one text at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).tolist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield texts.slice(start)


def slices(texts: list[bytes], most: int = 4_000_000):
    """(from, to) ranges of at most `most` bytes of text, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)

