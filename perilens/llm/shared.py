"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII punctuation that is cut from both ends of a word where words are compared loosely.
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Odd multiplier of the rolling hashes (the 64-bit golden ratio).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or that of ``setCheckpointDir``; without either there is no shared folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-")  # one machine, as in tests
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def ascii_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def tidy() -> None:
    """Gives freed memory back to the system, so that a Python worker that waits for its next task is small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; nothing depends on it
        pass


def tidied(run: Callable) -> Callable:
    """A function over a task's batches whose own memory, caches included, goes back when the task ends."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return task


class WordHash(dict):
    """Word to 64-bit hash, remembered for the words that recur: up to ``most`` of at most 64 bytes, then it forgets all."""

    def __init__(self, most: int = 100_000, loose: bool = False):
        super().__init__()
        self.most, self.loose = most, loose

    def __missing__(self, word: bytes) -> int:
        if self.loose:
            text = word.decode("utf-8", "replace").strip(EDGE).lower()
            value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7) if text else 0
        else:
            value = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` word hashes; for fewer words, one for the whole run."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    last = len(hashes) - width + 1
    out = np.full(last, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ hashes[i : i + last]) * GOLDEN
            out ^= out >> np.uint64(29)
    return out


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Groups:
    """Union-find over 0..n-1 whose root is the smallest member; takes links as arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(self.parent, up := self.parent[self.parent]):
            self.parent = up
        return self.parent

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            a, b = roots[a], roots[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
