"""What the training-data operators share: word codes, batches, checkpoints.

Words are runs of bytes other than space and U+0009..U+000D.  That is exactly
what ``bytes.split()`` yields on UTF-8, so texts travel as binary columns and
are never decoded where only words count.
"""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on bytes; everything else stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Odd 64-bit multipliers of the rolling hashes (fixed values).
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


class WordCodes(dict):
    """Word bytes to 64-bit codes; a bounded memo in each worker, the same codes everywhere."""

    LIMIT = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORD_CODES = WordCodes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_B
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_C
    return x ^ (x >> np.uint64(31))


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k codes, in order; empty if there are fewer codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix((out + codes[i : i + n]) * MIX_A + np.uint64(i + 1))
    return out


def binary_text(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Keys, then the text as UTF-8 bytes; a null text is empty."""
    return df.select(*keys, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def binaries(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose values in a column have about so many bytes together; no rows, no slices.

    What a task makes of its texts then depends on the slice and not on the batch.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = min(batch.num_rows, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "left")) + 1)
        yield batch.slice(at, end - at)
        at = end


@functools.cache
def _libc():
    try:
        found = ctypes.CDLL("libc.so.6")
        found.mallopt(-3, 16 << 20)  # larger arrays get pages of their own, which go back when freed
        found.mallopt(-1, 256 << 20)  # the rest goes back when asked for, not with each free
        pa.set_memory_pool(pa.system_memory_pool())
        return found
    except (OSError, AttributeError):  # another C library: freed memory stays with the worker
        return None


def trimmed(result=None):
    """The result, after memory that this worker has freed went back to the system."""
    if libc := _libc():
        libc.malloc_trim(0)
    return result


def lean(items: Iterable) -> Iterator:
    """The items; now and then, and after the last, memory that this worker has freed goes back to the system."""
    _libc()
    for i, x in enumerate(items):
        yield x
        del x
        if i % 8 == 7:
            trimmed()
    trimmed()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a test folder if it is unset in local mode."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spanforge-')}")
        found = context._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table has not."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


class Scratch:
    """Intermediate tables in the shared folder; they survive lost executors and cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self, *done: DataFrame) -> None:
        """Deletes tables of this object that nothing reads any more."""
        context = self.spark.sparkContext
        own = self.root.rsplit("/", 1)[-1]
        for folder in {f.rsplit("/", 1)[0] for df in done for f in df.inputFiles()}:
            if f"/{own}/" in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def free(self, *done: DataFrame) -> None:
        """Deletes tables of this object that nothing reads any more, and lets Spark remove shuffles of finished steps.

        Spark drops a shuffle's files when the driver's garbage collector finds it
        unused, which may otherwise not happen before a query ends.  What Python has
        let go of reaches the driver's JVM within a second, so that is waited for.
        """
        import gc
        import time

        self.discard(*done)
        for wait in (1.2, 0.2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(wait)
