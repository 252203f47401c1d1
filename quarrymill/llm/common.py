"""What the operators of this subpackage share: written intermediate tables, guarded broadcasts, columns."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space that separates words: U+0009 to U+000D and U+0020. ``bytes.split()`` splits on the same six.
SPACES = b"\t\n\x0b\x0c\r "
#: A filter side of at most this many (long id) rows may be broadcast: 16 bytes each, 16 MB. Larger ones are shuffled.
BROADCAST_IDS = 1_000_000
#: Bytes of a batch that goes to a Python worker, about, and rows of a batch that is read from Parquet.
BATCH_BYTES, READ_ROWS = 2 << 20, 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; where that is unset (tests on one
    machine) a folder of this driver, which is then set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quarrymill.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.conf.set("spark.quarrymill.shared.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bounds what Spark hands to a Python worker at once by bytes, and the rows that it reads from Parquet at once, so that batches
    of long texts take no more memory. Session settings; ones that are already lower stay."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if int("".join(c for c in spark.conf.get(name, "2147483647") if c.isdigit()) or 0) > most:
            spark.conf.set(name, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: its lineage ends there, so a lost executor costs only the
    tasks that run, and what it was made from can be freed."""
    spark = df.sparkSession
    small_batches(spark)
    df.write.parquet(path := fresh_dir(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of tables that were written and are referred to no more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep_ids(df: DataFrame, ids: DataFrame, key: str, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of df whose key is in ids (one column, distinct). ids are broadcast only if a count shows that they are few;
    else both sides are shuffled."""
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text ('' for null), and no other column but those asked for: extra columns can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def trim() -> None:
    """Gives memory that this process has freed back to the system, where the C library can: workers live on between tasks."""
    if _TRIM:
        _TRIM(0)


class Bounded(dict):
    """A cache of computed values: forgets all when it holds `most`."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.make(key)
        return out


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None
pa.set_memory_pool(pa.system_memory_pool())  # so that trim() reaches Arrow's buffers, too

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 (public domain): a bijection of 64-bit numbers in which every bit depends on every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def set_env() -> None:
    """Threads: one for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


_KEPT: dict = {}


def kept_in_worker(make, *args):
    """make(*args), once for each Python worker: later tasks of the worker use it again, with what it has cached. The last
    one made is kept."""
    key = (make.__qualname__, *(hash(a) for a in args))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(*args)
    return _KEPT[key]


def forget() -> None:
    """Frees what kept_in_worker() keeps, in a task of a stage that needs none of it: workers live on between stages."""
    _KEPT.clear()
    trim()


def dropped(*tables: DataFrame, release: bool = True) -> None:
    """Deletes the folders of tables that written() made, which nothing reads any more; with release, frees what made them, too
    (a garbage collection on the driver, worth it for large ones)."""
    for table in tables:
        if path := getattr(table, "written_to", None):
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    if tables and release:
        free(tables[0].sparkSession)


class WordHashes:
    """64-bit hashes of words: two independent streams, remembered for words seen before."""

    def __init__(self, most: int = 150_000):
        import xxhash

        self.of = Bounded(xxhash.xxh3_64_intdigest, most)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of.__getitem__, words), np.uint64, len(words))


def arrays(column: pa.Array) -> list[np.ndarray | None]:
    """The lists of an Arrow list column as numpy arrays over shared memory."""
    flat, at, there = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_pylist()
    return [flat[a:b] if ok else None for a, b, ok in zip(at[:-1], at[1:], there)]
