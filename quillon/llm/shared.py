"""Work folders and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space as every contract of this subpackage defines it: space, tab, LF, VT, FF, CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a new local one is set if all
    runs in one process; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Bytes of an Arrow batch between Spark and a Python worker, at most (or one row).
BATCH_BYTES = 4_000_000
_BATCH_KEY, _CLEAN_KEY = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The worker's caches by operator: how to forget them.
_CACHES: dict[str, Callable[[], None]] = {}


def cache_of(operator: str, forget: Callable[[], None]) -> None:
    """Names a cache that a worker keeps between tasks of ``operator``; it goes when the worker turns to another one."""
    _CACHES[operator] = forget


def forget_others(operator: str) -> None:
    for name in [n for n in _CACHES if n != operator]:
        _CACHES.pop(name)()


def release() -> None:
    """Gives freed memory of this worker back to the machine, since Spark keeps idle workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, operator: str, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes, for workers that hold little memory once a task has ended."""
    conf = df.sparkSession.conf
    if not 0 < _bytes(conf.get(_BATCH_KEY)) <= BATCH_BYTES:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))

    def held(batches):
        forget_others(operator)
        yield from run(batches)
        release()

    return df.mapInArrow(held, schema)


def _bytes(text: str) -> int:
    """A size of Spark's settings, as 4m or 67108864b, in bytes."""
    text = text.strip().lower().removesuffix("b")
    return int(float(text[:-1]) * 1024 ** ("kmgt".index(text[-1]) + 1)) if text[-1:] in "kmgt" and text else int(text or 0)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting for the queries that run inside, where this Spark knows it."""
    before = spark.conf.get(key, None)
    if before is None:
        yield
        return
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffles_cleaned(spark: SparkSession):
    """Shuffle files of the queries that run inside go as soon as each has ended: what they made is a written table."""
    return setting(spark, _CLEAN_KEY, "true")


class Work:
    """A folder of one operator run below the shared folder. Tables written here cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str, by: list[str] | None = None) -> tuple[DataFrame, str]:
        """Writes ``df`` as Parquet and returns it reread, with its path."""
        path, writer = self.path(name), df.write
        with shuffles_cleaned(self.spark):
            (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def whole(col) -> object:
    """A text column with null read as the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
