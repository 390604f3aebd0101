"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def crc_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


#: Bytes of an Arrow batch that goes to a Python worker, whatever the number of its rows; one longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such call the allocator keeps it
        ctypes.CDLL(None).malloc_trim(0)


def map_stream(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches that are bounded by bytes; what a task has freed goes back to the system at its end.

    The bound is the session's, as Spark reads it when the plan runs; a lower one that is set already stays.
    """
    conf = df.sparkSession.conf
    size = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get(_BATCH_BYTES_KEY).strip().lower())
    if size is None or int(size[1]) << (10 * " kmgt".index(size[2] or " ")) > BATCH_BYTES:
        conf.set(_BATCH_BYTES_KEY, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, done: Callable[[], None] | None = None) -> DataFrame:
    """One output batch for each input batch; memory is bounded by a batch. ``done`` runs at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                if b.num_rows:
                    yield fn(b)
        finally:
            if done:
                done()

    return map_stream(df, run, schema)


_OWN: dict[str, str] = {}  # folders by application


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share; one of our own where it is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="eventloom-checkpoint-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        return _OWN[app]
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Parquet tables in the shared folder that cut the lineage and go when the block ends: smaller than checkpoints."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
