"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the ASCII controls 9 to 13.
GAP = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a temporary folder takes its place if everything runs in one process, as in tests; a
    cluster must have it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _local[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


Batches = Iterator[pa.RecordBatch]


def freeing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, giving memory back to the system at a task's end.

    Workers serve one task after another, of all stages; what their allocators keep would add up beside the executor's heap.
    """

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    # glibc only; other C libraries give memory back on their own.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is many times faster than numpy's hash table for whole numbers."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) > 1 else ordered


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``.

    The optimizer may inline a projected column into a lambda and evaluate it once an element; a lambda variable is
    evaluated once a row.
    """
    return F.transform(F.array(value), body)[0]


#: Document ids that are broadcast at most (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` names by doc_id or, where it has a ``mark`` (xxhash64 of the text), by both.

    Rows with a null id stay.
    """
    gone = written(gone.distinct(), "dropped")
    few = gone.count() <= BROADCAST_IDS
    gone = gone.withColumnsRenamed({c: f"_gone_{c}" for c in gone.columns})
    same = F.col("doc_id") == F.col("_gone_doc_id")
    if "_gone_mark" in gone.columns:
        same &= F.xxhash64("text") == F.col("_gone_mark")
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti").select(*docs.columns)
