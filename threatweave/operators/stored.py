"""Library tables that are stored in buckets: an upsert reads and writes the buckets of its keys and no others.

A folder holds generations of buckets and a log. An upsert writes the buckets it touches as a new generation and then appends
one row to the log, which names the generation and its buckets; a bucket's rows are those of the newest generation that the
log names for it. A job that fails before that row leaves the table as it was. One writer at a time; readers see the log
that was there when they began.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 64
LOG = "seq long, buckets array<int>, n_buckets int, columns string, keys array<string>"


def bucket(keys: list[str], n: int) -> Column:
    """A row's bucket; nulls count as empty texts."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(n)).cast("int")


def _log(spark: SparkSession, folder: str) -> list:
    return sorted(spark.read.schema(LOG).parquet(f"{folder}/log").collect(), key=lambda r: r["seq"])


def _commit(spark: SparkSession, folder: str, row: tuple) -> None:
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def _write(rows: DataFrame, keys: list[str], n: int, path: str) -> None:
    # A bucket is written by four tasks at most, so a large one isn't one task's.
    cut = rows.withColumn("_bucket", bucket(keys, n))
    cut.repartition("_bucket", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(4))).write.partitionBy("_bucket").parquet(path)


def create(rows: DataFrame, keys: list[str], folder: str, buckets: int = BUCKETS) -> None:
    _write(rows, keys, buckets, f"{folder}/generation-1")
    _commit(rows.sparkSession, folder, (1, list(range(buckets)), buckets, rows.schema.json(), keys))


def _newest(log: list) -> dict[int, list[int]]:
    """The buckets that each generation is the newest of."""
    owner: dict[int, int] = {}
    for r in log:
        owner |= dict.fromkeys(r["buckets"], r["seq"])
    out: dict[int, list[int]] = {}
    for b, seq in sorted(owner.items()):
        out.setdefault(seq, []).append(b)
    return out


def read(spark: SparkSession, folder: str, only: list[int] | None = None) -> DataFrame:
    """The table as it is, or some of its buckets."""
    log = _log(spark, folder)
    schema = StructType.fromJson(json.loads(log[0]["columns"]))
    full = StructType([*schema.fields, StructField("_bucket", IntegerType())])
    out = spark.createDataFrame([], schema)
    for seq, buckets in _newest(log).items():
        wanted = [b for b in buckets if only is None or b in only]
        if wanted:
            out = out.unionByName(spark.read.schema(full).parquet(f"{folder}/generation-{seq}").filter(F.col("_bucket").isin(wanted)).drop("_bucket"))
    return out


def upsert(changes: DataFrame, folder: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[int]:
    """Put ``changes`` into the table and tell which buckets were rewritten.

    ``merge(current, changes)`` gets the touched buckets' rows and gives what they become; without it, rows of the same
    key are replaced. At most one number a bucket comes to the driver.
    """
    spark = changes.sparkSession
    log = _log(spark, folder)
    keys, n = list(log[0]["keys"]), log[0]["n_buckets"]
    touched = sorted(r["b"] for r in changes.select(bucket(keys, n).alias("b")).distinct().collect())
    if not touched:
        return []
    current = read(spark, folder, touched)
    if merge is None:
        same = [current[k].eqNullSafe(changes[k]) for k in keys]
        both = current.join(changes, same, "left_anti").unionByName(changes.select(current.columns))
    else:
        both = merge(current, changes).select(current.columns)
    seq = log[-1]["seq"] + 1
    _write(both, keys, n, f"{folder}/generation-{seq}")
    _commit(spark, folder, (seq, touched, n, log[0]["columns"], keys))
    return touched


def remove(gone: DataFrame, folder: str) -> list[int]:
    """Drop the rows of the given keys."""
    keys = list(_log(gone.sparkSession, folder)[0]["keys"])
    return upsert(gone, folder, lambda current, g: current.join(g.select(keys).distinct(), [current[k].eqNullSafe(g[k]) for k in keys], "left_anti"))


def compacted(spark: SparkSession, folder: str) -> None:
    """All buckets as one generation."""
    log = _log(spark, folder)
    seq, n = log[-1]["seq"] + 1, log[0]["n_buckets"]
    _write(read(spark, folder), list(log[0]["keys"]), n, f"{folder}/generation-{seq}")
    _commit(spark, folder, (seq, list(range(n)), n, log[0]["columns"], list(log[0]["keys"])))
