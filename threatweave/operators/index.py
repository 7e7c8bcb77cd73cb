"""A stored trigram index: postings in buckets, with appends and deletions, that a search reads in part.

A folder holds segments, each a table of postings (trigram, id, seq) in folders by bucket, and a log of commits. A
commit appends one row to the log after its segment is written, so what a lost or failed job leaves behind is never read.
Changed and deleted ids are written as marks (id, seq): postings before an id's latest mark are dead. ``compacted`` writes what
lives as one segment. Appends by one writer at a time; readers see the commits that were there when they began.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .search import trigrams

#: Buckets of an index: a trigram's bucket is its CRC-32 by their number, which driver and tasks compute alike.
BUCKETS = 64
LOG = "seq long, kind string, path string, buckets int"


def _log(spark: SparkSession, folder: str) -> list:
    try:
        rows = spark.read.schema(LOG).parquet(f"{folder}/log").collect()
    except AnalysisException:
        return []
    rows = sorted(rows, key=lambda r: r["seq"])
    start = max((k for k, r in enumerate(rows) if r["kind"] == "base"), default=0)
    return rows[start:]


def _commit(spark: SparkSession, folder: str, seq: int, kind: str, path: str, buckets: int) -> None:
    spark.createDataFrame([(seq, kind, path, buckets)], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def _segment(postings: DataFrame, path: str, buckets: int) -> None:
    """Postings by bucket; a bucket is dealt by trigram, so that a frequent trigram's files are written by one task and others'
    beside it."""
    cut = postings.withColumn("bucket", F.crc32(F.col("trigram").cast("binary")) % buckets)
    cut.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "trigram", "id").write.partitionBy("bucket").parquet(path)


def _next(log: list) -> int:
    return log[-1]["seq"] + 1 if log else 1


def create(rows: DataFrame, id_col: str, text_col: str, folder: str, buckets: int = BUCKETS) -> None:
    """A new index of all texts."""
    path = f"{folder}/segment-1"
    _segment(trigrams(rows, id_col, text_col).withColumn("seq", F.lit(1).cast("long")), path, buckets)
    _commit(rows.sparkSession, folder, 1, "base", path, buckets)


def put(rows: DataFrame, id_col: str, text_col: str, folder: str) -> None:
    """New rows, and new texts of known ids: earlier postings of their ids die."""
    spark = rows.sparkSession
    log = _log(spark, folder)
    seq, buckets = _next(log), log[0]["buckets"]
    path = f"{folder}/segment-{seq}"
    rows.select(F.col(id_col).alias("id"), F.lit(seq).cast("long").alias("seq")).distinct().write.parquet(f"{path}-marks")
    _segment(trigrams(rows, id_col, text_col).withColumn("seq", F.lit(seq).cast("long")), path, buckets)
    _commit(spark, folder, seq, "put", path, buckets)


def remove(ids: DataFrame, id_col: str, folder: str) -> None:
    """The ids' postings die."""
    spark = ids.sparkSession
    log = _log(spark, folder)
    seq = _next(log)
    path = f"{folder}/segment-{seq}"
    ids.select(F.col(id_col).alias("id"), F.lit(seq).cast("long").alias("seq")).distinct().write.parquet(f"{path}-marks")
    _commit(spark, folder, seq, "remove", path, log[0]["buckets"])


def _living(spark: SparkSession, log: list, trigrams_of: list[str] | None) -> DataFrame:
    """(trigram, id) of living postings; of the given trigrams only, from their buckets."""
    segments = [r["path"] for r in log if r["kind"] != "remove"]
    parts = []
    for path in segments:
        rows = spark.read.parquet(path)
        if trigrams_of is not None:
            rows = rows.filter(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % log[0]["buckets"] for t in trigrams_of})) & F.col("trigram").isin(trigrams_of))
        parts.append(rows.select("trigram", "id", "seq"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    marks = [f"{r['path']}-marks" for r in log if r["kind"] != "base"]
    if marks:
        last = spark.read.parquet(*marks).groupBy("id").agg(F.max("seq").alias("dead"))
        found = found.join(last, "id", "left").filter("dead is null or seq >= dead")
    return found.select("trigram", "id")


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(id): texts that have all trigrams of the query, which has three letters at least."""
    q = query.strip().lower()
    wanted = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    if not wanted:
        raise ValueError("a query needs three letters")
    found = _living(spark, _log(spark, folder), wanted)
    return found.groupBy("id").agg(F.count_distinct("trigram").alias("n")).filter(F.col("n") == len(wanted)).select("id")


def search(rows: DataFrame, id_col: str, text_col: str, folder: str, query: str) -> DataFrame:
    """The rows whose text holds the query, in any case; found by the index and confirmed in the text."""
    ids = candidates(rows.sparkSession, folder, query).withColumnRenamed("id", id_col)
    return rows.join(ids, id_col, "left_semi").filter(F.contains(F.lower(text_col), F.lit(query.strip().lower())))


def compacted(spark: SparkSession, folder: str) -> None:
    """All that lives in one segment; older segments aren't read any more."""
    log = _log(spark, folder)
    seq, buckets = _next(log), log[0]["buckets"]
    path = f"{folder}/segment-{seq}"
    _segment(_living(spark, log, None).withColumn("seq", F.lit(seq).cast("long")), path, buckets)
    _commit(spark, folder, seq, "base", path, buckets)
