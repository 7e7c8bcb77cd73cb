"""Operator 5: substring dedup by content-defined chunks with a gear rolling hash.

The gear hash at a byte is a sum over the last ``WINDOW`` bytes, each mapped to a random number and shifted by its age. A
chunk ends where the hash is at least as great as at the ``APART`` bytes on either side, so a cut depends on the bytes
around it only: an insertion moves the cuts near it, and equal passages are cut alike from ``WINDOW + APART`` bytes on. In
stretches with a short period, where cuts could be nearer than ``APART``, each counts from the one before. Chunks that
would be longer than ``MOST`` bytes are cut by length. Chunks are compared by 128-bit digests over all
documents. Runs of repeated chunks of ``RUN`` bytes or more are repeated passages; all but the first occurrence (the least
document id and place) of their chunks are removed. Shorter runs (stock phrases) stay.

Defined results: a null or empty text has no chunks and is kept; repeats within a document count; rows that repeat a
document id are told apart by a hash of their text; rows that repeat as a whole repeat each other, and both count as first;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, let, table, written
from .tokens import chunks

APART, MOST = 20, 200
RUN = 80
WINDOW = 16
#: A digest with more occurrences is split among tasks, this many in each; and the most digests that are split (24 bytes each).
SHARE, SPLIT = 10_000, 100_000
#: Bits of a packed chunk's length and of the tag that tells texts of one document id apart.
LENGTH_BITS, TAG_BITS = 8, 20
GEAR = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: sums over 1, 2, 4 ... 16 bytes, each from two of the one before."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h = longer
        width *= 2
    return h


def peaks(h: np.ndarray) -> np.ndarray:
    """Where ``h`` is at least as great as in the APART places on either side; never at the ends."""
    n = len(h) - 2 * APART
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # The greatest of APART neighbours from each place on, from two of shorter stretches.
    most, width = h, 1
    while width < APART:
        step = min(width, APART - width)
        most = np.maximum(most[:-step], most[step:])
        width += step
    mid = h[APART : APART + n]
    return np.flatnonzero((mid >= most[:n]) & (mid >= most[APART + 1 : APART + 1 + n])) + APART


def cuts(data: bytes) -> list[int]:
    """Where the chunks of a text end."""
    out, at, n = [], 0, len(data)
    for m in [*(peaks(gear(np.frombuffer(data, dtype=np.uint8))) + 1).tolist(), n]:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= APART or m == n > at:
            at = m
            out.append(at)
    return out


def chunk_table(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, spot, high, low): all chunks of ``docs`` (doc_id, tag, text).

    high and low are the digest; spot packs start, length and tag, so that a chunk is five whole numbers and spots of a
    text are in the order of their starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4 << 20):
            ids, sizes, starts, ends, digests = [], [], [], [], []
            tags = part["tag"].to_numpy()
            for text in part["text"].to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                own = cuts(data)
                at = 0
                for e in own:
                    digests.append(xxhash.xxh3_128_digest(data[at:e]))
                    starts.append(at)
                    at = e
                ends += own
                sizes.append(len(own))
            take = np.repeat(np.arange(len(sizes)), sizes)
            ids = part["doc_id"].combine_chunks().take(pa.array(take))
            start, end = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)
            both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            spot = (start << (LENGTH_BITS + TAG_BITS)) | ((end - start) << TAG_BITS) | tags[take]
            yield pa.RecordBatch.from_arrays([ids, pa.array(spot, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "spot", "high", "low"])

    return docs.select("doc_id", "tag", "text").mapInArrow(freeing(run), "doc_id long, spot long, high long, low long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, start, length, first): chunks that occur twice or more; first marks the occurrence that stays.

    Occurrences meet their digest's row by a shuffled join. The ``SPLIT`` most frequent digests are known to all tasks, and
    each goes to one task for every ``SHARE`` of its occurrences, so a chunk that very many texts share isn't one task's work.
    """
    every = chunk_table(docs)
    place = F.struct("doc_id", "spot")
    often = every.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    often = written(often.select("high", "low", "first", F.ceil(F.col("n") / SHARE).cast("int").alias("parts")), "chunk-digests")
    hot = often.filter("parts > 1").orderBy(F.desc("parts"), "high", "low").limit(SPLIT)
    hot = written(hot.select(F.col("high").alias("hot_high"), F.col("low").alias("hot_low"), F.col("parts").alias("hot_parts")), "chunk-hot")

    def beside(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(hot), (F.col("high") == F.col("hot_high")) & (F.col("low") == F.col("hot_low")), "left")

    keys = beside(often).select("high", "low", "first", F.explode(F.sequence(F.lit(0), F.coalesce("hot_parts", F.lit(1)) - 1)).alias("part"))
    rows = beside(every).select("high", "low", "doc_id", "spot", F.pmod(F.xxhash64("doc_id", "spot"), F.coalesce("hot_parts", F.lit(1))).cast("int").alias("part"))
    # A null document id sorts first and is a place like any other.
    found = rows.join(keys, ["high", "low", "part"]).select("doc_id", "spot", place.eqNullSafe(F.col("first")).alias("first"))
    start, length = F.shiftright("spot", LENGTH_BITS + TAG_BITS), F.shiftright("spot", TAG_BITS).bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))
    return found.select("doc_id", F.col("spot").bitwiseAND(F.lit((1 << TAG_BITS) - 1)).alias("tag"), start.alias("start"), length.alias("length"), "first")


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, runs): the repeated passages of each text as (s, e, gone), bytes and removed bytes; there may be none."""
    held = repeated_chunks(docs).groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct("start", "length", "first"))).alias("c"))
    # A run begins at each chunk that doesn't begin where the one before ends.
    heads = F.expr("filter(sequence(0, size(c) - 1), i -> i = 0 or get(c, i).start <> get(c, i - 1).start + get(c, i - 1).length)")

    def runs(heads: Column) -> Column:
        def run(head: Column, j: Column) -> Column:
            after = F.coalesce(F.get(heads, j + 1), F.size("c"))
            last = F.get("c", after - 1)
            gone = F.aggregate(F.slice("c", head + 1, after - head), F.lit(0).cast("long"), lambda a, x: a + F.when(x["first"], F.lit(0)).otherwise(x["length"]))
            return F.struct(F.get("c", head)["start"].alias("s"), (last["start"] + last["length"]).alias("e"), gone.alias("gone"))

        return F.filter(F.transform(heads, run), lambda r: r["e"] - r["s"] >= RUN)

    # Rows without a run stay in: a filter on the runs would have Spark find them twice.
    return held.select("doc_id", "tag", let(heads, runs).alias("runs"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, has_repeat, n_repeats, repeat_bytes, removed_bytes, kept, repeats.

    ``repeats`` lists the repeated passages as start:end:removed, in bytes; ``kept`` is false where a text loses all of it.
    """
    tagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("text"), F.lit(1 << TAG_BITS)).alias("tag"), "text")
    found = written(passages(tagged), "passages")
    rows = tagged.select("doc_id", "tag", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    out = rows.join(found.withColumnsRenamed({"doc_id": "of", "tag": "of_tag"}), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")), "left")
    zero = F.lit(0).cast("long")
    runs = F.coalesce("runs", F.array().cast("array<struct<s:bigint,e:bigint,gone:bigint>>"))
    out = out.select("doc_id", "n_bytes", runs.alias("runs"))
    total = lambda part: F.aggregate("runs", zero, lambda a, r: a + part(r))
    gone = total(lambda r: r["gone"])
    return out.select(
        "doc_id",
        "n_bytes",
        (F.size("runs") > 0).alias("has_repeat"),
        F.size("runs").cast("long").alias("n_repeats"),
        total(lambda r: r["e"] - r["s"]).alias("repeat_bytes"),
        gone.alias("removed_bytes"),
        ((gone < F.col("n_bytes")) | (F.col("n_bytes") == 0)).alias("kept"),
        F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["s"].cast("string"), r["e"].cast("string"), r["gone"].cast("string"))), ",").alias("repeats"),
    )


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
