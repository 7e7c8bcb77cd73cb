"""Operator 7: k-d tree partitioning of documents into shards of near-equal bytes.

A node that must give k shards is cut along its widest dimension (its range as a share of the range over all rows) at the
weighted median, that is where the bytes stand as floor(k/2) to the rest. Dimensions are the logarithm of the size, the
bytes a character, and the language. Each is the high part of a 63-bit key whose middle part is the text's CRC-32 and
whose low part is a hash of the document id, so that every cut exists, however many rows share a value, and equal texts
lie side by side.

The median is found by histograms: the bytes of all nodes of a level are summed by bins of their key range, the bin with
the median is refined, until it holds less than ``TOLERANCE`` of a shard's bytes or is one group of equal texts. The driver sees
bins, never documents. A group of equal texts stays together unless it holds more than ``GROUP`` of a shard's bytes, where sizes
near equal would not hold otherwise; so one that holds a third of all bytes is spread over shards.

Slots: rows of a shard fall into buckets by a hash of their id; a bucket's first slot is the prefix sum over the counts of
buckets, so no window holds more than a bucket. DataFrame and SQL functions only.

Defined results: a null text has size 1 and CRC 0; null languages and ids are values like others; repeated rows get slots
of their own; an empty table gives no rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 8
TOLERANCE = 0.002
#: Share of a shard's bytes that a cut may be off by, so that equal texts stay together.
GROUP = 0.02
#: Rows of a slot bucket on average.
BUCKET_ROWS = 20_000
#: Bits of a key that a pass resolves, from high to low: the dimension, the text's CRC-32, the id's hash.
PASSES = (10, 10, 16, 16, 11)
DIM_BITS, CRC_BITS, ID_BITS = 20, 32, 11
KEYS = ("by_size", "by_width", "by_lang")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the three keys of every document."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.length(text).alias("chars"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    top = (1 << DIM_BITS) - 1
    low = F.shiftleft(F.col("text_crc32"), ID_BITS) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))

    def key(value: Column) -> Column:
        return F.shiftleft(F.least(F.greatest(value.cast("long"), F.lit(0)), F.lit(top)).cast("long"), CRC_BITS + ID_BITS) + low

    # Sizes up to 2**40 bytes, one to four bytes a character.
    by_size = F.log2("size") * ((top + 1) / 40)
    by_width = ((F.col("size") - 1) / F.greatest(F.col("chars"), F.lit(1)) - 1) * ((top + 1) / 3)
    by_lang = F.shiftright(F.crc32(F.encode("lang", "UTF-8")), 32 - DIM_BITS)
    return base.select("doc_id", "size", "text_crc32", key(by_size).alias("by_size"), key(by_width).alias("by_width"), key(by_lang).alias("by_lang"))


def _medians(rows: DataFrame, nodes: dict[int, dict], tolerance: float, group: float) -> dict[int, int]:
    """For each node (its key and the bytes wanted below the cut) the cut: rows with a smaller key go left."""
    low = dict.fromkeys(nodes, 0)
    want = {n: x["want"] for n, x in nodes.items()}
    cuts: dict[int, int] = {}
    left = sum(PASSES)
    for bits in PASSES:
        left -= bits
        open_ = [n for n in nodes if n not in cuts]
        if not open_:
            break
        key = reduce(lambda c, n: c.when(F.col("node") == n, F.shiftright(F.col(nodes[n]["key"]) - F.lit(low[n]), left)), open_, F.when(F.lit(False), F.lit(0).cast("long")))
        bins = rows.select("node", "size", key.alias("bin")).filter((F.col("bin") >= 0) & (F.col("bin") < (1 << bits))).groupBy("node", "bin").agg(F.sum("size").alias("bytes"))
        seen: dict[int, list] = {n: [] for n in open_}
        for row in bins.collect():
            seen[row["node"]].append((row["bin"], row["bytes"]))
        for n in open_:
            below = 0
            for b, size in sorted(seen[n]):
                if below + size >= want[n]:
                    break
                below += size
            # With all bits but the id's, a bin is a group of equal texts.
            if size <= tolerance or left == 0 or (left == ID_BITS and size <= group):
                take = below + size - want[n] <= want[n] - below
                cuts[n] = low[n] + ((b + take) << left)
            else:
                low[n] += b << left
                want[n] -= below
    return cuts


def kd_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` of ``metadata`` with ``node``, the shard."""
    ranges = rows.agg(*[F.min(k).alias(f"{k}_low") for k in KEYS], *[F.max(k).alias(f"{k}_high") for k in KEYS], F.sum("size").alias("bytes")).first()
    rows = rows.withColumn("node", F.lit(0))
    if ranges["bytes"] is None:
        return rows
    shift = CRC_BITS + ID_BITS
    wide = {k: max(1, (ranges[f"{k}_high"] >> shift) - (ranges[f"{k}_low"] >> shift)) for k in KEYS}
    # A node is named by its first shard; it gives so many shards.
    leaves = {0: shards}
    while any(k > 1 for k in leaves.values()):
        spans = {r["node"]: r for r in rows.groupBy("node").agg(*[(F.max(F.shiftright(k, shift)) - F.min(F.shiftright(k, shift))).alias(k) for k in KEYS], F.sum("size").alias("bytes")).collect()}
        asked = {}
        for n, k in leaves.items():
            if k > 1 and n in spans:
                widest = max(KEYS, key=lambda d: spans[n][d] / wide[d])
                asked[n] = {"key": widest, "want": spans[n]["bytes"] * (k // 2) / k}
        cuts = _medians(rows, asked, TOLERANCE * ranges["bytes"] / shards, GROUP * ranges["bytes"] / shards)
        after = {}
        chain = F.when(F.lit(False), F.lit(0))
        for n, k in leaves.items():
            if k == 1 or n not in cuts:
                after[n] = 1
                continue
            after[n], after[n + k // 2] = k // 2, k - k // 2
            chain = chain.when((F.col("node") == n) & (F.col(asked[n]["key"]) >= F.lit(cuts[n])), F.lit(n + k // 2))
        leaves = after
        rows = rows.withColumn("node", F.coalesce(chain, F.col("node")))
    return rows


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = written(metadata(docs), "shard-metadata")
    placed = kd_shards(rows, shards)
    n_buckets = max(1, -(-rows.count() // (shards * BUCKET_ROWS)))
    placed = placed.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_buckets)).alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row a bucket: a table of all rows divided by BUCKET_ROWS.
    bases = written(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shard-bases")
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    out = placed.withColumn("at", F.row_number().over(within) - 1).join(bases, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
