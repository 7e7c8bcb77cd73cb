"""Operator 4: quality rules and a hashed n-gram log-likelihood ratio between trusted text and the raw corpus.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets, with add-one
smoothing, are counted over all documents: one of the trusted documents (labelled good and not toxic), one of the whole
corpus. A document's score is the mean log ratio of its n-grams, in 1/1024 nats and whole numbers, so that it doesn't
depend on the order of additions. A document is kept unless the base rules fail it or its score lies below the trusted
documents' quantile ``QUANTILE`` (an exact count over all of them, not a sketch). For the quantile each trusted document is
scored without its own fold of the trusted documents (``FOLDS`` of them, by a hash of the id), since a text that was counted
scores higher than an equally good one that wasn't.

DataFrame and SQL functions only. The table of the ratios has a fixed size (``BUCKETS`` whole numbers), so it goes into the
scoring expression as a constant. Trusted ids are broadcast while they are few and joined by shuffle otherwise.

Defined results: a null text has no words and fails the base rules; a document that is labelled more than once is trusted
if each of its labels says so; with no trusted documents the base rules alone decide; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, let, table, words_of, written

BUCKETS = 1 << 14
SCALE = 1024
QUANTILE, FOLDS = 0.001, 8
LEAST_WORDS, MOST_REPEATED = 50, 50
BROADCAST_IDS = 1_000_000
#: Scores are whole numbers within plus and minus this, which bounds the histogram.
LIMIT = 16 * SCALE

#: Positions covered by windows of three words that occur twice or more; ``w`` is the array of words.
_REPEATS = """
transform(array(if(size({w}) < 3, cast(array() as array<bigint>), transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])))), h ->
  if(size(array_distinct(h)) = size(h), 0L,
    transform(array(array_sort(transform(h, (x, i) -> struct(x as h, i as i)))), s ->
      transform(array(array_sort(transform(filter(transform(s, (x, j) -> struct(x.i as i,
          (j > 0 and get(s, j - 1).h = x.h) or coalesce(get(s, j + 1).h = x.h, false) as twice)), x -> x.twice), x -> x.i))), p ->
        aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0L, (a, x) -> a + x))[0])[0]))[0]
"""


def base_columns(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, words) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.expr(_REPEATS.format(w="words")).alias("n_repeat_words"),
    )


def buckets(words: Column) -> Column:
    """Bucket numbers of all words and of all pairs of neighbours."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def both(h: Column) -> Column:
        one = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
        pairs = F.transform(F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda x, i: F.pmod(F.xxhash64(F.get(h, i), x), F.lit(BUCKETS)).cast("int"))
        return F.concat(one, pairs)

    return F.transform(F.array(hashes), both)[0]


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return good.filter("good and doc_id is not null").select("doc_id")


def flagged(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``trusted``."""
    ids = written(ids, "trusted").withColumn("trusted", F.lit(True))
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def ratios(docs: DataFrame) -> list[list[int]]:
    """The log ratio of each bucket from ``docs`` (words, trusted, fold): without the trusted texts of fold 0, 1 ..., and from all."""
    grams = docs.select(F.when(F.col("trusted"), F.col("fold")).alias("fold"), F.explode(buckets(F.col("words"))).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), *[F.count_if(F.col("fold") == k).alias(f"good{k}") for k in range(FOLDS)]).collect()
    raw, good = [1] * BUCKETS, [[0] * BUCKETS for _ in range(FOLDS)]
    for row in counted:
        raw[row["bucket"]] += row["raw"]
        for k in range(FOLDS):
            good[k][row["bucket"]] = row[f"good{k}"]
    every = [1 + sum(parts) for parts in zip(*good, strict=True)]
    return [_ratios([n - x for n, x in zip(every, own, strict=True)], raw) for own in good] + [_ratios(every, raw)]


def _ratios(good: list[int], raw: list[int]) -> list[int]:
    if sum(good) == BUCKETS:
        return [0] * BUCKETS
    shift = math.log(sum(raw)) - math.log(sum(good))
    return [round(SCALE * (math.log(g) - math.log(r) + shift)) for g, r in zip(good, raw, strict=True)]


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, the base columns, base_failed, kept, and score (1/1024 nats an n-gram)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = flagged(texts, trusted_ids(labels)).withColumn("words", words_of(F.col("text"))).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    values = [v for one in ratios(marked.select("trusted", "fold", "words")) for v in one]
    held = F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")

    def total(grams: Column, which: Column) -> Column:
        return F.aggregate(grams, F.lit(0).cast("long"), lambda a, g: a + F.get(held, which * BUCKETS + g))

    totals = let(buckets(F.col("words")), lambda g: F.struct(total(g, F.lit(FOLDS)).alias("all"), F.when(F.col("trusted"), total(g, F.col("fold"))).alias("own")))
    n_grams = F.greatest(2 * F.size("words") - 1, F.lit(1))
    score = lambda part: F.greatest(F.least(F.expr(f"totals.{part} div n_grams"), F.lit(LIMIT)), F.lit(-LIMIT))
    scored = base_columns(marked.withColumn("totals", totals).withColumn("n_grams", n_grams)).withColumn("score", score("all")).withColumn("own_score", score("own"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score", "own_score", "trusted")
    scored = written(scored, "quality-scores")
    counts = sorted((r["score"], r["count"]) for r in scored.filter("trusted and not base_failed").select(F.col("own_score").alias("score")).groupBy("score").count().collect())
    least, left = -LIMIT - 1, QUANTILE * sum(n for _, n in counts)
    for value, n in counts:
        if left < n:
            least = value
            break
        left -= n
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= least)).alias("kept"), "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
