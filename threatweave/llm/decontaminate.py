"""Operator 6: benchmark decontamination with spaced seeds.

A seed is a hash of the words at the fixed positions of a mask; the positions between are ignored, so a substituted word
there does no harm. Seeds of all benchmark items (at every position) are joined with seeds of all documents (at every
position). Each hit fixes a diagonal, on which the item and the document are compared word by word: a match counts +1, a
substitution ``-PENALTY``, and the best run must reach ``SHARE`` of the item's words, ``NEED`` for long items. Words are
lower-cased runs of letters and digits.

DataFrame and SQL functions only. Benchmark seeds and candidate ids are broadcast behind a count, and joined by shuffle beyond it.

Items shorter than a mask, from ``shortest`` words on, must occur as they are: windows of their lengths are joined by hash and
compared word by word. They cost nothing where there are none.

Defined results: a null or empty text has no words and is kept; items with fewer than ``shortest`` words aren't searched (by
default five, as shorter ones are met by chance in clean texts and are no evidence; with 1 items of any length are searched, exactly); repeated items
count by their ids; a document row is judged by its id, so rows that share an id share the verdict, and rows without an id are
kept; an empty benchmark keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Word positions that count; the others are ignored.
MASKS = ((0, 1, 3, 5, 6, 9), (0, 2, 3, 4, 7, 8), (0, 1, 2, 5, 7, 8))
SPAN = 10
#: The fewest words of an item that is searched, where a caller has no choice of its own.
WHOLE = 5
#: What a best run needs: so many in so many of the item's words, NEED at most.
SHARE, NEED, PENALTY = (7, 10), 10, 1
BROADCAST_SEEDS, BROADCAST_IDS = 2_000_000, 1_000_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, seed) of every position of ``words``; masks that reach beyond the end are left out."""
    hashes = df.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("h")).filter(F.size("h") > max(map(max, MASKS)) - 1)
    shifted = F.arrays_zip(*[F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))).alias(f"w{k}") for k in range(SPAN)])
    rows = hashes.select(key, F.posexplode(shifted).alias("pos", "w"))
    marks = []
    for n, mask in enumerate(MASKS):
        seed = F.xxhash64(F.lit(n), *[F.col(f"w.w{k}") for k in mask])
        marks.append(F.when(F.col(f"w.w{max(mask)}").isNotNull(), seed))
    return rows.select(key, "pos", F.explode(F.array(*marks)).alias("seed")).filter("seed is not null")


def best_run(words: Column, item: Column, shift: Column) -> Column:
    """The best sum along the diagonal ``shift`` (document position minus item position)."""
    step = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(words) - shift) - 1
    gains = F.transform(F.sequence(first, last), lambda q: F.when(F.get(item, q) == F.get(words, q + shift), F.lit(1)).otherwise(F.lit(-PENALTY)))

    def add(acc: Column, gain: Column) -> Column:
        now = F.greatest(acc["now"] + gain, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(gains, step, add, lambda acc: acc["best"])


def windows(df: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """(key, seed) of every run of ``lengths`` words (at most SPAN - 1)."""
    hashes = df.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("h")).filter(F.size("h") >= min(lengths))
    shifted = F.arrays_zip(*[F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))).alias(f"w{k}") for k in range(max(lengths))])
    rows = hashes.select(key, F.explode(shifted).alias("w"))
    marks = [F.when(F.col(f"w.w{n - 1}").isNotNull(), F.xxhash64(F.lit(n), *[F.col(f"w.w{k}") for k in range(n)])) for n in lengths]
    return rows.select(key, F.explode(F.array(*marks)).alias("seed")).filter("seed is not null")


def whole_items(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched): items (item_id, words) of fewer than SPAN words that occur in a text as they are."""
    lengths = sorted(r.n for r in items.select(F.size("words").alias("n")).distinct().collect())
    if not lengths:
        return texts.sparkSession.range(0).select(F.col("id").alias("doc_id"), F.col("id").alias("item_id"), F.lit(0).alias("matched"))
    small = items.count() <= BROADCAST_SEEDS
    seed = F.lit(None).cast("long")
    for n in lengths:
        seed = F.when(F.size("words") == n, F.xxhash64(F.lit(n), *[F.xxhash64(F.get("words", F.lit(k))) for k in range(n)])).otherwise(seed)
    wanted = items.select("item_id", seed.alias("seed"))
    mine = windows(texts.select("doc_id", tokens(F.col("text")).alias("words")), "doc_id", lengths)
    pairs = written(mine.join(F.broadcast(wanted) if small else wanted, "seed").select("doc_id", "item_id").distinct(), "whole-items")
    found = texts.join(pairs, "doc_id").select("doc_id", "item_id", tokens(F.col("text")).alias("words")).join(items.withColumnRenamed("words", "item"), "item_id")
    n = F.size("item")
    there = F.exists(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))), lambda p: F.slice("words", p, n) == F.col("item"))
    return found.filter(there).select("doc_id", "item_id", n.alias("matched"))


def overlaps(docs: DataFrame, benchmark: DataFrame, shortest: int = WHOLE) -> DataFrame:
    """(doc_id, item_id, matched): verified overlaps, the best run of each pair. Items have ``shortest`` words at least."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("words")).filter(F.col("item_id").isNotNull() & (F.size("words") >= max(1, shortest)))
    known = written(known, "benchmark-words")
    items, short = known.filter(F.size("words") >= SPAN), known.filter(F.size("words") < SPAN)
    item_seeds = written(seeds(items, "item_id").select("seed", "item_id", F.col("pos").alias("q")).distinct(), "benchmark-seeds")
    small = item_seeds.count() <= BROADCAST_SEEDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    mine = seeds(texts.select("doc_id", tokens(F.col("text")).alias("words")), "doc_id")
    hits = mine.join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    diagonals = written(hits.select("doc_id", "item_id", (F.col("pos") - F.col("q")).alias("shift")).distinct(), "diagonals")
    ids = diagonals.select("doc_id").distinct()
    few = ids.count() <= BROADCAST_IDS
    found = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    found = found.select("doc_id", tokens(F.col("text")).alias("words"))
    both = diagonals.join(items.withColumnRenamed("words", "item"), "item_id").join(found, "doc_id")
    need = F.least(F.lit(NEED), F.floor(F.size("item") * SHARE[0] / SHARE[1]))
    scored = both.select("doc_id", "item_id", best_run(F.col("words"), F.col("item"), F.col("shift")).alias("matched"), need.alias("need")).filter("matched >= need").drop("need")
    return scored.unionByName(whole_items(texts, short)).groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"))


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = WHOLE) -> DataFrame:
    """doc_id, n_items, matched and item_ids (ascending) of the documents that overlap with the benchmark."""
    found = overlaps(docs, benchmark, shortest).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("matched").alias("matched"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return written(found, "contaminated")


def with_verdict(docs: DataFrame, found: DataFrame) -> DataFrame:
    few = found.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(found) if few else found, "doc_id", "left")


def decontaminate(docs: DataFrame, benchmark: DataFrame, shortest: int = WHOLE) -> DataFrame:
    """One row a document: doc_id, contaminated, kept, n_items, matched, item_ids."""
    out = with_verdict(docs.select(F.col("doc_id").cast("long").alias("doc_id")), contaminated(docs, benchmark, shortest))
    hit = F.col("n_items").isNotNull()
    return out.select("doc_id", hit.alias("contaminated"), (~hit).alias("kept"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _seed_sql(source: str, key: str) -> str:
    rows = []
    for n, mask in enumerate(MASKS):
        words = ", ".join(f"w[p + {k}]" for k in mask)
        rows.append(f"SELECT {key}, p, {n} AS m, concat_ws(' ', {words}) AS k FROM {source} WHERE p + {max(mask)} <= len(w)")
    return " UNION ALL ".join(rows)


#: The same result in SQL: seeds as texts, the best run by running sums.
OP6_SQL = rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
b AS (SELECT item_id, w FROM i WHERE len(w) >= {SPAN}), o AS (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS k FROM i WHERE len(w) BETWEEN {WHOLE} AND {SPAN - 1}),
tp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t), bp AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS p FROM b),
ts AS ({_seed_sql("tp", "doc_id")}), bs AS ({_seed_sql("bp", "item_id")}),
d AS (SELECT DISTINCT doc_id, item_id, ts.p - bs.p AS shift FROM ts JOIN bs USING (m, k)),
g AS (SELECT doc_id, item_id, shift, t.w AS w, b.w AS v, unnest(range(greatest(1, 1 - shift), least(len(b.w), len(t.w) - shift) + 1)) AS q FROM d JOIN t USING (doc_id) JOIN b USING (item_id)),
s AS (SELECT doc_id, item_id, shift, q, sum(CASE WHEN v[q] = w[q + shift] THEN 1 ELSE -{PENALTY} END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q) AS s FROM g),
r AS (SELECT doc_id, item_id, shift, s - least(0, coalesce(min(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run FROM s),
f AS (SELECT doc_id, item_id, cast(max(run) AS BIGINT) AS matched FROM r JOIN b USING (item_id) GROUP BY doc_id, item_id HAVING max(run) >= least({NEED}, {SHARE[0]} * any_value(len(b.w)) // {SHARE[1]})
  UNION ALL SELECT DISTINCT doc_id, item_id, n FROM (SELECT doc_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k FROM tp, (SELECT DISTINCT n FROM o) WHERE p + n - 1 <= len(w)) JOIN o USING (n, k)),
c AS (SELECT doc_id, count(*) AS n_items, max(matched) AS matched, list(item_id ORDER BY item_id) AS item_ids FROM f GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, n_items IS NULL AS kept, coalesce(n_items, 0) AS n_items, coalesce(matched, 0) AS matched, coalesce(item_ids, []) AS item_ids FROM documents LEFT JOIN c USING (doc_id)
"""
