"""Operator 10: an interpolated modified Kneser-Ney model of trusted text rates every document by its perplexity.

Units are characters, order ``ORDER``: any script works, and what the model holds grows with the variety of the trusted
text. Counting: tasks count the windows of their trusted texts, Spark sums them; continuation counts, discounts (from
counts of counts, for 1, 2 and 3 or more) and context sums are aggregations and joins over the count tables, which Spark
shards by gram. Scoring joins the same tables. Documents are written in blocks of neighbouring rows, tasks list the distinct
windows of each block, the distinct windows of all blocks get their probability by joins with the counts, order by order, and
these go back to the blocks. A second pass over the documents reads the probabilities of its own block, and of no other. The
windows that are most frequent in trusted text (``HEAD`` of them at most, of fixed size whatever the corpus) are in nearly every
block; they are scored by the same joins, but once, and every task reads them, so that blocks only list the others.

A share of the trusted documents (``FOLDS``-th part by a hash of the id) is left out of the counts and sets the thresholds,
exactly and over all of them. A text's bits a character are compared with the mean of its language, in units of the spread of
held-out texts of like length (powers of two), because the mean over few characters strays; the ``QUANTILE`` of this by language
is the threshold of ``kept``. ``clean`` rates words beside the mean, in which a few strange ones vanish: the most surprising
word of a text, less what the number of its words makes likely, has a threshold of its own, in the same way. Means, spreads and
quantiles of few texts are drawn towards those of all (``DRAWN`` texts' worth), so nothing switches by size.

Defined results: a null or empty text has no characters, 0 bits and is kept and clean, a text without letters is clean; labels that contradict each other make a
document untrusted; null languages are a language of their own; without trusted documents all are kept; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freeing, new_path, table, written
from .quality_rules import flagged, trusted_ids
from .tokens import chunks

ORDER = 5
FOLDS, QUANTILE = 8, (995, 1000)
#: Held-out texts that the pooled mean, the spread of the next longer texts and the pooled distribution count for.
DRAWN = {"mean": 10, "spread": 10, "quantile": 100}
#: A word of n letters that costs ``RATE * n`` bits surprises by 0; the spread of its bits grows with the root of n + ``FEW``.
RATE, FEW = 2.5, 4
#: A block holds two to the power of this many documents at most: its distinct windows are what a task holds at once.
BLOCK_BITS = 13
#: Stands before a text, so that its first characters have a context.
START = "\x02"
#: Windows that every task reads: 16 bytes each.
HEAD = 1 << 20
SCALE = 1000
#: Bytes of text whose windows a task handles at once: its arrays take about 100 times as much.
CHUNK_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(77))
FACTORS = _rng.integers(0, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 start marks, and where each begins (one more at the end)."""
    pad = START * (ORDER - 1)
    flat = np.frombuffer((pad + pad.join(texts) if texts else "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) + ORDER - 1 for t in texts], dtype=np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def codes(flat: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place (places before n - 1 are 0)."""
    out = np.zeros(len(flat), dtype=np.uint64)
    wide = flat.astype(np.uint64)
    for k in range(n):
        out[n - 1 :] += (wide[n - 1 - k : len(flat) - k] + np.uint64(1)) * FACTORS[k]
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each occurs first, and each place's number among them."""
    back, own = pd.factorize(keys)
    first = np.empty(len(own), dtype=np.int64)
    first[back[::-1]] = np.arange(len(keys))[::-1]
    return own, first, back


def gram_counts(trusted: DataFrame) -> DataFrame:
    """(gram, c): how often each window of ORDER characters occurs in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            texts = [t or "" for t in chunk["text"].to_pylist()]
            pad = START * (ORDER - 1)
            joined = pad + pad.join(texts)
            flat, bounds = points(texts)
            at = inner_places(flat, bounds)
            if len(at):
                _, first, back = distinct(codes(flat, ORDER)[at])
                n = np.bincount(back)
                yield pa.RecordBatch.from_arrays([pa.array([joined[i - ORDER + 1 : i + 1] for i in at[first].tolist()]), pa.array(n, pa.int64())], names=["gram", "c"])

    return trusted.select("text").mapInArrow(freeing(run), "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def model(trusted: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The model's tables by order, from 0, and the counts (gram, c) of the longest order.

    An order's first table (gram, own) has what remains of a gram's count after the discount, the second (context, sum, cuts) the sum of a
    context's counts and of what was cut from them, which goes to the next lower order. Order 0 has the uniform probability. Only
    counts and contexts are written; the discounted counts are expressions on the counts' tables, so no table is written twice.
    """
    spark = trusted.sparkSession
    tables = {ORDER: written(gram_counts(trusted), "grams")}
    for n in range(ORDER - 1, 0, -1):
        shorter = tables[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c"))
        tables[n] = written(shorter, "grams")
    rows: list[tuple[DataFrame, DataFrame]] = []
    for n, grams in sorted(tables.items()):
        # The discounts, from how many grams occur once to four times.
        seen = grams.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count("*").alias("all")).first()
        n1, n2, n3, n4 = (seen[f"n{k}"] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [min(0.95 * k, max(0.05, k - (k + 1) * y * b / a)) if a and b else min(0.75, 0.5 * k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        if n == 1:
            base = spark.range(1).select(F.lit("").alias("gram"), F.lit(1.0 / (seen["all"] + 1)).alias("own"))
            rows.append((base, spark.range(0).select(F.lit("").alias("context"), F.lit(0).alias("sum"), F.lit(0.0).alias("cuts"))))
        contexts = grams.groupBy(F.substring("gram", 1, n - 1).alias("context")).agg(F.sum("c").alias("sum"), F.sum(cut).alias("cuts"))
        rows.append((grams.select("gram", (F.col("c") - cut).alias("own")), written(contexts, "kneser-contexts")))
    return rows, tables[ORDER]


def blocks(docs: DataFrame) -> DataFrame:
    """``docs`` with ``block``, a number of neighbouring rows, as a written table: both passes must see the same blocks."""
    return written(docs.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "kneser-documents", "zstd")


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Chunks of texts, each of one block."""
    for chunk in chunks(batches, "text", CHUNK_BYTES):
        own = chunk["block"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(own[a]), chunk.slice(a, b - a)


def inner_places(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The places of the texts' own characters, without the start marks."""
    inner = np.ones(len(flat), dtype=bool)
    for k in range(ORDER - 1):
        inner[bounds[:-1] + k] = False
    return np.flatnonzero(inner)


def keyed(grams: DataFrame) -> DataFrame:
    """(key, gram): windows of ORDER characters with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.frombuffer("".join(batch["gram"].to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(codes(wide, ORDER)[ORDER - 1 :: ORDER].view(np.int64)), batch["gram"]], names=["key", "gram"])

    return grams.select("gram").mapInArrow(freeing(run), "key long, gram string")


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts`` (gram, c) with the largest counts: as many classes of counts (a quarter octave each) as hold ``most`` rows."""
    size = F.floor(4 * F.log2("c"))
    least, held = None, 0
    for row in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += row["n"]
        if held > most:
            break
        least = row["size"]
    return counts.filter(F.lit(False) if least is None else size >= least)


def has(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are among ``own``, which is sorted."""
    if not len(own):
        return np.zeros(len(keys), dtype=bool)
    return own[np.minimum(np.searchsorted(own, keys), len(own) - 1)] == keys


def block_windows(docs: DataFrame, head: str) -> DataFrame:
    """(block, key, gram): the distinct windows of ORDER characters of each block that the head (a folder of keys) hasn't, and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.sort(columns(head, {"key": np.int64})[0].view(np.uint64))
        at, seen = None, np.zeros(0, dtype=np.uint64)
        for block, chunk in by_block(batches):
            if block != at:
                at, seen = block, np.zeros(0, dtype=np.uint64)
            texts = [t or "" for t in chunk["text"].to_pylist()]
            flat, bounds = points(texts)
            ends = inner_places(flat, bounds)
            keys, first, _ = distinct(codes(flat, ORDER)[ends])
            new = ~has(common, keys)
            new[new] = ~has(seen, keys[new])
            if new.any():
                pad = START * (ORDER - 1)
                joined = pad + pad.join(texts)
                grams = [joined[i - ORDER + 1 : i + 1] for i in ends[first[new]].tolist()]
                # A stable sort merges what is in order already.
                seen = np.sort(np.concatenate([seen, np.sort(keys[new])]), kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block)), pa.array(keys[new].view(np.int64)), pa.array(grams, pa.string())], names=["block", "key", "gram"])

    return docs.select("block", "text").mapInArrow(freeing(run), "block long, key long, gram string")


def probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``grams`` (key, gram, others), distinct windows of ORDER characters, as (key, others, p): the last character's probability after the others.

    Each order's probability is joined from the counts' table of that order and from the probability of the shorter window.
    A key of these joins has as many rows as there are characters at most.
    """
    wanted = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        wanted[n] = wanted[n + 1].select(F.substring("gram", 2, n).alias("gram")).distinct()
    carried = {ORDER: [c for c in grams.columns if c != "gram"]}
    floor = model[0][0].first()["own"]
    # The only context of order 1 is the empty one; without trusted text there is none.
    whole = model[1][1].first()
    sums, cuts = (whole["sum"], whole["cuts"]) if whole else (1, 1.0)
    p = wanted[1].join(model[1][0], "gram", "left").select("gram", (F.coalesce(F.col("own") / sums, F.lit(0.0)) + cuts / sums * floor).alias("p"))
    for n in range(2, ORDER + 1):
        own, contexts = model[n]
        held = wanted[n].withColumn("context", F.substring("gram", 1, n - 1)).withColumn("shorter", F.substring("gram", 2, n - 1))
        held = held.join(own, "gram", "left").join(contexts, "context", "left").join(p.withColumnRenamed("gram", "shorter"), "shorter")
        p = held.select(*carried.get(n, ["gram"]), (F.coalesce(F.col("own") / F.col("sum"), F.lit(0.0)) + F.coalesce(F.col("cuts") / F.col("sum"), F.lit(1.0)) * F.col("p")).alias("p"))
    return p


def scored_blocks(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], counts: DataFrame, most: int = HEAD) -> tuple[str, str]:
    """Two folders: the probabilities of the head's windows, and those of each block's other windows, a folder a block.

    The head is chosen by its counts, so its windows and the others get their probabilities by the same joins.
    """
    spark = docs.sparkSession
    chosen = new_path(spark, "kneser-chosen")
    keyed(frequent(counts, most)).write.parquet(chosen)
    windows = written(block_windows(docs, chosen), "kneser-windows")
    rest = windows.groupBy("key").agg(F.first("gram").alias("gram")).withColumn("common", F.lit(False))
    common = spark.read.schema("key long, gram string").parquet(chosen).withColumn("common", F.lit(True))
    p = written(probabilities(written(rest.unionByName(common), "kneser-distinct"), model), "kneser-probabilities")
    head, path = new_path(spark, "kneser-head"), new_path(spark, "kneser-blocks")
    p.filter("common").select("key", "p").write.parquet(head)
    windows.select("block", "key").join(p.filter("not common").select("key", "p"), "key").select("block", "key", "p").repartition("block").write.partitionBy("block").parquet(path)
    return head, path


def scored_bits(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the windows in a folder, and -log2 of their probabilities; none where there is no folder."""
    key, p = columns(path, {"key": np.int64, "p": np.float64})
    by = np.argsort(key.view(np.uint64))
    return key.view(np.uint64)[by], -np.log2(p[by])


def columns(path: str, kinds: dict[str, type]) -> list[np.ndarray]:
    """Columns of all rows in a folder of Parquet files; empty where there is no folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    found: dict[str, list] = {c: [np.zeros(0, dtype=kind)] for c, kind in kinds.items()}
    for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            for batch in pq.ParquetFile(f.path, filesystem=system).iter_batches(200_000, columns=list(kinds)):
                for c in kinds:
                    found[c].append(batch[c].to_numpy())
    return [np.concatenate(x) for x in found.values()]


def peaks(flat: np.ndarray, bounds: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words (runs of letters) each text has, and how much the most surprising one surprises (times SCALE, whole)."""
    own, back = np.unique(flat, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in own.tolist()], dtype=bool)[back] if len(own) else np.zeros(0, dtype=bool)
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Start marks are no letters, so a word is within one text.
    upto = np.concatenate([[0.0], np.cumsum(bits)])
    size = end - start
    each = np.rint(SCALE * (upto[end] - upto[start] - RATE * size) / np.sqrt(size + FEW)).astype(np.int64)
    of = np.searchsorted(bounds, start, side="right") - 1
    n = np.bincount(of, minlength=len(bounds) - 1)
    most = np.zeros(len(bounds) - 1, dtype=np.int64)
    if len(each):
        most[n > 0] = np.maximum.reduceat(each, np.flatnonzero(np.diff(of, prepend=-1)))
    return n, most


def perplexities(docs: DataFrame, folders: tuple[str, str], carried: list[str]) -> DataFrame:
    """``carried`` columns, n_scored (characters), bits (bits a character times SCALE, whole), n_words (runs of letters) and peak of every document."""
    head, path = folders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = scored_bits(head)
        at = None
        for block, chunk in by_block(batches):
            if block != at:
                at, mine = block, scored_bits(f"{path}/block={block}")
            texts = [t or "" for t in chunk["text"].to_pylist()]
            flat, bounds = points(texts)
            ends = inner_places(flat, bounds)
            bits = np.zeros(len(flat))
            if len(ends):
                own, _, back = distinct(codes(flat, ORDER)[ends])
                each = np.full(len(own), np.nan)
                for keys, values in (common, mine):
                    at_ = np.flatnonzero(has(keys, own))
                    each[at_] = values[np.searchsorted(keys, own[at_])]
                if np.isnan(each).any():
                    raise RuntimeError(f"block {block} has windows that were not scored")
                bits[ends] = each[back]
            sums = np.add.reduceat(bits, bounds[:-1])
            n = np.diff(bounds) - ORDER + 1
            mean = np.rint(SCALE * sums / np.maximum(n, 1)).astype(np.int64)
            out = chunk.select(carried).combine_chunks().to_batches(max_chunksize=None)[0]
            words, most = peaks(flat, bounds, bits)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(n, pa.int64()), pa.array(mean), pa.array(words, pa.int64()), pa.array(most)], names=[*carried, "n_scored", "bits", "n_words", "peak"])

    kept = [docs.schema[c] for c in carried]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.select("block", "text", *carried).mapInArrow(freeing(run), f"{schema}, n_scored long, bits long, n_words long, peak long")


def beside(rows: DataFrame, by_lang: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``by_lang`` (of, ...) of their language."""
    few = by_lang.count() <= 100_000
    return rows.join(F.broadcast(by_lang) if few else by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")


def spreads(held: DataFrame) -> list[float]:
    """The spread of ``held`` (n_scored, off) by floor(log2(n_scored)), each drawn towards what the next longer texts have.

    A mean over half the characters has twice the variance at most, which is what a class without texts gets.
    """
    found = {r["k"]: (r["n"], r["squares"]) for r in held.groupBy(F.floor(F.log2("n_scored")).cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("off") * F.col("off")).alias("squares")).collect()}
    total = sum(n for n, _ in found.values())
    longer = sum(q for _, q in found.values()) / total if total else 1.0
    out = [0.0] * 64
    for k in range(63, -1, -1):
        n, squares = found.get(k, (0, 0))
        prior = 2 * longer if k < max(found, default=64) else longer
        longer = max(1.0, (squares + DRAWN["spread"] * prior) / (n + DRAWN["spread"]))
        out[k] = longer**0.5
    return out


def quantiles(held: DataFrame, langs: DataFrame, value: str, name: str) -> DataFrame:
    """(of, name): by language, the quantile of ``held`` (lang, value) mixed with all languages' as if it had some more rows."""
    counts = held.groupBy("lang", F.col(value).alias("value")).agg(F.count("*").alias("n"))
    pooled = counts.groupBy("value").agg(F.sum("n").alias("n"))
    total = pooled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Weights are whole: a row of the language counts ``total``, each of all rows ``DRAWN``.
    own = counts.select("lang", "value", (F.col("n") * total).alias("n"))
    shared = langs.crossJoin(F.broadcast(pooled.select("value", (F.col("n") * DRAWN["quantile"]).alias("n"))))
    part = Window.partitionBy("lang")
    upto = part.orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    rows = own.unionByName(shared).withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(part))
    return rows.filter(QUANTILE[1] * F.col("upto") >= QUANTILE[0] * F.col("all")).groupBy(F.col("lang").alias("of")).agg(F.min("value").alias(name))


def rated(scored: DataFrame) -> DataFrame:
    """``scored`` (lang, held, n_scored, bits, n_words, peak) with kept and clean."""
    held = scored.filter("held and n_scored > 0")
    langs = scored.select("lang").distinct()
    pool = held.agg(F.sum("bits").alias("sum"), F.count("*").alias("n"), F.regr_slope("peak", F.log2(F.col("n_words") + 1)).alias("slope")).first()
    mean = pool["sum"] / pool["n"] if pool["n"] else 0.0
    sums = held.groupBy(F.col("lang").alias("own")).agg(F.sum("bits").alias("sum"), F.count("*").alias("n"))
    drawn = F.round((F.coalesce("sum", F.lit(0)) + DRAWN["mean"] * F.lit(mean)) / (F.coalesce("n", F.lit(0)) + DRAWN["mean"])).cast("long")
    means = written(langs.join(sums, F.col("lang").eqNullSafe(F.col("own")), "left").select(F.col("lang").alias("of"), drawn.alias("mean")), "means")
    slope = round(max(0.0, pool["slope"] or 0.0))
    rows = beside(scored, means).withColumn("off", F.col("bits") - F.col("mean")).withColumn("odd", F.col("peak") - F.round(slope * F.log2(F.col("n_words") + 1)).cast("long"))
    spread = F.array(*[F.lit(x) for x in spreads(rows.filter("held and n_scored > 0"))])
    rows = rows.withColumn("off", F.round(100 * F.col("off") / F.get(spread, F.floor(F.log2(F.greatest("n_scored", F.lit(1)))).cast("int"))).cast("long"))
    for value, name in (("off", "most_off"), ("odd", "most_odd")):
        limits = quantiles(rows.filter("held and n_scored > 0"), langs, value, name)
        rows = beside(rows, written(limits, "thresholds"))
    within = lambda v, most, n: (F.col(n) == 0) | F.coalesce(F.col(v) <= F.col(most), F.lit(True))
    return rows.withColumn("kept", within("off", "most_off", "n_scored")).withColumn("clean", within("odd", "most_odd", "n_words"))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, lang, n_scored, bits_per_char, perplexity, kept (by perplexity), peak, clean (by its words)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    marked = flagged(texts, trusted_ids(labels)).withColumn("held", F.col("trusted") & (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0))
    marked = blocks(marked)
    folders = scored_blocks(marked, *model(marked.filter("trusted and not held")))
    scored = written(perplexities(marked, folders, ["doc_id", "lang", "held"]), "perplexities")
    bits = F.col("bits") / SCALE
    return rated(scored).select("doc_id", "lang", "n_scored", bits.alias("bits_per_char"), F.pow(F.lit(2.0), bits).alias("perplexity"), "kept", (F.col("peak") / SCALE).alias("peak"), "clean")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
