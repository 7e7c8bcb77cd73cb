"""Operator 11: toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words (runs of letters and of characters above ASCII, A-Z lower-cased) and their first
``PREFIXES`` bytes, each as a 64-bit hash. A term has a weight and a vector of ``FACTORS`` numbers; the score of a text
is the logistic of an offset, the weights of its terms and the dot products of all pairs of their vectors. So terms that are
harmless alone (a group's name, an ambiguous insult) can be toxic together, which a sum of weights can't say.

1. Labelled documents outside the held-out fifth count, for every term, documents and toxic documents; tasks sum what they
   see before the shuffle.
2. Terms take part whose counts differ from what the share of toxic documents explains: a log-likelihood ratio of at least
   ``2 ln(terms)``, at which less than about one term of all would pass by chance. Of these the ``FEATURES`` clearest are the
   model (a bound on the model's size, which tasks get as a broadcast of at most 3 MB).
3. Each labelled document becomes the list of its model terms; equal lists are counted. Every round all tasks add up the
   gradient of the log loss over these rows, as whole numbers so that the order of additions doesn't matter, and the driver
   takes one step of adaptive gradient descent for the model's terms.
4. All documents, whole, are scored by tasks of their own.

Labels are read for training alone; neither they nor language, source or id enter a score.

Defined results: a null text or one without words has no terms and gets the offset's score, the share of toxic documents;
without labels that is a fourth, so nothing is predicted toxic; a document that is labelled more than once is toxic if any label says so, null
labels are none; rows that repeat an id are scored each, and all of them learn from its label; a null id is held out; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, freeing, table, written
from .divergence import terms_of
from .minhash import mixed
from .tokens import chunks

PREFIXES = (4, 5, 6)
FACTORS, ROUNDS = 4, 30
FEATURES = 1 << 16
#: Documents that a term needs at least.
LEAST = 3
#: Steps of weights and of vectors, decay, spread of the first vectors, and parts of one in whole gradients.
STEP, VECTOR_STEP, DECAY, SPREAD, WHOLE = 1.0, 0.1, 1e-4, 0.05, 1 << 24
FOLDS = 5
#: Labels that are broadcast at most (12 bytes each).
BROADCAST_LABELS = 1_000_000
#: Random factors of a word's bytes by their place.
PLACES = np.random.default_rng(11).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A column for the whole word and for each prefix: 64-bit hashes, 0 where a word is no longer than the prefix."""
    words = words.cast(pa.large_binary())
    first, n = words.offset, len(words)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[first : first + n + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if n and words.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    starts, sizes = offsets[:-1] - (offsets[0] if n else 0), np.diff(offsets)
    out = np.zeros((n, 1 + len(PREFIXES)), dtype=np.uint64)
    if not len(data):
        return out.view(np.int64)
    # The sum of bytes times the random factors of their places.
    place = (np.arange(len(data)) - np.repeat(starts, sizes)) % len(PLACES)
    some = sizes > 0
    out[some, 0] = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * PLACES[place], starts[some])
    ahead = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        eight |= ahead[starts + k].astype(np.uint64) << np.uint64(8 * k)
    for c, k in enumerate(PREFIXES, 1):
        long = sizes > k
        out[long, c] = (eight[long] & np.uint64((1 << 8 * k) - 1)) * np.uint64(2) + np.uint64(1) + (np.uint64(c) << np.uint64(60))
    for c in range(out.shape[1]):
        out[:, c] = np.where(out[:, c] == 0, 0, np.maximum(mixed(out[:, c]), np.uint64(1)))
    return out.view(np.int64)


def hashed_terms(texts: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and terms: each distinct term of each text, by rows. With ``only`` (sorted hashes) terms are places in it."""
    words, codes, bounds = terms_of(texts)
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    values = word_hashes(words)
    good = values != 0
    if only is not None:
        at = np.searchsorted(only, values)
        good &= np.append(only, 0)[at] == values if len(only) else False
        values = at
        # Words without a term of the model go before anything is sorted.
        keep = good.any(axis=1)[codes]
        rows, codes = rows[keep], codes[keep]
    width = max(1, len(words))
    once = distinct(rows * width + codes)
    rows, codes = once // width, once % width
    held = good[codes]
    terms = values[codes][held]
    rows = np.repeat(rows, held.sum(axis=1))
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    return rows[new], terms[new]


def counted_terms(texts: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of some texts, and in how many texts and toxic texts they are."""
    words, codes, bounds = terms_of(texts)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    width = max(1, len(words))
    once = distinct(rows * width + codes)
    rows, codes = once // width, once % width
    parts = []
    for values in word_hashes(words).T:
        terms, place = np.unique(values, return_inverse=True)
        # A prefix counts once a text, whichever words have it.
        width = max(1, len(terms))
        at = distinct(rows * width + place[codes])
        at, row = at % width, at // width
        n, bad = np.bincount(at, minlength=len(terms)), np.bincount(at[toxic[row] > 0], minlength=len(terms))
        real = terms != 0
        parts.append((terms[real], n[real], bad[real]))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))


def term_counts(labelled: DataFrame) -> DataFrame:
    """term, n and n_toxic over labelled texts (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", 16 << 20):
            found = counted_terms(chunk["text"].combine_chunks(), chunk["toxic"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["term", "n", "n_toxic"])

    return labelled.mapInArrow(freeing(run), "term long, n long, n_toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def ratio(n: Column, bad: Column, docs: int, toxic: int) -> Column:
    """Twice the log-likelihood ratio between a term's own share of toxic documents and the share of all."""
    share = toxic / docs

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    rest, rest_bad = docs - n, toxic - bad
    return 2 * (part(bad, n * share) + part(n - bad, n * (1 - share)) + part(rest_bad, rest * share) + part(rest - rest_bad, rest * (1 - share)))


def model_terms(labelled: DataFrame, docs: int, toxic: int, most: int) -> np.ndarray:
    """The hashes of the terms that take part, sorted."""
    if not 0 < toxic < docs:
        return np.zeros(0, dtype=np.int64)
    counts = written(term_counts(labelled).filter(F.col("n") >= LEAST), "toxicity-counts")
    least = 2 * math.log(max(2, counts.count()))
    rated = counts.select("term", ratio(F.col("n"), F.col("n_toxic"), docs, toxic).alias("r")).filter(F.col("r") >= least)
    return np.array(sorted(r["term"] for r in rated.orderBy(F.desc("r"), "term").limit(most).collect()), dtype=np.int64)


def raw_scores(rows: np.ndarray, terms: np.ndarray, n: int, offset: float, weights: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic, and the sum of vectors of every text."""
    z, sums = np.full(n, offset), np.zeros((n, vectors.shape[1]))
    if len(rows):
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        at = rows[starts]
        sums[at] = np.add.reduceat(vectors[terms], starts, axis=0)
        squares = np.add.reduceat((vectors[terms] ** 2).sum(axis=1), starts)
        z[at] += np.add.reduceat(weights[terms], starts) + 0.5 * ((sums[at] ** 2).sum(axis=1) - squares)
    return z, sums


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(rows: DataFrame, offset: float, weights: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows (terms, toxic, n) of the gradient of weights and vectors."""
    names = ["w", *[f"v{k}" for k in range(vectors.shape[1])]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), len(names)), dtype=np.int64)
        seen = np.zeros(len(weights), dtype=bool)
        for batch in batches:
            lists = batch["terms"]
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            at, terms = np.repeat(np.arange(len(batch)), sizes), lists.flatten().to_numpy(zero_copy_only=False)
            z, sums = raw_scores(at, terms, len(batch), offset, weights, vectors)
            left = ((logistic(z) - batch["toxic"].to_numpy()) * batch["n"].to_numpy())[at]
            # Whole numbers, and small enough in one batch for exact sums of doubles.
            for k in range(len(names)):
                each = left if k == 0 else left * (sums[at, k - 1] - vectors[terms, k - 1])
                total[:, k] += np.bincount(terms, weights=np.rint(each * WHOLE), minlength=len(weights)).astype(np.int64)
            seen[terms] = True
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(total[used, k]) for k in range(len(names))]], names=["term", *names])

    parts = rows.mapInArrow(run, "term long, " + ", ".join(f"{c} long" for c in names))
    out = np.zeros((len(weights), len(names)))
    for r in parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["term"]] = [r[c] / WHOLE for c in names]
    return out[:, 0], out[:, 1:]


def train(labelled: DataFrame, most: int = FEATURES, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """The model of labelled texts (text, toxic): hashes of its terms, offset, weights and vectors."""
    labelled = written(labelled, "toxicity-labelled")
    docs, toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    kept = model_terms(labelled, docs, toxic, most)
    share = (toxic + 0.5) / (docs + 2)
    offset = math.log(share / (1 - share))
    weights, vectors = np.zeros(len(kept)), np.random.default_rng(11).normal(0, SPREAD, (len(kept), FACTORS))
    if not len(kept):
        return kept, offset, weights, vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            rows, terms = hashed_terms(chunk["text"].combine_chunks(), kept)
            bounds = np.searchsorted(rows, np.arange(chunk.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds), pa.array(terms.astype(np.int32))), chunk["toxic"].combine_chunks()], names=["terms", "toxic"])

    lists = labelled.mapInArrow(freeing(run), "terms array<int>, toxic int").filter(F.size("terms") > 0)
    rows = written(lists.groupBy("terms", "toxic").agg(F.count("*").alias("n")), "toxicity-rows")
    seen, seen_vectors = np.full(len(kept), 1e-8), np.full(vectors.shape, 1e-8)
    for _ in range(rounds):
        g, gv = gradient(rows, offset, weights, vectors)
        g, gv = g / docs + DECAY * weights, gv / docs + DECAY * vectors
        seen, seen_vectors = seen + g * g, seen_vectors + gv * gv
        weights, vectors = weights - STEP * g / np.sqrt(seen), vectors - VECTOR_STEP * gv / np.sqrt(seen_vectors)
    return kept, offset, weights, vectors


def scored(docs: DataFrame, model: tuple[np.ndarray, float, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, offset, weights, vectors = shared.value
        for chunk in chunks(batches, "text", 8 << 20):
            rows, terms = hashed_terms(chunk["text"].combine_chunks(), kept)
            score = logistic(raw_scores(rows, terms, chunk.num_rows, offset, weights, vectors)[0])
            yield pa.RecordBatch.from_arrays([chunk["doc_id"].combine_chunks(), chunk["held_out"].combine_chunks(), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return texts.mapInArrow(freeing(run), "doc_id long, held_out boolean, score double, predicted int")


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic (0 or 1) of the documents to learn from."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).filter("doc_id is not null and toxic is not null")
    marks = written(marks.filter(~held_out(F.col("doc_id"))), "toxicity-labels")
    few = marks.count() <= BROADCAST_LABELS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks) if few else marks, "doc_id").select("text", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted."""
    return scored(docs, train(labelled_texts(docs, labels)))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
