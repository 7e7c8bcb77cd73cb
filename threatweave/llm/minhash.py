"""Operator 2: near-duplicates by MinHash bands with sequential Bayesian verification.

1. Each text becomes its set of five-word shingles (64-bit hashes) and a signature of ``BANDS * ROWS`` minima.
2. Equal sets (by a 128-bit digest of the whole set) collapse to one row, so exact copies cost nothing further.
3. Sets that agree in a whole band are candidates. In a bucket every set is compared with one center, not with all
   others: first with the least document id, then, where members of a bucket are still in different components, with the
   member that shares most buckets, and at last with every member of another component, in blocks inside tasks that
   return verified links only.
4. A candidate's signatures are compared in batches; it is dropped as soon as the posterior probability that the
   similarity reaches the threshold falls below ``MISS`` (uniform prior, so the posterior is a binomial tail).
5. Survivors are verified on the full sets, rebuilt from the whole texts.
6. Links become components by least labels with pointer jumps; later links join components, and aren't labelled from the start.

The threshold is a parameter, ``NEAR`` unless a caller has its own. The bands lose a pair of similarity 0.8 with a
probability of 3e-6, one of 0.85 with 2e-9.

Defined results: a text without words has an empty set and no links; a null document id has a null component and is
kept; rows that share an id but not a text are separate documents, each in the component of its own set (sets go by the
least document id and text hash that have them, and a component's id is the least doc_id of its members); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, freeing, table, written
from .graph import beside, components, extended
from .tokens import chunks

WORDS = 5
ROWS, BANDS = 6, 42
#: Similarity of 80 in 100, as integers, for all callers without a threshold of their own.
NEAR = (80, 100)
#: The threshold of op2_minhash_near_dedup.
NEED = (85, 100)
#: Chosen probability of losing a pair at the threshold, and signature values compared at once.
MISS, BATCH = 1e-7, 36
#: Sets of a block when sets are compared with each other; leaves that share one copy of a center; sets of a family at most.
BLOCK, FAN, FAMILY = 256, 64, 20_000
#: Ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000

_rng = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
STEPS = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names], dtype=np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    bounds = np.asarray(lists.offsets).astype(np.int64)
    full = np.array([w != "" for w in names], dtype=bool)[codes] if names else np.zeros(0, dtype=bool)
    bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
    flat = hashes[codes[full]] if names else np.zeros(0, dtype=np.uint64)
    n = max(0, len(flat) - WORDS + 1)
    joint = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        joint += flat[k : k + n] * STEPS[k]
    joint = mixed(joint)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(distinct(joint[a : b - WORDS + 1]))
        elif b > a:
            out.append(mixed((flat[a:b] * STEPS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(low), 512):
        np.minimum(best, (low[a : a + 512, None] * FACTORS + SHIFTS).min(axis=0), out=best)
    return best


def band_hashes(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k] + np.uint64(1))
    return out.astype(np.int64)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches of n at which the posterior of similarity >= threshold is at least ``miss``."""
    total = 0.0
    for m in range(n + 2):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def bounds_of(need: tuple[int, int]) -> list[tuple[int, int]]:
    """After how many signature values a pair needs how many matches."""
    return [(n, least_matches(n, need[0] / need[1], MISS)) for n in range(BATCH, ROWS * BANDS + 1, BATCH)]


BOUNDS = bounds_of(NEED)

#: A set is told by the least document id that has it, with a hash of that text, as ids may repeat.
LINK = "a struct<doc_id:bigint,mark:bigint>, b struct<doc_id:bigint,mark:bigint>"


def may_link(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]] = BOUNDS) -> np.ndarray:
    """Of the pairs of signatures (rows), which still can reach the threshold after all batches."""
    left = np.arange(len(a))
    same = np.zeros(len(a), dtype=np.int32)
    for n, least in bounds:
        same[left] += (a[left, n - BATCH : n] == b[left, n - BATCH : n]).sum(axis=1, dtype=np.int32)
        left = left[same[left] >= least]
    out = np.zeros(len(a), dtype=bool)
    out[left] = True
    return out


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, ROWS * BANDS)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, set_id (digest of the set), sig (low 16 bits of each minimum) and bands of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", 4 << 20):
            rows: dict[str, list] = {"n_shingles": [], "set_id": [], "sig": [], "bands": []}
            for s in shingle_sets(chunk["text"].combine_chunks()):
                rows["n_shingles"].append(len(s))
                if len(s):
                    sig = signature(s)
                    rows["set_id"].append(blake2b(s.tobytes(), digest_size=16).digest())
                    rows["sig"].append(sig.astype(np.uint16).tobytes())
                    rows["bands"].append(band_hashes(sig))
                else:
                    for k in ("set_id", "sig", "bands"):
                        rows[k].append(None)
            yield pa.RecordBatch.from_arrays([chunk["doc_id"].combine_chunks(), chunk["mark"].combine_chunks(), pa.array(rows["n_shingles"], pa.int64()), pa.array(rows["set_id"], pa.binary()), pa.array(rows["sig"], pa.binary()), pa.array(rows["bands"], pa.list_(pa.int64()))], names=["doc_id", "mark", *rows])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).mapInArrow(freeing(run), "doc_id long, mark long, n_shingles long, set_id binary, sig binary, bands array<long>")


def _surviving(pairs: DataFrame, sigs: DataFrame, need: tuple[int, int]) -> DataFrame:
    """Candidate pairs (a, b) that pass the sequential test."""
    bounds = bounds_of(need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keep = may_link(_signatures(batch["sig_a"]), _signatures(batch["sig_b"]), bounds)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(freeing(run), LINK)


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, text) of the wanted sets."""
    wanted = written(wanted.select("rep", "rep.*"), "minhash-places")
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return texts.join(F.broadcast(wanted) if few else wanted, ["doc_id", "mark"]).select("rep", "text")


def _links(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = [pa.StructArray.from_arrays([pa.array([x[k] for x in side], pa.int64()) for k in (0, 1)], names=["doc_id", "mark"]) for side in (a, b)]
    return pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def _verified(pairs: DataFrame, docs: DataFrame, need: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. Many b share one copy of their a, FAN of them a time."""
    pairs = written(pairs.distinct(), "minhash-pairs")
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("fans"))
    leaves = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("fans")).alias("fan"), F.col("b").alias("rep"), F.lit(1).alias("role"))
    heads = leaves.select("a", "fan", F.col("a").alias("rep"), F.lit(0).alias("role")).distinct()
    wanted = written(leaves.unionByName(heads), "minhash-wanted")
    # Only the texts of candidates are moved.
    texts = _texts(wanted.select("rep").distinct(), docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, head = None, None, None
        for chunk in chunks(batches, "text", 4 << 20):
            sets = shingle_sets(chunk["text"].combine_chunks())
            found = []
            for *key, doc_id, mark, role, s in zip(*(chunk[c].to_pylist() for c in ("a_id", "a_mark", "fan", "doc_id", "mark", "role")), sets, strict=True):
                # Equal rows of a document stand side by side and count once.
                if last == (key, doc_id, mark):
                    continue
                last = (key, doc_id, mark)
                if role == 0:
                    at, head = key, s
                elif at == key:
                    common = len(np.intersect1d(head, s, assume_unique=True))
                    if common and need[1] * common >= need[0] * (len(head) + len(s) - common):
                        found.append(((key[0], key[1]), (doc_id, mark)))
            yield _links([x for x, _ in found], [y for _, y in found])

    joined = wanted.join(texts, "rep").repartition("a", "fan").sortWithinPartitions("a", "fan", "role", "rep")
    return joined.select(F.col("a.doc_id").alias("a_id"), F.col("a.mark").alias("a_mark"), "fan", "rep.doc_id", "rep.mark", "role", "text").mapInArrow(freeing(run), LINK)


def _unsettled(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, rep, comp, low, size) of buckets whose members are in more than one component; low is the least of these."""
    now = bands.join(labels, "rep", "left").select("bucket", "rep", F.coalesce("comp", "rep").alias("comp"))
    open_ = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).filter("low < high")
    return now.join(open_.select("bucket", "low", "size"), "bucket")


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, shingles): the wanted full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", 4 << 20):
            sets = [s.tobytes() for s in shingle_sets(chunk["text"].combine_chunks())]
            yield pa.RecordBatch.from_arrays([chunk["rep"].combine_chunks(), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return written(_texts(wanted, docs).mapInArrow(freeing(run), "rep struct<doc_id:bigint,mark:bigint>, shingles binary").dropDuplicates(["rep"]), "minhash-sets")


def _families(rows: DataFrame, most: int) -> DataFrame:
    """(family, rep, comp, blocks): open buckets joined into families of components that share some, so that a pair meets once.

    Buckets link components, not sets: a large group of near copies shares nearly all its buckets and is one component by
    then, while links between its sets would be as many as its bucket entries. A family of more than ``most`` sets stays apart by its buckets, whose pairs are fewer. Only families of more than one
    block are looked up, of which there are few, so that no exchange deals the rows by their family.
    """
    # An open bucket has two components at least, so each of them is in a link.
    kin = components(rows.filter("comp <> low").select("comp", "low").distinct(), "comp", "low").select(F.col("id").alias("comp"), F.xxhash64("comp").alias("family"))
    joined = written(beside(rows, kin, "comp").select("bucket", "rep", "comp", "family"), "minhash-kin")
    large = _sized(joined.select("family", "rep").distinct(), most)
    keyed = _beside(joined, large, "family").select(F.when(F.col("size").isNull(), F.col("family")).otherwise(F.col("bucket")).alias("family"), "rep", "comp").distinct()
    keyed = written(keyed, "minhash-keyed")
    return _beside(keyed, _sized(keyed, BLOCK), "family").select("family", "rep", "comp", F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int").alias("blocks"))


def _sized(rows: DataFrame, more_than: int) -> DataFrame:
    """(of, size) of the families with more than so many rows; counted in parts before they are dealt."""
    return written(rows.groupBy(F.col("family").alias("of")).agg(F.count("*").alias("size")).filter(F.col("size") > more_than), "minhash-sizes")


def _beside(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    few = sizes.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(sizes) if few else sizes, rows[key] == sizes["of"], "left")


def _block_links(rows: DataFrame, reps: DataFrame, docs: DataFrame, need: tuple[int, int], most: int) -> DataFrame:
    """Links (a, b) between different components of a family, verified on the full sets; enough of them to join all that link.

    A family of m sets is cut into blocks, and each pair of blocks is compared in one task, which holds two blocks at
    most. A pair must share a band, pass the sequential test and reach the threshold on the full sets. Components that a
    task has joined aren't compared again, so it returns less links than it has components.
    """
    bounds = bounds_of(need)
    rows = written(_families(rows, most), "minhash-families")
    sets = _sets(rows.select("rep").distinct(), docs)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp").join(reps.select("rep", "sig", "bands"), "rep").join(sets, "rep")

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        block, reps = part["block"].to_numpy(), part["rep"].combine_chunks()
        ids = list(zip(reps.field("doc_id").to_pylist(), reps.field("mark").to_pylist(), strict=True))
        number: dict[tuple[int, int], int] = {}
        of = part["comp"].combine_chunks()
        comps = np.array([number.setdefault(c, len(number)) for c in zip(of.field("doc_id").to_pylist(), of.field("mark").to_pylist(), strict=True)])
        sigs, bands = _signatures(part["sig"]), np.array(part["bands"].to_pylist(), dtype=np.int64)
        full = [np.frombuffer(x, dtype=np.uint64) for x in part["shingles"].to_pylist()]
        sizes = np.array([len(x) for x in full])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for x in left.tolist():
            ys = right[(comps[right] != comps[x]) & ((right > x) | (i != j))]
            ys = ys[(bands[ys] == bands[x]).any(axis=1)]
            if len(ys):
                ys = ys[may_link(np.broadcast_to(sigs[x], (len(ys), sigs.shape[1])), sigs[ys], bounds)]
            if len(ys):
                pooled = np.concatenate([full[y] for y in ys.tolist()])
                at = np.minimum(np.searchsorted(full[x], pooled), sizes[x] - 1)
                common = np.add.reduceat((full[x][at] == pooled).astype(np.int64), np.cumsum(sizes[ys]) - sizes[ys])
                for y in ys[need[1] * common >= need[0] * (sizes[x] + sizes[ys] - common)].tolist():
                    if comps[y] != comps[x]:
                        found.append((ids[x], ids[y]))
                        comps[comps == comps[y]] = comps[x]
        return pa.Table.from_batches([_links([a for a, _ in found], [b for _, b in found])])

    return spread.groupBy("family", "i", "j").applyInArrow(run, LINK)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (rep, comp) with further links."""
    return extended(labels.withColumnRenamed("rep", "id"), written(links, "minhash-links"), "a", "b").withColumnRenamed("id", "rep")


def near_duplicates(docs: DataFrame, need: tuple[int, int] = NEAR, family: int = FAMILY) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, mark (xxhash64 of the text).

    Sets link at a similarity of need[0] in need[1].
    """
    feats = written(features(docs), "minhash-features")
    full = feats.filter("set_id is not null and doc_id is not null")
    reps = written(full.groupBy("set_id").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.min(F.struct("sig", "bands")).alias("x")).select("set_id", "rep", "x.*"), "minhash-reps")
    sigs = reps.select("rep", "sig")
    every = reps.select("rep", F.explode("bands").alias("bucket"))
    centers = every.groupBy("bucket").agg(F.min("rep").alias("a"), F.count("*").alias("n")).filter("n > 1")
    # Only members of buckets with company go on.
    bands = written(every.join(centers, "bucket").select("bucket", "rep", "a"), "minhash-bands")
    pairs = bands.filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    links = written(_verified(_surviving(pairs, sigs, need), docs, need), "minhash-links")
    labels = components(links, "a", "b").withColumnRenamed("id", "rep")

    rows = written(_unsettled(bands.select("bucket", "rep"), labels), "minhash-open")
    if not rows.isEmpty():
        shared = rows.groupBy("rep").agg(F.sum("size").alias("shared"))
        rated = rows.join(shared, "rep")
        chosen = rated.groupBy("bucket").agg(F.min(F.struct(F.negative("shared").alias("least"), "rep", "comp")).alias("c"))
        stars = rated.join(chosen, "bucket").filter("comp <> c.comp").select(F.col("c.rep").alias("a"), F.col("rep").alias("b")).distinct()
        labels = _joined(labels, _verified(_surviving(stars, sigs, need), docs, need))
        rows = written(_unsettled(rows.select("bucket", "rep"), labels), "minhash-open")
        if not rows.isEmpty():
            labels = _joined(labels, _block_links(rows, reps, docs, need, family))

    owners = reps.select("set_id", "rep").join(labels, "rep", "left").select("set_id", F.coalesce("comp", "rep").getField("doc_id").alias("comp"))
    out = feats.select("doc_id", "n_shingles", "set_id", "mark").join(owners, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "mark")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NEED).select("doc_id", "n_shingles", "component_id", "kept")


#: The same result by comparing all pairs of sets that share a shingle.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM w),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, cast(len(x) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
