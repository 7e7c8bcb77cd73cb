"""Operator 13: how far the sources of a language are apart in their terms, by in-mapper stripes.

1. A task folds its documents, whole, into hash stripes: for each language and term the number of documents that hold it and
   the counts by source. When it holds ``HELD`` terms it spills them as rows and starts anew, so its memory is bounded and a
   frequent term costs one row a spill, not one an occurrence.
2. Spilled stripes are dealt by language and term and sorted; a task merges neighbours as they come, holds one stripe at a
   time, and passes on those of terms in at least ``LEAST_DOCS`` documents of the language.
3. Merged stripes are written once. From them come the number of kept terms of a language and the counts of its sources.
4. The stripes of a language are dealt into parts of about ``PART`` terms; each part meets its language's sources once
   (a cogroup, so nothing is broadcast) and emits its share of every pair's sum and its best terms of each source.
5. Shares are summed by pair, best terms ranked again.

A task holds the sums of one language's pairs of sources, as many as the result has rows, and a block of ``PART`` terms by
sources. All arithmetic is on whole numbers; the product of a count with 1e9 is split, so counts to 9e13 are exact.

Defined results: null text, language and source count as empty ones; a language's single source has no pairs; a language
without kept terms has pairs of value 0 and no terms; documents are rows, so rows that repeat count each, with or without an
id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freeing, table, written
from .tokens import chunks

LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Terms that a task holds before it spills, and terms of a part.
HELD, PART = 300_000, 8192
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
#: Bytes of a text to bytes of its terms: A-Z lower-cased, letters and all above ASCII as they are, else a space.
_TO = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, the number of each occurrence's term, and the bounds of each text's occurrences."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    first, last = (texts.offset, texts.offset + len(texts))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[first : last + 1]
    data = texts.buffers()[2]
    plain = b"" if data is None else data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes().translate(_TO)
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(plain))
    lists = pc.ascii_split_whitespace(clean)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[codes]
    bounds = np.concatenate([[0], np.cumsum(full)])[np.asarray(lists.offsets)]
    return coded.dictionary, codes[full].astype(np.int64), bounds


class Stripes:
    """A task's hash stripes: languages, sources and terms by number, and counts of (language, term[, source])."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.groups: dict[tuple[int, str], int] = {}
        self.terms: dict[str, int] = {}
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.hits: list[tuple[np.ndarray, np.ndarray]] = []

    def fold(self, chunk: pa.Table) -> None:
        distinct, codes, bounds = terms_of(chunk["text"].combine_chunks())
        names = distinct.to_pylist()
        lang_of = np.array([self.langs.setdefault(x, len(self.langs)) for x in chunk["lang"].to_pylist()], dtype=np.int64)
        group_of = np.array([self.groups.setdefault((g, s), len(self.groups)) for g, s in zip(lang_of.tolist(), chunk["source"].to_pylist(), strict=True)], dtype=np.int64)
        sizes = np.diff(bounds)
        width = max(1, len(names))
        held = np.array([self.terms.setdefault(x, len(self.terms)) for x in names], dtype=np.int64)
        once, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + codes, return_counts=True)
        doc, term = once // width, held[once % width] if len(once) else once
        self.docs.append(_summed([(lang_of[doc] << 32 | term, np.ones(len(doc), dtype=np.int64))]))
        self.hits.append(_summed([(group_of[doc] << 32 | term, n)]))
        if len(self.hits) > 15:
            self.docs, self.hits = [_summed(self.docs)], [_summed(self.hits)]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All stripes; the fold starts anew."""
        docs, hits = _summed(self.docs), _summed(self.hits)
        langs, groups, terms = list(self.langs), list(self.groups), list(self.terms)
        # Counts by (language, term), then source.
        lang_of = np.array([g for g, _ in groups], dtype=np.int64)
        keys = lang_of[hits[0] >> 32] << 32 | hits[0] & 0xFFFFFFFF if len(hits[0]) else hits[0]
        order = np.lexsort((hits[0] >> 32, keys))
        starts = np.searchsorted(keys[order], docs[0])
        sources = np.array([s for _, s in groups], dtype=object)[(hits[0] >> 32)[order]] if groups else np.zeros(0, dtype=object)
        names, tags = np.array(terms, dtype=object), np.array(langs, dtype=object)
        n = hits[1][order]
        for a in range(0, len(docs[0]), 50_000):
            key = docs[0][a : a + 50_000]
            bounds = np.append(starts[a : a + len(key)], starts[a + len(key)] if a + len(key) < len(starts) else len(n))
            at = slice(bounds[0], bounds[-1])
            offsets = pa.array((bounds - bounds[0]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tags[key >> 32], pa.string()), pa.array(names[key & 0xFFFFFFFF], pa.string()), pa.array(docs[1][a : a + 50_000]),
                    pa.ListArray.from_arrays(offsets, pa.array(sources[at], pa.string())), pa.ListArray.from_arrays(offsets, pa.array(n[at])),
                ],
                names=["lang", "term", "df", "sources", "counts"],
            )
        self.__init__()


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
    values = np.concatenate([v for _, v in parts]) if parts else np.zeros(0, dtype=np.int64)
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(values[order], starts)


def stripes(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Spilled stripes of all documents; a term may have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Stripes()
        for chunk in chunks(batches, "text", 4 << 20):
            own.fold(chunk)
            if len(own.terms) > held:
                yield from own.rows()
        yield from own.rows()

    return docs.mapInArrow(freeing(run), STRIPE)


def merged(spilled: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One stripe a kept term, of neighbours in sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, df, counts = None, 0, {}
        out: dict[str, list] = {"lang": [], "term": [], "df": [], "sources": [], "counts": []}

        def close() -> None:
            if df >= least_docs:
                for name, value in zip(out, (*key, df, list(counts), list(counts.values())), strict=True):
                    out[name].append(value)

        def batch_of() -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))
            for v in out.values():
                v.clear()
            return made

        for batch in batches:
            langs, terms = batch["lang"], batch["term"]
            dfs = batch["df"].to_numpy(zero_copy_only=False)
            if not len(batch):
                continue
            # Terms that lie wholly within the batch and are too rare go without a look at their counts.
            new = np.ones(len(batch), dtype=bool)
            new[1:] = ~pc.and_(pc.equal(langs[1:], langs[:-1]), pc.equal(terms[1:], terms[:-1])).to_numpy(zero_copy_only=False)
            group = np.cumsum(new) - 1
            enough = np.add.reduceat(dfs, np.flatnonzero(new)) >= least_docs
            enough[[0, -1]] = True
            batch = batch.filter(pa.array(enough[group]))
            for lang, term, n, sources, values in zip(*(batch[c].to_pylist() for c in out), strict=True):
                if key != (lang, term):
                    close()
                    key, df, counts = (lang, term), 0, {}
                df += n
                for s, v in zip(sources, values, strict=True):
                    counts[s] = counts.get(s, 0) + v
            if len(out["term"]) > 10_000:
                yield batch_of()
        close()
        if out["term"]:
            yield batch_of()

    dealt = spilled.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(freeing(run), STRIPE)


def probabilities(counts: np.ndarray, total: np.ndarray | int, n_terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * n_terms)), with the product in two steps of 1e4 and 1e5."""
    below = np.asarray(total, dtype=np.int64) + 2 * n_terms
    whole, rest = np.divmod(counts + 2, below)
    high, rest = np.divmod(rest * 10_000, below)
    return 1 + (whole * 10_000 + high) * 100_000 + rest * 100_000 // below


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def divergences(kept: DataFrame, groups: DataFrame, part: int = PART, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank from merged stripes and all (lang, source) groups."""
    hits = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    facts = groups.join(hits, ["lang", "source"], "left").join(sizes, "lang", "left")
    facts = written(facts.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_terms", F.lit(0)).alias("n_terms")), "divergence-facts")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / part)).cast("int")
    spread = facts.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    # A language has as many parts as its terms need; facts has a row for each, so it names the number.
    numbers = facts.groupBy("lang").agg(F.max(parts).alias("parts"))
    dealt = kept.join(numbers, "lang").withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")).select("lang", "part", "term", "sources", "counts")

    def run(stripes: pa.Table, facts: pa.Table) -> pa.Table:
        names, n_terms = facts["source"].to_pylist(), facts["n_terms"][0].as_py()
        order = sorted(range(len(names)), key=lambda i: names[i].encode())
        names, totals = [names[i] for i in order], facts["n"].to_numpy()[order]
        lang, number = facts["lang"][0].as_py(), {s: i for i, s in enumerate(names)}
        sums, best = np.zeros((len(names), len(names)), dtype=np.int64), []
        block = max(1, (1 << 22) // len(names))
        for a in range(0, len(stripes), block):
            cut = stripes.slice(a, block)
            lists = cut["sources"].combine_chunks()
            row = np.repeat(np.arange(len(cut)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            counts = np.zeros((len(cut), len(names)), dtype=np.int64)
            counts[row, [number[s] for s in lists.flatten().to_pylist()]] = cut["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            p = probabilities(counts, totals, n_terms)
            q = probabilities(counts.sum(axis=1), int(totals.sum()), n_terms)
            terms = cut["term"].to_pylist()
            for i in range(len(names)):
                if i + 1 < len(names):
                    sums[i, i + 1 :] += gaps(p[:, i : i + 1], p[:, i + 1 :]).sum(axis=0)
                over = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
                values = gaps(p[over, i], q[over])
                # Ties with the last of the best stay, for the order by terms.
                if len(values) > top:
                    at = np.flatnonzero(values >= np.partition(values, -top)[-top])
                    over, values = over[at], values[at]
                first = sorted(zip((-values).tolist(), [terms[k] for k in over.tolist()], strict=True), key=lambda x: (x[0], x[1].encode()))[:top]
                best += [(names[i], "term", t, -v) for v, t in first]
        sums += sums.T
        pairs = [(names[i], "pair", names[j], int(sums[i, j])) for i in range(len(names)) for j in range(len(names)) if i != j]
        rows = [(lang, *r) for r in pairs + best]
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())))})

    shares = dealt.groupBy("lang", "part").cogroup(spread.groupBy("lang", "part")).applyInArrow(run, "lang string, source string, part string, item string, value long")
    # A term has one share, a pair one from each part.
    values = shares.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, held: int = HELD, part: int = PART) -> DataFrame:
    """The divergences of all sources of ``docs`` (text, lang, source)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = written(merged(stripes(docs, held), least_docs), "divergence-stripes")
    return divergences(kept, docs.select("lang", "source").distinct(), part)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: The same by counting words and joining all groups with all kept terms.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
h AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c FROM g JOIN k ON k.lang = g.lang LEFT JOIN h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM a JOIN v USING (lang)),
t AS (SELECT lang, term, sum(c) AS c FROM a GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS q FROM t JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS s FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
values_ AS (
  SELECT g.lang, g.source, 'pair' AS part, b.source AS item, coalesce(s, 0)::BIGINT AS value FROM g JOIN g b ON g.lang = b.lang AND g.source <> b.source LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM values_ QUALIFY part = 'pair' OR rank <= 10
"""
