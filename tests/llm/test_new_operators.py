"""Toxicity, clustering and source divergences: against SQL, by hand, on odd rows and on empty tables."""

import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from threatweave.llm import centroids, divergence, registry, toxicity

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, cluster string, x int, distance double"


def same(spark_rows, columns, sql, tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    theirs = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})").fetchall()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in spark_rows), key=key) == sorted(theirs, key=key)
    return theirs


def vectors(n, rng, dims=64):
    return [(i, [float(v) for v in rng.normal(i % 5, 1.5, dims)], 0, "c", 1, 0.5) for i in range(n)]


def arrow(rows):
    return pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})


def test_clusters_of_odd_vectors(spark):
    """Nulls, wrong lengths, non-finite components, repeated rows and ids, ties, and a vector that fills a third of the table."""
    rng = np.random.default_rng(4)
    rows = vectors(120, rng)
    hot = [0.25] * 64
    rows += [(1000 + i, hot, 0, "c", 1, 0.5) for i in range(80)]
    rows += [rows[3], (5, rows[7][1], 0, "c", 1, 0.5), (None, rows[8][1], 0, "c", 1, 0.5)]
    bad = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [1.0] * 63 + [None]), (305, [float("nan")] + [1.0] * 63), (306, [float("-inf")] + [1.0] * 63), (None, None)]
    rows += [(i, v, 0, "c", 1, 0.5) for i, v in bad]
    out = centroids.report(*centroids.cluster(spark.createDataFrame(rows, VECTORS).repartition(5)))
    assert out.count() == 203
    same(out.collect(), out.columns, centroids.OP12_SQL, {"embeddings": arrow(rows)})


def test_clusters_of_few_vectors(spark):
    rows = vectors(7, np.random.default_rng(1))
    out = centroids.report(*centroids.cluster(spark.createDataFrame(rows, VECTORS)))
    assert sorted(r["cluster"] for r in out.collect()) == list(range(7)) and all(r["inertia"] == 0 for r in out.collect())
    assert centroids.report(*centroids.cluster(spark.createDataFrame([], VECTORS))).collect() == []


def test_products_stay_exact(spark):
    """After all rounds each product is that of the vector with the last centroids; only changed components were used."""
    rows = vectors(90, np.random.default_rng(9))
    state, last = centroids.cluster(spark.createDataFrame(rows, VECTORS), n=6, rounds=3)
    for r in state.collect():
        x = np.array(r["x"])
        assert r["dots"] == (last @ x).tolist()
        far = ((last - x) ** 2).sum(axis=1)
        assert (r["cluster"], r["distance"]) == (int(far.argmin()), int(far.min()))


def test_component_too_large(spark):
    rows = [(1, [1e9] + [0.0] * 63, 0, "c", 1, 0.5)]
    with pytest.raises(Exception, match="lies beyond"):
        centroids.cluster(spark.createDataFrame(rows, VECTORS))


DOCS = "doc_id long, text string, lang string, source string, df int, term string, rank int"


def texts(rng, n):
    words = ["Alpha", "beta", "GAMMA", "straße", "été", "ÉTÉ", "naïve", "x1y", "don't", "data", "model", "zeta"]
    return [(i, " ".join(words[int(w)] for w in rng.integers(0, 3 + i % 9, rng.integers(1, 40))), ("en", "de", None)[i % 3], ("a", "b", None, "", "é")[i % 5], 1, "t", 2) for i in range(n)]


@pytest.mark.parametrize("held, part", [(300_000, 8192), (3, 2)])
def test_divergences_of_odd_texts(spark, held, part):
    """Nulls, empty and long texts, ties, repeated rows, a group and a language without terms; with spills and many parts."""
    rows = texts(np.random.default_rng(2), 150)
    rows += [rows[0]] * 5 + [(None, None, None, None, 1, "t", 2), (900, "", "en", "only", 1, "t", 2), (901, "Alpha\x00beta " * 20_000, "en", "a", 1, "t", 2), (902, "rare words", "fr", "a", 1, "t", 2), (903, None, "fr", "b", 1, "t", 2), (904, "alone", "it", "a", 1, "t", 2)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    out = divergence.audit(docs, held=held, part=part)
    frame = pa.table({c: pa.array([r[k] for r in rows]) for k, c in enumerate(("doc_id", "text", "lang", "source"))})
    theirs = same(out.collect(), out.columns, divergence.OP13_SQL, {"documents": frame})
    assert ("fr", "a", "pair", "b", 0, 1) in theirs and not any(r[0] == "it" for r in theirs)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_probabilities_of_large_counts():
    for c, n, v in ((0, 0, 1), (5, 17, 3), (8 * 10**13, 8 * 10**13, 10**6), (10**12, 3 * 10**13, 7)):
        assert divergence.probabilities(np.array([c]), n, v)[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)


def terms_by_hand(text):
    """A text's words and prefixes as bytes; their hashes by the operator's own function."""
    words = {w.translate({65 + k: chr(97 + k) for k in range(26)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")}
    every = set()
    for w in words:
        h = toxicity.word_hashes(pa.array([w]))[0]
        every |= {(k, w.encode() if k == 0 else w.encode()[: toxicity.PREFIXES[k - 1]], int(x)) for k, x in enumerate(h) if x}
    return every


def test_hashes_tell_terms_apart(spark):
    seen = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        for k, term, h in terms_by_hand(r["text"]):
            assert seen.setdefault(h, (k, term)) == (k, term)
    assert len(seen) > 1000


def test_scores_by_hand(spark):
    """The score of each text is the logistic of the model's offset, weights and pairs, added up one by one."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept, offset, weights, vectors = model = toxicity.train(toxicity.labelled_texts(docs, labels))
    assert len(kept) > 5
    place = {int(h): k for k, h in enumerate(kept)}
    rows = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    for d in docs.limit(150).collect():
        own = sorted(place[h] for _, _, h in terms_by_hand(d["text"]) if h in place)
        z = offset + sum(weights[i] for i in own) + sum(float(vectors[i] @ vectors[j]) for a, i in enumerate(own) for j in own[a + 1 :])
        r = rows[d["doc_id"]]
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-30, min(30, z)))), abs_tol=1e-9)
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)


def test_held_out_labels_change_nothing(spark):
    """Nor does the way rows are dealt."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs.repartition(7), turned).collect()}
    assert all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)


def test_words_that_are_toxic_together(spark):
    """Insults alone and groups alone are harmless, both together are toxic: no sum of weights tells all three apart."""
    rng = np.random.default_rng(3)
    insults, groups, rest = ["badone", "worseone"], ["groupa", "groupb"], [f"word{chr(97 + k)}" for k in range(20)]
    rows, marks = [], []
    for i in range(1600):
        words = [rest[int(k)] for k in rng.integers(0, 20, 12)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += [insults[int(rng.integers(0, 2))]] * insult + [groups[int(rng.integers(0, 2))]] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(insult and group)))
    out = {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in rows if out[i]["held_out"]]
    assert sum(out[i]["predicted"] == marks[i][1] for i in held) > 0.97 * len(held) > 200


def test_toxicity_of_odd_rows(odd, none, labels):
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {True}
    empty = {r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}
    assert len(empty) == 1
    assert toxicity.toxicity(none, labels).collect() == []
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {(0.25, 0)}


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in registry.QUERIES["op11_toxicity"](spark, sf).collect()}
    marks = [(rows[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(r["predicted"] for r, t in marks if t) > 0.85 * sum(t for _, t in marks)
    assert sum(r["predicted"] for r, t in marks if not t) < 0.01 * len(marks)
