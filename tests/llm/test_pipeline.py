"""The stages one after another: each works on what the one before kept."""

import corpus_pipeline
from threatweave.llm import minhash, pii
from threatweave.llm.common import new_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dedup", "decontamination", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = new_path(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns
        now = {r["doc_id"]: r for r in out.collect()}
        assert set(now) <= set(before) and (name == "personal_data") == (set(now) == set(before))
        if name != "personal_data":
            assert all(now[i] == before[i] for i in now)
        docs, before = out, now
    assert all(r["n_email"] == 0 for r in pii.digest(pii.find_spans(docs)).collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(before)


def test_stages_on_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_near_dedup_takes_similarity_of_80(spark):
    """Copies of 100 words, the last 10 changed: 86 of 106 shingles are common. Changed in the last 14: 82 of 110."""
    words = [f"word{i}" for i in range(100)]
    texts = [" ".join(words[: 100 - n] + [f"other{n}x{i}" for i in range(n)]) for n in (0, 10, 14)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {0, 2}
    assert all(r["kept"] for r in minhash.near_duplicates(docs, minhash.NEED).collect())


def test_quality_drops_bad_and_toxic(spark):
    """What the stage leaves of labelled documents: trusted ones, few bad ones, and less than half of the toxic ones."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf).select("doc_id").collect()}
    share = lambda want: sum(i in left for i, x in labels.items() if want(x)) / sum(map(want, labels.values()))
    assert share(lambda x: x == (1, 0)) > 0.97 and share(lambda x: x[0] == 0) < 0.15 and share(lambda x: x == (1, 1)) < 0.5
