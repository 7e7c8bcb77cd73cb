"""Every operator on odd rows and on empty tables."""

import pytest

from threatweave.llm import chunk_dedup, decontaminate, kneser_ney, licenses, minhash, packing, pii, quality_rules, sharding, token_files, tokens
from threatweave.llm.common import new_path

OPERATORS = {
    "pii": lambda d, labels, bench: pii.digest(pii.find_spans(d)),
    "redact": lambda d, labels, bench: pii.redact(d),
    "minhash": lambda d, labels, bench: minhash.near_duplicates(d),
    "quality": lambda d, labels, bench: quality_rules.quality_rules(d, labels),
    "chunks": lambda d, labels, bench: chunk_dedup.substring_dedup(d),
    "decontaminate": lambda d, labels, bench: decontaminate.decontaminate(d, bench),
    "shards": lambda d, labels, bench: sharding.shard(d),
    "perplexity": lambda d, labels, bench: kneser_ney.quality_classifier(d, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_document(name, odd, labels, benchmark):
    out = OPERATORS[name](odd, labels, benchmark).collect()
    assert len(out) == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, none, labels, benchmark):
    assert OPERATORS[name](none, labels.limit(0), benchmark.limit(0)).collect() == []


def test_token_files_and_packing(spark, odd, none):
    for docs, n in ((odd, odd.count()), (none, 0)):
        uri = new_path(spark, "test-tokens")
        token_files.write_token_files(docs, uri, tokenizer_path=tokens.default_path(), end_id=1)
        rows = token_files.read_token_files(spark, uri).collect()
        assert len(rows) == n
        ordered = sorted(rows, key=lambda r: r["start"])
        assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:i]) for i in range(n)]
        keys = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
        assert keys == sorted(keys)
        pieces = packing.pack(docs, tokenizer_path=tokens.default_path(), end_id=2).collect()
        assert sum(p["length"] for p in pieces) == sum(r["n_tokens"] for r in rows)


def test_licence_scan(spark, odd, none):
    assert licenses.scan(none).collect() == []
    extra = spark.createDataFrame([(50, "Some text here about rivers.\nReleased under the MIT License.\nMore of it."), (51, "Licensed under CC BY-NC 4.0."), (52, "All about a licence to drive and the mit hall.")], "doc_id long, text string")
    found = {r["doc_id"]: r["families"] for r in licenses.scan(odd.select("doc_id", "text").unionByName(extra)).collect()}
    assert found[50] == ["MIT"] and found[51] == ["CC-BY-NC"] and 1 not in found


def test_minhash_ties_and_repeats(odd):
    rows = minhash.near_duplicates(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["component_id"] for i in (1, 2) for r in by[i]} == {1}
    assert [r["kept"] for r in by[2]] == [False, False]
    assert all(r["n_shingles"] == 0 and r["kept"] for r in by[3] + by[4] + by[5])
    assert all(r["component_id"] is None and r["kept"] for r in by[None])


def test_redaction_keeps_the_rest(odd):
    rows = {r["doc_id"]: r for r in pii.redact(odd).collect()}
    assert rows[9]["text"] == "mail <EMAIL> or <IP>" and rows[9]["n_chars"] == len("mail <EMAIL> or <IP>")
    assert rows[3]["text"] is None and rows[1]["spans"] == "z"


def test_nothing_trusted_keeps_all(odd, labels):
    assert all(r["kept"] for r in kneser_ney.quality_classifier(odd, labels.limit(0)).collect())


def test_decontamination_tolerates_substitutions(spark, benchmark):
    from .conftest import TEXT

    words = TEXT.split()[10:40]
    words[6] = words[17] = words[25] = "other"
    docs = spark.createDataFrame([(1, "Before. " + " ".join(words).upper() + " After."), (2, "nothing of the kind at all in these few words here today")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert rows[1]["item_ids"] == [1] and not rows[1]["kept"] and rows[2]["kept"]


def test_short_items_match_as_they_are(spark):
    import duckdb

    items = [(1, "alpha beta gamma delta epsilon"), (2, "One two three, four five six SEVEN"), (3, "four words are few"), (4, "nine words in a row are still rather short"), (None, "alpha beta gamma delta zeta"), (5, "alpha beta gamma delta epsilon")]
    texts = [
        (1, "x Alpha, beta gamma delta epsilon y"), (2, "alpha beta gamma x epsilon"), (3, "one two three four five six seven. Alpha beta gamma delta epsilon"), (4, "four words are few"),
        (5, None), (6, ""), (7, "alpha"), (7, "a alpha beta gamma delta epsilon"), (8, "nine words in a row are still rather short" + " z" * 20_000), (9, "alpha beta gamma delta epsilonx"), (None, "alpha beta gamma delta epsilon"),
    ]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in texts], "doc_id long, text string, seed string, matched int")
    bench = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, words string")
    found = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {1: [1, 5], 3: [1, 2, 5], 7: [1, 5], 8: [4]}
    out = decontaminate.decontaminate(docs, bench).collect()
    assert len(out) == len(texts) and sum(not r["kept"] for r in out) == 5
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts[:6] + texts[8:10])
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", [i for i in items if i[0] is not None])
    mine = decontaminate.decontaminate(docs.filter("doc_id not in (7)"), bench)
    assert sorted(tuple(r) for r in mine.collect()) == sorted(con.sql(f"select {', '.join(mine.columns)} from ({decontaminate.OP6_SQL})").fetchall())


def test_minhash_ids_that_repeat_join_no_strangers(spark):
    """Two texts under one id stay apart; each joins its own copies, also where the sets of an id meet in one bucket."""
    a, b = " ".join(f"left{i}" for i in range(60)), " ".join(f"right{i}" for i in range(60))
    rows = [(1, a), (2, a + " more"), (2, b), (3, b), (4, a + " again"), (4, a + " again"), (5, None), (5, a)]
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(1, 56, 1, True), (2, 56, 2, True), (2, 57, 1, False), (3, 56, 2, False), (4, 57, 1, False), (4, 57, 1, False), (5, 0, 5, True), (5, 56, 1, False)]


def test_substituted_items_of_every_length(spark):
    """Items of 10 words and more with each word substituted at 5 %: at least nine in ten are found; other texts aren't."""
    import numpy as np

    rng = np.random.default_rng(5)
    items, docs = [], []
    for n in (10, 11, 12, 13, 15, 20, 40):
        for k in range(300):
            words = [f"w{rng.integers(0, 5000)}" for _ in range(n)]
            items.append((n * 1000 + k, " ".join(words)))
            changed = [f"x{rng.integers(0, 5000)}" if rng.random() < 0.05 else w for w in words]
            docs.append((n * 1000 + k, " ".join([*(f"w{rng.integers(0, 5000)}" for _ in range(30)), *changed, "end"])))
    plain = [(100_000 + k, " ".join(f"w{rng.integers(0, 5000)}" for _ in range(60))) for k in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(spark.createDataFrame(docs + plain, "doc_id long, text string"), bench).collect()}
    for n in (10, 11, 12, 13, 15, 20, 40):
        assert sum(n * 1000 + k in found.get(n * 1000 + k, []) for k in range(300)) >= 270
    assert not any(i >= 100_000 for i in found)


def test_items_of_any_length(spark):
    docs = spark.createDataFrame([(1, "say four words are few now"), (2, "four words are"), (3, "one")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Four words are few"), (2, "one"), (3, "")], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).collect() == []
    assert {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(docs, bench, shortest=1).collect()} == {1: [1], 3: [2]}
