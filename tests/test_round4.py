"""Findings of round 4: what larger tables showed, on small ones."""

from pyspark.sql import functions as F

from threatweave.operators import extract as ex
from threatweave.operators import joins as jo
from threatweave.operators import patterns as pt
from threatweave.operators import records as re_
from threatweave.operators import specs as sp
from threatweave.sources.writers import stored
from threatweave.streaming import jobs as st


def test_seen_in_with_ids_that_repeat(spark):
    """ids cut to a width name several rows; a link means its own row, live or not."""
    research = spark.createDataFrame([(1000001, "TR-100000", 5, "draft"), (1000002, "TR-100000", 7, "archived"), (1000003, "TR-100000", 9, "draft"), (3, "TR-3", 1, "draft")], "rid long, research_id string, created_at int, status string")
    links = spark.createDataFrame([(1000001, "a"), (1000001, "a"), (1000002, "b"), (1000003, "c"), (3, "a"), (1000003, "a")], "rid long, entity_key string").withColumn("entity_type", F.lit("malware"))
    out = jo.seen_in(links, research, entity_type="malware", key="rid").collect()
    assert {r["entity_key"]: r["research"] for r in out} == {"a": ["TR-100000", "TR-100000", "TR-3"], "c": ["TR-100000"]}


def test_texts_are_not_shuffled_by_token(spark, monkeypatch):
    """a dictionary goes to the texts while it is small; beyond that tokens are shuffled without their texts. Names sharing a first token don't meet."""
    docs = spark.createDataFrame([(i, f"see Supplier#{i:05d} and group{i % 3}, ALIAS{i % 2}") for i in range(40)], "doc_id long, text string")
    names = [(f"Supplier#{i:05d}", f"s{i}") for i in range(0, 80, 2)] + [("Group1", "g1"), ("group1", "g9"), ("alias", "no")]
    want = {(i, f"s{i}") for i in range(0, 40, 2)} | {(i, g) for i in range(1, 40, 3) for g in ("g1", "g9")}
    n = spark.createDataFrame(names, "name string, canonical string")
    monkeypatch.setattr(ex, "stored", lambda rows, name: rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (500_000, 0):
            monkeypatch.setattr(ex, "BROADCAST_NAMES", most)
            near = ex.name_hits(docs, n)
            plan = near._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin [token" in plan) == (most > 0)
            assert sorted(tuple(r) for r in ex.dictionary_hits(docs, n).collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_seed_names_gathers_names_not_actors(spark):
    """an alias of many actors is one name of a seed until the end; seeds that name nothing stay."""
    actors = spark.createDataFrame([(f"Actor {i:03d}", ["Shared", f"Own{i}"]) for i in range(300)], "name string, aliases array<string>")
    malware = spark.createDataFrame([("mal7",), ("abc",)], "name string")
    seeds = spark.createDataFrame([(1, "by SHARED and APT7 with Mal7 abc"), (2, "by own5 and actor 005"), (3, None), (4, "nobody")], "doc_id long, text string")
    rows = {r["doc_id"]: (r["actors"], r["malware"]) for r in re_.seed_names(seeds, actors, malware).collect()}
    assert rows == {1: (["APT7"] + [f"Actor {i:03d}" for i in range(300)], ["mal7"]), 2: (["Actor 005"], []), 3: ([], []), 4: ([], [])}


def test_equal_specifications_are_compared_once(spark, monkeypatch):
    """five hundred specifications with two kinds of conditions are two comparisons an event, and give all their ids; so do streams."""
    kinds = [[("a", "endswith", ["X"])], [("a", "contains", ["q"]), ("b", "equals", ["1"])]]
    specs = stored(spark.createDataFrame([(f"s{i}", "p", kinds[i % 2]) for i in range(500)] + [(None, "p", kinds[0]), ("s0", "p", kinds[0])], sp.SPEC), "specs")
    events = spark.createDataFrame([(1, "p", "aqx", "1"), (2, "p", "qq", "1"), (3, "p", "q", "2"), (4, "r", "x", "1")], "id int, category string, a string, b string")
    sizes, anchors = [], sp.anchors
    monkeypatch.setattr(sp, "anchors", lambda rows: sizes.append(rows.count()) or anchors(rows))
    want = [(1, f"s{i}") for i in range(500)] + [(2, f"s{i}") for i in range(1, 500, 2)] + [(1, None)]
    for rows in (sp.matches(events, specs), st._finished(sp.matches(st._stream(events), specs))):
        assert sorted((tuple(r) for r in rows.select("id", "spec_id").collect()), key=repr) == sorted(want, key=repr)
    assert sizes == [2, 2]


def test_names_of_a_scope_go_to_its_texts(spark, monkeypatch):
    """F1 to F5: patterns of a scope meet its texts as a list, whose plan cuts no text into runs; scopes with many meet by anchors, with the same results."""
    texts = [(s, i, f"text {i} of name{i % 5} and é{i % 3}") for s in range(4) for i in range(12)] + [(1, 99, None), (9, 1, "name1")]
    patterns = [(s, k, f"name{k}") for s in range(4) for k in range(s, 5)] + [(2, 7, ""), (3, 8, None), (1, 1, "é0"), (1, 1, "name1")] + [(0, 50 + k, f"none{k}") for k in range(20)]
    t = spark.createDataFrame(texts, "s int, text_id int, text string")
    p = spark.createDataFrame(patterns, "s int, pattern_id int, pattern string")
    want = sorted({(a, i, j) for a, i, x in texts for b, j, y in patterns if a == b and x and y and y in x})
    for each in (256, 6, 0):
        monkeypatch.setattr(pt, "EACH", each)
        out = pt.occurrences(t, p, scope=["s"])
        assert sorted(tuple(r) for r in out.collect()) == want
        assert ("xxhash64" in out._jdf.queryExecution().optimizedPlan().toString()) == (each < 256)


def test_relations_of_indicators_with_several_texts(spark, monkeypatch):
    """the best that any text of an indicator says counts; research that names much gives the same."""
    named = [(1, "malware", "mal1", "m1"), (1, "malware", "mal1", "m1"), (1, "actor", "Fox", "a1"), (1, "actor", "owl", "a2"), (2, "actor", "fox", "a3"), (2, "tool", "x", "t"), (3, "malware", "", "m0")]
    texts = [(1, "i", "by FOX"), (1, "i", "with MAL1"), (1, "j", "by fox"), (1, "j", "nobody"), (1, "k", None), (1, "k", "nobody"), (2, "l", "x"), (3, "n", "mal"), (4, "o", "fox")]
    want = [("i", "m1"), ("j", "a1"), ("k", "a1"), ("k", "a2"), ("l", "a3")]
    for each in (256, 2, 0):
        monkeypatch.setattr(pt, "EACH", each)
        out = jo.stix_relations(spark.createDataFrame(named, "research_id int, type string, name string, entity_id string"), spark.createDataFrame(texts, "research_id int, indicator_id string, text string"))
        assert sorted((r["src"], r["dst"]) for r in out.collect()) == want
        assert ("xxhash64" in out._jdf.queryExecution().optimizedPlan().toString()) == (each < 256)


def test_actor_matches_are_told_once(spark):
    """actors that share several names with a research are one row each, without an exchange of the matches."""
    library = spark.createDataFrame([("a", "Fox", ["Red", "FOX", ""]), ("b", "Owl", ["red", None]), ("a", "Cat", None), ("c", None, ["x"])], "actor_id string, name string, aliases array<string>")
    named = spark.createDataFrame([(1, "s", "RED", ["fox", "cat"]), (1, "s", "fox", None), (1, "t", "owl", ["red", ""]), (2, "s", None, [None, "Cat"]), (3, None, "X", None), (4, "s", "none", ["none"])], "research_id int, source_id string, name string, aliases array<string>")
    out = re_.actor_matches(library, named)
    want = [("a", 1, "s"), ("b", 1, "s"), ("a", 1, "t"), ("b", 1, "t"), ("a", 2, "s"), ("c", 3, None)]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(actor_id#" not in plan.split("BroadcastExchange")[0]


def test_quotes_are_looked_for_without_cutting_texts(spark, monkeypatch):
    """a few n-grams are looked for in the text as whole words; many are compared with the text's own; both give the same."""
    quotes = [(1, 1, "alpha beta gamma delta zz yy"), (2, 1, "alpha beta gamma delta epsilon zeta eta theta xx"), (3, 1, "lph beta"), (4, 1, "zeta"), (5, 1, "eta zeta"), (6, 2, "a"), (7, 2, ""), (8, 9, "alpha")]
    texts = [(1, "Alpha, beta gamma - delta epsilon; zeta eta theta."), (2, "")]
    args = spark.createDataFrame(quotes, "quote_id int, source_id int, quote string"), spark.createDataFrame(texts, "source_id int, text string")
    monkeypatch.setattr(jo, "FEW_GRAMS", 0, raising=True)
    want = {r["quote_id"]: r["found"] for r in jo.quotes_found(*args).collect()}
    monkeypatch.setattr(jo, "FEW_GRAMS", 64)
    assert {r["quote_id"]: r["found"] for r in jo.quotes_found(*args).collect()} == want == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True}


def test_exposure_is_not_dealt_twice(spark):
    """pairs of research and workspace aren't sorted, nor dealt once more; the first product that matches is told."""
    affected = spark.createDataFrame([(1, "Mail Server 2019"), (1, "Mail Server 2019"), (1, "web gate"), (2, "nothing")], "research_id int, product string")
    owned = spark.createDataFrame([("w1", 2, "Mail server"), ("w1", 1, "Web thing"), ("w2", 5, "mail"), ("w3", 1, "other"), ("w9", 1, "mail")], "workspace_id string, pos int, product string")
    spaces = spark.createDataFrame([("w1",), ("w2",), ("w3",)], "workspace_id string")
    out = jo.applicability(affected, owned, spaces)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("hashpartitioning(research_id#") == 1
    assert sorted(tuple(r) for r in out.collect()) == [(1, "w1", "exposed", "runs web thing"), (1, "w2", "exposed", "runs mail")]
