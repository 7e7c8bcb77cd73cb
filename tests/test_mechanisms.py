"""Patterns by anchors, indexes, numbering, streams and the object graph against brute force."""

import datetime as dt
import random
import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from threatweave.operators import index as ix
from threatweave.operators import patterns as pt
from threatweave.operators import provenance as pv
from threatweave.operators import specs as sp
from threatweave.plans import queries_stix, queries_streams, registry
from threatweave.plans.domain import GIVEN
from threatweave.plans.registry import Tables
from threatweave.sources import stix as sx
from threatweave.sources.writers import folder, stored
from threatweave.streaming import stateful as sf

from .conftest import SF
from .test_oracle import plain

NEW = ["j17_provenance_backfill", "j18_inferred_sources", "f10_spec_index", "x01_trigram_index", "k05_stix_graph", "k06_stix_faults", "ss01_feed_in_batches", "ss02_views_in_batches", "ss09_runs_in_batches", "m06_stored_upserts", "e05_seed_names", "p17_compatible"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(registry.SQL[name])
    at = [rel.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr) and mine


def no_nested_loop(df):
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_occurrences(spark):
    """Patterns of every length from one character on, in any script, with and without a scope."""
    rng = random.Random(7)
    letters = "abcé日x "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(rng.randrange(3), i, word(rng.randrange(0, 120))) for i in range(150)] + [(0, 900, None), (1, 901, ""), (2, 902, "ab" * 5000)]
    patterns = [(rng.randrange(3), i, word(rng.choice((1, 2, 3, 5)))) for i in range(60)]
    patterns += [(s, 1000 + i, t[a : a + n]) for i, (s, _, t) in enumerate(texts[:120]) if t for a, n in [(rng.randrange(len(t)), rng.choice((4, 9, 14, 20, 40)))]]
    patterns += [(0, 2000, ""), (0, 2001, None), (2, 2002, "ab" * 30), (0, 3, "zz"), (0, 3, "a")]
    t = spark.createDataFrame(texts, "s int, text_id int, text string")
    p = spark.createDataFrame(patterns, "s int, pattern_id int, pattern string")
    want = {(a, i, j) for a, i, x in texts for b, j, y in patterns if a == b and x and y and y in x}
    out = pt.occurrences(t, p, scope=["s"])
    no_nested_loop(out)
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) == want and len(rows) == len(want) > 500
    free = {(i, j) for _, i, x in texts for _, j, y in patterns if x and y and y in x}
    assert {tuple(r) for r in pt.occurrences(t, p).collect()} == free
    assert pt.occurrences(t, p.limit(0), scope=["s"]).collect() == []


def test_anchors_cut_candidates(spark):
    """A thousand long patterns with one begin in common: each text meets few of them."""
    patterns = [(i, f"https://www.example.org/shared/path/{i:05d}/page") for i in range(1000)]
    texts = [(i, f"see https://www.example.org/shared/path/{i:05d}/page today") for i in range(0, 1000, 10)]
    out = pt.occurrences(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(patterns, "pattern_id int, pattern string"))
    assert {tuple(r) for r in out.collect()} == {(i, i) for i, _ in texts}


def test_numbers_within_ranges(spark):
    rows = [(k, p) for k in (1, 2) for p in random.Random(k).sample(range(500), 60)]
    out = pt.sequence_within(spark.createDataFrame(rows, "k int, pos long"), ["k"], "pos", "n", width=7).collect()
    assert {(r["k"], r["pos"]): r["n"] for r in out} == {(k, p): sorted(q for j, q in rows if j == k).index(p) + 1 for k, p in rows}


Q = "research_id int, pos int, query_id string, opportunity_id string, origin string, type string, provenance string, group_id string, title string, data_sources array<string>, techniques array<string>, source_ids array<string>"


def test_backfill_of_one_record(spark):
    """Every branch once: numbers carry on from those a record has, titles share one, later detections replace earlier ones."""
    queries = [
        (1, 0, "a", "DO-1", "x", "ttp", None, None, "t", None, None, None), (1, 1, "b", None, "reference", "ttp", None, "", "V (vendor, S7)", None, None, None), (1, 2, "c", "", "x", "ioc", "odd", None, "t", [], None, None),
        (1, 3, "d", None, "x", "ioc", None, None, "t", ["file_hash"], None, None), (1, 4, "e", None, "x", "vuln", None, None, "t", None, None, None), (1, 5, "f", None, "x", "ttp", None, None, "Two", None, ["T1"], None),
        (1, 6, "g", None, "x", "ioa", None, None, "One", None, ["T9"], None), (1, 7, "h", None, "x", "ttp", None, None, "Two", None, None, ["own"]), (1, 8, "i", None, "x", "ttp", "vendor", "VREF-4", "t", None, None, None),
        (1, 9, "j", "gone", None, None, None, None, None, None, None, None), (1, 10, "k", "X-2", "reference", "ttp", None, None, "t", None, None, None), (1, 11, "l", None, "reference", "x", None, None, "none", None, None, None), (2, 0, "a", "DO-1", "x", "ttp", None, None, "t", None, None, None),
    ]
    opps = [(1, 0, "DO-1", "AP-1.1", ["T1"], ["S9"]), (1, 1, "DO-1", "AP-1.1", ["T1"], None), (1, 2, "X-2", "none", ["T1", "T2"], None)]
    steps = [(1, 0, "AP-1.1", ["S1"]), (1, 1, "AP-1.1", ["S10", "S2", "S10", ""])]
    mitre = [(1, "T1", ["S3", "S2"]), (1, "T2", ["S11"]), (2, "T1", ["S5"])]
    iocs = [(1, "md5", ["S6"]), (1, "sha256", ["S12", "S6"]), (1, "ipv4", ["S1"])]
    o = "research_id int, pos int, opportunity_id string, behaviour_ref string, techniques array<string>, source_ids array<string>"
    s = "research_id int, pos int, ref string, source_ids array<string>"
    args = [spark.createDataFrame(queries, Q), spark.createDataFrame(opps, o), spark.createDataFrame(steps, s), spark.createDataFrame(mitre, "research_id int, technique_id string, source_ids array<string>"),
            spark.createDataFrame(iocs, "research_id int, type string, source_ids array<string>"), spark.createDataFrame([(1, ["S8", "S4"])], "research_id int, source_ids array<string>")]
    rows = {(r["research_id"], r["query_id"]): (r["provenance"], r["group_id"], r["source_ids"]) for r in pv.backfilled(*args).collect()}
    assert rows == {
        (1, "a"): ("derived", "DET-1", ["S2", "S10"]), (1, "b"): ("vendor", "VREF-2", ["S7"]), (1, "c"): ("derived", "IOC-IPV4", []), (1, "d"): ("derived", "IOC-SHA256", ["S6", "S12"]), (1, "e"): ("derived", "VULN-1", ["S4", "S8"]),
        (1, "f"): ("generic", "TTP-1", ["S2", "S3"]), (1, "g"): ("derived", "TTP-2", []), (1, "h"): ("generic", "TTP-1", ["own"]), (1, "i"): ("vendor", "VREF-4", []), (1, "j"): ("derived", "TTP-3", []),
        (1, "k"): ("vendor", "DET-X-2", ["S2", "S3", "S11"]), (1, "l"): ("vendor", "VREF-3", []), (2, "a"): ("generic", "TTP-1", []),
    }


def test_five_thousand_specifications(spark):
    """All against all events, equal to brute force; a plan without nested loops that doesn't grow with their number."""
    rng = random.Random(3)
    parts = ["Alpha", "beta", "-ENC", "x", "é", "", "gamma.exe", "long literal with blanks", "0123456789abcdef"]
    value = lambda: "".join(rng.choice(parts) for _ in range(rng.choice((0, 1, 1, 2, 3))))
    specs = [(f"s{i}", rng.choice("pq"), [(rng.choice(("a", "b")), rng.choice(sp.OPS), [value() for _ in range(rng.choice((1, 1, 2)))]) for _ in range(rng.choice((1, 2, 2)))]) for i in range(5000)]
    specs += [("none", "p", []), ("null", "p", None), ("lost", "p", [("missing", "equals", ["x"])]), ("odd", "p", [("a", "like", ["x"])]), ("empty", "p", [("a", "equals", [])])]
    events = [(i, rng.choice("pqr"), None if rng.random() < 0.1 else value() + value(), value()) for i in range(120)]
    test = {"equals": lambda x, v: x == v, "startswith": str.startswith, "endswith": str.endswith, "contains": lambda x, v: v in x}
    want = []
    for i, category, a, b in events:
        low = {"a": a and a.lower() if a else a, "b": b.lower()}
        for name, of, conditions in specs:
            if of == category and conditions and all(c[0] in low and c[1] in test and low[c[0]] is not None and any(test[c[1]](low[c[0]], v.lower()) for v in c[2]) for c in conditions):
                want.append((i, name))
    out = sp.matches(spark.createDataFrame(events, "id int, category string, a string, b string"), stored(spark.createDataFrame(specs, sp.SPEC), "specs")).select("id", "spec_id")
    no_nested_loop(out)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and len(want) > 3000
    few = sp.matches(spark.createDataFrame(events, "id int, category string, a string, b string"), stored(spark.createDataFrame(specs[:200], sp.SPEC), "specs"))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(out) < 1.5 * size(few)


def test_search_reads_its_buckets_only(spark):
    rows = spark.createDataFrame([(i, f"text {i % 7} of needle{i % 5} and more{i}") for i in range(200)], "id long, text string")
    path = folder(spark, "trigrams")
    ix.create(rows, "id", "text", path, buckets=32)
    want = {i for i in range(200) if i % 5 == 3}
    assert {r["id"] for r in ix.search(rows, "id", "text", path, " NEEDLE3 ").collect()} == want
    import zlib

    needed = {zlib.crc32(t.encode()) % 32 for t in ("nee", "eed", "edl", "dle", "le3")}
    gone = 0
    for part in Path(path.removeprefix("file://")).glob("segment-1/bucket=*"):
        if int(part.name.split("=")[1]) not in needed:
            shutil.rmtree(part)
            gone += 1
    assert gone > 10 and {r["id"] for r in ix.search(rows, "id", "text", path, "needle3").collect()} == want


def test_index_of_changes(spark):
    """Texts change, ids go and come back, a segment without a commit is not read, and compaction changes no answer."""
    schema = "id long, text string"
    path = folder(spark, "trigrams")
    now = {i: f"alpha beta{i}" for i in range(30)}
    frame = lambda d: spark.createDataFrame(list(d.items()), schema)
    found = lambda q: {r["id"] for r in ix.search(frame(now), "id", "text", path, q).collect()}
    by_hand = lambda q: {i for i, t in now.items() if q in t}
    ix.create(frame(now), "id", "text", path)
    for change in ({3: "gamma delta", 4: "alpha gamma"}, {3: "alpha again", 40: "gamma new"}):
        now |= change
        ix.put(frame(change), "id", "text", path)
    for i in (4, 7):
        del now[i]
    ix.remove(spark.createDataFrame([(4,), (7,)], "id long"), "id", path)
    now[7] = "back gamma"
    ix.put(frame({7: "back gamma"}), "id", "text", path)
    ix._segment(ix.trigrams(frame({99: "alpha lost"}), "id", "text").withColumn("seq", F.lit(99).cast("long")), f"{path}/segment-99", 64)
    for again in range(2):
        assert all(found(q) == by_hand(q) for q in ("alpha", "gamma", "beta1", "delta", "new", "zzz"))
        assert {r["id"] for r in ix.candidates(spark, path, "alpha").collect()} == by_hand("alpha")
        ix.compacted(spark, path)
    assert len(ix._log(spark, path)) == 1
    with pytest.raises(ValueError):
        ix.candidates(spark, path, "ab")


def test_state_of_views_ends(spark):
    """Many keys, each seen on one day: state holds the keys of the last days only."""
    start = dt.datetime(2024, 1, 1)
    rows = [(f"k{d}-{i}", start + dt.timedelta(days=d, minutes=i * 10 + m), d) for d in range(6) for i in range(20) for m in (0, 5, 12)]
    stream, n = sf.in_batches(spark.createDataFrame(rows, "key string, seen_at timestamp, batch int"), "batch", "views")
    with sf.timers(spark):
        out, progress = sf.finished(sf.spaced_views(stream, minutes=10))
    assert n == 6 and sorted((r["key"], r["seen_at"]) for r in out.collect()) == sorted((k, t) for k, t, _ in rows if (t - start).seconds // 60 % 10 != 5)
    held = sf.state_rows(progress)
    assert len(held) >= 6 and max(held) <= 4 * 2 * 20 and spark.conf.get(sf.PROVIDER, None) != sf.ROCKSDB


def test_late_entries_are_counted_and_runs_remember(spark):
    t = Tables(spark, SF)
    seen = folder(spark, "feed-seen")
    rows = queries_streams.arrivals(t)
    stream, _ = sf.in_batches(rows, "batch", "feed-in")
    late = sf.late_rows(sf.feed_run(stream, seen, run=0, lateness="10 hours"))
    known = sf.known_feed(spark, seen, rows.drop("batch").withColumn("canonical", F.lit("")).schema)
    first = known.collect()
    assert late > 0 and len({r["canonical"] for r in first}) == len(first) > 20
    stream, _ = sf.in_batches(rows, "batch", "feed-in")
    sf.feed_run(stream, seen, run=1, lateness="10 hours")
    again = known.sparkSession.read.schema(known.schema).parquet(seen).collect()
    # What came too late in the first run may come in time in none; nothing known is added twice.
    assert len({r["canonical"] for r in again}) == len(again) == len(first)


def test_graph_without_faults(spark):
    objects = stored(sx.graph(*queries_stix._sections(Tables(spark, SF))), "objects")
    refs = sx.report_refs(objects)
    assert sx.problems(objects, refs).collect() == []
    assert {r["type"] for r in objects.select("type").distinct().collect()} == set(sx.REQUIRED)
    bodies = sx.bodies(objects.filter("type = 'malware'").limit(5)).collect()
    assert all('"is_family":true' in r["body"] and "null" not in r["body"] for r in bodies)
    assert sx.shared(objects).count() == 6


def test_exact_medians(spark):
    """Ties, one value, even and odd numbers, far outliers and negative values; with bins that must be cut again and again."""
    import statistics

    from threatweave.operators.aggregates import exact_medians

    rng = random.Random(5)
    groups = {
        "even": [rng.gauss(0, 1) for _ in range(1000)], "odd": [rng.expovariate(1) for _ in range(1001)], "far": [1e18, -1e18] + [rng.random() for _ in range(799)], "tie": [2.5] * 300 + [7.0] * 300,
        "one": [4.25], "same": [3.0] * 50, "near": [1 + k * 2**-50 for k in range(400)], "two": [1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("even", None), ("none", None), ("odd", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: statistics.median(v) for k, v in groups.items()}
    assert exact_medians(df, "k", "v", bins=4, few=10) == want == exact_medians(df, "k", "v")


def test_hot_keys_in_parts(spark):
    """A key with half of all articles: the same clusters, and no part with more than its share."""
    from threatweave.operators import graph as gr

    rng = random.Random(2)
    rows = [(i, "hot") for i in range(0, 400, 2)] + [(i, f"k{rng.randrange(150)}") for i in range(400)] + [(7, "hot"), (7, "hot")]
    keys = spark.createDataFrame(rows, "article_id long, key string")
    a = {tuple(r) for r in gr.clusters(keys, split=10).collect()}
    assert a == {tuple(r) for r in gr.clusters(keys).collect()} and len(a) == 400


def test_lists_are_cut_before_they_are_gathered(spark):
    from threatweave.operators import aggregates as ag
    from threatweave.operators import hunt as hu
    from threatweave.operators import ranking as rk

    rows = [(k, i, f"v{i:03d}") for k in ("a", "b") for i in range(60)] + [("c", 1, "x")]
    out = {r["k"]: r["values"] for r in rk.keep_last(spark.createDataFrame(rows, "k string, at int, v string"), ["k"], "at", "v", 5).collect()}
    assert out == {"a": [f"v{i:03d}" for i in range(55, 60)], "b": [f"v{i:03d}" for i in range(55, 60)], "c": ["x"]}
    hits = spark.createDataFrame([("h", dt.datetime(2024, 1, 1, 0, i), f"c{i % 9}" if i % 10 else None) for i in range(40)], "host string, ts timestamp, command_line string")
    r = ag.hunt_rollup(hits, ["host"], lines=4).first()
    assert (r["n"], r["n_lines"], r["command_lines"]) == (40, 9, ["c0", "c1", "c2", "c3"])
    found = [(f"s{i % 7}", "domain", "A.top" if i % 2 else "a.TOP", f"context {i:02d}") for i in range(30)] + [("s9", "md5", "x", None)]
    out = {r["type"]: r for r in ag.merged_indicators(spark.createDataFrame(found, "source_id string, type string, value string, context string")).collect()}
    assert out["domain"]["contexts"] == ["context 00", "context 07", "context 14"] and out["domain"]["n_sources"] == 7 and out["md5"]["contexts"] == []
    assets = spark.createDataFrame([("CVE-1", "s", f"d{i % 80:02d}") for i in range(200)] + [("CVE-2", "s", "d")], "cve string, software string, device string")
    r = hu.exposure(assets, assets.filter("cve = 'CVE-1'")).collect()
    assert [(x["cve"], x["devices"], x["examples"]) for x in r] == [("CVE-1", 80, [f"d{i:02d}" for i in range(50)])]


def test_upserts_touch_their_buckets_only(spark):
    """Rounds of changes, removals and a merge equal a rebuild; what isn't committed is not read; compaction changes nothing."""
    from threatweave.operators import stored as sd

    rng = random.Random(4)
    schema = "a string, b long, v string"
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], schema)
    path = folder(spark, "stored")
    now = {(rng.choice(("x", "y", None)), i if i % 9 else None): f"v{i}" for i in range(120)}
    sd.create(frame(now), ["a", "b"], path, buckets=16)
    rows = lambda: {(r["a"], r["b"]): r["v"] for r in sd.read(spark, path).collect()}
    assert rows() == now
    for k in range(3):
        changes = {key: f"round{k}" for key in rng.sample(sorted(now, key=repr), 4)} | {("new", k): "n"}
        touched = sd.upsert(frame(changes), path)
        now |= changes
        assert rows() == now and 1 <= len(touched) <= 5
        kept = [p.name for p in Path(path.removeprefix("file://")).glob(f"generation-{k + 2}/_bucket=*")]
        assert sorted(kept) == sorted(f"_bucket={b}" for b in touched)
    gone = rng.sample(sorted(now, key=repr), 10)
    sd.remove(frame({k: "" for k in gone}), path)
    now = {k: v for k, v in now.items() if k not in gone}
    assert rows() == now and sd.read(spark, path).count() == len(now)
    longer = lambda current, changes: current.unionByName(changes).groupBy("a", "b").agg(F.concat_ws("+", F.array_sort(F.collect_list("v"))).alias("v"))
    one = next(k for k in now if None not in k)
    sd.upsert(frame({one: "zz"}), path, longer)
    now[one] += "+zz"
    sd._write(frame({("lost", 1): "x"}), ["a", "b"], 16, f"{path}/generation-99")
    assert rows() == now and sd.upsert(frame({}), path) == []
    sd.compacted(spark, path)
    assert rows() == now and len(sd._newest(sd._log(spark, path))) == 1


def test_compatibility_forms(spark):
    """Every 97th character with such a form, alone and between others, and marks that compose; plain texts pass no function."""
    import unicodedata

    from threatweave.functions import text as tx
    from threatweave.operators import joins as jo

    odd = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and not unicodedata.is_normalized("NFKC", chr(c))][::97]
    texts = odd + [f"a{x}b {x}" for x in odd] + ["é ü", "각", "ﬁne ²", "plain", "", "é ü"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.nfkc(F.col("t")).alias("u")).collect()
    assert {r["i"]: r["u"] for r in rows} == {i: unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)} and len(odd) > 50
    quotes = spark.createDataFrame([(1, "s", "xy ﬁnd ｌｏｇ ²")], "quote_id int, source_id string, quote string")
    stored_text = spark.createDataFrame([("s", "It is xy find log 2 now.")], "source_id string, text string")
    assert [jo.quotes_found(quotes, stored_text, compatible=c).first()["found"] for c in (False, True)] == [False, True]


def test_names_of_the_library_in_seeds(spark):
    from threatweave.operators.records import seed_names

    seeds = spark.createDataFrame([(1, "APT7 and Blue-Fox hit; BLUE FOX (foxy) with emotet, Emotets and Abc."), (2, None), (3, "")], "doc_id int, text string")
    actors = spark.createDataFrame([("Blue Fox", ["Foxy", ""]), ("Fox", None), ("Other", ["x9"])], "name string, aliases array<string>")
    malware = spark.createDataFrame([("Emotet",), ("Abc",), ("missing",)], "name string")
    rows = {r["doc_id"]: (r["actors"], r["malware"]) for r in seed_names(seeds, actors, malware).collect()}
    assert rows == {1: (["APT7", "Blue Fox", "Fox"], ["Emotet"]), 2: ([], []), 3: ([], [])}
