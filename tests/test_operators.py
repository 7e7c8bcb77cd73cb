"""Operators on small literal tables, and the extractor's golden cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threatweave.operators import aggregates as ag
from threatweave.operators import extract as ex
from threatweave.operators import graph as gr
from threatweave.operators import hunt as hu
from threatweave.operators import joins as jo
from threatweave.operators import ranking as rk


def found(spark, text):
    rows = ex.indicators(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    return {(r["type"], r["value"]) for r in rows}


def test_indicators(spark):
    sha = "7c" * 32
    text = f"It fetched hxxps://files[.]quiet-harbor[.]net/load?k=2, then spoke to 185.220.101[.]34 (not 192.168.7.9) while github.com stayed open; the file {sha} came from 2a03:2880:f10c::35, never from fe80::2 at 09:41:20."
    assert found(spark, text) == {("url", "https://files.quiet-harbor.net/load?k=2"), ("ipv4", "185.220.101.34"), ("sha256", sha), ("ipv6", "2a03:2880:f10c::35")}


def test_labelled_indicators(spark):
    md5 = "b" * 32
    text = f'JA3: {md5}\nUser-Agent: Mozilla/5.0 (X11)\nmutex named "Abc123" and Global\\XyZ9\nnamed pipe "evil" and \\\\.\\pipe\\x1\nthe user agent is unknown\nt13d1516h2_8daaf6152771_b186095e22b6'
    got = found(spark, text)
    assert ("ja3", md5) in got and not any(k == "md5" for k, _ in got)
    assert {v for k, v in got if k == "mutex"} == {"Abc123", "Global\\XyZ9"} and {v for k, v in got if k == "named_pipe"} == {"\\\\.\\pipe\\evil", "\\\\.\\pipe\\x1"}
    assert {v for k, v in got if k == "user_agent"} == {"Mozilla/5.0 (X11)"} and ("ja4", "t13d1516h2_8daaf6152771_b186095e22b6") in got


def test_allowed_links_hide_their_parts(spark):
    assert found(spark, "See https://www.microsoft.com/evil.exe and cmd.exe and dropper.exe and asp.net") == {("file_name", "dropper.exe")}
    assert found(spark, "pay bitcoin 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa now") == {("wallet", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa")}


def test_spaced_events(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + dt.timedelta(minutes=3)), ("a", t + dt.timedelta(minutes=5)), ("a", t + dt.timedelta(minutes=11)), ("b", t + dt.timedelta(minutes=3))]
    out = rk.spaced(spark.createDataFrame(rows, "k string, at timestamp"), ["k"], "at", 10).collect()
    assert sorted((r["k"], r["at"].minute) for r in out) == [("a", 0), ("a", 11), ("b", 3)]


def test_busy_time(spark):
    t = dt.datetime(2024, 1, 1)
    m = lambda n: t + dt.timedelta(minutes=n)
    rows = [(1, m(0), m(1)), (1, m(1), m(4)), (1, m(2), m(5)), (1, m(30), m(31)), (1, m(31), None)]
    out = rk.busy_time(spark.createDataFrame(rows, "k int, s timestamp, e timestamp"), ["k"], "s", "e", F.lit(m(32)).cast("timestamp")).collect()
    assert out[0]["seconds"] == 7 * 60


def test_clusters_join_through_others(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "d"), (6, "d")], "article_id long, key string")
    assert {r["article_id"]: r["cluster_id"] for r in gr.clusters(keys).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_cluster_score(spark):
    at = dt.datetime(2026, 9, 29, 7)
    h = lambda n: at - dt.timedelta(hours=n)
    rows = [(1, "t1", "P1", "B", h(3), ["CVE-2025-53770"], [], []), (2, "t2", "P2", "B", h(5), ["CVE-2025-53770"], [], []), (3, "gov", "P3", "A", h(8), ["CVE-2025-53770"], [], []), (4, "alone", "P4", "A", h(20), [], [], [])]
    arts = spark.createDataFrame(rows, "article_id long, title string, publisher string, reliability string, published timestamp, cves array<string>, actors array<string>, malware array<string>")
    out = {r["cluster_id"]: r for r in gr.ranked_clusters(arts, gr.clusters(gr.article_keys(arts)), F.lit(at).cast("timestamp")).collect()}
    assert out[1]["score"] == 14 and out[1]["title"] == "gov" and out[1]["why"] == ["reported by 3 publishers", "names a CVE", "government advisory", "published in the last 12 h"]
    assert out[4]["n_articles"] == 1 and out[4]["label"] == "alone"


def test_related_through_a_hot_key(spark):
    """A key of any size keeps all its items, and a wanted item finds all its partners."""
    keys = spark.range(3000).select(F.col("id").alias("research_id"), F.lit("hot").alias("key")).union(spark.createDataFrame([(5, "rare"), (7, "rare"), (9, "alone")], "id long, key string"))
    rows = jo.related(keys).collect()
    assert len(rows) == 3002 and {(r["key"], r["class"], r["n"]) for r in rows} == {("hot", 0, 3000), ("rare", 5, 2)}
    pairs = {r["b"]: r["shared"] for r in jo.related_to(spark.createDataFrame([(7,)], "research_id long"), keys).collect()}
    assert len(pairs) == 2999 and pairs[5] == ["hot", "rare"] and pairs[8] == ["hot"]


def test_quotes(spark):
    q = spark.createDataFrame([(1, 1, "“Attackers  used a web shell”"), (2, 1, "Attackers used a shell on the servers"), (3, 1, "nothing like it at all there"), (4, 1, "")], "quote_id int, source_id int, quote string")
    t = spark.createDataFrame([(1, "We saw that attackers used a web shell on the servers.")], "source_id int, text string")
    out = {r["quote_id"]: r["found"] for r in jo.quotes_found(q, t).collect()}
    assert out[1] and not out[3] and out[4]


def test_periods():
    d = dt.date(2024, 5, 15)
    assert ag.period_bounds("last_quarter", d)[0].date() == dt.date(2024, 1, 1) and ag.period_bounds("last_quarter", d)[1].date() == dt.date(2024, 3, 31)
    assert ag.period_bounds("week", d)[0].date() == dt.date(2024, 5, 13)
    assert ag.period_bounds("last_quarter", dt.date(2024, 2, 1))[0].date() == dt.date(2023, 10, 1)


def test_specifications(spark):
    events = spark.createDataFrame([(1, "process_creation", "C:\\W\\CMD.EXE"), (2, "process_creation", None), (3, "web", "cmd.exe")], "event_id int, category string, image string")
    specs = [{"spec_id": "a", "category": "process_creation", "conditions": [{"field": "image", "op": "endswith", "values": ["\\cmd.exe"]}]}, {"spec_id": "b", "category": "web", "conditions": [{"field": "gone", "op": "equals", "values": ["x"]}]}]
    assert [(r["event_id"], r["spec_id"]) for r in hu.matches(events, specs).collect()] == [(1, "a")]


def test_nothing_in_nothing_out(spark):
    assert jo.related(spark.createDataFrame([], "research_id long, key string")).count() == 0


def test_quotes_with_few_changed_words(spark):
    """Three quarters of the word n-grams are enough, in short quotes too."""
    text = "The group used a web shell on the public server, then moved on to the mail host."
    quotes = {1: ("used a web shell on the public server then moved quickly", True), 2: ("public server, then", True), 3: ("mail host of the group", False), 4: ("moved on to the", True), 5: ("never seen before words in this order", False), 6: ("", True)}
    rows = spark.createDataFrame([(i, 1, q) for i, (q, _) in quotes.items()], "quote_id long, source_id long, quote string")
    found = {r["quote_id"]: r["found"] for r in jo.quotes_found(rows, spark.createDataFrame([(1, text)], "source_id long, text string")).collect()}
    assert found == {i: want for i, (_, want) in quotes.items()}
