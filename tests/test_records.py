"""Records: mails, seeds and trees on small hand-made rows."""

from threatweave.operators import records


def test_mail_indicators(spark):
    rows = [(1, 0, "email", "Jo@corp.example"), (1, 1, "email", "x@evil.top"), (1, 2, "domain", "mail.corp.example"), (1, 3, "domain", "evil.top"), (1, 4, "url", "https://news.example/a?utm_source=x"), (1, 5, "url", "https://evil.top/b"), (1, 6, "cve", "CVE-2024-1000"), (2, 0, "domain", "corp.example"), (2, 1, "domain", None)]
    found = spark.createDataFrame(rows, "mail_id long, pos int, type string, value string")
    people = spark.createDataFrame([(1, "jo@Corp.example"), (1, None), (2, "no address")], "mail_id long, address string")
    articles = spark.createDataFrame([(1, "https://news.example/a", "news.example"), (2, None, None)], "mail_id long, url string, host string")
    kept = {(r["mail_id"], r["pos"]) for r in records.mail_indicators(found, people, articles).collect()}
    assert kept == {(1, 1), (1, 3), (1, 5), (2, 0), (2, 1)}
    assert records.mail_indicators(found, people, articles, most=1).count() == 2


def test_seed_entities(spark):
    text = "The Critical FortiGate flaw hits Citrix. More Words\nSee https://a.example/x CVE-2024-1000 and APT28."
    rows = records.seed_entities(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["keywords"] == ["FortiGate", "Citrix"] and got[1]["cves"] == ["CVE-2024-1000"] and got[1]["urls"] == ["https://a.example/x"] and "APT28" in got[1]["actors"]
    assert all(not got[i][c] for i in (2, 3) for c in ("cves", "urls", "actors"))


def test_tree_filter(spark):
    nodes = spark.createDataFrame([(1, p) for p in ("a", "a/b", "a/b/c", "a/d", "ab", "ab/c")], "root long, path string")
    matches = spark.createDataFrame([(1, "a/b", True), (1, "ab/c", False), (2, "a/d", True)], "root long, path string, by_text boolean")
    assert sorted(r["path"] for r in records.tree_filter(nodes, matches).collect()) == ["a", "a/b", "a/b/c", "ab", "ab/c"]
