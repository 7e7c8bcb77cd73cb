"""Column functions on literal rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from threatweave.functions import indicators as ind
from threatweave.functions import text as tx
from threatweave.functions import urls as ul
from threatweave.sources import readers as rd


@pytest.fixture(scope="module")
def say(spark):
    """The value of an expression of column v for each given value."""

    def run(values, fn, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r["x"] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]

    return run


def test_refang_and_defang(say):
    assert say(["hxxps://a[.]b(.)com[/]x", "u[at]x[dot]org", None], tx.refang) == ["https://a.b.com/x", "u@x.org", None]
    assert say(["https://a.b.com/x.y"], lambda c: tx.defang(c, F.lit("url"))) == ["hxxps://a[.]b[.]com/x.y"]
    assert say(["2001:db8::1"], lambda c: tx.defang(c, F.lit("ipv6"))) == ["2001[:]db8::1"]
    assert say(["1.2.3.4", "a.b.c"], lambda c: tx.defang(c, F.lit(None).cast("string"))) == ["1.2.3[.]4", "a[.]b[.]c"]
    assert say(["C:\\x.exe"], lambda c: tx.defang(c, F.lit("file_path"))) == ["C:\\x.exe"]


def test_types(say):
    values = ["hxxp://a[.]top/x", "a@b.org", "a" * 64, "b" * 40, "c" * 32, "cve-2024-12345", "8.8.8.8", "HKLM\\Run\\x", "C:\\a\\b.exe", "evil.top", "x.exe", "2606:4700::1111", "\\\\.\\pipe\\x", "hello"]
    assert say(values, ind.kind_of) == ["url", "email", "sha256", "sha1", "md5", "cve", "ipv4", "registry", "file_path", "domain", "file_name", "ipv6", "named_pipe", "other"]


def test_addresses(say):
    assert say(["10.0.0.1", "8.8.8.8", "172.16.0.1", "100.64.1.1", "x", None], ind.public_v4) == [False, True, False, False, False, False]
    assert say(["2001:4860:4860::8888", "fe80::1", "2001:db8::1", "::ffff:1.2.3.4", "12:30:45"], ind.public_v6) == [True, False, False, False, False]
    assert say(["2606:4700:4700:0:0:0:0:1111", "1:0:0:2:0:0:0:3", "0:0:0:0:0:0:0:1"], ind.canonical_v6) == ["2606:4700:4700::1111", "1:0:0:2::3", "::1"]


def test_keys_and_titles(say):
    assert say(["  A New-Title! ", None], tx.title_key) == ["a new title", ""]
    assert say(["Volt Typhoon", "!!"], tx.slug) == ["volt-typhoon", "unnamed"]
    assert say([["S10", "S2", "", "S2"]], tx.natural_order, "array<string>") == [["S2", "S10"]]
    assert say(["<ID@x> ", ""], lambda c: ind.message_key(c, F.lit("raw")))[0] == "mid:id@x"
    assert say(["\n First line. Second one.\nThird"], tx.seed_title) == ["First line"]


def test_uuid5(say):
    ns = "6f1c9a52-3b1e-4f0a-9d7e-8a2b5c4e1d70"
    assert say(["DO-2", "é"], lambda c: ind.uuid5(ns, c)) == [str(uuid.uuid5(uuid.UUID(ns), x)) for x in ("DO-2", "é")]


def test_urls(say):
    assert say(["HTTPS://www.A.com/x/?q=1#f", "a.com"], ul.canonical) == ["https://a.com/x", "https://a.com"]
    assert say(["https://A.com/p?utm_source=x&b=2&fbclid=3#z"], ul.without_campaign) == ["https://a.com/p?b=2"]
    assert say(["https://urldefense.com/v3/__https://a.com/x__;!!y", "https://urldefense.proofpoint.com/v2/url?u=https-3A__a.com_x&d=1"], ul.unwrap) == ["https://a.com/x", "https://a.com/x"]
    assert say(["<p>a&amp;b</p><script>x</script><br>c <b>d</b>"], ul.page_text) == ["a&b\n\nc d"]


def test_times_and_verdicts(say):
    s = lambda c: F.unix_seconds(ind.lenient_time(c))
    assert say(["1700000000", "2024-01-02T03:04:05Z", "2024-01-02 noon", "soon", None], s) == [1700000000, 1704164645, 1704153600, None, None]
    at = F.lit("2024-06-01").cast("timestamp")

    def v(flags, benign, good, named, grade, seen):
        return lambda c: ind.verdict(c, F.lit(flags), F.lit(benign), F.lit(good), F.lit(named), F.lit(grade), F.lit(seen).cast("timestamp"), at)

    assert say(["sha256"], v(5, False, True, True, "A", None)) == ["benign"]
    assert say(["ipv4"], v(2, False, False, False, "C", "2024-01-01")) == ["expired"]
    assert say(["sha256"], v(2, False, False, False, "C", "2014-01-01")) == ["malicious"]
    assert say(["ipv4"], v(1, False, False, False, "C", "2024-05-01")) == ["suspicious"]
    assert say(["ipv4"], v(0, False, False, True, "B", None)) == ["malicious"]


def test_status_rules(say):
    assert say(["reviewed", "reference", "nope"], lambda c: ind.status_problem(c, F.lit("generated"), F.lit(1))) == ["findings to fix first", "only vendor queries are references", "unknown status"]
    assert say(["deployed"], lambda c: ind.later_status(c, F.lit("reviewed"))) == ["deployed"]


def test_forwards(say):
    mail = "see this\n---------- Forwarded message ---------\nFrom: A <a@x.org>\nSubject: Hi\n\n> body one\n> two"
    out = say([mail, "plain"], rd.forwarded)
    assert (out[0]["note"], out[0]["sender"], out[0]["subject"], out[0]["body"]) == ("see this", "A <a@x.org>", "Hi", "body one\ntwo")
    assert out[1]["note"] == "plain" and out[1]["body"] is None
