"""Extraction and matching against plain Python over whole texts of the smallest tables, all columns."""

import html as html_lib
import ipaddress
import re

import pytest

from threatweave.operators import extract as ex
from threatweave.plans.registry import QUERIES, Tables
from threatweave.sources import fixed

from .conftest import SF

DOT, REFANG = r"(?:\.|\[\.\]|\(\.\))", ((r"(?i)hxxp", "http"), (r"(?i)\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)", "."), (r"\[:\]", ":"), (r"\[/\]", "/"), (r"(?i)\[@\]|\[at\]", "@"))


@pytest.fixture(scope="module")
def reports(spark):
    return {r["doc_id"]: r["text"] for r in Tables(spark, SF).reports.select("doc_id", "text").collect()}


def sentences(text):
    parts = re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z0-9\"'(])", re.sub(r"[ \t\n\x0b\f\r]+", " ", text))
    return [s.strip(" ") for s in parts if 20 < len(s.strip(" ")) < 600]


def clip(text, n):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.strip(" ")) if w]
    return " ".join(words[:n]) + ("…" if len(words) > n else "")


def java(pattern):
    """Java's classes are ASCII unless a pattern asks otherwise."""
    return re.compile(pattern, re.ASCII)


def test_sentences(spark, reports):
    want = {(i, k, s) for i, t in reports.items() for k, s in enumerate(sentences(t))}
    assert {(r["doc_id"], r["pos"], r["sentence"]) for r in QUERIES["p21_sentences"](spark, SF).collect()} == want and len(want) > 1000


def test_techniques(spark, reports):
    want = set()
    for i, text in reports.items():
        first = {}
        for pos, s in enumerate(sentences(text)):
            for pattern, technique in fixed.HINTS:
                if technique not in first and java("(?i)" + pattern).search(s):
                    first[technique] = (pos, s)
        want |= {(i, t, p, clip(s, 30), clip(s, 25)) for t, (p, s) in first.items()}
    rows = QUERIES["e06_techniques"](spark, SF).collect()
    assert {tuple(r) for r in rows} == want and len({w[1] for w in want}) >= 3


def test_every_hint(spark):
    """One sentence for each hint, in upper case too; the first of two sentences counts."""
    samples = ["attackers exploited the public server", "they scanned for hosts", "dropped a webshell", "an iis module", "ran powershell", "a command shell", "used /bin/sh", "by wmic", "with psexec", "a scheduled task", "changed group policy", "ran mimikatz", "stole the machinekey", "copied ntds.dit", "disable the antivirus", "set the registry", "base64 text", "over rdp", "via admin$", "an frp tunnel", "sent a beacon", "made a dns tunnel", "the ransomware", "ran vssadmin", "exfiltrated files", "by phishing", "stolen credentials", "ran whoami", "ran systeminfo", "downloaded tools, download payload", "dll side-loading", "a deserialization bug"]
    text = " ".join(f"Then it was seen that {s} on host{k}." for k, s in enumerate(samples)) + " And later again POWERSHELL was run there."
    rows = {r["technique_id"]: r for r in ex.techniques(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()}
    assert set(rows) == {t for _, t in fixed.HINTS} and rows["T1059.001"]["pos"] == 4 and all(r["doc_id"] == 1 for r in rows.values())


def test_notes(spark, reports):
    want = {}
    for i, text in reports.items():
        s = sentences(text)
        keep = lambda p, n: [x for x in s if java(p).search(x)][:n]  # noqa: B023, E731
        names = list(dict.fromkeys(java(fixed.ACTOR_PATTERN).findall(text)))
        want[i] = {
            "summary": " ".join(s[:4]), "claims": s[:6], "ioas": keep(r"(?i)(spawn|child process|w3wp|POST /|GET /|-enc|\.aspx)", 8),
            "industries": [x for x in fixed.INDUSTRIES if java(rf"(?i)\b{x}\b").search(text)], "recommendations": keep(r"(?i)\b(patch|update|rotate|disable|apply|upgrade)\b", 5),
            "actors": names[:6], "cves": sorted({x.upper() for x in java(fixed.CVE_PATTERN).findall(text)}),
        }
    rows = QUERIES["e07_notes"](spark, SF).collect()
    assert {r["doc_id"]: {k: r[k] for k in want[r["doc_id"]]} for r in rows} == want and all(w["recommendations"] and w["industries"] for w in want.values())


def test_covering_steps(spark):
    comments = Tables(spark, SF).comments.select("thread_id", "comment_id", "pos", "text").collect()
    words = lambda s: list(dict.fromkeys(re.findall("[a-z]{4,}", s.lower())))
    want = {}
    for a in comments:
        own = words(a["text"])
        rated = [(len(set(own) & set(words(b["text"]))) / len(own), -b["pos"], b["comment_id"]) for b in comments if own and b["thread_id"] == a["thread_id"] and b["pos"] % 2 == 0]
        if rated and max(rated)[0] >= 0.5:
            want[a["comment_id"]] = (a["thread_id"], max(rated)[2], max(rated)[0])
    rows = QUERIES["j23_covering_steps"](spark, SF).collect()
    assert {r["ioa_id"]: (r["research_id"], r["ref"], r["share"]) for r in rows} == want and want


def page_text(html):
    t = re.sub(r"(?is)<(script|style|head|title|noscript|template)\b.*?</\1\s*>", "", html)
    t = re.sub(r"(?s)<!--.*?-->", "", t)
    out, at = [], 0
    for m in re.finditer(r"(?s)<[!/?A-Za-z][^>]*>", t):
        out.append(t[at : m.start()])
        if re.match(r"(?i)</?(?:p|div|br|li|tr|h[1-6]|table|blockquote|pre|hr|section|article|ul|ol)\b", m[0]):
            out.append("\n")
        at = m.end()
    plain = html_lib.unescape("".join(out) + t[at:]).replace("\xa0", " ")
    plain = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[ \t\r\f\x0b]+", " ", plain)))
    return plain.strip(" \t\n\r\f\x0b")


def test_page_text(spark):
    pages = {r["page_id"]: r["html"] for r in Tables(spark, SF).pages.select("page_id", "html").collect()}
    rows = QUERIES["s03_page_text"](spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: page_text(h) for i, h in pages.items()}
    assert {r["page_id"]: r["n_links"] for r in rows} == {i: len(re.findall(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a\s*>", h)) for i, h in pages.items()}


def refang(value):
    value = value.strip(" ")
    for pattern, plain in REFANG:
        value = re.sub(pattern, plain, value)
    return value


def allowed(host):
    parts = host.lower().split(".")
    return any(".".join(parts[k:]) in fixed.ALLOWED_DOMAINS for k in range(len(parts)))


def context(text, s, e):
    start = max(text.rfind(".", max(s - 160, 0), max(s - 1, 0)) + 1, s - 160, 0) if s else 0
    stop = text.find(".", e, e + 160)
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text[start : (stop + 1 if stop >= 0 else e + 160)]).strip(" ")


def indicators(text):
    """(type, value) to contexts, for the kinds that the reports hold."""
    taken, out = [], {}
    patterns = {k: (p, g) for k, p, g in ex.PATTERNS}
    for kind, (pattern, groups) in patterns.items():
        for m in java(pattern).finditer(text):
            s, e = m.span()
            if any(s < b and e > a for a, b in taken):
                continue
            value, emit, consume = refang(re.sub(r"[.,;:]+$", "", m[0])), True, None
            if groups:
                value = re.sub(r"[.,;:]+$", "", next((g.strip(" ") for g in m.groups() if g and g.strip(" ")), ""))
                emit = bool(value)
            elif kind == "url":
                emit, consume = not allowed(re.match(r"[^/:]*", re.sub(r"(?i)^[a-z]+://", "", value))[0]), True
            elif kind == "email":
                emit = not allowed(value.rpartition("@")[2])
            elif kind == "ipv4":
                emit = ipaddress.ip_address(value).is_global
            elif kind == "ipv6":
                try:
                    value = str(ipaddress.ip_address(value.lower()))
                    emit = ipaddress.ip_address(value).is_global
                except ValueError:
                    emit = False
            elif kind == "domain":
                low = value.lower()
                path = low.rpartition(".")[2] in fixed.FILE_TLDS and "\\" in text[max(s - 2, 0) : s]
                stub = len(low.split(".")) == 2 and low.split(".")[0] in ("e", "i", "etc", "vs", "fig")
                emit = not (allowed(low) or low in fixed.TECH_NAMES or low.startswith("system.") or path or stub)
            elif kind == "file_name":
                emit = value.lower() not in fixed.BENIGN_FILES
            elif kind == "cve":
                value = value.upper()
            elif kind in ("sha256", "sha1", "md5"):
                value = value.lower()
                emit = not (s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum())
            elif kind == "wallet":
                emit = bool(re.search("(?i)(bitcoin|btc|wallet|ransom)", text[max(s - 200, 0) : e + 200]))
            if consume or (consume is None and emit):
                taken.append((s, e))
            if emit:
                key = (kind, value if kind in ("url", "file_path", "registry") else value.lower())
                out.setdefault(key, (value, []))[1].append(context(text, s, e))
    return {(k, v): list(dict.fromkeys(c))[:5] for (k, _), (v, c) in out.items()}


def test_indicators(spark, reports):
    assert len(re.findall(DOT, "a.b[.]c(.)d")) == 3
    want = {(i, k, v, tuple(c)) for i, t in reports.items() for (k, v), c in indicators(t).items()}
    got = {(r["doc_id"], r["type"], r["value"], tuple(r["contexts"])) for r in QUERIES["e01_indicators"](spark, SF).collect()}
    assert {w[:3] for w in want} == {g[:3] for g in got} and len({w[1] for w in want}) >= 4
    assert want == got
    counts = {r["type"]: r["n"] for r in QUERIES["e01_indicators_by_type"](spark, SF).collect()}
    assert counts == {k: sum(w[1] == k for w in want) for k in counts} and set(counts) == {w[1] for w in want}


ODD = [
    'Mutex named "Abc-1" beside Global\\XyZ9; named pipe "evil" and \\\\.\\pipe\\x1. JA3: ' + "b" * 32 + " or t13d1516h2_8daaf6152771_b186095e22b6.",
    "HKLM\\Software\\Run and C:\\Users\\Public\\a.exe then dropper.dll, cmd.exe and asp.net, e.com, evil-site[.]top and https://www.microsoft.com/x plus hxxp://bad(.)example-host.ru/p?q=1.",
    "Mail to x.y@evil[.]top or a@microsoft.com; 10.0.0.1, 185.220.101[.]34, 2a03:2880:f10c::35 and fe80::2; pay bitcoin 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa.",
    "z" + "a" * 64 + " " + "A" * 40 + " " + "c" * 32 + "9 CVE-2024-12345 cve-2024-1234. 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa alone",
    "",
    "no indicator here at all",
]


def test_indicators_of_every_kind(spark):
    rows = ex.indicators(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")).collect()
    want = {(i, k, v, tuple(c)) for i, t in enumerate(ODD) for (k, v), c in indicators(t).items() if k not in ("named_pipe", "ja4")}
    assert {(r["doc_id"], r["type"], r["value"], tuple(r["contexts"])) for r in rows if r["type"] not in ("named_pipe", "ja4")} == want
    assert {r["type"] for r in rows} >= {"mutex", "named_pipe", "ja3", "ja4", "registry", "file_path", "file_name", "domain", "url", "email", "ipv4", "ipv6", "wallet", "sha1", "cve"}


def test_character_references(spark):
    texts = ["&copy; 2024 &middot; a&lt;b &amp;lt; &nbsp;x", "&#65;&#x42;&#X43; &#128; &#0; &#xD800; &#x110000; &#1; &#x1F600;", "&notit; &unknown; &ampx & &; &copy2024 &NotEqualTilde;", "", "plain", "&amp;amp;", "A&B &Eacute;t&eacute; &#8217;"]
    from pyspark.sql import functions as F

    from threatweave.functions.urls import unescape

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", unescape(F.col("t")).alias("u")).collect()
    assert {r["i"]: r["u"] for r in rows} == {i: html_lib.unescape(t) for i, t in enumerate(texts)}
