"""Scalar functions of indicators: types, addresses, keys, patterns, expiry and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import fixed
from .text import let, refang
from .urls import under

# What an indicator of each type looks like, tried in this order.
SHAPES = (
    ("named_pipe", r"(?i)^\\\\[.?]\\pipe\\\S+$"),
    ("url", r"(?i)^(?:https?|ftp)://[^\s\"'<>()\[\]]+$"),
    ("email", r"(?i)^[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}$"),
    ("ja4", r"(?i)^[tqd](?:1[0-3]|s3|00)[di]\d{4}[a-z0-9]{2}_[a-f0-9]{12}_[a-f0-9]{12}$"),
    ("sha256", r"(?i)^[a-f0-9]{64}$"),
    ("sha1", r"(?i)^[a-f0-9]{40}$"),
    ("md5", r"(?i)^[a-f0-9]{32}$"),
    ("cve", r"(?i)^CVE-\d{4}-\d{4,7}$"),
    ("ipv4", r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"),
    ("registry", r"(?i)^(?:HKLM|HKCU|HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER|HKU|HKCR)\\[^\s\"'<>]+$"),
    ("file_path", r"(?i)^[A-Z]:\\(?:[^\\/:*?\"<>|\r\n\s]+\\)*[^\\/:*?\"<>|\r\n\s]+\.[a-z0-9]{2,4}$"),
    ("domain", r"(?i)^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:TLD)$"),
    ("file_name", r"(?i)^[\w\-]+\.(?:aspx|asp|jsp|php|exe|dll|ps1|bat|vbs|js|hta|lnk|sys|scr|msi|jar)$"),
)
# Top-level domains that indicators use.
TLDS = (
    "com|net|org|info|biz|io|co|ru|cn|top|xyz|app|dev|online|site|club|live|me|tk|ml|ga|cf|gq|pw|cc|su|in|uk|de|fr|nl|br|ir|kp|us|eu|jp|kr|tw|hk|"
    r"sg|au|ca|link|click|shop|store|cloud|tech|pro|space|website|fun|icu|buzz|work|zip|mov|ngrok-free\.app|ngrok\.io|onion"
)
# IPv4 blocks that are not public, as first and last address.
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def kind_of(value: Column) -> Column:
    """The type of a value, after refanging; 'other' if it is like none."""
    plain = refang(value)
    rules = [(name, plain.rlike(p.replace("TLD", TLDS))) for name, p in SHAPES]
    chain = reduce(lambda c, r: c.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    v6 = plain.rlike(r"(?i)^[0-9a-f:]*:[0-9a-f:.]*$") & v6_groups(plain).isNotNull()
    return chain.when(v6, "ipv6").otherwise("other")


def v4_number(value: Column) -> Column:
    parts = F.split(value, r"\.")
    octet = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    return octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3)


def public_v4(value: Column) -> Column:
    """Whether an IPv4 address is none of the private, reserved, loopback, link-local or multicast ones."""

    def base(text: str) -> int:
        return sum(int(x) << s for x, s in zip(text.split("."), (24, 16, 8, 0), strict=True))

    n = v4_number(value)
    blocked = reduce(lambda a, b: a | b, [n.between(base(a), base(a) + (1 << (32 - bits)) - 1) for a, bits in PRIVATE_V4])
    return F.coalesce(n.isNotNull() & ~blocked, F.lit(False))


def v6_groups(value: Column) -> Column:
    """The eight groups of an IPv6 address as numbers; null if it is none."""
    v = F.lower(value)
    halves = F.split(v, "::", -1)
    of = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))
    head, tail = of(F.get(halves, F.lit(0))), of(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    gap = F.lit(8) - F.size(head) - F.size(tail)
    groups = F.when((F.size(halves) == 1) & (F.size(head) == 8), head).when((F.size(halves) == 2) & (gap >= 1), F.concat(head, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), tail))
    ok = F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(ok, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int")))


def canonical_v6(value: Column) -> Column:
    """The shortest form: no leading zeros, the longest run of two or more zero groups (the first one) as '::'."""

    def shorten(text: Column) -> Column:
        chain = F.when(F.lit(False), text)
        for n in range(8, 1, -1):
            run = rf"(?:^|:)0(?::0){{{n - 1}}}(?::|$)"
            chain = chain.when(text.rlike(run), F.regexp_replace(text, rf"^(.*?){run}(.*)$", "$1::$2"))
        return chain.otherwise(text)

    plain = lambda g: F.array_join(F.transform(g, lambda x: F.lower(F.hex(x))), ":")
    return let(v6_groups(value), lambda g: F.when(g.isNotNull(), let(plain(g), shorten)))


def public_v6(value: Column) -> Column:
    """Whether an IPv6 address is globally routable and no mapped IPv4 address."""

    def test(g: Column) -> Column:
        a, b = F.get(g, F.lit(0)), F.get(g, F.lit(1))
        zero5 = reduce(lambda x, y: x & y, [F.get(g, F.lit(i)) == 0 for i in range(5)])
        special = (
            (zero5 & F.get(g, F.lit(5)).isin(0, 0xFFFF))
            | (a.bitwiseAND(F.lit(0xFE00)) == 0xFC00)
            | (a.bitwiseAND(F.lit(0xFFC0)) == 0xFE80)
            | (a.bitwiseAND(F.lit(0xFF00)) == 0xFF00)
            | ((a == 0x2001) & (b < 0x0200) & ~(b.between(0x20, 0x3F)) & ~((b == 1) | (b == 3)))
            | ((a == 0x2001) & (b == 0x0DB8))
            | (a == 0x2002)
            | ((a == 0x0100) & (b == 0))
            | ((a == 0x0064) & (b == 0xFF9B) & (F.get(g, F.lit(2)) == 1))
            | (a == 0x3FFF)
            | (a == 0x5F00)
        )
        return ~special

    return F.coalesce(let(v6_groups(value), test), F.lit(False))


def key_of(kind: Column, value: Column) -> Column:
    return F.concat_ws("|", kind, F.lower(refang(value)))


def known_good(value: Column, more: dict[str, str] | None = None) -> Column:
    """The label of a hash of legitimate software; null otherwise."""
    named = fixed.KNOWN_GOOD | (more or {})
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.lower(F.trim(value)))


def huntable(kind: Column, value: Column) -> Column:
    """Public addresses, domains that aren't allowed ones, and hashes that aren't known to be good; other types always."""
    return F.when(kind == "ipv4", public_v4(value)).when(kind == "domain", ~under(value, fixed.ALLOWED_DOMAINS)).when(kind == "sha256", known_good(value).isNull()).otherwise(True)


def lenient_time(value: Column) -> Column:
    """A time from epoch seconds, ISO text or a text that starts with a date; null if none is found."""
    s = F.trim(value.cast("string"))
    epoch = F.when(s.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_seconds(s.try_cast("double")))
    return F.coalesce(epoch, F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(F.substring(s, 1, 10)))))


def expires_at(kind: Column, first_seen: Column, days: dict[str, int] | None = None) -> Column:
    """First seen plus the days of its type; null where a type never expires or no date is known."""
    table = fixed.EXPIRY_DAYS if days is None else days
    n = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), list(table.items())[1:], F.when(kind == next(iter(table)), next(iter(table.values()))))
    return first_seen + F.make_dt_interval(n)


def verdict(kind: Column, flags: Column, provider_benign: Column, good: Column, named: Column, reliability: Column, first_seen: Column, at: Column) -> Column:
    """benign if known to be; else malicious, suspicious or unknown by flags and naming; expired once past its date."""
    reliable = named & F.substring(F.coalesce(reliability, F.lit("C")), 1, 1).isin("A", "B")
    live = F.when((flags >= 2) | reliable, "malicious").when((flags == 1) | named, "suspicious").otherwise("unknown")
    gone = F.coalesce(at >= expires_at(kind, first_seen), F.lit(False))
    return F.when(good | provider_benign, "benign").when(gone, "expired").otherwise(live)


def hidden(verdict_: Column, excluded: Column, include_expired: Column) -> Column:
    return F.coalesce(excluded, F.lit(False)) | verdict_.isin("benign", "false_positive") | ((verdict_ == "expired") & ~include_expired)


def stix_pattern(kind: Column, value: Column) -> Column:
    """The STIX pattern of an indicator; null for types without one."""
    v = F.trim(refang(value))
    quoted = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    whole = lambda name, x: F.concat(F.lit(f"[{name} = '"), quoted(x), F.lit("']"))
    low = F.lower(v)
    out = (
        F.when(kind == "ipv4", whole("ipv4-addr:value", v))
        .when(kind == "ipv6", whole("ipv6-addr:value", v))
        .when(kind == "domain", whole("domain-name:value", low))
        .when(kind == "url", whole("url:value", v))
        .when(kind == "email", whole("email-addr:value", low))
        .when(kind == "md5", whole("file:hashes.MD5", low))
        .when(kind == "sha1", whole("file:hashes.'SHA-1'", low))
        .when(kind == "sha256", whole("file:hashes.'SHA-256'", low))
        .when(kind == "file_name", whole("file:name", v))
        .when(kind == "registry", whole("windows-registry-key:key", v))
        .when(kind == "mutex", whole("mutex:name", v))
    )
    return F.when(v != "", out)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) in a namespace given as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stix_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def cpe_product(criteria: Column) -> Column:
    """'Vendor Product version edition' from a CPE name; the name itself if it has too few parts."""
    p = F.split(criteria, ":")
    word = lambda i: F.initcap(F.replace(F.get(p, F.lit(i)), F.lit("_"), F.lit(" ")))
    some = lambda i: F.when(~F.coalesce(F.get(p, F.lit(i)), F.lit("*")).isin("*", "-", ""), F.replace(F.get(p, F.lit(i)), F.lit("_"), F.lit(" ")))
    version = F.when(~F.get(p, F.lit(5)).isin("*", "-", ""), F.get(p, F.lit(5)))
    name = F.concat_ws(" ", word(3), word(4), version, some(9))
    return F.when(F.size(p) < 6, criteria).otherwise(F.replace(name, F.lit("Microsoft Sharepoint"), F.lit("Microsoft SharePoint")))


def message_key(message_id: Column, raw: Column) -> Column:
    mid = F.lower(F.trim(F.regexp_replace(F.trim(F.coalesce(message_id, F.lit(""))), "^<+|>+$", "")))
    return F.when(mid != "", F.concat(F.lit("mid:"), mid)).otherwise(F.concat(F.lit("sha256:"), F.sha2(raw, 256)))


def plus_tags(addresses: Column) -> Column:
    """Tags of addresses like name+tag@host, in lower case."""
    return F.transform(F.filter(addresses, lambda a: F.regexp_extract(a, "^([^@]*)", 1).contains("+")), lambda a: F.lower(F.regexp_extract(a, r"^[^@+]*\+([^@]*)", 1)))


def spec_key(category: Column, conditions: Column) -> Column:
    """Detections with the same logic share a key: conditions and values sorted, values in lower case."""
    same = F.array_sort(F.transform(conditions, lambda c: F.struct(c["field"].alias("field"), c["op"].alias("op"), F.array_sort(F.transform(c["values"], lambda v: F.lower(v))).alias("values"))))
    return F.to_json(F.struct(category.alias("category"), same.alias("conditions")))


def status_rank(status: Column) -> Column:
    items = list(fixed.STATUS_RANK.items())
    return reduce(lambda c, kv: c.when(status == kv[0], kv[1]), items[1:], F.when(status == items[0][0], items[0][1])).otherwise(-1)


def later_status(a: Column, b: Column) -> Column:
    return F.when(status_rank(a) >= status_rank(b), a).otherwise(b)


def status_problem(new: Column, origin: Column, n_lint: Column) -> Column:
    """Why a query can't take a status; null if it can."""
    return (
        F.when(status_rank(new) < 0, "unknown status")
        .when((new == "reference") & (origin != "reference"), "only vendor queries are references")
        .when((origin == "reference") & new.isin("generated", "syntax_checked"), "vendor queries are not checked")
        .when((origin != "reference") & (n_lint > 0) & new.isin("syntax_checked", "reviewed", "lab_tested", "deployed"), "findings to fix first")
    )


def budget(depth: Column, seconds: Column, tokens: Column, warn: float = 80.0) -> Column:
    """(pct_time, pct_tokens, state) of a run against the limits of its depth; unknown depths count as standard."""
    pick = lambda i: reduce(lambda c, kv: c.when(depth == kv[0], kv[1][i]), list(fixed.BUDGETS.items())[1:], F.when(depth == "quick", fixed.BUDGETS["quick"][i])).otherwise(fixed.BUDGETS["standard"][i])
    t = F.round(100.0 * (seconds / 60.0) / pick(0), 1)
    k = F.round(100.0 * F.coalesce(tokens, F.lit(0)) / pick(1), 1)
    worst = F.greatest(t, k)
    return F.struct(t.alias("pct_time"), k.alias("pct_tokens"), F.when(worst >= 100, "over").when(worst >= warn, "warning").otherwise("ok").alias("state"))


def lint(platform: Column, body: Column) -> Column:
    """Findings of a stored query's text: empty, unbalanced brackets or quotes, words of another dialect."""
    b = F.trim(body)
    bare = F.regexp_replace(b, r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`|/(?:\\.|[^/\n])+/[a-z]*", "")
    count = lambda text, ch: F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
    is_ = lambda *names: platform.isin(*names)
    rules = [(count(bare, o) != count(bare, c), f"unbalanced {o}{c}") for o, c in ("()", "[]", "{}")]
    rules += [
        (count(F.regexp_replace(b, r"\\.", ""), '"') % 2 == 1, "unbalanced double quotes"),
        (is_("kql_sentinel", "kql_defender") & ~b.rlike(r"^(let\s|union\s|[A-Z][A-Za-z0-9_]+|_?[Ii]m_?[A-Z][A-Za-z0-9_]*)"), "KQL starts with a table, let or union"),
        (is_("kql_sentinel", "kql_defender", "cql") & b.rlike(r"\bindex\s*="), "index= is SPL"),
        (is_("kql_sentinel", "kql_defender") & b.rlike(r"\|\s*stats\s"), "KQL says summarize, not stats"),
        (is_("spl") & b.rlike(r"\|\s*where\s+\w+\s*=~"), "=~ is KQL"),
        (is_("spl") & b.rlike(r"\|\s*project\s"), "project is KQL"),
        (is_("cql") & b.rlike(r"(?i)\|\s*where\s"), "CQL has no where"),
        (is_("xql") & ~b.contains("dataset") & ~b.contains("preset"), "XQL needs a dataset or preset"),
        (is_("esql") & ~b.rlike(r"(?i)^(FROM|ROW|SHOW)\s"), "ES|QL starts with FROM"),
        (is_("yaral") & ~(b.rlike(r"\brule\s+\w+\s*\{") & b.contains("condition:")), "YARA-L needs a rule with a condition"),
        (is_("aql") & ~b.rlike(r"(?i)^SELECT\s"), "AQL starts with SELECT"),
    ]
    rules += [(is_("sigma") & ~b.contains(k), f"Sigma needs {k}") for k in ("title:", "logsource:", "detection:", "condition:")]
    found = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda m: m.isNotNull())
    return F.when(b == "", F.array(F.lit("empty"))).otherwise(found)
