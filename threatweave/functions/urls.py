"""Scalar functions of URLs and hosts."""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import fixed
from .text import let, refang

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; '' where absent."""
    return F.regexp_extract(url, _PARTS, n)


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", "")), r"\.$", "")


def canonical(url: Column) -> Column:
    """One key for a page: scheme and host in lower case, no www., no trailing slash, no query, no fragment."""
    u = F.trim(url)
    scheme = F.coalesce(F.nullif(F.lower(part(u, 1)), F.lit("")), F.lit("https"))
    authority = F.regexp_replace(F.lower(part(u, 2)), r"^www\.", "")
    path = F.coalesce(F.nullif(F.regexp_replace(part(u, 3), "/+$", ""), F.lit("")), F.lit("/"))
    return F.concat(scheme, F.lit("://"), authority, path)


def parents(domain: Column) -> Column:
    """The domain and all its parents, longest first."""
    labels = F.split(F.regexp_replace(F.lower(domain), r"\.+$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def under(domain: Column, allowed: tuple[str, ...]) -> Column:
    """Whether the domain is one of ``allowed`` or below one."""
    return F.arrays_overlap(parents(domain), F.array(*map(F.lit, allowed)))


def without_campaign(url: Column) -> Column:
    """Scheme and host in lower case, campaign parameters and fragment dropped."""
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(fixed.CAMPAIGN_KEY))
    query = F.array_join(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    path = F.coalesce(F.nullif(part(url, 3), F.lit("")), F.lit("/"))
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _parameter(url: Column, name: str) -> Column:
    return F.nullif(F.try_url_decode(F.regexp_extract(part(url, 4), rf"(?:^|&){name}=([^&]*)", 1)), F.lit(""))


def unwrap(url: Column, hops: int = 3) -> Column:
    """The target of link protection and redirect services, some hops deep."""

    def once(u: Column) -> Column:
        h, path = host(u), part(u, 3)
        v3 = F.try_url_decode(F.regexp_replace(F.regexp_extract(u, r"/v3/__(.*?)(?:__;|$)", 1), "_+$", ""))
        v2 = F.try_url_decode(F.translate(_parameter(u, "u"), "-_", "%/"))
        target = (
            F.when(h.endswith("safelinks.protection.outlook.com"), _parameter(u, "url"))
            .when(h.endswith("urldefense.com") & path.contains("/v3/__"), v3)
            .when(h.endswith("urldefense.proofpoint.com"), v2)
            .when(h.isin("www.google.com", "google.com") & (path == "/url"), F.coalesce(_parameter(u, "q"), _parameter(u, "url")))
        )
        return F.coalesce(target, u)

    # Each hop is bound once, or the expression would grow with the power of the hops.
    for _ in range(hops):
        url = let(url, once)
    return url


def link(raw: Column) -> Column:
    """A link's normal form; null if it is no http(s) link."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(refang(raw)), r"^[<>\"']+|[<>\"']+$", ""), r"[.,;:)\]]+$", "")

    def normal(u: Column) -> Column:
        return F.when(u.rlike(r"(?i)^https?://") & (F.length(u) <= 2000) & (host(u) != ""), without_campaign(u))

    return let(bare, lambda u: F.when(u.rlike(r"(?i)^https?://"), let(unwrap(u), normal)))


def link_kind(normal: Column, defanged: Column) -> Column:
    """(kind, reason) of a link in normal form, by the first rule that holds."""
    says = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))

    def rules(u: Column) -> Column:
        h, path = host(u), part(u, 3)
        prefixed = reduce(lambda a, p: a | h.startswith(p), fixed.TRACKER_PREFIXES[1:], h.startswith(fixed.TRACKER_PREFIXES[0]))
        return F.when(
            u.isNotNull(),
            F.when(defanged, says("indicator", "Defanged link"))
            .when(path.rlike(fixed.ASSET), says("noise", "Image or asset"))
            .when(under(h, fixed.SOCIAL), says("noise", "Social profile"))
            .when(under(h, fixed.TRACKERS) | prefixed, says("noise", "Tracking link"))
            .when(u.rlike(fixed.TRACKER_PATH), says("noise", "Tracking or preferences page"))
            .when(path.rlike(fixed.BOILERPLATE) & (part(u, 4) == ""), says("noise", "Homepage or boilerplate"))
            .otherwise(says("article", "Article")),
        )

    return let(normal, rules)


def vendor(url: Column) -> Column:
    """The publisher (id, name, reliability) whose domain the URL is on; the first in the table wins."""
    h = F.lower(part(url, 2))
    chain = None
    for id_, name, domains, grade in fixed.VENDORS:
        hit = reduce(lambda a, b: a | b, [(h == d) | h.endswith("." + d) for d in domains])
        row = F.struct(F.lit(id_).alias("id"), F.lit(name).alias("name"), F.lit(grade).alias("reliability"))
        chain = F.when(hit, row) if chain is None else chain.when(hit, row)
    return chain


#: A character reference: a number, or a name with its semicolon or one of the old names without.
REFERENCE = r"&(#[0-9]{1,9};?|#[xX][0-9a-fA-F]{1,7};?|[A-Za-z][A-Za-z0-9]{1,31};?)"
#: All names of HTML 5 as one literal, and what numbers 128 to 159 stand for, both by rule.
_NAMES = "\x01".join(f"{name}\x02{value}" for name, value in html5.items())
_OLD = "\x01".join(f"{n}\x02{bytes([n]).decode('cp1252', 'replace').replace(chr(0xFFFD), chr(n))}" for n in range(0x80, 0xA0))
_OLDEST = max(len(n) for n in html5 if not n.endswith(";"))


def unescape(text: Column) -> Column:
    """Character references as what they stand for; unknown names stay as they are."""
    names, old = (F.str_to_map(F.lit(x), F.lit("\x01"), F.lit("\x02")) for x in (_NAMES, _OLD))

    def number(ref: Column) -> Column:
        n = F.when(F.lower(ref).startswith("#x"), F.conv(F.regexp_extract(ref, "^#[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(ref, "^#([0-9]+)", 1)).cast("long")
        none = n.between(1, 8) | n.isin(0xB, 0x7F) | n.between(0xE, 0x1F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        bad = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(F.when(~bad, n)), 8, "0")), "UTF-32")
        return F.when(bad, "\ufffd").when(n.between(0x80, 0x9F), F.element_at(old, n.cast("string"))).when(none, "").otherwise(plain)

    def name(ref: Column) -> Column:
        cut = [F.when(F.length(ref) > k, F.concat(F.element_at(names, F.substring(ref, 1, k)), F.substring(ref, k + 1, 64))) for k in range(_OLDEST, 1, -1)]
        return F.coalesce(F.element_at(names, ref), *cut, F.concat(F.lit("&"), ref))

    plain = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), lambda ref: F.when(ref.startswith("#"), number(ref)).otherwise(name(ref)))
    whole = F.array_join(F.zip_with(F.split(text, REFERENCE, -1), F.concat(plain, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def page_text(html: Column) -> Column:
    """Readable text of a page: hidden parts dropped, blocks on lines of their own, entities decoded, blanks collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head|title|noscript|template)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)</?(?:p|div|br|li|tr|h[1-6]|table|blockquote|pre|hr|section|article|ul|ol)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[!/?A-Za-z][^>]*>", "")
    t = F.regexp_replace(F.replace(unescape(t), F.lit("\u00a0"), F.lit(" ")), r"[ \t\r\f\x0b]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def page_links(html: Column) -> Column:
    """(href, anchor) of all links of a page, in order."""
    pattern = F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a\s*>")
    clean = lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]*>", ""), r"\s+", " "))
    return F.zip_with(F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(2)), lambda h, a: F.struct(h.alias("href"), clean(a).alias("anchor")))


def is_error_page(text: Column) -> Column:
    return (F.length(text) < 300) | (F.substring(text, 1, 1500).rlike(fixed.ERROR_MARKERS) & (F.length(text) < 4000))
