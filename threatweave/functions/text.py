"""Scalar normalisers of text: columns in, columns out."""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources import fixed


def let(value: Column, body) -> Column:
    """Bind ``value`` once a row for ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def refang(value: Column) -> Column:
    """hxxp becomes http; bracketed dots, colons, slashes and at signs lose their brackets."""
    out = F.trim(value)
    for pattern, plain in ((r"(?i)hxxp", "http"), (r"(?i)\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)", "."), (r"\[:\]", ":"), (r"\[/\]", "/"), (r"(?i)\[@\]|\[at\]", "@")):
        out = F.regexp_replace(out, pattern, plain)
    return out


def defang(value: Column, kind: Column) -> Column:
    """The form of an indicator that nobody can click; hashes, names and the like stay as they are."""
    plain = refang(value)
    dots = lambda c: F.replace(c, F.lit("."), F.lit("[.]"))
    hxxp = F.regexp_replace(plain, r"(?i)^http", "hxxp")
    host = F.regexp_extract(hxxp, r"(?i)^hxxps?://([^/]+)", 1)
    head = F.regexp_extract(hxxp, r"(?i)^(hxxps?://)", 1)
    url = F.when(host != "", F.concat(head, dots(host), F.regexp_replace(hxxp, r"(?i)^hxxps?://[^/]+", ""))).otherwise(dots(hxxp))
    fixed_kinds = ("sha256", "sha1", "md5", "file_name", "file_path", "registry", "mutex", "named_pipe", "user_agent", "ja3", "ja4", "cve", "wallet")
    last = F.regexp_replace(hxxp, r"\.([^.]*)$", "[.]$1")
    v4 = (kind == "ipv4") | (kind.isNull() & hxxp.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"))
    return (
        F.when(kind.isin(*fixed_kinds), plain)
        .when(kind == "email", dots(F.replace(hxxp, F.lit("@"), F.lit("[@]"))))
        .when(kind == "ipv6", F.regexp_replace(hxxp, r"^([^:]*):", "$1[:]"))
        .when(v4, last)
        .when((kind == "url") | hxxp.contains("://"), url)
        .otherwise(dots(hxxp))
    )


def title_key(title: Column) -> Column:
    """Titles that differ in case and marks only share a key."""
    return F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " ")), 1, 80)


def slug(name: Column) -> Column:
    dashed = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("unnamed"))


def natural_order(ids: Column) -> Column:
    """Distinct non-empty ids, S2 before S10."""
    keyed = F.transform(F.array_distinct(F.filter(ids, lambda x: x != "")), lambda x: F.struct(F.coalesce(F.regexp_replace(x, r"\D", "").try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("n"), x.alias("id")))
    return F.transform(F.array_sort(keyed), lambda x: x["id"])


@cache
def changed_by_nfkc() -> str:
    """A class of all characters that compatibility composition may change, alone or after another one; by rule."""
    odd = {0x1161, *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for c in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        x = chr(c)
        if unicodedata.combining(x) or not unicodedata.is_normalized("NFKC", x):
            odd.add(c)
        parts = unicodedata.decomposition(x).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            odd.add(int(parts[1], 16))
    ranges: list[list[int]] = []
    for c in sorted(odd):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def nfkc(text: Column) -> Column:
    """Compatibility forms composed (NFKC), which Spark has no function for: texts with such characters pass an Arrow function."""
    # Other texts go as nulls, so nothing of them is moved.
    return F.coalesce(_composed(F.when(text.rlike(changed_by_nfkc()), text)), text)


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def comparable(text: Column, *, compatible: bool = False) -> Column:
    """For quotes: marks unified, lower case, defanged dots undone, letters and digits with single spaces.

    With ``compatible`` compatibility forms (ligatures, full-width letters, superscripts) are composed first.
    """
    text = nfkc(text) if compatible else text
    out = F.lower(F.translate(F.coalesce(text, F.lit("")), "‘’“”–— ", "''\"\"-- "))
    out = F.regexp_replace(out, r"\[\.\]|\(\.\)|\[dot\]", ".")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Sentences of 21 to 599 characters, in order."""
    parts = F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: (F.length(s) > 20) & (F.length(s) < 600))


def clip_words(text: Column, n: int) -> Column:
    """The first n words, with an ellipsis if there were more."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return let(words, lambda w: F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit("…")).otherwise("")))


def strip_hidden(text: Column) -> Column:
    """Without control, zero-width and bidirectional characters; line ends are \\n."""
    hidden = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f​-‏‪-‮⁠-⁤﻿]"
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), hidden, ""), "\r\n?", "\n")


# Lines of mails that say nothing, and header lines of quoted mails.
NOISE = (
    r"(?i)unsubscribe|manage (?:your )?(?:email )?preferences|you (?:are )?receiv(?:ed|ing) this|view (?:this email )?in (?:your )?browser"
    r"|confidentiality notice|this e-?mail (?:and any attachments )?(?:is|are) (?:intended|confidential)"
)
HEADER = r"(?i)^[ >]*(From|Sent|Date|To|Cc|Subject|Reply-To):[ \t]*(.*)$"


def strip_noise(text: Column) -> Column:
    """Lines up to the signature, without footers and quoted header lines."""
    lines = F.split(text, "\n", -1)

    def kept(all_lines: Column) -> Column:
        marks = F.filter(F.transform(all_lines, lambda s, i: F.when(F.trim(s) == "--", i)), lambda i: i.isNotNull())
        upto = F.slice(all_lines, 1, F.coalesce(F.get(marks, F.lit(0)), F.size(all_lines)))
        return F.filter(upto, lambda s: ~s.rlike(NOISE) & ~s.rlike(HEADER))

    return F.trim(F.regexp_replace(F.array_join(let(lines, kept), "\n"), "\n{3,}", "\n\n"))


def tlp(*texts: Column) -> Column:
    """The first text's traffic-light mark; WHITE is called CLEAR."""
    found = F.coalesce(*[F.nullif(F.upper(F.regexp_extract(t, fixed.TLP_PATTERN, 1)), F.lit("")) for t in texts])
    return F.when(found == "WHITE", "CLEAR").otherwise(found)


def cve_id(value: Column) -> Column:
    return F.translate(F.upper(F.trim(F.coalesce(value, F.lit("")))), "‑–", "--")


def is_cve(value: Column) -> Column:
    return cve_id(value).rlike(r"^CVE-\d{4}-\d{4,7}$")


def cves(text: Column) -> Column:
    """Distinct upper-case CVE ids, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(fixed.CVE_PATTERN), F.lit(0)), lambda c: F.upper(c))))


def actor_names(text: Column) -> Column:
    """Names that look like actors', in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.ACTOR_PATTERN), F.lit(0)))


def seed_title(text: Column, limit: int = 120) -> Column:
    """The first sentence of the first non-blank line, without its dot."""
    line = F.get(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != ""), F.lit(0))
    first = F.get(F.split(line, r"(?<=[.!?])\s"), F.lit(0))
    return F.substring(F.regexp_replace(F.coalesce(first, F.lit("Untitled threat")), r"\.+$", ""), 1, limit)


def context_of(text: Column, start: Column, end: Column, width: int = 160) -> Column:
    """The sentence around a span (0-based, end exclusive), at most ``width`` characters to either side."""
    before = F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)) - F.when(start > 0, F.lit(1)).otherwise(F.lit(0)))
    dot = F.locate(".", F.reverse(before))
    head = F.when(dot > 0, dot - 1).otherwise(F.least(start, F.lit(width)) - F.when(start > 0, F.lit(1)).otherwise(F.lit(0)))
    head = head + F.when(start > 0, F.lit(1)).otherwise(F.lit(0))
    after = F.substring(text, end + 1, F.lit(width))
    stop = F.locate(".", after)
    tail = F.when(stop > 0, stop).otherwise(F.lit(width))
    return F.trim(F.regexp_replace(F.substring(text, start - head + 1, head + (end - start) + tail), r"\s+", " "))


def search_text(*parts: Column) -> Column:
    """All parts (texts or arrays of texts) in one lower-case text."""
    return F.lower(F.array_join(F.filter(F.flatten(F.array(*parts)), lambda p: p != ""), " "))
