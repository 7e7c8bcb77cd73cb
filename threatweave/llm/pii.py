"""Operator 1: personal data by weak supervision.

Base spans come from fixed patterns and checks. Further candidates are what the patterns find but the checks refuse, looser
forms (written-out e-mail addresses, phone numbers without a country code), and secrets: values of passwords and keys, and long
runs of token characters. Five labelers vote on every candidate, for (+1), against (-1) or not at all (0):

- regex: the base check holds, or refuses a form that the base pattern found; for secrets, formats of well-known keys and digests
- gazetteer: top-level domains in use and reserved ones, card issuers' prefixes, address blocks, dialling prefixes, names that
  secrets have, and names of values that only look like secrets
- context: telling words shortly before, in the four languages of the corpus
- shape: variety of the characters; runs of one digit or counting digits speak against
- border: quotes, brackets, colons and equals signs beside it speak for a value, letters and digits against

Expectation-maximisation over the counts of vote patterns estimates, for each kind, how common personal data is and how
reliable each labeler is (votes are independent given the truth). Its posteriors are the soft labels of the final span
classifier, a logistic regression on votes and shape features. Both are fitted on counts of patterns, whose number is bounded by
the feature values (``5 * 3**5 * 5 * 3``), not by the corpus. Candidates with a probability of ``CERTAIN`` or more that
don't touch a base span of any kind become added spans; base spans always stay.

DataFrame and SQL functions only; the fit is arithmetic on the driver over the counted patterns.

Defined results: a null text is an empty one; without candidates there are no added spans; rows that repeat are judged
each; ties (spans that start at one place) stand in the order of ``KINDS``; very long texts are searched whole; an empty table
gives no rows; extra columns are ignored, and ``redact`` keeps them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written

#: The kinds with base spans, and the one that only the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: The fixed patterns. Runs are possessive and start where no earlier start in the same run can match, so that long runs
#: cost linear time; what they find is what the plain forms find.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What secrets are called, and what values are called that only look like secrets.
SECRET_NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|client[_ -]?key|credentials?|bearer|auth|passwort|kennwort|geheimnis|mot de passe|jeton|contrase(?:ñ|n)a|clave"
HARMLESS_NAMES = r"sha-?[0-9]*|md5|crc|commit|checksum|hash|digest|uuid|guid|etag|revision|rev|build|blob|serial|isbn|doi"
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++ ?(?:[\[(](?:at|AT)[\])]| at (?=[A-Za-z0-9-]++ dot )) ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]|(?<= )dot(?= )) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    # A value has a digit, which is looked for before its name is.
    "secret": rf"(?<=[=:\s\"'])(?=[^\s\"'<>,;0-9]{{0,60}}+[0-9])(?<=[=:]\s{{0,2}}[\"']?)(?<=(?i:{SECRET_NAMES})\s{{0,2}}[=:]\s{{0,2}}[\"']?)[^\s\"'<>,;]{{6,}}+|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{{16,}}+=*+",
}
#: Texts that can't hold a match are not searched.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_NEEDS = {"email": r"[\[(](?:at|AT)[\])]| at [A-Za-z0-9-]++ dot ", "phone": r"[0-9]{3}[ .-][0-9]{4}", "secret": r"[=:]\s{0,2}[\"']?[^\s\"'<>,;0-9]{0,60}+[0-9]|(?<![A-Za-z0-9+/_=-])[A-Za-z+/_-]{0,60}+[0-9][A-Za-z0-9+/_-]{15}|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]{16})[A-Za-z+/_-]++[0-9]"}
#: For, and against.
GAZETTEER = {
    "email": (r"(?i)(?:\.|dot[\])]? ?)(?:com|org|net|edu|gov|mil|info|io|dev|app|biz|eu|de|at|ch|fr|be|lu|es|mx|ar|cl|co|pe|uk|ie|us|ca|au|nz|it|nl|pt|pl|se|no|fi|dk|cz|jp|cn|in|br|ru|za)$", r"(?i)\.(?:test|invalid|localhost|local|png|jpe?g|gif|js|css|py|txt)$"),
    "ip": (r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|[1-9][0-9]?\.[0-9]{2,3}\.|1[0-9]{2}\.|2[01][0-9]\.|22[0-3]\.)", r"^(?:0|127\.|255\.|22[4-9]\.|2[3-5][0-9]\.|[0-9]\.[0-9]\.)|[0-9]{4}"),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|64|65|35|62)", r"^(?:0|1|7|8|9)"),
    "phone": (r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2})", r"^(?:\+0|\(?[01][0-9]{2}|\(?555[ )-])"),
    "secret": (rf"(?i)(?:{SECRET_NAMES})\W{{0,5}}$", rf"(?i)(?:{HARMLESS_NAMES})\W{{0,5}}$"),
}
FOR = {
    "email": r"(?i)mail|contact|write|reach|reply|correo|escr[ií]b|courriel|[ée]cri(?:re|vez)|kontakt|schreib|erreich",
    "ip": r"(?i)\bip\b|address|host|server|login|client|adresse|direcci|servidor|serveur",
    "card": r"(?i)card|visa|master|amex|credit|debit|pay|tarjeta|pago|carte|paiement|karte|zahl",
    "phone": r"(?i)phone|call|\btel|mobile|\bfax|\bcell|dial|text me|t[ée]l[ée]|appel|anruf|ruf|handy|ll[aá]m|m[oó]vil",
    "secret": r"(?i)login|user|sign in|access|connect|export |env|config|zugang|anmeld|acc[eè]s|connexion|acceso|usuario",
}
AGAINST = r"(?i)version|\bv\.?\s*$|order|\bid\b|\bref|isbn|section|ticket|invoice|\bno\.\s*$|#\s*$|bestell|rechnung|commande|facture|pedido|factura|https?://\S*$"
#: Formats of keys and of digests that serve as keys.
KEY_FORMS = r"^(?:AKIA[0-9A-Z]{12,}|gh[pousr]_\w{20,}|sk-[\w-]{16,}|xox[abpr]-[\w-]{10,}|AIza[\w-]{20,}|eyJ[\w-]{10,}.*|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"
UUID = r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
CERTAIN = 0.9
CONTEXT = 40
ROUNDS, STEPS = 30, 400
VOTES = ("v_regex", "v_gazetteer", "v_context", "v_shape", "v_border")
SPAN = "struct<s:int,e:int,v:string>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (s, e, v): code points, e exclusive. The text between matches gives the places."""
    none = F.array().cast(f"array<{SPAN}>")

    def place(found: Column) -> Column:
        def between(parts: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), none.alias("out"))

            def step(acc: Column, i: Column) -> Column:
                s = acc["at"] + F.length(F.get(parts, i))
                e = s + F.length(F.get(found, i))
                return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), F.get(found, i).alias("v")))).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), between))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """The Luhn check over a text of digits."""
    doubled = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: let(F.substring(F.reverse(value), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1)), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The base check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(digits(value))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits(value))).otherwise(False)
    return (n >= 10) & (n <= 15)


def votes(kind: str, text: Column, span: Column, base: Column, loose: bool) -> dict[str, Column]:
    """The labelers' votes, and the features of the classifier, of one candidate."""
    value, d = span["v"], digits(span["v"])
    before = F.substring(text, F.greatest(span["s"] - CONTEXT, F.lit(0)) + 1, F.least(span["s"], F.lit(CONTEXT)))
    left, right = F.when(span["s"] > 0, F.substring(text, span["s"], F.lit(1))).otherwise(" "), F.substring(text, span["e"] + 1, F.lit(1))
    vote = lambda yes, no: F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))
    secret = kind == "secret"
    named = before if secret else value
    flat = d.rlike(r"([0-9])\1{6}") | d.rlike("0123456|1234567|2345678|3456789|9876543")
    kinds = F.size(F.array_distinct(F.split(value, "")))
    varied = (kinds >= 9) if secret else (kinds >= 5)
    rule = vote(value.rlike(KEY_FORMS), value.rlike(UUID)) if secret else F.lit(0) if loose else vote(base, ~base)
    return {
        "v_regex": rule,
        "v_gazetteer": vote(named.rlike(GAZETTEER[kind][0]), named.rlike(GAZETTEER[kind][1])),
        "v_context": vote(before.rlike(FOR[kind]) & ~before.rlike(AGAINST), before.rlike(AGAINST)),
        "v_shape": vote(varied & ~flat, flat | ~varied),
        "v_border": vote(left.rlike(r"[\"'=:<(\[]") | right.rlike(r"[\"'>)\]]"), left.rlike(r"[\p{L}\p{N}/]") | right.rlike(r"[\p{L}\p{N}/]")),
        "size": F.least(F.floor(F.length(value) / 8), F.lit(4)).cast("int"),
        "form": F.when(F.lit(loose), F.lit(2)).when(value.rlike(r"[\x20()-]"), F.lit(1)).otherwise(F.lit(0)),
    }


def candidates(docs: DataFrame, keep: str) -> DataFrame:
    """``keep`` and found: an array of candidates (s, k, e, base, votes, features), for every document."""
    text = F.coalesce("text", F.lit(""))
    shape = "array<struct<s:int,k:int,e:int,base:boolean," + ",".join(f"{n}:int" for n in (*VOTES, "size", "form")) + ">>"

    def described(kind: str, loose: bool):
        def describe(span: Column) -> Column:
            def row(base: Column) -> Column:
                seen = votes(kind, text, span, base, loose)
                return F.struct(span["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), span["e"].alias("e"), base.alias("base"), *[c.cast("int").alias(n) for n, c in seen.items()])

            return let(F.lit(False) if loose else valid(kind, span["v"]), row)

        return describe

    def of_length(low: int, high: int):
        return lambda span: F.length(digits(span["v"])).between(low, high)

    lists = []
    for loose, source, needs in ((False, PATTERNS, NEEDS), (True, LOOSE, LOOSE_NEEDS)):
        for kind, pattern in source.items():
            found = matches(text, pattern)
            if kind in ("card", "phone") and not loose:
                # Numbers of other lengths are neither cards nor phones, and no candidates.
                found = F.filter(found, of_length(*((13, 20) if kind == "card" else (7, 17))))
            if kind == "secret":
                # Words and plain numbers are no secrets, whatever stands before them.
                found = F.filter(found, lambda span: span["v"].rlike("[0-9]") & span["v"].rlike("[A-Za-z]"))
            rows = F.transform(found, described(kind, loose))
            lists.append(F.when(text.rlike(needs[kind]), rows.cast(shape)).otherwise(F.array().cast(shape)))
    return docs.select(keep, F.concat(*lists).alias("found"))


def em(counts: dict[tuple, int], n_votes: int) -> dict[tuple, float]:
    """Posterior of each vote pattern of one kind: two classes, votes independent given the class."""
    prior = 0.5
    # To start with, a vote is right three times in four.
    tables = [{c: {v: (0.75 if (v > 0) == c else 0.25) if v else 0.5 for v in (-1, 0, 1)} for c in (True, False)} for _ in range(n_votes)]
    post: dict[tuple, float] = {}
    total = sum(counts.values())
    for _ in range(ROUNDS):
        for pattern in counts:
            yes, no = prior, 1 - prior
            for t, v in zip(tables, pattern, strict=True):
                yes, no = yes * t[True][v], no * t[False][v]
            post[pattern] = yes / (yes + no)
        prior = (sum(n * post[p] for p, n in counts.items()) + 1) / (total + 2)
        for i, t in enumerate(tables):
            for c in (True, False):
                held = {v: 4 * (0.6 if (v > 0) == c else 0.2) if v else 2.0 for v in (-1, 0, 1)}
                for p, n in counts.items():
                    held[p[i]] += n * (post[p] if c else 1 - post[p])
                s = sum(held.values())
                t[c] = {v: x / s for v, x in held.items()}
    return post


def indicators(kind: int, row: dict) -> list[tuple]:
    """The binary features of a candidate; each is a (name, value) of its kind."""
    return [(kind, "bias", 0)] + [(kind, n, int(row[n])) for n in (*VOTES, "size", "form")]


def train(patterns: list[dict]) -> dict[tuple, float]:
    """Weights of the span classifier from counted patterns (k, votes, features, n)."""
    soft: list[tuple[list[tuple], float, float]] = []
    for k in range(len(KINDS)):
        mine = [p for p in patterns if p["k"] == k]
        counts: dict[tuple, int] = {}
        for p in mine:
            v = tuple(p[n] for n in VOTES)
            counts[v] = counts.get(v, 0) + p["n"]
        if not counts:
            continue
        post = em(counts, len(VOTES))
        soft += [(indicators(k, p), post[tuple(p[n] for n in VOTES)], math.log1p(p["n"])) for p in mine]
    weights: dict[tuple, float] = {f: 0.0 for names, _, _ in soft for f in names}
    scale = sum(n for *_, n in soft) or 1.0
    for _ in range(STEPS):
        slope = {f: 0.001 * w for f, w in weights.items()}
        for names, y, n in soft:
            p = 1 / (1 + math.exp(-sum(weights[f] for f in names)))
            for f in names:
                slope[f] += (p - y) * n / scale
        for f, g in slope.items():
            weights[f] -= 2.0 * g
    return {f: round(w, 6) for f, w in weights.items()}


def probability(c: Column, weights: dict[tuple, float]) -> Column:
    total = F.lit(0.0)
    for n in ("bias", *VOTES, "size", "form"):
        mine = {(k, v): w for (k, name, v), w in weights.items() if name == n}
        if mine:
            value = F.lit(0) if n == "bias" else c[n]
            chain = reduce(lambda a, x: a.when((c["k"] == x[0][0]) & (value == x[0][1]), F.lit(x[1])), sorted(mine.items()), F.when(F.lit(False), F.lit(0.0)))
            total = total + F.coalesce(chain, F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def find_spans(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """``keep`` and spans: (s, k, e, base), by s and then k, of every document row."""
    held = written(candidates(docs, keep), "pii-candidates")
    keys = ["k", *VOTES, "size", "form"]
    counted = held.select(F.explode("found").alias("c")).select("c.*").groupBy(*keys).agg(F.count("*").alias("n")).collect()
    weights = train(sorted((r.asDict() for r in counted), key=lambda r: tuple(r[x] for x in keys)))
    base = F.filter("found", lambda c: c["base"])

    def both(sure: Column) -> Column:
        more = F.filter("found", lambda c: ~c["base"] & (probability(c, weights) >= CERTAIN) & ~F.exists(sure, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
        return F.array_sort(F.transform(F.concat(sure, more), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["base"].alias("base"))))

    some = let(base, both)
    return held.select(keep, F.when(F.size("found") > 0, some).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,base:boolean>>")).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda c: c["base"])

    def of_kind(i: int):
        return lambda c: c["base"] & (c["k"] == i)

    counts = [F.size(F.filter("spans", of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE_KINDS)]
    more = [F.size(F.filter("spans", lambda c: ~c["base"])).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("has_private")]
    return found.select("doc_id", *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *more)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; other columns stay, n_chars follows the text.

    The candidates are found on the rows themselves, so the text never leaves its row and nothing is shuffled.
    """
    found = find_spans(docs.select(F.struct(*docs.columns).alias("__row"), "text"), "__row")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("__row.text")

    def step(acc: Column, c: Column) -> Column:
        fresh = c["s"] >= acc["at"]
        part = F.concat(F.substring(text, acc["at"] + 1, F.greatest(c["s"] - acc["at"], F.lit(0))), F.get(names, c["k"]))
        return F.struct(F.greatest(acc["at"], c["e"]).alias("at"), F.concat(acc["out"], F.when(fresh, part).otherwise("")).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when((F.size("spans") > 0) & text.isNotNull(), cleaned).otherwise(text)
    fresh = {"text": F.col("__new")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(text.eqNullSafe(F.col("__new")), F.col("__row.n_chars")).otherwise(F.length("__new")).cast(docs.schema["n_chars"].dataType)
    out = found.select("__row", new.alias("__new"))
    return out.select(*[fresh.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digest(find_spans(docs))
