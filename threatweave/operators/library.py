"""The library of a team: filters, pages, siblings, summaries, and the rules that rate what is in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.text import refang

#: Rows that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def _all(*conditions: Column | None) -> Column:
    """All conditions that are given."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def _has(text: Column, part: str | None) -> Column | None:
    return F.contains(F.lower(text), F.lit(part.lower())) if part else None


def _is(column: str, value: str | None) -> Column | None:
    return F.col(column) == value if value else None


def actors(rows: DataFrame, *, q: str | None = None, origin: str | None = None, motivation: str | None = None, industry: str | None = None) -> DataFrame:
    """Actors by a part of their name or aliases, part of their origin, a motivation and a target industry."""
    named = F.concat_ws(" ", "name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    among = lambda c, v: F.array_contains(c, v) if v else None
    return rows.filter(_all(_has(named, q), _has(F.col("origin"), origin) if origin else None, among("motivation", motivation), among("industries", industry)))


def queries(rows: DataFrame, *, platform: str | None = None, kind: str | None = None, status: str | None = None, origin: str | None = None, technique: str | None = None, group: str | None = None, provenance: str | None = None, q: str | None = None) -> DataFrame:
    """Stored queries by exact fields, a technique, and a part of title, body or id."""
    text = F.concat_ws(" ", "title", "body", "query_id")
    tagged = F.array_contains("techniques", technique.upper()) if technique else None
    return rows.filter(_all(_is("platform", platform), _is("type", kind), _is("status", status), _is("origin", origin), _is("group_id", group), _is("provenance", provenance), tagged, _has(text, q)))


def research_queries(rows: DataFrame, *, platform: str | None = None, group: str | None = None, include_reference: bool = True) -> DataFrame:
    """The queries of research: of a platform and a group, with or without vendors' own ones."""
    return rows.filter(_all(_is("platform", platform), _is("group_id", group), None if include_reference else F.col("origin") != "reference"))


def iocs(rows: DataFrame, *, kind: str | None = None, verdict: str | None = None, q: str | None = None) -> DataFrame:
    """Indicators by type, verdict and a part of the value, which may be typed defanged."""
    part = F.contains(F.lower("value"), F.lower(refang(F.lit(q)))) if q else None
    return rows.filter(_all(_is("type", kind), _is("verdict", verdict), part))


def ioc_view(rows: DataFrame, *, types: list[str] | None = None, verdicts: list[str] | None = None, hidden_only: bool = False, q: str | None = None) -> DataFrame:
    """A research's indicators by types, by verdicts or only those that hunts leave out, and by a part of the value."""
    return iocs(rows.filter(_all(F.col("type").isin(types) if types else None, F.col("hidden_from_hunts") if hidden_only else F.col("verdict").isin(verdicts) if verdicts else None)), q=q)


def exportable(rows: DataFrame, include_expired: bool = False) -> DataFrame:
    """Indicators that may leave: neither hidden from hunts (a null flag follows the verdict) nor benign nor excluded."""
    out = F.coalesce("excluded", F.lit(False))
    hide = F.coalesce("hidden_from_hunts", ind.hidden(F.col("verdict"), out, F.lit(include_expired)))
    return rows.filter(~F.coalesce(hide | F.col("verdict").isin("false_positive", "benign") | out, F.lit(False)))


def audit(events: DataFrame, *, entity: str | None = None, user: str | None = None, kind: str | None = None, action: str | None = None, types: tuple[str, ...] = ("research", "cve", "actor", "malware", "ioc", "query")) -> DataFrame:
    """Audit events of an entity (an id, also in capitals, or ``type:id``), a user, a type and an action."""
    if entity and ":" in entity and entity.split(":", 1)[0] in types:
        kind, entity = entity.split(":", 1)
    return events.filter(_all(F.col("entity_id").isin(entity, entity.upper()) if entity else None, _is("entity_type", kind), _is("user_id", user), _is("action", action)))


def page(rows: DataFrame, *order: Column, number: int = 1, size: int = 50) -> DataFrame:
    """One page of rows in an order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def included_sources(sources: DataFrame, read: DataFrame, excluded: DataFrame) -> DataFrame:
    """Sources that were read well and that nobody has excluded."""
    return sources.join(read.filter("ok").select("source_id").distinct(), "source_id", "left_semi").join(excluded.select("source_id").distinct(), "source_id", "left_anti")


def hashes_of(malware: DataFrame, links: DataFrame, indicators: DataFrame) -> DataFrame:
    """(malware_id, value): hashes of research on a malware whose role or context has the first word of its name."""
    word = F.lower(F.substring_index("name", " ", 1))
    told = F.lower(F.concat(F.coalesce("context", F.lit("")), F.coalesce("role", F.lit(""))))
    own = links.join(malware.select("malware_id", word.alias("word")), "malware_id").select("research_id", "malware_id", "word").distinct()
    mine = indicators.filter(F.col("type").isin("sha256", "sha1", "md5")).select("research_id", "value", told.alias("told")).distinct()
    return own.join(mine, "research_id").filter(F.contains("told", "word")).select("malware_id", "value").distinct()


def siblings(wanted: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, sibling_id): for each wanted query the others of its research and group, or, without a group, of its sigma rule."""
    rule = lambda c: F.when(c("group_id").isNotNull(), F.concat_ws("/", F.lit("g"), c("research_id"), c("group_id"))).otherwise(F.concat(F.lit("s/"), F.coalesce(c("sigma_ref"), F.when(c("platform") == "sigma", c("query_id")))))
    mine = wanted.select("query_id", rule(F.col).alias("k")).filter("k is not null")
    others = queries.select(F.col("query_id").alias("sibling_id"), rule(F.col).alias("k"))
    return mine.join(others, "k").filter("query_id <> sibling_id").select("query_id", "sibling_id")


def summaries(research: DataFrame, named: DataFrame, queries: DataFrame, results: DataFrame) -> DataFrame:
    """One row a research: numbers of techniques, indicators, sources and own queries, and the result states of its workspaces.

    named has (research_id, technique_id, ioc, source_id), a row a mention; queries (research_id, origin); results
    (research_id, workspace_id, status).
    """
    counts = named.groupBy("research_id").agg(F.count_distinct("technique_id").alias("ttps"), F.count_distinct("ioc").alias("iocs"), F.count_distinct("source_id").alias("sources"))
    own = queries.filter("origin <> 'reference'").groupBy("research_id").agg(F.count("*").alias("queries"))
    states = results.groupBy("research_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "workspace_id", "status"))).alias("results"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = research.join(counts, "research_id", "left").join(own, "research_id", "left").join(states, "research_id", "left")
    return out.select(*research.columns, zero("ttps"), zero("iocs"), zero("queries"), zero("sources"), F.coalesce("results", F.array().cast("array<string>")).alias("results"))


def required_logs(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(research_id, data_source, label): the distinct categories that a research's queries need; unknown ones label themselves."""
    rows = queries.select("research_id", F.explode("data_sources").alias("data_source")).distinct()
    few = labels.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(labels) if few else labels, "data_source", "left").select("research_id", "data_source", F.coalesce("label", "data_source").alias("label"))


def vendor_queries(rows: DataFrame, platforms: tuple[str, ...]) -> DataFrame:
    """(research_id, platform, body, number): vendors' queries, the first of those whose texts differ in case and white space only."""
    plain = F.lower(F.trim(F.regexp_replace("body", r"\s+", " ")))
    first = rows.withColumn("_k", plain).filter("_k <> ''").groupBy("research_id", "_k").agg(F.min(F.struct("pos", "platform", "body")).alias("x"))
    platform = F.when(F.col("x.platform").isin(*platforms), F.col("x.platform")).when(F.contains(F.lower("x.platform"), F.lit("kql")), "kql_defender").otherwise(F.col("x.platform"))
    number = F.row_number().over(Window.partitionBy("research_id").orderBy("x.pos"))
    return first.select("research_id", platform.alias("platform"), F.col("x.body").alias("body"), number.cast("long").alias("number"))


def csv_rows(queries: DataFrame) -> DataFrame:
    """Stored queries as they go into a CSV file: lists joined, gaps empty."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    joined = lambda c, sep: F.array_join(F.coalesce(c, F.array().cast("array<string>")), sep).alias(c)
    return queries.select("research_id", "query_id", text("group_id"), "type", "platform", "title", text("status"), text("provenance"), joined("source_ids", " "), joined("techniques", " "), joined("log_sources", "; "), text("fp_notes"), text("workspace_mapping"), joined("lint", "; "), "body")


def provider_flag(provider: Column, number: Column, word: Column) -> Column:
    """Whether a provider's answer flags an indicator: engines, score, pulses or hits as ``number``, its class as ``word``."""
    # From which number on which provider's answer counts.
    least = {"virustotal": 3, "abuseipdb": 50, "otx": 3, "urlscan": 1, "abusech": 1}
    out = F.when(provider == "greynoise", word == "malicious")
    for name, n in least.items():
        out = out.when(provider == name, number >= n)
    return F.coalesce(out, F.lit(False))


def provider_benign(provider: Column, word: Column, riot: Column) -> Column:
    return (provider == "greynoise") & ((F.coalesce(word, F.lit("")) == "benign") | F.coalesce(riot, F.lit(False)))


def verdict_inputs(found: DataFrame, sources: DataFrame, role_pattern: str) -> DataFrame:
    """(type, value, best_reliability, named, listed): what the verdict of an indicator rests on.

    found has (type, value, source_id, role, context), sources (source_id, reliability, origin). The best reliability is the least
    letter of sources other than the seed, C where none has one; named means that a role or context tells what it is; listed
    means that such a source has it and that it isn't a file's name or path.
    """
    rows = found.join(sources.select("source_id", "reliability", F.col("origin").alias("_origin")), "source_id", "left")
    vendor = F.coalesce(F.col("_origin") != "seed_text", F.lit(True))
    told = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(role_pattern)
    out = rows.groupBy("type", "value").agg(F.coalesce(F.min(F.when(vendor, F.coalesce("reliability", F.lit("C")))), F.lit("C")).alias("best_reliability"), F.bool_or(told("role") | told("context")).alias("named"), F.bool_or(vendor).alias("_vendor"))
    return out.select("type", "value", "best_reliability", (F.col("named") & F.col("_vendor")).alias("named"), (F.col("_vendor") & ~F.col("type").isin("file_name", "file_path")).alias("listed"))


def intel_first_seen(provider_times: Column, published: Column, at: Column) -> Column:
    """The earliest date of providers and sources; dates more than a day ahead don't count."""
    none = F.array().cast("array<string>")
    times = F.transform(F.concat(F.coalesce(provider_times, none), F.coalesce(published, none)), ind.lenient_time)
    return F.array_min(F.filter(times, lambda t: t <= at + F.expr("interval 1 day")))


def severity(n_cves: Column, techniques: Column) -> Column:
    """critical with a CVE and exploitation, high with one of them, else medium."""
    exploited, known = F.array_contains(techniques, "T1190"), n_cves > 0
    return F.when(known & exploited, "critical").when(known | exploited, "high").otherwise("medium")


def classification(n_cves: Column, n_sources: Column) -> Column:
    kinds = F.array(F.when(n_cves > 0, "vulnerability_exploitation"), F.when(n_sources > 1, "campaign").otherwise("ttp_trend"))
    return F.filter(kinds, lambda k: k.isNotNull())


def impact(techniques: Column) -> Column:
    """Which of confidentiality, integrity and availability techniques touch."""
    return F.struct(F.lit(True).alias("confidentiality"), F.array_contains(techniques, "T1190").alias("integrity"), F.arrays_overlap(techniques, F.array(F.lit("T1486"), F.lit("T1490"))).alias("availability"))


def advice(sentence: Column, action: str, told: str, urgent: str, most: int = 400) -> Column:
    """The horizon of a sentence that recommends an action; null for other sentences."""
    return F.when((F.length(sentence) <= most) & sentence.rlike(action) & sentence.rlike(told), F.when(sentence.rlike(urgent), "immediate").otherwise("short_term"))


def unchanged(new: Column, old: Column, old_count: Column, bodies: Column) -> Column:
    """Whether a group's queries still have the same values; where the old values weren't stored, by number and texts."""
    low = F.lower(bodies)
    return F.when(old.isNotNull(), F.array_sort(new) == F.array_sort(old)).otherwise((old_count == F.size(new)) & F.forall(new, lambda v: F.contains(low, F.lower(v))))


def unknown_members(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(item, key): what items refer to and nobody knows."""
    return items.select("item", F.explode("refs").alias(key)).filter(F.col(key).isNotNull()).distinct().join(known.select(key).distinct(), key, "left_anti").select("item", key)


def affected_products(vulnerabilities: DataFrame) -> DataFrame:
    """(research_id, products): the distinct products of a research's vulnerabilities, sorted."""
    rows = vulnerabilities.select("research_id", F.explode("affected_products").alias("p")).filter("p <> ''").distinct()
    return rows.groupBy("research_id").agg(F.array_sort(F.collect_list("p")).alias("products"))
