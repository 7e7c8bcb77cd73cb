"""Where detections and queries come from: fields that records lack are filled in, or inferred for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_order, refang
from .joins import small
from .patterns import occurrences, sequence_within

# What a query can rest on, and the group of an indicator query by its first data source, with the types it looks for.
PROVENANCE = ("vendor", "derived", "generic")
IOC_GROUPS = (("network", "IPV4", ("ipv4", "ipv6")), ("dns", "DOMAIN", ("domain",)), ("file_hash", "SHA256", ("sha256", "sha1", "md5")))
VENDOR_SOURCE = r"\(vendor, (S\d+)\)"


def _none() -> Column:
    return F.array().cast("array<string>")


def _gathered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct source ids of each key in natural order."""
    each = rows.select(*keys, F.explode("source_ids").alias("_s")).filter("_s <> ''").distinct()
    return each.groupBy(*keys).agg(natural_order(F.collect_list("_s")).alias(name))


def _last(rows: DataFrame, keys: list[str], *kept: str) -> DataFrame:
    """One row a key: the last by position, as a later entry replaces an earlier one; of equal positions the greatest."""
    return rows.groupBy(*keys).agg(F.max(F.struct("pos", *kept)).alias("_x")).select(*keys, *[f"_x.{c}" for c in kept])


def filled_opportunities(opportunities: DataFrame, steps: DataFrame, mitre: DataFrame) -> DataFrame:
    """(research_id, opportunity_id, source_ids): own sources, else those of the step it detects, else of its techniques' rows.

    opportunities (research_id, pos, opportunity_id, behaviour_ref, techniques, source_ids), steps (research_id, pos, ref,
    source_ids), mitre (research_id, technique_id, source_ids). Of equal ids the last counts.
    """
    last = _last(opportunities, ["research_id", "opportunity_id"], "behaviour_ref", "techniques", "source_ids")
    step = _last(steps, ["research_id", "ref"], "source_ids").select("research_id", F.col("ref").alias("behaviour_ref"), natural_order(F.coalesce("source_ids", _none())).alias("_step"))
    asked = last.filter("source_ids is null").select("research_id", "opportunity_id", F.explode("techniques").alias("technique_id")).distinct()
    by_technique = _gathered(asked.join(mitre, ["research_id", "technique_id"]), ["research_id", "opportunity_id"], "_technique")
    out = last.join(step, ["research_id", "behaviour_ref"], "left").join(by_technique, ["research_id", "opportunity_id"], "left")
    inferred = F.when(F.size("_step") > 0, F.col("_step")).otherwise(F.coalesce("_technique", _none()))
    return out.select("research_id", "opportunity_id", F.coalesce("source_ids", inferred).alias("source_ids"))


def backfilled(queries: DataFrame, opportunities: DataFrame, steps: DataFrame, mitre: DataFrame, iocs: DataFrame, vulns: DataFrame) -> DataFrame:
    """(research_id, pos, query_id, provenance, group_id, source_ids): queries with what they lacked.

    queries (research_id, pos, query_id, opportunity_id, origin, type, provenance, group_id, title, data_sources, techniques,
    source_ids); iocs (research_id, type, source_ids), vulns (research_id, source_ids); the others as in
    ``filled_opportunities``. ``pos`` is a whole number that a research has once.

    A vendor query without a group gets the next VREF number of its research, after as many as the research has already; other
    queries that belong to no detection share a TTP number by title, in the order in which titles first come up. Both are
    running numbers over a research's queries, made of counts by range, so a research with a third of all queries needs no
    window over all of them.
    """
    opps = filled_opportunities(opportunities, steps, mitre).select("research_id", "opportunity_id", F.col("source_ids").alias("_opp"))
    rows = queries.withColumn("opportunity_id", F.nullif("opportunity_id", F.lit(""))).join(opps, ["research_id", "opportunity_id"], "left")
    known = F.col("_opp").isNotNull()
    rest = F.when(F.coalesce(F.col("origin") == "reference", F.lit(False)), "vendor").when(F.coalesce(F.col("type") == "ttp", F.lit(False)) & ~known, "generic").otherwise("derived")
    rows = rows.withColumn("provenance", F.when(F.col("provenance").isin(*PROVENANCE), F.col("provenance")).otherwise(rest))
    rows = rows.withColumn("type", F.coalesce("type", F.lit(""))).withColumn("title", F.coalesce("title", F.lit("")))
    first = F.get("data_sources", F.lit(0))
    kind = F.when(known, "opportunity").when(F.col("provenance") == "vendor", "vendor").when(F.col("type") == "ioc", "ioc").when(F.col("type") == "vuln", "vuln").otherwise("other")
    rows = rows.withColumn("_kind", kind).withColumn("_lacks", F.coalesce(F.col("group_id") == "", F.lit(True)))

    numbered = rows.filter("_lacks and _kind = 'vendor'").select("research_id", "pos")
    there = queries.filter(F.startswith("group_id", F.lit("VREF-"))).groupBy("research_id").agg(F.count("*").alias("_there"))
    vendors = sequence_within(numbered, ["research_id"], "pos", "_vref").join(there, "research_id", "left").select("research_id", "pos", (F.col("_vref") + F.coalesce("_there", F.lit(0))).alias("_vref"))
    titles = rows.filter("_lacks and _kind = 'other'").groupBy("research_id", "title").agg(F.min("pos").alias("_first"))
    titles = sequence_within(titles, ["research_id"], "_first", "_ttp").select("research_id", "title", "_ttp")
    rows = rows.join(vendors, ["research_id", "pos"], "left").join(titles, ["research_id", "title"], "left")

    category = F.coalesce(first, F.lit("network"))
    ioc_group, ioc_key = F.upper(category), F.lit(None).cast("string")
    for name, group, _ in IOC_GROUPS:
        ioc_group = F.when(category == name, group).otherwise(ioc_group)
        ioc_key = F.when(first == name, name).otherwise(ioc_key)
    oid = F.col("opportunity_id")
    detection = F.concat(F.lit("DET-"), F.when(F.startswith(oid, F.lit("DO-")), F.substring(oid, 4, 1 << 30)).otherwise(oid))
    number = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    own = F.when(F.col("_kind") == "opportunity", detection).when(F.col("_kind") == "vendor", number("VREF-", "_vref")).when(F.col("_kind") == "ioc", F.concat(F.lit("IOC-"), ioc_group)).when(F.col("_kind") == "vuln", "VULN-1").otherwise(number("TTP-", "_ttp"))
    rows = rows.withColumn("group_id", F.when(F.col("_lacks"), own).otherwise(F.col("group_id"))).withColumn("_category", F.when(F.col("_kind") == "ioc", ioc_key))

    wanted = F.lit(None).cast("string")
    for name, _, types in IOC_GROUPS:
        wanted = F.when(F.col("type").isin(*types), name).otherwise(wanted)
    by_type = _gathered(iocs.withColumn("_category", wanted).filter("_category is not null"), ["research_id", "_category"], "_ioc")
    by_vuln = _gathered(vulns, ["research_id"], "_vuln")
    asked = rows.filter("source_ids is null and _kind = 'other'").select("research_id", "pos", F.explode("techniques").alias("technique_id")).distinct()
    by_technique = _gathered(asked.join(mitre, ["research_id", "technique_id"]), ["research_id", "pos"], "_technique")
    rows = rows.join(by_type, ["research_id", "_category"], "left").join(by_vuln, "research_id", "left").join(by_technique, ["research_id", "pos"], "left")
    named = F.regexp_extract("title", VENDOR_SOURCE, 1)
    inferred = F.when(F.col("_kind") == "opportunity", F.col("_opp")).when(F.col("_kind") == "vendor", F.when(named != "", F.array(named))).when(F.col("_kind") == "ioc", F.col("_ioc")).when(F.col("_kind") == "vuln", F.col("_vuln")).otherwise(F.col("_technique"))
    return rows.select("research_id", "pos", "query_id", "provenance", "group_id", F.coalesce("source_ids", inferred, _none()).alias("source_ids"))


def inferred_sources(queries: DataFrame, opportunities: DataFrame, steps: DataFrame, ioas: DataFrame, iocs: DataFrame, vulns: DataFrame) -> DataFrame:
    """(research_id, query_id, source_ids): the sources to show beside a query.

    Its own; else its detection's, else those of the step and the observation that the detection refers to; else, for
    indicator queries, of the indicators whose refanged values its body holds in any case; for vulnerability queries, of
    the CVEs that its title and body hold. Sources stand in the order of what they come from. queries has (research_id, query_id, opportunity_id, type,
    title, body, source_ids), opportunities (research_id, pos, opportunity_id, behaviour_ref, source_ids), steps (research_id,
    pos, ref, source_ids), ioas (research_id, pos, ioa_id, source_ids), iocs (research_id, pos, value, source_ids), vulns
    (research_id, pos, cve, source_ids), where a research has a ``pos`` once. Of equal ids the first counts. Values go to the bodies of their research as a list while they
    are few, and meet them by anchors where they are many.
    """

    # Sections of research without queries, mostly nearly all, go before anything is shuffled.
    asked = small(queries.select("research_id").distinct())
    opportunities, steps, ioas, iocs, vulns = [x.join(asked, "research_id", "left_semi") for x in (opportunities, steps, ioas, iocs, vulns)]

    def first(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy("research_id", F.col(key).alias("behaviour_ref")).agg(F.min(F.struct("pos", F.coalesce("source_ids", _none()).alias("s")))["s"].alias(name))

    opps = opportunities.groupBy("research_id", "opportunity_id").agg(F.min(F.struct("pos", "behaviour_ref", "source_ids")).alias("_o")).select("research_id", "opportunity_id", "_o.behaviour_ref", F.coalesce("_o.source_ids", _none()).alias("_own"))
    opps = opps.join(first(steps, "ref", "_step"), ["research_id", "behaviour_ref"], "left").join(first(ioas, "ioa_id", "_ioa"), ["research_id", "behaviour_ref"], "left")
    both = F.array_distinct(F.concat(F.coalesce("_step", _none()), F.coalesce("_ioa", _none())))
    opps = opps.select("research_id", "opportunity_id", F.when(F.size("_own") > 0, F.col("_own")).otherwise(both).alias("_opp"))
    rows = queries.withColumn("opportunity_id", F.nullif("opportunity_id", F.lit(""))).join(opps, ["research_id", "opportunity_id"], "left")
    open_ = rows.filter("source_ids is null and _opp is null")

    def found(kind: str, text: Column, items: DataFrame, pattern: Column) -> DataFrame:
        texts = open_.filter(F.col("type") == kind).select("research_id", F.col("query_id").alias("text_id"), text.alias("text"))
        hits = occurrences(texts, items.select("research_id", F.col("pos").alias("pattern_id"), pattern.alias("pattern")), scope=["research_id"])
        named = hits.join(items.select("research_id", F.col("pos").alias("pattern_id"), F.posexplode("source_ids").alias("_at", "_s")), ["research_id", "pattern_id"])
        # A source counts where it comes first, so a query gathers no more rows than it has sources.
        order = named.groupBy("research_id", F.col("text_id").alias("query_id"), "_s").agg(F.min(F.struct("pattern_id", "_at")).alias("_o"))
        return order.groupBy("research_id", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_s"))), lambda x: x["_s"]).alias("_found"))

    by_ioc = found("ioc", F.lower("body"), iocs, F.lower(refang(F.col("value"))))
    by_cve = found("vuln", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))), vulns, F.col("cve"))
    out = rows.join(by_ioc.unionByName(by_cve), ["research_id", "query_id"], "left")
    inferred = F.when(F.col("_opp").isNotNull(), F.col("_opp")).otherwise(F.coalesce("_found", _none()))
    return out.select("research_id", "query_id", F.coalesce("source_ids", inferred).alias("source_ids"))
