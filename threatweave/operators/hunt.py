"""Detections and indicators over telemetry, in batches and streams alike: filters and broadcast joins only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Indicators that are broadcast at most; more are joined by shuffle (batch only).
BROADCAST_IOCS = 500_000


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def condition(field: Column, op: str, values: list[str]) -> Column:
    """One condition of a specification: any of the values, in any case."""
    low = F.lower(field)
    test = {"equals": lambda v: low == v, "endswith": lambda v: low.endswith(v), "contains": lambda v: low.contains(v), "startswith": lambda v: low.startswith(v)}[op]
    return F.coalesce(reduce(lambda a, b: a | b, [test(v.lower()) for v in values]), F.lit(False))


def matches(events: DataFrame, specs: list[dict]) -> DataFrame:
    """Events with the ids of the specifications they meet, one row a hit. A specification whose field the table lacks isn't run.

    All specifications are tested in one pass over the events.
    """
    tests = []
    for spec in specs:
        if all(c["field"] in events.columns for c in spec["conditions"]):
            hit = reduce(lambda a, b: a & b, [condition(F.col(c["field"]), c["op"], c["values"]) for c in spec["conditions"]])
            tests.append(F.when((F.col("category") == spec["category"]) & hit, F.lit(spec["spec_id"])))
    found = F.filter(F.array(*tests), lambda s: s.isNotNull())
    return events.withColumn("_hits", found).filter(F.size("_hits") > 0).withColumn("spec_id", F.explode("_hits")).drop("_hits")


def indicator_hits(events: DataFrame, iocs: DataFrame, *, few: bool = True) -> DataFrame:
    """Events that touch an indicator (type, value): its ioc_type and ioc_value beside the event's columns, one row a hit."""
    pair = lambda kind, column: F.struct(F.lit(kind).alias("ioc_type"), F.lower(column).alias("ioc_value"))
    pairs = F.array(pair("ipv4", "dst_ip"), pair("domain", "domain"), pair("sha256", "sha256"))
    rows = events.withColumn("_p", F.explode(F.filter(pairs, lambda p: p["ioc_value"].isNotNull()))).select("*", "_p.*").drop("_p")
    wanted = iocs.select(F.col("type").alias("ioc_type"), F.lower("value").alias("ioc_value")).distinct()
    return rows.join(F.broadcast(wanted) if few else wanted, ["ioc_type", "ioc_value"])


def hunted(events: DataFrame, iocs: DataFrame, since: Column) -> DataFrame:
    """Hits of indicators that aren't hidden, from ``since`` on; the indicators are broadcast while they are few."""
    live = iocs.filter(~F.col("hidden_from_hunts") & F.col("type").isin("ipv4", "domain", "sha256"))
    few = live.count() <= BROADCAST_IOCS
    return indicator_hits(events.filter(F.col("ts") >= since), live, few=few)


def exposure(assets: DataFrame, cves: DataFrame, names: int = 50) -> DataFrame:
    """(cve, software, devices, examples): distinct devices with a vulnerable software, and some of their names."""
    hit = assets.join(cves.select("cve").distinct(), "cve", "left_semi")
    each = hit.select("cve", "software", "device").filter("device is not null").distinct()
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy("cve", "software").orderBy("device")))
    some = F.when(F.col("_r") <= names, F.col("device"))
    return ranked.groupBy("cve", "software").agg(F.count("*").alias("devices"), F.array_sort(F.collect_list(some)).alias("examples"))


def neutral(events: DataFrame, dictionary: dict[str, str], overrides: dict[str, str] | None = None) -> DataFrame:
    """Events with vendor columns renamed to neutral fields; a workspace's own names outrank the vendor's."""
    names = {theirs: ours for ours, theirs in dictionary.items()} | {theirs: ours for theirs, ours in (overrides or {}).items()}
    return events.withColumnsRenamed({k: v for k, v in names.items() if k in events.columns})
