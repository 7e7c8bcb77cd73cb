"""Queries of the STIX object tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stix as sx
from ..sources.writers import NAMESPACE, stored
from .registry import query


def _sections(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = t.mentions
    rid = F.col("rid").alias("research_id")
    actors = m.filter("rid % 5 <> 0").select(rid, F.col("actor").alias("name"), F.array(F.concat(F.lit("Group"), (F.col("suppkey") % 40).cast("string")), F.lit("")).alias("aliases"))
    malware = m.select(rid, F.col("malware").alias("name"), F.when(F.col("partkey") % 90 % 4 == 0, "RMM").when(F.col("partkey") % 90 % 4 == 1, "loader").when(F.col("partkey") % 90 % 4 == 2, "odd").alias("kind"))
    vulns = m.filter("pos % 2 = 0").select(rid, F.when(F.col("partkey") % 13 == 0, "CVE-x").otherwise(F.lower("cve")).alias("cve"))
    mitre = m.select(rid, F.lower("technique_id").alias("technique_id"), F.concat(F.lit("Name of "), "technique_id").alias("name"), F.concat(F.lit("The "), "tactic_id", F.lit("!")).alias("tactic"))
    sectors = m.select(rid, F.when(F.col("flag") == "R", "Retail ").when(F.col("flag") == "A", "").otherwise("Energy & Gas").alias("name"))
    text = F.when(F.col("pos") % 3 == 0, F.lit("seen once")).when(F.col("pos") % 3 == 1, F.concat(F.lit("by GROUP"), (F.col("suppkey") % 40).cast("string"))).otherwise(F.upper("quote"))
    iocs = m.filter("flag <> 'R'").select(rid, F.col("ioc_type").alias("type"), F.replace("ioc_value", F.lit("."), F.lit("[.]")).alias("value"), F.when(F.col("state") == "O", "malicious").alias("verdict"), text.alias("text"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("valid_from"))
    r = t.research
    research = r.select(F.col("rid").alias("research_id"), "title", F.col("search_text").alias("summary"), F.when(F.col("rid") % 3 == 0, "white").when(F.col("rid") % 3 == 1, "red").alias("tlp"), "created_at", "updated_at", "published_at")
    return research, stored(sx.entities(actors, malware, vulns, mitre, sectors), "stix-entities"), stored(sx.indicators(iocs), "stix-indicators")


def _id(kind: str, key: str) -> str:
    """The name-based UUID in SQL."""
    h = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode(concat('{kind}|', {key})))"
    part = lambda a, n: f"substring({h}, {a}, {n})"
    return f"concat('{kind}--', {part(1, 8)}, '-', {part(9, 4)}, '-5', {part(14, 3)}, '-', substring('89ab89ab89ab89ab', cast(concat('0x', {part(17, 1)}) AS INTEGER) + 1, 1), {part(18, 3)}, '-', {part(21, 12)})"


NAMED = f"""
    a AS (SELECT DISTINCT rid, 'intrusion-set' AS type, {_id("intrusion-set", "actor")} AS id, actor AS name FROM mentions WHERE rid % 5 <> 0),
    al AS (SELECT DISTINCT rid, {_id("intrusion-set", "actor")} AS id, concat('group', cast(suppkey % 40 AS STRING)) AS n FROM mentions WHERE rid % 5 <> 0),
    m AS (SELECT DISTINCT rid, CASE WHEN partkey % 90 % 4 = 0 THEN 'tool' ELSE 'malware' END AS type, CASE WHEN partkey % 90 % 4 = 0 THEN {_id("tool", "malware")} ELSE {_id("malware", "malware")} END AS id, malware AS name FROM mentions),
    v AS (SELECT DISTINCT rid, 'vulnerability' AS type, {_id("vulnerability", "cve")} AS id, cve AS name FROM mentions WHERE pos % 2 = 0 AND partkey % 13 <> 0),
    p AS (SELECT rid, 'attack-pattern' AS type, {_id("attack-pattern", "technique_id")} AS id, concat('Name of ', technique_id) AS name FROM (SELECT DISTINCT rid, technique_id FROM mentions)),
    s AS (SELECT DISTINCT rid, 'identity' AS type, {_id("identity", "concat('sector|', lower(x))")} AS id, x AS name FROM (SELECT rid, CASE flag WHEN 'R' THEN 'Retail' WHEN 'N' THEN 'Energy & Gas' END AS x FROM mentions WHERE flag <> 'A')),
    n AS (SELECT * FROM a UNION ALL SELECT * FROM m UNION ALL SELECT * FROM v UNION ALL SELECT * FROM p UNION ALL SELECT * FROM s),
    i0 AS (SELECT rid, ioc_type, lower(ioc_value) AS low, min((ioc_value, CASE WHEN state = 'O' THEN 'malicious' ELSE '' END, CASE pos % 3 WHEN 0 THEN 'seen once' WHEN 1 THEN concat('by GROUP', cast(suppkey % 40 AS STRING)) ELSE upper(quote) END)) AS x FROM mentions WHERE flag <> 'R' GROUP BY ALL),
    i AS (SELECT rid, 'indicator' AS type, {_id("indicator", "concat(rid, '|', ioc_type, '|', low)")} AS id, x[1] AS name, lower(x[3]) AS text FROM i0),
    h AS (SELECT i.rid, i.id AS src, m.id AS dst, 0 AS k FROM i JOIN m ON m.rid = i.rid AND contains(text, m.name) UNION SELECT i.rid, i.id, a.id, 1 FROM i JOIN a ON a.rid = i.rid AND contains(text, a.name) UNION SELECT i.rid, i.id, al.id, 1 FROM i JOIN al ON al.rid = i.rid AND contains(text, al.n)),
    r AS (SELECT rid, src, 'indicates' AS verb, dst FROM (SELECT *, min(k) OVER (PARTITION BY rid, src) AS least FROM h) WHERE k = least
      UNION ALL SELECT i.rid, i.id, 'indicates', a.id FROM i JOIN a ON a.rid = i.rid WHERE i.id NOT IN (SELECT src FROM h)
      UNION ALL SELECT a.rid, a.id, CASE WHEN n.type IN ('malware', 'tool', 'attack-pattern') THEN 'uses' ELSE 'targets' END, n.id FROM a JOIN n ON n.rid = a.rid AND n.type <> 'intrusion-set'
      UNION ALL SELECT m.rid, m.id, 'targets', v.id FROM m JOIN v ON v.rid = m.rid WHERE m.type = 'malware' AND m.rid NOT IN (SELECT rid FROM a)),
    o AS (SELECT rid, type, id, name, NULL AS relationship_type, NULL AS source_ref, NULL AS target_ref FROM n UNION ALL SELECT rid, type, id, name, NULL, NULL, NULL FROM i
      UNION ALL SELECT rid, 'relationship', {_id("relationship", "concat(rid, '|', src, '|', verb, '|', dst)")}, NULL, verb, src, dst FROM r UNION ALL SELECT rid, 'report', {_id("report", "cast(rid AS STRING)")}, title, NULL, NULL, NULL FROM research)"""


@query("k05_stix_graph", f"""
    WITH {NAMED} SELECT o.rid AS research_id, type, id, name, relationship_type, source_ref, target_ref, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created, strftime(greatest(created_at, updated_at), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS modified,
      CASE o.rid % 3 WHEN 0 THEN '{sx.TLP2["CLEAR"]}' WHEN 1 THEN '{sx.TLP2["RED"]}' ELSE '{sx.TLP2["AMBER"]}' END AS marking_ref FROM o JOIN research USING (rid)""")
def stix_graph(t):
    return sx.graph(*_sections(t)).select("research_id", "type", "id", "name", "relationship_type", "source_ref", "target_ref", "created", "modified", "marking_ref")


@query("k05_report_refs", f"""
    WITH {NAMED} SELECT o.rid AS research_id, count(*) + 1 AS n, min(id) AS least, max(id) AS most FROM o JOIN research USING (rid) WHERE type <> 'report' GROUP BY o.rid
    UNION ALL SELECT rid, 1, NULL, NULL FROM research WHERE rid NOT IN (SELECT rid FROM o WHERE type <> 'report')""")
def report_refs(t):
    """A report refers to all objects of its research; their number, and the first and last id."""
    refs = sx.report_refs(stored(sx.graph(*_sections(t)).select("research_id", "type", "id"), "stix-objects"))
    own = F.when(~F.col("ref").isin(_producer(t)), F.col("ref"))
    return refs.groupBy("research_id").agg(F.count("*").alias("n"), F.min(own).alias("least"), F.max(own).alias("most"))


def _producer(t) -> str:
    return sx.shared(t.nation).filter("type = 'identity'").first()["id"]


@query("k06_stix_faults", f"""
    WITH {NAMED} SELECT o.rid AS research_id, id, 'missing name' AS problem FROM o JOIN research USING (rid) WHERE type = 'malware' AND o.rid % 17 = 0
    UNION ALL SELECT o.rid, concat('x', id), 'bad id' FROM o JOIN research USING (rid) WHERE type = 'attack-pattern' AND o.rid % 19 = 0
    UNION ALL SELECT o.rid, o.id, concat('unresolved ', o.target_ref) FROM o JOIN research USING (rid) JOIN p ON p.rid = o.rid AND p.id = o.target_ref WHERE o.type = 'relationship' AND o.rid % 19 = 0
    UNION ALL SELECT o.rid, id, 'repeated id' FROM o JOIN research USING (rid) WHERE type = 'vulnerability' AND o.rid % 23 = 0
    UNION ALL SELECT o.rid, id, 'spec_version' FROM o JOIN research USING (rid) WHERE type = 'indicator' AND o.rid % 29 = 0""")
def stix_faults(t):
    """Planted faults of five kinds, each in some research: no name, a malformed id and what refers to the right one, a repeated id, an old version."""
    objects = sx.graph(*_sections(t))
    k = F.col("research_id")
    broken = objects.withColumn("name", F.when(~((F.col("type") == "malware") & (k % 17 == 0)), F.col("name")))
    broken = broken.withColumn("id", F.when((F.col("type") == "attack-pattern") & (k % 19 == 0), F.concat(F.lit("x"), "id")).otherwise(F.col("id")))
    broken = broken.withColumn("spec_version", F.when((F.col("type") == "indicator") & (k % 29 == 0), "2.0").otherwise(F.col("spec_version")))
    broken = broken.unionByName(broken.filter((F.col("type") == "vulnerability") & (k % 23 == 0)))
    broken = stored(broken, "stix-objects")
    return sx.problems(broken, sx.report_refs(broken))
