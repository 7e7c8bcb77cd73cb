"""Queries of joins, predicates over telemetry, graphs and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..operators import graph as gr
from ..operators import hunt as hu
from ..operators import joins as jo
from ..operators import search as se
from .registry import query

def _links(t):
    return t.links.withColumnRenamed("rid", "research_id")


def _research(t):
    return t.research.withColumn("research_id", F.col("rid"))


def _overrides(t):
    return t.supplier.select(F.concat(F.lit("domain|cdn"), (F.col("s_suppkey") % 97).cast("string"), F.lit(".update"), (F.col("s_suppkey") % 13).cast("string"), F.lit(".top")).alias("key"), F.lit("benign").alias("verdict")).dropDuplicates(["key"])


DECISIONS = """decisions AS (SELECT concat('domain|cdn', cast(p_partkey % 97 AS STRING), '.update', cast(p_partkey % 13 AS STRING), '.top') AS key, CASE WHEN p_partkey % 2 = 0 THEN 'false_positive' END AS verdict, p_partkey % 5 = 0 AS excluded FROM part),
    overrides AS (SELECT DISTINCT concat('domain|cdn', cast(s_suppkey % 97 AS STRING), '.update', cast(s_suppkey % 13 AS STRING), '.top') AS key, 'benign' AS verdict FROM supplier),
    iocs AS (SELECT DISTINCT concat(ioc_type, '|', lower(ioc_value)) AS key, CASE WHEN rid % 3 = 0 THEN 'malicious' ELSE 'expired' END AS pipeline_verdict FROM mentions)"""


def _pipeline(t):
    return t.mentions.select(ind.key_of(F.col("ioc_type"), F.col("ioc_value")).alias("key"), F.when(F.col("rid") % 3 == 0, "malicious").otherwise("expired").alias("pipeline_verdict")).distinct()


@query("j01_provenance", """
    SELECT l.entity_key, l.rid AS research_id, m.source_id, s.publisher, (min((m.pos, m.quote)))[2] AS quote FROM (SELECT DISTINCT rid, entity_key FROM links WHERE entity_type = 'actor') l
    JOIN mentions m ON m.rid = l.rid AND m.actor = l.entity_key JOIN sources s ON s.rid = m.rid AND s.source_id = m.source_id GROUP BY ALL""")
def provenance(t):
    sections = t.mentions.select(F.col("rid").alias("research_id"), F.col("actor").alias("entity_key"), "source_id", "pos", "quote")
    return jo.provenance(_links(t), sections, t.sources.withColumnRenamed("rid", "research_id"), entity_type="actor")


@query("g24_provenance_summary", """
    WITH items AS (SELECT DISTINCT actor AS entity_key, rid, source_id, concat('Publisher ', substring(source_id, 2, 5)) AS publisher FROM mentions),
    f AS (SELECT entity_key, publisher, min((rid, source_id)) AS a, count(*) AS n FROM items GROUP BY ALL)
    SELECT entity_key, sum(n) AS source_count, list(publisher ORDER BY a, publisher) AS publishers FROM f GROUP BY entity_key""")
def provenance_summary(t):
    return jo.provenance_summary(provenance(t))


@query("j02_quotes", """
    SELECT source_id, name, coalesce(min(CASE WHEN quote LIKE concat('%', name, '%') THEN (rid % 2, rid, quote) END)[3], '') AS quote
    FROM (SELECT DISTINCT source_id, name FROM (SELECT DISTINCT concat('mal', cast(l_partkey % 90 AS STRING)) AS name FROM lineitem) CROSS JOIN (SELECT DISTINCT source_id FROM sources)) w LEFT JOIN mentions m USING (source_id) GROUP BY ALL""")
def quotes(t):
    names = t.lineitem.select(F.concat(F.lit("mal"), (F.col("l_partkey") % 90).cast("string")).alias("name")).distinct()
    wanted = t.sources.select("source_id").distinct().join(names, F.lit(True))
    rows = t.mentions.select("source_id", F.col("rid").alias("pos"), "quote")
    return jo.first_quote(wanted, rows.filter("pos % 2 = 0").withColumnRenamed("quote", "statement"), rows.filter("pos % 2 = 1"))


@query("j04_seen_in", """
    SELECT entity_key, list(research_id ORDER BY created_at DESC, research_id DESC) AS research FROM (SELECT DISTINCT entity_key, r.research_id, r.created_at FROM links l JOIN research r USING (rid) WHERE entity_type = 'malware' AND status <> 'archived') GROUP BY entity_key""")
def seen_in(t):
    return jo.seen_in(t.links, t.research, entity_type="malware", key="rid")


KEYS = "k AS (SELECT DISTINCT rid AS id, cve AS key FROM mentions UNION SELECT DISTINCT rid, lower(actor) FROM mentions)"


def _keys(t):
    m = t.mentions.withColumnRenamed("rid", "research_id")
    return m.select("research_id", F.col("cve").alias("key")).union(m.select("research_id", F.lower("actor")))


@query("j05_related", f"""
    WITH {KEYS} SELECT key, id, min(id) OVER (PARTITION BY key) AS class, count(*) OVER (PARTITION BY key) AS n FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1""")
def related(t):
    return jo.related(_keys(t))


@query("j06_duplicates", """
    WITH live AS (SELECT rid FROM research WHERE status <> 'archived'),
    m AS (SELECT doc_id, rid, 0 AS k, concat('covers CVE-2024-0', cast(1000 + doc_id % 211 AS STRING)) AS why FROM reports JOIN live ON rid % 211 = doc_id % 211
      UNION ALL SELECT doc_id, rid, 1, concat('covers Apt', cast(doc_id % 40 + 1 AS STRING)) FROM reports JOIN live ON rid % 40 = doc_id % 40
      UNION ALL SELECT DISTINCT a.doc_id, b.doc_id, 2, 'uses the same source URL' FROM reports a JOIN reports b USING (url) JOIN live ON rid = b.doc_id)
    SELECT * FROM (SELECT doc_id AS seed_id, rid AS research_id, string_agg(why, '; ' ORDER BY k) AS reasons FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY research_id) <= 5""")
def duplicates(t):
    r = t.research.select(F.col("rid").alias("research_id"), "status")
    cves = r.select("research_id", F.concat(F.lit("CVE-2024-0"), (1000 + F.col("research_id") % 211).cast("string")).alias("cve"))
    names = r.select("research_id", F.concat(F.lit("APT"), (F.col("research_id") % 40 + 1).cast("string")).alias("name"))
    urls = t.reports.select(F.col("doc_id").alias("research_id"), "url")
    return jo.duplicates_of(t.reports.select(F.col("doc_id").alias("seed_id"), "text", F.array("url").alias("urls")), r, cves, names, urls)


@query("j07_applicability", """
    WITH owned AS (SELECT workspace_id, pos, lower(product) AS wp, trim(regexp_replace(lower(product), '\\b(server|on-prem|on-premises|\\d{4}|se|subscription edition)\\b', '', 'g')) AS core FROM products),
    affected AS (SELECT DISTINCT rid AS research_id, lower(p_name) AS p FROM mentions JOIN part ON p_partkey = partkey),
    hit AS (SELECT research_id, workspace_id, arg_min(wp, pos) AS wp FROM affected JOIN owned ON (core <> '' AND contains(p, core)) OR (p <> '' AND contains(wp, split_part(p, ' ', 1))) GROUP BY ALL)
    SELECT research_id, workspace_id, 'exposed' AS status, concat('runs ', wp) AS reason FROM hit JOIN (SELECT workspace_id FROM workspaces) USING (workspace_id)""")
def applicability(t):
    affected = t.mentions.join(t.part, F.col("p_partkey") == F.col("partkey")).select(F.col("rid").alias("research_id"), F.col("p_name").alias("product"))
    return jo.applicability(affected, t.products, t.workspaces)


@query("j08_coverage_gaps", """
    WITH need AS (SELECT DISTINCT rid AS ref, tactic_id AS data_source FROM mentions), have AS (SELECT DISTINCT workspace_id, concat('TA', cast(pos % 14 AS STRING)) AS data_source FROM products WHERE (pos % 25 + pos % 14) % 8 <> 0)
    SELECT workspace_id, ref, data_source FROM need CROSS JOIN workspaces ANTI JOIN have USING (workspace_id, data_source)""")
def gaps(t):
    need = t.mentions.select(F.col("rid").alias("ref"), F.lit("ttp").alias("kind"), F.col("tactic_id").alias("data_source"))
    have = t.products.filter("(pos % 25 + pos % 14) % 8 <> 0").select("workspace_id", F.concat(F.lit("TA"), (F.col("pos") % 14).cast("string")).alias("data_source"))
    return jo.coverage_gaps(need, t.workspaces, have).drop("kind")


@query("j09_enriched", """
    SELECT concat('CVE-2024-', cast(1000 + p_partkey AS STRING)) AS cve, CASE WHEN p_partkey % 2 = 0 THEN 9.0 ELSE 1.0 END AS cvss, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE 'old' END AS description,
      CASE WHEN p_partkey % 6 = 1 THEN ['known'] WHEN p_partkey % 2 = 0 THEN [p_name] END AS products, CASE WHEN p_partkey % 3 = 0 THEN '2024-02-02' END AS kev_added, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS epss,
      CASE WHEN p_partkey % 2 = 1 THEN 'unchecked' WHEN p_partkey % 5 = 0 THEN 'not_found' WHEN p_partkey % 8 = 2 THEN 'rejected' ELSE 'verified' END AS validation FROM part""")
def enriched(t):
    k = F.col("p_partkey")
    p = t.part.withColumn("cve", F.concat(F.lit("CVE-2024-"), (1000 + k).cast("string")))
    vulns = p.select(F.lower("cve").alias("cve"), F.lit(1.0).alias("cvss"), F.lit("old").alias("description"), F.when(k % 6 == 1, F.array(F.lit("known"))).otherwise(F.array().cast("array<string>")).alias("products"), F.lit("x").alias("kev_added"))
    state, text = F.when(k % 8 == 2, "Rejected").otherwise("Analyzed"), F.when(k % 4 == 0, F.col("p_type")).otherwise("")
    nvd = p.filter("p_partkey % 2 = 0").select("cve", (k % 5 != 0).alias("exists"), state.alias("state"), F.lit(9.0).alias("score"), text.alias("description"), F.array("p_name").alias("products"))
    kev = p.filter("p_partkey % 3 = 0").select("cve", F.lit("2024-02-02").alias("date_added"))
    return jo.enriched(vulns, nvd, kev, p.filter("p_partkey % 7 <> 0").select("cve", F.col("p_retailprice").alias("epss")))


@query("j10_cached_reputation", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'missing' WHEN p_partkey % 48 < 24 THEN 'cache' ELSE 'stale' END AS state FROM part""")
def cached(t):
    at = F.lit("2024-03-03 00:00:00").cast("timestamp_ntz")
    cache = t.part.filter("p_partkey % 3 <> 0").select("p_partkey", (at - F.make_dt_interval(F.lit(0), (F.col("p_partkey") % 48).cast("int"))).alias("fetched_at"))
    return jo.cached(t.part.select("p_partkey"), cache, at, keys=["p_partkey"]).select("p_partkey", "state")


@query("t06_lookups", """
    SELECT ioc_type AS type, lower(ioc_value) AS value FROM mentions GROUP BY ALL ORDER BY count(DISTINCT source_id) DESC, type, value LIMIT 150""")
def lookups(t):
    merged = t.mentions.groupBy(F.col("ioc_type").alias("type"), F.lower("ioc_value").alias("value")).agg(F.count_distinct("source_id").alias("n_sources")).withColumn("state", F.lit("missing"))
    return jo.lookups(merged, most=150).select("type", "value")


@query("j11_reviewed", f"""
    WITH {DECISIONS} SELECT i.key, pipeline_verdict, coalesce(d.verdict, o.verdict, pipeline_verdict) AS verdict, CASE WHEN d.verdict IS NOT NULL THEN 'analyst' WHEN o.verdict IS NOT NULL THEN 'library' ELSE 'pipeline' END AS verdict_source,
      coalesce(d.excluded, FALSE) AS excluded, coalesce(d.excluded, FALSE) OR coalesce(d.verdict, o.verdict, pipeline_verdict) IN ('benign', 'false_positive', 'expired') AS hidden_from_hunts
    FROM iocs i LEFT JOIN (SELECT DISTINCT ON (key) * FROM decisions ORDER BY key, verdict NULLS LAST, excluded) d USING (key) LEFT JOIN overrides o USING (key)""")
def reviewed(t):
    d = _decisions_sorted(t)
    return jo.reviewed(_pipeline(t), d, _overrides(t))


def _decisions_sorted(t):
    rows = t.part.select(F.concat(F.lit("domain|cdn"), (F.col("p_partkey") % 97).cast("string"), F.lit(".update"), (F.col("p_partkey") % 13).cast("string"), F.lit(".top")).alias("key"), F.when(F.col("p_partkey") % 2 == 0, "false_positive").alias("verdict"), (F.col("p_partkey") % 5 == 0).alias("excluded"))
    return rows.groupBy("key").agg(F.min(F.struct(F.coalesce("verdict", F.lit("~")).alias("o"), "excluded", "verdict")).alias("x")).select("key", "x.verdict", "x.excluded")


@query("j13_hidden_keys", f"""
    WITH {DECISIONS}, d1 AS (SELECT DISTINCT ON (key) * FROM decisions ORDER BY key, verdict NULLS LAST, excluded), i1 AS (SELECT key, min(pipeline_verdict) AS v FROM iocs GROUP BY key)
    SELECT key FROM d1 FULL JOIN overrides o USING (key) FULL JOIN i1 USING (key) WHERE coalesce(excluded, FALSE) OR coalesce(d1.verdict, o.verdict, v) IN ('benign', 'false_positive', 'expired')""")
def hidden_keys(t):
    return jo.hidden_keys(_decisions_sorted(t), _overrides(t), _pipeline(t).groupBy("key").agg(F.min("pipeline_verdict").alias("verdict")))


@query("j14_tools_of_actors", """
    SELECT a.entity_key AS left_key, b.entity_key AS right_key, count(*) AS n FROM (SELECT DISTINCT rid, entity_key FROM links WHERE entity_type = 'actor') a JOIN (SELECT DISTINCT rid, entity_key FROM links WHERE entity_type = 'malware') b USING (rid) GROUP BY ALL""")
def tools(t):
    return jo.co_named(_links(t), left="actor", right="malware")


@query("j16_cited_sources", """
    SELECT p_partkey AS opportunity_id, CASE WHEN p_partkey % 2 = 0 THEN [concat('S', cast(p_partkey % 9 AS STRING))] ELSE coalesce(s, []) END AS source_ids
    FROM part LEFT JOIN (SELECT technique_id, list(source_id ORDER BY cast(substring(source_id, 2) AS INT)) AS s FROM (SELECT DISTINCT technique_id, source_id FROM mentions) GROUP BY 1) ON technique_id = concat('T', cast(1000 + p_size AS STRING))""")
def cited(t):
    opps = t.part.select(F.col("p_partkey").alias("opportunity_id"), F.col("p_partkey").cast("string").alias("behaviour_ref"), F.array(F.concat(F.lit("T"), (1000 + F.col("p_size")).cast("string"))).alias("techniques"))
    steps = t.part.select(F.col("p_partkey").cast("string").alias("ref"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("S"), (F.col("p_partkey") % 9).cast("string")))).otherwise(F.array().cast("array<string>")).alias("source_ids"))
    mitre = t.mentions.groupBy("technique_id").agg(F.collect_set("source_id").alias("source_ids"))
    return jo.cited_sources(opps, steps, mitre)


@query("j19_stix_relations", """
    WITH n AS (SELECT DISTINCT rid, 'malware' AS type, malware AS name FROM mentions UNION SELECT DISTINCT rid, 'actor', actor FROM mentions),
    r AS (SELECT i.rid, i.pos, n.name, CASE WHEN type = 'malware' AND contains(quote, name) THEN 0 WHEN type = 'actor' AND contains(quote, name) THEN 1 WHEN type = 'actor' THEN 2 END AS k FROM mentions i JOIN n USING (rid))
    SELECT DISTINCT concat(cast(rid AS STRING), '/', cast(pos AS STRING)) AS src, name AS dst FROM r QUALIFY k IS NOT NULL AND k = min(k) OVER (PARTITION BY rid, pos)""")
def relations(t):
    m = t.mentions
    named = m.select("rid", F.lit("malware").alias("type"), F.col("malware").alias("name")).union(m.select("rid", F.lit("actor"), "actor"))
    inds = m.select(F.col("rid").alias("research_id"), F.concat_ws("/", F.col("rid").cast("string"), F.col("pos").cast("string")).alias("indicator_id"), F.col("quote").alias("text"))
    return jo.stix_relations(named.select(F.col("rid").alias("research_id"), "type", "name", F.col("name").alias("entity_id")), inds).select("src", "dst")


@query("j21_exposure", "SELECT cve, malware AS software, count(DISTINCT source_id) AS devices, list_slice(list(DISTINCT source_id ORDER BY source_id), 1, 50) AS examples FROM mentions WHERE cve IN (SELECT concat('CVE-2024-', cast(1000 + s_suppkey AS STRING)) FROM supplier) GROUP BY ALL")
def exposure(t):
    cves = t.supplier.select(F.concat(F.lit("CVE-2024-"), (1000 + F.col("s_suppkey")).cast("string")).alias("cve"))
    return hu.exposure(t.mentions.select("cve", F.col("malware").alias("software"), F.col("source_id").alias("device")), cves)


@query("j22_lineage_edges", "SELECT source_id AS src, technique_id AS dst, bool_and(rid % 2 = 1) AS inferred FROM mentions GROUP BY ALL")
def edges(t):
    e = t.mentions.select(F.col("source_id").alias("src"), F.col("technique_id").alias("dst"), "rid")
    return jo.lineage_edges(e.filter("rid % 2 = 0"), e.filter("rid % 2 = 1"))


@query("j23_covering_steps")
def covering(t):
    c = t.comments.withColumnsRenamed({"thread_id": "research_id"})
    return jo.covering_step(c.select("research_id", F.col("comment_id").alias("ioa_id"), F.col("text").alias("description")), c.filter("pos % 2 = 0").select("research_id", F.col("comment_id").alias("ref"), "pos", F.col("text").alias("behaviour")))


@query("j24_ungrounded", """
    SELECT rid AS research_id, pos AS item, CASE WHEN pos = 1 THEN 'missing_source' ELSE 'unknown_source' END AS kind FROM (SELECT DISTINCT rid, pos FROM mentions WHERE pos IN (1, 2))""")
def ungrounded(t):
    items = t.mentions.select("rid", "pos").distinct().select(F.col("rid").alias("research_id"), F.lit("claims").alias("section"), F.col("pos").alias("item"), F.when(F.col("pos") == 1, F.array(F.lit(""))).when(F.col("pos") == 2, F.array(F.lit("S99"))).otherwise(F.array().cast("array<string>")).alias("source_ids"))
    real = t.mentions.filter("pos > 2").groupBy(F.col("rid").alias("research_id"), F.col("pos").alias("item")).agg(F.collect_set("source_id").alias("source_ids")).select("research_id", F.lit("claims").alias("section"), "item", "source_ids")
    return jo.ungrounded(items.filter("item <= 2").unionByName(real), t.sources.withColumnRenamed("rid", "research_id")).select("research_id", "item", "kind")


@query("j25_quotes_found", """
    SELECT doc_id AS quote_id, doc_id % 3 <> 2 AS found FROM documents""")
def found_quotes(t):
    plain = _plain(F.col("text"))
    # From the middle of a text: up to 150 characters that follow its first third.
    part = F.substring(plain, (F.length(plain) / 3).cast("int") + 1, F.lit(150))
    q = F.when(F.col("doc_id") % 3 == 0, F.upper(part)).when(F.col("doc_id") % 3 == 1, "").otherwise("zq xz qz zx qq xx zzq qqz")
    return jo.quotes_found(t.documents.select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("source_id"), q.alias("quote")), t.documents.select(F.col("doc_id").alias("source_id"), "text"))


def _plain(c):
    from ..functions.text import comparable

    return comparable(c)


@query("j26_routing", """
    SELECT c_custkey AS mail_id, CASE c_custkey % 3 WHEN 0 THEN 'wsT' WHEN 1 THEN 'wsD' ELSE 'wsO' END AS workspace_id FROM customer""")
def routing(t):
    k = F.col("c_custkey")
    mails = t.customer.select(k.alias("mail_id"), F.when(k % 3 == 0, F.array(F.lit("in+Ops@x.org"))).otherwise(F.array(F.lit("in@x.org"))).alias("recipients"), F.when(k % 3 <= 1, "a@mail.deep.acme.org").otherwise("b@nowhere.net").alias("sender"), F.when(k % 3 == 2, "c@sub.other.org").otherwise("d@x").alias("original_sender"))
    one = t.nation.limit(1)
    tags = one.select(F.lit("ops").alias("tag"), F.lit("wsT").alias("workspace_id"))
    domains = one.select(F.explode(F.array(F.struct(F.lit("acme.org").alias("domain"), F.lit("wsD").alias("workspace_id")), F.struct(F.lit("other.org").alias("domain"), F.lit("wsO").alias("workspace_id")))).alias("x")).select("x.*")
    return jo.routed(mails, tags, domains).select("mail_id", "workspace_id")


@query("j27_unseen", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unseen(t):
    return jo.unseen(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("j29_latest_verdicts", "SELECT concat(ioc_type, '|', lower(ioc_value)) AS key, arg_max(flag, (seen_at, rid, pos)) AS verdict FROM mentions GROUP BY 1")
def latest(t):
    return jo.latest_verdict(t.mentions.select(ind.key_of(F.col("ioc_type"), F.col("ioc_value")).alias("key"), F.col("flag").alias("verdict"), F.col("seen_at").alias("updated_at"), F.struct("rid", "pos").alias("research_id")))


@query("j33_source_states", """
    SELECT c_custkey AS source_id, CASE WHEN c_custkey % 7 = 0 THEN 'excluded' WHEN c_custkey % 3 = 0 THEN 'read' WHEN c_custkey % 3 = 1 THEN 'failed' ELSE 'pending' END AS state FROM customer""")
def source_states(t):
    c = t.customer.select(F.col("c_custkey").alias("source_id"))
    return jo.source_states(c, c.filter("source_id % 3 < 2").withColumn("ok", F.col("source_id") % 3 == 0), c.filter("source_id % 7 = 0"))


@query("j34_notified", """
    WITH told AS (SELECT comment_id, concat('user', cast(thread_id % 60 + 1 AS STRING)) AS user_id, 0 AS k FROM comments UNION ALL
      SELECT a.comment_id, b.author, 1 FROM comments a JOIN comments b ON a.thread_id = b.thread_id AND b.pos < a.pos)
    SELECT comment_id, user_id, CASE WHEN min(k) = 0 THEN 'mention' ELSE 'reply' END AS kind FROM told JOIN comments USING (comment_id) WHERE user_id <> author GROUP BY comment_id, user_id""")
def notified(t):
    from ..operators.extract import mentions

    return jo.notified(t.comments, mentions(t.comments, t.users, id_col="comment_id", text_col="text"))


SPECS = [
    {"spec_id": "shell", "category": "process_creation", "conditions": [{"field": "image", "op": "endswith", "values": ["\\CMD.exe", "\\powershell.exe"]}, {"field": "command_line", "op": "contains", "values": ["-enc"]}]},
    {"spec_id": "web", "category": "web", "conditions": [{"field": "url_path", "op": "startswith", "values": ["/Layouts/1", "/layouts/2"]}]},
    {"spec_id": "absent", "category": "web", "conditions": [{"field": "no_such_field", "op": "equals", "values": ["x"]}]},
]


@query("f10_detections", """
    SELECT event_id, 'shell' AS spec_id FROM telemetry WHERE category = 'process_creation' AND event_id % 4 IN (0, 1) AND event_id % 3 = 0 UNION ALL SELECT event_id, 'web' FROM telemetry WHERE category = 'web' AND user_id % 9 IN (1, 2)""")
def detections(t):
    return hu.matches(t.telemetry, SPECS).select("event_id", "spec_id")


@query("j20_retro_hunt", """
    SELECT DISTINCT event_id, type AS ioc_type, value AS ioc_value FROM (SELECT event_id, 'ipv4' AS type, dst_ip AS value FROM telemetry UNION ALL SELECT event_id, 'domain', lower(domain) FROM telemetry UNION ALL SELECT event_id, 'sha256', sha256 FROM telemetry)
    WHERE (type, value) IN (SELECT (ioc_type, lower(ioc_value)) FROM mentions WHERE rid % 3 <> 0)""")
def retro_hunt(t):
    iocs = t.mentions.select(F.col("ioc_type").alias("type"), F.col("ioc_value").alias("value"), (F.col("rid") % 3 == 0).alias("hidden_from_hunts"))
    return hu.hunted(t.telemetry, iocs, F.lit("2000-01-01").cast("timestamp_ntz")).select("event_id", "ioc_type", "ioc_value")


@query("p38_neutral_fields", "SELECT event_id, command_line, image FROM telemetry WHERE category = 'process_creation'")
def neutral(t):
    vendor = t.telemetry.filter("category = 'process_creation'").select("event_id", F.col("command_line").alias("ProcessCommandLine"), F.col("image").alias("MyImage"))
    return hu.neutral(vendor, {"command_line": "ProcessCommandLine", "image": "FileName"}, {"MyImage": "image"})


@query("g29_hunt_rollup", """
    SELECT host, image, count(*) AS n, epoch(min(ts)) AS first_s, epoch(max(ts)) AS last_s, count(DISTINCT command_line) AS lines, list_slice(list(DISTINCT command_line ORDER BY command_line), 1, 50) AS command_lines FROM telemetry WHERE category = 'process_creation' AND event_id % 4 IN (0, 1) AND event_id % 3 = 0 GROUP BY ALL""")
def rollup(t):
    from ..operators.aggregates import hunt_rollup

    rows = hunt_rollup(hu.matches(t.telemetry, SPECS[:1]), ["host", "image"])
    s = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6)
    return rows.select("host", "image", "n", s("first_ts").alias("first_s"), s("last_ts").alias("last_s"), F.col("n_lines").alias("lines"), "command_lines")


def _articles(t):
    none = F.array().cast("array<string>")
    k = F.col("doc_id")
    return t.reports.select(
        k.alias("article_id"), F.concat("title", k.cast("string")).alias("title"), "publisher", "reliability", "published",
        F.when(k % 3 == 0, F.array(F.concat(F.lit("CVE-"), (k % 211).cast("string")))).otherwise(none).alias("cves"),
        F.when(k % 5 == 0, F.array(F.concat(F.lit("Actor"), (k % 130).cast("string")))).otherwise(none).alias("actors"), none.alias("malware"),
    )


CLUSTERS = """WITH RECURSIVE k AS (SELECT doc_id AS id, concat('cve:', cast(doc_id % 211 AS STRING)) AS key FROM reports WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, concat('actor:', cast(doc_id % 130 AS STRING)) FROM reports WHERE doc_id % 5 = 0
      UNION ALL SELECT doc_id, concat('title:', substring(trim(regexp_replace(lower(concat(title, cast(doc_id AS STRING))), '[^a-z0-9]+', ' ', 'g')), 1, 80)) FROM reports WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0),
    e AS (SELECT DISTINCT a.id, b.id AS other FROM k a JOIN k b USING (key)), c AS (SELECT id, id AS seen FROM k UNION SELECT c.id, e.other FROM c JOIN e ON c.seen = e.id)"""


@query("c01_clusters", f"{CLUSTERS} SELECT id AS article_id, min(seen) AS cluster_id FROM c GROUP BY id")
def clusters(t):
    return gr.clusters(gr.article_keys(_articles(t)))


@query("g18_ranked_clusters", f"""{CLUSTERS}, m AS (SELECT id, min(seen) AS cluster_id FROM c GROUP BY id)
    SELECT cluster_id, count(*) AS n_articles, 3 * count(DISTINCT publisher) + CASE WHEN bool_or(doc_id % 3 = 0) THEN 2 ELSE 0 END + CASE WHEN bool_or(reliability = 'A') THEN 2 ELSE 0 END + CASE WHEN bool_or(doc_id % 5 = 0) THEN 1 ELSE 0 END
      + CASE WHEN max(published) >= TIMESTAMP '2024-02-08 12:00:00' THEN 1 ELSE 0 END AS score FROM reports JOIN m ON id = doc_id GROUP BY cluster_id""")
def ranked_clusters(t):
    a = _articles(t)
    return gr.ranked_clusters(a, gr.clusters(gr.article_keys(a)), F.lit("2024-02-09 00:00:00").cast("timestamp_ntz")).select("cluster_id", "n_articles", "score")


@query("u04_picked", f"""{CLUSTERS}, m AS (SELECT id, min(seen) AS cluster_id FROM c GROUP BY id), s AS (SELECT cluster_id, 3 * count(DISTINCT publisher) + CASE WHEN bool_or(doc_id % 3 = 0) THEN 2 ELSE 0 END + CASE WHEN bool_or(reliability = 'A') THEN 2 ELSE 0 END
      + CASE WHEN bool_or(doc_id % 5 = 0) THEN 1 ELSE 0 END + CASE WHEN max(published) >= TIMESTAMP '2024-02-08 12:00:00' THEN 1 ELSE 0 END AS score, max(published) AS newest FROM reports JOIN m ON id = doc_id GROUP BY cluster_id)
    SELECT cluster_id, score FROM s WHERE cluster_id NOT IN (SELECT cluster_id FROM k JOIN m USING (id) WHERE key IN ('actor:5', 'actor:10', 'cve:3')) ORDER BY score DESC, newest DESC, cluster_id LIMIT 10""")
def picked(t):
    a = _articles(t)
    keys = gr.article_keys(a)
    members = gr.clusters(keys)
    at = F.lit("2024-02-09 00:00:00").cast("timestamp_ntz")
    seen = t.nation.limit(1).select(F.explode(F.array(F.lit("actor:actor5"), F.lit("actor:actor10"), F.lit("cve:CVE-3"))).alias("key"), at.alias("at"))
    return gr.picked(gr.ranked_clusters(a, members, at), members, keys, seen, F.lit("2024-02-02 00:00:00").cast("timestamp_ntz"), 10).select("cluster_id", "score")


@query("c02_lineage", """
    WITH RECURSIVE e AS (SELECT DISTINCT source_id AS src, technique_id AS dst FROM mentions UNION SELECT DISTINCT technique_id, tactic_id FROM mentions),
    d AS (SELECT src AS start, dst AS node FROM e WHERE src IN ('S1', 'T1003', 'TA3') UNION SELECT d.start, e.dst FROM d JOIN e ON e.src = d.node),
    u AS (SELECT dst AS start, src AS node FROM e WHERE dst IN ('S1', 'T1003', 'TA3') UNION SELECT u.start, e.src FROM u JOIN e ON e.dst = u.node)
    SELECT start, node, 'down' AS direction FROM d UNION ALL SELECT start, node, 'up' FROM u""")
def lineage(t):
    m = t.mentions
    e = m.select(F.col("source_id").alias("src"), F.col("technique_id").alias("dst")).union(m.select("technique_id", "tactic_id")).distinct()
    starts = t.nation.limit(1).select(F.explode(F.array(*map(F.lit, ("S1", "T1003", "TA3")))).alias("node"))
    return gr.lineage(e, starts)


@query("c03_folded", """
    WITH e AS (SELECT DISTINCT source_id AS src, technique_id AS dst FROM mentions), n AS (SELECT 0 AS col, src AS node, count(*) AS outs, 0 AS ins FROM e GROUP BY src UNION ALL SELECT 1, dst, 0, count(*) FROM e GROUP BY dst)
    SELECT node, outs, ins, count(*) OVER (PARTITION BY col) <= 12 OR row_number() OVER (PARTITION BY col ORDER BY outs > 0 DESC, outs DESC, ins DESC, node) <= 10 AS shown FROM n""")
def folded(t):
    e = t.mentions.select(F.col("source_id").alias("src"), F.col("technique_id").alias("dst")).distinct()
    nodes = e.select(F.lit(0).alias("column"), F.col("src").alias("node")).union(e.select(F.lit(1), "dst")).distinct()
    return gr.folded(e, nodes).select("node", "outs", "ins", "shown")


@query("c04_same_technique", "SELECT rid, pos, CASE partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE ELSE FALSE END AS same FROM mentions")
def same(t):
    k, own = F.col("partkey") % 4, F.col("technique_id")
    other = F.when(k == 0, own).when(k == 1, F.concat(own, F.lit(".002"))).when(k == 2, "T9999").otherwise(F.concat(own, F.lit("9")))
    return t.mentions.select("rid", "pos", gr.same_technique(F.when(k == 1, own).otherwise(F.concat(own, F.lit(".001"))), other).alias("same"))


@query("x01_search", """
    SELECT research_id, title, status FROM research WHERE status <> 'archived' AND (contains(lower(research_id), 'cve-2024-1005') OR contains(search_text, 'cve-2024-1005')) ORDER BY updated_at DESC, research_id LIMIT 6""")
def search(t):
    return se.research(t.research, " CVE-2024-1005 ")


@query("x01_trigram_search", "SELECT rid FROM research WHERE contains(search_text, 'actor7 1')")
def trigram(t):
    rows = t.research.select("rid", "search_text")
    return se.by_trigrams(se.trigrams(rows, "rid", "search_text"), rows, "rid", "search_text", "actor7 1").select("rid")


@query("x02_entities", """
    SELECT type, key, title FROM (SELECT 'user' AS type, user_id AS key, name AS title FROM users UNION ALL SELECT 'actor', actor_id, name FROM actors) WHERE contains(lower(title), '01') QUALIFY row_number() OVER (PARTITION BY type ORDER BY title, key) <= 5""")
def entities(t):
    rows = t.users.select(F.lit("user").alias("type"), F.col("user_id").alias("key"), F.col("name").alias("title")).unionByName(t.actors.select(F.lit("actor").alias("type"), F.col("actor_id").alias("key"), F.col("name").alias("title")))
    return se.entities(rows, "01").select("type", "key", "title")


@query("x03_jump", "SELECT DISTINCT lower(ioc_value) AS query, 'ioc' AS type FROM mentions")
def jump(t):
    typed = t.mentions.select(F.lower("ioc_value").alias("query")).distinct()
    known = t.mentions.select(F.lit("ioc").alias("type"), F.lower("ioc_value").alias("title"), F.lower("ioc_value").alias("key")).distinct()
    return se.jump(typed, known).select("query", "type")


@query("f01_listed", """
    SELECT rid FROM research WHERE status <> 'archived' AND severity IN ('high', 'critical') AND list_contains(workspace_ids, 'ws3') AND contains(search_text, 'campaign') AND cast(created_at AS DATE) >= DATE '1995-01-01'""")
def listed(t):
    return se.listed(t.research, severity=["high", "critical"], workspace="ws3", q="campaign", date_from="1995-01-01").select("rid")


@query("f04_scoped", "SELECT rid FROM research WHERE list_contains(workspace_ids, 'ws7')")
def scoped(t):
    return t.research.filter(F.array_contains("workspace_ids", "ws7")).select("rid")


@query("u06_topped_up", "SELECT n_nationkey FROM nation ORDER BY n_nationkey >= 5, n_nationkey LIMIT 12")
def topped(t):
    n = t.nation.withColumn("rank", F.col("n_nationkey"))
    return se.topped_up(n.filter("n_nationkey < 5"), n, "n_nationkey", 12).select("n_nationkey")
