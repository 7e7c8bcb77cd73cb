"""Queries of the library's filters, pages and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..operators import library as li
from ..sources import fixed, writers
from .registry import query

def _queries(t):
    return t.queries.select("*", F.col("rid").alias("research_id"), F.array("technique_id", "second_id").alias("techniques"))


@query("f02_actors", "SELECT actor_id FROM actors WHERE contains(lower(concat(name, ' ', aliases[1], ' ', aliases[2])), 'group1') AND nation % 3 = 1")
def actors(t):
    rows = t.actors.withColumns({"origin": F.concat(F.lit("Origin"), (F.col("nation") % 3).cast("string")), "motivation": F.array(F.lit("espionage")), "industries": F.array(F.lit("Retail"))})
    return li.actors(rows, q="Group1", origin="gin1", motivation="espionage", industry="Retail").select("actor_id")


@query("f02_queries", "SELECT query_id FROM queries WHERE platform = 'splunk' AND type = 'ttp' AND (technique_id = 'T1012' OR second_id = 'T1012') AND contains(lower(concat(title, ' ', body, ' ', query_id)), 'brand#')")
def queries(t):
    return li.queries(_queries(t), platform="splunk", kind="ttp", technique="t1012", q="BRAND#").select("query_id")


@query("f02_iocs", "SELECT rid, pos, ioc_value FROM mentions WHERE ioc_type = 'domain' AND flag = 'R' AND contains(lower(ioc_value), 'cdn1.update')")
def iocs(t):
    rows = t.mentions.select("rid", "pos", F.col("ioc_type").alias("type"), F.col("ioc_value").alias("value"), F.col("flag").alias("verdict"))
    return li.iocs(rows, kind="domain", verdict="R", q="CDN1[.]update").select("rid", "pos", F.col("value").alias("ioc_value"))


@query("t07_query_page", "SELECT query_id, price FROM queries WHERE origin <> 'reference' ORDER BY price DESC, query_id DESC LIMIT 25 OFFSET 25")
def query_page(t):
    return li.page(li.research_queries(_queries(t), include_reference=False), F.desc("price"), F.desc("query_id"), number=2, size=25).select("query_id", "price")


@query("t07_ioc_page", "SELECT rid, pos, ioc_value FROM mentions WHERE ioc_type = 'ipv4' ORDER BY seen_at DESC, rid DESC, pos DESC LIMIT 100")
def ioc_page(t):
    rows = t.mentions.withColumnsRenamed({"ioc_type": "type", "ioc_value": "value"})
    return li.page(li.iocs(rows, kind="ipv4"), F.desc("seen_at"), F.desc("rid"), F.desc("pos"), size=100).select("rid", "pos", F.col("value").alias("ioc_value"))


@query("f03_audit", "SELECT event_id FROM access WHERE method = 'GET' AND path = '/api/library/cves/cve-2024-1003/'")
def audit(t):
    from ..operators.extract import views

    seen = views(t.access).join(t.access.select("event_id", F.col("method").alias("action")), "event_id")
    return li.audit(seen, entity="cve:cve-2024-1003", action="GET").select("event_id")


VERDICTS = "CASE WHEN pos = 1 THEN 'benign' WHEN pos = 3 THEN 'expired' WHEN pos = 4 THEN 'false_positive' ELSE 'malicious' END"


def _rated(t):
    return t.mentions.select("rid", "pos", F.col("ioc_type").alias("type"), F.col("ioc_value").alias("value"), F.expr(VERDICTS).alias("verdict"), F.expr("case when rid % 3 = 0 then rid % 2 = 0 end").alias("excluded"), F.expr("case when rid % 5 = 0 then false end").alias("hidden_from_hunts"))


@query("f05_ioc_view", f"SELECT rid, pos FROM mentions WHERE ioc_type IN ('ipv4', 'domain') AND {VERDICTS} IN ('benign', 'expired') AND contains(lower(ioc_value), '45.1')")
def ioc_view(t):
    return li.ioc_view(_rated(t), types=["ipv4", "domain"], verdicts=["benign", "expired"], q="45[.]1").select("rid", "pos")


@query("f09_exportable", "SELECT rid, pos FROM mentions WHERE NOT (rid % 3 = 0 AND rid % 2 = 0) AND pos NOT IN (1, 4) AND (pos <> 3 OR rid % 5 = 0)")
def exportable(t):
    return li.exportable(_rated(t)).select("rid", "pos")


@query("f11_included", "SELECT rid, source_id FROM (SELECT DISTINCT concat(cast(rid AS STRING), source_id) AS k, rid, source_id FROM mentions) WHERE rid % 4 <> 0 AND rid % 7 <> 0")
def included(t):
    rows = t.sources.select("rid", F.col("source_id").alias("own"), F.concat(F.col("rid").cast("string"), "source_id").alias("source_id"))
    return li.included_sources(rows, rows.select("source_id", (F.col("rid") % 4 != 0).alias("ok")), rows.filter("rid % 7 = 0")).select("rid", F.col("own").alias("source_id"))


@query("f13_research_queries", "SELECT rid, query_id FROM queries WHERE platform = 'kql_sentinel' AND group_id = 'G2' AND origin <> 'reference'")
def research_queries(t):
    return li.research_queries(_queries(t), platform="kql_sentinel", group="G2", include_reference=False).select("rid", "query_id")


@query("j15_malware_hashes", "SELECT DISTINCT l.malware AS malware_id, h.ioc_value AS value FROM mentions l JOIN mentions h USING (rid) WHERE h.ioc_type = 'sha256' AND contains(h.quote, l.malware)")
def malware_hashes(t):
    m = t.mentions.withColumnRenamed("rid", "research_id")
    malware = m.select(F.col("malware").alias("malware_id"), F.concat("malware", F.lit(" loader")).alias("name")).distinct()
    return li.hashes_of(malware, m.select("research_id", F.col("malware").alias("malware_id")), m.select("research_id", F.col("ioc_type").alias("type"), F.col("ioc_value").alias("value"), F.col("quote").alias("context"), F.lit(None).cast("string").alias("role")))


@query("j28_summaries", """
    SELECT r.rid, coalesce(ttps, 0) AS ttps, coalesce(iocs, 0) AS iocs, coalesce(queries, 0) AS queries, coalesce(sources, 0) AS sources, coalesce(results, []) AS results FROM research r
    LEFT JOIN (SELECT rid, count(DISTINCT technique_id) AS ttps, count(DISTINCT (ioc_type, ioc_value)) AS iocs, count(DISTINCT source_id) AS sources FROM mentions GROUP BY rid) USING (rid)
    LEFT JOIN (SELECT rid, count(*) AS queries FROM queries WHERE origin <> 'reference' GROUP BY rid) USING (rid)
    LEFT JOIN (SELECT rid, list(DISTINCT concat(workspace_id, ':', status) ORDER BY concat(workspace_id, ':', status)) AS results FROM results GROUP BY rid) USING (rid)""")
def summaries(t):
    named = t.mentions.select(F.col("rid").alias("research_id"), "technique_id", F.struct("ioc_type", "ioc_value").alias("ioc"), "source_id")
    out = li.summaries(t.research.select(F.col("rid").alias("research_id")), named, _queries(t), t.results.withColumnRenamed("rid", "research_id"))
    return out.withColumnRenamed("research_id", "rid")


@query("j30_required_logs", """
    SELECT DISTINCT rid AS research_id, tactic_id AS data_source, coalesce(label, tactic_id) AS label FROM mentions LEFT JOIN (SELECT concat('TA', cast(n_nationkey AS STRING)) AS k, n_name AS label FROM nation WHERE n_nationkey % 2 = 0) ON k = tactic_id""")
def required_logs(t):
    labels = t.nation.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("TA"), F.col("n_nationkey").cast("string")).alias("data_source"), F.col("n_name").alias("label"))
    return li.required_logs(t.mentions.select(F.col("rid").alias("research_id"), F.array("tactic_id", "tactic_id").alias("data_sources")), labels)


@query("j31_siblings", """
    WITH k AS (SELECT qid, query_id, CASE WHEN group_id IS NOT NULL THEN concat('g/', cast(rid AS STRING), '/', group_id) ELSE concat('s/', coalesce(sigma_ref, CASE WHEN platform = 'sigma' THEN query_id END)) END AS k, group_id, sigma_ref, platform FROM queries)
    SELECT a.query_id, b.query_id AS sibling_id FROM k a JOIN k b USING (k) WHERE a.qid % 50 = 0 AND a.query_id <> b.query_id AND (a.group_id IS NOT NULL OR a.sigma_ref IS NOT NULL OR a.platform = 'sigma')""")
def siblings(t):
    # A search: the wanted ones are every fiftieth, against all.
    rows = _queries(t)
    return li.siblings(rows.filter("qid % 50 = 0"), rows)


@query("e10_vendor_queries", """
    SELECT rid AS research_id, CASE WHEN platform IN ('sigma', 'splunk') THEN platform WHEN contains(lower(platform), 'kql') THEN 'kql_defender' ELSE platform END AS platform, body, row_number() OVER (PARTITION BY rid ORDER BY qid) AS number
    FROM (SELECT * FROM queries QUALIFY row_number() OVER (PARTITION BY rid, lower(trim(regexp_replace(body, '\\s+', ' ', 'g'))) ORDER BY qid) = 1)""")
def vendor_queries(t):
    return li.vendor_queries(_queries(t).select("research_id", F.col("qid").alias("pos"), "platform", "body"), ("sigma", "splunk"))


@query("k02_query_csv", """
    SELECT rid AS research_id, query_id, coalesce(group_id, '') AS group_id, type, platform, title, status, concat(technique_id, ' ', second_id) AS techniques, body FROM queries""")
def query_csv(t):
    none, gap = F.array().cast("array<string>"), F.lit(None).cast("string")
    rows = _queries(t).select("*", F.lit("generated").alias("provenance"), none.alias("source_ids"), none.alias("log_sources"), gap.alias("fp_notes"), gap.alias("workspace_mapping"), none.alias("lint"))
    back = writers.csv_round_trip(li.csv_rows(rows))
    return back.select("research_id", "query_id", F.coalesce("group_id", F.lit("")).alias("group_id"), "type", "platform", "title", "status", "techniques", "body")


@query("r03_verdicts", """
    SELECT rid, pos, CASE WHEN pos = 1 OR rid % 11 = 0 THEN 'benign' WHEN ioc_type <> 'sha256' AND seen_at + to_days(CASE ioc_type WHEN 'ipv4' THEN 90 ELSE 180 END) <= TIMESTAMP '1996-06-01' THEN 'expired'
      WHEN pos % 4 >= 2 OR (state = 'O' AND flag <> 'N') THEN 'malicious' WHEN pos % 4 = 1 OR state = 'O' THEN 'suspicious' ELSE 'unknown' END AS verdict FROM mentions""")
def verdicts(t):
    m = t.mentions
    reliability = F.when(F.col("flag") == "N", "C").when(F.col("flag") == "A", "A").otherwise("B")
    v = ind.verdict(F.col("ioc_type"), F.col("pos") % 4, F.col("rid") % 11 == 0, F.col("pos") == 1, F.col("state") == "O", reliability, F.col("seen_at"), F.lit("1996-06-01").cast("timestamp_ntz"))
    return m.select("rid", "pos", v.alias("verdict"))


@query("r04_provider_flags", """
    SELECT rid, pos, CASE pos % 6 WHEN 0 THEN partkey % 6 >= 3 WHEN 1 THEN partkey % 100 >= 50 WHEN 2 THEN partkey % 6 >= 3 WHEN 3 THEN partkey % 6 >= 1 WHEN 4 THEN partkey % 6 >= 1 ELSE flag = 'R' END AS flagged, pos % 6 = 5 AND (flag = 'A' OR suppkey % 9 = 0) AS benign FROM mentions""")
def provider_flags(t):
    names = F.array(*map(F.lit, ("virustotal", "abuseipdb", "otx", "urlscan", "abusech", "greynoise")))
    provider = F.get(names, (F.col("pos") % 6).cast("int"))
    word = F.when(F.col("flag") == "R", "malicious").when(F.col("flag") == "A", "benign").otherwise("unknown")
    number = F.when(provider == "abuseipdb", F.col("partkey") % 100).otherwise(F.col("partkey") % 6)
    return t.mentions.select("rid", "pos", li.provider_flag(provider, number, word).alias("flagged"), li.provider_benign(provider, word, F.col("suppkey") % 9 == 0).alias("benign"))


@query("r05_verdict_inputs", """
    SELECT ioc_type AS type, lower(ioc_value) AS value, coalesce(min(CASE WHEN source_id <> 'S1' THEN CASE WHEN source_id IN ('S2', 'S3') THEN 'A' WHEN source_id = 'S4' THEN 'B' ELSE 'C' END END), 'C') AS best_reliability,
      bool_or(pos = 2) AND bool_or(source_id <> 'S1') AS named, bool_or(source_id <> 'S1') AS listed FROM mentions GROUP BY ALL""")
def verdict_inputs(t):
    found = t.mentions.select(F.col("ioc_type").alias("type"), F.lower("ioc_value").alias("value"), "source_id", F.when(F.col("pos") == 2, "seen as C2 server").alias("role"), F.lit("in a list").alias("context"))
    s = F.col("source_id")
    sources = t.sources.select(s).distinct().select(s, F.when(s.isin("S2", "S3"), "A").when(s == "S4", "B").otherwise("C").alias("reliability"), F.when(s == "S1", "seed_text").otherwise("feed").alias("origin"))
    return li.verdict_inputs(found, sources, fixed.MALICIOUS_ROLE)


@query("r07_first_seen", """
    SELECT rid, pos, strftime(CASE WHEN pos % 3 = 0 THEN NULL WHEN pos % 3 = 1 THEN least(seen_at, TIMESTAMP '1996-01-01') ELSE CASE WHEN seen_at <= TIMESTAMP '1996-01-02' THEN seen_at END END, '%Y-%m-%d') AS day FROM mentions""")
def first_seen(t):
    seen = F.date_format("seen_at", "yyyy-MM-dd")
    given = F.when(F.col("pos") % 3 == 0, F.array(F.lit("not a date"))).when(F.col("pos") % 3 == 1, F.array(seen, F.lit("1996-01-01"))).otherwise(F.array(seen))
    at = li.intel_first_seen(F.array(F.lit("2999-01-01")), given, F.lit("1996-01-01").cast("timestamp"))
    return t.mentions.select("rid", "pos", F.date_format(at, "yyyy-MM-dd").alias("day"))


@query("r08_severity", """
    WITH g AS (SELECT rid, count(DISTINCT CASE WHEN pos % 2 = 0 THEN cve END) AS n, list_distinct(list(CASE partkey % 9 WHEN 0 THEN 'T1190' WHEN 1 THEN 'T1486' ELSE technique_id END)) AS t, count(DISTINCT source_id) AS s FROM mentions GROUP BY rid)
    SELECT rid, CASE WHEN n > 0 AND list_contains(t, 'T1190') THEN 'critical' WHEN n > 0 OR list_contains(t, 'T1190') THEN 'high' ELSE 'medium' END AS severity,
      list_concat(CASE WHEN n > 0 THEN ['vulnerability_exploitation'] ELSE [] END, [CASE WHEN s > 1 THEN 'campaign' ELSE 'ttp_trend' END]) AS classification, list_contains(t, 'T1190') AS integrity, list_contains(t, 'T1486') AS availability FROM g""")
def severity(t):
    technique = F.when(F.col("partkey") % 9 == 0, "T1190").when(F.col("partkey") % 9 == 1, "T1486").otherwise(F.col("technique_id"))
    g = t.mentions.groupBy("rid").agg(F.count_distinct(F.when(F.col("pos") % 2 == 0, F.col("cve"))).alias("n"), F.collect_set(technique).alias("t"), F.count_distinct("source_id").alias("s"))
    hit = li.impact(F.col("t"))
    return g.select("rid", li.severity(F.col("n"), F.col("t")).alias("severity"), li.classification(F.col("n"), F.col("s")).alias("classification"), hit["integrity"].alias("integrity"), hit["availability"].alias("availability"))


@query("r09_advice", f"""
    SELECT comment_id, CASE WHEN regexp_matches(text, '{fixed.ADVICE_ACTION}') AND regexp_matches(text, '{fixed.ADVICE_TOLD}') THEN CASE WHEN regexp_matches(text, '{fixed.ADVICE_URGENT}') THEN 'immediate' ELSE 'short_term' END END AS horizon
    FROM (SELECT comment_id, concat(text, CASE pos % 4 WHEN 0 THEN ' You should patch it' WHEN 1 THEN ' We recommend to monitor it' WHEN 2 THEN ' They patch it' ELSE '' END) AS text FROM comments)""")
def advised(t):
    text = F.concat("text", F.when(F.col("pos") % 4 == 0, " You should patch it").when(F.col("pos") % 4 == 1, " We recommend to monitor it").when(F.col("pos") % 4 == 2, " They patch it").otherwise(""))
    return t.comments.select("comment_id", li.advice(text, fixed.ADVICE_ACTION, fixed.ADVICE_TOLD, fixed.ADVICE_URGENT).alias("horizon"))


@query("r10_unchanged", """
    SELECT qid, CASE qid % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN qid % 3 <> 0 ELSE FALSE END AS same FROM queries""")
def unchanged(t):
    k = F.col("qid")
    new = F.array(F.lower("body"), F.lower("title"))
    old = F.when(k % 4 == 0, F.array(F.lower("title"), F.lower("body"))).when(k % 4 == 1, F.array(F.lower("title")))
    bodies = F.concat("title", F.lit(" "), F.when(k % 3 == 0, "gone").otherwise(F.upper("body")))
    return _queries(t).select("qid", li.unchanged(new, old, F.when(k % 4 == 3, 3).otherwise(2), bodies).alias("same"))


@query("u07_unknown_members", "SELECT DISTINCT rid AS item, source_id FROM mentions WHERE source_id NOT IN (SELECT concat('S', cast(n_nationkey AS STRING)) FROM nation WHERE n_nationkey % 3 <> 0)")
def unknown(t):
    known = t.nation.filter("n_nationkey % 3 <> 0").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("source_id"))
    return li.unknown_members(t.mentions.select(F.col("rid").alias("item"), F.array("source_id", F.lit(None).cast("string")).alias("refs")), known, "source_id")


@query("u09_products", "SELECT rid AS research_id, list_sort(list(DISTINCT p_name)) AS products FROM mentions JOIN part ON p_partkey = partkey GROUP BY rid")
def products(t):
    rows = t.mentions.join(t.part, F.col("p_partkey") == F.col("partkey")).select(F.col("rid").alias("research_id"), F.array("p_name", F.lit(""), "p_name").alias("affected_products"))
    return li.affected_products(rows)
