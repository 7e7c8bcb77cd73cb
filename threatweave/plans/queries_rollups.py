"""Queries of roll-ups, ranking, numbering and intervals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import ranking as rk
from .registry import query

QUARTER = ag.period_bounds("quarter", dt.date(1996, 6, 20))
BEFORE = ag.previous(*QUARTER)
IN_Q = "BETWEEN TIMESTAMP '1996-04-01 00:00:00' AND TIMESTAMP '1996-06-20 23:59:59.999999'"


@query("g01_kpis", f"""
    WITH p AS (SELECT 'current' AS period, TIMESTAMP '{QUARTER[0]}' AS a, TIMESTAMP '{QUARTER[1]}' AS b UNION ALL SELECT 'previous', TIMESTAMP '{BEFORE[0]}', TIMESTAMP '{BEFORE[1]}')
    SELECT period, count(*) FILTER (created_at BETWEEN a AND b AND status NOT IN ('running', 'failed')) AS runs, count(*) FILTER (published_at BETWEEN a AND b) AS published,
      round(median(epoch(published_at - created_at) / 3600) FILTER (published_at BETWEEN a AND b), 1) AS median_hours,
      cast(coalesce(sum(n_iocs) FILTER (created_at BETWEEN a AND b AND status NOT IN ('running', 'failed')), 0) AS BIGINT) AS iocs, cast(coalesce(sum(n_queries) FILTER (created_at BETWEEN a AND b AND status NOT IN ('running', 'failed')), 0) AS BIGINT) AS queries,
      (SELECT count(*) FROM results WHERE status IN ('suspicious', 'confirmed') AND updated_at BETWEEN a AND b) AS findings
    FROM research CROSS JOIN p GROUP BY period, a, b""")
def kpis(t):
    research = t.research.withColumn("research_id", F.col("rid"))
    return ag.kpis(research, t.results.withColumnRenamed("rid", "research_id"), {"current": QUARTER, "previous": BEFORE})


@query("g02_previous_period", f"SELECT count(*) AS n FROM research WHERE created_at BETWEEN TIMESTAMP '{BEFORE[0]}' AND TIMESTAMP '{BEFORE[1]}'")
def previous(t):
    return t.research.filter(ag.within("created_at", BEFORE)).agg(F.count("*").alias("n"))


@query("g03_periods", """
    SELECT rid, date_trunc('quarter', created_at)::DATE AS quarter, (date_trunc('quarter', created_at) - INTERVAL 3 MONTH)::DATE AS last_quarter, date_trunc('week', created_at)::DATE AS week FROM research""")
def periods(t):
    q = F.date_trunc("quarter", "created_at")
    return t.research.select("rid", F.to_date(q).alias("quarter"), F.add_months(F.to_date(q), -3).alias("last_quarter"), F.to_date(F.date_trunc("week", "created_at")).alias("week"))


@query("g04_weekly", f"""
    SELECT w::DATE AS week, count(rid) AS n FROM generate_series(TIMESTAMP '1996-04-01', TIMESTAMP '1996-06-20', INTERVAL 7 DAY) g(w) LEFT JOIN research ON date_trunc('week', created_at) = w AND created_at {IN_Q} GROUP BY w""")
def weekly(t):
    return ag.weekly(t.research, "created_at", QUARTER)


@query("ss07_weekly_windows", "SELECT date_trunc('week', created_at)::DATE AS week, count(*) AS n FROM research GROUP BY 1")
def windows(t):
    return t.research.groupBy(F.window("created_at", "7 days", startTime="4 days").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("week"), "n")


@query("g05_severity_mix", "SELECT value, pos, (SELECT count(*) FROM research WHERE severity = value) AS n FROM (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('none', 4)) v(value, pos)")
def severity(t):
    return ag.domain_counts(t.research, "severity", ["critical", "high", "medium", "low", "none"])


@query("g06_heat_map", "WITH c AS (SELECT DISTINCT technique_id, tactic_id FROM mentions) SELECT tactic_id, technique_id, n FROM c JOIN (SELECT technique_id, count(DISTINCT rid) AS n FROM mentions GROUP BY 1) USING (technique_id)")
def heat(t):
    return ag.heat_map(t.mentions.withColumnRenamed("rid", "research_id"), t.mentions.groupBy("technique_id").agg(F.collect_set("tactic_id").alias("tactics")))


@query("g07_top_actors", "SELECT actor, count(*) AS n FROM mentions GROUP BY actor ORDER BY n DESC, actor LIMIT 5")
def top_actors(t):
    return ag.most_common(t.mentions, "actor", 5)


@query("g07_top_cves", "SELECT cve, count(*) AS n, arg_max(discount, (rid, pos, partkey, suppkey, discount)) AS discount FROM mentions GROUP BY cve ORDER BY n DESC, cve LIMIT 5")
def top_cves(t):
    return ag.most_common(t.mentions.withColumn("o", F.struct("rid", "pos", "partkey", "suppkey", "discount")), "cve", 5, last="discount", order="o")


@query("g08_per_workspace", """
    WITH r AS (SELECT DISTINCT rid, status, published_at, unnest(workspace_ids) AS workspace_id FROM research), a AS (SELECT workspace_id, count(*) AS runs, max((published_at, rid)) FILTER (status = 'published')[2] AS last_report FROM r GROUP BY 1),
    b AS (SELECT workspace_id, count(*) FILTER (results.status IN ('suspicious', 'confirmed')) AS findings, count(*) FILTER (results.status = 'pending') AS pending FROM results SEMI JOIN r USING (rid, workspace_id) GROUP BY 1)
    SELECT workspace_id, coalesce(runs, 0) AS runs, coalesce(findings, 0) AS findings, coalesce(pending, 0) AS pending, last_report FROM workspaces LEFT JOIN a USING (workspace_id) LEFT JOIN b USING (workspace_id)""")
def per_workspace(t):
    return ag.per_workspace(t.research.withColumn("research_id", F.col("rid")), t.results.withColumnRenamed("rid", "research_id"), t.workspaces)


@query("g09_workspace_counts", "SELECT workspace_id, count(DISTINCT rid) AS n FROM (SELECT rid, unnest(workspace_ids) AS workspace_id FROM research) GROUP BY 1")
def workspace_counts(t):
    return ag.workspace_counts(t.research.withColumn("research_id", F.col("rid")))


@query("g10_actor_techniques", "SELECT actor, technique_id, n, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY n DESC, technique_id) AS k FROM (SELECT actor, technique_id, count(*) AS n FROM (SELECT DISTINCT rid, actor, technique_id FROM mentions) GROUP BY ALL)) WHERE k <= 3")
def actor_techniques(t):
    return ag.most_common_each(t.mentions.select("rid", "actor", "technique_id").distinct(), "actor", "technique_id", 3)


@query("g11_coverage", "SELECT entity_key, cast(sum(n_queries) AS BIGINT) AS n FROM (SELECT DISTINCT rid, entity_key FROM links WHERE entity_type = 'malware') JOIN research USING (rid) GROUP BY 1")
def coverage(t):
    return t.links.filter("entity_type = 'malware'").select("rid", "entity_key").distinct().join(t.research.select("rid", "n_queries"), "rid").groupBy("entity_key").agg(F.sum("n_queries").alias("n"))


@query("g12_facets", "SELECT 'status' AS facet, status AS value, count(*) AS n FROM research GROUP BY status UNION ALL SELECT 'severity', severity, count(*) FROM research GROUP BY severity UNION ALL SELECT 'created_by', created_by, count(*) FROM research GROUP BY created_by")
def facets(t):
    return ag.facets(t.research, ["status", "severity", "created_by"])


@query("g13_tactic_rail", """
    WITH tac AS (SELECT DISTINCT tactic_id FROM mentions) SELECT rid AS research_id, tactic_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT rid FROM mentions) CROSS JOIN tac LEFT JOIN (SELECT rid, tactic_id, count(DISTINCT technique_id) AS n FROM mentions GROUP BY ALL) USING (rid, tactic_id)""")
def rail(t):
    m = t.mentions.withColumnRenamed("rid", "research_id")
    return ag.tactic_rail(m, m.select("tactic_id").distinct().withColumn("pos", F.lit(0))).drop("pos")


@query("g14_thread_counts", "SELECT section, count(*) FILTER (pos = 0) AS threads, count(*) FILTER (pos = 0 AND NOT resolved) AS open, count(*) AS comments FROM comments GROUP BY section")
def thread_counts(t):
    return ag.thread_counts(t.comments)


@query("g15_verdict_counts", "SELECT flag, state, count(*) AS n FROM mentions GROUP BY ALL")
def verdict_counts(t):
    return ag.counts_by(t.mentions, ["flag", "state"])


@query("g16_runs_by_type", """
    SELECT rid AS result_id, CASE pos % 4 WHEN 0 THEN 'ioc' WHEN 1 THEN 'ioa' WHEN 2 THEN 'ttp' ELSE 'other' END AS type, count(DISTINCT technique_id) AS n FROM mentions GROUP BY ALL""")
def runs_by_type(t):
    key = F.concat_ws("|", (F.col("pos") % 4).cast("string"), "technique_id")
    keys = t.mentions.select(key.alias("key"), (F.col("pos") % 4).alias("k")).distinct()
    of = lambda k, name: keys.filter(F.col("k") == k).select("key", F.lit(name).alias("type"))
    return ag.runs_by_type(t.mentions.select(F.col("rid").alias("result_id"), key.alias("entry")), of(0, "ioc"), of(1, "ioa"), of(2, "ttp"), ["ioc", "ioa", "ttp"])


@query("g17_levels", "SELECT 1 AS depth, count(DISTINCT tactic_id) AS n FROM mentions UNION ALL SELECT 2, count(DISTINCT technique_id) FROM mentions UNION ALL SELECT 3, count(DISTINCT source_id) FROM mentions")
def levels(t):
    m = t.mentions
    rows = m.select(F.lit(1).alias("depth"), F.col("tactic_id").alias("key")).union(m.select(F.lit(2), "technique_id")).union(m.select(F.lit(3), "source_id"))
    return ag.level_counts(rows)


@query("g17_descendants", "SELECT path, count(DISTINCT source_id) AS n FROM (SELECT tactic_id AS path, source_id FROM mentions UNION ALL SELECT concat(tactic_id, '/', technique_id), source_id FROM mentions UNION ALL SELECT concat(tactic_id, '/', technique_id, '/', source_id), source_id FROM mentions) GROUP BY path")
def descendants(t):
    return ag.descendant_counts(t.mentions.select(F.concat_ws("/", "tactic_id", "technique_id", "source_id").alias("path"), F.col("source_id").alias("key"), F.lit(True).alias("leaf")))


@query("g19_readiness", """
    SELECT rid AS research_id, coalesce(b, 0) AS blocking, coalesce(w, 0) AS warnings, coalesce(b, 0) = 0 AS ready FROM research LEFT JOIN (SELECT rid, count(*) FILTER (pos < 3) AS b, count(*) FILTER (pos >= 3) AS w FROM mentions WHERE flag = 'R' GROUP BY rid) USING (rid)""")
def readiness(t):
    issues = t.mentions.filter("flag = 'R'").select(F.col("rid").alias("research_id"), F.when(F.col("pos") < 3, "block").otherwise("warn").alias("severity"))
    return ag.readiness(issues, t.research.select(F.col("rid").alias("research_id")))


@query("g21_merged_indicators", """
    SELECT ioc_type AS type, (min((source_id, ioc_value)))[2] AS value, count(DISTINCT source_id) AS n_sources, list_sort(list(DISTINCT source_id)) AS source_ids, any_value(c.contexts) AS contexts
    FROM mentions JOIN (SELECT ioc_type AS t, k, list(quote ORDER BY s, quote) AS contexts FROM (SELECT * FROM (SELECT ioc_type, lower(ioc_value) AS k, quote, min(source_id) AS s FROM mentions GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ioc_type, k ORDER BY s, quote) <= 3) GROUP BY ALL) c ON c.t = ioc_type AND c.k = lower(ioc_value) GROUP BY ioc_type, lower(ioc_value)""")
def merged(t):
    return ag.merged_indicators(t.mentions.select("source_id", F.col("ioc_type").alias("type"), F.col("ioc_value").alias("value"), F.col("quote").alias("context")))


@query("g22_merged_techniques", "SELECT technique_id, arg_min(quote, (rid, pos, quote)) AS procedure, list_sort(list(DISTINCT source_id)) AS source_ids FROM mentions GROUP BY technique_id")
def merged_techniques(t):
    return ag.merged_techniques(t.mentions.select("technique_id", F.col("quote").alias("procedure"), "source_id", F.struct("rid", "pos", "quote").alias("pos")))


@query("g23_detection_groups", """
    WITH q AS (SELECT rid AS group_id, CASE WHEN pos % 5 = 0 THEN 'sigma' ELSE concat('p', cast(pos % 5 AS STRING)) END AS platform, CASE partkey % 3 WHEN 0 THEN 'generated' WHEN 1 THEN 'reviewed' ELSE 'deployed' END AS status, partkey % 3 AS k FROM mentions)
    SELECT group_id, coalesce(arg_min(status, k) FILTER (platform <> 'sigma'), min(status)) AS status, count(DISTINCT status) FILTER (platform <> 'sigma') > 1 AS mixed, list_sort(list(DISTINCT platform)) AS platforms FROM q GROUP BY group_id""")
def groups(t):
    status = F.element_at(F.array(F.lit("generated"), F.lit("reviewed"), F.lit("deployed")), (F.col("partkey") % 3 + 1).cast("int"))
    return ag.detection_groups(t.mentions.select(F.col("rid").alias("group_id"), F.when(F.col("pos") % 5 == 0, "sigma").otherwise(F.concat(F.lit("p"), (F.col("pos") % 5).cast("string"))).alias("platform"), status.alias("status")))


@query("g25_shares", "SELECT severity, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM research GROUP BY severity")
def shares(t):
    return ag.share_by(t.research, "severity")


@query("g26_enrichment_state", """
    SELECT 'state' AS kind, 'partial' AS value UNION ALL SELECT DISTINCT 'not_found', cve FROM mentions WHERE pos = 1 UNION ALL SELECT DISTINCT 'invalid_format', cve FROM mentions WHERE pos = 3 AND partkey % 2 = 0 UNION ALL SELECT DISTINCT 'rejected', cve FROM mentions WHERE pos = 4 AND partkey % 3 = 0""")
def enrichment(t):
    k = F.col("partkey")
    v = F.when(F.col("pos") == 1, "not_found").when((F.col("pos") == 3) & (k % 2 == 0), "invalid_format").when((F.col("pos") == 4) & (k % 3 == 0), "rejected").otherwise("verified")
    return ag.enrichment_state(t.mentions.select("cve", F.when(F.col("pos") == 2, "unavailable").otherwise("live").alias("state"), v.alias("validation")))


@query("g27_source_cards", "SELECT source_id, count(*) AS claims, count(*) FILTER (pos % 2 = 0) AS techniques, count(*) FILTER (pos % 3 = 0) AS iocs FROM mentions GROUP BY source_id")
def cards(t):
    m = t.mentions
    return ag.source_cards(m, m.filter("pos % 2 = 0"), m.filter("pos % 3 = 0"))


@query("g28_summaries", """
    WITH s AS (SELECT rid AS id, quote AS sentence, quantity, pos, partkey, suppkey, coalesce(sum(8) OVER (PARTITION BY rid ORDER BY quantity DESC, pos, partkey, suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY rid ORDER BY quantity DESC, pos, partkey, suppkey) AS r FROM mentions)
    SELECT id, string_agg(sentence, ' ' ORDER BY r) AS summary FROM s WHERE b <= 20 GROUP BY id""")
def summaries(t):
    return ag.top_summary(t.mentions.select(F.col("rid").alias("id"), F.col("quote").alias("sentence"), F.col("quantity").alias("score"), F.struct("pos", "partkey", "suppkey").alias("pos")), 20)


@query("g30_horizons", "SELECT CASE pos % 3 WHEN 0 THEN 'immediate' WHEN 1 THEN 'short_term' ELSE 'long_term' END AS horizon, pos % 3 AS pos, row_number() OVER (PARTITION BY pos % 3 ORDER BY comment_id) AS number, text AS action FROM comments")
def horizons(t):
    h = F.element_at(F.array(F.lit("immediate"), F.lit("short_term"), F.lit("long_term")), (F.col("pos") % 3 + 1).cast("int"))
    return ag.by_horizon(t.comments.select(h.alias("horizon"), F.col("comment_id").alias("pos"), F.col("text").alias("action")))


@query("g31_threads", "SELECT thread_id, arg_min(text, pos) AS root, coalesce(list(text ORDER BY pos) FILTER (pos > 0), []) AS replies FROM comments GROUP BY thread_id")
def threads(t):
    return ag.threads(t.comments)


@query("g32_intake_counts", "SELECT rid, count(DISTINCT cve) AS cves, count(DISTINCT ioc_value) AS iocs FROM mentions GROUP BY rid")
def intake_counts(t):
    rows = t.mentions.groupBy("rid").agg(F.collect_set("cve").alias("c"), F.collect_set("ioc_value").alias("i"))
    return rows.select("rid", F.size("c").cast("long").alias("cves"), F.size("i").cast("long").alias("iocs"))


@query("g33_feed_freshness", "SELECT source_id AS feed, epoch(max(seen_at)) AS s, bool_or(pos = 7) AS stale FROM mentions GROUP BY source_id")
def freshness(t):
    rows = ag.feed_freshness(t.mentions.select(F.col("source_id").alias("feed"), F.col("seen_at").alias("checked_at"), F.when(F.col("pos") == 7, "stale").otherwise("live").alias("state")))
    return rows.select("feed", F.unix_seconds(F.col("checked_at").cast("timestamp")).cast("double").alias("s"), "stale")


@query("g34_type_provenance", "SELECT ioc_type AS type, flag AS provenance, count(DISTINCT technique_id) AS detections, count(*) AS variants FROM mentions GROUP BY GROUPING SETS ((ioc_type, flag), (ioc_type))")
def type_provenance(t):
    return ag.type_provenance(t.mentions.select(F.col("ioc_type").alias("type"), F.col("flag").alias("provenance"), F.col("technique_id").alias("group_id")))


@query("g20_unread", "SELECT author AS user_id, count(*) FILTER (NOT resolved) AS unread FROM comments GROUP BY author")
def unread(t):
    return ag.unread(t.comments.select(F.col("author").alias("user_id"), F.col("resolved").alias("read")))


@query("w01_opportunities", """
    WITH m AS (SELECT rid, technique_id AS spec_key, min((pos, source_id, quantity)) AS f FROM mentions GROUP BY ALL), a AS (SELECT rid, spec_key, f[1] AS idx, f[2] AS step, f[3] AS score FROM m),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY rid, step ORDER BY score DESC, idx, spec_key) <= 1), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, idx, spec_key) <= 3)
    SELECT rid AS research_id, spec_key, concat('DO-', cast(row_number() OVER (PARTITION BY rid ORDER BY idx, spec_key) AS STRING)) AS opportunity_id FROM c""")
def opportunities(t):
    opps = t.mentions.groupBy("rid", "technique_id").agg(F.min(F.struct("pos", "source_id", "quantity")).alias("f")).select(F.col("rid").alias("research_id"), F.struct(F.col("f.pos").alias("p"), "technique_id").alias("idx"), F.col("technique_id").alias("spec_key"), F.col("f.source_id").alias("step"), F.array("technique_id").alias("techniques"), F.col("f.quantity").alias("score"))
    return rk.best_opportunities(opps, per_step=1, most=3).select("research_id", "spec_key", "opportunity_id")


@query("r06_opportunity_scores", "SELECT p_partkey, 1 + 0.5 + CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS score FROM part")
def scores(t):
    s = F.col("p_size")
    c = F.array(F.struct(F.lit("image").alias("field"), F.lit("equals").alias("op"), F.array(F.lit("x")).alias("values")))
    return t.part.select("p_partkey", rk.opportunity_score(c, F.when(s % 2 == 0, "web").otherwise("dns"), F.when(s % 3 == 0, "T1"), F.array(F.lit("T1")), F.when(s % 5 == 0, "ioa").otherwise("ioc")).cast("double").alias("score"))


@query("w02_syndicated", "SELECT source_id FROM (SELECT doc_id AS source_id, substring(trim(regexp_replace(lower(substring(title, 1, 9)), '[^a-z0-9]+', ' ', 'g')), 1, 80) AS k, doc_id % 17 AS score, published FROM reports) QUALIFY k = '' OR row_number() OVER (PARTITION BY k ORDER BY score DESC, published DESC, source_id) = 1")
def syndicated(t):
    return rk.without_syndicated(t.reports.select(F.col("doc_id").alias("source_id"), F.substring("title", 1, 9).alias("title"), (F.col("doc_id") % 17).alias("score"), "published")).select("source_id")


@query("t02_ranked_sources", """
    WITH a AS (SELECT doc_id AS source_id, concat(publisher, '/', cast(doc_id % 700 AS STRING)) AS c, concat(title, cast(doc_id AS STRING)) AS title, doc_id % 3 AS o, doc_id % 17 AS score, published FROM reports), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY c ORDER BY o, source_id) = 1),
    d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY substring(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 80) ORDER BY score DESC, published DESC, source_id) = 1) SELECT source_id FROM d ORDER BY score DESC, published DESC, source_id LIMIT 15""")
def ranked_sources(t):
    origin = F.element_at(F.array(F.lit("seed"), F.lit("vendor_feed"), F.lit("web")), (F.col("doc_id") % 3 + 1).cast("int"))
    return rk.rank_sources(t.reports.select(F.col("doc_id").alias("source_id"), "url", F.concat("title", F.col("doc_id").cast("string")).alias("title"), origin.alias("origin"), (F.col("doc_id") % 17).alias("score"), "published"), 15).select("source_id")


#: The first view of a user and path, and each that is three days or more after the last kept one.
SPACED = """WITH RECURSIVE s AS (SELECT user_id, path, min(seen_at) AS kept_at FROM access GROUP BY ALL UNION ALL
      SELECT s.user_id, s.path, min(v.seen_at) FROM s JOIN (SELECT user_id, path, seen_at FROM access) v USING (user_id, path) WHERE v.seen_at >= s.kept_at + to_days(3) GROUP BY s.user_id, s.path)"""


@query("w03_spaced_views", f"{SPACED} SELECT user_id, path, epoch(kept_at) AS at_s FROM s")
def spaced(t):
    return rk.spaced(t.access, ["user_id", "path"], "seen_at", 4320).select("user_id", "path", (F.unix_micros("seen_at") / 1e6).alias("at_s"))


@query("w04_busy_time", """
    WITH s AS (SELECT rid, epoch(seen_at) AS s, epoch(seen_at) + quantity * 86400 AS e FROM mentions), w AS (SELECT *, coalesce(max(e) OVER (PARTITION BY rid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) AS reach FROM s)
    SELECT rid, sum(greatest(0, e - greatest(s, reach))) AS seconds FROM w GROUP BY rid""")
def busy(t):
    end = F.col("seen_at") + F.make_dt_interval(F.col("quantity").cast("int"))
    return rk.busy_time(t.mentions.withColumn("until", end), ["rid"], "seen_at", "until")


@query("w05_latest", "SELECT created_by, arg_max(rid, (updated_at, rid)) AS rid FROM research GROUP BY created_by")
def latest(t):
    return rk.latest(t.research, ["created_by"], "updated_at", "rid").select("created_by", "rid")


@query("w06_previous_versions", "SELECT research_id, version, lag(version) OVER (PARTITION BY research_id ORDER BY version) AS previous FROM (SELECT DISTINCT rid AS research_id, pos AS version FROM mentions WHERE flag <> 'A')")
def versions(t):
    return rk.previous_version(t.mentions.filter("flag <> 'A'").select(F.col("rid").alias("research_id"), F.col("pos").alias("version")).distinct())


@query("w07_keep_last", "SELECT actor, list_slice(list(rid ORDER BY rid), greatest(1, count(*) - 19), count(*)) AS values FROM (SELECT DISTINCT actor, rid FROM mentions) GROUP BY actor")
def keep_last(t):
    return rk.keep_last(t.mentions.select("actor", "rid", F.col("rid").alias("v")).distinct(), ["actor"], "rid", "v", 20)


@query("w08_numbered", "SELECT rid, source_id, concat('Q-', cast(row_number() OVER (PARTITION BY rid ORDER BY source_id) AS STRING)) AS number FROM sources")
def numbered(t):
    return rk.numbered(t.sources, ["rid"], [F.asc("source_id")], "Q-").select("rid", "source_id", "number")


@query("w09_carried_numbers", "SELECT rid, pos, partkey, suppkey, concat('TTP-', cast(dense_rank() OVER (PARTITION BY rid ORDER BY technique_id) AS STRING)) AS number FROM mentions")
def carried(t):
    return rk.carried_numbers(t.mentions, ["rid"], "technique_id", "TTP-").select("rid", "pos", "partkey", "suppkey", "number")


@query("w10_first_seen", "SELECT lower(ioc_value) AS value, min(rid) AS rid FROM mentions GROUP BY 1")
def first_seen(t):
    return rk.first_by_key(t.mentions.withColumn("value", F.lower("ioc_value")), ["value"], [F.asc("rid")]).select("value", "rid")


@query("t01_page", "SELECT rid FROM research ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, rid DESC LIMIT 50 OFFSET 100")
def page(t):
    s = F.col("severity")
    return rk.page(t.research, [F.desc(F.when(s == "critical", 4).when(s == "high", 3).when(s == "medium", 2).otherwise(1)), F.desc("rid")], 3, 50).select("rid")


@query("t05_mitre_rows", """
    WITH c AS (SELECT technique_id, min(tactic_id) AS t FROM mentions WHERE technique_id <> 'T1007' GROUP BY 1) SELECT DISTINCT rid AS research_id, technique_id, t AS tactic_id FROM mentions JOIN c USING (technique_id)""")
def mitre(t):
    m = t.mentions
    cat = m.filter("technique_id <> 'T1007'").groupBy("technique_id").agg(F.lit("Name").alias("name"), F.array(F.min("tactic_id")).alias("tactics"))
    rows = m.select(F.col("rid").alias("research_id"), F.lower("technique_id").alias("technique_id"), F.lit("TA999").alias("tactic_id"), F.col("pos").alias("idx"), F.col("quote").alias("procedure"))
    return rk.mitre_rows(rows, cat, m.select("tactic_id").distinct().withColumn("pos", F.lit(1))).select("research_id", "technique_id", "tactic_id")


@query("t08_recent", "SELECT rid FROM research ORDER BY updated_at DESC, rid LIMIT 6")
def recent(t):
    return t.research.orderBy(F.desc("updated_at"), "rid").limit(6).select("rid")


@query("t09_report_slices", "SELECT rid, list_slice(list(technique_id ORDER BY technique_id), 1, 8) AS techniques FROM (SELECT DISTINCT rid, technique_id FROM mentions) GROUP BY rid")
def slices(t):
    return t.mentions.groupBy("rid").agg(F.slice(F.array_sort(F.collect_set("technique_id")), 1, 8).alias("techniques"))


@query("t10_history", "SELECT event_id FROM access WHERE method = 'GET' ORDER BY seen_at DESC, event_id LIMIT 100")
def history(t):
    return t.access.filter("method = 'GET'").orderBy(F.desc("seen_at"), "event_id").limit(100).select("event_id")


@query("t11_picker", "SELECT technique_id FROM (SELECT DISTINCT technique_id FROM mentions) WHERE contains(lower(technique_id), 't102') ORDER BY NOT starts_with(lower(technique_id), 't102'), technique_id LIMIT 8")
def picker(t):
    q = F.lower("technique_id")
    return t.mentions.select("technique_id").distinct().filter(F.contains(q, F.lit("t102"))).orderBy(~F.startswith(q, F.lit("t102")), "technique_id").limit(8)
