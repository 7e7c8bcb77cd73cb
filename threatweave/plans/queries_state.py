"""Queries of upserts, set operations, diffs, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..operators import diff as di
from ..operators import merge as me
from ..sources import writers as wr
from ..streaming import jobs as st
from .queries_rollups import SPACED
from .registry import query

OLD, NEW = "flag <> 'A'", "flag <> 'R'"


def _versions(t):
    m = t.mentions.select(F.col("rid").alias("research_id"), F.lower("cve").alias("key"), F.struct("pos", "partkey", "suppkey").alias("pos"), "source_id", "malware", "flag")
    return m.filter(OLD), m.filter(NEW)


DIFF = f"""o AS (SELECT rid AS research_id, lower(cve) AS key, min((pos, partkey, suppkey, source_id, malware)) AS x FROM mentions WHERE {OLD} GROUP BY ALL), n AS (SELECT rid AS research_id, lower(cve) AS key, min((pos, partkey, suppkey, source_id, malware)) AS x FROM mentions WHERE {NEW} GROUP BY ALL),
    d AS (SELECT research_id, key, CASE WHEN o.x IS NULL THEN 'added' WHEN n.x IS NULL THEN 'removed' WHEN (o.x[4], o.x[5]) <> (n.x[4], n.x[5]) THEN 'changed' END AS change, o.x AS a, n.x AS b FROM o FULL JOIN n USING (research_id, key))"""


@query("d01_keyed_diff", f"WITH {DIFF} SELECT research_id, key, change FROM d WHERE change IS NOT NULL")
def keyed(t):
    return di.keyed(*_versions(t), ["research_id", "key"], ["source_id", "malware"]).select("research_id", "key", "change")


@query("d02_field_changes", f"WITH {DIFF} SELECT research_id, key, 'source_id' AS field, a[4] AS before, b[4] AS after FROM d WHERE change = 'changed' AND a[4] <> b[4] UNION ALL SELECT research_id, key, 'malware', a[5], b[5] FROM d WHERE change = 'changed' AND a[5] <> b[5]")
def field_changes(t):
    return di.field_changes(di.keyed(*_versions(t), ["research_id", "key"], ["source_id", "malware"]), ["research_id", "key"], ["source_id", "malware"])


@query("d01_summaries", f"""WITH {DIFF}, c AS (SELECT research_id, count(*) FILTER (change = 'added') AS p, count(*) FILTER (change = 'removed') AS m, count(*) FILTER (change = 'changed') AS c FROM d WHERE change IS NOT NULL GROUP BY 1)
    SELECT research_id, concat_ws(', ', CASE WHEN p > 0 THEN concat('+', p) END, CASE WHEN m > 0 THEN concat('-', m) END, CASE WHEN c > 0 THEN concat(c, ' changed') END) AS text FROM c""")
def summaries(t):
    return di.summary(di.keyed(*_versions(t), ["research_id", "key"], ["source_id", "malware"]), ["research_id"])


@query("d03_string_lists", "SELECT rid, list_filter([b], lambda x: x <> a) AS added, list_filter([a], lambda x: x <> b) AS removed FROM (SELECT rid, workspace_ids[1] AS a, workspace_ids[2] AS b FROM research)")
def string_lists(t):
    rows = t.research.select("rid", F.slice("workspace_ids", 1, 1).alias("old"), F.slice("workspace_ids", 2, 1).alias("new"))
    return di.string_lists(rows, "old", "new").select("rid", "added", "removed")


@query("d04_keyless_diff", f"""
    WITH c AS (SELECT rid AS research_id, technique_id AS body, count(*) FILTER ({OLD}) - count(*) FILTER ({NEW}) AS d FROM mentions GROUP BY ALL), a AS (SELECT research_id, sum(d) FILTER (d > 0) AS o, -sum(d) FILTER (d < 0) AS n FROM c GROUP BY 1)
    SELECT research_id, cast(greatest(coalesce(n, 0) - coalesce(o, 0), 0) AS BIGINT) AS added, cast(greatest(coalesce(o, 0) - coalesce(n, 0), 0) AS BIGINT) AS removed, cast(least(coalesce(o, 0), coalesce(n, 0)) AS BIGINT) AS changed FROM a WHERE coalesce(o, n) IS NOT NULL""")
def keyless(t):
    m = t.mentions.select(F.col("rid").alias("research_id"), F.col("technique_id").alias("body"), "flag")
    rows = di.keyless(m.filter(OLD), m.filter(NEW), ["research_id"], "body")
    return rows.groupBy("research_id").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])


@query("d05_scalar_diff", "SELECT rid, 'severity' AS field, 'changed' AS change FROM research WHERE severity <> 'low' UNION ALL SELECT rid, 'title', 'removed' FROM research WHERE rid % 2 = 0")
def scalars(t):
    old = t.research.select("rid", "severity", "title")
    new = t.research.select("rid", F.lit("low").alias("severity"), F.when(F.col("rid") % 2 == 1, F.col("title")).alias("title"))
    return di.scalars(old, new, ["rid"], ["severity", "title"])


@query("d06_new_items", f"SELECT DISTINCT rid, technique_id FROM mentions m WHERE {NEW} AND NOT EXISTS (SELECT 1 FROM mentions o WHERE o.rid = m.rid AND o.technique_id = m.technique_id AND o.flag <> 'A')")
def new_items(t):
    m = t.mentions.select("rid", "technique_id", "flag")
    return di.new_items(m.filter(OLD), m.filter(NEW), ["rid"], "technique_id").select("rid", "technique_id").distinct()


@query("d07_same_but", "SELECT rid, rid % 3 = 0 AS changed FROM research")
def same_but(t):
    rows = t.research.select("rid", F.struct("title", F.lit(1).alias("checked")).alias("a"), F.struct(F.when(F.col("rid") % 3 == 0, "x").otherwise(F.col("title")).alias("title"), F.lit(2).alias("checked")).alias("b"))
    return di.same_but(rows, "a", "b", ["checked"]).select("rid", "changed")


@query("m01_changed_sections", f"""
    WITH s AS (SELECT rid, tactic_id AS section, list_sort(list(technique_id) FILTER ({OLD})) AS a, list_sort(list(technique_id) FILTER ({NEW})) AS b FROM mentions GROUP BY ALL) SELECT rid AS research_id, list_sort(list(section)) AS sections FROM s WHERE a IS DISTINCT FROM b GROUP BY rid""")
def changed_sections(t):
    body = lambda w: t.mentions.filter(w).groupBy(F.col("rid").alias("research_id"), F.col("tactic_id").alias("section")).agg(F.to_json(F.array_sort(F.collect_list("technique_id"))).alias("body"))
    return di.changed_sections(body(OLD), body(NEW))


@query("m02_rebuilt_links", f"SELECT DISTINCT rid, actor FROM mentions m WHERE (rid % 5 = 0 AND {NEW}) OR (NOT (rid % 5 = 0 AND EXISTS (SELECT 1 FROM mentions o WHERE o.rid = m.rid AND o.flag <> 'R')))")
def rebuilt(t):
    m = t.mentions.select(F.col("rid").alias("research_id"), "actor", "flag")
    return me.rebuilt_links(m.drop("flag").distinct(), m.filter(f"research_id % 5 = 0 and {NEW}").drop("flag")).withColumnRenamed("research_id", "rid")


@query("m03_resolved_actors", """
    SELECT name, min(actor_id) AS actor_id FROM (SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN concat('actor', cast(s_suppkey AS STRING)) ELSE trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') END AS actor_id FROM supplier) GROUP BY name""")
def resolved(t):
    current = t.actors.filter(F.substring("actor_id", 6, 9).try_cast("int") % 2 == 0).select("actor_id", F.concat(F.lit("x"), "actor_id").alias("name"), F.array(F.upper("name")).alias("aliases"))
    return me.resolved_actors(current, t.actors.select("name", F.array().cast("array<string>").alias("aliases")))


@query("m03_merged_actors", """
    WITH c AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS actor_id, name, aliases, nation FROM actors)
    SELECT actor_id, list_sort(list_distinct(list_concat(CASE WHEN nation % 2 = 0 THEN aliases ELSE [] END, ['New']))) AS aliases, CASE WHEN nation % 3 = 0 THEN 'n' WHEN nation % 2 = 0 THEN 'o' END AS origin FROM c""")
def merged_actors(t):
    from ..functions.text import slug

    c = t.actors.withColumn("actor_id", slug(F.col("name")))
    none = F.array().cast("array<string>")
    current = c.filter("nation % 2 = 0").select("actor_id", "name", "aliases", F.lit("o").alias("origin"), none.alias("motivation"), F.lit(1).alias("last_seen"))
    changes = c.select("name", F.array(F.lit("New")).alias("aliases"), F.when(F.col("nation") % 3 == 0, "n").otherwise("").alias("origin"), none.alias("motivation"), F.lit(2).alias("seen_at"))
    return me.merged_actors(current, changes).select("actor_id", "aliases", "origin")


@query("m04_merged_malware", "SELECT p_partkey AS malware_id, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN contains(p_name, p_brand) THEN p_name ELSE concat(p_name, ' ', p_brand) END ELSE p_brand END AS capabilities FROM part")
def merged_malware(t):
    current = t.part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("malware_id"), F.col("p_name").alias("name"), F.col("p_name").alias("capabilities"), F.lit(1).alias("last_seen"))
    return me.merged_malware(current, t.part.select(F.col("p_partkey").alias("malware_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("role"), F.lit(2).alias("seen_at"))).select("malware_id", "capabilities")


@query("m05_merged_cves", "SELECT p_partkey AS cve, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE p_retailprice END AS cvss, CASE WHEN p_size % 2 = 0 THEN 'old' ELSE p_name END AS description FROM part")
def merged_cves(t):
    none = F.array().cast("array<string>")
    current = t.part.select(F.col("p_partkey").alias("cve"), F.lit(1.0).alias("cvss"), F.lit(0.1).alias("epss"), F.lit("old").alias("description"), none.alias("products"))
    changes = t.part.select(F.col("p_partkey").alias("cve"), F.when(F.col("p_size") % 3 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("cvss"), F.lit(0.0).alias("epss"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")).alias("description"), none.alias("products"))
    return me.merged_cves(current, changes).select("cve", "cvss", "description")


@query("m06_merged_iocs", """
    SELECT p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN 'old' WHEN p_partkey % 5 = 0 THEN 'benign' ELSE 'new' END AS verdict, CASE WHEN p_size % 3 = 1 THEN 3 ELSE 2 END AS n FROM part""")
def merged_iocs(t):
    ctx = lambda r, c: F.struct(F.lit(r).alias("research_id"), F.lit(c).alias("context"))
    current = t.part.select(F.col("p_partkey").alias("key"), F.lit("old").alias("verdict"), F.lit(5).alias("first_seen"), F.array(ctx("A", "a"), ctx("B", "b")).alias("contexts"))
    changes = t.part.filter("p_size % 3 <> 0").select(F.col("p_partkey").alias("key"), F.lit("new").alias("verdict"), F.lit(3).alias("first_seen"), F.when(F.col("p_size") % 3 == 1, "C").otherwise("B").alias("research_id"), F.lit("fresh").alias("context"))
    overrides = t.part.filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("key"), F.lit("benign").alias("verdict"))
    return me.merged_iocs(current, changes, overrides).select("key", "verdict", F.size("contexts").alias("n"))


@query("m07_merged_queries", "SELECT p_partkey AS query_id, CASE WHEN p_size % 3 = 0 THEN 'deployed' WHEN p_size % 2 = 0 THEN 'reviewed' ELSE 'lab_tested' END AS status FROM part")
def merged_queries(t):
    current = t.part.select(F.col("p_partkey").alias("query_id"), F.lit("t").alias("title"), F.lit("reviewed").alias("status"), (F.col("p_size") % 3 == 0).alias("deployed"))
    return me.merged_queries(current, t.part.select(F.col("p_partkey").alias("query_id"), F.lit("u").alias("title"), F.when(F.col("p_size") % 2 == 0, "generated").otherwise("lab_tested").alias("status"))).select("query_id", "status")


@query("u03_orphaned", "SELECT DISTINCT partkey AS query_id FROM mentions WHERE flag = 'A' AND partkey % 4 <> 0 AND partkey NOT IN (SELECT partkey FROM mentions WHERE flag <> 'A')")
def orphaned(t):
    m = t.mentions.select(F.col("partkey").alias("query_id"), "flag")
    return me.orphaned(m.filter("flag = 'A'"), m.filter("flag <> 'A'"), t.part.select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") % 4 == 0).alias("deployed")))


@query("m08_expiry_again", "SELECT rid, pos, CASE ioc_type WHEN 'ipv4' THEN cast(seen_at + INTERVAL 120 DAY AS DATE) END AS expires FROM mentions")
def expiry(t):
    return t.mentions.select("rid", "pos", ind.expires_at(F.col("ioc_type"), F.col("seen_at"), {"ipv4": 120}).cast("date").alias("expires"))


@query("m09_decided", "SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 'new' ELSE 'old' END AS verdict FROM part WHERE p_size % 5 <> 0")
def decided(t):
    current = t.part.select(F.col("p_partkey").alias("key"), F.lit("old").alias("verdict"), F.lit(False).alias("excluded"), F.lit("n").alias("note"))
    changes = t.part.filter("p_size % 2 = 0 or p_size % 5 = 0").select(F.col("p_partkey").alias("key"), F.lit("new").alias("verdict"), F.lit(None).cast("boolean").alias("excluded"), F.lit("").alias("note"), (F.col("p_size") % 5 == 0).alias("restore"))
    return me.decided(current, changes).select("key", "verdict")


@query("m10_regrouped", f"""
    WITH g AS (SELECT rid AS research_id, ioc_type AS group_id, list_sort(list(DISTINCT lower(ioc_value)) FILTER ({OLD})) AS o, list_sort(list(DISTINCT lower(ioc_value)) FILTER ({NEW})) AS n FROM mentions GROUP BY ALL)
    SELECT research_id, group_id, CASE WHEN n IS NULL THEN 'removed' WHEN o IS NULL THEN 'added' WHEN o = n THEN 'unchanged' ELSE 'changed' END AS action, coalesce(len(o), 0) AS before, coalesce(len(n), 0) AS after FROM g""")
def regrouped(t):
    m = t.mentions.select(F.col("rid").alias("research_id"), F.col("ioc_type").alias("group_id"), F.lower("ioc_value").alias("value"), "flag")
    return me.regrouped(m.filter(OLD), m.filter(NEW))


@query("m11_kept_edits", "SELECT rid AS research_id, severity AS section, CASE WHEN rid % 4 = 0 THEN 'old' ELSE title END AS body, rid % 4 = 0 AS edited FROM research")
def kept_edits(t):
    new = t.research.select(F.col("rid").alias("research_id"), F.col("severity").alias("section"), F.col("title").alias("body"))
    return me.kept_edits(new, new.withColumn("body", F.lit("old")).withColumn("edited", F.col("research_id") % 4 == 0))


@query("m12_created_results", """
    SELECT rid AS research_id, workspace_id, CASE WHEN rid % 2 = 0 THEN 'not_applicable' ELSE 'pending' END AS status FROM (SELECT DISTINCT rid, unnest(workspace_ids) AS workspace_id FROM research) ANTI JOIN results USING (rid, workspace_id)""")
def created(t):
    r = t.research.select(F.col("rid").alias("research_id"), "workspace_ids")
    exposure = r.select("research_id", F.explode(F.array_distinct("workspace_ids")).alias("workspace_id"), F.when(F.col("research_id") % 2 == 0, "not_exposed").otherwise("exposed").alias("status"))
    return me.created_results(r, t.results.withColumnRenamed("rid", "research_id"), exposure)


@query("m13_repaired", "SELECT rid, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS state, CASE WHEN status = 'running' AND rid % 2 = 0 THEN 'failed' WHEN rid % 2 = 0 THEN 'running' ELSE 'done' END AS stage FROM research")
def repaired(t):
    runs = t.research.select("rid", F.col("status").alias("state"), F.create_map(F.lit("iocs"), F.when(F.col("rid") % 2 == 0, "running").otherwise("done")).alias("stages"))
    return me.repaired(runs).select("rid", "state", F.col("stages")["iocs"].alias("stage"))


@query("u02_entity_sets", "SELECT rid, list_sort(list_distinct(list_concat(workspace_ids, ['ws1']))) AS ids FROM research")
def entity_sets(t):
    return t.research.select("rid", F.array_sort(F.array_union("workspace_ids", F.array(F.lit("ws1")))).alias("ids"))


@query("u05_remembered", "SELECT technique_id AS key, epoch(max(seen_at)) AS s FROM mentions GROUP BY 1 HAVING max(seen_at) >= TIMESTAMP '1998-11-01'")
def remembered(t):
    m = t.mentions.select(F.col("technique_id").alias("key"), F.col("seen_at").alias("at"), "flag")
    return me.remembered(m.filter("flag = 'A'").drop("flag"), m.filter("flag <> 'A'").drop("flag"), F.lit("1998-11-01").cast("timestamp_ntz")).select("key", F.unix_seconds(F.col("at").cast("timestamp")).cast("double").alias("s"))


@query("u08_platforms", "SELECT rid, list_distinct_in_order AS platforms FROM (SELECT rid, CASE WHEN workspace_ids[1] = workspace_ids[2] THEN ['sigma', workspace_ids[1]] ELSE ['sigma', workspace_ids[1], workspace_ids[2]] END AS list_distinct_in_order FROM research)")
def platforms(t):
    return t.research.select("rid", F.array_distinct(F.concat(F.array(F.lit("sigma")), "workspace_ids")).alias("platforms"))


@query("u10_missing_platforms", "SELECT rid, list_sort(list_filter(list_distinct(workspace_ids), lambda x: x <> 'ws1')) AS missing FROM research")
def missing(t):
    return t.research.select("rid", F.array_sort(F.array_except("workspace_ids", F.array(F.lit("ws1")))).alias("missing"))


@query("k01_ioc_csv", "SELECT ioc_type AS type, count(*) AS n FROM mentions GROUP BY 1")
def ioc_csv(t):
    rows = t.mentions.select(F.col("ioc_type").alias("type"), F.col("ioc_value").alias("value"), F.array("source_id").alias("source_ids"))
    return wr.csv_round_trip(wr.ioc_rows(rows)).groupBy("type").agg(F.count("*").alias("n"))


@query("k03_record_json", "SELECT rid, title FROM research")
def record_json(t):
    return wr.json_round_trip(wr.public(t.research.select("rid", "title", F.lit("x").alias("_internal"))))


@query("k04_period_extract", "SELECT rid, severity FROM research WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1997-01-01'")
def extract(t):
    return wr.partitioned_round_trip(t.research.filter("created_at >= timestamp_ntz '1996-01-01' and created_at < timestamp_ntz '1997-01-01'").select("rid", "severity"), "severity").select("rid", "severity")


@query("k05_stix_objects", "SELECT 'indicator' AS type, count(DISTINCT (ioc_type, lower(ioc_value))) AS n FROM mentions UNION ALL SELECT 'intrusion-set', count(DISTINCT actor) FROM mentions UNION ALL SELECT 'malware', count(DISTINCT malware) FROM mentions")
def stix(t):
    return wr.stix_objects(t.mentions).groupBy("type").agg(F.count("*").alias("n"))


@query("k06_stix_problems", "SELECT 'missing name' AS problem, count(DISTINCT actor) AS n FROM mentions WHERE actor = 'actor7'")
def stix_problems(t):
    objects = wr.stix_objects(t.mentions)
    broken = objects.withColumn("name", F.when(F.col("name") != "actor7", F.col("name")))
    return wr.stix_problems(broken).groupBy("problem").agg(F.count("*").alias("n"))


@query("ss01_feed_stream", "SELECT count(DISTINCT regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '')) AS n FROM pages")
def feed_stream(t):
    return st.run_feed(t.pages)


@query("ss02_view_stream", f"{SPACED} SELECT concat(user_id, ' ', path) AS key, epoch(kept_at) AS at_s FROM s")
def view_stream(t):
    return st.run_views(t.access, 4320).select("key", (F.unix_micros("seen_at") / 1e6).alias("at_s"))


@query("ss03_log_tail", "SELECT event_id, path FROM access")
def tail(t):
    return st.run_tail(t.access)


@query("ss06_match_stream", "SELECT spec_id, count(*) AS n FROM (SELECT 'web' AS spec_id FROM telemetry WHERE category = 'web' AND user_id % 9 IN (1, 2)) GROUP BY 1")
def match_stream(t):
    return st.run_matches(t.telemetry)
