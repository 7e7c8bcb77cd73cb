"""Queries of records against the library, mails and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import ranking as rk
from ..operators import records as re_
from ..operators import search as se
from ..sources import fixed, writers
from ..streaming import jobs as st
from .queries_joins import CLUSTERS, _articles
from .registry import query

def _rid():
    return F.col("rid").alias("research_id")


@query("f12_live", "SELECT rid, pos FROM mentions WHERE rid IN (SELECT rid FROM research WHERE status <> 'archived')")
def live(t):
    return re_.live(t.mentions.select(_rid(), "pos"), t.research.select(_rid(), "status")).select(F.col("research_id").alias("rid"), "pos")


@query("j03_actors", """
    WITH a AS (SELECT actor_id, unnest([lower(name), lower(aliases[1]), lower(aliases[2])]) AS k FROM actors),
    n AS (SELECT rid AS research_id, source_id, unnest([concat('group', cast(suppkey AS STRING)), concat('alias', cast(partkey % 1000 AS STRING))]) AS k FROM mentions)
    SELECT DISTINCT actor_id, research_id, source_id FROM a JOIN n USING (k)""")
def actor_matches(t):
    named = t.mentions.select(_rid(), "source_id", F.concat(F.lit("GROUP"), F.col("suppkey").cast("string")).alias("name"), F.array(F.concat(F.lit("ALIAS"), (F.col("partkey") % 1000).cast("string")), F.lit("")).alias("aliases"))
    return re_.actor_matches(t.actors.select("actor_id", "name", "aliases"), named)


@query("j03_malware", "SELECT DISTINCT concat('mal-', cast(n_nationkey AS STRING)) AS malware_id, rid AS research_id, source_id FROM mentions JOIN nation ON partkey % 90 = n_nationkey")
def malware_matches(t):
    library = t.nation.select(F.concat(F.lit("mal-"), F.col("n_nationkey").cast("string")).alias("malware_id"))
    return re_.malware_matches(library, t.mentions.select(_rid(), "source_id", F.concat(F.lit("(Mal  "), (F.col("partkey") % 90).cast("string"), F.lit(")")).alias("name")))


@query("j03_iocs", "SELECT DISTINCT concat(ioc_type, '/', lower(ioc_value)) AS ioc_id, rid AS research_id, source_id FROM mentions WHERE ioc_type <> 'sha256'")
def ioc_matches(t):
    m = t.mentions.select(_rid(), "source_id", F.col("ioc_type").alias("type"), F.col("ioc_value").alias("value"))
    library = m.filter("type <> 'sha256'").select(F.concat_ws("/", "type", F.lower("value")).alias("ioc_id"), "type", F.lower("value").alias("value")).distinct()
    return re_.ioc_matches(library, m.withColumn("value", F.replace("value", F.lit("."), F.lit("[.]"))))


@query("j12_overrides", """
    WITH o AS (SELECT rid * 10 + pos AS id, min(ioc_type) AS t, min(lower(ioc_value)) AS v, max(seen_at) AS seen, max(flag) AS d FROM mentions GROUP BY 1)
    SELECT concat(t, '|', v) AS key, d AS decision FROM o QUALIFY row_number() OVER (PARTITION BY t, v ORDER BY seen DESC, id DESC) = 1""")
def overrides(t):
    rows = t.mentions.groupBy((F.col("rid") * 10 + F.col("pos")).alias("ioc_id")).agg(F.min("ioc_type").alias("type"), F.min(F.lower("ioc_value")).alias("value"), F.max("seen_at").alias("at"), F.max("flag").alias("decision"))
    return re_.keyed_overrides(rows.select("ioc_id", "decision", "at"), rows.select("ioc_id", "type", "value"))


@query("j32_classes", """
    WITH f AS (SELECT DISTINCT rid AS research_id, pos AS behaviour_id, 'cve' AS class, cve AS key FROM mentions WHERE partkey % 3 = 0 UNION SELECT DISTINCT rid, pos, 'actor', actor FROM mentions WHERE suppkey % 4 = 0)
    SELECT * FROM f UNION ALL SELECT DISTINCT rid, pos, 'unmapped', NULL FROM mentions WHERE (rid, pos) NOT IN (SELECT (research_id, behaviour_id) FROM f)""")
def classes(t):
    m = t.mentions.select("*", _rid())
    both = lambda kind, c: m.select("research_id", F.col("pos").alias("behaviour_id"), F.lit(kind).alias("kind"), F.concat_ws("/", "pos", c).alias("ref"))
    one = lambda kind, c, rule: m.filter(rule).select("research_id", F.lit(kind).alias("class"), F.col(c).alias("key"), F.lit(kind).alias("kind"), F.concat_ws("/", "pos", c).alias("ref"))
    return re_.class_members(both("cve", "cve").unionByName(both("actor", "actor")), one("cve", "cve", "partkey % 3 = 0").unionByName(one("actor", "actor", "suppkey % 4 = 0")))


@query("j35_from_source", """
    WITH o AS (SELECT DISTINCT rid AS research_id, source_id, 'claim' AS kind, quote AS item FROM mentions UNION SELECT DISTINCT rid, source_id, 'technique', technique_id FROM mentions UNION SELECT DISTINCT rid, source_id, 'ioc', ioc_value FROM mentions)
    SELECT * FROM o UNION ALL SELECT DISTINCT research_id, source_id, 'detection', query_id FROM o JOIN queries ON rid = research_id AND technique_id = item WHERE kind = 'technique'""")
def from_source(t):
    m = t.mentions
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("item")) for k, c in (("claim", "quote"), ("technique", "technique_id"), ("ioc", "ioc_value"))]))
    return re_.from_source(m.select(_rid(), "source_id", kinds.alias("x")).select("research_id", "source_id", "x.*"), t.queries.select(_rid(), "technique_id", F.col("query_id").alias("item")))


@query("f06_tree", """
    WITH b AS (SELECT DISTINCT rid AS root, tactic_id AS a, concat(tactic_id, '/', technique_id) AS b, concat(tactic_id, '/', technique_id, '/', source_id) AS c, flag = 'R' AND pos < 3 AS leaf, technique_id = 'T1007' AS branch FROM mentions),
    n AS (SELECT root, a AS path FROM b UNION SELECT root, b FROM b UNION SELECT root, c FROM b)
    SELECT root, a AS path FROM b WHERE leaf OR branch UNION SELECT root, b FROM b WHERE leaf OR branch UNION SELECT root, c FROM b WHERE leaf OR branch""")
def tree(t):
    m = t.mentions.select(F.col("rid").alias("root"), F.array("tactic_id", "technique_id", "source_id").alias("p"), (F.col("flag").eqNullSafe("R") & (F.col("pos") < 3)).alias("leaf"), F.col("technique_id") == "T1007")
    path = lambda n: F.array_join(F.slice("p", 1, n), "/")
    nodes = m.select("root", F.explode(F.array(path(1), path(2), path(3))).alias("path")).distinct()
    matches = m.filter("leaf").select("root", path(3).alias("path"), F.lit(False).alias("by_text")).unionByName(m.filter("p[1] = 'T1007'").select("root", path(2).alias("path"), F.lit(True).alias("by_text")))
    return re_.tree_filter(nodes, matches)


WORDS = ", ".join(f"'{w}'" for w in fixed.KEYWORD_STOP)


@query("e05_seeds", rf"""
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')[1] AS line FROM documents),
    s AS (SELECT doc_id, coalesce(regexp_replace(CASE WHEN regexp_matches(line, '[.!?]\s') THEN regexp_extract(line, '^(.*?[.!?])\s', 1) ELSE line END, '\.+$', ''), 'Untitled threat') AS line FROM l),
    w AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(line, '[^\x00-\x7F\P{{L}}]', '_', 'g'), '{fixed.KEYWORD}'), lambda x: lower(x) NOT IN ({WORDS})) AS w FROM s)
    SELECT doc_id, array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 4), ' ') AS keywords FROM w""")
def seeds(t):
    return re_.seed_entities(t.documents).select("doc_id", F.array_join("keywords", " ").alias("keywords"))


@query("e09_mail_indicators", """
    WITH p AS (SELECT DISTINCT rid, concat('update', cast(suppkey % 13 AS STRING), '.top') AS d FROM mentions WHERE pos = 2), a AS (SELECT DISTINCT rid, lower(ioc_value) AS h FROM mentions WHERE pos = 4 AND ioc_type = 'domain')
    SELECT rid AS mail_id, pos, ioc_value AS value FROM mentions m WHERE NOT (ioc_type = 'domain' AND (EXISTS (SELECT 1 FROM p WHERE p.rid = m.rid AND ends_with(lower(m.ioc_value), '.' || p.d)) OR EXISTS (SELECT 1 FROM a WHERE a.rid = m.rid AND a.h = lower(m.ioc_value))))""")
def mail_indicators(t):
    m = t.mentions.select(F.col("rid").alias("mail_id"), "pos", F.col("ioc_type").alias("type"), F.col("ioc_value").alias("value"), "suppkey")
    people = m.filter("pos = 2").select("mail_id", F.concat(F.lit("Jo@Update"), (F.col("suppkey") % 13).cast("string"), F.lit(".top")).alias("address"))
    articles = m.filter("pos = 4 and type = 'domain'").select("mail_id", F.concat(F.lit("https://"), F.lower("value"), F.lit("/a")).alias("url"), F.col("value").alias("host"))
    return re_.mail_indicators(m.drop("suppkey"), people, articles).select("mail_id", "pos", "value")


@query("u01_discovered", """
    WITH c AS (SELECT doc_id, doc_id % 9 AS s, doc_id % 50 = 7 AS seeded, doc_id % 3 = 0 AS fed, concat('https://', source, '.example.org/post/', cast(doc_id % 700 AS STRING)) AS canonical FROM documents),
    e AS (SELECT doc_id, canonical, 'seed' AS origin, 0 AS o, 100 AS score FROM c WHERE seeded UNION ALL SELECT doc_id, canonical, 'vendor_feed', 1, s + 10 FROM c WHERE fed AND s >= 3 UNION ALL SELECT doc_id, canonical, 'web', 2, s FROM c)
    SELECT doc_id AS source_id, canonical, origin, cast(score AS BIGINT) AS score FROM e QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY o, score DESC, doc_id) = 1""")
def discovered(t):
    rows = t.reports.select(F.col("doc_id").alias("source_id"), "url", (F.col("doc_id") % 9).alias("score"))
    return re_.discovered(rows.filter("source_id % 50 = 7"), rows.filter("source_id % 3 = 0"), rows)


@query("ss04_cve_states", """
    WITH c AS (SELECT cve, max(seen_at) AS seen, max(quantity) AS v FROM mentions GROUP BY cve), k AS (SELECT *, cast(right(cve, 4) AS INT) AS n FROM c),
    s AS (SELECT *, CASE WHEN n % 4 <> 0 AND seen > TIMESTAMP '1998-11-01' - INTERVAL 24 HOUR THEN 'fresh' WHEN n % 3 = 0 THEN 'fetched' WHEN n % 4 <> 0 THEN 'stale' ELSE 'unavailable' END AS state FROM k)
    SELECT cve, state, CASE state WHEN 'fetched' THEN -1.0 WHEN 'unavailable' THEN NULL ELSE cast(v AS DOUBLE) END AS value FROM s""")
def cve_states(t):
    all_ = t.mentions.groupBy("cve").agg(F.max("seen_at").alias("fetched_at"), F.max("quantity").cast("double").alias("value"))
    n = F.right("cve", F.lit(4)).cast("int")
    return re_.cached_or_stale(t.mentions, all_.filter(n % 4 != 0), all_.filter(n % 3 == 0).select("cve", F.lit(-1.0).alias("value")), F.lit("1998-11-01").cast("timestamp_ntz"))


SCORED = f"""{CLUSTERS}, m AS (SELECT id, min(seen) AS cluster_id FROM c GROUP BY id),
    s AS (SELECT cluster_id, count(DISTINCT publisher) AS p, bool_or(doc_id % 3 = 0) AS v, bool_or(reliability = 'A') AS o, bool_or(doc_id % 5 = 0) AS n, max(published) >= TIMESTAMP '2024-02-08 12:00:00' AS f, max(published) AS newest FROM reports JOIN m ON id = doc_id GROUP BY cluster_id),
    r AS (SELECT cluster_id, newest, 3 * p + CASE WHEN v THEN 2 ELSE 0 END + CASE WHEN o THEN 2 ELSE 0 END + CASE WHEN n THEN 1 ELSE 0 END + CASE WHEN f THEN 1 ELSE 0 END AS score,
      concat_ws('; ', CASE WHEN p > 1 THEN concat('reported by ', cast(p AS STRING), ' publishers') END, CASE WHEN v THEN 'names a CVE' END, CASE WHEN o THEN 'government advisory' END, CASE WHEN n THEN 'named actor or malware' END, CASE WHEN f THEN 'published in the last 12 h' END) AS why FROM s)"""


def _ranked(t):
    a = _articles(t)
    return gr.ranked_clusters(a, gr.clusters(gr.article_keys(a)), F.lit("2024-02-09 00:00:00").cast("timestamp_ntz"))


@query("r02_cluster_scores", f"{SCORED} SELECT cluster_id, score, why FROM r")
def cluster_scores(t):
    return _ranked(t).select("cluster_id", "score", F.array_join("why", "; ").alias("why"))


@query("t03_digest", f"{SCORED} SELECT cluster_id, score FROM r ORDER BY score DESC, newest DESC, cluster_id LIMIT 10")
def digest(t):
    return _ranked(t).orderBy(F.desc("score"), F.desc("newest"), "cluster_id").limit(10).select("cluster_id", "score")


@query("t04_groups", """
    WITH r AS (SELECT 'research' AS type, research_id AS key, title, search_text AS text, epoch(updated_at) AS recent, 6 AS most FROM research WHERE status <> 'archived' UNION ALL SELECT 'actor', actor_id, name, concat_ws(' ', aliases[1], aliases[2]), NULL, 5 FROM actors
      UNION ALL SELECT 'query', query_id, title, NULL, NULL, 5 FROM queries),
    h AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY CASE WHEN lower(title) = 'actor7' OR lower(key) = 'actor7' THEN 0 WHEN starts_with(lower(key), 'actor7') THEN 1 ELSE 2 END, recent DESC NULLS LAST, title, key) AS rank FROM r
      WHERE contains(lower(title), 'actor7') OR contains(lower(key), 'actor7') OR contains(lower(coalesce(text, '')), 'actor7'))
    SELECT type, key, title, rank FROM h WHERE rank <= most""")
def search_groups(t):
    kind = lambda rows, name, key, title, text, recent: rows.select(F.lit(name).alias("type"), F.col(key).alias("key"), F.col(title).alias("title"), text.cast("string").alias("text"), recent.cast("double").alias("recent"))
    none = F.lit(None)
    rows = kind(t.research.filter("status <> 'archived'"), "research", "research_id", "title", F.col("search_text"), F.unix_micros(F.col("updated_at").cast("timestamp")))
    rows = rows.unionByName(kind(t.actors, "actor", "actor_id", "name", F.array_join("aliases", " "), none)).unionByName(kind(t.queries, "query", "query_id", "title", none, none))
    return se.groups(rows, " Actor7", {"research": 6, "actor": 5, "query": 5})


@query("k07_append_log", "SELECT event_id, path FROM access")
def append_log(t):
    rows = t.access
    path = writers.folder(rows.sparkSession, "log")
    writers.append_log(rows.filter("method = 'POST'"), path)
    writers.append_log(rows.filter("method <> 'POST'"), path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select("event_id", "path")


@query("p41_technique_names", """
    WITH c AS (SELECT technique_id, min(tactic_id) AS tactic_id FROM mentions GROUP BY 1)
    SELECT DISTINCT rid AS research_id, CASE WHEN partkey % 2 = 0 THEN concat(technique_id, '.001') ELSE technique_id END AS technique_id, c.tactic_id, concat('Parent ', technique_id) AS technique, CASE WHEN partkey % 2 = 0 THEN concat('Child: ', technique_id) ELSE '' END AS sub_technique
    FROM mentions JOIN c USING (technique_id)""")
def technique_names(t):
    m = t.mentions
    top = m.groupBy("technique_id").agg(F.array(F.min("tactic_id")).alias("tactics"))
    parent = F.concat(F.lit("Parent "), "technique_id")
    child = top.select(F.concat("technique_id", F.lit(".001")).alias("technique_id"), F.concat(parent, F.lit(": Child: "), "technique_id").alias("name"), "tactics")
    catalogue = top.select("technique_id", parent.alias("name"), "tactics").unionByName(child)
    named = F.when(F.col("partkey") % 2 == 0, F.concat("technique_id", F.lit(".001"))).otherwise(F.col("technique_id"))
    rows = m.select(_rid(), named.alias("technique_id"), F.lit("TA999").alias("tactic_id"), F.col("pos").alias("idx"), F.col("quote").alias("procedure"))
    out = rk.mitre_rows(rows, catalogue, m.select("tactic_id").distinct().withColumn("pos", F.lit(1)))
    return out.select("research_id", "technique_id", "tactic_id", "technique", "sub_technique")


@query("ss09_budget_alerts", """
    WITH r AS (SELECT concat('user', cast(user_id AS STRING)) AS key, ts, event_id, CASE WHEN value >= 100 THEN 2 WHEN value >= 40 THEN 1 ELSE 0 END AS rank FROM telemetry), g AS (SELECT key, ts, max(rank) AS rank FROM r GROUP BY ALL),
    b AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT key, epoch(ts) AS at_s, rank FROM b WHERE rank > before""")
def budget_alerts(t):
    rank = F.when(F.col("value") >= 100, 2).when(F.col("value") >= 40, 1).otherwise(0)
    rows = t.telemetry.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("at"), rank.alias("rank"))
    return st.run_budgets(rows.groupBy("key", "at").agg(F.max("rank").alias("rank"))).select("key", (F.unix_micros("at") / 1e6).alias("at_s"), "rank")
