"""Queries of the provenance of detections and of patterns in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import joins
from ..operators import provenance as pv
from ..operators import specs as sp
from ..sources import writers
from .registry import query

#: Sections of records, made of the derived tables by the same expressions on both sides.
SECTIONS = {
    "opps": """SELECT rid AS research_id, qid AS pos, concat(CASE WHEN qid % 2 = 0 THEN 'DO-' ELSE 'X-' END, cast(qid % 5 AS STRING)) AS opportunity_id, concat('AP-1.', cast(qid % 9 AS STRING)) AS behaviour_ref, {technique_id|second_id} AS techniques,
      CASE WHEN qid % 7 = 0 THEN {'S3'|'S11'} END AS source_ids FROM queries WHERE qid % 3 = 0""",
    "steps": "SELECT rid AS research_id, pos, concat('AP-1.', cast(pos AS STRING)) AS ref, CASE WHEN partkey % 4 = 0 THEN {} ELSE {source_id|'S2'} END AS source_ids FROM {said}",
    "ioas": "SELECT rid AS research_id, pos, concat('AP-1.', cast(pos + 4 AS STRING)) AS ioa_id, {source_id|'S12'} AS source_ids FROM {said}",
    "mitre": "SELECT rid AS research_id, technique_id, {source_id|''} AS source_ids FROM {said}",
    "iocs": "SELECT rid AS research_id, pos, ioc_type AS type, replace(ioc_value, '.', '[.]') AS value, {source_id} AS source_ids FROM {said}",
    "vulns": "SELECT rid AS research_id, pos, cve, {source_id|'S1'} AS source_ids FROM {said}",
    "hunts": """SELECT rid AS research_id, qid AS pos, query_id, CASE qid % 4 WHEN 1 THEN concat('DO-', cast(qid % 5 AS STRING)) WHEN 3 THEN '' END AS opportunity_id, origin, CASE WHEN qid % 11 < 2 THEN 'vuln' ELSE type END AS type,
      CASE qid % 6 WHEN 0 THEN 'derived' WHEN 1 THEN 'odd' END AS provenance, CASE WHEN qid % 13 = 0 THEN 'VREF-9' WHEN qid % 17 = 0 THEN 'own' WHEN qid % 5 = 0 THEN '' END AS group_id,
      concat(substring(title, 1, 7), CASE WHEN qid % 14 = 0 THEN ' (vendor, S4)' ELSE '' END) AS title, CASE qid % 5 WHEN 0 THEN {'network'} WHEN 1 THEN {'dns'} WHEN 2 THEN {'file_hash'|'dns'} WHEN 3 THEN {'web'} END AS data_sources,
      {technique_id|second_id} AS techniques, CASE WHEN qid % 19 = 0 THEN {'S8'} END AS source_ids, body FROM queries""",
}


#: A mention for each research and position.
SAID = "(SELECT rid, pos, max(source_id) AS source_id, max(technique_id) AS technique_id, max(ioc_type) AS ioc_type, max(ioc_value) AS ioc_value, max(cve) AS cve, max(partkey) AS partkey FROM mentions GROUP BY rid, pos)"


def _sql(name: str, spark: bool) -> str:
    import re

    def one(m: re.Match) -> str:
        items = m[1].replace("|", ", ")
        if spark:
            return f"array({items})" if items else "cast(array() AS array<string>)"
        return f"[{items}]" if items else "[]::VARCHAR[]"

    return re.sub(r"\{([^{}]*)\}", one, SECTIONS[name].replace("{said}", SAID))


def _section(t, name: str) -> DataFrame:
    base = "queries" if "FROM queries" in SECTIONS[name] else "mentions"
    rows = getattr(t, base)
    rows.createOrReplaceTempView(f"_section_{base}")
    return rows.sparkSession.sql(_sql(name, True).replace(f"FROM {base}", f"FROM _section_{base}"))


def _with(*names: str) -> str:
    return ", ".join(f"{n} AS ({_sql(n, False)})" for n in names)


NATURAL = "(CASE WHEN regexp_replace({x}, '\\D', '', 'g') = '' THEN 0 ELSE cast(regexp_replace({x}, '\\D', '', 'g') AS BIGINT) END), {x}"
_NAT = NATURAL.format(x="s")


@query("j17_provenance_backfill", rf"""
    WITH {_with("opps", "steps", "mitre", "iocs", "vulns", "hunts")},
    lo AS (SELECT * FROM opps QUALIFY row_number() OVER (PARTITION BY research_id, opportunity_id ORDER BY pos DESC) = 1),
    ls AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY research_id, ref ORDER BY pos DESC) = 1),
    lt AS (SELECT research_id, opportunity_id, list(s ORDER BY {_NAT}) AS x FROM (SELECT DISTINCT research_id, opportunity_id, unnest(m.source_ids) AS s FROM (SELECT research_id, opportunity_id, unnest(techniques) AS technique_id FROM lo) JOIN mitre m USING (research_id, technique_id)) WHERE s <> '' GROUP BY ALL),
    sx AS (SELECT research_id, ref, list(s ORDER BY {_NAT}) AS x FROM (SELECT DISTINCT research_id, ref, unnest(source_ids) AS s FROM ls) GROUP BY ALL),
    o AS (SELECT lo.research_id, lo.opportunity_id, coalesce(lo.source_ids, sx.x, lt.x, []::VARCHAR[]) AS opp FROM lo LEFT JOIN sx ON sx.research_id = lo.research_id AND sx.ref = lo.behaviour_ref LEFT JOIN lt ON lt.research_id = lo.research_id AND lt.opportunity_id = lo.opportunity_id),
    a AS (SELECT h.* REPLACE (CASE WHEN h.provenance IN ('vendor', 'derived', 'generic') THEN h.provenance WHEN h.origin = 'reference' THEN 'vendor' WHEN h.type = 'ttp' AND opp IS NULL THEN 'generic' ELSE 'derived' END AS provenance), opp,
      count(*) FILTER (group_id LIKE 'VREF-%') OVER (PARTITION BY h.research_id) AS there, coalesce(group_id, '') = '' AS lacks FROM hunts h LEFT JOIN o ON o.research_id = h.research_id AND o.opportunity_id = nullif(h.opportunity_id, '')),
    k AS (SELECT *, CASE WHEN opp IS NOT NULL THEN 'o' WHEN provenance = 'vendor' THEN 'v' WHEN type = 'ioc' THEN 'i' WHEN type = 'vuln' THEN 'c' ELSE 't' END AS k FROM a),
    f AS (SELECT research_id, title, row_number() OVER (PARTITION BY research_id ORDER BY min(pos)) AS ttp FROM k WHERE k = 't' AND lacks GROUP BY research_id, title),
    n AS (SELECT k.*, ttp, there + sum(CASE WHEN k = 'v' AND lacks THEN 1 ELSE 0 END) OVER (PARTITION BY k.research_id ORDER BY pos) AS vref FROM k LEFT JOIN f ON f.research_id = k.research_id AND f.title = k.title AND k = 't' AND lacks),
    it AS (SELECT research_id, c, list(s ORDER BY {_NAT}) AS x FROM (SELECT DISTINCT research_id, CASE WHEN type = 'ipv4' THEN 'network' WHEN type = 'domain' THEN 'dns' ELSE 'file_hash' END AS c, unnest(source_ids) AS s FROM iocs) GROUP BY ALL),
    vt AS (SELECT research_id, list(s ORDER BY {_NAT}) AS x FROM (SELECT DISTINCT research_id, unnest(source_ids) AS s FROM vulns) GROUP BY ALL),
    tt AS (SELECT research_id, pos, list(s ORDER BY {_NAT}) AS x FROM (SELECT DISTINCT q.research_id, q.pos, unnest(m.source_ids) AS s FROM (SELECT research_id, pos, unnest(techniques) AS technique_id FROM n) q JOIN mitre m USING (research_id, technique_id)) WHERE s <> '' GROUP BY ALL)
    SELECT n.research_id, n.pos, query_id, provenance,
      CASE WHEN NOT lacks THEN group_id WHEN k = 'o' THEN concat('DET-', CASE WHEN opportunity_id LIKE 'DO-%' THEN substring(opportunity_id, 4) ELSE opportunity_id END) WHEN k = 'v' THEN concat('VREF-', vref)
        WHEN k = 'i' THEN concat('IOC-', CASE coalesce(data_sources[1], 'network') WHEN 'network' THEN 'IPV4' WHEN 'dns' THEN 'DOMAIN' WHEN 'file_hash' THEN 'SHA256' ELSE upper(data_sources[1]) END) WHEN k = 'c' THEN 'VULN-1' ELSE concat('TTP-', ttp) END AS group_id,
      coalesce(n.source_ids, CASE k WHEN 'o' THEN opp WHEN 'v' THEN CASE WHEN title LIKE '%(vendor, S4)%' THEN ['S4'] END WHEN 'i' THEN it.x WHEN 'c' THEN vt.x ELSE tt.x END, []::VARCHAR[]) AS source_ids
    FROM n LEFT JOIN it ON it.research_id = n.research_id AND it.c = n.data_sources[1] LEFT JOIN vt ON vt.research_id = n.research_id LEFT JOIN tt ON tt.research_id = n.research_id AND tt.pos = n.pos""")
def backfill(t):
    return pv.backfilled(*[_section(t, n) for n in ("hunts", "opps", "steps", "mitre", "iocs", "vulns")])


#: Bodies that hold values of their research: indicators of every second position in upper case, and one CVE in the title.
BODIES = """bodies AS (SELECT h.research_id, h.query_id, h.opportunity_id, h.type, h.source_ids, concat(h.title, ' ', coalesce(max(CASE WHEN m.pos % 3 = 1 THEN cve END), '')) AS title,
      concat(any_value(h.body), ' in (', coalesce(array_to_string(list(upper(ioc_value) ORDER BY m.pos) FILTER (m.pos % 2 = h.pos % 2), ', '), ''), ') ', coalesce(max(CASE WHEN m.pos % 3 = 2 THEN lower(cve) END), '')) AS body
    FROM hunts h LEFT JOIN {said} m ON m.rid = h.research_id GROUP BY h.research_id, h.query_id, h.opportunity_id, h.type, h.source_ids, h.title)""".replace("{said}", SAID)


@query("j18_inferred_sources", f"""
    WITH {_with("opps", "steps", "ioas", "iocs", "vulns", "hunts")}, {BODIES},
    fo AS (SELECT * FROM opps QUALIFY row_number() OVER (PARTITION BY research_id, opportunity_id ORDER BY pos) = 1),
    o AS (SELECT fo.research_id, fo.opportunity_id, CASE WHEN len(fo.source_ids) > 0 THEN fo.source_ids ELSE concat(coalesce(s.source_ids, []), coalesce(i.source_ids, [])) END AS opp FROM fo LEFT JOIN steps s ON s.research_id = fo.research_id AND s.ref = behaviour_ref LEFT JOIN ioas i ON i.research_id = fo.research_id AND ioa_id = behaviour_ref),
    e AS (SELECT b.*, opp FROM bodies b LEFT JOIN o ON o.research_id = b.research_id AND o.opportunity_id = nullif(b.opportunity_id, '')),
    h AS (SELECT e.research_id, query_id, i.pos, i.source_ids AS x FROM e JOIN iocs i ON i.research_id = e.research_id AND e.type = 'ioc' AND contains(lower(body), lower(replace(value, '[.]', '.')))
      UNION ALL SELECT e.research_id, query_id, v.pos, v.source_ids FROM e JOIN vulns v ON v.research_id = e.research_id AND e.type = 'vuln' AND contains(concat(title, ' ', body), cve)),
    g AS (SELECT research_id, query_id, flatten(list(x ORDER BY pos)) AS x FROM h GROUP BY ALL)
    SELECT e.research_id, e.query_id, coalesce(e.source_ids, list_filter(y, lambda v, k: list_position(y, v) = k)) AS source_ids FROM (SELECT e.*, coalesce(opp, g.x, []::VARCHAR[]) AS y FROM e LEFT JOIN g ON g.research_id = e.research_id AND g.query_id = e.query_id) e""")
def inferred(t):
    hunts = _section(t, "hunts")
    asked = joins.small(hunts.select(F.col("research_id").alias("rid")).distinct())
    named = t.mentions.join(asked, "rid", "left_semi").groupBy(F.col("rid").alias("research_id"), F.col("pos").alias("at")).agg(F.max("ioc_value").alias("ioc_value"), F.max("cve").alias("cve"))
    rows = hunts.join(named, "research_id", "left").groupBy("research_id", "query_id", "opportunity_id", "type", "source_ids", "title", "pos", "body").agg(
        F.max(F.when(F.col("at") % 3 == 1, F.col("cve"))).alias("one"), F.max(F.when(F.col("at") % 3 == 2, F.lower("cve"))).alias("low"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at") % 2 == F.col("pos") % 2, F.struct("at", F.upper("ioc_value").alias("v"))))), lambda x: x["v"]), ", ").alias("values"),
    )
    blank = lambda c: F.coalesce(c, F.lit(""))
    bodies = rows.select("research_id", "query_id", "opportunity_id", "type", "source_ids", F.concat("title", F.lit(" "), blank("one")).alias("title"), F.concat("body", F.lit(" in ("), blank("values"), F.lit(") "), blank("low")).alias("body"))
    return pv.inferred_sources(writers.stored(bodies, "bodies"), *[_section(t, n) for n in ("opps", "steps", "ioas", "iocs", "vulns")])


#: A specification of each part: what it looks for and where; some share literals, some hold empty or short ones.
SPECS = """SELECT concat('spec', cast(p_partkey AS STRING)) AS spec_id, CASE p_partkey % 4 WHEN 0 THEN 'process_creation' WHEN 1 THEN 'web' WHEN 2 THEN 'dns' ELSE 'network' END AS category, 'all' AS k,
      CASE p_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'url_path' WHEN 2 THEN 'domain' ELSE 'dst_ip' END AS f1,
      CASE p_partkey % 4 WHEN 0 THEN 'endswith' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'startswith' ELSE 'equals' END WHEN 2 THEN CASE WHEN p_size % 3 = 0 THEN 'startswith' ELSE 'contains' END ELSE CASE WHEN p_size % 2 = 0 THEN 'equals' ELSE 'contains' END END AS o1,
      CASE p_partkey % 4 WHEN 0 THEN CASE p_size % 3 WHEN 0 THEN '\\CMD.exe' WHEN 1 THEN '\\PowerShell.EXE' ELSE '' END
        WHEN 1 THEN concat('/Layouts/', cast(p_size % 9 AS STRING), CASE WHEN p_size % 2 = 0 THEN '' ELSE '/start.aspx' END)
        WHEN 2 THEN concat(CASE WHEN p_size % 3 = 0 THEN 'cdn' ELSE '' END, cast(p_partkey % 97 AS STRING), CASE WHEN p_size % 3 = 1 THEN concat('.UPDATE', cast(p_size % 13 AS STRING), '.to') ELSE '' END)
        ELSE concat('45.', cast(p_partkey % 200 AS STRING), CASE WHEN p_size % 2 = 0 THEN concat('.', cast(p_size AS STRING), '.7') ELSE '.1' END) END AS v1,
      CASE p_partkey % 4 WHEN 0 THEN 'command_line' WHEN 1 THEN 'host' WHEN 2 THEN 'host' ELSE 'no_such_field' END AS f2, CASE p_partkey % 4 WHEN 0 THEN 'contains' ELSE 'endswith' END AS o2,
      CASE p_partkey % 4 WHEN 0 THEN concat(CASE WHEN p_size % 2 = 0 THEN '-ENC {"k": ' ELSE '' END, cast(p_partkey % 100 AS STRING)) ELSE cast(p_size % 10 AS STRING) END AS v2
    FROM part"""


def _literal(sql: str) -> str:
    """Spark reads backslashes in plain literals as escapes."""
    return sql.replace("'\\", "r'\\")


def spec_rows(t) -> DataFrame:
    t.part.createOrReplaceTempView("_section_part")
    raw = t.part.sparkSession.sql(_literal(SPECS.replace("FROM part", "FROM _section_part")))
    one = lambda f, o, *v: F.struct(F.col(f).alias("field"), F.col(o).alias("op"), F.array(*v).alias("values"))
    # Network specifications name a field that events lack; two of ten do without it and run.
    first, second = one("f1", "o1", F.col("v1")), one("f2", "o2", F.col("v2"), F.when(F.col("category") == "web", F.lit("HOST1")))
    both = F.when(F.col("category") != "network", F.array(first, second)).when(F.col("v2").isin("1", "4"), F.array(first)).otherwise(F.array(second))
    return raw.select("spec_id", "category", both.alias("conditions"))


SPEC_INDEX = f"""
    WITH s AS ({SPECS}), e AS (SELECT *, map {{'image': lower(image), 'url_path': lower(url_path), 'domain': lower(domain), 'dst_ip': lower(dst_ip), 'command_line': lower(command_line), 'host': lower(host)}} AS m FROM telemetry),
    c AS (SELECT event_id, spec_id, lower(v1) AS a, lower(v2) AS b, m[f1] AS x, m[f2] AS y, o1, o2, p.v3 AS w FROM e JOIN (SELECT *, CASE WHEN category = 'web' THEN 'host1' END AS v3 FROM s WHERE category <> 'network' OR f1 <> 'dst_ip' OR v2 IN ('1', '4')) p USING (category))
    SELECT event_id, spec_id FROM c WHERE CASE o1 WHEN 'equals' THEN x = a WHEN 'startswith' THEN starts_with(x, a) WHEN 'endswith' THEN ends_with(x, a) ELSE contains(x, a) END
      AND CASE WHEN o2 = 'contains' THEN contains(y, b) WHEN y IS NULL THEN TRUE ELSE ends_with(y, b) OR coalesce(ends_with(y, w), FALSE) END"""


@query("f10_spec_index", SPEC_INDEX)
def spec_index(t):
    return sp.matches(t.telemetry, spec_rows(t)).select("event_id", "spec_id")


@query("x01_trigram_index", """
    SELECT rid FROM (SELECT rid, CASE WHEN rid % 7 = 0 THEN concat('moved ', search_text) ELSE search_text END AS x FROM research WHERE rid % 11 <> 0
      UNION ALL SELECT -1 - rid, concat(search_text, ' moved actor7 1') FROM research WHERE rid % 5 = 0) WHERE contains(x, 'actor7 1')""")
def trigram_index(t):
    """An index written once, then texts changed, ids removed and new ones put, and one search."""
    rows = t.research.select("rid", "search_text")
    folder = writers.folder(rows.sparkSession, "trigrams")
    ix.create(rows, "rid", "search_text", folder)
    changed = rows.filter("rid % 7 = 0").withColumn("search_text", F.concat(F.lit("moved "), "search_text"))
    ix.put(changed, "rid", "search_text", folder)
    ix.remove(rows.filter("rid % 11 = 0"), "rid", folder)
    fresh = rows.filter("rid % 5 = 0").select((-1 - F.col("rid")).alias("rid"), F.concat("search_text", F.lit(" moved actor7 1")).alias("search_text"))
    ix.put(fresh, "rid", "search_text", folder)
    now = rows.join(changed.select("rid"), "rid", "left_anti").unionByName(changed).unionByName(fresh)
    return ix.search(now, "rid", "search_text", folder, "Actor7 1").select("rid")
