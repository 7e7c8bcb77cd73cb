"""Queries of scans, normalisers, predicates and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import text as tx
from ..functions import urls as ul
from ..operators import extract as ex
from ..operators import ranking as rk
from ..sources import fixed
from ..sources import readers as rd
from .registry import query

RE2_WORDS = r"[^a-z0-9]+"


@query("s01_feed_items", """
    SELECT doc_id, canonical FROM (
      SELECT doc_id, concat('https://', regexp_replace(split_part(split_part(url, '://', 2), '/', 1), '^www\\.', ''), '/post/', cast(doc_id % 700 AS STRING)) AS canonical,
        row_number() OVER (PARTITION BY doc_id % 700 ORDER BY publisher, doc_id) AS n, publisher
      FROM (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY doc_id) AS k FROM reports) WHERE k <= 60 AND published >= TIMESTAMP '2024-01-10' AND trim(title) <> '')
    QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY publisher, doc_id) = 1""")
def feed_items(t):
    items = t.reports.select("doc_id", F.col("publisher").alias("feed"), F.col("doc_id").alias("pos"), "url", "title", "published", F.col("text").alias("summary"))
    return rk.feed_items(items, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("doc_id", "canonical")


@query("s02_articles", """
    SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE substring(sha256(text), 1, 16) END AS content_hash, length(substring(text, 1, 150000)) AS n FROM documents""")
def articles(t):
    return rd.articles(t.documents).select("doc_id", "content_hash", F.length("text").alias("n"))


@query("s03_page_text")
def page_text(t):
    return t.pages.select("page_id", ul.page_text(F.col("html")).alias("text"), F.size(ul.page_links(F.col("html"))).cast("long").alias("n_links"))


@query("s03_page_links", r"""
    SELECT page_id, len(regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["'']([^"'']+)["''][^>]*>.*?</a\s*>', 1)) AS n_links FROM pages""")
def page_links(t):
    return t.pages.select("page_id", F.size(ul.page_links(F.col("html"))).cast("long").alias("n_links"))


@query("s04_error_pages", """
    SELECT doc_id FROM documents WHERE NOT (length(text) < 300 OR (regexp_matches(substring(text, 1, 1500), '(?i)(NoSuchKey|AccessDenied|404 (- *)?Not Found|Page not found|Just a moment)') AND length(text) < 4000))""")
def readable(t):
    return t.documents.filter(~ul.is_error_page(F.col("text"))).select("doc_id")


@query("s05_kev_catalogue", """
    SELECT cve, max(date_added) AS date_added FROM (SELECT upper(cve) AS cve, cast(seen_at AS DATE) AS date_added FROM mentions) GROUP BY cve""")
def kev(t):
    day = F.date_format("seen_at", "yyyy-MM-dd")
    feed = t.mentions.groupBy("rid").agg(F.collect_list(F.struct(F.lower("cve").alias("cveID"), day.alias("dateAdded"))).alias("vulnerabilities")).select(F.to_json(F.struct("vulnerabilities")).alias("json"), F.col("rid").alias("release"))
    return rd.kev(feed, last=F.struct("date_added", "release")).select("cve", F.col("date_added").cast("date").alias("date_added"))


@query("s06_epss_scores", """
    SELECT cve, max(discount) AS epss FROM mentions WHERE rid % 5 <> 0 GROUP BY cve""")
def epss(t):
    score = F.when(F.col("rid") % 5 != 0, F.col("discount").cast("string")).otherwise("n/a")
    feed = t.mentions.groupBy("rid").agg(F.collect_list(F.struct("cve", score.alias("epss"), F.lit("0.5").alias("percentile"), F.lit("2024-01-01").alias("date"))).alias("data")).select(F.to_json(F.struct("data")).alias("json"))
    return rd.epss(feed).groupBy("cve").agg(F.max("epss").alias("epss"))


@query("s07_nvd_entries", """
    SELECT rid, concat('CVE-2024-', cast(1000 + rid % 211 AS STRING)) AS cve, CASE WHEN rid % 2 = 0 THEN 7.5 ELSE 5.0 END AS score, CASE WHEN rid % 2 = 0 THEN '3.1' ELSE '2.0' END AS version, ['CWE-79', 'CWE-89'] AS cwes FROM research""")
def nvd(t):
    v31 = F.array(F.struct(F.lit("Secondary").alias("type"), F.struct(F.lit(1.0).alias("baseScore"), F.lit("3.1").alias("version")).alias("cvssData")), F.struct(F.lit("Primary").alias("type"), F.struct(F.lit(7.5).alias("baseScore"), F.lit("3.1").alias("version")).alias("cvssData")))
    v2 = F.array(F.struct(F.lit("Secondary").alias("type"), F.struct(F.lit(5.0).alias("baseScore"), F.lit("2.0").alias("version")).alias("cvssData")))
    metrics = F.struct(F.when(F.col("rid") % 2 == 0, v31).alias("cvssMetricV31"), v2.alias("cvssMetricV2"))
    weak = F.array(F.struct(F.array(*[F.struct(F.lit("en").alias("lang"), F.lit(x).alias("value")) for x in ("CWE-89", "NVD-CWE-Other", "CWE-79", "CWE-89")]).alias("description")))
    cve = F.struct(F.concat(F.lit("CVE-2024-"), (1000 + F.col("rid") % 211).cast("string")).alias("id"), metrics.alias("metrics"), weak.alias("weaknesses"))
    feed = t.research.select("rid", F.to_json(F.struct(F.array(F.struct(cve.alias("cve"))).alias("vulnerabilities"))).alias("json"))
    return rd.nvd(feed, ["rid"]).select("rid", "cve", "score", "version", "cwes")


@query("s08_technique_bundle", """
    SELECT suppkey AS id, concat('T', cast(1000 + suppkey AS STRING), '.001') AS technique_id, concat('Parent ', cast(suppkey AS STRING), ': Sub') AS name, ['TA0002'] AS tactics
    FROM (SELECT s_suppkey AS suppkey FROM supplier) WHERE suppkey % 4 <> 0""")
def bundle(t):
    n = F.col("s_suppkey").cast("string")
    ref = lambda x: F.array(F.struct(F.lit("mitre-attack").alias("source_name"), x.alias("external_id")))
    phase = F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.lit("execution").alias("phase_name")))
    obj = lambda name, tid, gone: F.struct(F.lit("attack-pattern").alias("type"), name.alias("name"), gone.alias("revoked"), ref(tid).alias("external_references"), phase.alias("kill_chain_phases"))
    tid = (1000 + F.col("s_suppkey")).cast("string")
    objects = F.array(obj(F.concat(F.lit("Parent "), n), F.concat(F.lit("T"), tid), F.lit(False)), obj(F.lit("Sub"), F.concat(F.lit("T"), tid, F.lit(".001")), F.col("s_suppkey") % 4 == 0))
    feed = t.supplier.select(F.col("s_suppkey").alias("id"), F.to_json(F.struct(objects.alias("objects"))).alias("json"))
    return rd.attack_bundle(feed, ["id"]).filter(F.col("technique_id").contains("."))


@query("s09_catalogue", """
    SELECT tactic_id, count(*) AS n FROM (SELECT DISTINCT technique_id, tactic_id FROM mentions) GROUP BY tactic_id""")
def catalogue(t):
    synced = t.mentions.groupBy("technique_id").agg(F.lit("").alias("name"), F.collect_set("tactic_id").alias("tactics"))
    return rd.with_fallback(synced, rd.techniques(synced.sparkSession)).select("technique_id", F.explode("tactics").alias("tactic_id")).groupBy("tactic_id").agg(F.count("*").alias("n"))


@query("s10_table_scan", "SELECT rid, status, severity FROM research WHERE price > 200000")
def scan(t):
    return t.research.filter("price > 200000").select("rid", "status", "severity")


@query("s11_sections", "SELECT rid, pos, technique_id, source_id FROM mentions")
def sections(t):
    record = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "technique_id", "source_id"))), lambda x: x.withField("source_ids", F.array(x["source_id"]))).alias("mitre")))
    nested = t.mentions.groupBy("rid").agg(record.alias("record"))
    rows = rd.section(nested, "mitre", "array<struct<pos:int,technique_id:string,source_ids:array<string>>>", keep=["rid"])
    return rows.select("rid", "item.pos", "item.technique_id", F.explode("item.source_ids").alias("source_id"))


@query("s12_first_texts", """
    SELECT source_id, min(rid) AS rid, arg_min(quote, (rid, pos)) AS text FROM mentions GROUP BY source_id""")
def first_texts(t):
    return rk.first_by_key(t.mentions, ["source_id"], [F.asc("rid"), F.asc("pos")]).select("source_id", "rid", F.col("quote").alias("text"))


@query("s13_step_index", """
    SELECT rid, CASE WHEN pos % 2 = 0 THEN concat('R', cast(pos AS STRING)) ELSE concat('AP-1.', cast(row_number() OVER (PARTITION BY rid ORDER BY pos, technique_id) AS STRING)) END AS ref, technique_id FROM mentions""")
def step_index(t):
    step = F.struct(F.when(F.col("pos") % 2 == 0, F.concat(F.lit("R"), F.col("pos").cast("string"))).alias("ref"), "technique_id")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("pos", "technique_id", step.alias("step")))), lambda x: x["step"])
    paths = t.mentions.groupBy("rid").agg(F.array(F.struct(steps.alias("steps"))).alias("paths"))
    return rd.steps(paths, "paths", keep=["rid"]).select("rid", "ref", "step.technique_id")


@query("p01_refang", """
    SELECT doc_id, regexp_replace(regexp_replace(link, '(?i)hxxp', 'http', 'g'), '\\[\\.\\]', '.', 'g') AS plain FROM (SELECT doc_id, regexp_extract(text, 'hxxps://[^ ]+', 0) AS link FROM reports)""")
def refang(t):
    return t.reports.select("doc_id", tx.refang(F.regexp_extract("text", "hxxps://[^ ]+", 0)).alias("plain"))


@query("p02_defang", """
    SELECT rid, pos, CASE ioc_type WHEN 'ipv4' THEN regexp_replace(ioc_value, '\\.([^.]*)$', '[.]\\1') WHEN 'domain' THEN replace(ioc_value, '.', '[.]') ELSE ioc_value END AS shown FROM mentions""")
def defang(t):
    return t.mentions.select("rid", "pos", tx.defang(F.col("ioc_value"), F.col("ioc_type")).alias("shown"))


@query("p03_types", "SELECT ioc_type AS type, count(*) AS n FROM mentions GROUP BY 1")
def types(t):
    return t.mentions.groupBy(ind.kind_of(F.col("ioc_value")).alias("type")).agg(F.count("*").alias("n"))


@query("p04_known_good", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Empty file (MD5)' END AS label FROM documents""")
def known_good(t):
    return t.documents.select("doc_id", ind.known_good(F.when(F.col("doc_id") % 3 == 0, F.lit(" D41D8CD98F00B204E9800998ECF8427E")).otherwise(F.md5(F.col("doc_id").cast("string")))).alias("label"))


@query("p05_allowed_domains", "SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) LIKE '%.example.%' AND NOT split_part(split_part(url, '://', 2), '/', 1) LIKE '%.example.co%m.%' AS allowed FROM pages")
def allowed(t):
    return t.pages.select("page_id", ul.under(ul.host(F.col("url")), fixed.ALLOWED_DOMAINS).alias("allowed"))


@query("p06_public_v4", """
    SELECT event_id, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19))) AS is_public
    FROM (SELECT event_id, event_id % 256 AS a, user_id % 256 AS b FROM events)""")
def public_v4(t):
    ip = F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("7"), F.lit("7"))
    return t.events.select("event_id", ind.public_v4(ip).alias("is_public"))


@query("p06_public_v6", """
    SELECT event_id, event_id % 3 = 0 AS is_public, CASE event_id % 3 WHEN 0 THEN concat('2606:4700::', lower(printf('%x', user_id % 500 + 1))) WHEN 1 THEN 'fe80::1' ELSE '2001:db8::1' END AS canonical FROM events""")
def public_v6(t):
    tail = F.lpad(F.lower(F.hex(F.col("user_id") % 500 + 1)), 4, "0")
    ip = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("2606:4700:0000:0:0:0:0:"), tail)).when(F.col("event_id") % 3 == 1, "FE80::1").otherwise("2001:0DB8::0001")
    return t.events.select("event_id", ind.public_v6(ip).alias("is_public"), ind.canonical_v6(ip).alias("canonical"))


@query("p07_context", """
    SELECT doc_id, trim(concat('2024-', lpad(cast(1000 + doc_id % 211 AS STRING), 5, '0'), ' in the public web server of Retail firms.')) AS said FROM documents""")
def context(t):
    tail = F.regexp_extract("text", "(?s)(2024-0[0-9]{4} in the public web server.*)$", 1)
    return t.reports.select("doc_id", tail.alias("t")).select("doc_id", tx.context_of(F.col("t"), F.lit(0), F.lit(5)).alias("said"))


@query("p08_canonical_url", """
    SELECT doc_id, concat('https://', publisher, '.example.org/post/', cast(doc_id % 700 AS STRING)) AS canonical FROM reports""")
def canonical(t):
    return t.reports.select("doc_id", ul.canonical(F.col("url")).alias("canonical"))


@query("p09_vendor", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'cisa' WHEN 1 THEN 'mandiant' WHEN 2 THEN 'talos' END AS vendor_id FROM documents""")
def vendor(t):
    url = F.when(F.col("doc_id") % 4 == 0, "https://www.CISA.gov/x").when(F.col("doc_id") % 4 == 1, "https://cloud.google.com/blog").when(F.col("doc_id") % 4 == 2, "http://blog.talosintelligence.com/").otherwise("https://notcisa.gov.example/")
    return t.documents.select("doc_id", ul.vendor(url)["id"].alias("vendor_id"))


@query("p10_title_key", "SELECT doc_id, substring(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 80) AS key FROM reports")
def title_key(t):
    return t.reports.select("doc_id", tx.title_key(F.col("title")).alias("key"))


@query("p11_slug", "SELECT p_partkey, coalesce(nullif(substring(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), ''), 'unnamed') AS slug FROM part")
def slug(t):
    return t.part.select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))


@query("p12_natural_order", """
    SELECT rid, list(source_id ORDER BY cast(substring(source_id, 2) AS INT)) AS ids FROM (SELECT DISTINCT rid, source_id FROM mentions) GROUP BY rid""")
def natural(t):
    return t.mentions.groupBy("rid").agg(F.collect_list("source_id").alias("ids")).select("rid", tx.natural_order(F.col("ids")).alias("ids"))


@query("p13_spec_key", "SELECT count(DISTINCT (rid % 7, pos % 2)) AS n FROM mentions")
def spec_key(t):
    c = F.struct(F.lit("image").alias("field"), F.lit("endswith").alias("op"), F.array(F.concat(F.lit("A"), (F.col("rid") % 7).cast("string")), F.concat(F.lit("b"), (F.col("pos") % 2).cast("string"))).alias("values"))
    d = F.struct(F.lit("image").alias("field"), F.lit("endswith").alias("op"), F.array(F.concat(F.lit("B"), (F.col("pos") % 2).cast("string")), F.concat(F.lit("a"), (F.col("rid") % 7).cast("string"))).alias("values"))
    key = ind.spec_key(F.lit("process_creation"), F.array(F.when(F.col("rid") % 2 == 0, c).otherwise(d)))
    return t.mentions.select(key.alias("k")).agg(F.count_distinct("k").alias("n"))


@query("p14_ioc_key", "SELECT rid, pos, concat(ioc_type, '|', lower(ioc_value)) AS key FROM mentions")
def ioc_key(t):
    return t.mentions.select("rid", "pos", ind.key_of(F.col("ioc_type"), tx.defang(F.col("ioc_value"), F.col("ioc_type"))).alias("key"))


@query("p15_cve_ids", "SELECT rid, pos, CASE WHEN pos % 4 = 0 THEN concat(cve, 'X') ELSE cve END AS cve, pos % 4 <> 0 AS ok FROM mentions")
def cve_ids(t):
    raw = F.concat(F.lit(" "), F.lower(F.translate("cve", "-", "–")), F.when(F.col("pos") % 4 == 0, "x").otherwise(""), F.lit(" "))
    return t.mentions.select("rid", "pos", tx.cve_id(raw).alias("cve"), tx.is_cve(raw).alias("ok"))


@query("p16_cpe_product", """
    SELECT p_partkey, concat('Acme Web ', 'Server', CASE WHEN p_size % 2 = 0 THEN concat(' ', cast(p_size AS STRING)) ELSE '' END, CASE WHEN p_size % 3 = 0 THEN ' pro ed' ELSE '' END) AS product FROM part""")
def cpe(t):
    c = F.concat(F.lit("cpe:2.3:a:acme:web_server:"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("*"), F.lit(":*:*:*:"), F.when(F.col("p_size") % 3 == 0, "pro_ed").otherwise("-"), F.lit(":*:*"))
    return t.part.select("p_partkey", ind.cpe_product(c).alias("product"))


@query("p17_comparable", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS plain FROM documents")
def comparable(t):
    return t.documents.select("doc_id", tx.comparable(F.col("text")).alias("plain"))


@query("p18_times", """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch(o_orderdate) WHEN 1 THEN epoch(o_orderdate) WHEN 2 THEN epoch(cast(o_orderdate AS DATE)) END AS s FROM orders""")
def times(t):
    d = F.to_timestamp("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.unix_seconds(d).cast("string")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" someday"))).otherwise("soon")
    return t.orders.select("o_orderkey", F.unix_seconds(ind.lenient_time(raw)).cast("double").alias("s"))


@query("p19_expiry", """
    SELECT rid, pos, CASE ioc_type WHEN 'ipv4' THEN cast(seen_at + INTERVAL 90 DAY AS DATE) WHEN 'domain' THEN cast(seen_at + INTERVAL 180 DAY AS DATE) END AS expires FROM mentions""")
def expiry(t):
    return t.mentions.select("rid", "pos", ind.expires_at(F.col("ioc_type"), F.col("seen_at")).cast("date").alias("expires"))


@query("p20_reputation_summary", "SELECT rid, concat('VT ', cast(n_iocs AS STRING), ' · OTX ', cast(n_queries AS STRING)) AS shown FROM research")
def reputation(t):
    m = F.create_map(F.lit("VT"), F.col("n_iocs").cast("string"), F.lit("OTX"), F.col("n_queries").cast("string"))
    return t.research.select("rid", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(" ", e["key"], e["value"])), " · ").alias("shown"))


@query("p21_sentences")
def sentences(t):
    return ex.sentence_table(t.reports)


@query("p22_clip_words", """
    SELECT doc_id, concat(array_to_string(list_slice(w, 1, 25), ' '), CASE WHEN len(w) > 25 THEN '…' ELSE '' END) AS shown
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def clip(t):
    return t.documents.select("doc_id", tx.clip_words(F.col("text"), 25).alias("shown"))


@query("p23_strip_hidden", "SELECT doc_id, text AS clean FROM documents")
def strip_hidden(t):
    return t.documents.select("doc_id", tx.strip_hidden(F.concat(F.lit("​"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("‮"))).alias("clean"))


@query("p24_strip_noise", "SELECT doc_id, trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')) AS clean FROM documents")
def strip_noise(t):
    return t.documents.select("doc_id", tx.strip_noise(F.concat("text", F.lit("\nSubject: x\nPlease unsubscribe here\n-- \nbye"))).alias("clean"))


@query("p25_forwards", "SELECT doc_id, 'see below' AS note, concat('a', cast(doc_id % 9 AS STRING), '@x.org') AS sender, trim(text) AS body FROM documents")
def forwards(t):
    mail = F.concat(F.lit("see below\n---------- Forwarded message ---------\nFrom: a"), (F.col("doc_id") % 9).cast("string"), F.lit("@x.org\nSubject: s\n\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    return t.documents.select("doc_id", rd.forwarded(mail).alias("f")).select("doc_id", "f.note", "f.sender", "f.body")


@query("p26_unwrap", "SELECT page_id, url AS target FROM pages")
def unwrapped(t):
    safe = F.concat(F.lit("https://eur01.safelinks.protection.outlook.com/?data=1&url="), F.url_encode("url"), F.lit("&x=2"))
    twice = F.concat(F.lit("https://www.google.com/url?q="), F.url_encode(safe))
    return t.pages.select("page_id", ul.unwrap(F.when(F.col("page_id") % 2 == 0, safe).otherwise(twice)).alias("target"))


@query("p27_plain_links", "SELECT doc_id, concat('https://www.', publisher, '.example.org/post/', cast(doc_id % 700 AS STRING), '/?p=', cast(doc_id % 5 AS STRING)) AS plain FROM reports")
def plain_links(t):
    return t.reports.select("doc_id", ul.without_campaign(F.concat(F.col("url"), F.lit("#top"))).alias("plain"))


@query("p28_link_kinds", """
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'indicator' WHEN 1 THEN 'noise' WHEN 2 THEN 'noise' WHEN 3 THEN 'noise' WHEN 4 THEN 'noise' ELSE 'article' END AS kind FROM documents""")
def link_kinds(t):
    raw = F.element_at(F.array(*map(F.lit, ("hxxps://evil[.]top/a", "https://a.example/logo.png", "https://twitter.com/x/y", "https://click.news.example/q/1", "https://a.example/about", "https://a.example/posts/2024/deep"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", ul.link_kind(ul.link(raw), F.col("doc_id") % 6 == 0)["kind"].alias("kind"))


@query("p29_tlp", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'CLEAR' WHEN 1 THEN 'AMBER+STRICT' END AS tlp FROM documents")
def tlp(t):
    mark = F.when(F.col("doc_id") % 3 == 0, "tlp: white").when(F.col("doc_id") % 3 == 1, "TLP:AMBER+STRICT").otherwise("no mark")
    return t.documents.select("doc_id", tx.tlp(F.col("text"), mark).alias("tlp"))


@query("p30_message_keys", "SELECT conv_id, turn, CASE WHEN turn = 0 THEN concat('mid:', cast(conv_id AS STRING), '@x') ELSE concat('sha256:', sha256(text)) END AS key FROM conversations")
def message_keys(t):
    mid = F.when(F.col("turn") == 0, F.concat(F.lit(" <"), F.col("conv_id").cast("string"), F.lit("@X> "))).otherwise("")
    return t.conversations.select("conv_id", "turn", ind.message_key(mid, F.col("text")).alias("key"))


@query("p31_plus_tags", "SELECT c_custkey, [concat('t', cast(c_custkey % 7 AS STRING))] AS tags FROM customer")
def plus_tags(t):
    return t.customer.select("c_custkey", ind.plus_tags(F.array(F.concat(F.lit("in+T"), (F.col("c_custkey") % 7).cast("string"), F.lit("@x.org")), F.lit("plain@x.org"))).alias("tags"))


@query("p32_stix_patterns", """
    SELECT rid, pos, CASE ioc_type WHEN 'ipv4' THEN concat('[ipv4-addr:value = ''', ioc_value, ''']') WHEN 'domain' THEN concat('[domain-name:value = ''', lower(ioc_value), ''']') ELSE concat('[file:hashes.''SHA-256'' = ''', ioc_value, ''']') END AS pattern FROM mentions""")
def patterns(t):
    return t.mentions.select("rid", "pos", ind.stix_pattern(F.col("ioc_type"), F.col("ioc_value")).alias("pattern"))


@query("p33_stix_times", "SELECT rid, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM research")
def stix_times(t):
    return t.research.select("rid", ind.stix_time(F.col("created_at")).alias("at"))


@query("p34_uuid5")
def uuids(t):
    return t.actors.select("actor_id", ind.uuid5("6f1c9a52-3b1e-4f0a-9d7e-8a2b5c4e1d70", F.concat(F.lit("actor|"), "actor_id")).alias("id"))


@query("p35_search_text", "SELECT rid, lower(concat(title, ' ', created_by)) AS text FROM research")
def search_text(t):
    return t.research.select("rid", tx.search_text(F.array("title"), F.array(F.lit("")), F.array("created_by")).alias("text"))


@query("p36_status", """
    WITH ranks AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i, unnest(['reference', 'generated', 'syntax_checked', 'reviewed', 'lab_tested', 'deployed', 'deprecated']) AS name, unnest([0, 0, 1, 2, 3, 4, 5]) AS r)
    SELECT p_partkey, CASE WHEN a.r >= b.r THEN a.name ELSE b.name END AS later FROM part JOIN ranks a ON a.i = p_size % 7 JOIN ranks b ON b.i = p_size % 5""")
def statuses(t):
    names = F.array(*map(F.lit, fixed.STATUS_RANK), F.lit("deprecated"))
    a, b = F.get(names, (F.col("p_size") % 7).cast("int")), F.get(names, (F.col("p_size") % 5).cast("int"))
    return t.part.select("p_partkey", ind.later_status(a, b).alias("later"))


@query("p37_lint", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['index= is SPL'] WHEN 1 THEN ['unbalanced ()'] WHEN 2 THEN ['empty'] ELSE [] END AS findings FROM events""")
def lints(t):
    bodies = F.element_at(F.array(*map(F.lit, ("Table | where index=main", "Table | where (a == 1", " ", 'Table | where a == "(" | summarize count()'))), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", ind.lint(F.lit("kql_sentinel"), bodies).alias("findings"))


@query("p39_budgets", """
    SELECT event_id, t AS pct_time, k AS pct_tokens, CASE WHEN greatest(t, k) >= 100 THEN 'over' WHEN greatest(t, k) >= 80 THEN 'warning' ELSE 'ok' END AS state
    FROM (SELECT event_id, round(100.0 * ((event_id % 700) / 60.0) / 10.0, 1) AS t, round(100.0 * (event_id % 613 * 1000) / 600000.0, 1) AS k FROM events)""")
def budgets(t):
    k = F.col("event_id")
    return t.events.select("event_id", ind.budget(F.lit("unknown"), (k % 700).cast("double"), k % 613 * 1000).alias("b")).select("event_id", "b.*")


@query("p40_hidden", "SELECT rid, pos, pos = 1 OR pos = 2 OR (pos = 3 AND rid % 2 = 0) AS hide FROM mentions")
def hidden(t):
    v = F.when(F.col("pos") == 1, "benign").when(F.col("pos") == 3, "expired").otherwise("malicious")
    return t.mentions.select("rid", "pos", F.when(F.col("rid") % 2 == 0, ind.hidden(v, F.col("pos") == 2, F.lit(False))).otherwise(ind.hidden(v, F.col("pos") == 2, F.lit(True))).alias("hide"))


@query("p42_seed_titles", r"""
    SELECT doc_id, CASE WHEN line IS NULL THEN 'Untitled threat' ELSE substring(regexp_replace(CASE WHEN regexp_matches(line, '[.!?]\s') THEN regexp_extract(line, '^(.*?[.!?])\s', 1) ELSE line END, '\.+$', ''), 1, 120) END AS title
    FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')[1] AS line FROM documents)""")
def seed_titles(t):
    return t.documents.select("doc_id", tx.seed_title(F.col("text")).alias("title"))


@query("f07_relevant", "SELECT doc_id, CASE WHEN doc_id % 40 = 6 THEN 3 ELSE 0 END + CASE WHEN doc_id % 211 = 5 THEN 4 ELSE 0 END AS score FROM documents")
def relevant(t):
    terms = t.nation.limit(1).select(F.explode(F.array(F.struct(F.lit("APT7").alias("term"), F.lit(3).alias("weight")), F.struct(F.lit("apt7").alias("term"), F.lit(1).alias("weight")), F.struct(F.lit("CVE-2024-01005").alias("term"), F.lit(4).alias("weight")))).alias("x")).select("x.*")
    return ex.relevance(t.reports, terms)


@query("f08_huntable", """
    SELECT rid, pos, CASE partkey % 5 WHEN 0 THEN FALSE WHEN 1 THEN FALSE WHEN 2 THEN FALSE ELSE TRUE END AS ok FROM mentions""")
def huntable(t):
    k = F.col("partkey") % 5
    kind = F.when(k == 0, "ipv4").when(k == 1, "domain").when(k == 2, "sha256").otherwise(F.col("ioc_type"))
    value = F.when(k == 0, "10.1.2.3").when(k == 1, "www.microsoft.com").when(k == 2, F.sha2(F.lit(""), 256)).otherwise(F.col("ioc_value"))
    return t.mentions.select("rid", "pos", ind.huntable(kind, value).alias("ok"))


@query("e01_indicators")
def indicators(t):
    return ex.indicators(t.reports)


@query("e01_indicators_by_type")
def indicators_by_type(t):
    return ex.indicators(t.reports).groupBy("type").agg(F.count("*").alias("n"))


@query("e02_cves", "SELECT doc_id, [concat('CVE-2024-', lpad(cast(1000 + doc_id % 211 AS STRING), 5, '0'))] AS cves FROM reports")
def cves(t):
    return t.reports.select("doc_id", tx.cves(F.concat("text", F.lit(" "), F.lower("text"))).alias("cves"))


@query("e03_actor_names", f"SELECT doc_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS actors FROM (SELECT doc_id, regexp_extract_all(text, '{fixed.ACTOR_PATTERN}') AS x FROM reports)")
def actor_names(t):
    return t.reports.select("doc_id", tx.actor_names(F.col("text")).alias("actors"))


@query("e04_dictionary", "SELECT doc_id, 'actor7' AS canonical FROM documents WHERE doc_id % 40 = 6 UNION ALL SELECT doc_id, 'ransom' FROM documents")
def dictionary(t):
    names = t.nation.limit(1).select(F.explode(F.array(F.struct(F.lit("apt7").alias("name"), F.lit("actor7").alias("canonical")), F.struct(F.lit("RANSOMWARE").alias("name"), F.lit("ransom").alias("canonical")), F.struct(F.lit("ransomwar").alias("name"), F.lit("no").alias("canonical")))).alias("x")).select("x.*")
    return ex.dictionary_hits(t.reports, names)


@query("e06_techniques")
def techniques(t):
    return ex.techniques(t.reports)


@query("e07_notes")
def notes(t):
    return ex.notes(t.reports)


@query("e08_links", """
    SELECT doc_id, concat('https://cdn', cast(doc_id % 97 AS STRING), '.update', cast(doc_id % 13 AS STRING), '.top/a?id=', cast(doc_id % 3 AS STRING)) AS url, 'indicator' AS kind FROM reports
    UNION ALL SELECT doc_id, concat('https://www.', publisher, '.example.org/post/', cast(doc_id % 700 AS STRING), '/?p=', cast(doc_id % 5 AS STRING)), 'article' FROM reports""")
def links(t):
    return ex.links(t.reports.withColumn("hrefs", F.array("url", F.lit("mailto:a@b"), "url")), id_col="doc_id", text_col="text", hrefs_col="hrefs").select("doc_id", "url", "kind")


@query("e11_mentions", """
    SELECT DISTINCT comment_id, concat('user', cast(thread_id % 60 + 1 AS STRING)) AS user_id FROM comments""")
def user_mentions(t):
    return ex.mentions(t.comments, t.users, id_col="comment_id", text_col="text")


@query("e12_views", """
    SELECT event_id, CASE WHEN path LIKE '/api/library/cves/%' THEN 'cve' WHEN path LIKE '/api/library/actors/%' THEN 'actor' ELSE 'research' END AS entity_type,
      CASE WHEN path LIKE '/api/library/cves/%' THEN upper(replace(substring(path, 19), '/', '')) WHEN path LIKE '/api/library/actors/%' THEN replace(substring(path, 21), '%20', ' ') ELSE substring(path, 15) END AS entity_id
    FROM access WHERE method = 'GET' AND NOT path LIKE '%check-duplicates' AND NOT path LIKE '/api/research/x/%'""")
def views(t):
    return ex.views(t.access).select("event_id", "entity_type", "entity_id")


@query("r01_relevance_by_source", "SELECT publisher, cast(sum(CASE WHEN doc_id % 40 = 6 THEN 3 ELSE 0 END) AS BIGINT) AS score FROM reports GROUP BY publisher")
def relevance_by_source(t):
    terms = t.nation.limit(1).select(F.lit("apt7").alias("term"), F.lit(3).alias("weight"))
    return ex.relevance(t.reports, terms).join(t.reports.select("doc_id", "publisher"), "doc_id").groupBy("publisher").agg(F.sum("score").alias("score"))
