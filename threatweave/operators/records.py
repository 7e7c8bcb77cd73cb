"""Records of research against the library, mails and sources: matching, membership, clean-up, candidates, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import text as tx
from ..functions import urls as ul
from ..sources import fixed
from ..sources.writers import stored
from .extract import BROADCAST_NAMES, name_hits
from .ranking import first_by_key


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def live(links: DataFrame, research: DataFrame) -> DataFrame:
    """Links of research that isn't archived."""
    return links.join(research.filter("status <> 'archived'").select("research_id").distinct(), "research_id", "left_semi")


def _names(rows: DataFrame, *kept: str) -> DataFrame:
    """(kept, k): a row for each distinct lower-case name or alias; empty ones name nobody."""
    every = F.concat(F.array("name"), F.coalesce("aliases", _no_strings()))
    return rows.select(*kept, F.explode(F.array_distinct(F.transform(every, F.lower))).alias("k")).filter("k <> ''").distinct()


def actor_matches(library: DataFrame, named: DataFrame) -> DataFrame:
    """(actor_id, research_id, source_id): research that names an actor of the library by a name or alias of either side.

    library has (actor_id, name, aliases), named (research_id, source_id, name, aliases). An alias may stand for many actors, so the
    matches are many more than either side; each is told once, by the least name that both have, and none is shuffled to be so.
    """
    own = _names(library, "actor_id").groupBy("actor_id").agg(F.collect_set("k").alias("_own"))
    known = own.select("actor_id", "_own", F.explode("_own").alias("k"))
    every = F.concat(F.array("name"), F.coalesce("aliases", _no_strings()))
    said = named.groupBy("research_id", "source_id").agg(F.array_distinct(F.flatten(F.collect_set(F.filter(F.transform(every, F.lower), lambda x: x != "")))).alias("_said"))
    near = said.select("research_id", "source_id", "_said", F.explode("_said").alias("k")).join(F.broadcast(known) if known.count() <= BROADCAST_NAMES else known, "k")
    return near.filter(F.col("k") == F.array_min(F.array_intersect("_own", "_said"))).select("actor_id", "research_id", "source_id")


def malware_matches(library: DataFrame, named: DataFrame) -> DataFrame:
    """(malware_id, research_id, source_id): research that names a malware whose id is the name's slug."""
    rows = named.select(tx.slug(F.col("name")).alias("malware_id"), "research_id", "source_id").distinct()
    return rows.join(library.select("malware_id").distinct(), "malware_id", "left_semi")


def ioc_matches(library: DataFrame, named: DataFrame) -> DataFrame:
    """(ioc_id, research_id, source_id): research with an indicator of the library, whether written defanged or not."""
    key = ind.key_of(F.col("type"), F.col("value")).alias("k")
    return library.select("ioc_id", key).join(named.select(key, "research_id", "source_id").distinct(), "k").select("ioc_id", "research_id", "source_id")


def keyed_overrides(overrides: DataFrame, iocs: DataFrame) -> DataFrame:
    """(key, decision): the latest override of each indicator's key; ties go to the greater id."""
    rows = overrides.join(iocs.select("ioc_id", ind.key_of(F.col("type"), F.col("value")).alias("key")), "ioc_id")
    return rows.groupBy("key").agg(F.max_by("decision", F.struct("at", "ioc_id")).alias("decision"))


def class_members(behaviours: DataFrame, members: DataFrame) -> DataFrame:
    """(research_id, behaviour_id, class, key): the classes a behaviour hangs under, ``unmapped`` where none takes it.

    behaviours has a row per reference (research_id, behaviour_id, kind, ref); members has (research_id, class, key, kind, ref):
    what makes a reference belong to a class.
    """
    found = behaviours.join(members, ["research_id", "kind", "ref"]).select("research_id", "behaviour_id", "class", "key").distinct()
    rest = behaviours.select("research_id", "behaviour_id").distinct().join(found, ["research_id", "behaviour_id"], "left_anti")
    return found.unionByName(rest.select("research_id", "behaviour_id", F.lit("unmapped").alias("class"), F.lit(None).cast("string").alias("key")))


def from_source(items: DataFrame, detections: DataFrame) -> DataFrame:
    """(research_id, source_id, kind, item): all that rests on a source, distinct, with the detections of its techniques.

    items has (research_id, source_id, kind, item), detections (research_id, technique_id, item).
    """
    own = items.select("research_id", "source_id", "kind", "item").distinct()
    techniques = own.filter("kind = 'technique'").select("research_id", "source_id", F.col("item").alias("technique_id"))
    down = techniques.join(detections, ["research_id", "technique_id"]).select("research_id", "source_id", F.lit("detection").alias("kind"), "item").distinct()
    return own.unionByName(down)


def tree_filter(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Nodes (root, path) that a filter leaves: matches, their ancestors, and the whole branch below a match by text.

    matches has (root, path, by_text). Paths are joined by slashes; every join is on equal paths, as a path's ancestors are
    listed from the path itself.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = matches.select("root", F.explode(up).alias("path")).distinct()
    branches = matches.filter("by_text").select("root", F.col("path").alias("top")).distinct()
    below = nodes.select("root", "path", F.explode(up).alias("top")).join(branches, ["root", "top"], "left_semi").select("root", "path")
    return nodes.join(above.unionByName(below).distinct(), ["root", "path"], "left_semi")


def seed_names(seeds: DataFrame, actors: DataFrame, malware: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, actors, malware): what a seed names of the library and by pattern, sorted.

    actors (name, aliases) counts under its name whichever of its names the text holds; malware (name) needs four letters. Names are whole
    words in any case; they meet the text by a token, so a large library is no nested loop. What a seed names is gathered before an alias is
    replaced by all actors that have it.
    """
    every = F.concat(F.array("name"), F.coalesce("aliases", _no_strings()))
    known = stored(actors.select(F.explode(every).alias("x"), F.col("name").alias("canonical")).filter("x <> ''").select(F.col("x").alias("name"), "canonical").distinct(), "actor-names")
    text = seeds.select(id_col, F.col(text_col).alias("text"))
    hit = lambda names, least: name_hits(text, names, id_col=id_col, least=least, hyphens=True)
    by_name = hit(known, 1).withColumn("_k", F.lit("actor"))
    by_pattern = text.select(id_col, F.explode(tx.actor_names(F.col("text"))).alias("name")).withColumn("_k", F.lit("pattern"))
    found = by_name.unionByName(by_pattern).unionByName(hit(malware, 4).withColumn("_k", F.lit("malware")))
    of = lambda kind: F.collect_set(F.when(F.col("_k") == kind, F.col("name")))
    named = found.groupBy(id_col).agg(of("actor").alias("_names"), of("pattern").alias("_pattern"), of("malware").alias("malware"))
    listed = known.groupBy("name").agg(F.collect_set("canonical").alias("_all"))
    listed = F.broadcast(listed) if known.count() <= BROADCAST_NAMES else listed
    who = named.select(id_col, "_pattern", "malware", F.explode_outer("_names").alias("name")).join(listed, "name", "left").groupBy(id_col)
    who = who.agg(F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list("_all")), F.first("_pattern")))).alias("actors"), F.array_sort(F.first("malware")).alias("malware"))
    out = seeds.select(id_col).distinct().join(who, id_col, "left")
    return out.select(id_col, F.coalesce("actors", _no_strings()).alias("actors"), F.coalesce("malware", _no_strings()).alias("malware"))


def seed_entities(seeds: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """(id, title, cves, urls, actors, keywords): what a seed text names by pattern; a null text names nothing.

    Keywords are distinctive words of the title's line: no stop words, none of the CVEs and actors, the first ``most``.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = seeds.select(id_col, tx.seed_title(text).alias("title"), tx.seed_title(text, 1 << 30).alias("_line"), tx.cves(text).alias("cves"), F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.SEED_URL), F.lit(0))).alias("urls"), F.array_sort(tx.actor_names(text)).alias("actors"))
    # (?U): letters of every script are parts of words.
    words = F.regexp_extract_all("_line", F.lit("(?U)" + fixed.KEYWORD), F.lit(0))
    plain = F.filter(words, lambda w: ~F.lower(w).isin(*fixed.KEYWORD_STOP))
    return rows.select(id_col, "title", "cves", "urls", "actors", F.slice(F.array_except(plain, F.concat("cves", "actors")), 1, most).alias("keywords"))


def mail_indicators(found: DataFrame, people: DataFrame, articles: DataFrame, *, most: int = 200) -> DataFrame:
    """(mail_id, pos, type, value, display): indicators of mails but for CVEs, what belongs to participants, and article links.

    found has (mail_id, pos, type, value), people (mail_id, address), articles (mail_id, url, host). A mail's own addresses and
    links are few, so they are gathered by mail and the indicators need one join.
    """
    address, at = F.lower("address"), F.contains("address", F.lit("@"))
    who = people.filter(at).select("mail_id", F.explode(F.array(F.concat(F.lit("email:"), address), F.concat(F.lit("at:"), F.substring_index(address, "@", -1)))).alias("k"))
    what = articles.select("mail_id", F.explode(F.array(F.concat(F.lit("url:"), "url"), F.concat(F.lit("host:"), F.lower("host")))).alias("k"))
    banned = who.unionByName(what).filter("k is not null").groupBy("mail_id").agg(F.collect_set("k").alias("banned"))
    low = F.lower("value")
    mark = lambda kind, c: F.concat(F.lit(kind), F.coalesce(c, F.lit("")))
    keys = F.when(F.col("type") == "email", F.array(mark("email:", low), mark("at:", F.substring_index(low, "@", -1)))).when(
        F.col("type") == "domain", F.concat(F.array(mark("host:", low)), F.transform(ul.parents(F.col("value")), lambda d: F.concat(F.lit("at:"), d)))
    ).when(F.col("type") == "url", F.array(mark("url:", ul.link(F.col("value"))), mark("host:", ul.host(F.col("value"))))).otherwise(_no_strings())
    rows = found.filter("type <> 'cve'").join(banned, "mail_id", "left").filter(~F.coalesce(F.arrays_overlap(keys, F.col("banned")), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("mail_id").orderBy("pos", "type", "value"))
    return rows.withColumn("_n", rank).filter(F.col("_n") <= most).select("mail_id", "pos", "type", "value", tx.defang(F.col("value"), F.col("type")).alias("display"))


def discovered(seed: DataFrame, feed: DataFrame, web: DataFrame, *, least: int = 3) -> DataFrame:
    """Candidate sources of all origins, one a canonical URL: seeds first (100), feeds from ``least`` on (10 more), then the web (8 more for vendors).

    All have (source_id, url, score); the score of seeds isn't read.
    """
    vendor = F.when(ul.vendor(F.col("url")).isNotNull(), 8).otherwise(0)
    parts = [
        seed.select("source_id", "url", F.lit(100).cast("long").alias("score"), F.lit(0).alias("_o"), F.lit("seed").alias("origin")),
        feed.filter(F.col("score") >= least).select("source_id", "url", (F.col("score") + 10).cast("long").alias("score"), F.lit(1).alias("_o"), F.lit("vendor_feed").alias("origin")),
        web.select("source_id", "url", (F.col("score") + vendor).cast("long").alias("score"), F.lit(2).alias("_o"), F.lit("web").alias("origin")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("canonical", ul.canonical(F.col("url")))
    return first_by_key(every, ["canonical"], [F.asc("_o"), F.desc("score"), F.asc("source_id")]).select("source_id", "canonical", "origin", "score")


def cached_or_stale(wanted: DataFrame, cache: DataFrame, fetched: DataFrame, at: Column, *, hours: int = 24) -> DataFrame:
    """(cve, state, value): ``fresh`` from the cache within ``hours``, else ``fetched``, else ``stale`` from the cache, else ``unavailable``.

    cache has (cve, value, fetched_at), a row a CVE; fetched (cve, value) holds what could be looked up again.
    """
    rows = wanted.select("cve").distinct().join(cache.select("cve", F.col("value").alias("_old"), "fetched_at"), "cve", "left")
    rows = rows.join(fetched.select("cve", F.col("value").alias("_new"), F.lit(True).alias("_again")), "cve", "left")
    fresh = F.coalesce(F.col("fetched_at") > at - F.make_interval(hours=F.lit(hours)), F.lit(False))
    state = F.when(fresh, "fresh").when(F.col("_again"), "fetched").when(F.col("fetched_at").isNotNull(), "stale").otherwise("unavailable")
    return rows.select("cve", state.alias("state"), F.when(state == "fetched", F.col("_new")).otherwise(F.col("_old")).alias("value"))
