"""Joins between reports, entities, sources, workspaces and indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.writers import stored
from .patterns import by_size, occurrences

#: Rows that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: N-grams of a quote that are looked for in a text one by one at most.
FEW_GRAMS = 64


def small(df: DataFrame) -> DataFrame:
    """``df`` with a hint to broadcast it, if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def seen_in(links: DataFrame, research: DataFrame, *, entity_type: str, key: str = "research_id") -> DataFrame:
    """(entity_key, research): ids of the live research that names each entity, newest first.

    Links and research meet by ``key``, which need not be the id that is shown: ids that are cut to a width may repeat.
    """
    live = research.filter(F.col("status") != "archived").select(F.col(key).alias("_key"), "research_id", "created_at")
    rows = links.filter(F.col("entity_type") == entity_type).select("entity_key", F.col(key).alias("_key")).join(live, "_key")
    # Repeated rows of a link go where they meet, so that one exchange by entity serves the rest.
    rows = rows.distinct().select("entity_key", "research_id", "created_at").repartition("entity_key").distinct()
    newest = F.sort_array(F.collect_list(F.struct("created_at", "research_id")), asc=False)
    return rows.groupBy("entity_key").agg(F.transform(newest, lambda x: x["research_id"]).alias("research"))


def provenance(links: DataFrame, sections: DataFrame, sources: DataFrame, *, entity_type: str) -> DataFrame:
    """(entity_key, research_id, source_id, publisher, quote): one row per research and source, its first quote."""
    own = links.filter(F.col("entity_type") == entity_type).select("research_id", "entity_key").distinct()
    cited = own.join(sections, ["research_id", "entity_key"]).groupBy("entity_key", "research_id", "source_id").agg(F.min(F.struct("pos", "quote"))["quote"].alias("quote"))
    return cited.join(sources, ["research_id", "source_id"]).select("entity_key", "research_id", "source_id", "publisher", "quote")


def provenance_summary(items: DataFrame) -> DataFrame:
    """(entity_key, source_count, publishers): distinct pairs of research and source, publishers in order of their first one."""
    first = items.groupBy("entity_key", "publisher").agg(F.min(F.struct("research_id", "source_id")).alias("at"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "publisher"))), lambda x: x["publisher"])
    return first.groupBy("entity_key").agg(F.sum("n").alias("source_count"), ordered.alias("publishers"))


def first_quote(wanted: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_id, name, quote): the first claim of a source that names it, else the first evidence quote, else ''."""
    both = claims.select("source_id", "pos", F.col("statement").alias("q"), F.lit(0).alias("rank")).unionByName(evidence.select("source_id", "pos", F.col("quote").alias("q"), F.lit(1).alias("rank")))
    # A source repeats its quotes: each text counts once, where it comes first.
    each = both.groupBy("source_id", "rank", "q").agg(F.min("pos").alias("pos"))
    texts = each.select("source_id", F.struct("rank", "pos", "q").alias("text_id"), F.lower("q").alias("text"))
    names = wanted.select("source_id", F.col("name").alias("pattern_id"), F.lower("name").alias("pattern"))
    first = occurrences(texts, names, scope=["source_id"]).groupBy("source_id", F.col("pattern_id").alias("name")).agg(F.min("text_id")["q"].alias("quote"))
    return wanted.select("source_id", "name").distinct().join(first, ["source_id", "name"], "left").select("source_id", "name", F.coalesce("quote", F.lit("")).alias("quote"))


def related(keys: DataFrame, *, id_col: str = "research_id", key_col: str = "key") -> DataFrame:
    """(key, id, class, n): the items of every key that two or more share; class is the least of them, n their number.

    Items of a key are related to each other. Written as membership, a key of n items costs n rows, however popular it is;
    ``related_to`` gives the partners of chosen items.
    """
    rows = keys.select(F.col(key_col).alias("key"), F.col(id_col).alias("id")).distinct()
    sized = rows.groupBy("key").agg(F.min("id").alias("class"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(small(sized), "key").select("key", "id", "class", "n")


def related_to(wanted: DataFrame, keys: DataFrame, *, id_col: str = "research_id", key_col: str = "key") -> DataFrame:
    """(a, b, shared): for each wanted item all others that share keys with it, and the keys."""
    rows = keys.select(F.col(id_col).alias("b"), F.col(key_col).alias("k")).distinct()
    mine = rows.join(wanted.select(F.col(id_col).alias("b")).distinct(), "b", "left_semi").select(F.col("b").alias("a"), "k")
    return mine.join(rows, "k").filter("a <> b").groupBy("a", "b").agg(F.array_sort(F.collect_set("k")).alias("shared"))


def applicability(affected: DataFrame, owned: DataFrame, workspaces: DataFrame, *, every: bool = False) -> DataFrame:
    """(research_id, workspace_id, status, reason): the workspaces that run an affected product, or with ``every`` all of them.

    affected (research_id, product), owned (workspace_id, pos, product), workspaces (workspace_id). A product matches if
    its name without edition words is in an affected one, or an affected one's first word is in it. Products meet by
    their distinct names, of which there are few, before they meet research and workspaces.
    """
    core = F.trim(F.regexp_replace(F.lower("product"), r"\b(server|on-prem|on-premises|\d{4}|se|subscription edition)\b", ""))
    a = affected.select(F.lower("product").alias("p")).distinct()
    w = owned.select(F.lower("product").alias("wp"), core.alias("core")).distinct()
    # Names meet by their anchors in both directions, so distinct names aren't compared each with each.
    within = occurrences(a.select(F.col("p").alias("text_id"), F.col("p").alias("text")), w.select(F.col("wp").alias("pattern_id"), F.col("core").alias("pattern"))).select(F.col("text_id").alias("p"), F.col("pattern_id").alias("wp"))
    around = occurrences(w.select(F.col("wp").alias("text_id"), F.col("wp").alias("text")).distinct(), a.filter("p <> ''").select(F.col("p").alias("pattern_id"), F.substring_index("p", " ", 1).alias("pattern"))).select(F.col("pattern_id").alias("p"), F.col("text_id").alias("wp"))
    match = within.unionByName(around).distinct()
    # Each affected name meets a workspace once, at the workspace's first product that matches.
    best = match.select("p", "wp").join(owned.select("workspace_id", "pos", F.lower("product").alias("wp")), "wp").groupBy("p", "workspace_id").agg(F.min(F.struct("pos", "wp")).alias("best"))
    # Numbered within its workspace, as the least number of many pairs needs no sort.
    best = stored(best.withColumn("_r", F.row_number().over(Window.partitionBy("workspace_id").orderBy("best"))), "exposing")
    # Dealt by research beforehand, so that the pairs of research and workspace, many more than names, aren't dealt again; among
    # all tasks, as few of them would be enough for the names but not for the pairs.
    tasks = int(affected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hit = affected.select("research_id", F.lower("product").alias("p")).repartition(tasks, "research_id").distinct().join(small(best.select("p", "workspace_id", "_r")), "p")
    least = hit.groupBy("research_id", "workspace_id").agg(F.min("_r").alias("_r"))
    exposed = least.join(small(best.select("workspace_id", "_r", "best.wp")), ["workspace_id", "_r"]).select("research_id", "workspace_id", "wp")
    out = exposed.join(workspaces.select("workspace_id"), "workspace_id", "left_semi")
    if every:
        # One row for each research and workspace is what is asked for here; research meets the few workspaces in place.
        pairs = affected.select("research_id").distinct().join(small(workspaces.select("workspace_id")), F.lit(True))
        out = pairs.join(exposed, ["research_id", "workspace_id"], "left")
    return out.select("research_id", "workspace_id", F.when(F.col("wp").isNotNull(), "exposed").otherwise("not_exposed").alias("status"), F.when(F.col("wp").isNotNull(), F.concat(F.lit("runs "), "wp")).otherwise("no affected product").alias("reason"))


def coverage_gaps(required: DataFrame, workspaces: DataFrame, collected: DataFrame) -> DataFrame:
    """(workspace_id, ref, kind, data_source): what hunts need (ref, kind, data_source) and a workspace doesn't collect.

    For each workspace the missing sources are found first, among distinct data sources; they then meet the hunts.
    """
    needed = required.select("data_source").distinct()
    missing = workspaces.select("workspace_id").join(small(needed), F.lit(True)).join(collected.select("workspace_id", "data_source"), ["workspace_id", "data_source"], "left_anti")
    return required.select("ref", "kind", "data_source").distinct().join(small(missing), "data_source").select("workspace_id", "ref", "kind", "data_source")


def enriched(vulns: DataFrame, nvd: DataFrame, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """``vulns`` (cve, cvss, description, products, kev_added) with what the feeds know, and a validation mark.

    NVD fills score and description only where it has them and products only where there are none; the exploited-list
    fields always follow the list, also to null; EPSS fields follow the feed where it has the id.
    """
    cve = tx.cve_id(F.col("cve"))
    rows = vulns.withColumn("cve", cve)
    n = nvd.select("cve", F.col("exists").alias("n_exists"), F.col("state").alias("n_state"), F.col("score").alias("n_score"), F.col("description").alias("n_text"), F.col("products").alias("n_products"))
    out = rows.join(n, "cve", "left").join(kev.select("cve", F.col("date_added").alias("k_added")), "cve", "left").join(epss.select("cve", F.col("epss").alias("e_score")), "cve", "left")
    valid = tx.is_cve(F.col("cve"))
    mark = F.when(~valid, "invalid_format").when(F.col("n_exists").isNull(), "unchecked").when(~F.col("n_exists"), "not_found").when(F.lower("n_state") == "rejected", "rejected").otherwise("verified")
    none = F.coalesce(F.size("products"), F.lit(0)) <= 0
    return out.select(
        "cve",
        F.coalesce(F.when(F.col("n_score") != 0, F.col("n_score")), "cvss").alias("cvss"),
        F.coalesce(F.nullif("n_text", F.lit("")), "description").alias("description"),
        F.when(none, F.col("n_products")).otherwise(F.col("products")).alias("products"),
        F.col("k_added").alias("kev_added"),
        F.col("e_score").alias("epss"),
        mark.alias("validation"),
    )


def cached(wanted: DataFrame, cache: DataFrame, at: Column, *, keys: list[str], hours: int = 24) -> DataFrame:
    """``wanted`` with the cached value and state: cache (fresh), stale (older) or missing."""
    fresh = F.col("fetched_at") > at - F.expr(f"interval {hours} hours")
    return wanted.join(cache, keys, "left").withColumn("state", F.when(F.col("fetched_at").isNull(), "missing").when(fresh, "cache").otherwise("stale"))


def lookups(merged: DataFrame, *, most: int, sizes: str = "n_sources") -> DataFrame:
    """The cache misses to look up first: those that most sources report, ``most`` of them."""
    return merged.filter("state = 'missing'").orderBy(F.desc(sizes), "type", "value").limit(most)


def reviewed(iocs: DataFrame, decisions: DataFrame, overrides: DataFrame, include_expired: bool = False) -> DataFrame:
    """``iocs`` (key, pipeline_verdict) with the verdict that counts: analyst over library over pipeline."""
    out = iocs.join(decisions.select("key", F.col("verdict").alias("_a"), F.col("excluded").alias("_x")), "key", "left").join(overrides.select("key", F.col("verdict").alias("_l")), "key", "left")
    verdict = F.coalesce("_a", "_l", "pipeline_verdict")
    source = F.when(F.col("_a").isNotNull(), "analyst").when(F.col("_l").isNotNull(), "library").otherwise("pipeline")
    excluded = F.coalesce("_x", F.lit(False))
    hide = excluded | verdict.isin("benign", "false_positive") | ((verdict == "expired") & F.lit(not include_expired))
    return out.withColumns({"verdict": verdict, "verdict_source": source, "excluded": excluded, "hidden_from_hunts": hide}).drop("_a", "_x", "_l")


def hidden_keys(decisions: DataFrame, overrides: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(key): indicators that hunts leave out, from decisions, overrides and pipeline verdicts, of which any may lack a key."""
    out = decisions.select("key", F.col("verdict").alias("a"), F.col("excluded").alias("x")).join(overrides.select("key", F.col("verdict").alias("l")), "key", "full_outer").join(verdicts.select("key", F.col("verdict").alias("p")), "key", "full_outer")
    verdict = F.coalesce("a", "l", "p")
    return out.filter(F.coalesce("x", F.lit(False)) | verdict.isin("benign", "false_positive", "expired")).select("key")


def ungrounded(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(research_id, section, item, kind, unknown): items that cite no source, or one that the research hasn't."""
    cited = items.select("research_id", "section", "item", F.explode_outer(F.filter("source_ids", lambda s: s != "")).alias("source_id"))
    known = sources.select("research_id", "source_id").distinct().withColumn("ok", F.lit(True))
    state = cited.join(known, ["research_id", "source_id"], "left").groupBy("research_id", "section", "item").agg(
        F.count("source_id").alias("n"), F.array_sort(F.collect_set(F.when(F.col("source_id").isNotNull() & F.col("ok").isNull(), F.col("source_id")))).alias("unknown")
    )
    kind = F.when(F.col("n") == 0, "missing_source").when(F.size("unknown") > 0, "unknown_source")
    return state.select("research_id", "section", "item", kind.alias("kind"), "unknown").filter("kind is not null")


def grams(words: Column, n: Column) -> Column:
    """Distinct word n-grams, as texts."""
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def quotes_found(quotes: DataFrame, texts: DataFrame, share: float = 0.75, *, compatible: bool = False) -> DataFrame:
    """(quote_id, found): whether a quote (quote_id, source_id, quote) is in the text of a source it cites.

    Found means: in the text as a whole once both are made comparable, or with ``share`` of its distinct word n-grams. Empty
    quotes are found; quotes without any stored text are left out. With ``compatible`` compatibility forms count as plain ones.
    """
    q = quotes.select("quote_id", "source_id", tx.comparable(F.col("quote"), compatible=compatible).alias("q"))
    t = texts.select("source_id", tx.comparable(F.col("text"), compatible=compatible).alias("t"))
    near = q.join(t, "source_id")

    def shared(g: Column, n: Column) -> Column:
        # Words have single spaces, so a few n-grams are looked for in the text as they are; for many the text is cut as well.
        each = F.size(F.filter(g, lambda x: F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" ")))))
        return F.when(F.size(g) <= FEW_GRAMS, each).otherwise(F.size(F.array_intersect(g, grams(F.split("t", " "), n))))

    def enough(words: Column) -> Column:
        n = F.when(F.size(words) >= 6, 3).when(F.size(words) >= 3, 2).otherwise(1)
        return tx.let(grams(words, n), lambda g: shared(g, n) >= share * F.size(g))

    # The n-grams are only made where the plain search fails.
    hit = F.when((F.col("q") == "") | F.contains("t", "q"), True).otherwise(tx.let(F.split("q", " "), enough))
    return near.groupBy("quote_id").agg(F.bool_or(hit).alias("found"))


def routed(mails: DataFrame, tags: DataFrame, domains: DataFrame) -> DataFrame:
    """(mail_id, workspace_id, reason): where a mail belongs: recipient tag, then sender's domain, then original sender's."""
    from ..functions.indicators import plus_tags
    from ..functions.urls import parents

    by_tag = mails.select("mail_id", F.posexplode(plus_tags(F.col("recipients"))).alias("pos", "key")).join(small(tags.withColumnRenamed("tag", "key")), "key").select("mail_id", F.lit(0).alias("rank"), "pos", "workspace_id", F.concat(F.lit("tag "), "key").alias("reason"))
    parts = [by_tag]
    for rank, column in ((1, "sender"), (2, "original_sender")):
        rows = mails.filter(F.contains(column, F.lit("@"))).select("mail_id", F.posexplode(parents(F.substring_index(column, "@", -1))).alias("pos", "key"))
        parts.append(rows.join(small(domains.withColumnRenamed("domain", "key")), "key").select("mail_id", F.lit(rank).alias("rank"), "pos", "workspace_id", F.concat(F.lit("domain "), "key").alias("reason")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = every.groupBy("mail_id").agg(F.min(F.struct("rank", "pos", "workspace_id", "reason")).alias("b"))
    return best.select("mail_id", "b.workspace_id", "b.reason")


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")


def co_named(links: DataFrame, *, left: str, right: str) -> DataFrame:
    """(left_key, right_key, n): entities of two types by the number of research that name both."""
    side = lambda t, name: links.filter(F.col("entity_type") == t).select("research_id", F.col("entity_key").alias(name)).distinct()
    return side(left, "left_key").join(side(right, "right_key"), "research_id").groupBy("left_key", "right_key").agg(F.count("*").alias("n"))


def latest_verdict(rows: DataFrame) -> DataFrame:
    """(key, verdict): the verdict of the research that was updated last; the larger id breaks a tie."""
    return rows.groupBy("key").agg(F.max_by("verdict", F.struct("updated_at", "research_id")).alias("verdict"))


def cited_sources(opportunities: DataFrame, steps: DataFrame, mitre: DataFrame) -> DataFrame:
    """(opportunity_id, source_ids): of the step it detects, else of the techniques it has; natural order."""
    from ..functions.text import natural_order

    s = steps.select(F.col("ref").alias("behaviour_ref"), F.col("source_ids").alias("_s"))
    by_technique = opportunities.select("opportunity_id", F.explode("techniques").alias("technique_id")).join(mitre.select("technique_id", F.explode("source_ids").alias("x")), "technique_id").groupBy("opportunity_id").agg(F.collect_set("x").alias("_t"))
    out = opportunities.join(s, "behaviour_ref", "left").join(by_technique, "opportunity_id", "left")
    ids = F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.coalesce("_t", F.array().cast("array<string>")))
    return out.select("opportunity_id", natural_order(ids).alias("source_ids"))


def duplicates_of(seeds: DataFrame, research: DataFrame, cves: DataFrame, names: DataFrame, urls: DataFrame, most: int = 5) -> DataFrame:
    """(seed_id, research_id, reasons): live research that shares a CVE, a named actor or a source URL with a seed, ``most`` of it.

    The least ids count. Of each key only so many are joined: one that isn't among the first of a key isn't among a seed's first.
    """
    from .extract import dictionary_hits

    live = research.filter("status <> 'archived'").select("research_id").distinct()

    def first(rows: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy("research_id")
        mine = rows.select(key, "research_id").distinct().join(live, "research_id")
        return mine.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")

    cves, urls = first(cves, "cve"), first(urls, "url")
    named = first(names.withColumn("canonical", F.lower("name")), "canonical")
    text = seeds.select("seed_id", F.col("text"))
    by_cve = text.select("seed_id", F.explode(tx.cves(F.col("text"))).alias("cve")).join(cves, "cve").groupBy("seed_id", "research_id").agg(F.concat(F.lit("covers "), F.array_join(F.array_sort(F.collect_set("cve")), ", ")).alias("why")).withColumn("rank", F.lit(0))
    hits = dictionary_hits(text, names.select("name", F.lower("name").alias("canonical")).distinct(), id_col="seed_id", least=1)
    by_name = hits.join(named, "canonical").groupBy("seed_id", "research_id").agg(F.concat(F.lit("covers "), F.initcap(F.min("canonical"))).alias("why")).withColumn("rank", F.lit(1))
    by_url = seeds.select("seed_id", F.explode("urls").alias("url")).join(urls, "url").select("seed_id", "research_id", F.lit("uses the same source URL").alias("why")).distinct().withColumn("rank", F.lit(2))
    every = by_cve.unionByName(by_name).unionByName(by_url)
    joined = every.groupBy("seed_id", "research_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "why"))), lambda x: x["why"]), "; ").alias("reasons"))
    ranked = joined.withColumn("_n", F.row_number().over(Window.partitionBy("seed_id").orderBy("research_id")))
    return ranked.filter(F.col("_n") <= most).drop("_n")


def covering_step(ioas: DataFrame, steps: DataFrame, least: float = 0.5) -> DataFrame:
    """(ioa_id, ref, share): the step that shares most of an observation's words of four letters or more."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))
    a = ioas.select("research_id", "ioa_id", words(F.col("description")).alias("w")).withColumn("n", F.size("w"))
    b = steps.select("research_id", "ref", "pos", F.explode(words(F.col("behaviour"))).alias("word"))
    hits = a.select("research_id", "ioa_id", "n", F.explode("w").alias("word")).join(b, ["research_id", "word"]).groupBy("research_id", "ioa_id", "n", "ref", "pos").agg(F.count("*").alias("c"))
    rated = hits.withColumn("share", F.col("c") / F.col("n")).filter(F.col("share") >= least)
    best = rated.groupBy("research_id", "ioa_id").agg(F.max_by(F.struct("ref", "share"), F.struct("share", F.negative("pos"))).alias("b"))
    return best.select("research_id", "ioa_id", "b.*")


def lineage_edges(stated: DataFrame, inferred: DataFrame) -> DataFrame:
    """(src, dst, inferred): both kinds of links; a stated one outranks an inferred one."""
    both = stated.select("src", "dst", F.lit(False).alias("inferred")).unionByName(inferred.select("src", "dst", F.lit(True).alias("inferred")))
    return both.groupBy("src", "dst").agg(F.bool_and("inferred").alias("inferred"))


def notified(comments: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(comment_id, user_id, kind): who hears of a comment: those it mentions, else earlier writers of the thread; never its author."""
    authors = comments.select("comment_id", F.col("author").alias("_author"), "thread_id", "pos")
    told = mentioned.select("comment_id", "user_id").withColumn("rank", F.lit(0)).unionByName(
        authors.join(comments.select("thread_id", F.col("author").alias("user_id"), F.col("pos").alias("_p")), "thread_id").filter("_p < pos").select("comment_id", "user_id", F.lit(1).alias("rank"))
    )
    out = told.join(authors.select("comment_id", "_author"), "comment_id").filter("user_id <> _author").groupBy("comment_id", "user_id").agg(F.min("rank").alias("rank"))
    return out.select("comment_id", "user_id", F.when(F.col("rank") == 0, "mention").otherwise("reply").alias("kind"))


def source_states(found: DataFrame, read: DataFrame, excluded: DataFrame) -> DataFrame:
    """(source_id, state): excluded, read, failed or pending."""
    out = found.join(read.select("source_id", "ok"), "source_id", "left").join(excluded.select("source_id").distinct().withColumn("_x", F.lit(True)), "source_id", "left")
    return out.select("source_id", F.when(F.col("_x"), "excluded").when(F.col("ok"), "read").when(~F.col("ok"), "failed").otherwise("pending").alias("state"))


def stix_relations(named: DataFrame, indicators: DataFrame) -> DataFrame:
    """(src, dst, kind): an indicator points at the malware its text names, else the actors it names, else all actors of its research; once a research.

    The names of a research are few and go to its indicators as one list; a research with more than ``patterns.EACH`` meets its by anchors.
    """
    rank = F.when(F.col("type") == "malware", 0).otherwise(1)
    named = named.filter(F.col("type").isin("malware", "actor")).select("research_id", rank.alias("rank"), "entity_id", F.lower("name").alias("name"))
    texts = indicators.select("research_id", "indicator_id", F.lower("text").alias("text"))
    few, large, _ = by_size(named, ["research_id"])
    lists = few.repartition("research_id").groupBy("research_id").agg(F.collect_set(F.struct("rank", "entity_id", "name")).alias("_list"))
    near = texts.repartition("research_id").join(lists, "research_id")
    entry = lambda x, r: F.struct(r.alias("rank"), x["entity_id"].alias("entity_id"))
    told = F.transform(F.filter("_list", lambda x: (x["name"] != "") & F.contains("text", x["name"])), lambda x: entry(x, x["rank"]))
    actors = F.transform(F.filter("_list", lambda x: x["rank"] == 1), lambda x: entry(x, F.lit(2)))
    meant = tx.let(F.coalesce(told, F.array().cast("array<struct<rank:int,entity_id:string>>")), lambda t: F.when(F.size(t) > 0, F.filter(t, lambda x: x["rank"] == F.array_min(F.transform(t, lambda y: y["rank"])))).otherwise(actors))
    rows = near.select("research_id", "indicator_id", F.explode_outer(meant).alias("_x")).filter("_x is not null").select("research_id", "indicator_id", "_x.*").distinct()
    # An indicator may have several texts; the best that one of them says counts.
    least = F.min("rank").over(Window.partitionBy("research_id", "indicator_id"))
    out = rows.withColumn("_least", least).filter("rank = _least").select("indicator_id", "entity_id")
    if large is not None:
        mine = lambda x: x.join(large, "research_id", "left_semi")
        out = out.unionByName(_by_anchors(mine(named), mine(texts)))
    return out.select(F.col("indicator_id").alias("src"), F.col("entity_id").alias("dst"), F.lit("indicates").alias("kind"))


def _by_anchors(named: DataFrame, texts: DataFrame) -> DataFrame:
    """(indicator_id, entity_id) of ``stix_relations``, for research that names much."""
    hits = occurrences(texts.withColumnRenamed("indicator_id", "text_id"), named.select("research_id", F.struct("rank", "entity_id").alias("pattern_id"), F.col("name").alias("pattern")), scope=["research_id"])
    hits = hits.select("research_id", F.col("text_id").alias("indicator_id"), "pattern_id.*")
    best = hits.groupBy("research_id", "indicator_id").agg(F.min("rank").alias("rank"))
    told = hits.join(best, ["research_id", "indicator_id", "rank"]).select("research_id", "indicator_id", "entity_id")
    # Only indicators whose text names nobody meet all actors of their research.
    silent = texts.select("research_id", "indicator_id").join(best, ["research_id", "indicator_id"], "left_anti")
    rest = silent.join(named.filter("rank = 1").select("research_id", "entity_id"), "research_id").select("research_id", "indicator_id", "entity_id")
    return told.unionByName(rest).distinct().select("indicator_id", "entity_id")
