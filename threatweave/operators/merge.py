"""Upserts: a current table and its changes become the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import later_status, status_rank


def given(new: Column, old: Column) -> Column:
    """The new value unless it is null, empty or zero."""
    return F.coalesce(new, old)


def text_or(new: str, old: str) -> Column:
    return F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))


def number_or(new: str, old: str) -> Column:
    return F.coalesce(F.when(F.col(new) != 0, F.col(new)), F.col(old))


def list_or(new: str, old: str) -> Column:
    return F.when(F.coalesce(F.size(new), F.lit(0)) > 0, F.col(new)).otherwise(F.col(old))


def union_sorted(a: str, b: str) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def rebuilt_links(current: DataFrame, changed: DataFrame) -> DataFrame:
    """The link table after the research in ``changed`` gave its links anew."""
    keep = current.join(changed.select("research_id").distinct(), "research_id", "left_anti")
    return keep.unionByName(changed.select(*current.columns)).distinct()


def resolved_actors(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(name, actor_id): the library actor of each new name: by its slug, else by an alias, else by one of its own aliases."""
    from ..functions.text import slug

    own = slug(F.col("name"))
    by_id = changes.select("name", own.alias("actor_id")).join(current.select("actor_id"), "actor_id").select("name", F.lit(0).alias("rank"), "actor_id")
    alias = current.select("actor_id", F.explode("aliases").alias("a")).select("actor_id", F.lower("a").alias("a"))
    by_alias = changes.select("name", F.lower("name").alias("a")).join(alias, "a").select("name", F.lit(1).alias("rank"), "actor_id")
    named = current.select("actor_id", F.lower("name").alias("a"))
    by_own = changes.select("name", F.explode("aliases").alias("a")).select("name", F.lower("a").alias("a")).join(named, "a").select("name", F.lit(1).alias("rank"), "actor_id")
    found = by_id.unionByName(by_alias).unionByName(by_own).groupBy("name").agg(F.min(F.struct("rank", "actor_id")).alias("b"))
    return changes.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("b.actor_id", own).alias("actor_id"))


def merged_actors(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The actor library after changes (name, aliases, origin, motivation, seen_at): sets unite, the last sighting is kept."""
    ids = resolved_actors(current, changes)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    new = changes.join(ids, "name").groupBy("actor_id").agg(F.min_by("name", "seen_at").alias("n_name"), flat("aliases").alias("n_aliases"), F.max_by(F.nullif("origin", F.lit("")), F.when(F.col("origin") != "", F.col("seen_at"))).alias("n_origin"), flat("motivation").alias("n_motivation"), F.max("seen_at").alias("n_seen"))
    out = current.join(new, "actor_id", "full_outer")
    name = F.coalesce("name", "n_name")
    return out.select("actor_id", name.alias("name"), F.array_except(union_sorted("aliases", "n_aliases"), F.array(name)).alias("aliases"), F.coalesce("n_origin", "origin").alias("origin"), union_sorted("motivation", "n_motivation").alias("motivation"), F.greatest("last_seen", "n_seen").alias("last_seen"))


def merged_malware(current: DataFrame, changes: DataFrame, most: int = 2000) -> DataFrame:
    """The malware library: a role text that isn't in the capabilities yet is added at their end."""
    new = changes.select("malware_id", F.col("name").alias("n_name"), F.col("role").alias("n_role"), F.col("seen_at").alias("n_seen"))
    out = current.join(new, "malware_id", "full_outer")
    old = F.coalesce("capabilities", F.lit(""))
    more = F.when((F.coalesce("n_role", F.lit("")) == "") | F.contains(old, "n_role"), old).otherwise(F.substring(F.trim(F.concat_ws(" ", old, "n_role")), 1, most))
    return out.select("malware_id", F.coalesce("name", "n_name").alias("name"), more.alias("capabilities"), F.greatest("last_seen", "n_seen").alias("last_seen"))


def merged_cves(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The vulnerability library: empty or zero news leave the old value."""
    new = changes.select("cve", *[F.col(c).alias(f"n_{c}") for c in changes.columns if c != "cve"])
    out = current.join(new, "cve", "full_outer")
    return out.select("cve", number_or("n_cvss", "cvss").alias("cvss"), number_or("n_epss", "epss").alias("epss"), text_or("n_description", "description").alias("description"), list_or("n_products", "products").alias("products"))


def merged_iocs(current: DataFrame, changes: DataFrame, overrides: DataFrame, keep: int = 20) -> DataFrame:
    """The indicator library after one research's indicators (key, research_id, verdict, context, first_seen).

    An override outranks the news; the research's old context is replaced; the last ``keep`` contexts stay; the earliest
    sighting counts.
    """
    new = changes.select("key", F.col("verdict").alias("n_verdict"), F.col("first_seen").alias("n_first"), F.struct("research_id", "context").alias("n_ctx"))
    out = current.join(new, "key", "full_outer").join(overrides.select("key", F.col("verdict").alias("o_verdict")), "key", "left")
    none = F.array().cast("array<struct<research_id:string,context:string>>")
    old = F.filter(F.coalesce("contexts", none), lambda c: ~c["research_id"].eqNullSafe(F.col("n_ctx.research_id")))
    all_ = F.when(F.col("n_ctx").isNull(), F.coalesce("contexts", none)).otherwise(F.concat(old, F.array("n_ctx")))
    last = F.slice(all_, F.greatest(F.size(all_) - keep + 1, F.lit(1)), keep)
    verdict = F.when(F.col("n_verdict").isNull(), F.col("verdict")).otherwise(F.coalesce("o_verdict", "n_verdict"))
    return out.select("key", verdict.alias("verdict"), F.least("first_seen", "n_first").alias("first_seen"), last.alias("contexts"))


def merged_queries(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The query library: a status never falls back, and a deployed query is at least deployed."""
    new = changes.select("query_id", F.col("title").alias("n_title"), F.col("status").alias("n_status"))
    out = current.join(new, "query_id", "full_outer")
    status = F.when(F.col("status").isNull(), F.col("n_status")).when(F.col("n_status").isNull(), F.col("status")).otherwise(later_status(F.col("status"), F.col("n_status")))
    floor = F.when(F.coalesce("deployed", F.lit(False)) & (status_rank(status) < status_rank(F.lit("deployed"))), "deployed").otherwise(status)
    return out.select("query_id", F.coalesce("n_title", "title").alias("title"), floor.alias("status"), F.coalesce("deployed", F.lit(False)).alias("deployed"))


def orphaned(old_links: DataFrame, new_links: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id): queries that lost their last link and aren't deployed."""
    lost = old_links.select("query_id").distinct().join(new_links.select("query_id"), "query_id", "left_anti")
    return lost.join(queries.filter("not deployed").select("query_id"), "query_id", "left_semi")


def decided(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Analyst decisions after changes: given fields replace, restoring deletes, what is left empty goes."""
    new = changes.select("key", F.col("verdict").alias("n_verdict"), F.col("excluded").alias("n_excluded"), F.col("note").alias("n_note"), F.col("restore").alias("n_restore"))
    out = current.join(new, "key", "full_outer").filter(~F.coalesce("n_restore", F.lit(False)))
    out = out.select("key", F.coalesce("n_verdict", "verdict").alias("verdict"), F.coalesce("n_excluded", "excluded", F.lit(False)).alias("excluded"), text_or("n_note", "note").alias("note"))
    return out.filter("verdict is not null or excluded or note is not null")


def regrouped(old: DataFrame, new: DataFrame) -> DataFrame:
    """(research_id, group_id, action, before, after): what happens to each indicator group from its old and new values."""
    sets = lambda f, n: f.groupBy("research_id", "group_id").agg(F.array_sort(F.collect_set("value")).alias(n))
    both = sets(old, "o").join(sets(new, "n"), ["research_id", "group_id"], "full_outer")
    action = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return both.select("research_id", "group_id", action.alias("action"), count("o").alias("before"), count("n").alias("after"))


def created_results(research: DataFrame, results: DataFrame, exposure: DataFrame) -> DataFrame:
    """(research_id, workspace_id, status): result rows that don't exist yet; not applicable where a workspace isn't exposed."""
    wanted = research.select("research_id", F.explode(F.array_distinct("workspace_ids")).alias("workspace_id")).join(results.select("research_id", "workspace_id"), ["research_id", "workspace_id"], "left_anti")
    out = wanted.join(exposure.select("research_id", "workspace_id", F.col("status").alias("_e")), ["research_id", "workspace_id"], "left")
    return out.select("research_id", "workspace_id", F.when(F.col("_e") == "not_exposed", "not_applicable").otherwise("pending").alias("status"))


def repaired(runs: DataFrame) -> DataFrame:
    """Runs that a restart cut off: running and queued ones failed, and so did their running stages (map stage -> state)."""
    cut = F.col("state").isin("running", "queued")
    stages = F.transform_values("stages", lambda k, v: F.when(v == "running", "failed").otherwise(v))
    return runs.withColumn("stages", F.when(cut, stages).otherwise(F.col("stages"))).withColumn("state", F.when(cut, "failed").otherwise(F.col("state")))


def kept_edits(new: DataFrame, old: DataFrame) -> DataFrame:
    """Sections (research_id, section, body) of a new run; those that a person edited keep their old body."""
    edits = old.filter("edited").select("research_id", "section", F.col("body").alias("_old"))
    return new.join(edits, ["research_id", "section"], "left").select("research_id", "section", F.coalesce("_old", "body").alias("body"), F.col("_old").isNotNull().alias("edited"))


def remembered(seen: DataFrame, sent: DataFrame, cutoff: Column) -> DataFrame:
    """Keys with the last time they were sent; those before the cutoff are forgotten."""
    return seen.unionByName(sent).groupBy("key").agg(F.max("at").alias("at")).filter(F.col("at") >= cutoff)
