"""Search over research and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.text import refang


def research(rows: DataFrame, query: str, limit: int = 6) -> DataFrame:
    """Live research with the text in its id or search text: exact id, then id prefix, then newest. The text is taken as it is."""
    q = query.strip().lower()
    live = rows.filter((F.col("status") != "archived") & (F.contains(F.lower("research_id"), F.lit(q)) | F.contains("search_text", F.lit(q))))
    rank = F.when(F.lower("research_id") == q, 0).when(F.startswith(F.lower("research_id"), F.lit(q)), 1).otherwise(2)
    return live.orderBy(rank, F.desc("updated_at"), "research_id").limit(limit).select("research_id", "title", "status")


def entities(rows: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(type, key, title, rank): per type the entities with the text in their title, exact ones first."""
    q = query.strip().lower()
    hits = rows.filter(F.contains(F.lower("title"), F.lit(q)))
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.when(F.lower("title") == q, 0).otherwise(1), "title", "key"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit)


def groups(rows: DataFrame, query: str, limits: dict[str, int]) -> DataFrame:
    """(type, key, title, rank): the best hits of each type, as many as ``limits`` says.

    rows has (type, key, title, text, recent): ``text`` is searched besides title and key. Exact titles or keys come first, keys that
    begin with the query next, then the greatest ``recent``, the title and the key.
    """
    q = query.strip().lower()
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    hits = rows.filter(F.col("type").isin(*limits) & (F.contains(low("title"), F.lit(q)) | F.contains(low("key"), F.lit(q)) | F.contains(low("text"), F.lit(q))))
    place = F.when((low("title") == q) | (low("key") == q), 0).when(F.startswith(low("key"), F.lit(q)), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("type").orderBy(place, F.desc_nulls_last("recent"), "title", "key"))
    most = F.lit(0)
    for kind, n in limits.items():
        most = F.when(F.col("type") == kind, n).otherwise(most)
    # The first condition is one number, so that tasks keep the best rows only before the shuffle.
    return hits.withColumn("rank", rank).filter(F.col("rank") <= max(limits.values())).filter(F.col("rank") <= most).select("type", "key", "title", "rank")


def jump(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, type, key): the entity that a typed query names exactly: a CVE, an indicator or a research id."""
    plain = refang(F.col("query"))
    kind = ind.kind_of(F.col("query"))
    typed = queries.select("query", F.when(plain.rlike(r"(?i)^tr-\d{4}-\d+$"), "research").when(kind == "cve", "cve").when(kind.isin("ipv4", "domain", "url", "sha256", "sha1", "md5"), "ioc").alias("type"), F.lower(plain).alias("low")).filter("type is not null")
    return typed.join(rows.select("type", F.lower("title").alias("low"), "key"), ["type", "low"]).select("query", "type", "key")


def trigrams(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(trigram, id): an index that finds texts by any part of three letters or more."""
    t = F.lower(text_col)
    parts = F.when(F.length(t) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))))
    return rows.select(F.col(id_col).alias("id"), F.explode(parts).alias("trigram"))


def by_trigrams(index: DataFrame, rows: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """Rows with the text, found by the index and confirmed in the text."""
    q = query.strip().lower()
    wanted = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    ids = index.filter(F.col("trigram").isin(*wanted)).groupBy("id").agg(F.count_distinct("trigram").alias("n")).filter(F.col("n") == len(wanted))
    return rows.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi").filter(F.contains(F.lower(text_col), F.lit(q)))


def topped_up(first: DataFrame, second: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows of ``first`` and, after them, those of ``second`` that it hasn't, ``limit`` in all. Both have a ``rank``."""
    more = second.join(first.select(key), key, "left_anti").withColumn("_o", F.lit(1))
    return first.withColumn("_o", F.lit(0)).unionByName(more).orderBy("_o", "rank", key).limit(limit).drop("_o")


def listed(rows: DataFrame, **f) -> DataFrame:
    """The research list: values of a facet are alternatives, facets add up; archived research only when asked for."""
    status = f.get("status")
    out = rows.filter(F.col("status").isin(*status)) if status else rows.filter("status <> 'archived'")
    for name in ("severity", "created_by"):
        if f.get(name):
            out = out.filter(F.col(name).isin(*f[name]))
    if f.get("workspace") and f["workspace"] != "all":
        out = out.filter(F.array_contains("workspace_ids", f["workspace"]))
    if f.get("date_from"):
        out = out.filter(F.to_date("created_at") >= F.lit(f["date_from"]).cast("date"))
    if f.get("date_to"):
        out = out.filter(F.to_date("created_at") <= F.lit(f["date_to"]).cast("date"))
    for term in (f.get("q") or "").lower().split():
        out = out.filter(F.contains("search_text", F.lit(term)) | F.contains(F.lower("research_id"), F.lit(term)))
    for name, low in (("actors", True), ("cves", False), ("techniques", False)):
        if f.get(name):
            value = f[name].lower() if low else f[name].upper()
            out = out.filter(F.array_contains(F.transform(name, F.lower if low else F.upper), value))
    return out


SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}
