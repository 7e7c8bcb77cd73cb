"""Clusters of reports, lineage and degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.writers import folder


#: Articles of a part of a key, and keys with parts that are broadcast at most.
SPLIT, BROADCAST_KEYS = 100_000, 1_000_000


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that driver and executors share, and read back: its lineage ends there."""
    path = folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def article_keys(articles: DataFrame) -> DataFrame:
    """(article_id, key): the CVEs, actors and malware a report names; its title key if it names none."""
    tagged = lambda c, kind: F.transform(c, lambda x: F.concat(F.lit(kind + ":"), x if kind == "cve" else F.lower(x)))
    keys = F.concat(tagged(F.col("cves"), "cve"), tagged(F.col("actors"), "actor"), tagged(F.col("malware"), "malware"))
    own = F.when(F.size(keys) > 0, F.array_distinct(keys)).otherwise(F.array(F.concat(F.lit("title:"), tx.title_key(F.col("title")))))
    return articles.select("article_id", F.explode(own).alias("key"))


def clusters(keys: DataFrame, split: int = SPLIT) -> DataFrame:
    """(article_id, cluster_id): articles that share keys, directly or through others; the id is the least article's.

    Articles and keys form a graph of two sides, so a key that many share costs one edge each. In every round a key
    takes the least label of its articles, an article the least of its keys, and then the label of its label. A key with more
    than ``split`` articles is cut into parts: its label is told to each part, so no task gets all of its articles.
    """
    edges = saved(keys.select("article_id", "key").distinct())
    hot = saved(edges.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > split).select("key", F.ceil(F.col("n") / split).cast("int").alias("parts")))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
    part = F.coalesce(F.pmod(F.xxhash64("article_id"), F.col("parts")), F.lit(0))
    edges = saved(edges.join(hot, "key", "left").select("article_id", "key", part.cast("int").alias("part")))
    labels = saved(edges.select("article_id").distinct().withColumn("cluster_id", F.col("article_id")))
    while True:
        by_key = edges.join(labels, "article_id").groupBy("key").agg(F.min("cluster_id").alias("low"))
        told = by_key.join(hot, "key", "left").select("key", "low", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        heard = edges.join(told, ["key", "part"]).groupBy("article_id").agg(F.min("low").alias("low"))
        jump = labels.select(F.col("article_id").alias("low"), F.col("cluster_id").alias("far"))
        moved = labels.join(heard, "article_id").join(jump, "low", "left")
        moved = saved(moved.select("article_id", F.least("cluster_id", "low", "far").alias("new"), (F.least("cluster_id", "low", "far") < F.col("cluster_id")).alias("changed")))
        labels = moved.select("article_id", F.col("new").alias("cluster_id"))
        if moved.filter("changed").isEmpty():
            return labels


def ranked_clusters(articles: DataFrame, members: DataFrame, at: Column) -> DataFrame:
    """One row a cluster, scored: publishers, CVEs, government sources, named actors or malware, freshness."""
    rows = articles.join(members, "article_id")
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("reliability", "published", "article_id", c))), lambda x: x[c])))
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("reliability", "published", "article_id", "publisher"))), lambda x: x["publisher"]))
    out = rows.groupBy("cluster_id").agg(
        F.count("*").alias("n_articles"), ordered.alias("publishers"), F.array_sort(flat("cves")).alias("cves"), flat("actors").alias("actors"), flat("malware").alias("malware"),
        F.max("published").alias("newest"), F.bool_or(F.col("reliability") == "A").alias("official"), F.min_by("title", F.struct("reliability", "published", "article_id")).alias("title"),
    )
    many, cve, named = F.size("publishers") > 1, F.size("cves") > 0, (F.size("actors") > 0) | (F.size("malware") > 0)
    fresh = F.col("newest") >= at - F.expr("interval 12 hours")
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = 3 * F.size("publishers") + points(cve, 2) + points(F.col("official"), 2) + points(named, 1) + points(fresh, 1)
    why = F.filter(F.array(F.when(many, F.concat(F.lit("reported by "), F.size("publishers").cast("string"), F.lit(" publishers"))), F.when(cve, "names a CVE"), F.when(F.col("official"), "government advisory"), F.when(named, "named actor or malware"), F.when(fresh, "published in the last 12 h")), lambda w: w.isNotNull())
    label = F.concat(F.slice("cves", 1, 2), F.slice("actors", 1, 1), F.slice("malware", 1, 1))
    return out.select("cluster_id", "n_articles", "publishers", "cves", "actors", "malware", "newest", "title", F.when(F.size(label) > 0, F.array_join(label, " · ")).otherwise(F.col("title")).alias("label"), score.cast("long").alias("score"), why.alias("why"))


def picked(ranked: DataFrame, members: DataFrame, keys: DataFrame, seen: DataFrame, cutoff: Column, limit: int) -> DataFrame:
    """The best clusters none of whose keys were sent since the cutoff."""
    old = keys.join(seen.filter(F.col("at") >= cutoff).select("key"), "key", "left_semi").join(members, "article_id").select("cluster_id").distinct()
    return ranked.join(old, "cluster_id", "left_anti").orderBy(F.desc("score"), F.desc("newest"), "cluster_id").limit(limit)


def lineage(edges: DataFrame, starts: DataFrame, depth: int = 7) -> DataFrame:
    """(start, node, direction): everything up and down the layered graph from each start; ``depth`` is the number of layers."""
    def walk(src: str, dst: str, name: str) -> DataFrame:
        reach = starts.select(F.col("node").alias("start"), "node")
        step, parts = reach, []
        for _ in range(depth):
            step = step.join(edges.select(F.col(src).alias("node"), F.col(dst).alias("to")), "node").select("start", F.col("to").alias("node")).distinct()
            parts.append(step)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct().withColumn("direction", F.lit(name))

    return walk("src", "dst", "down").unionByName(walk("dst", "src", "up"))


def folded(edges: DataFrame, nodes: DataFrame, most: int = 12, keep: int = 10) -> DataFrame:
    """Nodes (column, node) with ``shown``: crowded columns show the nodes with an exit, most exits, most entries."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"))
    rows = nodes.join(out, "node", "left").join(into, "node", "left").fillna(0, ["outs", "ins"])
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc(F.col("outs") > 0), F.desc("outs"), F.desc("ins"), "node"))
    n = F.count("*").over(Window.partitionBy("column"))
    return rows.withColumn("_r", rank).withColumn("_n", n).select("column", "node", "outs", "ins", ((F.col("_n") <= most) | (F.col("_r") <= keep)).alias("shown"))


def same_technique(a: Column, b: Column) -> Column:
    """Equal, or one the parent of the other."""
    top = lambda c: F.substring_index(c, ".", 1)
    return (a == b) | (top(a) == b) | (a == top(b))
