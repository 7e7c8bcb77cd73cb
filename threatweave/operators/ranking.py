"""Ranking, dedup, numbering and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ul
from .joins import small


def first_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; rows without a time come last."""
    return first_by_key(rows, keys, [F.desc_nulls_last(at), F.desc(tie)])


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def without_syndicated(sources: DataFrame) -> DataFrame:
    """Of sources with the same title key the best-scored, newest one; sources without a title all stay.

    Untitled rows are set aside first, so that they form no group.
    """
    rows = sources.withColumn("_k", tx.title_key(F.col("title")))
    named = first_by_key(rows.filter("_k <> ''"), ["_k"], [F.desc("score"), F.desc_nulls_last("published"), F.asc("source_id")])
    return named.unionByName(rows.filter("_k = ''")).drop("_k")


def rank_sources(candidates: DataFrame, limit: int) -> DataFrame:
    """Candidates of all origins: one row per canonical URL (seed before feed before web), no syndicated copies, best first."""
    origin = F.when(F.col("origin") == "seed", 0).when(F.col("origin") == "vendor_feed", 1).otherwise(2)
    keyed = candidates.withColumn("_c", ul.canonical(F.col("url")))
    unique = first_by_key(keyed, ["_c"], [origin, F.asc("source_id")]).drop("_c")
    return without_syndicated(unique).orderBy(F.desc("score"), F.desc_nulls_last("published"), "source_id").limit(limit)


def feed_items(items: DataFrame, since: Column, per_feed: int = 60) -> DataFrame:
    """Feed entries with an http link, a title and a date from ``since`` on: the first ``per_feed`` of each feed, one a canonical URL."""
    head = items.withColumn("_n", F.row_number().over(Window.partitionBy("feed").orderBy("pos"))).filter(F.col("_n") <= per_feed)
    good = head.filter(F.col("url").rlike("(?i)^https?://") & (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.col("published") >= since))
    summary = F.substring(F.trim(F.regexp_replace(F.regexp_replace("summary", "<[^>]+>", " "), r"\s+", " ")), 1, 600)
    keyed = good.withColumn("canonical", ul.canonical(F.col("url"))).withColumn("summary", summary)
    return first_by_key(keyed, ["canonical"], [F.asc("feed"), F.asc("pos")]).drop("_n")


def spaced(events: DataFrame, keys: list[str], at: str, minutes: int) -> DataFrame:
    """Events at least ``minutes`` after the last kept one of their key.

    Whether an event is kept depends on the one kept before, so a key's times are folded in order; only times are
    gathered, and a gap of more than the window starts a new group, so a group is a burst and not a key's whole history.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    window = minutes * 60 * 1_000_000
    order = Window.partitionBy(*keys).orderBy("_t")
    rows = events.select(*keys, t.alias("_t")).withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(order) > window).cast("int"), F.lit(1)))
    rows = rows.withColumn("_burst", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def step(acc: Column, x: Column) -> Column:
        keep = F.coalesce(x - acc["last"] >= window, F.lit(True))
        return F.struct(F.when(keep, x).otherwise(acc["last"]).alias("last"), F.when(keep, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))
    times = rows.groupBy(*keys, "_burst").agg(F.array_sort(F.collect_list("_t")).alias("ts"))
    kept = times.select(*keys, F.explode(F.aggregate("ts", start, step, lambda acc: acc["out"])).alias("_t"))
    return kept.select(*keys, F.timestamp_micros("_t").alias(at))


def busy_time(spans: DataFrame, keys: list[str], start: str, end: str, at: Column | None = None) -> DataFrame:
    """(keys, seconds): length of the union of a key's intervals; open ones end at ``at``, empty ones count nothing."""
    s = F.unix_micros(F.col(start).cast("timestamp"))
    e = F.unix_micros((F.coalesce(F.col(end), at) if at is not None else F.col(end)).cast("timestamp"))
    rows = spans.select(*keys, s.alias("s"), F.greatest(s, e).alias("e")).filter("s is not null and e is not null")
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("s"))
    new = rows.withColumn("own", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), reach)))
    return new.groupBy(*keys).agg((F.sum("own") / 1e6).alias("seconds"))


def previous_version(versions: DataFrame) -> DataFrame:
    return versions.withColumn("previous", F.lag("version").over(Window.partitionBy("research_id").orderBy("version")))


def numbered(rows: DataFrame, group: list[str], order: list[Column], prefix: str, name: str = "number") -> DataFrame:
    """Rows with ids prefix1, prefix2 ... within their group."""
    return rows.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("string")))


def carried_numbers(rows: DataFrame, group: list[str], carrier: str, prefix: str, name: str = "number") -> DataFrame:
    """Rows with ids that equal carriers share, numbered in the order of the carrier."""
    return rows.withColumn(name, F.concat(F.lit(prefix), F.dense_rank().over(Window.partitionBy(*group).orderBy(carrier)).cast("string")))


def keep_last(items: DataFrame, keys: list[str], at: str, value: str, n: int) -> DataFrame:
    """(keys, values): the last n values in order. They are ranked first, so that no more are gathered."""
    last = items.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(value)))).filter(F.col("_r") <= n)
    ordered = F.array_sort(F.collect_list(F.struct(F.negative("_r").alias("_r"), value)))
    return last.groupBy(*keys).agg(F.transform(ordered, lambda x: x[value]).alias("values"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the ordered rows; the size is held between 1 and 500."""
    size = max(1, min(size, 500))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def best_opportunities(opps: DataFrame, *, per_step: int = 2, most: int = 15) -> DataFrame:
    """The best detections per attack step and research, renumbered.

    opps (research_id, idx, spec_key, step, techniques, score). Rows of the same logic merge into the first, which takes
    their techniques; of a step (or first technique) the ``per_step`` best stay, of a research the ``most`` best.
    """
    merged = opps.groupBy("research_id", "spec_key").agg(
        F.min_by(F.struct("idx", "step", "score"), "idx").alias("f"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "techniques"))), lambda x: x["techniques"]))).alias("techniques")
    )
    rows = merged.select("research_id", "spec_key", "techniques", "f.*").withColumn("_s", F.coalesce("step", F.concat(F.lit("tech:"), F.coalesce(F.get("techniques", F.lit(0)), F.lit("")))))
    best = top_per_group(rows, ["research_id", "_s"], [F.desc("score"), F.asc("idx")], per_step).drop("rank", "_s")
    kept = top_per_group(best, ["research_id"], [F.desc("score"), F.asc("idx")], most).drop("rank")
    return numbered(kept, ["research_id"], [F.asc("idx")], "DO-", "opportunity_id")


def opportunity_score(conditions: Column, category: Column, step_technique: Column, techniques: Column, kind: Column) -> Column:
    """Conditions, half a point a field, the category's worth, two for the step's technique, one for behaviour rules."""
    fields = F.size(F.array_distinct(F.transform(conditions, lambda c: c["field"])))
    worth = F.when(category.isin("process_creation", "web"), 2).when(category == "file_event", 1).otherwise(0)
    match = F.coalesce(F.array_contains(techniques, step_technique), F.lit(False))
    return F.size(conditions) + 0.5 * fields + worth + F.when(match, 2).otherwise(0) + F.when(kind == "ioa", 1).otherwise(0)


def mitre_rows(rows: DataFrame, catalogue: DataFrame, tactics: DataFrame) -> DataFrame:
    """Technique rows of the catalogue, one per technique and tactic, in kill-chain order (column ``pos``).

    A row's tactic stays if the technique has it, else it is the technique's first one. catalogue (technique_id, name, tactics).
    """
    known = rows.withColumn("technique_id", F.upper(F.trim("technique_id"))).join(small(catalogue), "technique_id")
    tactic = F.when(F.array_contains("tactics", F.col("tactic_id")), F.col("tactic_id")).otherwise(F.get("tactics", F.lit(0)))
    sub = F.col("technique_id").contains(".")
    named = known.withColumn("tactic_id", tactic).withColumn("technique", F.when(sub, F.substring_index("name", ": ", 1)).otherwise(F.col("name"))).withColumn("sub_technique", F.when(sub, F.regexp_extract("name", "^.*?: (.*)$", 1)).otherwise(""))
    unique = first_by_key(named, ["research_id", "technique_id", "tactic_id"], [F.asc("idx")])
    return unique.join(small(tactics.select("tactic_id", "pos")), "tactic_id", "left").select("research_id", "pos", "tactic_id", "technique_id", "technique", "sub_technique", "procedure")


def dropped_techniques(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    return rows.select(F.upper(F.trim("technique_id")).alias("technique_id")).distinct().join(small(catalogue), "technique_id", "left_anti")
