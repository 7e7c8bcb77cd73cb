"""Roll-ups over research, results, queries and events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import status_rank
from .joins import small
from .patterns import sequence_within


def period_bounds(period: str, today: dt.date, first: dt.date | None = None, last: dt.date | None = None) -> tuple[dt.datetime, dt.datetime]:
    """Start and end of a period in words; a period that is under way ends today. Weeks begin on Monday."""
    quarter = dt.date(today.year, 3 * ((today.month - 1) // 3) + 1, 1)
    end = today
    if period == "custom" and first and last:
        start, end = first, last
    elif period == "week":
        start = today - dt.timedelta(days=today.weekday())
    elif period == "month":
        start = today.replace(day=1)
    elif period == "year":
        start = today.replace(month=1, day=1)
    elif period == "last_quarter":
        end = quarter - dt.timedelta(days=1)
        start = dt.date(end.year, 3 * ((end.month - 1) // 3) + 1, 1)
    else:
        start = quarter
    return dt.datetime.combine(start, dt.time.min), dt.datetime.combine(end, dt.time.max)


def previous(start: dt.datetime, end: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """The period of the same length that ends one second before."""
    second = dt.timedelta(seconds=1)
    return start - (end - start) - second, start - second


def within(column: str | Column, bounds: tuple[dt.datetime, dt.datetime]) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    lit = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return c.between(lit(bounds[0]), lit(bounds[1]))


def exact_medians(rows: DataFrame, key: str, value: str, *, bins: int = 1024, few: int = 10_000) -> dict[str, float]:
    """The exact median of each key's values (doubles); keys are few, values may be many.

    Ranges that hold the middle values are cut into ``bins`` and counted, again and again, until no more than ``few`` values are left
    in a key's range; those are ordered by the driver. So no task holds more than counts, however many values a key has.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    state = {r["k"]: {"below": 0, "n": r["n"], "in": r["n"], "lo": r["lo"], "hi": r["hi"]} for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    out: dict[str, float] = {}
    while True:
        for k in [k for k, s in state.items() if s["lo"] == s["hi"]]:
            out[k] = state.pop(k)["lo"]
        open_ = {k: s for k, s in state.items() if s["in"] > few}
        if not open_:
            break
        where = F.lit(None)
        for k, s in open_.items():
            cut = F.least(F.floor((F.col("v") - s["lo"]) / (s["hi"] - s["lo"]) * bins), F.lit(bins - 1))
            where = F.when((F.col("k") == k) & F.col("v").between(s["lo"], s["hi"]), cut).otherwise(where)
        found = rows.withColumn("bin", where.cast("int")).filter("bin is not null").groupBy("k", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "bin").collect()
        for k, s in open_.items():
            own = [r for r in found if r["k"] == k]
            # The bins that hold the two middle ranks, and what lies between them.
            ranks, before, held = ((s["n"] - 1) // 2, s["n"] // 2), s["below"], []
            for r in own:
                if before <= ranks[1] and before + r["n"] > ranks[0]:
                    held.append((before, r))
                before += r["n"]
            (below, first), (_, last) = held[0], held[-1]
            if len(held) == 2:
                # The middle lies between two bins: the greatest of the one and the least of the other.
                out[k] = (first["hi"] + last["lo"]) / 2
                state.pop(k)
            else:
                s |= {"below": below, "in": first["n"], "lo": first["lo"], "hi": first["hi"]}
    if state:
        left = F.lit(False)
        for k, s in state.items():
            left = left | ((F.col("k") == k) & F.col("v").between(s["lo"], s["hi"]))
        values: dict[str, list[float]] = {k: [] for k in state}
        for r in rows.filter(left).collect():
            values[r["k"]].append(r["v"])
        for k, s in state.items():
            ordered = sorted(values[k])
            out[k] = (ordered[(s["n"] - 1) // 2 - s["below"]] + ordered[s["n"] // 2 - s["below"]]) / 2
    return out


def kpis(research: DataFrame, results: DataFrame, periods: dict[str, tuple[dt.datetime, dt.datetime]]) -> DataFrame:
    """One row a period: runs, published, median hours to publish, findings, indicators and queries, in one pass over each table.

    The medians are exact and come from ``exact_medians``, whose values are the hours of one period each.
    """
    hours = (F.unix_micros(F.to_timestamp("published_at")) - F.unix_micros(F.to_timestamp("created_at"))) / 3.6e9
    inside = F.filter(F.array(*[F.when(within("published_at", b), F.lit(n)) for n, b in periods.items()]), lambda p: p.isNotNull())
    medians = exact_medians(research.select(F.explode(inside).alias("period"), hours.alias("hours")), "period", "hours")
    rows = []
    for name, bounds in periods.items():
        made = within("created_at", bounds) & ~F.col("status").isin("running", "failed")
        out = within("published_at", bounds)
        middle = F.round(F.lit(medians.get(name)).cast("double"), 1)
        rows.append(F.struct(F.lit(name).alias("period"), F.count_if(made).alias("runs"), F.count_if(out).alias("published"), middle.alias("median_hours"), F.coalesce(F.sum(F.when(made, F.col("n_iocs"))), F.lit(0)).alias("iocs"), F.coalesce(F.sum(F.when(made, F.col("n_queries"))), F.lit(0)).alias("queries")))
    base = research.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    found = [F.struct(F.lit(n).alias("period"), F.count_if(F.col("status").isin("suspicious", "confirmed") & within("updated_at", b)).alias("findings")) for n, b in periods.items()]
    more = results.join(research.select("research_id"), "research_id", "left_semi").agg(F.array(*found).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return base.join(more, "period")


def weekly(rows: DataFrame, at: str, bounds: tuple[dt.datetime, dt.datetime]) -> DataFrame:
    """(week, n): rows a week, Monday weeks over the whole period, zero where there are none."""
    spark = rows.sparkSession
    monday = bounds[0].date() - dt.timedelta(days=bounds[0].weekday())
    weeks = spark.range(0, (bounds[1].date() - monday).days // 7 + 1).select(F.expr(f"date_add(date '{monday}', cast(id * 7 as int))").alias("week"))
    counts = rows.filter(within(at, bounds)).groupBy(F.to_date(F.date_trunc("week", F.col(at))).alias("week")).agg(F.count("*").alias("n"))
    return weeks.join(counts, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))


def domain_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(value, pos, n): counts over a fixed domain in its order, zero where there are none."""
    spark = rows.sparkSession
    values = spark.range(1).select(F.posexplode(F.array(*map(F.lit, domain))).alias("pos", "value"))
    counts = rows.filter(F.col(column).isin(*domain)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return values.join(counts, "value", "left").select("value", "pos", F.coalesce("n", F.lit(0)).alias("n"))


def heat_map(mitre: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(tactic_id, technique_id, n): distinct research per technique, under each of its tactics. catalogue (technique_id, tactics)."""
    counts = mitre.groupBy("technique_id").agg(F.count_distinct("research_id").alias("n"))
    return counts.join(small(catalogue), "technique_id").select(F.explode("tactics").alias("tactic_id"), "technique_id", "n")


def tactic_rail(mitre: DataFrame, tactics: DataFrame) -> DataFrame:
    """(research_id, tactic_id, pos, n): distinct techniques per tactic, zero filled, in kill-chain order. tactics (tactic_id, pos)."""
    ids = mitre.select("research_id").distinct()
    counts = mitre.groupBy("research_id", "tactic_id").agg(F.count_distinct("technique_id").alias("n"))
    return ids.join(small(tactics), F.lit(True)).join(counts, ["research_id", "tactic_id"], "left").select("research_id", "tactic_id", "pos", F.coalesce("n", F.lit(0)).alias("n"))


def most_common(rows: DataFrame, by: str, n: int, last: str | None = None, order: str | None = None) -> DataFrame:
    """(by, n[, last]): the most frequent values, ties by value; ``last`` is the last seen value of another column."""
    aggs = [F.count("*").alias("n")] + ([F.max_by(last, order).alias(last)] if last else [])
    return rows.groupBy(by).agg(*aggs).orderBy(F.desc("n"), by).limit(n)


def most_common_each(rows: DataFrame, group: str, by: str, n: int) -> DataFrame:
    counts = rows.groupBy(group, by).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), by))).filter(F.col("rank") <= n)


def per_workspace(research: DataFrame, results: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(workspace_id, runs, findings, pending, last_report): research (research_id, workspace_ids, status, published_at)."""
    rows = research.select("research_id", "status", "published_at", F.explode(F.array_distinct("workspace_ids")).alias("workspace_id"))
    last = F.max_by("research_id", F.when(F.col("status") == "published", F.struct("published_at", "research_id")))
    made = rows.groupBy("workspace_id").agg(F.count("*").alias("runs"), last.alias("last_report"))
    own = results.join(rows.select("research_id", "workspace_id"), ["research_id", "workspace_id"], "left_semi").groupBy("workspace_id").agg(F.count_if(F.col("status").isin("suspicious", "confirmed")).alias("findings"), F.count_if(F.col("status") == "pending").alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return workspaces.select("workspace_id").join(made, "workspace_id", "left").join(own, "workspace_id", "left").select("workspace_id", zero("runs"), zero("findings"), zero("pending"), "last_report")


def workspace_counts(research: DataFrame) -> DataFrame:
    return research.select("research_id", F.explode("workspace_ids").alias("workspace_id")).groupBy("workspace_id").agg(F.count_distinct("research_id").alias("n"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): the values of each column with their counts, in one aggregation by grouping sets."""
    sets = rows.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_{c}") for c in columns])
    facet, value = None, None
    for c in columns:
        mine = F.col(f"_{c}") == 0
        facet = F.when(mine, c) if facet is None else facet.when(mine, c)
        value = F.when(mine, F.col(c).cast("string")) if value is None else value.when(mine, F.col(c).cast("string"))
    return sets.select(facet.alias("facet"), value.alias("value"), "n").filter("value is not null")


def thread_counts(comments: DataFrame) -> DataFrame:
    """(section, threads, open, comments) from comments (comment_id, thread_id, section, pos, resolved); pos 0 is a root."""
    return comments.groupBy("section").agg(F.count_if(F.col("pos") == 0).alias("threads"), F.count_if((F.col("pos") == 0) & ~F.col("resolved")).alias("open"), F.count("*").alias("comments"))


def threads(comments: DataFrame) -> DataFrame:
    """(thread_id, root, replies): roots with their replies in order."""
    reply = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "text")))), lambda x: x["text"])
    return comments.groupBy("thread_id").agg(F.min_by("text", "pos").alias("root"), reply.alias("replies"))


def counts_by(rows: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def share_by(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, pct): counts and their share of all rows in percent, one decimal."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("total")), F.lit(True)).select(by, "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


def runs_by_type(entries: DataFrame, by_id: DataFrame, by_opportunity: DataFrame, by_group: DataFrame, types: list[str]) -> DataFrame:
    """(result_id, type, n): distinct entries by the type of the query, opportunity or group they name, else other."""
    rows = entries.select("result_id", "entry").distinct()
    for name, frame in (("_q", by_id), ("_o", by_opportunity), ("_g", by_group)):
        rows = rows.join(frame.select(F.col("key").alias("entry"), F.col("type").alias(name)).dropDuplicates(["entry"]), "entry", "left")
    kind = F.coalesce("_q", "_o", "_g")
    return rows.groupBy("result_id", F.when(kind.isin(*types), kind).otherwise("other").alias("type")).agg(F.count("*").alias("n"))


def level_counts(paths: DataFrame) -> DataFrame:
    """(depth, n): distinct keys of a hierarchy by level."""
    return paths.groupBy("depth").agg(F.count_distinct("key").alias("n"))


def descendant_counts(paths: DataFrame, sep: str = "/") -> DataFrame:
    """(path, n): distinct leaves below each node; a leaf hands itself to all its ancestors, so nothing is compared pairwise."""
    parts = F.split("path", sep)
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))
    return paths.filter("leaf").select("key", F.explode(up).alias("path")).groupBy("path").agg(F.count_distinct("key").alias("n"))


def readiness(issues: DataFrame, research: DataFrame) -> DataFrame:
    """(research_id, blocking, warnings, ready) from issues (research_id, severity)."""
    counts = issues.groupBy("research_id").agg(F.count_if(F.col("severity") == "block").alias("blocking"), F.count_if(F.col("severity") != "block").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = research.select("research_id").join(counts, "research_id", "left").select("research_id", zero("blocking"), zero("warnings"))
    return out.withColumn("ready", F.col("blocking") == 0)


def merged_indicators(found: DataFrame, contexts: int = 3) -> DataFrame:
    """(type, value, n_sources, source_ids, contexts) over all sources; values are the same in any case. found (source_id, type, value, context)."""
    rows = found.select("type", F.lower("value").alias("k"), "value", "source_id", "context")
    grouped = rows.groupBy("type", "k").agg(F.min(F.struct("source_id", "value"))["value"].alias("value"), F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    # Contexts are ranked by their first source before they are gathered.
    each = rows.filter("context is not null").groupBy("type", "k", "context").agg(F.min("source_id").alias("_s"))
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy("type", "k").orderBy("_s", "context"))).filter(F.col("_r") <= contexts)
    some = ranked.groupBy("type", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "context"))), lambda x: x["context"]).alias("contexts"))
    out = grouped.join(some, ["type", "k"], "left")
    return out.select("type", "value", F.size("source_ids").cast("long").alias("n_sources"), "source_ids", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))


def merged_techniques(rows: DataFrame) -> DataFrame:
    """(technique_id, procedure, source_ids): the first row's text and the sources of all."""
    return rows.groupBy("technique_id").agg(F.min_by("procedure", "pos").alias("procedure"), F.array_sort(F.collect_set("source_id")).alias("source_ids"))


def detection_groups(queries: DataFrame) -> DataFrame:
    """(group_id, status, mixed, platforms): the least advanced status of a group's native queries, and whether they differ."""
    native = F.when(F.col("platform") != "sigma", F.col("status"))
    low = F.min_by(native, F.when(native.isNotNull(), status_rank(F.col("status"))))
    return queries.groupBy("group_id").agg(F.coalesce(low, F.min("status")).alias("status"), (F.count_distinct(native) > 1).alias("mixed"), F.array_sort(F.collect_set("platform")).alias("platforms"))


def enrichment_state(rows: DataFrame) -> DataFrame:
    """(kind, value): one row ``state``, that of all look-ups together, and a row for each id that failed, by how it failed.

    rows (cve, state, validation).
    """
    s = F.col("state")
    n = F.count("*")
    state = F.when(n == 0, "none").when(F.count_if(s == "unavailable") == n, "unavailable").when(F.count_if(s == "unavailable") > 0, "partial").when(F.count_if(s == "live") > 0, "live").when(F.count_if(s == "stale") > 0, "stale").otherwise("cache")
    failed = rows.filter(F.col("validation").isin("not_found", "invalid_format", "rejected")).select(F.col("validation").alias("kind"), F.col("cve").alias("value")).distinct()
    return rows.agg(state.alias("value")).select(F.lit("state").alias("kind"), "value").unionByName(failed)


def feed_freshness(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feed").agg(F.max("checked_at").alias("checked_at"), F.bool_or(F.col("state").isin("stale", "unavailable")).alias("stale"))


def source_cards(claims: DataFrame, techniques: DataFrame, iocs: DataFrame) -> DataFrame:
    """(source_id, claims, techniques, iocs): how much each source gave."""
    parts = [f.groupBy("source_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(w)) for w, f in (("claims", claims), ("techniques", techniques), ("iocs", iocs))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("source_id").pivot("what", ["claims", "techniques", "iocs"]).agg(F.coalesce(F.sum("n"), F.lit(0)))


def top_summary(sentences: DataFrame, words: int = 200) -> DataFrame:
    """(id, summary): sentences by score until more than ``words`` words are reached, the one that passes the limit included."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    n = F.size(F.split("sentence", r"\s+"))
    upto = F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sentences.withColumn("_before", upto).withColumn("_rank", F.row_number().over(order)).filter(F.col("_before") <= words)
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))


def hunt_rollup(hits: DataFrame, by: list[str], lines: int = 50) -> DataFrame:
    """Per group: number, first and last time, the number of distinct command lines and the first ``lines`` of them."""
    whole = hits.groupBy(*by).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    each = hits.filter("command_line is not null").select(*by, "command_line").distinct()
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("command_line")))
    listed = ranked.groupBy(*by).agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("_r") <= lines, F.col("command_line")))).alias("command_lines"))
    return whole.join(listed, by, "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0))).withColumn("command_lines", F.coalesce("command_lines", F.array().cast("array<string>")))


def by_horizon(recommendations: DataFrame) -> DataFrame:
    """(horizon, pos, number, action): actions numbered within their horizon, horizons in their order; a row an action.

    recommendations (horizon, pos, action); ``pos`` is a whole number that a horizon has once.
    """
    order = F.when(F.col("horizon") == "immediate", 0).when(F.col("horizon") == "short_term", 1).otherwise(2)
    return sequence_within(recommendations, ["horizon"], "pos", "number").select("horizon", order.alias("pos"), "number", "action")


def type_provenance(queries: DataFrame) -> DataFrame:
    """(type, provenance, detections, variants); null provenance is the total of a type."""
    return queries.groupingSets([["type", "provenance"], ["type"]], "type", "provenance").agg(F.count_distinct("group_id").alias("detections"), F.count("*").alias("variants"))


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("read")).alias("unread"))
