"""Queries of streams that run over several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import specs as sp
from ..sources.writers import folder
from ..streaming import jobs as st
from ..streaming import stateful as sf
from .queries_provenance import SPEC_INDEX, spec_rows
from .queries_rollups import SPACED
from .registry import query


@query("ss02_views_in_batches", f"{SPACED} SELECT concat(user_id, ' ', path) AS key, epoch(kept_at) AS at_s FROM s")
def views_in_batches(t):
    """Views of a month in micro-batches of six days, with state that ends after three."""
    rows = t.access.select(F.concat_ws(" ", "user_id", "path").alias("key"), F.col("seen_at").cast("timestamp").alias("seen_at"), F.floor(F.dayofmonth("seen_at") / 6).alias("batch"))
    stream, _ = sf.in_batches(rows, "batch", "views-in")
    with sf.timers(rows.sparkSession):
        out, _ = sf.finished(sf.spaced_views(stream, minutes=4320))
    return out.select("key", (F.unix_micros("seen_at") / 1e6).alias("at_s"))


@query("ss09_runs_in_batches", """
    WITH r AS (SELECT concat('user', cast(user_id AS STRING)) AS key, ts, max(CASE WHEN value >= 100 THEN 2 WHEN value >= 40 THEN 1 ELSE 0 END) AS rank FROM telemetry GROUP BY ALL),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) > INTERVAL 30 HOUR THEN 1 ELSE 0 END AS new FROM r), s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts) AS run FROM g),
    b AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY key, run ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT key, epoch(ts) AS at_s, rank FROM b WHERE rank > before""")
def runs_in_batches(t):
    rank = F.when(F.col("value") >= 100, 2).when(F.col("value") >= 40, 1).otherwise(0)
    rows = t.telemetry.groupBy(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("at")).agg(F.max(rank).alias("rank"))
    stream, _ = sf.in_batches(rows.withColumn("batch", F.floor(F.dayofmonth("at") / 6)), "batch", "runs-in")
    with sf.timers(rows.sparkSession):
        out, _ = sf.finished(sf.rising_alerts(stream, hours=30))
    return out.select("key", (F.unix_micros("at") / 1e6).alias("at_s"), "rank")


#: Feed entries of three days in six batches; one in 17 comes three batches late, and every link comes again, one batch later, written differently.
ARRIVALS = """SELECT page_id, url, 1700000000 + page_id % 60 * 4000 AS s, floor(page_id % 60 / 10) + CASE WHEN page_id % 17 = 3 THEN 3 ELSE 0 END AS b FROM pages
    UNION ALL SELECT page_id, upper(split_part(url, '://', 1)) || '://' || split_part(url, '://', 2) || '?utm_source=again', 1700000000 + page_id % 60 * 4000 + 30, floor(page_id % 60 / 10) + 1 FROM pages"""


def arrivals(t) -> DataFrame:
    t.pages.createOrReplaceTempView("_section_pages")
    rows = t.pages.sparkSession.sql(ARRIVALS.replace("FROM pages", "FROM _section_pages"))
    return rows.select("page_id", "url", F.timestamp_seconds("s").alias("published"), F.col("b").cast("int").alias("batch"))


@query("ss01_feed_in_batches", f"""
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', ''), '://www[.]', '://') AS k, s, b FROM ({ARRIVALS})),
    m AS (SELECT b, max(s) AS newest FROM a GROUP BY b), w AS (SELECT b, max(newest) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 36000 AS mark FROM m WHERE b <= 3),
    w2 AS (SELECT b, max(newest) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 36000 AS mark FROM m WHERE b > 3),
    l AS (SELECT a.*, coalesce(s <= mark, FALSE) AS late FROM a JOIN (SELECT * FROM w UNION ALL SELECT * FROM w2) USING (b))
    SELECT CASE WHEN late THEN 'late' ELSE 'new' END AS kind, CASE WHEN NOT late THEN k END AS canonical, CASE WHEN late THEN count(*) ELSE 1 END AS n FROM l GROUP BY late, CASE WHEN NOT late THEN k END""")
def feed_in_batches(t):
    """Two runs over arriving entries with one table of what is known; the entries, and how many came too late."""
    rows = arrivals(t)
    seen = folder(rows.sparkSession, "feed-seen")
    late = 0
    for run, part in enumerate((rows.filter("batch <= 3"), rows.filter("batch > 3"))):
        stream, _ = sf.in_batches(part, "batch", "feed-in")
        late += sf.late_rows(sf.feed_run(stream, seen, run=run, lateness="10 hours"))
    known = sf.known_feed(rows.sparkSession, seen, rows.drop("batch").withColumn("canonical", F.lit("")).schema)
    counted = t.nation.limit(1).select(F.lit("late").alias("kind"), F.lit(None).cast("string").alias("canonical"), F.lit(late).cast("long").alias("n"))
    return known.groupBy("canonical").agg(F.count("*").alias("n")).select(F.lit("new").alias("kind"), "canonical", "n").unionByName(counted.filter("n > 0"))


@query("ss06_spec_stream", SPEC_INDEX)
def spec_stream(t):
    """Arriving telemetry against all specifications, by the same index as in a batch."""
    out = st._finished(sp.matches(st._stream(t.telemetry), spec_rows(t)))
    return out.select("event_id", "spec_id")
