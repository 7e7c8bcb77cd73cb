"""Queries of stored tables, names in seeds and compatibility forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import records as re_
from ..operators import stored as sd
from ..sources import fixed
from ..sources.writers import folder
from .registry import query


def _library(rows):
    """(type, k, value, n, first_seen, last_seen) of mentions; the least spelling stands for all."""
    return rows.groupBy(F.col("ioc_type").alias("type"), F.lower("ioc_value").alias("k")).agg(F.min("ioc_value").alias("value"), F.count("*").alias("n"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def _merged(current, changes):
    both = current.unionByName(changes)
    return both.groupBy("type", "k").agg(F.min("value").alias("value"), F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query("m06_stored_upserts", """
    SELECT ioc_type AS type, lower(ioc_value) AS k, min(ioc_value) AS value, count(*) AS n, epoch(min(seen_at)) AS first_s, epoch(max(seen_at)) AS last_s FROM mentions WHERE ioc_type <> 'domain' OR partkey % 97 >= 5 OR flag = 'R' GROUP BY ALL""")
def stored_upserts(t):
    """A library of indicators in buckets: written once, merged with three rounds of mentions, some keys removed in between."""
    m = t.mentions
    path = folder(m.sparkSession, "library")
    sd.create(_library(m.filter("flag = 'A'")), ["type", "k"], path)
    sd.upsert(_library(m.filter("flag = 'N' and pos % 2 = 0")), path, _merged)
    sd.upsert(_library(m.filter("flag = 'N' and pos % 2 = 1")), path, _merged)
    sd.remove(m.filter("ioc_type = 'domain' and partkey % 97 < 5").select(F.col("ioc_type").alias("type"), F.lower("ioc_value").alias("k")), path)
    sd.upsert(_library(m.filter("flag = 'R'")), path, _merged)
    s = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6)
    return sd.read(m.sparkSession, path).select("type", "k", "value", "n", s("first_seen").alias("first_s"), s("last_seen").alias("last_s"))


_SEED = "concat(text, ' by group', cast(doc_id % 40 AS STRING), '-x, ALIAS', cast(doc_id % 33 AS STRING), ' and Mal', cast(doc_id % 120 AS STRING), '; xmal', cast(doc_id % 7 AS STRING), ' APT', cast(doc_id % 9 + 1 AS STRING))"


_PLAIN = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')"


@query("e05_seed_names", rf"""
    WITH s AS (SELECT doc_id, {_SEED} AS text, concat(' ', {_PLAIN.format(_SEED)}, ' ') AS low FROM documents), n AS (SELECT name, {_PLAIN.format("x")} AS x FROM (SELECT name, unnest([name, aliases[1], aliases[2]]) AS x FROM actors)), m AS (SELECT DISTINCT malware FROM mentions),
    a AS (SELECT DISTINCT doc_id, name FROM s JOIN n ON contains(low, concat(' ', x, ' ')) UNION SELECT doc_id, unnest(regexp_extract_all(text, '{fixed.ACTOR_PATTERN}')) FROM s),
    w AS (SELECT DISTINCT doc_id, malware FROM s JOIN m ON length(malware) >= 4 AND contains(low, concat(' ', malware, ' ')))
    SELECT doc_id, coalesce(any_value(x.v), []) AS actors, coalesce(any_value(y.v), []) AS malware FROM s LEFT JOIN (SELECT doc_id, list(name ORDER BY name) AS v FROM a GROUP BY doc_id) x USING (doc_id) LEFT JOIN (SELECT doc_id, list(malware ORDER BY malware) AS v FROM w GROUP BY doc_id) y USING (doc_id) GROUP BY doc_id""")
def seed_names(t):
    seeds = t.documents.select("doc_id", F.expr(_SEED).alias("text"))
    return re_.seed_names(seeds, t.actors.select("name", "aliases"), t.mentions.select(F.col("malware").alias("name")).distinct())


@query("p17_compatible", "SELECT doc_id, trim(regexp_replace(lower(replace(replace(text, 'f', 'fi'), 'x', '2')), '[^a-z0-9]+', ' ', 'g')) AS plain FROM documents")
def compatible(t):
    """Texts written with ligatures, superscripts and full-width letters compare like plain ones."""
    odd = F.translate("text", "abcdefxABCDE", "ａｂｃｄｅﬁ²ＡＢＣＤＥ")
    return t.documents.select("doc_id", tx.comparable(odd, compatible=True).alias("plain"))
