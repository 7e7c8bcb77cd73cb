"""Exports: flat files, JSON records and STIX object tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as ind

#: Namespace of the deterministic ids.
NAMESPACE = "2f1d8c1e-5b0a-4d3c-9a57-6d1b3c9e7f10"


_local: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    A temporary folder takes its place only where everything runs in one process, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        base = _local[context.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ioc_rows(iocs: DataFrame) -> DataFrame:
    """Indicators as they go into a CSV file: values defanged, source ids in one text."""
    from ..functions.text import defang

    return iocs.select("type", defang(F.col("value"), F.col("type")).alias("value"), F.array_join("source_ids", " ").alias("sources"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def csv_round_trip(rows: DataFrame) -> DataFrame:
    path = folder(rows.sparkSession, "csv")
    write_csv(rows, path)
    return rows.sparkSession.read.schema(rows.schema).option("header", True).csv(path)


def public(rows: DataFrame) -> DataFrame:
    """Without columns whose names start with an underscore."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


def json_round_trip(rows: DataFrame) -> DataFrame:
    path = folder(rows.sparkSession, "json")
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def partitioned_round_trip(rows: DataFrame, by: str) -> DataFrame:
    path = folder(rows.sparkSession, "extract")
    rows.write.partitionBy(by).parquet(path)
    return rows.sparkSession.read.parquet(path)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, so that what uses it more than once doesn't compute it again."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def stix_id(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{kind}--"), ind.uuid5(NAMESPACE, F.concat(F.lit(f"{kind}|"), key)))


def stix_objects(mentions: DataFrame) -> DataFrame:
    """(type, id, name, pattern): one object per actor, malware and indicator, with ids that stay the same between exports."""
    actors = mentions.select(F.lit("intrusion-set").alias("type"), stix_id("intrusion-set", F.lower("actor")).alias("id"), F.col("actor").alias("name"), F.lit(None).cast("string").alias("pattern")).distinct()
    malware = mentions.select(F.lit("malware").alias("type"), stix_id("malware", F.lower("malware")).alias("id"), F.col("malware").alias("name"), F.lit(None).cast("string").alias("pattern")).distinct()
    keyed = mentions.groupBy("ioc_type", F.lower("ioc_value").alias("low")).agg(F.min("ioc_value").alias("value"))
    found = keyed.select(F.lit("indicator").alias("type"), stix_id("indicator", F.concat_ws("|", "ioc_type", "low")).alias("id"), F.col("value").alias("name"), ind.stix_pattern(F.col("ioc_type"), F.col("value")).alias("pattern"))
    return actors.unionByName(malware).unionByName(found)


def stix_problems(objects: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(id, problem): malformed or repeated ids, missing properties, references (id, ref) to nothing."""
    shape = r"^[a-z][a-z0-9-]+--[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    own = F.array(
        F.when(~F.col("id").rlike(shape) | ~F.startswith("id", F.concat("type", F.lit("--"))), F.lit("bad id")),
        F.when(F.col("name").isNull(), F.lit("missing name")),
        F.when((F.col("type") == "indicator") & F.col("pattern").isNull(), F.lit("missing pattern")),
    )
    out = objects.select("id", F.explode(F.filter(own, lambda p: p.isNotNull())).alias("problem"))
    out = out.unionByName(objects.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("repeated id").alias("problem")))
    if refs is not None:
        lost = refs.join(objects.select(F.col("id").alias("ref")), "ref", "left_anti").select("id", F.lit("unresolved reference").alias("problem"))
        out = out.unionByName(lost)
    return out
