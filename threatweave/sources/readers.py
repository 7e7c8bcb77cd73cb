"""Landed feeds and records as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.indicators import cpe_product
from . import fixed

KEV_JSON = "struct<catalogVersion:string,dateReleased:string,vulnerabilities:array<struct<cveID:string,vendorProject:string,product:string,dateAdded:string,dueDate:string,requiredAction:string,knownRansomwareCampaignUse:string,vulnerabilityName:string>>>"
EPSS_JSON = "struct<status:string,data:array<struct<cve:string,epss:string,percentile:string,date:string>>>"
_METRIC = "array<struct<source:string,type:string,baseSeverity:string,cvssData:struct<version:string,baseScore:double,baseSeverity:string,vectorString:string>>>"
NVD_JSON = (
    "struct<totalResults:int,vulnerabilities:array<struct<cve:struct<id:string,vulnStatus:string,published:string,lastModified:string,"
    f"descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV40:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,"
    "weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,"
    "criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>>>>>>>>>"
)
BUNDLE_JSON = (
    "struct<objects:array<struct<type:string,name:string,revoked:boolean,x_mitre_deprecated:boolean,"
    "external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>>"
)


def feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of landed RSS files; a broken file gives a corrupt record, not an error."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").load(path)


def articles(docs: DataFrame, most: int = 150_000) -> DataFrame:
    """Texts cut at ``most`` characters with a hash of the whole content ('' for no text)."""
    whole = F.coalesce("text", F.lit(""))
    return docs.withColumn("content_hash", F.when(whole == "", "").otherwise(F.substring(F.sha2(whole, 256), 1, 16))).withColumn("text", F.substring("text", 1, most))


def kev(rows: DataFrame, *, json: str = "json", last: Column | None = None) -> DataFrame:
    """The catalogue of exploited vulnerabilities, one row an id; of repeated ids the last (by ``last``) counts."""
    items = rows.select("*", F.posexplode(F.from_json(json, KEV_JSON)["vulnerabilities"]).alias("pos", "v"))
    flat = items.select("*", tx.cve_id(F.col("v.cveID")).alias("cve"), F.col("v.dateAdded").alias("date_added"), F.col("v.dueDate").alias("due_date"), F.col("v.requiredAction").alias("required_action"), F.col("v.knownRansomwareCampaignUse").alias("ransomware"), F.col("v.vulnerabilityName").alias("name"), F.col("v.vendorProject").alias("vendor"), F.col("v.product").alias("product"))
    columns = ["date_added", "due_date", "required_action", "ransomware", "name", "vendor", "product"]
    return flat.filter("cve <> ''").groupBy("cve").agg(F.max_by(F.struct(*columns), last if last is not None else F.col("pos")).alias("x")).select("cve", "x.*")


def epss(rows: DataFrame, *, json: str = "json") -> DataFrame:
    """Exploit probabilities; rows without numbers are left out."""
    items = rows.select(F.explode(F.from_json(json, EPSS_JSON)["data"]).alias("d"))
    flat = items.select(tx.cve_id(F.col("d.cve")).alias("cve"), F.col("d.epss").try_cast("double").alias("epss"), F.col("d.percentile").try_cast("double").alias("percentile"), F.col("d.date").alias("date"))
    return flat.filter("epss is not null and percentile is not null")


def nvd(rows: DataFrame, keep: list[str], *, json: str = "json", most_cpes: int = 40) -> DataFrame:
    """One row an answer: the first vulnerability's text, its best score (v3.1, v4.0, v3.0, v2; primary first), products and weaknesses."""
    first = F.get(F.from_json(json, NVD_JSON)["vulnerabilities"], F.lit(0))["cve"]
    base = rows.select(*keep, first.alias("c"))
    pick = lambda v: F.coalesce(F.get(F.filter(F.col(f"c.metrics.{v}"), lambda m: m["type"] == "Primary"), F.lit(0)), F.get(F.col(f"c.metrics.{v}"), F.lit(0)))
    best = F.coalesce(*[pick(v) for v in ("cvssMetricV31", "cvssMetricV40", "cvssMetricV30", "cvssMetricV2")])
    text = F.coalesce(F.get(F.filter("c.descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"], F.lit(""))
    nodes = F.flatten(F.transform("c.configurations", lambda k: F.flatten(F.transform(k["nodes"], lambda n: n["cpeMatch"]))))
    cpes = F.slice(F.array_distinct(F.filter(nodes, lambda m: m["vulnerable"])), 1, most_cpes)
    weak = F.flatten(F.transform("c.weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"])))
    out = base.select(*keep, F.col("c").isNotNull().alias("exists"), F.col("c.id").alias("cve"), F.col("c.vulnStatus").alias("state"), text.alias("description"), best.alias("b"), cpes.alias("cpes"), F.array_sort(F.array_distinct(F.filter(weak, lambda w: w.startswith("CWE-")))).alias("cwes"))
    return out.select(*keep, "exists", "cve", "state", "description", F.col("b.cvssData.baseScore").alias("score"), F.col("b.cvssData.version").alias("version"), F.coalesce("b.cvssData.baseSeverity", "b.baseSeverity").alias("severity"), F.array_distinct(F.transform("cpes", lambda m: cpe_product(m["criteria"]))).alias("products"), "cwes")


def attack_bundle(rows: DataFrame, keep: list[str], *, json: str = "json") -> DataFrame:
    """(keep, technique_id, name, tactics): live techniques; a sub-technique's name follows its parent's."""
    objects = rows.select(*keep, F.explode(F.from_json(json, BUNDLE_JSON)["objects"]).alias("o"))
    tid = F.get(F.filter("o.external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]
    phases = F.transform(F.filter("o.kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: p["phase_name"])
    ids = F.create_map(*[F.lit(x) for i, name in fixed.TACTICS for x in (name.lower().replace(" ", "-"), i)])
    live = objects.filter((F.col("o.type") == "attack-pattern") & ~F.coalesce("o.revoked", F.lit(False)) & ~F.coalesce("o.x_mitre_deprecated", F.lit(False)) & tid.isNotNull())
    flat = live.select(*keep, tid.alias("technique_id"), F.col("o.name").alias("own"), F.filter(F.transform(phases, lambda p: F.try_element_at(ids, p)), lambda i: i.isNotNull()).alias("tactics")).withColumn("top", F.substring_index("technique_id", ".", 1))
    parents = flat.filter("technique_id = top").select(*keep, "top", F.col("own").alias("parent"))
    out = flat.join(parents, [*keep, "top"], "left")
    name = F.when((F.col("technique_id") != F.col("top")) & F.col("parent").isNotNull(), F.concat("parent", F.lit(": "), "own")).otherwise(F.col("own"))
    return out.select(*keep, "technique_id", name.alias("name"), "tactics")


def rows_of(spark: SparkSession, values: list[tuple], names: list[str]) -> DataFrame:
    """A small dimension as a DataFrame, from literals."""
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
    return spark.range(1).select(F.explode(F.array(*[F.struct(*[lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in values])).alias("r")).select("r.*")


def tactics(spark: SparkSession) -> DataFrame:
    return rows_of(spark, [(i, name, n) for n, (i, name) in enumerate(fixed.TACTICS)], ["tactic_id", "name", "pos"])


def techniques(spark: SparkSession) -> DataFrame:
    return rows_of(spark, list(fixed.TECHNIQUES), ["technique_id", "name", "tactics"])


def with_fallback(synced: DataFrame, bundled: DataFrame) -> DataFrame:
    """The synced table, or the bundled one while it is empty."""
    some = synced.limit(1).select(F.lit(True).alias("_some"))
    return synced.unionByName(bundled.join(F.broadcast(some), F.lit(True), "left_anti"))


def section(records: DataFrame, name: str, ddl: str, keep: list[str], *, json: str = "record") -> DataFrame:
    """(keep, pos, item): one list section of nested records as rows."""
    return records.select(*keep, F.posexplode(F.from_json(json, f"struct<{name}:{ddl}>")[name]).alias("pos", "item"))


def steps(records: DataFrame, paths: str, keep: list[str]) -> DataFrame:
    """(keep, ref, step): attack steps by their reference, AP-path.step where they have none."""
    outer = records.select(*keep, F.posexplode(paths).alias("i", "p"))
    inner = outer.select(*keep, "i", F.posexplode("p.steps").alias("j", "step"))
    return inner.select(*keep, F.coalesce("step.ref", F.concat(F.lit("AP-"), (F.col("i") + 1).cast("string"), F.lit("."), (F.col("j") + 1).cast("string"))).alias("ref"), "step")


MARKER = r"(?im)^[ >]*(?:-{3,}\s*(?:Forwarded message|Original Message|Weitergeleitete Nachricht|Message transféré)\s*-{3,}|Begin forwarded message:)[ \t]*$"


def forwarded(mail: Column) -> Column:
    """(note, sender, subject, body): a mail's own note and what it forwards; note only, if it forwards nothing."""
    at = F.regexp_instr(mail, F.lit(MARKER))

    def parts(rest: Column) -> Column:
        lines = F.split(rest, "\n", -1)
        head = lambda k: F.trim(F.get(F.filter(F.transform(F.slice(lines, 1, 12), lambda s: F.regexp_extract(s, rf"(?i)^[ >]*{k}:[ \t]*(.*)$", 1)), lambda s: s != ""), F.lit(0)))
        body = F.regexp_replace(rest, r"(?i)\A(?:[ >]*(?:(?:From|Sent|Date|To|Cc|Subject|Reply-To):[^\n]*)?\n)*", "")
        plain = F.array_join(F.transform(F.split(body, "\n", -1), lambda s: F.regexp_replace(s, "^> *", "")), "\n")
        return F.struct(head("From").alias("sender"), head("Subject").alias("subject"), F.trim(plain).alias("body"))

    rest = F.regexp_replace(F.regexp_replace(F.substring(mail, at, F.length(mail)), r"\A[^\n]*", ""), r"\A\n+", "")
    none = F.struct(F.lit(None).cast("string").alias("sender"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("body"))
    inner = F.when(at > 0, tx.let(rest, parts)).otherwise(none)
    note = F.when(at > 0, F.trim(F.regexp_replace(F.substring(mail, F.lit(1), at - 1), r"\s+$", ""))).otherwise(mail)
    return tx.let(inner, lambda x: F.struct(note.alias("note"), x["sender"].alias("sender"), x["subject"].alias("subject"), x["body"].alias("body")))
