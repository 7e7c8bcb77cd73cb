"""The training-data pipeline: stages over ``documents``, each written as Parquet and read by the next.

Quality classifier (rejected documents go), near-duplicates (one document of each group stays), benchmark
decontamination (overlapping documents go), personal data (spans are replaced by their kind), packing into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threatweave.llm import decontaminate, kneser_ney, minhash, packing, pii, tokens
from threatweave.llm.common import new_path, table, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity and most surprising word stay within their language's thresholds.

    Texts without characters to score, and rows without an id, stay; rows that share an id go together if one of them goes; without trusted
    labels all stay; an empty table gives an empty one, with the columns it has, extra ones included.
    """
    rated = kneser_ney.quality_classifier(docs, table(spark, sf_dir, "labels"))
    return without(docs, rated.filter("not (kept and clean)").select("doc_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies.

    Rows are judged by id and text, so an id that is used for two texts joins nothing and loses nothing. Rows that are equal in both
    stay or go together; rows without an id or without words stay.
    """
    groups = minhash.near_duplicates(docs)
    return without(docs, groups.filter("not kept").select("doc_id", "mark"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark.

    Null and empty texts and rows without an id stay; rows that share an id go together; an empty benchmark leaves all.
    """
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null, n_chars follows the text, other columns stay."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null or empty text is its end id alone, rows that repeat are packed each."""
    return packing.pack(docs, tokenizer_path=tokens.default_path(), end_id=2)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
