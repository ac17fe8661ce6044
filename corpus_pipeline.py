"""The text pipeline: from `documents` to the mix that training takes.

Each stage works on all that the one before kept, and its decisions take effect; all but the last return
the columns of `documents`. Null and empty texts, repeated rows and missing ids are handled as the operators
state; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.llm import decontam, mixing, near_copies, quality, secrets
from gaugeflow.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    scored = quality.score_quality(docs.withColumnsRenamed({"score": "__score"}), table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") >= quality.THRESHOLD).drop("score").withColumnsRenamed({"__score": "score"})


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, in reading order, of each group of near duplicates: five-word shingles of similarity 0.8 or more."""
    placed = docs.withColumn("__place", F.monotonically_increasing_id())
    first = near_copies.first_copies(placed.select(F.col("__place").alias("place"), "text"))
    return placed.join(first.select(F.col("place").alias("__place")), "__place", "left_semi").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    marked = decontam.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter(~F.col("contaminated")).select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and the number of characters brought up to date."""
    redacted = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        redacted = redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return redacted.select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's id and source with the words that the mix takes of it."""
    return mixing.mix_sources(docs, keep=["doc_id", "source"])


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]
#: Learned scores and components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
