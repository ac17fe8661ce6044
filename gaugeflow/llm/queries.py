"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.llm import conversations, decontam, hnsw, html, katz, mixing, negatives, phrases, pii, quality, secrets, simhash, tokens
from gaugeflow.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [pii.count_kind(F.col("pii"), kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    base = F.sha2(pii.span_text(pii.base_spans(F.col("pii"))), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.span_text(F.col("pii")).alias("spans"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every vector."""
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [secrets.count_kind(F.col("secrets"), kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS]
    base = F.sha2(secrets.span_text(F.col("secrets"), secrets.BASE_KINDS), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, secrets.span_text(F.col("secrets")).alias("spans"))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", (quality.fold("doc_id") == 0).alias("held_out"), "score", predicted)


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after recurring passages are removed."""
    kept = phrases.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = katz.score_text(docs, keep=["doc_id"])
    held_out = (katz.fold("doc_id") == katz.HELD_OUT).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    marked = decontam.mark_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_items = F.size("hit_items").cast("long").alias("n_items")
    return marked.select("doc_id", "n_words", "n_hit", n_items, decontam.items_digest().alias("items_sha256"), "contaminated")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    path = public_tokenizers.path(tokens.VOCABULARY_FILE)
    return tokens.count_tokens(table(spark, sf_dir, "documents"), path, keep=["doc_id"])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong-label vectors that score nearly as high as the positives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_near_vectors": op2_near_vectors,
    "op3_secret_scan": op3_secret_scan,
    "op4_page_text": op4_page_text,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_language_model": op8_language_model,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
    "op11_token_counts": op11_token_counts,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}
