"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, fingerprint, html_extract, langid, line_dedup, packing, quality, ranked_search, secret_scan, simhash, toxicity, url_filter
from .common import fold, read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprints_with_edits(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it contains."""
    docs = read(spark, sf_dir, "documents")
    index = decontam.build(docs, read(spark, sf_dir, "benchmark"))
    return decontam.matches(docs, index, ["doc_id"]).select("doc_id", F.inline("found"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~F.coalesce(held_out, F.lit(True))))
    return langid.classify(docs, model, ["doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out")])


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_boilerplate(read(spark, sf_dir, "documents"), "source")
    return found.select("doc_id", "source", "text", "n_lines", "n_dropped")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = quality.fit(docs, labels.where(~F.coalesce(held_out, F.lit(True))))
    found = quality.score(docs, model, ["doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out")])
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels.where(~F.coalesce(held_out, F.lit(True))))
    found = toxicity.score(docs, model, ["doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out")])
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"), ["doc_id"])
    base = secret_scan.KINDS[:3]
    return found.select("doc_id", *[secret_scan.counted(F.col("spans"), kind).alias(f"n_{kind}") for kind in base], F.sha2(secret_scan.listed(F.col("spans"), base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans"), secret_scan.KINDS).alias("spans"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents for each benchmark item."""
    index = ranked_search.build(read(spark, sf_dir, "documents"))
    return ranked_search.search(index, read(spark, sf_dir, "benchmark"), 20)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_decontamination, op3_language_id, op4_html_text, op5_line_dedup, op6_quality, op7_simhash_components, op8_toxicity, op9_packing, op10_url_filter, op11_secrets, op12_ranked_search, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.oracle_sql("source"), "op10_url_filter": url_filter.oracle_sql(), "op12_ranked_search": ranked_search.oracle_sql(), "op13_divergence": divergence.oracle_sql()}
