"""One registered query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.llm import (
    decontam,
    fingerprint,
    html_text,
    jaccard_join,
    licenses,
    packing,
    pii,
    sharding,
    token_scan,
    toxicity,
)
from cuelight.llm.common import documents


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", html_text.main_text_column("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs.select("doc_id", "text"), index).select(
        "doc_id",
        F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)").alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= index.settings.threshold).cast("int").alias("predicted"),
        F.col("__evidence").alias("evidence"),
    )


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(documents(spark, sf_dir))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(documents(spark, sf_dir)).select(
        "doc_id",
        F.length("__text").cast("long").alias("n_chars"),
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.told("__fp").alias("fingerprint"),
        fingerprint.told("__edited_fp").alias("edited_fingerprint"),
        fingerprint.likeness("__fp", "__edited_fp").alias("near_edited"),
        fingerprint.likeness("__fp", "__next___fp").alias("near_next"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.document_digests(documents(spark, sf_dir))
    return sharding.uniform_shards(rows, shards=16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, order = token_scan.written(documents(spark, sf_dir), packing.tokenizer_paths())
    return token_scan.token_counts(blocks).join(order, ["file", "ordinal"])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = documents(spark, sf_dir).select("doc_id", pii.span_digest("text").alias("found"))
    return got.select("doc_id", "found.*")


QUERIES = {
    q.__name__: q
    for q in (
        op1_html_extraction,
        op2_toxicity,
        op3_license_scans,
        op4_benchmark_decontamination,
        op5_best_fit_packing,
        op6_ngram_jaccard_join,
        op7_document_fingerprints,
        op8_sharding,
        op9_token_counts,
        op10_pii,
    )
}
ORACLES: dict[str, str] = {}
