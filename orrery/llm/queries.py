"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import classifier, clusters, decontaminate, language, lines, middles, near, oracles, packing, quality, repeats, sharding, substrings, urls
from orrery.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.document_labels(pages, table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(table(spark, sf_dir, "documents")).drop("kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the lines dropped, and the size and hash of the text that is left."""
    docs = table(spark, sf_dir, "documents")
    left = lines.drop_lines(docs.select("doc_id", "source", "text"), F.col("source"), "text")
    return left.select("doc_id", F.col("orrery_dropped").cast("long").alias("n_dropped"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents")).drop("kept")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and hashes of the outputs, and of the texts restored from them."""
    rows = middles.divided(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(middles.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_annulus_clusters": op11_annulus_clusters,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRINGS,
    "op5_quality_rules": oracles.QUALITY,
    "op7_line_dedup": oracles.LINES,
    "op9_near_dedup": oracles.NEAR,
    "op11_annulus_clusters": oracles.CLUSTERS,
    "op12_fill_in_middle": oracles.MIDDLES,
}
