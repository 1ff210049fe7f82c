"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.llm import ann, decontaminate, licenses, lines, mixing, ngram_join, phrases, quality, toxicity, warc
from tagtide.llm.common import table


def op1_ann_block_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrases.remove_repeats(table(spark, sf_dir, "documents"), width=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda doc_id: F.crc32(doc_id.cast("string")) % 4 == 2
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, threshold=0.3)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents and the items in them; clean documents have no row."""
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    judged = quality.classify(table(spark, sf_dir, "documents"), trusted)
    return judged.select("doc_id", "n", F.round("perplexity", 6).alias("perplexity"), F.round("limit", 6).alias("limit"), "accepted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ann_block_matrix, op2_substring_dedup, op3_toxicity, op4_decontamination, op5_source_mixing, op6_line_dedup, op7_warc_revisits, op8_ngram_jaccard_join, op9_license_scan, op10_quality_classifier]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ann_block_matrix": ann.sql(),
        "op2_substring_dedup": phrases.sql(),
        "op4_decontamination": decontaminate.sql(),
        "op5_source_mixing": mixing.sql(),
        "op6_line_dedup": lines.sql(),
        "op7_warc_revisits": warc.sql(),
        "op8_ngram_jaccard_join": ngram_join.sql(),
        "op9_license_scan": licenses.sql(),
    }
