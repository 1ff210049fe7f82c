"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread by the next.

Every stage works on all that its predecessor kept, and its decisions take effect on the rows it
returns. All stages but the last return the columns of documents; the last adds what the mix takes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.llm.common import cut, shared_folder, table, tidy
from tagtide.llm.decontaminate import contamination
from tagtide.llm.lines import dedup_lines
from tagtide.llm.mixing import mix_sources
from tagtide.llm.ngram_join import ngram_components
from tagtide.llm.quality import classify


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above their language's limit go. Rows without a doc_id can't be judged and go too."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    keep = classify(docs, trusted).filter("accepted").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; documents stay, with n_chars of what is left."""
    counts = [c for c in ("n_lines", "n_removed") if c not in docs.columns]
    own = docs.withColumnsRenamed({c: f"_own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns})
    return dedup_lines(own).drop("n_lines", "n_removed").withColumnsRenamed({f"_own_{c}": c for c in ("n_lines", "n_removed") if c not in counts}).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest doc_id stays."""
    keep = cut(ngram_components(docs).filter("doc_id = component_id").select("doc_id").distinct())
    tidy(spark)
    return docs.join(keep, "doc_id", "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    clean = contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_items = 0").select("doc_id")
    return docs.join(clean, "doc_id", "left_semi")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, target and taken words; documents it takes nothing of go."""
    taken = mix_sources(docs).filter("taken > 0").groupBy("doc_id").agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"))
    return docs.drop("size", "source_size", "target", "taken").join(taken, "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
]
#: A language model's thresholds aren't SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        # what the last stage's plans left in the driver goes before the next one's come
        tidy(spark)
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
