"""The catalogue of this subpackage: one query per operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from siftlake.llm.bpe import encode_documents
from siftlake.llm.centroids import ORACLE_SQL as CENTROID_SQL
from siftlake.llm.centroids import cluster_vectors
from siftlake.llm.common import read_table, tokenizer_path
from siftlake.llm.divergence import ORACLE_SQL as DIVERGENCE_SQL
from siftlake.llm.divergence import source_divergence
from siftlake.llm.langid import identify
from siftlake.llm.line_dedup import line_digest
from siftlake.llm.license_scan import oracle_sql as license_sql
from siftlake.llm.license_scan import scan_licenses
from siftlake.llm.packing import pack_documents
from siftlake.llm.quality_rules import ORACLE_SQL as QUALITY_SQL
from siftlake.llm.quality_rules import judge
from siftlake.llm.simhash import near_duplicates
from siftlake.llm.substring_dedup import repeat_digest
from siftlake.llm.token_files import token_file_digest
from siftlake.llm.topk import top_products, whole_vectors
from siftlake.llm.toxicity import detect_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), tokenizer_path())


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(_documents(spark, sf_dir), tokenizer_path())


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_documents(spark, sf_dir), tokenizer_path())


def op6_kd_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(whole_vectors(read_table(spark, sf_dir, "embeddings")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(_documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_toxicity(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_documents(spark, sf_dir))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_license_scan": op2_license_scan,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_token_files": op4_token_files,
        "op5_trie_bpe": op5_trie_bpe,
        "op6_kd_tree_topk": op6_kd_tree_topk,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_simhash": op9_simhash,
        "op10_language_id": op10_language_id,
        "op11_toxicity": op11_toxicity,
        "op12_source_divergence": op12_source_divergence,
        "op13_centroid_clusters": op13_centroid_clusters,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    known = {
        "op1_quality_rules": QUALITY_SQL,
        "op2_license_scan": license_sql(),
        "op12_source_divergence": DIVERGENCE_SQL,
        "op13_centroid_clusters": CENTROID_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in known.items() if sql}
