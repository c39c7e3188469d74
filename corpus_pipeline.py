"""From raw documents to packed training sequences: STAGES in order, and run() over a whole table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All but the last return the
columns of documents, with n_chars brought up to date where a text has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.common import read_table, tokenizer_path
from siftlake.llm.line_dedup import drop_repeated_lines
from siftlake.llm.packing import pack_documents
from siftlake.llm.quality_rules import keep_good
from siftlake.llm.simhash import one_of_each
from siftlake.llm.substring_dedup import cut_repeats
from siftlake.session import materialise


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or are outliers of their language and source go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near-equal to an earlier one go; a document may be left without a line."""
    return _counted(drop_repeated_lines(docs), docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints stays, the one with the smallest doc_id."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in an earlier document, or before in the same one, are cut out."""
    cut = cut_repeats(docs).select("doc_id", F.col("kept_text").alias("text"), "rest.*")
    return _counted(cut, docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no tokenizer and no XXH64 of shingles; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
