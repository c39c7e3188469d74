"""File listings as tables, without reading file content."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.text import basename

# Compaction threshold and the number of small files tolerated.
MIN_FILE_BYTES = 128 * 1024 * 1024
MAX_SMALL_FILES = 8

#: Tasks that list folders, at most, and settings that keep a listing from staying in the driver once it is not used.
LISTING_TASKS = 200
LISTING = {
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(LISTING_TASKS),
    "spark.sql.hive.manageFilesourcePartitions": "false",
}


@contextmanager
def light_listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by few tasks instead of one each, and the shared cache of file names is passed by.

    The driver remembers every task and up to 250 MB of names. What is listed does not depend on either.
    """
    before = {k: spark.conf.get(k) for k in LISTING}
    try:
        for k, v in LISTING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def file_key(path: Column) -> Column:
    """A path without its scheme, so that listings by different file system clients agree.

    The base name alone is no identity: one write task uses the same name in every partition folder.
    """
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def list_table_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Every data file under a folder: path, key, base name, size. Content is never read."""
    with light_listing(spark):
        listing = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true")
            .load(path)
        )
    path_col = F.col("path")
    return listing.select(
        "path",
        file_key(path_col).alias("file_key"),
        basename(path_col).alias("file_name"),
        F.col("length").alias("file_size"),
    )


def files_of(df: DataFrame, *by: str) -> DataFrame:
    """Files that a scan of ``df`` actually opens, one row per file, and values of the columns ``by``, with its row count."""
    meta = F.col("_metadata")
    return df.groupBy(
        *by,
        meta["file_path"].alias("path"),
        file_key(meta["file_path"]).alias("file_key"),
        meta["file_name"].alias("file_name"),
        meta["file_size"].alias("file_size"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def small_files(listing: DataFrame, min_bytes: int = MIN_FILE_BYTES, max_small: int = MAX_SMALL_FILES) -> DataFrame:
    """Compaction pressure: how many files are under the threshold."""
    counted = listing.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("file_size") < F.lit(min_bytes)).alias("small_files")
    )
    status = (
        F.when(F.col("total_files") == 0, "unmeasured")
        .when(F.col("small_files") <= F.lit(max_small), "pass")
        .otherwise("fail")
    )
    return counted.select("total_files", "small_files", F.lit(max_small).alias("max_small"), status.alias("status"))


def orphan_files(listing: DataFrame, referenced: DataFrame, name: str = "file_key") -> DataFrame:
    """Files in the store that no commit refers to."""
    return listing.join(referenced.select(name).distinct(), name, "left_anti")


def footprint_by_source(events: DataFrame, files: DataFrame, source: str = "source") -> DataFrame:
    """Bytes per event per source. Both inputs carry ``source``; a source without events has no ratio."""
    counts = events.groupBy(source).agg(F.count(F.lit(1)).alias("n_events"))
    sizes = files.groupBy(source).agg(
        F.sum("file_size").cast("bigint").alias("total_bytes"), F.count(F.lit(1)).alias("n_files")
    )
    return sizes.join(counts, source, "left").select(
        source,
        "n_files",
        "total_bytes",
        F.coalesce("n_events", F.lit(0)).alias("n_events"),
        (F.col("total_bytes") / F.nullif(F.col("n_events"), F.lit(0))).alias("bytes_per_event"),
    )
