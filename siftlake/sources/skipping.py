"""A skipping index: per data file the range and a Bloom filter of chosen columns, asked before a scan opens anything.

The index is a table of its own with a row per file, so a needle in an unsorted table opens the files that may hold it
instead of all of them. It is built from the files it does not know yet, one pass over the chosen columns, and appended
to. A file that the index does not know, or knows with another size, is always opened: a stale index costs time, never
rows.

A filter is an array of 64-bit words, as many as a power of two; a value picks one word and four bits in it. Filters are
counted together at their largest size, one row per word at most, and folded in half until they fit the number of
distinct values of their file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.sources.files import file_key, light_listing, list_table_files

#: Words of a filter at most (half a megabyte) and bits per distinct value. Beyond that size a filter lets more files
#: through, and misses none.
MAX_WORDS, BITS_PER_VALUE = 1 << 16, 16
#: Files of one scan where all files of a table are read: the driver holds a listing of so many at a time.
FILES_AT_ONCE = 8192


def _hash(value: Column, data_type: T.DataType) -> Column:
    """A hash that equal values share, the two zeros of floating-point numbers included."""
    return F.xxhash64(value + F.lit(0.0)) if isinstance(data_type, (T.FloatType, T.DoubleType)) else F.xxhash64(value)


def _mask(hashed: Column) -> Column:
    """The four bits of a value within its word."""
    mask = F.lit(0).cast("long")
    for place in (16, 22, 28, 34):
        bit = F.shiftrightunsigned(hashed, place).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def _words(distinct: Column) -> Column:
    """The smallest power of two of words that gives every distinct value its bits, MAX_WORDS at most."""
    exponent = F.ceil(F.log2(F.greatest(distinct * BITS_PER_VALUE / 64, F.lit(1.0))))
    return F.least(F.lit(MAX_WORDS), F.pow(F.lit(2), exponent)).cast("long")


def index_files(scan: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per file of a file scan: file_key, file_size, n_rows, and per column its lo, hi, n_null and bloom.

    A column with nulls only has no range and an empty filter, so nothing is looked for in that file.
    """
    meta = F.col("_metadata")
    rows = scan.select(
        file_key(meta["file_path"]).alias("file_key"), meta["file_size"].alias("file_size"),
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    parts = [F.count(F.lit(1)).alias("n_rows")]
    for i in range(len(columns)):
        c = F.col(f"c{i}")
        parts += [
            F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.count_if(c.isNull()).alias(f"null{i}"),
            F.approx_count_distinct(c).alias(f"distinct{i}"),
        ]
    zones = rows.groupBy("file_key", "file_size").agg(*parts)
    hashed = F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(F.col(f"c{i}").isNotNull(), _hash(F.col(f"c{i}"), rows.schema[f"c{i}"].dataType)).alias("h"))
        for i in range(len(columns))
    ])
    values = rows.select("file_key", F.inline(hashed)).where("h is not null")
    place = F.col("h").bitwiseAND(F.lit(MAX_WORDS - 1))
    largest = values.groupBy("file_key", "i", place.alias("word")).agg(F.bit_or(_mask(F.col("h"))).alias("bits"))
    sizes = zones.select("file_key", F.posexplode(F.array(*[_words(F.col(f"distinct{i}")) for i in range(len(columns))])))
    sizes = sizes.select("file_key", F.col("pos").alias("i"), F.col("col").alias("words"))
    empty = sizes.select("file_key", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - 1)).alias("word"))
    folded = largest.join(sizes, ["file_key", "i"]).withColumn("word", F.col("word").bitwiseAND(F.col("words") - 1))
    words = folded.select("file_key", "i", "word", "bits").unionByName(empty.withColumn("bits", F.lit(0).cast("long")))
    words = words.groupBy("file_key", "i", "word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])
    filters = words.groupBy("file_key", "i").agg(ordered.alias("bloom"))
    filters = filters.groupBy("file_key").agg(
        *[F.max(F.when(F.col("i") == i, F.col("bloom"))).alias(f"bloom{i}") for i in range(len(columns))]
    )
    entries = [
        F.struct(*[F.col(f"{name}{i}").alias(alias) for name, alias in
                   (("lo", "lo"), ("hi", "hi"), ("null", "n_null"), ("bloom", "bloom"))]).alias(c)
        for i, c in enumerate(columns)
    ]
    return zones.join(filters, "file_key").select("file_key", "file_size", "n_rows", *entries)


def extend_index(spark: SparkSession, table: str, index: str, columns: Sequence[str]) -> int:
    """Index the files of a table that the index at that path does not know yet; the number of files added.

    Two writers may index one file twice: the rows are equal and a file is chosen once.
    """
    listing = list_table_files(spark, table)
    known = _read_index(spark, index)
    if known is not None:
        listing = listing.join(known.select("file_key", "file_size").distinct(), ["file_key", "file_size"], "left_anti")
    paths = [r["path"] for r in listing.select("path").collect()]
    if paths:
        # one schema for all passes; a column that the files do not hold comes from the names of all folders
        few = paths[:FILES_AT_ONCE]
        with light_listing(spark):
            own = spark.read.option("recursiveFileLookup", "true").parquet(paths[0]).columns
            schema = spark.read.option("basePath", table).parquet(*(few if set(columns) <= set(own) else paths)).schema
        for scan in scans(spark, table, paths, schema):
            index_files(scan, columns).write.mode("append").parquet(index)
    return len(paths)


def scans(spark: SparkSession, table: str, paths: Sequence[str], schema: T.StructType) -> Iterator[DataFrame]:
    """The files of a table in scans of FILES_AT_ONCE, to be used one after the other."""
    for start in range(0, len(paths), FILES_AT_ONCE):
        with light_listing(spark):
            scan = spark.read.schema(schema).option("basePath", table).parquet(*paths[start : start + FILES_AT_ONCE])
        yield scan


def _read_index(spark: SparkSession, index: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(index)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(index) if exists else None


def holds_any(index: DataFrame, column: str, values: Sequence[object]) -> Column:
    """Whether a file of the index may hold one of the values in a column; never false for a file that does."""
    entry, found = F.col(column), F.lit(False)
    data_type = index.select(f"{column}.lo").schema["lo"].dataType
    for value in values:
        needle = F.lit(value).cast(data_type)
        hashed = _hash(needle, data_type)
        place = hashed.bitwiseAND(F.size(entry["bloom"]).cast("long") - 1).cast("int")
        here = F.get(entry["bloom"], place).bitwiseAND(_mask(hashed)) == _mask(hashed)
        found = found | (needle.between(entry["lo"], entry["hi"]) & here)
    return F.coalesce(found, F.lit(False))


def overlaps(column: str, low: object, high: object) -> Column:
    """Whether the range of a file in a column meets low to high, both included."""
    entry = F.col(column)
    return F.coalesce((entry["hi"] >= F.lit(low)) & (entry["lo"] <= F.lit(high)), F.lit(False))


def files_to_open(spark: SparkSession, table: str, index: str, keep: Column, listing: DataFrame | None = None) -> DataFrame:
    """path, file_key and file_size of the table's files that fulfil keep by their row of the index, or have none.

    A listing of the table that the caller has kept is not made again.
    """
    judged = spark.read.parquet(index).select("file_key", "file_size", keep.alias("keep"))
    judged = judged.groupBy("file_key", "file_size").agg(F.max("keep").alias("keep"))
    listing = list_table_files(spark, table) if listing is None else listing
    listed = listing.join(judged, ["file_key", "file_size"], "left")
    return listed.where(F.coalesce("keep", F.lit(True))).select("path", "file_key", "file_size")


def read_files(spark: SparkSession, table: str, chosen: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """A scan of the chosen files alone. Their names go through the driver, as those of any scan do.

    Without a schema the whole table is listed for its own.
    """
    paths = [r["path"] for r in chosen.select("path").collect()]
    with light_listing(spark):
        if schema is None:
            whole = spark.read.parquet(table)
            if not paths:
                return whole.limit(0)
            schema = whole.schema
        elif not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", table).parquet(*paths)


def needle_rows(
    spark: SparkSession, table: str, index: str, column: str, values: Sequence[object],
    listing: DataFrame | None = None, schema: T.StructType | None = None,
) -> DataFrame:
    """The rows of a table that hold one of the values in a column, from the files that may have any."""
    chosen = files_to_open(spark, table, index, holds_any(spark.read.parquet(index), column, values), listing)
    return read_files(spark, table, chosen, schema).where(F.col(column).isin(*values))
