"""Readers for raw telemetry and landed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions.text import strip_ansi

# Column types of a Zeek connection log.
ZEEK_CONN_TYPES = {
    "ts": "double",
    "uid": "string",
    "id.orig_h": "string",
    "id.orig_p": "int",
    "id.resp_h": "string",
    "id.resp_p": "int",
    "proto": "string",
    "service": "string",
    "duration": "double",
    "orig_bytes": "bigint",
    "resp_bytes": "bigint",
    "conn_state": "string",
    "missed_bytes": "bigint",
    "history": "string",
    "orig_pkts": "bigint",
    "orig_ip_bytes": "bigint",
    "resp_pkts": "bigint",
    "resp_ip_bytes": "bigint",
}


BAD_LINE = "_bad_line"


def read_ndjson_checked(
    spark: SparkSession, path: str, schema: T.StructType | str
) -> tuple[DataFrame, DataFrame]:
    """``(records, quarantine)``: objects that fit the schema, and every other line with the reason.

    Blank lines are skipped. A line that is broken, or holds a value of another type than declared, is
    never a record, not even one of NULLs.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    checked = T.StructType([*wanted.fields, T.StructField(BAD_LINE, T.StringType())])
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select("value", F.from_json("value", checked, {"columnNameOfCorruptRecord": BAD_LINE}).alias("event"))
    is_object = F.trim("value").startswith("{")
    good = is_object & F.col("event").isNotNull() & F.col(f"event.{BAD_LINE}").isNull()
    records = parsed.filter(good).select([F.col("event").getField(f.name).alias(f.name) for f in wanted.fields])
    reason = F.when(is_object, "broken, or a value does not fit the schema").otherwise("not a JSON object")
    return records, parsed.filter(~good).select(F.col("value").alias("line"), reason.alias("reason"))


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """The records of ``read_ndjson_checked``; with ``strict`` the first bad line fails the job instead."""
    records, bad = read_ndjson_checked(spark, path, schema)
    if not strict:
        return records
    refuse = F.raise_error(F.concat(F.lit("bad line: "), F.substring("line", 1, 200)))
    nothing = bad.select(refuse.alias("refused")).filter(F.col("refused").isNotNull())
    names = records.columns
    return records.unionByName(nothing.select([F.lit(None).cast(records.schema[n].dataType).alias(n) for n in names]))


def parse_tolerant(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split text lines into ``(records, quarantine)``.

    Records are JSON objects carrying a ``class_uid``, as a VARIANT column ``record``. Blank lines are
    dropped; every other line goes to quarantine with the reason, so nothing disappears silently.
    """
    text = F.trim(strip_ansi(F.col(column)))
    parsed = (
        lines.select(text.alias("line"))
        .filter(F.length("line") > 0)
        .withColumn("record", F.when(F.col("line").startswith("{"), F.try_parse_json("line")))
        .withColumn("class_uid", F.try_variant_get("record", "$.class_uid", "int"))
    )
    records = parsed.filter(F.col("class_uid").isNotNull()).select("class_uid", "record")
    reason = F.when(F.col("record").isNull(), "not a JSON object").otherwise("no class_uid")
    quarantine = parsed.filter(F.col("class_uid").isNull()).select("line", reason.alias("reason"))
    return records, quarantine


def read_ndjson_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read a log that mixes OCSF JSON with other output."""
    return parse_tolerant(spark.read.text(path))


def zeek_header(spark: SparkSession, path: str, check_all: bool = False) -> list[str]:
    """Column names from a ``#fields`` line under ``path``.

    Files of one log share a header, so the search stops at the first one met. ``check_all`` reads
    every file instead and refuses a folder whose headers differ.
    """
    headers = spark.read.text(path).filter(F.col("value").startswith("#fields"))
    found = headers.distinct().take(2) if check_all else headers.take(1)
    if not found:
        raise ValueError(f"no #fields line in {path}")
    if len(found) > 1:
        raise ValueError(f"files under {path} carry different #fields lines")
    return found[0]["value"].split("\t")[1:]


def zeek_headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The ``#fields`` names of every file under ``path``; a file must have exactly one such line.

    What is collected is one line per file, and a driver that lists files holds their names anyway.
    """
    text = spark.read.text(path)
    lines = text.filter(F.col("value").startswith("#fields")).select("_metadata.file_path", "value").distinct()
    found: dict[str, list[str]] = {}
    for file, value in lines.collect():
        if unquote(file) in found:
            raise ValueError(f"{file} carries different #fields lines")
        found[unquote(file)] = value.split("\t")[1:]
    without = [f for f in map(unquote, text.inputFiles()) if _bare(f) not in set(map(_bare, found))]
    if without or not found:
        raise ValueError(f"no #fields line in {without[0] if without else path}")
    return found


def _bare(uri: str) -> str:
    """A file's address in one spelling: file:/x and file:///x are the same."""
    scheme, _, rest = uri.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}"


def read_zeek_tsv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """Tab-separated log with ``#`` metadata lines; ``-`` is NULL. Names keep their dots.

    Each file is read by its own header, in one scan per different header, so a rotated log whose columns
    come in another order keeps its values in their columns. Columns that a file lacks are NULL.
    """
    types = types or ZEEK_CONN_TYPES
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, names in sorted(zeek_headers(spark, path).items()):
        by_header.setdefault(tuple(names), []).append(file)
    parts = []
    for names, files in by_header.items():
        schema = T.StructType([T.StructField(n, T.DataType.fromDDL(types.get(n, "string"))) for n in names])
        parts.append(spark.read.csv(files, sep="\t", comment="#", schema=schema, nullValue="-", quote=""))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two-column ``source_field,ocsf_path`` file where only a first line may be a header.

    A later row whose source field is literally ``source`` is data. Rows that look like a header are
    therefore taken from a read that skips line one of each file, all others from a plain read; no
    row order is needed.
    """

    def rows(skip_first_line: bool) -> DataFrame:
        raw = spark.read.csv(path, header=skip_first_line, schema="source_field string, ocsf_path string")
        return raw.select(F.trim("source_field").alias("source_field"), F.trim("ocsf_path").alias("ocsf_path")).filter(
            F.col("ocsf_path").isNotNull()
        )

    like_header = F.coalesce(F.lower("source_field").isin("source_field", "source"), F.lit(False))
    return rows(False).filter(~like_header).unionByName(rows(True).filter(like_header))


def read_table_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame | None:
    """Only the named columns of a Parquet table; None when one is absent (the caller reports unmeasured)."""
    table = spark.read.parquet(path)
    if any(c not in table.columns for c in columns):
        return None
    return table.select(*[F.col(f"`{c}`") for c in columns])


def read_parquet_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """An explicit list of files, as handed out by a planner or a commit log."""
    return spark.read.parquet(*paths)
