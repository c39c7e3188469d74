"""Streaming queries, run to completion over what is there and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.plans import tables as t
from siftlake.plans.catalog import query
from siftlake.plans.mapping import drift_sql
from siftlake.plans.tables import sql
from siftlake.session import materialise, scratch_path
from siftlake.sources import sinks as sk
from siftlake.streaming import streams as st


def _as_stream(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """The table written once as files and opened as a stream over them."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.events(spark, sf_dir).withColumn("ts", F.timestamp_micros("time_us"))


@query(
    "stream_normalize_land",
    sql("ev", """
SELECT status, count(*) AS n, min(time) AS first_ms, count(src_ip) AS with_src FROM ev WHERE event_id % 41 <> 0
GROUP BY status UNION ALL SELECT 'quarantine', count(*), NULL, 0 FROM ev WHERE event_id % 41 = 0"""),
)
def _stream_normalize_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines, some of them cut short, through normalisation into a commit table."""
    raw, table = scratch_path(spark, "stream-raw"), scratch_path(spark, "stream-table")
    cut = F.when(F.col("event_key") % 41 == 0, F.substring("value", 1, 9)).otherwise(F.col("value"))
    t.okta_raw(spark, sf_dir).select(cut.alias("value")).write.text(raw)
    checkpoint = scratch_path(spark, "stream-checkpoint")
    run = st.stream_normalize_land(spark, raw, table, checkpoint, lambda batch: t.START_US // 1000 + batch)
    run.awaitTermination()
    landed = sk.read_commits(spark, table).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first_ms"), F.count("src_ip").alias("with_src")
    )
    bad = spark.read.text(f"{table}/quarantine").agg(
        F.lit("quarantine").alias("status"),
        F.count(F.lit(1)).alias("n"),
        F.lit(None).cast("bigint").alias("first_ms"),
        F.lit(0).cast("bigint").alias("with_src"),
    )
    return landed.unionByName(bad)


@query(
    "stream_minute_volume",
    "SELECT epoch_us(ts) // 60000000 * 60000 AS minute_ms, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2",
)
def _stream_minute_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "events").select(t.utc().alias("ts"), F.col("event_type").alias("source"))
    path, checkpoint = scratch_path(spark, "minute-volume"), scratch_path(spark, "stream-checkpoint")
    stream = _as_stream(spark, rows, "minute-source")
    st.stream_minute_volume(stream, path, checkpoint).awaitTermination()
    return st.read_minute_volume(spark, path, checkpoint)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with place, their number from 1 by ts and event_id: what lies in earlier minutes, and the number within."""
    timed = rows.withColumn("minute", F.expr("unix_micros(ts) div 60000000"))
    counts = timed.groupBy("minute").agg(F.count(F.lit(1)).alias("rows_in"))
    before = F.sum("rows_in").over(W.orderBy("minute")) - F.col("rows_in")  # a row per minute
    offsets = counts.select(F.col("minute").alias("m"), before.alias("before"))
    within = timed.withColumn("within", F.row_number().over(W.partitionBy("minute").orderBy("ts", "event_id")))
    placed = within.join(offsets, F.col("minute").eqNullSafe(F.col("m")))
    return placed.select(*rows.columns, (F.col("before") + F.col("within")).alias("place"))


@query(
    "stream_late_rows",
    """
WITH e AS (SELECT epoch_us(ts) AS us, event_type AS source, event_id FROM events),
b AS (SELECT *, row_number() OVER (ORDER BY us, event_id) % 4 = 0 AS held FROM e),
newest AS (SELECT max(us) // 1000 AS ms FROM b WHERE NOT held)
SELECT source, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS n_late FROM (
  SELECT source, held AND (us // 60000000 + 1) * 60000 <= ms - 300000 AS late FROM b, newest) GROUP BY source""",
)
def _stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the events arrives in a second batch of files, most of them long after their minute has closed."""
    rows = t.read(spark, sf_dir, "events").select(t.utc().alias("ts"), F.col("event_type").alias("source"), "event_id")
    marked = materialise(_numbered(rows).withColumn("held", F.col("place") % 4 == 0), "late-marked")
    path, feed = scratch_path(spark, "late-volume"), scratch_path(spark, "late-source")
    checkpoint = scratch_path(spark, "stream-checkpoint")
    for held in (False, True):
        # a run takes all files that are new to it as one batch
        part = marked.filter(F.col("held") == held).select("ts", "source")
        part.write.mode("append" if held else "errorifexists").parquet(feed)
        stream = spark.readStream.schema("ts timestamp, source string").parquet(feed)
        st.stream_minute_volume(stream, path, checkpoint).awaitTermination()
    counted = st.read_minute_volume(spark, path, checkpoint).groupBy("source").agg(F.sum("n").alias("n"))
    joined = counted.join(st.read_late_rows(spark, path, checkpoint, ["source"]), "source", "full_outer")
    zero = F.lit(0).cast("bigint")
    return joined.select("source", F.coalesce("n", zero).alias("n"), F.coalesce("n_late", zero).alias("n_late"))


@query("stream_dedup", "SELECT event_type AS source, count(*) AS n FROM events GROUP BY 1")
def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retry storm: every third event arrives three times."""
    n = F.col("event_id")
    copies = F.explode(F.sequence(F.lit(1), F.when(n % 3 == 0, 3).otherwise(1)))
    rows = t.read(spark, sf_dir, "events").select(t.utc().alias("ts"), "event_id", F.col("event_type").alias("source"))
    stream = _as_stream(spark, rows.withColumn("copy", copies), "retry-source")
    path = scratch_path(spark, "unique")
    st.stream_dedup(stream, ["event_id"], path, scratch_path(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_failed_auth_burst",
    sql("ev", """
SELECT time // 86400000 * 86400000 AS window_ms, src_ip, count(*) AS fails FROM ev
WHERE class_uid = 3002 AND status_id = 2 GROUP BY 1, 2 HAVING count(*) >= 2"""),
)
def _stream_failed_auth_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bursts")
    stream = _as_stream(spark, _events(spark, sf_dir), "burst-source")
    checkpoint = scratch_path(spark, "stream-checkpoint")
    st.stream_failed_auth_burst(stream, path, checkpoint, width="1 day").awaitTermination()
    return st.read_failed_auth_burst(spark, path, checkpoint, threshold=2)


@query(
    "field_drift_stream",
    drift_sql("""
SELECT source, n_unpopulated, n_at_risk, status FROM drift WHERE source = 'cloudtrail'
UNION ALL SELECT unnest(['sysmon', 'zeek']), 0, 0, 'unmeasured'"""),
)
def _field_drift_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.cloudtrail_raw(spark, sf_dir).select(F.lit("cloudtrail").alias("source"), "value")
    stream = _as_stream(spark, raw, "drift-source").select("source", F.parse_json("value").alias("record"))
    path = scratch_path(spark, "drift")
    st.field_drift_stream(stream, path, scratch_path(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(f"{path}/status").select("source", "n_unpopulated", "n_at_risk", "status")


@query(
    "stream_rollup",
    sql("ev", """
SELECT class_uid, activity_id, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS sum_bytes_out FROM ev GROUP BY 1, 2"""),
)
def _stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, path = ["class_uid", "activity_id"], scratch_path(spark, "rollup")
    stream = _as_stream(spark, _events(spark, sf_dir), "rollup-source")
    st.stream_rollup(stream, keys, path, scratch_path(spark, "stream-checkpoint"), ["bytes_out"]).awaitTermination()
    return st.read_rollup(spark, path, keys, ["bytes_out"])
