"""Field crosswalk from raw names to OCSF names, and what drifts away from it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.text import safe_key
from siftlake.operators.detections import DETECTIONS, DetectionSpec
from siftlake.session import fixed_table


@dataclass(frozen=True)
class MappedField:
    raw: str
    ocsf: str
    trap: bool = False


@dataclass(frozen=True)
class SourceMapping:
    class_uid: int
    fields: tuple[MappedField, ...]


# Raw field, OCSF field, and whether the pair is an easy one to get wrong.
CROSSWALK = {
    "zeek": SourceMapping(4001, (
        MappedField("id.orig_h", "src_ip"),
        MappedField("id.orig_p", "src_port"),
        MappedField("id.resp_h", "dst_ip"),
        MappedField("id.resp_p", "dst_port"),
        MappedField("proto", "protocol_num"),
        MappedField("orig_bytes", "bytes_out", trap=True),
        MappedField("resp_bytes", "bytes_in", trap=True),
        MappedField("orig_pkts", "packets_out"),
        MappedField("resp_pkts", "packets_in"),
        MappedField("conn_state", "activity_id"),
    )),
    "sysmon": SourceMapping(1007, (
        MappedField("Image", "process_path"),
        MappedField("ProcessId", "process_pid"),
        MappedField("CommandLine", "cmd_line"),
        MappedField("ParentImage", "parent_path"),
        MappedField("ParentProcessId", "parent_pid"),
        MappedField("User", "user", trap=True),
        MappedField("Computer", "device_hostname"),
    )),
    "cloudtrail": SourceMapping(3002, (
        MappedField("eventName", "class_uid"),
        MappedField("eventName", "activity_id"),
        MappedField("responseElements.ConsoleLogin", "status_id"),
        MappedField("userIdentity.userName", "user"),
        MappedField("sourceIPAddress", "src_ip"),
        MappedField("additionalEventData.MFAUsed", "is_mfa", trap=True),
    )),
}

CROSSWALK_SCHEMA = "source string, class_uid int, raw_field string, ocsf_field string, is_trap boolean"


def crosswalk_table(spark: SparkSession) -> DataFrame:
    """The crosswalk as a constant table of a few dozen rows."""
    rows = [(s, m.class_uid, f.raw, f.ocsf, f.trap) for s, m in CROSSWALK.items() for f in m.fields]
    return fixed_table(spark, CROSSWALK_SCHEMA, rows)


def resolve_path(df: DataFrame, path: str, record: str = "record") -> Column:
    """A raw field by name: the literal (possibly dotted) column if there is one, else the nested path.

    The choice is made when the plan is built; a path that is absent in a row is NULL.
    """
    if path in df.columns:
        return F.col(f"`{path}`").cast("string")
    if record in df.columns:
        # the literal dotted key is tried before the nested traversal
        literal = F.try_variant_get(record, f'$["{path}"]', "string")
        return F.coalesce(literal, F.try_variant_get(record, "$." + path, "string"))
    return F.lit(None).cast("string")


def crosswalk_long(raw: DataFrame, ocsf: DataFrame, source: str, key: str = "event_key") -> DataFrame:
    """Raw and mapped values side by side, one row per event and crosswalk pair."""
    fields = CROSSWALK[source].fields
    raw_values = raw.select(key, *[resolve_path(raw, f.raw).alias(f"r{i}") for i, f in enumerate(fields)])
    mapped = ocsf.select(
        key,
        *[
            (F.col(f.ocsf) if f.ocsf in ocsf.columns else F.lit(None)).cast("string").alias(f"o{i}")
            for i, f in enumerate(fields)
        ],
    )
    pairs = [
        F.struct(
            F.lit(f.raw).alias("raw_field"),
            F.col(f"r{i}").alias("raw_value"),
            F.lit(f.ocsf).alias("ocsf_field"),
            F.col(f"o{i}").alias("ocsf_value"),
            F.lit(f.trap).alias("is_trap"),
        )
        for i, f in enumerate(fields)
    ]
    return raw_values.join(mapped, key).select(key, F.inline(F.array(*pairs)))


def _nesting(record: Column) -> Column:
    """How deep objects and arrays lie in each other, from the schema text of a VARIANT."""
    marks = F.split(F.regexp_replace(F.schema_of_variant(record), "[^<>]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark == "<", 1).when(mark == ">", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda state: state["most"])


def observed_fields(df: DataFrame, record: str = "record", source: str = "source") -> DataFrame:
    """Field names seen per source at any depth, over all rows; elements of an array go by the array's name.

    The depth is that of the data, which one pass finds out. Each task reduces its rows to distinct names
    before the shuffle, so what moves is bounded by the number of names, not by the number of events.
    Materialise the result when it feeds several checks.
    """
    deepest = df.agg(F.max(_nesting(F.col(record)))).first()[0] or 1
    rows = df.select(source, F.lit(None).cast("string").alias("path_0"), F.col(record).alias("node"))
    for i in range(1, deepest + 1):
        opened = rows.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("node").outer()))
        above, key = F.col(f"path_{i - 1}"), F.col("key")
        path = F.when(key.isNotNull(), F.concat_ws(".", above, key)).when(F.col("value").isNotNull(), above)
        kept = [f"path_{k}" for k in range(i)]
        rows = opened.select(source, *kept, path.alias(f"path_{i}"), F.col("value").alias("node"))
    names = F.explode(F.array(*[f"path_{i}" for i in range(1, deepest + 1)]))
    return rows.select(source, names.alias("field")).filter(F.col("field").isNotNull()).distinct()


def expected_fields(spark: SparkSession) -> DataFrame:
    return crosswalk_table(spark).select("source", F.col("raw_field").alias("field")).distinct()


def field_diff(incoming: DataFrame) -> DataFrame:
    """Expected against incoming names per source: ``(source, field, change)``.

    ``change`` is missing or unexpected. A source without a crosswalk, or without any incoming name,
    cannot be judged and yields no rows here; ``drift_status`` reports it as unmeasured.
    """
    spark = incoming.sparkSession
    seen = incoming.select("source", "field").filter(F.col("field").isNotNull()).distinct()
    expected = expected_fields(spark)
    judged = expected.select("source").distinct().join(seen.select("source").distinct(), "source", "left_semi")
    # the object that holds an expected nested field is not a field of its own
    parts = F.split("field", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    holders = expected.filter(F.size(parts) > 1).select("source", F.explode(above).alias("field")).distinct()
    seen = seen.join(F.broadcast(holders), ["source", "field"], "left_anti")
    left = expected.withColumn("is_expected", F.lit(True))
    right = seen.withColumn("is_seen", F.lit(True))
    joined = left.join(right, ["source", "field"], "full_outer").join(F.broadcast(judged), "source", "left_semi")
    change = F.when(F.col("is_seen").isNull(), "missing").when(F.col("is_expected").isNull(), "unexpected")
    return joined.select("source", safe_key(F.col("field")).alias("field"), change.alias("change")).filter(
        F.col("change").isNotNull()
    )


def unpopulated_fields(incoming: DataFrame) -> DataFrame:
    """OCSF fields of a source for which every producing raw field is missing."""
    spark = incoming.sparkSession
    seen = incoming.select("source", F.col("field").alias("raw_field")).distinct().withColumn("is_seen", F.lit(True))
    judged = seen.select("source").distinct()
    producers = crosswalk_table(spark).join(judged, "source", "left_semi")
    joined = producers.join(seen, ["source", "raw_field"], "left")
    return (
        joined.groupBy("source", "class_uid", "ocsf_field")
        .agg(F.bool_and(F.col("is_seen").isNull()).alias("gone"))
        .filter("gone")
        .select("source", "class_uid", "ocsf_field")
    )


def hunt_fields(spark: SparkSession, specs: Sequence[DetectionSpec] = DETECTIONS) -> DataFrame:
    """Mapped fields each hunt depends on, as a constant table."""
    rows = [(s.id, s.technique, s.class_uid, f) for s in specs for f in sorted(s.mapped_fields())]
    return fixed_table(spark, "detection_id string, technique string, class_uid int, ocsf_field string", rows)


def drift_at_risk(incoming: DataFrame, specs: Sequence[DetectionSpec] = DETECTIONS) -> DataFrame:
    """Hunts of a source's class that lose a field: ``(source, detection_id, technique, lost_fields)``."""
    spark = incoming.sparkSession
    lost = unpopulated_fields(incoming).join(F.broadcast(hunt_fields(spark, specs)), ["class_uid", "ocsf_field"])
    return lost.groupBy("source", "detection_id", "technique").agg(
        F.array_join(F.sort_array(F.collect_set("ocsf_field")), ",").alias("lost_fields")
    )


def drift_status(incoming: DataFrame, specs: Sequence[DetectionSpec] = DETECTIONS) -> DataFrame:
    """fail only when a hunt loses a field; a source with nothing to compare is unmeasured."""
    spark = incoming.sparkSession
    sources = incoming.select("source").unionByName(crosswalk_table(spark).select("source")).distinct()
    seen = (
        incoming.filter(F.col("field").isNotNull())
        .join(F.broadcast(crosswalk_table(spark).select("source").distinct()), "source", "left_semi")
        .select("source")
        .distinct()
        .withColumn("measured", F.lit(True))
    )
    gaps = unpopulated_fields(incoming).groupBy("source").agg(F.count(F.lit(1)).alias("n_unpopulated"))
    risks = drift_at_risk(incoming, specs).groupBy("source").agg(F.count(F.lit(1)).alias("n_at_risk"))
    joined = sources.join(seen, "source", "left").join(gaps, "source", "left").join(risks, "source", "left")
    status = F.when(F.col("measured").isNull(), "unmeasured").when(F.col("n_at_risk") > 0, "fail").otherwise("pass")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        safe_key(F.col("source")).alias("source"),
        F.coalesce("n_unpopulated", zero).alias("n_unpopulated"),
        F.coalesce("n_at_risk", zero).alias("n_at_risk"),
        status.alias("status"),
    )
