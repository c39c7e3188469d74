"""The metric layer: named measures over the semantic datasets, and their declared joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.logic import case_flag, safe_ratio
from siftlake.functions.time import datediff_seconds

Datasets = Mapping[str, DataFrame]

# Declared relationships (from dataset, to dataset, from column, to column).
RELATIONSHIPS = {
    "finding_to_technique": ("detection_finding", "attack_technique", "technique_id", "technique_id"),
    "finding_to_rule": ("detection_finding", "sigma_rule", "rule_uid", "rule_uid"),
    "rule_to_technique": ("sigma_rule", "attack_technique", "technique_id", "technique_id"),
    "atlas_to_attack": ("atlas_technique", "attack_technique", "attack_technique_id", "technique_id"),
    "defense_bridge_to_attack": ("technique_defense", "attack_technique", "attack_technique_id", "technique_id"),
    "defense_bridge_to_d3fend": ("technique_defense", "d3fend_technique", "d3fend_id", "d3fend_id"),
    "class_map_to_attack": ("technique_class_map", "attack_technique", "attack_technique_id", "technique_id"),
}


def semantic_join(data: Datasets, relationship: str) -> DataFrame:
    """The left equi-join of a declared relationship; the referenced columns get a ``to_`` prefix."""
    source, target, from_column, to_column = RELATIONSHIPS[relationship]
    right = data[target].select(*[F.col(c).alias(f"to_{c}") for c in data[target].columns])
    return data[source].join(right, F.col(from_column) == F.col(f"to_{to_column}"), "left")


def semantic_joins(data: Datasets) -> DataFrame:
    """Link rate of every relationship: rows on the many side and how many of them find a partner.

    Keys are counted before they are joined, so a hot key is one row on either side.
    """
    out = None
    for name, (source, target, from_column, to_column) in RELATIONSHIPS.items():
        many = data[source].groupBy(F.col(from_column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        one = data[target].select(F.col(to_column).alias("k")).distinct().withColumn("linked", F.lit(True))
        row = many.join(one, "k", "left").agg(
            F.lit(name).alias("relationship"),
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("linked"), F.col("n"))), F.lit(0)).alias("n_linked"),
        )
        out = row if out is None else out.unionByName(row)
    assert out is not None
    return out


def _scalar(df: DataFrame, value: Column) -> Column:
    return df.agg(value).scalar()


def _n_techniques(data: Datasets) -> Column:
    return _scalar(data["attack_technique"], F.count_distinct("technique_id"))


def alert_volume(data: Datasets) -> DataFrame:
    return data["detection_finding"].agg(F.count("finding_uid").alias("alert_volume"))


def false_positive_rate(data: Datasets) -> DataFrame:
    flagged = F.sum(case_flag(F.col("verdict"), "False Positive"))
    return data["detection_finding"].agg(safe_ratio(flagged, F.count("finding_uid")).alias("false_positive_rate"))


def mean_time_to_detect_hours(data: Datasets) -> DataFrame:
    hours = datediff_seconds(F.col("first_seen_time"), F.col("event_time")) / F.lit(3600.0)
    return data["detection_finding"].agg(F.avg(hours).alias("mean_time_to_detect_hours"))


def techniques_with_detection_content(data: Datasets) -> DataFrame:
    return data["sigma_rule"].agg(F.count_distinct("technique_id").alias("techniques_with_detection_content"))


def detection_content_coverage_rate(data: Datasets) -> DataFrame:
    n = data["sigma_rule"].agg(F.count_distinct("technique_id").alias("n"))
    return n.select(safe_ratio(F.col("n"), _n_techniques(data)).alias("detection_content_coverage_rate"))


def _with_detect(data: Datasets) -> DataFrame:
    detect = F.when(F.col("d3fend_tactic") == "Detect", F.col("attack_technique_id"))
    return data["technique_defense"].agg(F.count_distinct(detect).alias("n"))


def detect_phase_coverage_rate(data: Datasets) -> DataFrame:
    rate = safe_ratio(F.col("n"), _n_techniques(data))
    return _with_detect(data).select(rate.alias("detect_phase_coverage_rate"))


def detection_blind_technique_count(data: Datasets) -> DataFrame:
    return _with_detect(data).select((_n_techniques(data) - F.col("n")).alias("detection_blind_technique_count"))


def telemetry_reachable_technique_rate(data: Datasets) -> DataFrame:
    n = data["technique_class_map"].agg(F.count_distinct("attack_technique_id").alias("n"))
    return n.select(safe_ratio(F.col("n"), _n_techniques(data)).alias("telemetry_reachable_technique_rate"))


def atlas_realized_technique_count(data: Datasets) -> DataFrame:
    realized = F.count_if(F.col("maturity") == "Realized")
    return data["atlas_technique"].agg(realized.alias("atlas_realized_technique_count"))


def atlas_attack_bridge_rate(data: Datasets) -> DataFrame:
    # atlas_id is the key of the dataset; both counts are still taken over distinct ids
    per_id = data["atlas_technique"].groupBy("atlas_id").agg(F.count("attack_technique_id").alias("n_links"))
    known = per_id.filter(F.col("atlas_id").isNotNull())
    rate = safe_ratio(F.count_if(F.col("n_links") > 0), F.count(F.lit(1)))
    return known.agg(rate.alias("atlas_attack_bridge_rate"))


def failed_authentication_rate(data: Datasets) -> DataFrame:
    failed = F.sum(F.when(F.col("status_id") == 2, 1).otherwise(0))
    return data["authentication"].agg(safe_ratio(failed, F.count("event_time")).alias("failed_authentication_rate"))


METRICS: dict[str, Callable[[Datasets], DataFrame]] = {
    f.__name__: f
    for f in (
        alert_volume,
        false_positive_rate,
        mean_time_to_detect_hours,
        techniques_with_detection_content,
        detection_content_coverage_rate,
        detect_phase_coverage_rate,
        detection_blind_technique_count,
        telemetry_reachable_technique_rate,
        atlas_realized_technique_count,
        atlas_attack_bridge_rate,
        failed_authentication_rate,
    )
}
