"""OCSF classes and the wide flat record used by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

# Classes in play, with category and display name.
CLASSES = {
    1007: (1, "Process Activity"),
    3002: (3, "Authentication"),
    4001: (4, "Network Activity"),
    6001: (6, "File System Activity"),
    6003: (6, "API Activity"),
}

# Candidate fields, first present wins.
TIME_FIELDS = ("time", "timestamp", "event_time", "@timestamp", "time_dt")
SOURCE_FIELDS = ("src_ip", "src_endpoint_ip", "src")

OCSF_SCHEMA = (
    "time bigint, class_uid int, category_uid int, class_name string, activity_id int, status_id int, "
    "status string, user string, actor_user string, src_ip string, src_port int, dst_ip string, "
    "dst_port int, protocol_num int, bytes_in bigint, bytes_out bigint, packets_in bigint, "
    "packets_out bigint, process_name string, process_path string, process_pid int, cmd_line string, "
    "parent_path string, parent_pid int, device_hostname string, api_operation string, "
    "is_mfa boolean, is_mfa_present boolean"
)

# Older names met in landed data, and the canonical name each one is read as.
ALIASES = {"hostname": "device_hostname"}


def first_present(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def canonical_names(df: DataFrame) -> DataFrame:
    """Rename older field names where the canonical one is not there yet."""
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def union_sources(*frames: DataFrame) -> DataFrame:
    """One wide table over event populations with different columns; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
