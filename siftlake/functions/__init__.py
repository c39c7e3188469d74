"""Column builders. Every one is an expression over built-in Spark functions."""

from siftlake.functions.logic import (
    case_flag,
    decay_status,
    field_value_check,
    freshness_check,
    null_sentinel_key,
    safe_ratio,
    status_rollup,
)
from siftlake.functions.net import cidr_bounds, cidr_match, ipv4_to_long, is_ipv4
from siftlake.functions.text import (
    basename,
    safe_key,
    safe_key_of,
    safe_text,
    strip_ansi,
    strip_domain_suffix,
    user_format_valid,
)
from siftlake.functions.time import (
    datediff_seconds,
    epoch_ms_utc,
    instant_of,
    latency_seconds,
    minute_bucket,
    trustworthy_stamp,
)

__all__ = [
    "basename",
    "case_flag",
    "cidr_bounds",
    "cidr_match",
    "datediff_seconds",
    "decay_status",
    "epoch_ms_utc",
    "field_value_check",
    "freshness_check",
    "instant_of",
    "ipv4_to_long",
    "is_ipv4",
    "latency_seconds",
    "minute_bucket",
    "null_sentinel_key",
    "safe_key",
    "safe_key_of",
    "safe_ratio",
    "safe_text",
    "status_rollup",
    "strip_ansi",
    "strip_domain_suffix",
    "trustworthy_stamp",
    "user_format_valid",
]
