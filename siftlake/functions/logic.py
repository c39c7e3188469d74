"""Small status and ratio rules shared by the checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions.time import trustworthy_stamp

# Statuses, time to live and clock-skew allowance in seconds.
PASS, FAIL, STALE, UNMEASURED, UNWIRED, PENDING = "pass", "fail", "stale", "unmeasured", "unwired", "pending"
DEFAULT_TTL_SECONDS = 86_400
FUTURE_SKEW_SECONDS = 300
MAX_FRESHNESS_SECONDS = 3600


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double ratio, NULL on a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator, F.lit(0))


def case_flag(c: Column, value: str) -> Column:
    """1 when the column equals ``value``, else 0 (also for NULL)."""
    return F.when(c == F.lit(value), 1).otherwise(0)


def null_sentinel_key(*parts: Column, sentinel: str = "∅") -> Column:
    """Parts joined by a bar, a NULL part written as the sentinel so that it still counts."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(sentinel)) for p in parts])


def status_rollup(status: Column) -> Column:
    """Aggregate: fail if any failed, pass if something passed, else unmeasured."""
    return (
        F.when(F.count_if(status == FAIL) > 0, F.lit(FAIL))
        .when(F.count_if(status == PASS) > 0, F.lit(PASS))
        .otherwise(F.lit(UNMEASURED))
    )


def _instant(now: str | Column) -> Column:
    return F.to_timestamp(F.lit(now) if isinstance(now, str) else now)


def decay_status(status: Column, stamp: Column, now: str | Column, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> Column:
    """A pass ages to stale when it is too old, from the future, or carries no zone-aware stamp."""
    age_ms = F.unix_millis(_instant(now)) - F.unix_millis(F.try_to_timestamp(stamp))
    fresh = (
        trustworthy_stamp(stamp)
        & (age_ms <= F.lit(ttl_seconds * 1000))
        & (age_ms >= F.lit(-FUTURE_SKEW_SECONDS * 1000))
    )
    return F.when((status == PASS) & ~F.coalesce(fresh, F.lit(False)), F.lit(STALE)).otherwise(status)


def freshness_check(snapshot_ms: Column, now_ms: int | Column, max_seconds: int = MAX_FRESHNESS_SECONDS) -> Column:
    """pass/fail on the age of the newest commit; a table never written is unmeasured."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    lag_ms = F.greatest(F.lit(0).cast("bigint"), now - snapshot_ms)
    return (
        F.when(snapshot_ms.isNull(), F.lit(UNMEASURED))
        .when(lag_ms <= F.lit(max_seconds * 1000), F.lit(PASS))
        .otherwise(F.lit(FAIL))
    )


def field_value_check(expected: Column, got: Column, got_present: Column, same_type: Column) -> Column:
    """Why one expected field is not met: missing, wrong-value, or NULL when it is met."""
    return F.when(~got_present, F.lit("missing")).when(
        ~(same_type & expected.eqNullSafe(got)), F.lit("wrong-value")
    )


def all_of(conditions: list[Column]) -> Column:
    """Conjunction; an empty list is true."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    """Disjunction; an empty list is false."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
