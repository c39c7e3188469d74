"""Time rules. Nothing here reads the wall clock and nothing depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONED = r"(Z|[+-]\d{2}:?\d{2})$"
MINUTE_US = 60_000_000


def instant_of(c: Column) -> Column:
    """Timestamp of ISO-like text; text without a zone is read as UTC, text that does not parse is NULL."""
    has_zone = c.rlike(r"\d{2}:\d{2}.*" + ZONED)
    return F.try_to_timestamp(F.when(has_zone, c).otherwise(F.concat(c, F.lit("Z"))))


def epoch_ms_utc(c: Column) -> Column:
    """ISO text to epoch milliseconds."""
    return F.unix_millis(instant_of(c))


def trustworthy_stamp(c: Column) -> Column:
    """True only for a zone-aware ISO stamp with a time part. NULL is not trustworthy."""
    zoned = c.rlike("T.*" + ZONED)
    return F.coalesce(zoned & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def minute_bucket(time_us: Column, start_us: int | Column, width_us: int = MINUTE_US) -> Column:
    """Floor-divided bucket number since ``start_us``."""
    start = F.lit(start_us) if isinstance(start_us, int) else start_us
    return F.floor((time_us - start) / F.lit(width_us)).cast("bigint")


def latency_seconds(ingest_us: Column, event_us: Column) -> Column:
    """Seconds between event and ingest."""
    return (ingest_us - event_us) / F.lit(1_000_000)


def datediff_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``; NULL when either is NULL."""
    return F.timestamp_diff("SECOND", start, end)
