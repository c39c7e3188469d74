"""Data-health checks: quality dimensions, source volume, golden signals, baselines, table audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.logic import status_rollup
from siftlake.functions.net import is_ipv4
from siftlake.functions.text import user_format_valid
from siftlake.functions.time import MINUTE_US, minute_bucket
from siftlake.operators.quantiles import exact_quantiles

# Thresholds of the landed-table scorecard.
THRESHOLDS = {
    "completeness": 0.98,
    "uniqueness": 0.999,
    "validity": 0.99,
    "consistency": 0.99,
    "timeliness": 0.99,
}
EPOCH_MS_FLOOR = 1_600_000_000_000

# Thresholds of the health layers.
SIX_THRESHOLDS = {
    "timeliness": 0.99,
    "accuracy": 0.99,
    "completeness": 0.98,
    "consistency": 0.99,
    "validity": 0.99,
    "uniqueness": 0.999,
}
TIMELY_US = 5 * MINUTE_US
TAIL_US = 6 * MINUTE_US
LATENCY_SLA_US = 30_000_000
ERROR_BUDGET = 0.005
TAIL_BUDGET = 0.05
DIP_FLOOR = 0.7
VOLUME_FLOOR = 0.95
DRIFT_MS = 2000
COMPLETENESS_FLOOR = 0.9


def share(condition: Column) -> Column:
    """Share of rows that meet a condition; a NULL condition counts as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def dq_completeness(df: DataFrame) -> DataFrame:
    return df.agg(share(F.col("src_ip").isNotNull() & F.col("dst_port").isNotNull()).alias("score"))


def dq_validity(df: DataFrame) -> DataFrame:
    return df.agg(share(F.col("dst_port").between(0, 65535) & is_ipv4(F.col("src_ip"))).alias("score"))


def dq_consistency(df: DataFrame, class_uid: int = 4001) -> DataFrame:
    return df.agg(share(F.col("class_uid") == class_uid).alias("score"))


def dq_timeliness(df: DataFrame) -> DataFrame:
    return df.agg(share(F.col("time") > F.lit(EPOCH_MS_FLOOR)).alias("score"))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def _distinct_share(df: DataFrame) -> DataFrame:
    """``score``, distinct rows over rows, exact. Rows are counted by a 64-bit hash, and only those whose hash
    occurs again are compared as a whole, so what moves is a number per row where rows seldom repeat."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    row_hash = F.xxhash64(*columns, *[c.isNull() for c in columns])
    hashed = df.withColumn("__row_hash", row_hash)
    counts = hashed.groupBy("__row_hash").agg(F.count(F.lit(1)).alias("__copies"))
    again = counts.filter(F.col("__copies") > 1).select("__row_hash")
    repeated = hashed.join(again, "__row_hash", "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies"))
    n_repeated = repeated.agg(F.count(F.lit(1))).scalar()
    total = F.nullif(F.sum("__copies"), F.lit(0))
    return counts.agg(((F.count_if(F.col("__copies") == 1) + n_repeated) / total).alias("score"))


def dq_uniqueness(df: DataFrame) -> DataFrame:
    """Distinct rows over rows, exact."""
    return _distinct_share(df)


def guard_epoch_type(df: DataFrame, field: str = "time") -> bool:
    """Time is stored as an integer type. A schema test; no row is read."""
    return field in df.columns and df.schema[field].dataType.simpleString() in ("int", "bigint")


def _verdict(score: Column, threshold: float) -> Column:
    return F.when(score.isNull(), "unmeasured").when(score >= F.lit(threshold), "OK").otherwise("FAIL")


def _dimension(name: str, score: Column, threshold: float) -> Column:
    return F.struct(
        F.lit(name).alias("check"),
        F.round(score, 6).alias("score"),
        F.lit(float(threshold)).alias("threshold"),
        _verdict(score, threshold).alias("verdict"),
    )


def dq_scorecard(df: DataFrame, class_uid: int = 4001) -> DataFrame:
    """Five dimensions and the guards as verdict rows.

    The shares are added up where the rows are read; uniqueness moves a hash per row.
    """
    totals = df.agg(
        share(F.col("src_ip").isNotNull() & F.col("dst_port").isNotNull()).alias("completeness"),
        share(F.col("dst_port").between(0, 65535) & is_ipv4(F.col("src_ip"))).alias("validity"),
        share(F.col("class_uid") == class_uid).alias("consistency"),
        share(F.col("time") > F.lit(EPOCH_MS_FLOOR)).alias("timeliness"),
        F.count_if(F.col("dst_port").isNull()).alias("null_ports"),
    ).withColumn("uniqueness", _distinct_share(df).scalar())
    guards = {
        "guard_no_null_in_exclusion": F.when(F.col("null_ports") == 0, 1.0).otherwise(0.0),
        "guard_epoch_type": F.lit(1.0 if guard_epoch_type(df) else 0.0),
    }
    rows = [_dimension(name, F.col(name), threshold) for name, threshold in THRESHOLDS.items()]
    rows += [_dimension(name, score, 1.0) for name, score in guards.items()]
    return totals.select(F.inline(F.array(*rows)))


def source_volume_health(
    events: DataFrame,
    baseline: DataFrame,
    start_us: int,
    end_us: int,
    bucket_us: int = MINUTE_US,
    dense: bool = True,
) -> DataFrame:
    """Per source: volume and worst bucket against the baseline, drop rate, median clock offset, verdict.

    ``events``: source, event_time_us, clock_offset_ms (integer), landed. ``baseline``: source,
    baseline_per_bucket. A bucket without any row is the worst one there is: it is found by comparing
    the number of buckets met with the number the window holds, without building empty buckets.
    ``dense=False`` looks only at buckets that have rows.
    """
    n_buckets = -(-(end_us - start_us) // bucket_us)
    # the window's last instant belongs to its last bucket
    number = F.least(minute_bucket(F.col("event_time_us"), start_us, bucket_us), F.lit(n_buckets - 1))
    inside = events.filter(F.col("event_time_us").between(start_us, end_us))
    per_bucket = inside.groupBy("source", number.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("landed").alias("n_landed")
    )
    volume = per_bucket.groupBy("source").agg(
        F.sum("n").alias("n_events"),
        F.sum("n_landed").alias("n_landed"),
        F.min("n").alias("worst_met"),
        F.count(F.lit(1)).alias("n_buckets"),
    )
    drift = exact_quantiles(inside, ["source"], "clock_offset_ms", [0.5]).withColumnRenamed("q0", "drift_ms")
    joined = baseline.join(volume, "source", "left").join(drift, "source", "left")
    zero = F.lit(0).cast("bigint")
    n_events = F.coalesce("n_events", zero)
    silent = F.coalesce("n_buckets", zero) < F.lit(n_buckets)
    worst = F.when(silent if dense else F.col("n_buckets").isNull(), zero).otherwise(F.col("worst_met"))
    per = F.nullif(F.col("baseline_per_bucket"), F.lit(0.0))
    volume_ratio = n_events / (per * F.lit(n_buckets))
    worst_ratio = worst / per
    volume_verdict = (
        F.when(worst_ratio < DIP_FLOOR, "FAIL: capture dip").when(volume_ratio < VOLUME_FLOOR, "WARN: low volume")
    )
    drift_verdict = F.when(F.abs("drift_ms") > DRIFT_MS, "FAIL: time-sync drift")
    verdict = F.concat_ws("; ", volume_verdict, drift_verdict)
    return joined.select(
        "source",
        F.round(volume_ratio, 3).alias("vol_vs_baseline"),
        F.round(worst_ratio, 3).alias("worst_vs_baseline"),
        F.round(1 - F.col("n_landed") / F.nullif(F.col("n_events"), F.lit(0)), 4).alias("drop_rate"),
        F.round(F.col("drift_ms") / 1000, 3).alias("clock_drift_s"),
        F.when(verdict == "", "OK").otherwise(verdict).alias("verdict"),
    )


def flow_golden_signals(events: DataFrame, start_us: int, end_us: int, tail_us: int = TAIL_US) -> DataFrame:
    """Latency, traffic, errors and saturation as rows ``(signal, value, limit, verdict)``.

    ``events``: event_time_us, ingest_time_us, landed. Quantiles are exact.
    """
    latency = events.withColumn("latency_us", F.col("ingest_time_us") - F.col("event_time_us"))
    q = exact_quantiles(latency.filter("landed"), [], "latency_us", [0.5, 0.95, 0.99])
    tail = F.col("landed") & (F.col("event_time_us") > F.lit(end_us - tail_us))
    n_tail = F.count_if(tail)
    counts = latency.agg(
        F.count_if("landed").alias("n_landed"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(
            F.count_if(tail & (F.col("latency_us") > F.lit(LATENCY_SLA_US))) / F.nullif(n_tail, F.lit(0)), F.lit(0.0)
        ).alias("saturation"),
    )
    one = counts.select("*", q.select(F.struct("*")).scalar().alias("q")).select("*", "q.*")
    errors = 1 - F.col("n_landed") / F.nullif(F.col("n"), F.lit(0))
    seconds = max((end_us - start_us) / 1e6, 1e-6)

    def signal(name: str, value: Column, limit: float | None, bad: str) -> Column:
        ok = F.lit(True) if limit is None else value <= F.lit(limit)
        return F.struct(
            F.lit(name).alias("signal"),
            F.round(value, 6).alias("value"),
            F.lit(limit).cast("double").alias("limit"),
            F.when(value.isNull(), "unmeasured").when(ok, "OK").otherwise(bad).alias("verdict"),
        )

    rows = [
        signal("latency_p50_s", F.col("q0") / 1e6, None, ""),
        signal("latency_p95_s", F.col("q1") / 1e6, LATENCY_SLA_US / 1e6, "FAIL: latency band breached"),
        signal("latency_p99_s", F.col("q2") / 1e6, None, ""),
        signal("traffic_eps", F.col("n_landed") / F.lit(seconds), None, ""),
        signal("errors", errors, ERROR_BUDGET, "FAIL: error budget exceeded"),
        signal("saturation", F.col("saturation"), TAIL_BUDGET, "WARN: backpressure at the tail"),
    ]
    return one.select(F.inline(F.array(*rows)))


def dq_six_dimensions(events: DataFrame, free_identity_sources: Sequence[str] = ("okta_idp",)) -> DataFrame:
    """Six dimensions over an event table with ``landed``.

    Accuracy needs a ground truth that telemetry does not carry, so it is always unmeasured. Copies of
    a (source, time, identity) key are counted per key first, a NULL identity being a key of its own;
    all scores come from those groups.
    """
    timely = (F.col("ingest_time_us") - F.col("event_time_us")) <= F.lit(TIMELY_US)
    valid = F.col("user").isNotNull() & user_format_valid(F.col("user"))
    judged = ~F.col("source").isin(*free_identity_sources) & F.col("user").isNotNull()
    short = judged & F.col("user").rlike(r"^u\d+$")
    landed = F.col("landed")
    groups = events.groupBy("source", "event_time_us", "user").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(landed).alias("n_landed"),
        F.count_if(landed & timely).alias("n_timely"),
        F.count_if(landed & valid).alias("n_valid"),
        F.count_if(landed & judged).alias("n_judged"),
        F.count_if(landed & short).alias("n_short"),
    )
    totals = groups.agg(
        *[F.sum(c).alias(c) for c in ("n", "n_landed", "n_timely", "n_valid", "n_judged", "n_short")],
        F.count_if(F.col("n_landed") > 0).alias("n_keys"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.col(a) / F.nullif(F.col(b), F.lit(0))

    scores = {
        "timeliness": ratio("n_timely", "n_landed"),
        "accuracy": F.lit(None).cast("double"),
        "completeness": ratio("n_landed", "n"),
        "consistency": 1 - ratio("n_short", "n_judged"),
        "validity": ratio("n_valid", "n_landed"),
        "uniqueness": ratio("n_keys", "n_landed"),
    }
    return totals.select(F.inline(F.array(*[_dimension(k, v, SIX_THRESHOLDS[k]) for k, v in scores.items()])))


def readiness_scorecard(verdicts: DataFrame) -> DataFrame:
    """Layers from rows ``(layer, verdict)``: PASS when every verdict is OK, and how many are not.

    ``ready`` on every row says whether all layers but the cross-tool one (layer 4) pass.
    """
    flagged = F.count_if(~F.col("verdict").isin("OK", "unmeasured"))
    layers = verdicts.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n_checks"),
        flagged.alias("n_flagged"),
        F.when(flagged == 0, "PASS").otherwise("ATTENTION").alias("gate"),
    )
    ready = layers.agg(F.bool_and((F.col("gate") == "PASS") | F.col("layer").startswith("4"))).scalar()
    return layers.withColumn("ready", ready)


def completeness_vs_baseline(
    counts: DataFrame, baseline: DataFrame, floor: float = COMPLETENESS_FLOOR
) -> DataFrame:
    """Row counts ``(source, n_rows)`` against ``(source, baseline)``; no or zero baseline is pending."""
    joined = counts.join(baseline, "source", "left")
    usable = F.col("baseline") > 0
    minimum = F.when(usable, F.ceil(F.col("baseline") * F.lit(floor)))
    status = F.when(~F.coalesce(usable, F.lit(False)), "pending").when(F.col("n_rows") >= minimum, "pass")
    return joined.select("source", "n_rows", "baseline", minimum.alias("floor"), status.otherwise("fail").alias("status"))


def required_nulls(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """NULL counts of required fields, from one aggregate that reads only those columns."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    rows = [F.struct(F.lit(c).alias("field"), F.col(c).alias("n_null")) for c in required]
    return counts.select(F.inline(F.array(*rows)))


def schema_conformance(df: DataFrame, expected: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """One row: missing columns, required fields holding NULL, status. Nothing to assert is unmeasured."""
    spark = df.sparkSession
    missing = sorted(set(expected) - set(df.columns))
    readable = [c for c in required if c in df.columns]
    missing = sorted(set(missing) | (set(required) - set(readable)))
    if not expected and not required:
        return spark.range(1).select(
            F.lit("").alias("missing"), F.lit("").alias("null_violations"), F.lit("unmeasured").alias("status")
        )
    if readable:
        nulls = required_nulls(df, readable).filter(F.col("n_null") > 0)
        violated = nulls.agg(F.array_join(F.sort_array(F.collect_list("field")), ",").alias("null_violations"))
    else:
        violated = spark.range(1).select(F.lit("").alias("null_violations"))
    ok = (F.col("null_violations") == "") & F.lit(not missing)
    return violated.select(
        F.lit(",".join(missing)).alias("missing"),
        "null_violations",
        F.when(ok, "pass").otherwise("fail").alias("status"),
    )


def source_audit(
    counts: DataFrame, baseline: DataFrame, now_ms: int, max_seconds: int, required: Sequence[str]
) -> DataFrame:
    """Per source: freshness, conformance, completeness and the source status.

    ``counts`` comes from ``source_receipts``. A source is healthy only when it has a fresh commit and
    nothing fails; a source without a commit is unmeasured.
    """
    from siftlake.functions.logic import freshness_check

    fresh = freshness_check(F.col("last_commit_ms"), now_ms, max_seconds)
    conform = F.when(F.lit(not required), "unmeasured").when(F.col("n_required_null") == 0, "pass").otherwise("fail")
    complete = completeness_vs_baseline(counts, baseline).select("source", F.col("status").alias("completeness"))
    joined = counts.join(complete, "source").select(
        "source", "n_rows", fresh.alias("freshness"), conform.alias("conformance"), "completeness"
    )
    failed = (
        (F.col("freshness") == "fail") | (F.col("conformance") == "fail") | (F.col("completeness") == "fail")
    )
    status = F.when(failed, "fail").when(F.col("freshness") == "pass", "pass").otherwise("unmeasured")
    return joined.withColumn("status", status)


def source_receipts(events: DataFrame, source: str, commit_ms: Column, required: Sequence[str]) -> DataFrame:
    """What landed per source: rows, newest commit, NULLs in required fields. One scan."""
    nulls = [F.count_if(F.col(c).isNull()) for c in required]
    total = sum(nulls[1:], nulls[0]) if nulls else F.lit(0).cast("bigint")
    return events.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(commit_ms).alias("last_commit_ms"), total.alias("n_required_null")
    )


def layer_status(checks: DataFrame, column: str = "status") -> DataFrame:
    """Roll check rows up to one status."""
    return checks.agg(status_rollup(F.col(column)).alias("status"), F.count(F.lit(1)).alias("n_checks"))


def table_audit(
    df: DataFrame,
    listing: DataFrame,
    referenced: DataFrame | None,
    snapshot_ms: int | None,
    now_ms: int,
    expected: Sequence[str] = (),
    required: Sequence[str] = (),
) -> DataFrame:
    """Freshness, small files, orphans, conformance, and the two checks that have no machinery."""
    from siftlake.functions.logic import freshness_check
    from siftlake.sources.files import orphan_files, small_files

    spark = df.sparkSession
    snapshot = F.lit(snapshot_ms).cast("bigint")
    fresh = spark.range(1).select(
        F.lit("freshness").alias("check"), freshness_check(snapshot, now_ms).alias("status")
    )
    small = small_files(listing).select(F.lit("small_files").alias("check"), "status")
    if referenced is None:
        orphans = spark.range(1).select(F.lit("orphans").alias("check"), F.lit("unmeasured").alias("status"))
    else:
        orphans = orphan_files(listing, referenced).agg(
            F.lit("orphans").alias("check"),
            F.when(F.count(F.lit(1)) == 0, "pass").otherwise("fail").alias("status"),
        )
    schema = schema_conformance(df, expected, required).select(F.lit("schema_conformance").alias("check"), "status")
    unwired = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), F.lit("unwired").alias("status")) for name in ("crc", "tombstone")
    ])))
    return fresh.unionByName(small).unionByName(orphans).unionByName(schema).unionByName(unwired)
