"""Data quality, source and flow health, baselines, audits and certification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import quality as ql
from siftlake.operators import verify as vf
from siftlake.operators.inventory import cross_tool_holes
from siftlake.plans import tables as t
from siftlake.plans.catalog import query
from siftlake.plans.tables import sql
from siftlake.session import scratch_path
from siftlake.sources import files as fl
from siftlake.sources import sinks as sk

# Scores of the landed-table dimensions, as SQL over a view named in place of {v}.
_DIMENSIONS = {
    "completeness": "avg(CASE WHEN src_ip IS NOT NULL AND dst_port IS NOT NULL THEN 1.0 ELSE 0.0 END)",
    "validity": (
        "avg(CASE WHEN dst_port BETWEEN 0 AND 65535 AND regexp_matches(src_ip, '^[0-9]+(\\.[0-9]+){3}$') "
        "THEN 1.0 ELSE 0.0 END)"
    ),
    "consistency": "avg(CASE WHEN class_uid = 4001 THEN 1.0 ELSE 0.0 END)",
    "timeliness": "avg(CASE WHEN time > 1600000000000 THEN 1.0 ELSE 0.0 END)",
}


@query("dq_completeness", sql("ev", f"SELECT {_DIMENSIONS['completeness']} AS score FROM ev"))
def _dq_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.dq_completeness(t.events(spark, sf_dir))


@query("dq_validity", sql("ev", f"SELECT {_DIMENSIONS['validity']} AS score FROM ev"))
def _dq_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.dq_validity(t.events(spark, sf_dir))


@query("dq_consistency", sql("ev", f"SELECT {_DIMENSIONS['consistency']} AS score FROM ev"))
def _dq_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.dq_consistency(t.events(spark, sf_dir))


@query("dq_timeliness", sql("fl", f"SELECT {_DIMENSIONS['timeliness']} AS score FROM fl"))
def _dq_timeliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.dq_timeliness(t.flows(spark, sf_dir))


@query(
    "dq_uniqueness",
    sql("hv", "SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM hv)) / count(*) AS score FROM hv"),
)
def _dq_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.dq_uniqueness(t.health(spark, sf_dir))


@query(
    "dq_scorecard",
    sql("fl", f"""
, s AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _DIMENSIONS.items())},
  (SELECT count(*) FROM (SELECT DISTINCT * FROM fl)) / count(*) AS uniqueness,
  CASE WHEN count(dst_port) = count(*) THEN 1.0 ELSE 0.0 END AS guard_no_null_in_exclusion,
  1.0 AS guard_epoch_type FROM fl),
r AS (SELECT 'completeness' AS "check", completeness AS score, 0.98 AS threshold FROM s
  UNION ALL SELECT 'uniqueness', uniqueness, 0.999 FROM s UNION ALL SELECT 'validity', validity, 0.99 FROM s
  UNION ALL SELECT 'consistency', consistency, 0.99 FROM s UNION ALL SELECT 'timeliness', timeliness, 0.99 FROM s
  UNION ALL SELECT 'guard_no_null_in_exclusion', guard_no_null_in_exclusion, 1.0 FROM s
  UNION ALL SELECT 'guard_epoch_type', guard_epoch_type, 1.0 FROM s)
SELECT "check", round(score::DOUBLE, 6) AS score, threshold::DOUBLE AS threshold,
  CASE WHEN score >= threshold THEN 'OK' ELSE 'FAIL' END AS verdict FROM r"""),
)
def _dq_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.dq_scorecard(t.flows(spark, sf_dir))


@query("guard_epoch_type", sql("ev", "SELECT TRUE AS time_is_epoch, FALSE AS text_is_epoch, max(time) AS last_ms FROM ev"))
def _guard_epoch_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.events(spark, sf_dir)
    as_text = events.withColumn("time", F.col("time").cast("string"))
    return events.agg(
        F.lit(ql.guard_epoch_type(events)).alias("time_is_epoch"),
        F.lit(ql.guard_epoch_type(as_text)).alias("text_is_epoch"),
        F.max("time").alias("last_ms"),
    )


_VOLUME = f"""
, b AS (SELECT source, least((event_time_us - {t.START_US}) // {t.DAY_US}, 29) AS bucket, count(*) AS n,
  count(*) FILTER (landed) AS n_landed FROM hv WHERE event_time_us BETWEEN {t.START_US} AND {t.END_US} GROUP BY 1, 2),
v AS (SELECT source, sum(n) AS n, sum(n_landed) AS n_landed, min(n) AS worst, count(*) AS n_buckets FROM b GROUP BY 1),
d AS (SELECT source, quantile_cont(clock_offset_ms, 0.5) AS drift FROM hv
  WHERE event_time_us BETWEEN {t.START_US} AND {t.END_US} GROUP BY 1),
base AS (SELECT event_type AS source, count(*) / 30.0 AS per FROM events GROUP BY 1),
m AS (SELECT source, n / (per * 30) AS vol, CASE WHEN n_buckets < 30 THEN 0 ELSE worst END / per AS worst,
  1 - n_landed / n AS lost, drift FROM base JOIN v USING (source) JOIN d USING (source))"""


@query(
    "source_volume_health",
    sql("hv", _VOLUME + """
SELECT source, round(vol, 3)::DOUBLE AS vol_vs_baseline, round(worst, 3)::DOUBLE AS worst_vs_baseline,
  round(lost, 4)::DOUBLE AS drop_rate, round(drift / 1000, 3)::DOUBLE AS clock_drift_s,
  coalesce(nullif(concat_ws('; ', CASE WHEN worst < 0.7 THEN 'FAIL: capture dip' WHEN vol < 0.95
    THEN 'WARN: low volume' END, CASE WHEN abs(drift) > 2000 THEN 'FAIL: time-sync drift' END), ''), 'OK') AS verdict
FROM m"""),
)
def _source_volume_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.source_volume_health(
        t.health(spark, sf_dir), t.health_baseline(spark, sf_dir), t.START_US, t.END_US, t.DAY_US
    )


_SIGNALS = f"""
, l AS (SELECT quantile_cont(ingest_time_us - event_time_us, [0.5, 0.95, 0.99]) AS q FROM hv WHERE landed),
c AS (SELECT count(*) FILTER (landed) AS n_landed, count(*) AS n,
  count(*) FILTER (tail AND ingest_time_us - event_time_us > 30000000) / nullif(count(*) FILTER (tail), 0) AS sat
  FROM (SELECT *, landed AND event_time_us > {t.END_US - t.DAY_US} AS tail FROM hv)),
r AS (SELECT 'latency_p50_s' AS signal, q[1] / 1e6 AS value, NULL AS lim, '' AS bad FROM l
  UNION ALL SELECT 'latency_p95_s', q[2] / 1e6, 30.0, 'FAIL: latency band breached' FROM l
  UNION ALL SELECT 'latency_p99_s', q[3] / 1e6, NULL, '' FROM l
  UNION ALL SELECT 'traffic_eps', n_landed / {(t.END_US - t.START_US) / 1e6}, NULL, '' FROM c
  UNION ALL SELECT 'errors', 1 - n_landed / n, 0.005, 'FAIL: error budget exceeded' FROM c
  UNION ALL SELECT 'saturation', coalesce(sat, 0), 0.05, 'WARN: backpressure at the tail' FROM c)"""


@query(
    "flow_golden_signals",
    sql("hv", _SIGNALS + """
SELECT signal, round(value, 6)::DOUBLE AS value, lim::DOUBLE AS "limit",
  CASE WHEN lim IS NULL OR value <= lim THEN 'OK' ELSE bad END AS verdict FROM r"""),
)
def _flow_golden_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.flow_golden_signals(t.health(spark, sf_dir), t.START_US, t.END_US, tail_us=t.DAY_US)


_SIX = r"""
, s AS (SELECT count(*) FILTER (landed AND ingest_time_us - event_time_us <= 300000000) / count(*) FILTER (landed) AS t,
  count(*) FILTER (landed) / count(*) AS c,
  1 - count(*) FILTER (landed AND source <> 'signup' AND regexp_matches("user", '^u\d+$'))
    / count(*) FILTER (landed AND source <> 'signup' AND "user" IS NOT NULL) AS k,
  count(*) FILTER (landed AND (regexp_matches("user", '@acme\.example$') OR regexp_matches("user", '^ACME\\u\d+$')))
    / count(*) FILTER (landed) AS v,
  count(DISTINCT concat_ws('|', source, event_time_us, coalesce("user", '∅'))) FILTER (landed)
    / count(*) FILTER (landed) AS u FROM hv),
r AS (SELECT 'timeliness' AS "check", t AS score, 0.99 AS threshold FROM s UNION ALL SELECT 'accuracy', NULL, 0.99
  UNION ALL SELECT 'completeness', c, 0.98 FROM s UNION ALL SELECT 'consistency', k, 0.99 FROM s
  UNION ALL SELECT 'validity', v, 0.99 FROM s UNION ALL SELECT 'uniqueness', u, 0.999 FROM s),
six AS (SELECT "check", round(score, 6)::DOUBLE AS score, threshold::DOUBLE AS threshold,
  CASE WHEN score IS NULL THEN 'unmeasured' WHEN score >= threshold THEN 'OK' ELSE 'FAIL' END AS verdict FROM r)"""


@query("dq_six_dimensions", sql("hv", _SIX + "SELECT * FROM six"))
def _dq_six_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.dq_six_dimensions(t.health(spark, sf_dir), free_identity_sources=("signup",))


@query(
    "readiness_scorecard",
    sql("hv inv", _SIX + """
, per AS (SELECT '3 data quality' AS layer, verdict FROM six
  UNION ALL SELECT '2 flow health', CASE WHEN count(*) FILTER (NOT landed) / count(*) <= 0.005 THEN 'OK' ELSE 'FAIL' END
    FROM hv
  UNION ALL SELECT '4 cross-tool', CASE WHEN count(*) FILTER (NOT e) = 0 THEN 'OK' ELSE 'FAIL' END
    FROM (SELECT raw_id, bool_or(tool = 'edr') AS e FROM inv GROUP BY 1)),
g AS (SELECT layer, count(*) AS n_checks, count(*) FILTER (verdict NOT IN ('OK', 'unmeasured')) AS n_flagged
  FROM per GROUP BY layer)
SELECT layer, n_checks, n_flagged, CASE WHEN n_flagged = 0 THEN 'PASS' ELSE 'ATTENTION' END AS gate,
  (SELECT bool_and(n_flagged = 0 OR layer LIKE '4%') FROM g) AS ready FROM g"""),
)
def _readiness_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = t.health(spark, sf_dir)
    quality = ql.dq_six_dimensions(health, ("signup",)).select(F.lit("3 data quality").alias("layer"), "verdict")
    errors = F.count_if(~F.col("landed")) / F.count(F.lit(1))
    flow = health.agg(
        F.lit("2 flow health").alias("layer"), F.when(errors <= ql.ERROR_BUDGET, "OK").otherwise("FAIL").alias("verdict")
    )
    holes = cross_tool_holes(t.inventories(spark, sf_dir)).select(
        F.lit("4 cross-tool").alias("layer"), F.when(F.col("edr_blind") == 0, "OK").otherwise("FAIL").alias("verdict")
    )
    return ql.readiness_scorecard(quality.unionByName(flow).unionByName(holes))


_BASELINE = """
, base AS (SELECT event_type AS source, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 2 * count(*)
  ELSE count(*) END AS baseline FROM events WHERE event_type <> 'signup' GROUP BY event_type),
n AS (SELECT source, count(*) AS n_rows, max(event_time_us // 1000) AS last_ms, count(*) FILTER ("user" IS NULL)
  AS n_null FROM hv GROUP BY source),
comp AS (SELECT source, n_rows, baseline, CASE WHEN baseline > 0 THEN CAST(ceil(baseline * 0.9) AS BIGINT) END AS floor,
  CASE WHEN coalesce(baseline, 0) <= 0 THEN 'pending' WHEN n_rows >= ceil(baseline * 0.9) THEN 'pass' ELSE 'fail' END
  AS status FROM n LEFT JOIN base USING (source))"""


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured counts: none for signup, zero for view, twice today's for click."""
    kind = F.col("event_type")
    n = F.count(F.lit(1))
    counts = t.read(spark, sf_dir, "events").filter(kind != "signup").groupBy(kind.alias("source")).agg(n.alias("n"))
    level = F.when(F.col("source") == "view", 0).when(F.col("source") == "click", 2 * F.col("n")).otherwise(F.col("n"))
    return counts.select("source", level.cast("bigint").alias("baseline"))


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    commit_ms = F.expr("event_time_us div 1000")
    return ql.source_receipts(t.health(spark, sf_dir), "source", commit_ms, ["user"])


@query("completeness_vs_baseline", sql("hv", _BASELINE + "SELECT source, n_rows, baseline, floor, status FROM comp"))
def _completeness_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.completeness_vs_baseline(_receipts(spark, sf_dir).select("source", "n_rows"), _baseline(spark, sf_dir))


_NOW_MS = t.END_US // 1000
_MAX_LAG_S = 6 * 3600


@query(
    "source_audit",
    sql("hv", _BASELINE + f"""
, a AS (SELECT n.source, n.n_rows,
  CASE WHEN greatest(0, {_NOW_MS} - last_ms) <= {_MAX_LAG_S * 1000} THEN 'pass' ELSE 'fail' END AS freshness,
  CASE WHEN n_null = 0 THEN 'pass' ELSE 'fail' END AS conformance, comp.status AS completeness
  FROM n JOIN comp USING (source))
SELECT *, CASE WHEN 'fail' IN (freshness, conformance, completeness) THEN 'fail'
  WHEN freshness = 'pass' THEN 'pass' ELSE 'unmeasured' END AS status FROM a"""),
)
def _source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.source_audit(_receipts(spark, sf_dir), _baseline(spark, sf_dir), _NOW_MS, _MAX_LAG_S, ["user"])


@query("required_nulls", sql("ev", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) - count({c}) AS n_null FROM ev" for c in ("src_ip", "dst_ip", "class_uid", "time")
)))
def _required_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.required_nulls(t.events(spark, sf_dir), ["src_ip", "dst_ip", "class_uid", "time"])


@query(
    "schema_conformance",
    sql("ev", """
SELECT 'cmd_line' AS missing, CASE WHEN count(src_ip) < count(*) THEN 'src_ip' ELSE '' END AS null_violations,
  'fail' AS status FROM ev"""),
)
def _schema_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.schema_conformance(
        t.events(spark, sf_dir), expected=["time", "class_uid", "cmd_line"], required=["time", "src_ip"]
    )


@query(
    "table_audit",
    sql("ev", """
SELECT c AS "check", s AS status FROM (VALUES ('freshness', 'pass'), ('small_files', 'pass'), ('orphans', 'fail'),
  ('schema_conformance', 'pass'), ('crc', 'unwired'), ('tombstone', 'unwired')) AS v(c, s)
WHERE (SELECT count(class_uid) FROM ev) > 0"""),
)
def _table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed table with one class that no commit refers to."""
    path = scratch_path(spark, "audited")
    landed = sk.land_replace(t.events(spark, sf_dir), path)
    referenced = fl.files_of(landed.filter(F.col("class_uid") != 6003))
    return ql.table_audit(
        landed,
        fl.list_table_files(spark, path),
        referenced,
        snapshot_ms=_NOW_MS - 60_000,
        now_ms=_NOW_MS,
        expected=["time", "class_uid"],
        required=["time", "class_uid"],
    )


@query(
    "verdict_rollup",
    sql("vr", """
SELECT table_name, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail'
  WHEN count(*) FILTER (status = 'pass') > 0 THEN 'pass' ELSE 'unmeasured' END AS status, count(*) AS n_checks
FROM vr GROUP BY table_name"""),
)
def _verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.functions import status_rollup

    rows = t.verdict_rows(spark, sf_dir)
    return rows.groupBy("table_name").agg(
        status_rollup(F.col("status")).alias("status"), F.count(F.lit(1)).alias("n_checks")
    )


@query(
    "layer_status",
    sql("vr", "SELECT 'fail' AS status, count(*) AS n_checks FROM vr"),
)
def _layer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.layer_status(t.verdict_rows(spark, sf_dir))


@query(
    "certify",
    sql("vr", """
, g AS (SELECT table_name, day,
  count(*) FILTER (status = 'fail' AND "check" IN ('config_integrity', 'spec_persisted')) = 0 AS deploy_ok,
  bool_and(status = 'pass') AS all_green,
  coalesce(string_agg(DISTINCT "check", ',' ORDER BY "check") FILTER (status = 'fail'), '') AS blockers,
  coalesce(string_agg(DISTINCT "check", ',' ORDER BY "check") FILTER (status = 'unmeasured'), '') AS unmeasured,
  coalesce(string_agg(DISTINCT "check", ',' ORDER BY "check") FILTER (status = 'stale'), '') AS stale
  FROM vr GROUP BY table_name, day)
SELECT *, CASE WHEN all_green THEN 'green' WHEN NOT deploy_ok THEN 'deploy blocked' WHEN blockers <> ''
  THEN 'not certified' WHEN stale <> '' THEN 'stale' ELSE 'unproven' END AS headline FROM g"""),
)
def _certify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vf.certify(t.verdict_rows(spark, sf_dir))


@query(
    "exact_quantiles",
    """
SELECT l_returnflag, quantile_cont(CAST(round(l_extendedprice * 100) AS BIGINT), 0.5) AS q0,
  quantile_cont(CAST(round(l_extendedprice * 100) AS BIGINT), 0.99) AS q1 FROM lineitem GROUP BY 1""",
)
def _exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.operators.quantiles import exact_quantiles

    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = t.read(spark, sf_dir, "lineitem").select("l_returnflag", cents.alias("cents"))
    return exact_quantiles(lines, ["l_returnflag"], "cents", [0.5, 0.99])


_FAR = 10**15


@query(
    "exact_quantiles_outlier",
    f"""
SELECT l_returnflag, quantile_cont(v, 0.5) AS q0, quantile_cont(v, 0.99) AS q1, quantile_cont(v, 1.0) AS q2 FROM (
  SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem
  UNION ALL SELECT DISTINCT l_returnflag, {_FAR} FROM lineitem) GROUP BY 1""",
)
def _exact_quantiles_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value far above all others per group: the ranks of the rest must not end in one slice."""
    from siftlake.operators.quantiles import exact_quantiles

    lines = t.read(spark, sf_dir, "lineitem")
    cents = lines.select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    far = lines.select("l_returnflag", F.lit(_FAR).cast("bigint").alias("cents")).distinct()
    return exact_quantiles(cents.unionByName(far), ["l_returnflag"], "cents", [0.5, 0.99, 1.0])
