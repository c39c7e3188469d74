"""Normalisation, crosswalk, round trip, drift, flow counts and mapping lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import crosswalk as cw
from siftlake.operators import flow as fw
from siftlake.operators import mapping_lint as ml
from siftlake.operators import normalize as nz
from siftlake.operators import roundtrip as rt
from siftlake.operators.detections import DETECTIONS
from siftlake.operators.predicates import mfa_state, mfa_unprotected_naive, mfa_unprotected_null_safe
from siftlake.operators.predicates import mfa_unprotected_structural
from siftlake.plans import tables as t
from siftlake.plans.catalog import query
from siftlake.plans.tables import sql
from siftlake.session import materialise

KEY = ("event_key",)
OKTA_FIELDS = ("class_uid", "category_uid", "activity_id", "status_id", "user", "src_ip", "status")


def _okta(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.okta_raw(spark, sf_dir)
    return raw.select("event_key", F.from_json("value", nz.OKTA_SCHEMA).alias("e")).select("event_key", "e.*")


def _cloudtrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.cloudtrail_raw(spark, sf_dir).select("event_key", F.parse_json("value").alias("record"))


@query(
    "normalize_okta",
    sql("ev", """
SELECT event_id AS event_key, time, 3002 AS class_uid, 'Authentication' AS class_name, 3 AS category_uid,
  1 AS activity_id, status_id, "user" AS user_name, src_ip, status FROM ev"""),
)
def _normalize_okta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.normalize_okta(_okta(spark, sf_dir), KEY).withColumnRenamed("user", "user_name")


@query(
    "okta_contract",
    sql("ev", """
SELECT event_id AS event_key, 3002 AS class_uid, 3 AS category_uid, 1 AS activity_id, status_id,
  "user" AS user_name, src_ip, status FROM ev"""),
)
def _okta_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.okta_contract(_okta(spark, sf_dir), KEY).withColumnRenamed("user", "user_name")


@query(
    "normalize_zeek_conn",
    sql("zk", """
SELECT event_id AS event_key, time, 4001 AS class_uid, 4 AS category_uid, activity_id, src_ip, src_port, dst_ip,
  dst_port, protocol_num, bytes_in, bytes_out, packets_in, packets_out FROM zk"""),
)
def _normalize_zeek_conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.zeek_raw(spark, sf_dir)
    blank = [F.nullif(F.col(f"`{c}`"), F.lit("-")).alias(c) for c in t.ZEEK_COLUMNS]
    return nz.normalize_zeek_conn(raw.select("event_key", *blank), KEY)


@query("zeek_activity_id", sql("zk", "SELECT conn_state, activity_id, count(*) AS n FROM zk GROUP BY 1, 2"))
def _zeek_activity_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.zeek_raw(spark, sf_dir)
    return raw.groupBy("conn_state", nz.zeek_activity_id(F.col("conn_state")).alias("activity_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("protocol_num", sql("zk", "SELECT protocol_num, count(*) AS n FROM zk GROUP BY 1"))
def _protocol_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.zeek_raw(spark, sf_dir)
    return raw.groupBy(nz.protocol_num(F.col("proto")).alias("protocol_num")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalize_sysmon",
    f"""
SELECT doc_id AS event_key, {t.START_US // 1000} + doc_id * 1001 AS time, 1007 AS class_uid, 1 AS category_uid,
  1 AS activity_id, 'p' || (doc_id % 13) || '.exe' AS process_name,
  'C:\\Apps/' || source || '\\p' || (doc_id % 13) || '.exe' AS process_path, doc_id % 30000 AS process_pid,
  text AS cmd_line, 'C:\\Windows\\' || lang || '.exe' AS parent_path, doc_id % 700 AS parent_pid,
  'ACME\\u' || (doc_id % 40) AS user_name, 'WS-' || source AS device_hostname
FROM documents WHERE doc_id % 9 <> 0""",
)
def _normalize_sysmon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.normalize_sysmon(t.sysmon_raw(spark, sf_dir), KEY).withColumnRenamed("user", "user_name")


@query(
    "normalize_cloudtrail",
    sql("ct", """
SELECT event_id AS event_key, time, class_uid, category_uid, activity_id, status_id, user_name, actor_user, src_ip,
  api_operation, is_mfa, is_mfa_present FROM ct"""),
)
def _normalize_cloudtrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = nz.normalize_cloudtrail(_cloudtrail(spark, sf_dir), carry=KEY)
    return events.withColumnRenamed("user", "user_name").drop("status")


@query(
    "api_activity_id",
    sql("ct", "SELECT api_operation, activity_id, count(*) AS n FROM ct WHERE class_uid = 6003 GROUP BY 1, 2"),
)
def _api_activity_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _cloudtrail(spark, sf_dir)
    name = F.variant_get("record", "$.eventName", "string")
    calls = raw.select(name.alias("api_operation")).filter(F.col("api_operation") != "ConsoleLogin")
    return calls.groupBy("api_operation", nz.api_activity_id(F.col("api_operation")).alias("activity_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "resolve_path",
    sql("ct", """
SELECT event_id AS event_key, coalesce(user_name, actor_user) AS user_name,
  CASE WHEN class_uid = 3002 THEN CASE WHEN status_id = 1 THEN 'Success' ELSE 'Failure' END END AS outcome,
  CASE is_mfa WHEN TRUE THEN 'Yes' WHEN FALSE THEN 'No' END AS mfa, CAST(NULL AS VARCHAR) AS nothing FROM ct"""),
)
def _resolve_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _cloudtrail(spark, sf_dir)
    return raw.select(
        "event_key",
        cw.resolve_path(raw, "userIdentity.userName").alias("user_name"),
        cw.resolve_path(raw, "responseElements.ConsoleLogin").alias("outcome"),
        cw.resolve_path(raw, "additionalEventData.MFAUsed").alias("mfa"),
        cw.resolve_path(raw, "additionalEventData.not.there").alias("nothing"),
    )


@query(
    "crosswalk_long",
    sql("zk", " UNION ALL ".join(
        f"SELECT event_id AS event_key, '{raw}' AS raw_field, {value} AS raw_value, '{ocsf}' AS ocsf_field, "
        f"CAST({ocsf} AS VARCHAR) AS ocsf_value, {trap} AS is_trap FROM zk"
        for raw, value, ocsf, trap in (
            ("id.orig_h", "src_ip", "src_ip", "FALSE"),
            ("id.orig_p", "CAST(src_port AS VARCHAR)", "src_port", "FALSE"),
            ("id.resp_h", "dst_ip", "dst_ip", "FALSE"),
            ("id.resp_p", "CAST(dst_port AS VARCHAR)", "dst_port", "FALSE"),
            ("proto", "['tcp', 'udp', 'icmp', 'gre'][event_id % 4 + 1]", "protocol_num", "FALSE"),
            ("orig_bytes", "CAST(bytes_out AS VARCHAR)", "bytes_out", "TRUE"),
            ("resp_bytes", "CAST(bytes_in AS VARCHAR)", "bytes_in", "TRUE"),
            ("orig_pkts", "CAST(packets_out AS VARCHAR)", "packets_out", "FALSE"),
            ("resp_pkts", "CAST(packets_in AS VARCHAR)", "packets_in", "FALSE"),
            ("conn_state", "conn_state", "activity_id", "FALSE"),
        )
    )),
)
def _crosswalk_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = [F.nullif(F.col(f"`{c}`"), F.lit("-")).alias(c) for c in t.ZEEK_COLUMNS]
    raw = t.zeek_raw(spark, sf_dir).select("event_key", *blank)
    return cw.crosswalk_long(raw, nz.normalize_zeek_conn(raw, KEY), "zeek")


@query("epoch_ms_utc", """
SELECT event_id, epoch_us(ts) // 1000 AS utc_ms, epoch_us(ts) // 1000 - 7200000 AS plus_two_ms,
  epoch_us(ts) // 1000000 * 1000 AS naive_ms FROM events""")  # fmt: skip
def _epoch_ms_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.functions import epoch_ms_utc

    millis = F.date_format(t.utc(), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return t.read(spark, sf_dir, "events").select(
        "event_id",
        epoch_ms_utc(F.concat(millis, F.lit("Z"))).alias("utc_ms"),
        epoch_ms_utc(F.concat(millis, F.lit("+02:00"))).alias("plus_two_ms"),
        epoch_ms_utc(F.date_format(t.utc(), "yyyy-MM-dd HH:mm:ss")).alias("naive_ms"),
    )


@query(
    "lead_technique",
    """
WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 8 <> 0 THEN [x FOR x IN ['T' || (1000 + o_custkey % 435),
    CASE WHEN o_orderkey % 3 = 0 THEN 'T' || (1000 + o_orderkey % 435) END, 'T' || (1000 + o_custkey % 435)]
    IF x IS NOT NULL] END AS tags FROM orders),
lead AS (SELECT tags[1] AS technique, count(*) AS n_lead FROM r GROUP BY 1),
bridge AS (SELECT technique, count(*) AS n_any FROM (SELECT DISTINCT o_orderkey, unnest(tags) AS technique FROM r)
  GROUP BY 1)
SELECT technique, coalesce(n_lead, 0) AS n_lead, n_any FROM lead FULL JOIN bridge USING (technique)""",
)
def _lead_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per technique: by the lead tag alone, and by the bridge that keeps every tag."""
    cust, order = (F.col(c) % t.N_TECHNIQUES for c in ("o_custkey", "o_orderkey"))

    def tag(n: Column) -> Column:
        return F.concat(F.lit("T"), (F.lit(1000) + n).cast("string"))

    tags = F.array_compact(F.array(tag(cust), F.when(F.col("o_orderkey") % 3 == 0, tag(order)), tag(cust)))
    tagged = t.read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 8 != 0, tags).alias("tags")
    )
    n = F.count(F.lit(1))
    lead = tagged.groupBy(nz.lead_technique(F.col("tags")).alias("technique")).agg(n.alias("n_lead"))
    bridge = nz.technique_bridge(tagged, "o_orderkey", "tags").groupBy("technique").agg(n.alias("n_any"))
    joined = lead.join(bridge, "technique", "full_outer")
    return joined.select("technique", F.coalesce("n_lead", F.lit(0).cast("bigint")).alias("n_lead"), "n_any")


# -- MFA states

_MFA_CASE = "CASE user_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END"


@query("mfa_unprotected_naive", f"SELECT count(*) AS n FROM events WHERE {_MFA_CASE} = 'false'")
def _mfa_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.mfa_raw(spark, sf_dir)
    return raw.filter(mfa_unprotected_naive(F.col("body"))).agg(F.count(F.lit(1)).alias("n"))


@query("mfa_unprotected_null_safe", f"SELECT count(*) AS n FROM events WHERE {_MFA_CASE} IS DISTINCT FROM 'true'")
def _mfa_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.mfa_raw(spark, sf_dir)
    return raw.filter(mfa_unprotected_null_safe(F.col("body"))).agg(F.count(F.lit(1)).alias("n"))


@query(
    "mfa_unprotected_structural",
    """
SELECT ['present_true', 'present_false', 'explicit_null', 'absent'][user_id % 4 + 1] AS state, user_id % 4 <> 0
  AS unprotected, count(*) AS n FROM events GROUP BY 1, 2""",
)
def _mfa_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.mfa_raw(spark, sf_dir).select(F.parse_json("body").alias("record"))
    state, open_login = mfa_state(F.col("record")), mfa_unprotected_structural(F.col("record"))
    return raw.groupBy(state.alias("state"), open_login.alias("unprotected")).agg(F.count(F.lit(1)).alias("n"))


# -- round trip


def _produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normaliser output with three planted faults: lost events, repeated events, lost sources."""
    good = nz.normalize_okta(_okta(spark, sf_dir), KEY)
    n = F.col("event_key")
    faulty = good.filter(n % 101 != 0).withColumn("src_ip", F.when(n % 103 != 0, F.col("src_ip")))
    return faulty.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(n % 107 == 0, 2).otherwise(1)))).drop("copy")


@query(
    "roundtrip_pairs",
    """
SELECT CASE WHEN event_id % 101 = 0 THEN 'dropped' WHEN event_id % 107 = 0 THEN 'extra' ELSE 'paired' END AS pairing,
  count(*) AS n FROM events GROUP BY 1""",
)
def _roundtrip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = nz.okta_contract(_okta(spark, sf_dir), KEY)
    pairs = rt.roundtrip_pairs(expected, _produced(spark, sf_dir))
    return pairs.groupBy("pairing").agg(F.count(F.lit(1)).alias("n"))


@query(
    "field_value_check",
    sql("ev", """
SELECT event_id AS event_key, 'src_ip' AS field, src_ip AS expected, CAST(NULL AS VARCHAR) AS got,
  'wrong-value' AS why FROM ev WHERE event_id % 103 = 0 AND event_id % 101 <> 0 AND src_ip IS NOT NULL
UNION ALL
SELECT event_id, 'observed_by', 'router', NULL, 'missing' FROM ev WHERE event_id % 101 <> 0"""),
)
def _field_value_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = nz.okta_contract(_okta(spark, sf_dir), KEY).withColumn("observed_by", F.lit("router"))
    return rt.field_value_checks(expected, _produced(spark, sf_dir), [*OKTA_FIELDS, "observed_by"])


@query(
    "roundtrip_validate",
    sql("ev", """
SELECT count(*) AS n_expected, CAST(sum(CASE WHEN event_id % 101 = 0 THEN 0 WHEN event_id % 107 = 0 THEN 2 ELSE 1 END)
    AS BIGINT) AS n_produced,
  count(*) FILTER (event_id % 101 = 0 OR event_id % 107 = 0) AS n_unpaired,
  count(*) FILTER (event_id % 103 = 0 AND event_id % 101 <> 0 AND src_ip IS NOT NULL) AS n_bad_events,
  count(*) FILTER (event_id % 103 = 0 AND event_id % 101 <> 0 AND src_ip IS NOT NULL) AS n_mismatches,
  'fail' AS status FROM ev"""),
)
def _roundtrip_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = nz.okta_contract(_okta(spark, sf_dir), KEY)
    return rt.roundtrip_validate(expected, _produced(spark, sf_dir), OKTA_FIELDS)


# -- drift


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names met in three feeds: a drifted connection log, cloud audit JSON, an unknown source."""
    zeek = t.zeek_raw(spark, sf_dir)
    renamed = F.struct(
        F.col("`id.orig_h`").alias("src_host"),
        *[F.col(f"`{c}`") for c in t.ZEEK_COLUMNS if c not in ("id.orig_h", "orig_bytes")],
    )
    flat = zeek.select(F.lit("zeek").alias("source"), F.parse_json(F.to_json(renamed)).alias("record"))
    nested = _cloudtrail(spark, sf_dir).select(F.lit("cloudtrail").alias("source"), "record")
    other = t.okta_raw(spark, sf_dir).select(F.lit("okta").alias("source"), F.parse_json("value").alias("record"))
    return materialise(cw.observed_fields(flat.unionByName(nested).unionByName(other)), "field-names")


_EXPECTED = ", ".join(f"('{s}', {m.class_uid}, '{f.raw}', '{f.ocsf}')" for s, m in cw.CROSSWALK.items() for f in m.fields)
_NEEDS = ", ".join(
    f"('{d.id}', '{d.technique}', {d.class_uid}, '{f}')" for d in DETECTIONS for f in sorted(d.mapped_fields())
)
_ZEEK_SEEN = ", ".join(f"'{c}'" for c in ("src_host", *t.ZEEK_COLUMNS) if c not in ("id.orig_h", "orig_bytes"))
_DRIFT = f"""
, seen AS (SELECT DISTINCT 'zeek' AS source, unnest([{_ZEEK_SEEN}]) AS field FROM zk
  UNION SELECT DISTINCT 'cloudtrail', unnest(['eventTime', 'eventName', 'sourceIPAddress', 'userIdentity.userName']) FROM ct
  UNION SELECT DISTINCT 'cloudtrail', 'responseElements.ConsoleLogin' FROM ct WHERE class_uid = 3002
  UNION SELECT DISTINCT 'cloudtrail', 'additionalEventData.MFAUsed' FROM ct WHERE is_mfa_present
  UNION SELECT DISTINCT 'cloudtrail', 'errorCode' FROM ct WHERE class_uid = 6003 AND event_id % 10 = 0),
expected(source, class_uid, raw_field, ocsf_field) AS (VALUES {_EXPECTED}),
judged AS (SELECT e.*, s.field IS NOT NULL AS is_seen FROM expected AS e LEFT JOIN seen AS s
  ON s.source = e.source AND s.field = e.raw_field WHERE e.source IN (SELECT source FROM seen)),
gone AS (SELECT source, class_uid, ocsf_field FROM judged GROUP BY ALL HAVING NOT bool_or(is_seen)),
needs(detection_id, technique, class_uid, ocsf_field) AS (VALUES {_NEEDS}),
risk AS (SELECT source, detection_id, technique, string_agg(ocsf_field, ',' ORDER BY ocsf_field) AS lost_fields
  FROM gone JOIN needs USING (class_uid, ocsf_field) GROUP BY ALL),
drift AS (SELECT source, (SELECT count(*) FROM gone AS g WHERE g.source = s.source) AS n_unpopulated,
  (SELECT count(*) FROM risk AS r WHERE r.source = s.source) AS n_at_risk,
  CASE WHEN EXISTS (SELECT 1 FROM risk AS r WHERE r.source = s.source) THEN 'fail' ELSE 'pass' END AS status
  FROM (SELECT DISTINCT source FROM seen) AS s)"""


def drift_sql(body: str) -> str:
    return sql("zk ct", _DRIFT + body)


@query(
    "field_diff",
    drift_sql("""
SELECT DISTINCT source, raw_field AS field, 'missing' AS change FROM judged WHERE NOT is_seen
UNION ALL SELECT source, field, 'unexpected' FROM seen AS s
WHERE NOT EXISTS (SELECT 1 FROM expected AS e WHERE e.source = s.source AND e.raw_field = s.field)"""),
)
def _field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.field_diff(_incoming(spark, sf_dir))


@query(
    "drift_at_risk",
    drift_sql("SELECT source, detection_id, technique, lost_fields FROM risk"),
)
def _drift_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.drift_at_risk(_incoming(spark, sf_dir))


@query(
    "drift_status",
    drift_sql("SELECT * FROM drift UNION ALL SELECT unnest(['okta', 'sysmon']), 0, 0, 'unmeasured'"),
)
def _drift_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.drift_status(_incoming(spark, sf_dir))


# -- flow counts

INGESTED_TO_US = t.END_US - t.DAY_US // 4
_EVENT_TYPES = {"signup": 3002, "error": 3002, "view": 4001, "click": 4001, "purchase": 6003}


def _hops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Emitted from raw types; the last hours are not ingested yet, and one whole class never landed."""
    raw = t.read(spark, sf_dir, "events")
    emitted = fw.emitted_counts(raw, F.col("event_type"), _EVENT_TYPES)
    events = t.events(spark, sf_dir)
    arrived = events.filter(F.col("time_us") < INGESTED_TO_US)
    ingested = fw.hop_counts(arrived, "ingested")
    landed = fw.hop_counts(arrived.filter(F.col("class_uid") != 6003), "landed")
    return emitted, ingested, landed


@query("emitted_counts", sql("ev", "SELECT class_uid, count(*) AS n FROM ev GROUP BY class_uid"))
def _emitted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir)[0]


@query(
    "hop_counts",
    sql("ev", f"""
SELECT 'ingested' AS hop, class_uid, count(*) AS n FROM ev WHERE time_us < {INGESTED_TO_US} GROUP BY class_uid
UNION ALL SELECT 'landed', class_uid, count(*) FROM ev WHERE time_us < {INGESTED_TO_US} AND class_uid <> 6003
GROUP BY 2"""),
)
def _hop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ingested, landed = _hops(spark, sf_dir)
    return ingested.unionByName(landed)


_RECONCILED = f"""
SELECT class_uid, emitted, ingested, landed, emitted - landed AS n_dropped,
  round((emitted - landed) / emitted, 4) AS drop_frac,
  CASE WHEN emitted - landed > emitted * 0.01 THEN 'fail' ELSE 'pass' END AS status
FROM (SELECT class_uid, count(*) AS emitted, count(*) FILTER (time_us < {INGESTED_TO_US}) AS ingested,
  count(*) FILTER (time_us < {INGESTED_TO_US} AND class_uid <> 6003) AS landed FROM ev GROUP BY class_uid)"""


@query("flow_reconcile", sql("ev", _RECONCILED))
def _flow_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fw.flow_reconcile(*_hops(spark, sf_dir), tolerance=0.01)


@query(
    "flow_status",
    sql("ev", f"SELECT 'fail' AS status, max(drop_frac) AS worst_drop, count(*) AS n_classes FROM ({_RECONCILED})"),
)
def _flow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fw.flow_status(fw.flow_reconcile(*_hops(spark, sf_dir), tolerance=0.01))


@query(
    "flow_gate",
    sql("ev", f"""
SELECT class_uid, emitted, landed, emitted - landed AS vanished, CASE WHEN emitted = landed THEN 'ok' ELSE 'DROP' END
  AS status FROM (SELECT class_uid, count(*) AS emitted,
  count(*) FILTER (time_us < {INGESTED_TO_US} AND class_uid <> 6003) AS landed FROM ev GROUP BY class_uid)"""),
)
def _flow_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    emitted, _, landed = _hops(spark, sf_dir)
    return fw.flow_gate(emitted, landed)


@query(
    "scrape_counters",
    """
WITH r AS (SELECT event_type AS host, event_id, event_id % 6 AS series, CAST(floor(value) AS BIGINT) AS v FROM events),
g AS (SELECT host, series, v - CASE WHEN v >= lag(v) OVER w THEN lag(v) OVER w ELSE 0 END AS step FROM r
  WINDOW w AS (PARTITION BY host, series ORDER BY event_id))
SELECT host,
  CAST(sum(CASE WHEN series = 0 THEN step ELSE 0 END) AS BIGINT) AS events_in,
  CAST(sum(CASE WHEN series = 2 THEN step ELSE 0 END) AS BIGINT) AS events_out,
  CAST(sum(CASE WHEN series = 4 THEN step ELSE 0 END) AS BIGINT) AS errors
FROM g WHERE series IN (0, 1, 2, 4) GROUP BY host""",
)
def _scrape_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics pages captured again and again from many hosts, with restarts, plumbing, comments and other series."""
    n, v = F.col("event_id"), F.floor("value").cast("string")

    def series(name: str, kind: str, component: str) -> Column:
        head = f'{name}{{component_id="c",component_kind="{kind}",component_type="{component}"}} '
        return F.concat(F.lit(head), v, F.lit(" 1704067200000"))

    line = (
        F.when(n % 6 == 0, series("vector_component_received_events_total", "source", "file"))
        .when(n % 6 == 1, series("vector_component_received_events_total", "transform", "remap"))
        .when(n % 6 == 2, series("vector_component_sent_events_total", "sink", "console"))
        .when(n % 6 == 3, series("vector_component_sent_events_total", "sink", "prometheus_exporter"))
        .when(n % 6 == 4, series("vector_component_errors_total", "transform", "remap"))
        .otherwise(F.concat(F.lit("# HELP vector_uptime_seconds "), v))
    )
    lines = t.read(spark, sf_dir, "events").select(F.col("event_type").alias("host"), "event_id", line.alias("value"))
    return fw.scrape_counters(lines, by=("host",), at="event_id")


# -- mapping lint

_TYPES = """
, typed AS (SELECT source_field, ocsf_path, s.a AS source_type, p.a AS target_type FROM mp
  LEFT JOIN (VALUES ('username', 'UserAccount'), ('process_name', 'Process'), ('image', 'File'),
    ('src_ip', 'NetworkNode'), ('dst_ip', 'NetworkNode'), ('group', 'UserGroup'), ('url', 'URL'),
    ('file_path', 'File'), ('sessionid', 'NetworkSession'), ('service', 'ServiceApplication'),
    ('real_user', 'UserAccount'), ('Host.Name', 'NetworkNode')) AS s(f, a) ON s.f = source_field
  LEFT JOIN (VALUES ('actor.user.name', 'UserAccount'), ('process.name', 'Process'), ('process.file.path', 'File'),
    ('src_endpoint.ip', 'NetworkNode'), ('dst_endpoint.ip', 'NetworkNode'), ('actor.group.name', 'UserGroup'),
    ('url', 'URL'), ('connection_info.uid', 'NetworkSession'), ('session.uid', 'Session'),
    ('src.port', 'NetworkNode')) AS p(f, a) ON p.f = ocsf_path),
linted AS (SELECT *, CASE WHEN source_type IS NULL OR target_type IS NULL THEN 'untestable'
    WHEN source_type <> target_type AND target_type <> 'Session' THEN 'crossing' ELSE 'ok' END AS status FROM typed)"""


def _lint_sql(body: str) -> str:
    return sql("mp", _TYPES + body)


@query(
    "mapping_type_lint",
    _lint_sql("""
SELECT source_field, ocsf_path, source_type, target_type, status, count(*) AS n FROM linted GROUP BY ALL"""),
)
def _mapping_type_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.mapping_type_lint(ml.distinct_mappings(t.mappings(spark, sf_dir)))


@query(
    "mapping_lint_summary",
    _lint_sql("""
SELECT count(*) AS n_checked, count(*) FILTER (status <> 'untestable') AS n_testable,
  count(*) FILTER (status = 'crossing') AS n_crossing, 'fail' AS status FROM linted"""),
)
def _mapping_lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.lint_summary(ml.mapping_type_lint(ml.distinct_mappings(t.mappings(spark, sf_dir))))


@query(
    "subclass_closure",
    """
WITH RECURSIVE pairs AS (SELECT p_partkey AS a,
  CASE WHEN p_partkey % 30 <> 0 THEN p_partkey - 1 WHEN p_partkey % 150 = 0 THEN p_partkey + 29 ELSE p_partkey - 30 END AS b
  FROM part WHERE p_partkey % 30 <> 0 OR p_partkey % 60 <> 30),
closed AS (SELECT a, b FROM pairs UNION SELECT c.a, p.b FROM closed c JOIN pairs p ON c.b = p.a)
SELECT a AS artifact, count(*) AS n_ancestors, CAST(sum(b) AS BIGINT) AS checksum, bool_or(a = b) AS in_cycle FROM closed GROUP BY a""",
)
def _subclass_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hierarchy over the parts: chains of 30 that lead on to others, some of which end in a cycle."""
    k = F.col("p_partkey")
    parent = F.when(k % 30 != 0, k - 1).when(k % 150 == 0, k + 29).otherwise(k - 30)
    parts = t.read(spark, sf_dir, "part").filter((k % 30 != 0) | (k % 60 != 30))
    closed = ml.transitive_closure(parts.select(k.alias("artifact"), parent.alias("ancestor")))
    return closed.groupBy("artifact").agg(
        F.count(F.lit(1)).alias("n_ancestors"),
        F.sum("ancestor").alias("checksum"),
        F.bool_or(F.col("artifact") == F.col("ancestor")).alias("in_cycle"),
    )


@query(
    "disjointness_selfcheck",
    _lint_sql("""
SELECT target_type AS artifact, count(*) AS n_mappings, FALSE AS impossible FROM linted
WHERE target_type IS NOT NULL GROUP BY target_type"""),
)
def _disjointness_selfcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artifact met in the mappings, and whether the disjoint set makes it impossible."""
    typed = t.mappings(spark, sf_dir).select(ml.ground_path(F.col("ocsf_path")).alias("artifact"))
    met = typed.filter(F.col("artifact").isNotNull()).groupBy("artifact").agg(F.count(F.lit(1)).alias("n_mappings"))
    broken = F.broadcast(ml.disjointness_selfcheck(spark).withColumn("hit", F.lit(True)))
    joined = met.join(broken, "artifact", "left")
    return joined.select("artifact", "n_mappings", F.coalesce("hit", F.lit(False)).alias("impossible"))
