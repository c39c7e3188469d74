"""Technique coverage, measured overlay and the metric layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import coverage as cv
from siftlake.operators import metrics as mt
from siftlake.plans import tables as t
from siftlake.plans.catalog import query
from siftlake.plans.tables import sql

VALIDATED_AT = "2024-01-20T00:00:00+00:00"
NOW = "2024-01-31T00:00:00Z"

_CLASS_OF = "(VALUES " + ", ".join(f"('{label}', {uid})" for label, uid in cv.ARTIFACT_CLASS.items()) + ")"

_MEMBER = f"""
, member AS (SELECT te.technique, coalesce(bool_or(band NOT IN ('zero_defense', '_meta')), FALSE)
    OR coalesce(bool_or(band = 'zero_defense'), FALSE) AS in_corpus,
  coalesce(bool_or(band = 'zero_defense'), FALSE) AS is_zero_defense
  FROM te LEFT JOIN co ON off_tech_id = technique GROUP BY te.technique),
leads AS (SELECT m.technique, d3fend_id, def_tech, phase, tactic, shared_artifact_names, shared_artifacts,
  'artifact_cooccurrence' AS proxy_quality, 0.25 AS trust, CAST(NULL AS VARCHAR) AS reason
  FROM member AS m JOIN co ON off_tech_id = m.technique AND band = 'detect'
  WHERE in_corpus AND NOT is_zero_defense
  UNION ALL SELECT technique, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    CASE WHEN NOT in_corpus THEN '{cv.NOT_IN_CORPUS}' ELSE '{cv.ZERO_DEFENSE}' END
  FROM member WHERE NOT in_corpus OR is_zero_defense),
classes AS (SELECT technique, list_sort(list(DISTINCT uid) FILTER (uid IS NOT NULL)) AS uids FROM
  (SELECT technique, unnest(string_split(shared_artifact_names, '|')) AS label FROM leads WHERE reason IS NULL) AS x
  LEFT JOIN {_CLASS_OF} AS c(l, uid) ON c.l = trim(x.label) GROUP BY technique),
curated AS (SELECT * FROM (VALUES ('T1071', 0.7), ('T1048', 0.7), ('T1110', 0.7), ('T1490', 0.7), ('T1003.001', 0.7))
  AS v(technique, trust)),
status AS (SELECT te.technique, te.tactic, te.class_uid, l.class_uid IS NOT NULL AS visible,
  coalesce(fi.n_findings > 0, FALSE) AS fired,
  CASE WHEN NOT has_detection THEN 'blind' WHEN l.class_uid IS NULL THEN 'dark_spot'
    WHEN coalesce(fi.n_findings > 0, FALSE) THEN 'fired' ELSE 'covered' END AS status, in_corpus, is_zero_defense,
  coalesce(array_to_string(uids, ','), '') AS required_classes, coalesce(e.n, 0) AS inferred_edges,
  coalesce(least(CASE WHEN e.n > 0 THEN 0.25 END, curated.trust), 0.0)::DOUBLE AS weakest_trust
  FROM te LEFT JOIN (SELECT DISTINCT class_uid FROM oc) AS l ON l.class_uid = te.class_uid
  LEFT JOIN fi ON fi.technique = te.technique JOIN member AS m ON m.technique = te.technique
  LEFT JOIN (SELECT technique, count(*) AS n FROM leads WHERE reason IS NULL GROUP BY 1) AS e
    ON e.technique = te.technique
  LEFT JOIN classes ON classes.technique = te.technique LEFT JOIN curated ON curated.technique = te.technique),
overlay AS (SELECT s.technique, s.status AS design_status, coalesce(ms.state, 'not_measured') AS measured_state,
  CASE ms.state WHEN 'DETECTED' THEN 'confirmed_fired' WHEN 'MISSED' THEN 'predicted_covered_but_missed'
    WHEN 'NOISY' THEN 'fired_but_noisy' ELSE 'not_measured' END AS reconciliation,
  precision::DOUBLE AS precision, matches, weakest_trust, FALSE AS import_stale
  FROM status AS s LEFT JOIN ms ON att_ck = s.technique)"""


def _cov_sql(body: str) -> str:
    return sql("te co oc fi ms", _MEMBER + body)


def _joined(names: str) -> Column:
    return F.array_join(F.col(names).cast("array<string>"), ",").alias(names)


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_class = t.ocsf(spark, sf_dir).groupBy("class_uid").agg(F.count(F.lit(1)).alias("n"))
    return cv.coverage_status(
        t.techniques(spark, sf_dir), by_class, t.fired(spark, sf_dir), t.corpus(spark, sf_dir)
    )


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.measured_overlay(_status(spark, sf_dir), t.measured(spark, sf_dir), VALIDATED_AT, NOW)


@query(
    "derive_counters",
    sql("mo po", """
SELECT defense, offense, count(DISTINCT artifact) AS shared_artifacts FROM mo JOIN po USING (artifact) GROUP BY 1, 2"""),
)
def _derive_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.derive_counters(t.monitors(spark, sf_dir), t.produces(spark, sf_dir))


@query("covered_techniques", sql("mo po", "SELECT DISTINCT offense FROM po WHERE artifact IN (SELECT artifact FROM mo)"))
def _covered_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.covered_techniques(t.produces(spark, sf_dir), t.monitors(spark, sf_dir))


@query(
    "blind_techniques",
    sql("tech bridge", """
SELECT technique_id FROM tech EXCEPT SELECT attack_technique_id FROM bridge WHERE d3fend_tactic = 'Detect'"""),
)
def _blind_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = t.semantic(spark, sf_dir)
    return cv.blind_techniques(data["attack_technique"], data["technique_defense"])


@query("corpus_membership", _cov_sql("SELECT technique, in_corpus, is_zero_defense FROM member"))
def _corpus_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.corpus_membership(t.techniques(spark, sf_dir), t.corpus(spark, sf_dir))


@query("defenses_for", _cov_sql("SELECT * REPLACE (CAST(trust AS DOUBLE) AS trust) FROM leads"))
def _defenses_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.defenses_for(t.techniques(spark, sf_dir), t.corpus(spark, sf_dir))


@query(
    "curated_defense_for",
    sql("te", "SELECT te.technique, c.d3fend_id, c.def_tech, c.trust::DOUBLE AS trust FROM te LEFT JOIN (VALUES "
        + ", ".join(f"('{a}', '{b}', '{c}', 0.7)" for a, b, c in cv.CURATED)
        + ") AS c(technique, d3fend_id, def_tech, trust) ON c.technique = te.technique"),
)
def _curated_defense_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.curated_defense_for(t.techniques(spark, sf_dir))


@query(
    "required_ocsf_classes",
    sql("co", f"""
SELECT off_tech_id, coalesce(array_to_string(list_sort(list(DISTINCT uid) FILTER (uid IS NOT NULL)), ','), '')
  AS required_classes
FROM (SELECT off_tech_id, unnest(string_split(shared_artifact_names, '|')) AS label FROM co) AS x
LEFT JOIN {_CLASS_OF} AS c(l, uid) ON c.l = trim(x.label) GROUP BY off_tech_id"""),
)
def _required_ocsf_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = cv.required_ocsf_classes(t.corpus(spark, sf_dir), "off_tech_id")
    return classes.select("off_tech_id", _joined("required_classes"))


@query(
    "weakest_trust",
    sql("co", """
, e AS (SELECT off_tech_id AS technique, CASE band WHEN 'zero_defense' THEN NULL WHEN 'detect' THEN 0.25
  WHEN 'harden' THEN 0.7 WHEN 'isolate' THEN 0.85 WHEN 'model' THEN 1.0 ELSE 0.3 END AS trust FROM co)
SELECT technique, coalesce(min(trust), 0.0)::DOUBLE AS weakest_trust FROM e GROUP BY technique"""),
)
def _weakest_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.col("band")
    quality = (
        F.when(band == "detect", "artifact_cooccurrence")
        .when(band == "harden", "ontology_curated")
        .when(band == "isolate", "ontology_axiom")
        .when(band == "model", "measured")
        .otherwise("hearsay")
    )
    edges = t.corpus(spark, sf_dir).select(
        F.col("off_tech_id").alias("technique"),
        F.when(band != "zero_defense", cv.trust_of(quality)).alias("trust"),
    )
    return cv.weakest_trust(edges, "technique")


@query("coverage_status", _cov_sql("SELECT * FROM status"))
def _coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _status(spark, sf_dir)
    return status.select(*[_joined(c) if c == "required_classes" else F.col(c) for c in status.columns])


def _buckets(column: str, names: tuple[str, ...]) -> str:
    return ", ".join(f"count(*) FILTER ({column} = '{n}') AS {n}" for n in names)


@query(
    "coverage_summary",
    _cov_sql(f"""
SELECT {_buckets("status", cv.COVERAGE_BUCKETS)}, count(*) AS total, count(*) FILTER (in_corpus) AS in_corpus,
  count(*) FILTER (is_zero_defense) AS zero_defense FROM status"""),
)
def _coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.coverage_summary(_status(spark, sf_dir))


@query(
    "dark_spot_recommendation",
    _cov_sql(f"""
SELECT s.technique, s.tactic, s.class_uid, s.required_classes AS classes_to_land, l.d3fend_id, l.def_tech, l.phase,
  l.shared_artifact_names, l.trust::DOUBLE AS trust,
  CASE WHEN l.d3fend_id IS NULL THEN coalesce(l.reason, '{cv.NO_LEAD}') END AS degrade
FROM status AS s LEFT JOIN leads AS l ON l.technique = s.technique WHERE s.status = 'dark_spot'"""),
)
def _dark_spot_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cv.dark_spot_recommendation(_status(spark, sf_dir), t.corpus(spark, sf_dir))
    return out.select(*[_joined(c) if c == "classes_to_land" else F.col(c) for c in out.columns])


@query("measured_overlay", _cov_sql("SELECT * FROM overlay"))
def _measured_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlay(spark, sf_dir)


@query(
    "overlay_summary",
    _cov_sql(f"SELECT {_buckets('reconciliation', cv.OVERLAY_BUCKETS)}, count(*) AS total FROM overlay"),
)
def _overlay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.overlay_summary(_overlay(spark, sf_dir))


@query("import_stale", sql("ms", "SELECT state, TRUE AS too_old, TRUE AS undated, FALSE AS fresh, count(*) AS n FROM ms GROUP BY 1"))
def _import_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.measured(spark, sf_dir).groupBy(
        "state",
        cv.import_stale("2023-12-01T00:00:00Z", NOW).alias("too_old"),
        cv.import_stale(None, NOW).alias("undated"),
        cv.import_stale(VALIDATED_AT, NOW).alias("fresh"),
    ).agg(F.count(F.lit(1)).alias("n"))


_GAPS = f"""
, gaps AS (SELECT o.technique, l.d3fend_id, l.def_tech, l.phase, l.shared_artifact_names, l.trust::DOUBLE AS trust,
  CASE WHEN l.d3fend_id IS NULL THEN coalesce(l.reason, '{cv.NO_LEAD}') END AS degrade,
  coalesce(array_to_string(c.uids, ','), '') AS ocsf_classes_to_land
  FROM overlay AS o LEFT JOIN leads AS l ON l.technique = o.technique LEFT JOIN classes AS c ON c.technique = o.technique
  WHERE o.reconciliation = 'predicted_covered_but_missed')"""


@query("gap_countermeasures", _cov_sql(_GAPS + "SELECT * FROM gaps"))
def _gap_countermeasures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cv.gap_countermeasures(_overlay(spark, sf_dir), t.corpus(spark, sf_dir))
    return out.select(*[_joined(c) if c == "ocsf_classes_to_land" else F.col(c) for c in out.columns])


@query(
    "gap_summary",
    _cov_sql(_GAPS + """
SELECT count(*) AS measured_fn, count(*) FILTER (n > 0) AS with_lead, count(*) FILTER (n = 0) AS honest_degrade
FROM (SELECT technique, count(d3fend_id) AS n FROM gaps GROUP BY technique)"""),
)
def _gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.gap_summary(cv.gap_countermeasures(_overlay(spark, sf_dir), t.corpus(spark, sf_dir)))


# -- metric layer

_LINKS = (
    ("finding_to_technique", "finding", "technique_id", "tech", "technique_id"),
    ("finding_to_rule", "finding", "rule_uid", "rule", "rule_uid"),
    ("rule_to_technique", "rule", "technique_id", "tech", "technique_id"),
    ("atlas_to_attack", "atlas", "attack_technique_id", "tech", "technique_id"),
    ("defense_bridge_to_attack", "bridge", "attack_technique_id", "tech", "technique_id"),
    ("defense_bridge_to_d3fend", "bridge", "d3fend_id", "d3", "d3fend_id"),
    ("class_map_to_attack", "cmap", "attack_technique_id", "tech", "technique_id"),
)
_ALL_SETS = "finding rule tech atlas bridge d3 cmap auth"


@query("semantic_joins", sql(_ALL_SETS, " UNION ALL ".join(
    f"SELECT '{name}' AS relationship, count(*) AS n_rows, "
    f"count(*) FILTER ({a}.{ca} IN (SELECT {cb} FROM {b})) AS n_linked FROM {a}"
    for name, a, ca, b, cb in _LINKS
)))
def _semantic_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.semantic_joins(t.semantic(spark, sf_dir))


@query(
    "semantic_join_rows",
    sql("finding rule", """
SELECT f.rule_uid, r.technique_id AS rule_technique, count(*) AS n FROM finding AS f
LEFT JOIN rule AS r ON r.rule_uid = f.rule_uid GROUP BY 1, 2"""),
)
def _semantic_join_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = mt.semantic_join(t.semantic(spark, sf_dir), "finding_to_rule")
    return joined.groupBy("rule_uid", F.col("to_technique_id").alias("rule_technique")).agg(
        F.count(F.lit(1)).alias("n")
    )


_N_TECH = "nullif((SELECT count(DISTINCT technique_id) FROM tech), 0)"
_METRIC_SQL = {
    "alert_volume": "SELECT count(finding_uid) AS {m} FROM finding",
    "false_positive_rate": "SELECT sum(CASE WHEN verdict = 'False Positive' THEN 1 ELSE 0 END)::DOUBLE "
    "/ nullif(count(finding_uid), 0) AS {m} FROM finding",
    "mean_time_to_detect_hours": "SELECT round(avg(date_diff('second', first_seen_time, event_time) "
    "/ 3600.0::DOUBLE), 6) AS {m} FROM finding",
    "techniques_with_detection_content": "SELECT count(DISTINCT technique_id) AS {m} FROM rule",
    "detection_content_coverage_rate": f"SELECT count(DISTINCT technique_id)::DOUBLE / {_N_TECH} AS {{m}} FROM rule",
    "detect_phase_coverage_rate": "SELECT count(DISTINCT attack_technique_id) FILTER (d3fend_tactic = 'Detect')::DOUBLE "
    f"/ {_N_TECH} AS {{m}} FROM bridge",
    "detection_blind_technique_count": f"SELECT {_N_TECH} - count(DISTINCT attack_technique_id) "
    "FILTER (d3fend_tactic = 'Detect') AS {m} FROM bridge",
    "telemetry_reachable_technique_rate": "SELECT count(DISTINCT attack_technique_id)::DOUBLE "
    f"/ {_N_TECH} AS {{m}} FROM cmap",
    "atlas_realized_technique_count": "SELECT count(*) FILTER (maturity = 'Realized') AS {m} FROM atlas",
    "atlas_attack_bridge_rate": "SELECT count(DISTINCT atlas_id) FILTER (attack_technique_id IS NOT NULL)::DOUBLE "
    "/ nullif(count(DISTINCT atlas_id), 0) AS {m} FROM atlas",
    "failed_authentication_rate": "SELECT sum(CASE WHEN status_id = 2 THEN 1 ELSE 0 END)::DOUBLE "
    "/ nullif(count(event_time), 0) AS {m} FROM auth",
}


def _metric(name: str) -> None:
    @query(name, sql(_ALL_SETS, _METRIC_SQL[name].format(m=name)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = mt.METRICS[name](t.semantic(spark, sf_dir))
        if name == "mean_time_to_detect_hours":
            return value.select(F.round(name, 6).alias(name))
        return value


for _name in mt.METRICS:
    _metric(_name)
