from __future__ import annotations

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from siftlake.operators import coverage as cv
from siftlake.operators import metrics as mt
from siftlake.operators.normalize import lead_technique, technique_bridge

CORPUS = (
    "off_tech_id string, d3fend_id string, def_tech string, phase string, tactic string, band string, "
    "shared_artifacts int, shared_artifact_names string, trust double"
)
NOW = "2026-06-30T00:00:00Z"


@pytest.fixture()
def corpus(make):
    return make(
        CORPUS,
        [
            ("T1071", "D3-A", "Watch", "Detect", "Detect", "detect", 2, "Network Traffic|Firmware", 0.25),
            ("T1071", "D3-B", "`Look`", "Detect", "Detect", "detect", 1, "Credential|Network Flow", 0.9),
            ("T1071", "D3-C", "Harden", "Harden", "Harden", "harden", 1, "Process", 0.25),
            ("T1048", "D3-C", "Harden", "Harden", "Harden", "harden", 1, "Process", 0.25),
            ("T1490", "", "", "", "", "zero_defense", 0, "", 0.0),
            ("_meta", "", "", "", "", "_meta", 0, "", 0.0),
        ],
    )


def techniques(make, *names):
    return make("technique string", [(n,) for n in names])


def test_defenses_or_a_reason(make, corpus):
    rows = as_dicts(cv.defenses_for(techniques(make, "T1071", "T1048", "T1490", "T1530"), corpus))
    got = {(r["technique"], r["d3fend_id"], r["reason"]) for r in rows}
    assert got == {
        ("T1071", "D3-A", None),
        ("T1071", "D3-B", None),
        ("T1490", None, cv.ZERO_DEFENSE),
        ("T1530", None, cv.NOT_IN_CORPUS),
    }
    assert {r["trust"] for r in rows if r["d3fend_id"]} == {0.25}
    assert {r["def_tech"] for r in rows if r["d3fend_id"]} == {"Watch", "Look"}


def test_required_classes(make, corpus):
    rows = {r["off_tech_id"]: r["required_classes"] for r in cv.required_ocsf_classes(corpus, "off_tech_id").collect()}
    assert rows == {"T1071": [1007, 3002, 4001], "T1048": [1007], "T1490": [], "_meta": []}


def test_trust(make):
    df = make("q string", [("measured",), ("hearsay",), ("artifact_cooccurrence",), ("unmapped",)])
    got = [r[0] for r in df.select(cv.trust_of(F.col("q"))).collect()]
    assert got == [1.0, 0.30, 0.25, 0.0]
    edges = make("k string, trust double", [("a", 0.7), ("a", 0.25), ("b", None)])
    assert {r["k"]: r["weakest_trust"] for r in cv.weakest_trust(edges, "k").collect()} == {"a": 0.25, "b": 0.0}


@pytest.fixture()
def status(make, corpus):
    inventory = make(
        "technique string, tactic string, class_uid int, has_detection boolean",
        [
            ("T1071", "c2", 4001, True),
            ("T1048", "exfil", 4001, True),
            ("T1490", "impact", 1007, True),
            ("T1530", "collection", 6003, True),
            ("T9999", "none", 4001, False),
        ],
    )
    by_class = make("class_uid int, n bigint", [(4001, 10), (6003, 0)])
    fired = make("technique string, n_findings bigint", [("T1071", 2), ("T1048", 0), ("T9999", 3)])
    return cv.coverage_status(inventory, by_class, fired, corpus)


def test_status_ladder(status):
    got = {r["technique"]: r for r in status.collect()}
    assert {t: r["status"] for t, r in got.items()} == {
        "T1071": "fired", "T1048": "covered", "T1490": "dark_spot", "T1530": "dark_spot", "T9999": "blind",
    }
    assert {t: r["weakest_trust"] for t, r in got.items()} == {
        "T1071": 0.25, "T1048": 0.70, "T1490": 0.70, "T1530": 0.0, "T9999": 0.0,
    }
    assert got["T1071"]["required_classes"] == [3002, 4001] and got["T1071"]["inferred_edges"] == 2
    assert as_dicts(cv.coverage_summary(status)) == [
        {"fired": 1, "covered": 1, "dark_spot": 2, "blind": 1, "total": 5, "in_corpus": 3, "zero_defense": 1}
    ]


def test_recommendation_is_for_dark_spots_only(status, corpus):
    rows = {r["technique"]: r["degrade"] for r in cv.dark_spot_recommendation(status, corpus).collect()}
    assert rows == {"T1490": cv.ZERO_DEFENSE, "T1530": cv.NOT_IN_CORPUS}


def test_recommendation_lists_leads_and_classes(make, corpus):
    inventory = make("technique string, tactic string, class_uid int, has_detection boolean", [("T1071", "c2", 4001, True)])
    nothing = make("class_uid int, n bigint", [])
    dark = cv.coverage_status(inventory, nothing, make("technique string, n_findings bigint", []), corpus)
    rows = cv.dark_spot_recommendation(dark, corpus).orderBy("d3fend_id").collect()
    assert [(r["d3fend_id"], r["classes_to_land"], r["degrade"]) for r in rows] == [
        ("D3-A", [3002, 4001], None),
        ("D3-B", [3002, 4001], None),
    ]


VERDICTS = [("T1071", "DETECTED", 1.0, 3), ("T1048", "MISSED", 0.0, 0), ("T1490", "MISSED", 0.0, 0), ("T1530", "ODD", 0.1, 1)]


@pytest.mark.parametrize("stamp", ["2026-05-30T23:59:59Z", None, "2026-06-15", "2026-07-01T00:00:00Z", "2026-06-15T00:00:00"])
def test_stale_import_measures_nothing(status, make, stamp):
    measured = make("att_ck string, state string, precision double, matches bigint", VERDICTS)
    overlay = cv.measured_overlay(status, measured, stamp, NOW)
    assert {r["reconciliation"] for r in overlay.collect()} == {"not_measured"}
    assert {r["import_stale"] for r in overlay.collect()} == {True}


def test_overlay_and_gaps(status, make, corpus):
    measured = make("att_ck string, state string, precision double, matches bigint", VERDICTS)
    overlay = cv.measured_overlay(status, measured, "2026-06-15T00:00:00+00:00", NOW)
    assert {r["technique"]: r["reconciliation"] for r in overlay.collect()} == {
        "T1071": "confirmed_fired",
        "T1048": "predicted_covered_but_missed",
        "T1490": "predicted_covered_but_missed",
        "T1530": "not_measured",
        "T9999": "not_measured",
    }
    assert as_dicts(cv.overlay_summary(overlay)) == [
        {"confirmed_fired": 1, "predicted_covered_but_missed": 2, "fired_but_noisy": 0, "not_measured": 2,
         "measured_only": 0, "total": 5}
    ]
    gaps = cv.gap_countermeasures(overlay, corpus)
    assert {r["technique"]: r["degrade"] for r in gaps.collect()} == {"T1048": cv.NO_LEAD, "T1490": cv.ZERO_DEFENSE}
    assert as_dicts(cv.gap_summary(gaps)) == [{"measured_fn": 2, "with_lead": 0, "honest_degrade": 2}]


def test_counters_and_covered(make):
    monitors = make("defense string, artifact string", [("d1", "a"), ("d1", "a"), ("d1", "b"), ("d2", "c")])
    produces = make("offense string, artifact string", [("o1", "a"), ("o1", "b"), ("o1", "a"), ("o2", "z"), ("o3", "c")])
    got = {tuple(r) for r in cv.derive_counters(monitors, produces).collect()}
    assert got == {("d1", "o1", 2), ("d2", "o3", 1)}
    assert {r[0] for r in cv.covered_techniques(produces, monitors).collect()} == {"o1", "o3"}


def test_lead_technique_and_bridge(make):
    df = make("k int, tags array<string>", [(1, ["T1", "T2", "T1"]), (2, []), (3, None)])
    assert [r[0] for r in df.orderBy("k").select(lead_technique(F.col("tags"))).collect()] == ["T1", None, None]
    assert {tuple(r) for r in technique_bridge(df, "k", "tags").collect()} == {(1, "T1"), (1, "T2")}


@pytest.fixture()
def datasets(make):
    ts = "2026-01-01 {:02d}:00:00"
    finding = make(
        "finding_uid string, event_time string, first_seen_time string, verdict string, technique_id string, rule_uid string",
        [
            ("f1", ts.format(5), ts.format(4), "False Positive", "T1", "r1"),
            ("f2", ts.format(5), ts.format(2), None, "T2", "r9"),
            ("f3", ts.format(5), None, "True Positive", None, None),
        ],
    )
    for c in ("event_time", "first_seen_time"):
        finding = finding.withColumn(c, F.to_timestamp(c))
    return {
        "detection_finding": finding,
        "authentication": make("event_time bigint, status_id int", [(1, 2), (2, 1), (3, None), (None, 2)]),
        "sigma_rule": make("rule_uid string, technique_id string", [("r1", "T1"), ("r2", "T1"), ("r3", None)]),
        "attack_technique": make("technique_id string", [("T1",), ("T2",), ("T3",), ("T4",)]),
        "atlas_technique": make(
            "atlas_id string, maturity string, attack_technique_id string",
            [("A1", "Realized", "T1"), ("A2", "Feasible", None), ("A3", "Realized", None)],
        ),
        "d3fend_technique": make("d3fend_id string", [("D1",)]),
        "technique_defense": make(
            "attack_technique_id string, d3fend_id string, d3fend_tactic string",
            [("T1", "D1", "Detect"), ("T1", "D2", "Detect"), ("T2", "D1", "Harden")],
        ),
        "technique_class_map": make("attack_technique_id string, ocsf_class_uid int", [("T1", 4001), ("T1", 3002)]),
    }


def test_metrics(datasets):
    got = {name: metric(datasets).first()[0] for name, metric in mt.METRICS.items()}
    assert got == {
        "alert_volume": 3,
        "false_positive_rate": pytest.approx(1 / 3),
        "mean_time_to_detect_hours": 2.0,
        "techniques_with_detection_content": 1,
        "detection_content_coverage_rate": 0.25,
        "detect_phase_coverage_rate": 0.25,
        "detection_blind_technique_count": 3,
        "telemetry_reachable_technique_rate": 0.25,
        "atlas_realized_technique_count": 2,
        "atlas_attack_bridge_rate": pytest.approx(1 / 3),
        "failed_authentication_rate": pytest.approx(2 / 3),
    }
    assert len(mt.METRICS) == 11


def test_empty_datasets_give_null_not_a_crash(datasets):
    empty = {name: df.limit(0) for name, df in datasets.items()}
    assert mt.false_positive_rate(empty).first()[0] is None
    assert mt.detect_phase_coverage_rate(empty).first()[0] is None


def test_semantic_joins(datasets):
    got = {r["relationship"]: (r["n_rows"], r["n_linked"]) for r in mt.semantic_joins(datasets).collect()}
    assert got["finding_to_rule"] == (3, 1)
    assert got["defense_bridge_to_d3fend"] == (3, 2)
    assert got["atlas_to_attack"] == (3, 1)
    rows = mt.semantic_join(datasets, "finding_to_rule")
    assert {r["finding_uid"]: r["to_rule_uid"] for r in rows.collect()} == {"f1": "r1", "f2": None, "f3": None}


def test_blind_techniques(datasets):
    blind = cv.blind_techniques(datasets["attack_technique"], datasets["technique_defense"])
    assert {r[0] for r in blind.collect()} == {"T2", "T3", "T4"}
