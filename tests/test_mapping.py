from __future__ import annotations

import json
import random

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from siftlake.operators import crosswalk as cw
from siftlake.operators import flow as fw
from siftlake.operators import mapping_lint as ml
from siftlake.operators import normalize as nz
from siftlake.operators import roundtrip as rt
from siftlake.operators.detections import detect_bruteforce
from siftlake.operators.predicates import (
    mfa_state,
    mfa_unprotected_naive,
    mfa_unprotected_null_safe,
    mfa_unprotected_structural,
)
from siftlake.sources import readers as rd
from siftlake.sources.sinks import land_replace


def okta_line(second: int, result: str, user: str, ip: str) -> str:
    return json.dumps(
        {
            "published": f"2026-03-01T00:00:{second:02d}Z",
            "eventType": "user.session.start",
            "outcome": {"result": result},
            "actor": {"alternateId": user},
            "client": {"ipAddress": ip},
        }
    )


OKTA = [okta_line(1, "SUCCESS", "ann@acme.example", "10.9.0.1"), okta_line(2, "FAILURE", "bo@acme.example", "10.9.0.2")]
OKTA += [okta_line(10 + i, "FAILURE", "eve@acme.example", "198.51.100.77") for i in range(6)]


@pytest.fixture()
def okta(spark, tmp_path):
    path = tmp_path / "okta.ndjson"
    path.write_text("\n".join([*OKTA, "", ""]))
    return rd.read_ndjson(spark, str(path), nz.OKTA_SCHEMA)


def test_promote_finds_only_the_planted_source(spark, okta, tmp_path):
    landed = land_replace(nz.normalize_okta(okta), str(tmp_path / "auth"))
    assert landed.count() == 8
    assert landed.filter("status = 'FAILURE'").count() == 7
    assert [tuple(r) for r in detect_bruteforce(landed).collect()] == [("198.51.100.77", 6)]


def test_land_replace_replaces(spark, okta, tmp_path):
    path = str(tmp_path / "auth")
    land_replace(nz.normalize_okta(okta), path)
    assert land_replace(nz.normalize_okta(okta), path).count() == 8


def test_okta_record(okta):
    first = as_dicts(nz.normalize_okta(okta).orderBy("time").limit(1))[0]
    assert first == {
        "time": 1772323201000, "class_uid": 3002, "class_name": "Authentication", "category_uid": 3, "activity_id": 1,
        "status_id": 1, "user": "ann@acme.example", "src_ip": "10.9.0.1", "status": "SUCCESS",
    }


ZEEK = """#separator \\x09
#path\tconn
#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\torig_bytes\tresp_bytes\tconn_state\torig_pkts\tresp_pkts
#types\ttime\tstring\taddr\tport\taddr\tport\tenum\tcount\tcount\tstring\tcount\tcount
1772323201.250\tCa\t10.9.1.1\t50000\t10.9.0.10\t443\ttcp\t520\t8400\tSF\t6\t10
1772323202.0\tCb\t10.9.1.2\t50001\t203.0.113.9\t53\tudp\t-\t-\tS0\t1\t0
1772323203.0\tCc\t10.9.1.3\t50002\t203.0.113.9\t3306\ticmp\t0\t0\tREJ\t1\t1
1772323204.0\tCd\t10.9.1.4\t50003\t203.0.113.9\t8080\tgre\t200\t0\tRSTO\t3\t1
1772323205.0\tCe\t10.9.1.5\t50004\t203.0.113.9\t8080\ttcp\t1\t2\tOTH\t3\t1
"""


@pytest.fixture()
def zeek(spark, tmp_path):
    path = tmp_path / "conn.log"
    path.write_text(ZEEK)
    return rd.read_zeek_tsv(spark, str(path))


def test_zeek_directions_states_and_protocols(zeek):
    rows = as_dicts(nz.normalize_zeek_conn(zeek).orderBy("time"))
    assert [(r["bytes_out"], r["bytes_in"]) for r in rows] == [(520, 8400), (None, None), (0, 0), (200, 0), (1, 2)]
    assert [r["activity_id"] for r in rows] == [2, 4, 5, 2, 6]
    assert [r["protocol_num"] for r in rows] == [6, 17, 1, None, 6]
    assert rows[0]["time"] == 1772323201250
    assert (rows[0]["src_ip"], rows[0]["src_port"], rows[0]["dst_ip"], rows[0]["dst_port"]) == (
        "10.9.1.1", 50000, "10.9.0.10", 443,
    )


def test_zeek_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a b.log").write_text("#fields\tts\tuid\torig_bytes\tresp_bytes\n1.0\tC\t10\t99\n")
    (tmp_path / "b.log").write_text("#fields\tuid\tts\tresp_bytes\torig_bytes\nD\t2.0\t98\t11\n")
    (tmp_path / "c.log").write_text("#fields\tts\tuid\n3.0\tE\n")
    rows = rd.read_zeek_tsv(spark, str(tmp_path)).select("ts", "uid", "orig_bytes", "resp_bytes").orderBy("ts").collect()
    assert [tuple(r) for r in rows] == [(1.0, "C", 10, 99), (2.0, "D", 11, 98), (3.0, "E", None, None)]


def test_zeek_file_needs_one_header(spark, tmp_path):
    (tmp_path / "a.log").write_text("#fields\tts\tuid\n1.0\tC\n#fields\tuid\tts\nC\t1.0\n")
    with pytest.raises(ValueError, match="different"):
        rd.read_zeek_tsv(spark, str(tmp_path))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.log").write_text("1.0\tC\n")
    (tmp_path / "c" / "y.log").write_text("#fields\tts\tuid\n1.0\tC\n")
    with pytest.raises(ValueError, match="no #fields"):
        rd.read_zeek_tsv(spark, str(tmp_path / "c"))


def test_broken_lines_are_no_logins(spark, tmp_path):
    good = json.dumps({"published": "2026-03-01T00:00:01Z", "eventType": "user.session.start",
                       "outcome": {"result": "SUCCESS"}, "actor": {"alternateId": "a"}, "client": {"ipAddress": "1.1.1.1"}})
    (tmp_path / "x.log").write_text("\n".join([good, good[:30], "junk", "", "[1]", "7", '{"outcome": 5}']))
    records, bad = rd.read_ndjson_checked(spark, str(tmp_path), nz.OKTA_SCHEMA)
    assert [r["status_id"] for r in nz.normalize_okta(records).collect()] == [1]
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["broken, or a value does not fit the schema"] * 2 + ["not a JSON object"] * 3
    assert rd.read_ndjson(spark, str(tmp_path), nz.OKTA_SCHEMA).count() == 1
    with pytest.raises(Exception, match="bad line"):
        rd.read_ndjson(spark, str(tmp_path), nz.OKTA_SCHEMA, strict=True).collect()


def test_sysmon_roles(make):
    image = "C:\\Windows\\System32\\cmd.exe"
    rows = [
        (1, "2026-03-01 00:10:00.123", image, 11, "cmd /c dir", "C:\\Windows\\explorer.exe", 7, "ACME\\ann", "WS-1"),
        (1, "2026-03-01 00:10:01.000", "/usr/bin/ls", 12, "ls", "/bin/sh", 8, "root", "WS-2"),
        (3, "2026-03-01 00:10:02.000", image, 13, "other", "x", 9, "y", "WS-3"),
    ]
    out = as_dicts(nz.normalize_sysmon(make(nz.SYSMON_SCHEMA, rows)).orderBy("time"))
    assert [r["process_name"] for r in out] == ["cmd.exe", "ls"]
    assert (out[0]["process_path"], out[0]["parent_path"], out[0]["user"]) == (image, rows[0][5], "ACME\\ann")
    assert (out[0]["process_pid"], out[0]["parent_pid"], out[0]["device_hostname"]) == (11, 7, "WS-1")
    assert out[0]["time"] == 1772323800123


CLOUD = [
    {"eventName": "ConsoleLogin", "responseElements": {"ConsoleLogin": "Success"}, "additionalEventData": {"MFAUsed": "Yes"}},
    {"eventName": "ConsoleLogin", "responseElements": {"ConsoleLogin": "Success"}, "additionalEventData": {}},
    {"eventName": "ConsoleLogin", "responseElements": {"ConsoleLogin": "Failure"}, "additionalEventData": {"MFAUsed": "No"}},
    {"eventName": "AttachUserPolicy"},
    {"eventName": "GetCallerIdentity", "errorCode": "AccessDenied"},
    {"eventName": "AssumeRole"},
]


def test_cloudtrail_routes_and_keeps_three_mfa_states(make):
    rows = [
        (i, json.dumps(e | {"eventTime": f"2026-03-01T01:0{i}:00Z", "userIdentity": {"userName": f"u{i}"}}))
        for i, e in enumerate(CLOUD)
    ]
    raw = make("event_key int, value string", rows).select("event_key", F.parse_json("value").alias("record"))
    out = as_dicts(nz.normalize_cloudtrail(raw, carry=("event_key",)).orderBy("event_key"))
    assert [r["class_uid"] for r in out] == [3002, 3002, 3002, 6003, 6003, 6003]
    assert [r["status_id"] for r in out] == [1, 1, 2, 1, 2, 1]
    assert [r["activity_id"] for r in out] == [1, 1, 1, 3, 2, 99]
    assert [(r["is_mfa"], r["is_mfa_present"]) for r in out[:3]] == [(True, True), (None, False), (False, True)]
    assert [r["user"] or r["actor_user"] for r in out] == [f"u{i}" for i in range(6)]


def test_mfa_absence_is_not_lost(make):
    def body(attributes: str) -> str:
        return '{"userIdentity":{"sessionContext":{"attributes":' + attributes + "}}}"

    bodies = [body('{"mfaAuthenticated":"true"}')] * 50 + [body('{"mfaAuthenticated":"false"}')] * 12
    bodies += [body("{}")] * 20 + [body('{"mfaAuthenticated":null}')] * 3
    df = make("body string", [(b,) for b in bodies]).withColumn("record", F.parse_json("body"))
    assert df.filter(mfa_unprotected_naive(F.col("body"))).count() == 12
    assert df.filter(mfa_unprotected_null_safe(F.col("body"))).count() == 35
    assert df.filter(mfa_unprotected_structural(F.col("record"))).count() == 35
    states = {r["s"]: r["count"] for r in df.groupBy(mfa_state(F.col("record")).alias("s")).count().collect()}
    assert states == {"present_true": 50, "present_false": 12, "absent": 20, "explicit_null": 3}


def test_tolerant_reader_quarantines(spark, tmp_path):
    path = tmp_path / "out.log"
    path.write_text('\x1b[32m{"class_uid":3002,"user":"a"}\x1b[0m\nstarting up\n\n{"class_uid":4001}\n{"broken\n{"x":1}\n[1]\n')
    records, quarantine = rd.read_ndjson_tolerant(spark, str(path))
    assert sorted(r["class_uid"] for r in records.collect()) == [3002, 4001]
    reasons = sorted((r["line"], r["reason"]) for r in quarantine.collect())
    assert reasons == [
        ("[1]", "not a JSON object"),
        ("starting up", "not a JSON object"),
        ('{"broken', "not a JSON object"),
        ('{"x":1}', "no class_uid"),
    ]


def test_mapping_csv_header_only_on_the_first_line(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("source_field,ocsf_path\nuser,actor.user.name\nsource,process.name\n")
    rows = {tuple(r) for r in rd.read_mapping_csv(spark, str(path)).collect()}
    assert rows == {("user", "actor.user.name"), ("source", "process.name")}
    path.write_text("user, actor.user.name\nlonely\n")
    assert [tuple(r) for r in rd.read_mapping_csv(spark, str(path)).collect()] == [("user", "actor.user.name")]


# -- round trip

FIELDS = ["class_uid", "status_id", "user", "src_ip", "status"]


def keyed(okta):
    return okta.withColumn("event_key", F.xxhash64("published", "client.ipAddress"))


def test_roundtrip_pass_and_faults(okta):
    raw = keyed(okta)
    expected = nz.okta_contract(raw, ("event_key",))
    produced = nz.normalize_okta(raw, ("event_key",))
    assert as_dicts(rt.roundtrip_validate(expected, produced, FIELDS))[0]["status"] == "pass"
    empty = as_dicts(rt.roundtrip_validate(expected, produced.limit(0), FIELDS))[0]
    assert (empty["status"], empty["n_unpaired"]) == ("unmeasured", 8)
    lost = produced.filter("status = 'FAILURE'")
    assert as_dicts(rt.roundtrip_validate(expected, lost, FIELDS))[0]["n_unpaired"] == 1
    twice = produced.unionByName(produced.limit(1))
    assert as_dicts(rt.roundtrip_validate(expected, twice, FIELDS))[0]["status"] == "fail"
    swapped = produced.withColumn("status_id", F.lit(3) - F.col("status_id"))
    verdict = as_dicts(rt.roundtrip_validate(expected, swapped, FIELDS))[0]
    assert (verdict["status"], verdict["n_bad_events"], verdict["n_mismatches"]) == ("fail", 8, 8)


def test_boolean_is_not_the_integer_it_resembles(make):
    expected = make("event_key int, is_mfa boolean", [(1, False)])
    produced = make("event_key int, is_mfa int", [(1, 0)])
    assert [r["why"] for r in rt.field_value_checks(expected, produced, ["is_mfa"]).collect()] == ["wrong-value"]
    bare = make("event_key int", [(1,)])
    assert [r["why"] for r in rt.field_value_checks(expected, bare, ["is_mfa"]).collect()] == ["missing"]


def test_resolve_path_prefers_the_literal_key(make):
    flat = make("`id.orig_h` string", [("10.0.0.1",)])
    assert flat.select(cw.resolve_path(flat, "id.orig_h")).first()[0] == "10.0.0.1"
    doc = make("value string", [('{"a.b":"flat","a":{"b":"deep","c":"only"}}',)]).select(
        F.parse_json("value").alias("record")
    )
    got = doc.select(*[cw.resolve_path(doc, p).alias(str(i)) for i, p in enumerate(["a.b", "a.c", "a.d", "z"])]).first()
    assert tuple(got) == ("flat", "only", None, None)


def test_crosswalk_long_flags_traps(zeek):
    raw = zeek.withColumnRenamed("uid", "event_key")
    rows = as_dicts(cw.crosswalk_long(raw, nz.normalize_zeek_conn(raw, ("event_key",)), "zeek"))
    assert len(rows) == 50
    mine = {r["raw_field"]: r for r in rows if r["event_key"] == "Ca"}
    assert (mine["orig_bytes"]["raw_value"], mine["orig_bytes"]["ocsf_field"]) == ("520", "bytes_out")
    assert (mine["orig_bytes"]["ocsf_value"], mine["orig_bytes"]["is_trap"]) == ("520", True)
    assert mine["conn_state"]["ocsf_value"] == "2"


# -- drift

ALL_ZEEK = [f.raw for f in cw.CROSSWALK["zeek"].fields]


def names(make, source, fields):
    return make("source string, field string", [(source, f) for f in fields])


def test_drifted_header_puts_two_hunts_at_risk(make):
    drifted = names(make, "zeek", ["src_host"] + [f for f in ALL_ZEEK if f not in ("id.orig_h", "orig_bytes")])
    gone = {r["ocsf_field"] for r in cw.unpopulated_fields(drifted).collect()}
    assert gone == {"src_ip", "bytes_out"}
    risk = {r["detection_id"]: r["lost_fields"] for r in cw.drift_at_risk(drifted).collect()}
    assert risk == {"c2_beacon": "bytes_out,src_ip", "exfil_egress": "bytes_out,src_ip"}
    status = {r["source"]: r["status"] for r in cw.drift_status(drifted).collect()}
    assert status == {"zeek": "fail", "sysmon": "unmeasured", "cloudtrail": "unmeasured"}
    changes = {(r["field"], r["change"]) for r in cw.field_diff(drifted).collect()}
    assert changes == {("id.orig_h", "missing"), ("orig_bytes", "missing"), ("src_host", "unexpected")}


def test_unused_field_does_not_alarm(make):
    seen = names(make, "zeek", [f for f in ALL_ZEEK if f != "orig_pkts"])
    assert {r["ocsf_field"] for r in cw.unpopulated_fields(seen).collect()} == {"packets_out"}
    assert {r["source"]: r["status"] for r in cw.drift_status(seen).collect()}["zeek"] == "pass"


def test_hostile_field_name_is_inert(make):
    seen = names(make, "zeek", [*ALL_ZEEK, "<script>`x`"])
    assert [r["field"] for r in cw.field_diff(seen).collect()] == ["&lt;script&gt;x"]


def test_observed_fields_at_any_depth(make):
    deep = {"a": {"b": {"c": {"d": 1}, "e": []}}, "f": [{"g": {"h": 1}}, 3], "i": None}
    df = make("source string, value string", [("s", json.dumps(deep)), ("t", "{}"), ("t", "7"), ("u", None)])
    seen = cw.observed_fields(df.select("source", F.parse_json("value").alias("record")))
    want = {"a", "a.b", "a.b.c", "a.b.c.d", "a.b.e", "f", "f.g", "f.g.h", "i"}
    assert {tuple(r) for r in seen.collect()} == {("s", x) for x in want}


def test_observed_fields_sees_nested_names(make):
    df = make("source string, value string", [("s", '{"a":{"b":1},"c":null}'), ("s", '{"a":{},"d":2}')])
    seen = cw.observed_fields(df.select("source", F.parse_json("value").alias("record")))
    assert {r["field"] for r in seen.collect()} >= {"a", "a.b", "c", "d"}


# -- flow


def hops(make, rows):
    schema = "class_uid int, n bigint"
    return [None if r is None else make(schema, r) for r in rows]


def test_flow_reconcile_cases(make):
    clean = fw.flow_reconcile(*hops(make, [[(3002, 4000)], [(3002, 4000)], [(3002, 4000)]]))
    assert as_dicts(fw.flow_status(clean)) == [{"status": "pass", "worst_drop": 0.0, "n_classes": 1}]
    rows = [[(3002, 4000), (4001, 10)], [(3002, 4000), (4001, 10)], [(3002, 3990)]]
    got = {r["class_uid"]: r for r in as_dicts(fw.flow_reconcile(*hops(make, rows)))}
    assert (got[3002]["n_dropped"], got[3002]["drop_frac"], got[3002]["status"]) == (10, 0.0025, "fail")
    assert (got[4001]["landed"], got[4001]["status"]) == (0, "fail")


@pytest.mark.parametrize(("tolerance", "status"), [(0.0025, "pass"), (0.00249, "fail")])
def test_flow_tolerance_is_strict(make, tolerance, status):
    got = fw.flow_reconcile(*hops(make, [[(1, 4000)], [(1, 4000)], [(1, 3990)]]), tolerance=tolerance)
    assert as_dicts(got)[0]["status"] == status


def test_flow_hop_that_did_not_run_is_unmeasured(make):
    got = as_dicts(fw.flow_reconcile(*hops(make, [[(1, 5)], None, [(1, 5)]])))[0]
    assert (got["ingested"], got["status"], got["n_dropped"]) == (None, "unmeasured", None)
    odd = as_dicts(fw.flow_reconcile(*hops(make, [[(1, 0), (2, 4)], [(1, 0), (2, -4)], [(1, 0), (2, 4)]])))
    assert {r["status"] for r in odd} == {"unmeasured"}


def test_flow_gate(make):
    emitted, landed = hops(make, [[(4001, 100), (3002, 40)], [(4001, 100)]])
    got = {r["class_uid"]: (r["landed"], r["status"]) for r in fw.flow_gate(emitted, landed).collect()}
    assert got == {4001: (100, "ok"), 3002: (0, "DROP")}


SCRAPE = [
    "# HELP vector_component_received_events_total x",
    'vector_component_received_events_total{component_id="raw",component_kind="source",component_type="file"} 8 1395066',
    'vector_component_received_events_total{component_id="m",component_kind="source",component_type="internal_metrics"} 99',
    'vector_component_sent_events_total{component_id="out",component_kind="sink",component_type="console"} 7',
    'vector_component_sent_events_total{component_id="p",component_kind="sink",component_type="prometheus_exporter"} 50',
    'vector_component_sent_events_total{component_id="t",component_kind="transform",component_type="remap"} 8',
    'vector_component_errors_total{component_id="t",component_kind="transform",component_type="remap"} 1',
    "vector_uptime_seconds 4",
]


def test_scrape_counters(make):
    got = as_dicts(fw.scrape_counters(make("value string", [(line,) for line in SCRAPE])))
    assert got == [{"events_in": 8, "events_out": 7, "errors": 1}]
    none = as_dicts(fw.scrape_counters(make("value string", [("vector_uptime_seconds 4",)])))
    assert none == [{"events_in": None, "events_out": None, "errors": None}]


def test_scrape_counters_over_several_captures(make):
    line = 'vector_component_received_events_total{component_id="raw",component_kind="source",component_type="file"} %d'
    rows = [("h", 1, line % 100), ("h", 2, line % 150), ("h", 3, line % 20), ("g", 1, line % 7)]
    lines = make("host string, at int, value string", rows)
    got = {r["host"]: r["events_in"] for r in fw.scrape_counters(lines, by=("host",), at="at").collect()}
    assert got == {"h": 170, "g": 7}
    assert fw.scrape_counters(lines, by=("host",)).filter("host = 'h'").first()["events_in"] == 150


# -- lint

SOUND = [
    ("username", "actor.user.name"), ("process_name", "process.name"), ("image", "process.file.path"),
    ("src_ip", "src_endpoint.ip"), ("group", "actor.group.name"), ("url", "url"), ("sessionid", "session.uid"),
]
CROSSED = [("username", "process.name"), ("file_path", "src_endpoint.ip"), ("process_name", "actor.user.name")]
MAPPING = "source_field string, ocsf_path string"


def test_lint_flags_only_crossings(make):
    linted = ml.mapping_type_lint(make(MAPPING, SOUND))
    assert as_dicts(ml.lint_summary(linted)) == [
        {"n_checked": 7, "n_testable": 7, "n_crossing": 0, "status": "pass"}
    ]
    wrong = ml.mapping_type_lint(make(MAPPING, CROSSED))
    assert as_dicts(ml.lint_summary(wrong))[0]["status"] == "fail"
    assert {r["status"] for r in wrong.collect()} == {"crossing"}
    bare = ml.mapping_type_lint(make(MAPPING, CROSSED), with_layer=False)
    assert {r["status"] for r in bare.collect()} == {"ok"}


def test_lint_without_testable_rows_is_an_error(make):
    swapped = ml.mapping_type_lint(make(MAPPING, [("a.b", "note"), ("x", "metadata.version")]))
    assert as_dicts(ml.lint_summary(swapped))[0]["status"] == "error"
    assert as_dicts(ml.lint_summary(swapped, allow_untestable=True))[0]["status"] == "pass"
    assert as_dicts(ml.lint_summary(ml.mapping_type_lint(make(MAPPING, []))))[0]["status"] == "error"


def test_selfcheck_catches_a_set_that_breaks_the_ontology(spark):
    assert ml.disjointness_selfcheck(spark).count() == 0
    broken = ml.disjointness_selfcheck(spark, (*ml.DISJOINT_SET, "Session"))
    assert [r["artifact"] for r in broken.collect()] == ["NetworkSession"]
    assert ml.disjoint_pairs(spark).count() == 56


def plain_closure(pairs):
    found = set(pairs)
    while True:
        more = {(a, d) for a, b in found for c, d in pairs if b == c} - found
        if not more:
            return found
        found |= more


@pytest.mark.parametrize("kind", ["deep", "cycles", "random", "none"])
def test_closure_of_a_hierarchy_table(make, kind):
    rng = random.Random(3)
    pairs = {
        "deep": [(f"n{i}", f"n{i + 1}") for i in range(75)] + [(f"n{i}", f"m{i}") for i in range(0, 75, 9)],
        "cycles": [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("x", "c3"), ("y", "y"), ("c5", "z"), ("x", "c3")],
        "random": [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(70)],
        "none": [],
    }[kind]
    closed = ml.transitive_closure(make("artifact string, ancestor string", [*pairs, (None, "a"), ("b", None)]))
    rows = [tuple(r) for r in closed.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_closure(pairs)


def test_closure_doubles_its_chains(make, monkeypatch):
    rounds = []
    real = ml.materialise
    monkeypatch.setattr(ml, "materialise", lambda df, label: rounds.append(label) or real(df, label))
    closed = ml.transitive_closure(make("artifact int, ancestor int", [(i, i + 1) for i in range(64)]))
    assert closed.count() == 64 * 65 // 2 and len(rounds) <= 9


def test_lint_with_a_hierarchy_table(spark, make):
    chain = [("UserAccount", "a1")] + [(f"a{i}", f"a{i + 1}") for i in range(1, 25)] + [("a25", "Process"), ("a9", "a2")]
    table = make("artifact string, ancestor string", chain)
    assert {r["artifact"] for r in ml.disjointness_selfcheck(spark, subclasses=table).collect()} == {"UserAccount"}
    mappings = make(MAPPING, [("cmdline", "process.name"), ("user", "process.name"), ("file", "url.path"), ("user", "metadata.x")])
    linted = ml.mapping_type_lint(mappings, subclasses=table).collect()
    assert {(r["source_field"], r["status"]) for r in linted} == {("cmdline", "ok"), ("user", "crossing"), ("file", "crossing"), ("user", "untestable")}
