from __future__ import annotations

import ipaddress
import random

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from siftlake.functions import ipv4_to_long
from siftlake.operators import correlate as co
from siftlake.operators import detections as dt
from siftlake.operators import inventory as iv
from siftlake.operators import pivot as pv
from siftlake.operators import predicates as pr
from siftlake.operators import profile as pf

EVENT = (
    "time bigint, class_uid int, activity_id int, status_id int, src_ip string, dst_ip string, dst_port int, "
    "user string, actor_user string, device_hostname string, cmd_line string, bytes_out bigint"
)
ORDER = [f.split()[0] for f in EVENT.split(", ")]


def event(**fields):
    return tuple(fields.get(name) for name in ORDER)


def net(src, dst, sent, n=1, **more):
    return [event(class_uid=4001, activity_id=6, src_ip=src, dst_ip=dst, bytes_out=sent, **more)] * n


def login(src, user, ok, n=1):
    return [event(class_uid=3002, activity_id=1, status_id=1 if ok else 2, src_ip=src, user=user)] * n


def process(host, cmd):
    return [event(class_uid=1007, activity_id=1, device_hostname=host, cmd_line=cmd)]


def call(actor, sent, n=1):
    return [event(class_uid=6003, activity_id=2, actor_user=actor, bytes_out=sent)] * n


BENIGN = (
    net("10.0.0.1", "10.0.0.9", 900, 3) + net("10.0.0.2", "10.0.0.9", 40, 2) + login("10.0.0.5", "ann", True, 9)
    + login("10.0.0.6", "bo", False, 4) + process("WS-1", "outlook.exe /recycle") + call("ann", 800, 2)
)
PLANTED = (
    net("10.0.1.7", "203.0.113.6", 84, 3) + net("10.0.1.8", "198.51.100.9", 5000, 3)
    + [e for i in range(6) for e in login("203.0.113.99", f"user{i}", False)]
    + process("FIN-7", "cmd /c VSSADMIN  delete shadows") + process("FIN-7", "C:\\x\\VssAdmin Delete Shadows /all")
    + process("FIN-8", "procdump -ma LSASS.exe") + call("svc", 25_000, 3)
)


@pytest.fixture(scope="module")
def benign(spark):
    return spark.createDataFrame(BENIGN, EVENT)


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame(BENIGN + PLANTED, EVENT)


def test_every_hunt_finds_its_plant(planted):
    want = {
        "c2_beacon": {("10.0.1.7", "203.0.113.6", 3, 84.0)},
        "exfil_egress": {("10.0.1.8", 15_000, 3)},
        "credential_stuffing": {("203.0.113.99", 6, 6)},
        "shadow_copy_deletion": {("FIN-7", 1)},
        "lsass_credential_access": {("FIN-8", 1)},
        "api_bulk_retrieval": {("svc", 3, 75_000)},
    }
    got = {s.id: {tuple(r) for r in dt.findings(planted, s).collect()} for s in dt.DETECTIONS}
    assert got == want


def test_benign_events_are_silent(benign, planted):
    quiet = {r["detection_id"]: r["verdict"] for r in dt.detection_verdicts(benign).collect()}
    assert set(quiet.values()) == {"SILENT"}
    loud = dt.detection_verdicts(planted)
    assert {r["verdict"] for r in loud.collect()} == {"FIRED"}
    assert as_dicts(dt.verdict_counts(loud)) == [{"fired": 6, "silent": 0, "total": 6}]


def test_one_pass_equals_the_single_hunts(planted):
    rows = dt.run_detections(planted).collect()
    got = {(r["detection_id"], r["finding_key"], r["measure"]): r["value"] for r in rows}
    for spec in dt.DETECTIONS:
        for row in dt.findings(planted, spec).collect():
            key = " → ".join(row[g] for g in spec.group)
            for m in spec.measures:
                assert got.pop((spec.id, key, m.name)) == float(row[m.name])
    assert not got


@pytest.mark.parametrize("kind", ["double", "decimal(12,3)", "bigint"])
def test_one_pass_keeps_the_type_of_its_inputs(make, kind):
    """Any number of keys, several sums, fractions and NULLs: both paths of a spec agree."""
    spec = dt.DetectionSpec(
        "w", "T0", "t", (("class_uid", "=", 4001),), ("src_ip", "dst_ip", "dst_port"),
        (dt.Measure("out", "sum", "b_out"), dt.Measure("inn", "sum", "b_in"), dt.Measure("mean", "avg", "b_out"),
         dt.Measure("users", "distinct", "user"), dt.Measure("ports", "distinct", "port"), dt.Measure("n", "count")),
        (("out", ">=", 3),), "inn",
    )
    rows = [(4001, "a", "b", i % 2, None if i % 5 == 0 else f"{i % 7}.9", f"{i}.25", f"u{i % 3}", i) for i in range(60)]
    df = make("class_uid int, src_ip string, dst_ip string, dst_port int, o string, i string, user string, port int", rows)
    cast = "double" if kind == "bigint" else kind
    df = df.withColumn("b_out", F.col("o").cast(cast).cast(kind)).withColumn("b_in", F.col("i").cast(cast).cast(kind))
    other = dt.BY_ID["credential_stuffing"]
    more = df.withColumn("status_id", F.lit(1)).withColumn("bytes_out", F.lit(0))
    got = {(r["finding_key"], r["measure"]): r["value"] for r in dt.run_detections(more, [other, spec]).collect()}
    want = {}
    for row in dt.findings(df, spec).collect():
        for m in spec.measures:
            want[(f"a → b → {row['dst_port']}", m.name)] = float(row[m.name])
    assert len(want) == 12 and got == pytest.approx(want)


def test_fractions_make_a_finding(make):
    rows = [(4001, "10.0.0.1", 0.9)] * 20_000
    df = make("class_uid int, src_ip string, bytes_out double", rows)
    found = dt.run_detections(df, [dt.BY_ID["exfil_egress"]]).filter("measure = 'total_bytes_out'").collect()
    assert [round(r["value"]) for r in found] == [18_000]


def test_sql_text_and_dataframe_agree(spark, planted):
    planted.createOrReplaceTempView("landed_events")
    for spec in dt.DETECTIONS:
        through_sql = spark.sql(dt.findings_sql(spec, "landed_events"))
        mine = dt.findings(planted, spec)
        assert through_sql.columns == mine.columns
        assert {tuple(r) for r in through_sql.collect()} == {tuple(r) for r in mine.collect()} != set()


def test_sql_literals_are_quoted(make):
    spec = dt.DetectionSpec("q", "T0", "t", (("cmd_line", "contains", "it's a\\b%"),), ("device_hostname",),
                            (dt.Measure("n", "count"),), (("n", ">=", 1),), "n")
    df = make(EVENT, process("h", "x IT'S A\\B% y") + process("i", "its ab"))
    df.createOrReplaceTempView("quoted_events")
    rows = df.sparkSession.sql(dt.findings_sql(spec, "quoted_events")).collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in dt.findings(df, spec).collect()] == [("h", 1)]


def test_boundary_four_is_not_five(make):
    four = make(EVENT, login("9.9.9.9", "a", False, 4))
    five = make(EVENT, login("9.9.9.9", "a", False, 5))
    spec = dt.BY_ID["credential_stuffing"]
    assert dt.findings(four, spec).count() == 0
    assert [tuple(r) for r in dt.findings(five, spec).collect()] == [("9.9.9.9", 5, 1)]


def test_top_n_and_tie_break(make):
    rows = [e for i in range(15) for e in login(f"9.9.9.{i:02d}", "a", False, 5)]
    top = dt.run_detections(make(EVENT, rows), top_n=3).filter("measure = 'failed_attempts'").orderBy("rank")
    assert [r["finding_key"] for r in top.collect()] == ["9.9.9.00", "9.9.9.01", "9.9.9.02"]
    counts = {r["detection_id"]: r["n_findings"] for r in dt.finding_counts(make(EVENT, rows)).collect()}
    assert counts == {"credential_stuffing": 15}


def test_null_group_key_is_shown_not_lost(make):
    found = dt.run_detections(make(EVENT, login(None, "a", False, 5)))
    assert {r["finding_key"] for r in found.collect()} == {"<null>"}


def test_absent_columns_skip_and_name_the_hunt(planted):
    narrow = planted.drop("cmd_line")
    _, skipped = dt.split_runnable(narrow, dt.DETECTIONS)
    assert skipped == ["shadow_copy_deletion", "lsass_credential_access"]
    verdicts = {r["detection_id"]: r["verdict"] for r in dt.detection_verdicts(narrow).collect()}
    assert verdicts["lsass_credential_access"] == "SKIPPED"
    assert verdicts["c2_beacon"] == "FIRED"


def test_hostile_key_comes_out_inert(make):
    rows = login("<b>`x`</b>\x07" + "y" * 90, "a", False, 5)
    key = dt.run_detections(make(EVENT, rows)).first()["finding_key"]
    assert key.startswith("&lt;b&gt;x&lt;/b&gt;y") and "`" not in key and key.endswith("…")


@pytest.mark.parametrize("leaky", ["cmd_line", "url", "message"])
def test_free_text_group_keys_are_refused(leaky):
    count = (dt.Measure("n", "count"),)
    with pytest.raises(ValueError, match="groups on"):
        dt.DetectionSpec("leak", "T0", "t", (), (leaky,), count, (), "n")


def test_regression(planted, benign):
    before, after = dt.detection_verdicts(planted), dt.detection_verdicts(benign)
    assert dt.regression_diff(before, before).count() == 0
    assert as_dicts(dt.regression_status(before, before))[0]["status"] == "pass"
    assert dt.regression_diff(before, after).count() == 6
    less = after.filter("detection_id <> 'c2_beacon'")
    vanished = dt.regression_diff(before, less).filter("detection_id = 'c2_beacon'").first()
    assert tuple(vanished) == ("c2_beacon", "FIRED", dt.ABSENT)
    assert as_dicts(dt.regression_status(before, after))[0]["status"] == "fail"
    assert as_dicts(dt.regression_status(before.limit(0), after))[0]["status"] == "unmeasured"


def test_predicates_follow_three_valued_logic(make):
    df = make("a int, s string", [(1, "x100%y"), (None, None), (5, "X100z")])
    assert df.filter(pr.predicate("a", "!=", 1)).count() == 1
    assert df.filter(pr.predicate("s", "contains", "100%")).count() == 1
    assert df.filter(pr.predicate("s", "contains", "x100")).count() == 2
    with pytest.raises(ValueError, match="unknown operator"):
        pr.predicate("a", "like", 1)


def test_sigma_rules_in_one_pass(planted):
    rules = [pr.RDP_RULE, pr.SigmaRule("no such field", (("registry_key", "=", "x"),))]
    got = {r["rule"]: (r["compiled"], r["matches"]) for r in pr.sigma_predicate(planted, rules).collect()}
    assert got == {"RDP Network Connection": (True, 0), "no such field": (False, None)}
    only = pr.sigma_predicate(planted, rules[1:]).collect()
    assert [(r["compiled"], r["matches"]) for r in only] == [(False, None)]


def test_exclusion_survives_a_null(make):
    df, out = make("k string", [("a",), ("b",), (None,)]), make("k string", [("a",), (None,)])
    assert {r["k"] for r in pr.exclude(df, out, "k").collect()} == {"b", None}
    assert as_dicts(pr.null_in_exclusion_guard(out, "k")) == [{"n_null": 1, "ok": False}]


# -- profile and pivot


def test_profile_of_a_known_distribution(make):
    rows = [event(time=100 + i, class_uid=3002 if i < 12 else 4001, activity_id=1 if i < 14 else 2,
                  src_ip=None if i == 0 else "10.0.0.1" if i < 9 else f"10.0.0.{i}") for i in range(20)]
    tidy, skipped = pf.analyze_table(make(EVENT, rows), top_n=2)
    got = {(r["view"], r["key"]): r for r in tidy.collect()}
    assert skipped == []
    counts = {k: r["n"] for k, r in got.items() if k[0] != "non_null"}
    assert counts == {
        ("row_count", ""): 20, ("by_class", "3002"): 12, ("by_class", "4001"): 8, ("by_activity", "1"): 14,
        ("by_activity", "2"): 6, ("top_sources", "10.0.0.1"): 8, ("top_sources", "10.0.0.10"): 1,
    }
    assert (got[("row_count", "")]["first_time"], got[("row_count", "")]["last_time"]) == (100, 119)
    assert got[("non_null", "src_ip")]["n"] == 19


def test_profile_names_what_it_skips(make):
    df = make("x int, class_uid string", [(1, "3002"), (2, None), (3, "<b>")])
    tidy, skipped = pf.analyze_table(df)
    assert skipped == ["activity_id", "top_sources", "time_span"]
    got = {r["key"]: r["n"] for r in tidy.filter("view = 'by_class'").collect()}
    assert got == {"3002": 1, "<null>": 1, "&lt;b&gt;": 1}
    empty, _ = pf.analyze_table(df.limit(0))
    assert [(r["view"], r["n"]) for r in empty.filter("view = 'row_count'").collect()] == [("row_count", 0)]


PIVOT = [
    event(time=i, class_uid=4001, activity_id=6, src_ip=s, dst_ip=d)
    for i, (s, d) in enumerate(
        [("10.0.1.5", "10.0.2.9")] * 2 + [("10.0.2.9", "10.0.1.5"), ("10.0.1.5", "10.0.2.10"), ("10.9.9.9", "10.0.2.9")]
        + [("10.0.1.5", "10.0.1.5")]
    )
] + [event(time=50, class_uid=3002, activity_id=1, src_ip="10.0.1.5", user="ann")]


def test_entity_profile_and_batch_form_agree(make):
    df = make(EVENT, PIVOT)
    one, skipped = pv.entity_profile(df, "ip", "10.0.1.5")
    got = {(r["view"], r["key"]): (r["n"], r["first_seen"], r["last_seen"]) for r in one.collect()}
    assert skipped == []
    assert got[("total", "")] == (6, 0, 50)
    assert got[("by_class", "4001")] == (5, 0, 5)
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "peer"} == {"10.0.2.9": 3, "10.0.2.10": 1}
    batch = pv.entity_profile_all(df, "ip").filter("entity = '10.0.1.5'").collect()
    assert {(r["view"], r["key"]): (r["n"], r["first_seen"], r["last_seen"]) for r in batch} == {
        k: v for k, v in got.items() if k[0] != "peer"
    }
    assert [tuple(r) for r in pv.top_counterparts(df, "ip", "10.0.1.5", 1).collect()] == [("10.0.2.9", 3)]
    top = {(r["entity"], r["peer"]) for r in pv.top_n_per_entity(df, "ip", 1).collect()}
    assert ("10.0.1.5", "10.0.2.9") in top and ("10.0.1.5", "10.0.2.10") not in top


def test_pivot_degrades_honestly(make):
    df = make("class_uid int, user string", [(3002, "ann")])
    _, skipped = pv.entity_profile(df, "user", "ann")
    assert skipped == ["time_span", "peers"]
    assert pv.entity_profile(make(EVENT, PIVOT), "ip", "1.2.3.4")[0].count() == 0
    with pytest.raises(ValueError, match="unknown entity type"):
        pv.entity_profile(df, "url", "x")


# -- correlation and address blocks


def test_correlation_is_not_inflated(make):
    auth = make("src_ip string, status string", [("6.6.6.6", "FAILURE")] * 8 + [("1.1.1.1", "SUCCESS")] * 50)
    flows = make("src_ip string, dst_port int", [("6.6.6.6", 3389)] * 5 + [("1.1.1.1", 3389), ("6.6.6.6", 80)])
    assert [tuple(r) for r in co.correlate_auth_net(auth, flows).collect()] == [("6.6.6.6", 8, 5)]


def test_ordered_correlation_against_brute_force(make):
    rnd = random.Random(4)
    auth = [(f"s{rnd.randrange(4)}", rnd.choice(["FAILURE", "SUCCESS"]), rnd.randrange(2000)) for _ in range(60)]
    flows = [(f"s{rnd.randrange(4)}", rnd.choice([3389, 80]), rnd.randrange(2000)) for _ in range(120)]
    want = {}
    for src in {a[0] for a in auth}:
        times = [t for s, status, t in auth if s == src and status == "FAILURE"]
        hits = [1 for s, port, t in flows if s == src and port == 3389 and any(f <= t <= f + 90 for f in times)]
        if hits:
            want[src] = (len(times), len(hits))
    a = make("src_ip string, status string, time bigint", auth)
    n = make("src_ip string, dst_port int, time bigint", flows)
    for bucket in (7, 90, 100_000):
        got = co.correlate_ordered(a, n, within_ms=90, bucket_ms=bucket).collect()
        assert {r["src_ip"]: (r["fails"], r["rdp"]) for r in got} == want


def test_cidr_join_against_brute_force(make):
    rnd = random.Random(7)
    ips = [f"10.{rnd.randrange(3)}.{rnd.randrange(4)}.{rnd.randrange(256)}" for _ in range(300)]
    blocks = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.128/25", "10.2.3.4/32", "0.0.0.0/0", "11.0.0.0/8"]
    blocks += ["10.1.2.77/24", "bad/24", "10.0.0.0/40"]
    df = make("ip string", [(i,) for i in ips]).select(ipv4_to_long(F.col("ip")).alias("ip_num"))
    rows = co.cidr_join(df, make("cidr string", [(b,) for b in blocks])).collect()
    got = {r["cidr"]: (r["n_ips"], r["n_events"]) for r in rows if r["status"] == "ok"}
    bad = {r["cidr"]: (r["status"], r["n_ips"], r["n_events"]) for r in rows if r["status"] != "ok"}
    assert bad == {b: ("unparsable", None, None) for b in ("bad/24", "10.0.0.0/40")}
    want = {}
    for b in blocks[:8]:
        inside = [i for i in ips if ipaddress.ip_address(i) in ipaddress.ip_network(b, strict=False)]
        want[b] = (len(set(inside)), len(inside))
    assert got == want


def test_cidr_join_looks_up_only_the_lengths_in_use(spark, make):
    df = make("ip_num bigint", [(i,) for i in range(1000)])
    rows = co.network_counts(df, [0, 24]).orderBy("prefix_length", "network").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 1000, 1000)] + [(24, 256 * k, min(256, 1000 - 256 * k), min(256, 1000 - 256 * k)) for k in range(4)]
    joined = co.cidr_join(df, make("cidr string", [("0.0.0.0/0",), ("0.0.1.0/24",), ("0.0.2.0/24",)]))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("prefix_length, 0") == 1 and plan.count("prefix_length, 24") == 1 and "prefix_length, 16" not in plan
    assert {r["cidr"]: r["n_ips"] for r in joined.collect()} == {"0.0.0.0/0": 1000, "0.0.1.0/24": 256, "0.0.2.0/24": 256}
    assert [tuple(r) for r in co.cidr_join(df, make("cidr string", [("x",)])).collect()] == [("x", "unparsable", None, None)]
    assert co.cidr_join(df, make("cidr string", [])).collect() == []


# -- inventories

INVENTORY = "tool string, raw_id string, last_seen timestamp"
NOW = "2026-03-02T00:00:00Z"


@pytest.fixture()
def inventory(make):
    def build(**tools):
        rows = []
        for tool, ids in tools.items():
            for raw_id, seen in ids.items() if isinstance(ids, dict) else [(i, None) for i in ids]:
                rows.append((tool, raw_id, seen))
        schema = "tool string, raw_id string, seen string"
        df = make(schema, rows)
        return df.select("tool", "raw_id", F.to_timestamp("seen").alias("last_seen"))

    return build


def resolve(df, **options):
    return {r["to_tool"]: r for r in as_dicts(iv.resolve_entities(df, "cmdb", NOW, **options))}


def test_exact_gap(inventory):
    df = inventory(cmdb=["a", "b", "c", None], edr=["a", "b", "x"], scanner=["c"])
    got = {r["to_tool"]: (r["gap_count"], r["primary_count"], r["to_count"], r["over_tolerance"])
           for r in iv.gap_exact(df, "cmdb", tolerance=1).collect()}
    assert got == {"edr": (1, 3, 3, False), "scanner": (2, 3, 1, True)}


def test_resolution_closes_declared_differences(inventory):
    df = inventory(cmdb=["web-01", "DB-01", "app-01"], edr=["web-01.corp", "db-01", "app-01"])
    got = resolve(df)["edr"]
    assert (got["covered"], got["uncovered_total"], got["status"]) == (3, 0, "pass")
    assert (got["mean_confidence"], got["freshness"]) == (0.9633, "unmeasured")
    strict = resolve(df, min_confidence=0.99)["edr"]
    assert (strict["covered"], strict["gap"]) == (2, 1)


def test_resolution_never_hides_a_hole(inventory):
    fresh, old = "2026-03-01T12:00:00Z", "2026-01-01T00:00:00Z"
    ahead = "2026-03-02T00:06:00Z"
    df = inventory(
        cmdb=["a", "b", "c", "d", "E", "e", "web-02", "g"],
        edr={"a": fresh, "b": old, "c": None, "d": fresh, "D.corp": fresh, "e": fresh, "web-01": fresh, "g": ahead},
    )
    got = resolve(df)["edr"]
    # a covered; b old, c undated and g from the future are stale; d has two candidates, E/e collapse; web-02 is a gap
    assert (got["covered"], got["stale"], got["unresolved"], got["gap"]) == (1, 3, 3, 1)
    assert got["primary_count"] == 8 and got["freshness"] == "measured" and got["status"] == "fail"


def test_resolution_status(inventory):
    alone = inventory(cmdb=["a"])
    assert as_dicts(iv.resolution_status(alone, iv.resolve_entities(alone, "cmdb", NOW), "cmdb"))[0]["status"] == "unmeasured"
    good = inventory(cmdb=["a"], edr=["a"])
    assert as_dicts(iv.resolution_status(good, iv.resolve_entities(good, "cmdb", NOW), "cmdb"))[0]["status"] == "pass"


def test_holes_and_set_operations(inventory):
    df = inventory(cmdb=["a", "b", "c"], edr=["a", "d"], scanner=["e", "a", None])
    assert as_dicts(iv.cross_tool_holes(df)) == [
        {"union_size": 5, "edr_blind": 3, "cmdb_unknown": 2, "edr_sees_cmdb_doesnt": 1, "scanner_only": 1}
    ]
    tools = [df.filter(F.col("tool") == t) for t in ("cmdb", "edr", "scanner")]
    assert {r[0] for r in iv.inventory_difference(*tools).collect()} == {"b", "c"}
    assert {r[0] for r in iv.inventory_union(tools[1], tools[2]).collect()} == {"a", "d", "e"}
