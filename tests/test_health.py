from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from siftlake.operators import quality as ql
from siftlake.operators import verify as vf
from siftlake.operators.quantiles import exact_quantiles
from siftlake.sources import files as fl
from siftlake.sources import sinks as sk

MIN = ql.MINUTE_US


def test_an_outlier_does_not_widen_the_last_slice(make, monkeypatch):
    """However far the largest value lies, a final slice spans 4096 integers at most."""
    from siftlake.operators import quantiles

    spans = []
    plain = quantiles._in_range

    def watched(counted, wanted, keys):
        spans.append(wanted.agg(F.max(quantiles._span())).first()[0])
        return plain(counted, wanted, keys)

    monkeypatch.setattr(quantiles, "_in_range", watched)
    values = [*range(0, 40_000, 2), 1_700_000_000_000_000, -(1 << 62), (1 << 62) + 5]
    got = exact_quantiles(make("v bigint", [(v,) for v in values]), [], "v", [0.0, 0.5, 1.0]).first()
    assert spans[-1] < 4096 and got["q1"] == float(np.median(np.array(values)))
    assert (got["q0"], got["q2"]) == (float(min(values)), float(max(values)))


def test_quantiles_equal_numpy(make):
    rnd = random.Random(1)
    rows = []
    for _ in range(3000):
        key = rnd.choice(["hot", "hot", "hot", "b"])
        rows.append((key, rnd.choice([7, int(rnd.gammavariate(2, 900_000)), rnd.randrange(-5, 5), 10**15 + rnd.randrange(9)])))
    rows += [("one", 42), ("none", None)]
    probabilities = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
    df = make("k string, v bigint", rows)
    got = {r["k"]: [r[f"q{i}"] for i in range(6)] for r in exact_quantiles(df, ["k"], "v", probabilities).collect()}
    assert set(got) == {"hot", "b", "one"}
    for key, values in got.items():
        want = np.percentile([v for k, v in rows if k == key and v is not None], [100 * p for p in probabilities])
        assert values == pytest.approx(list(want), rel=1e-12)
    overall = exact_quantiles(df, [], "v", [0.5]).first()
    assert overall["q0"] == float(np.percentile([v for _, v in rows if v is not None], 50))


SCORED = "time bigint, class_uid int, src_ip string, dst_port int"


def test_scorecard_thresholds(make):
    good = [(1_700_000_000_000 + i, 4001, "10.0.0.1", 443) for i in range(1000)]
    clean = {r["check"]: r["verdict"] for r in ql.dq_scorecard(make(SCORED, good)).collect()}
    assert set(clean.values()) == {"OK"} and len(clean) == 7
    bad = good[:960] + [good[0]] * 10 + [(1, 3002, "x", 70_000)] * 10 + [(2, 4001, None, None)] * 20
    scores = {r["check"]: (r["score"], r["verdict"]) for r in ql.dq_scorecard(make(SCORED, bad)).collect()}
    assert scores["completeness"] == (0.98, "OK")
    assert scores["uniqueness"] == (0.962, "FAIL")
    assert scores["validity"] == (0.97, "FAIL")
    assert scores["consistency"] == (0.99, "OK")
    assert scores["timeliness"] == (0.97, "FAIL")
    assert scores["guard_no_null_in_exclusion"] == (0.0, "FAIL")
    text = make("time string, class_uid int, src_ip string, dst_port int", [("1700000000000", 4001, "1.1.1.1", 1)])
    assert not ql.guard_epoch_type(text)


def test_single_scores_agree_with_the_scorecard(make):
    rows = [(1_700_000_000_000, 4001, "10.0.0.1", 443)] * 3 + [(1, 3002, None, 443)]
    df = make(SCORED, rows)
    card = {r["check"]: r["score"] for r in ql.dq_scorecard(df).collect()}
    for name in ("completeness", "uniqueness", "validity", "consistency", "timeliness"):
        assert getattr(ql, f"dq_{name}")(df).first()["score"] == pytest.approx(card[name])


HEALTH = (
    "source string, event_time_us bigint, ingest_time_us bigint, clock_offset_ms bigint, user string, landed boolean"
)


def feed(source, per_minute, minutes=range(10), offset=0, landed=True, user="a@acme.example", latency=1_000_000):
    return [
        (source, m * MIN + i, m * MIN + i + latency, offset, user, landed)
        for m in minutes
        for i in range(per_minute)
    ]


def volume(make, rows, baseline, **options):
    df = ql.source_volume_health(
        make(HEALTH, rows), make("source string, baseline_per_bucket double", baseline), 0, 10 * MIN, **options
    )
    return {r["source"]: r for r in as_dicts(df)}


def test_volume_verdicts(make):
    rows = feed("steady", 10) + feed("drift", 10, offset=90_000)
    rows += feed("dip", 10, [0, 1, 2, 3, 4, 5, 6, 8, 9]) + feed("dip", 6, [7])
    rows += feed("silent", 10, [0, 1, 2, 3, 4, 5, 6, 7, 9]) + feed("low", 9)
    rows += feed("lossy", 9) + feed("lossy", 1, landed=False)
    names = ["steady", "drift", "dip", "silent", "low", "lossy", "gone"]
    got = volume(make, rows, [(n, 10.0) for n in names])
    assert {n: r["verdict"] for n, r in got.items()} == {
        "steady": "OK",
        "drift": "FAIL: time-sync drift",
        "dip": "FAIL: capture dip",
        "silent": "FAIL: capture dip",
        "low": "WARN: low volume",
        "lossy": "OK",
        "gone": "FAIL: capture dip",
    }
    assert (got["dip"]["worst_vs_baseline"], got["dip"]["vol_vs_baseline"]) == (0.6, 0.96)
    assert (got["silent"]["worst_vs_baseline"], got["lossy"]["drop_rate"]) == (0.0, 0.1)
    assert got["drift"]["clock_drift_s"] == 90.0


def test_sparse_form_does_not_see_a_silent_minute(make):
    rows = feed("silent", 10, [0, 1, 2, 3, 4, 5, 6, 7, 9])
    got = volume(make, rows, [("silent", 10.0)], dense=False)["silent"]
    assert (got["worst_vs_baseline"], got["verdict"]) == (1.0, "WARN: low volume")


def test_golden_signals(make):
    rows = feed("s", 100, range(9)) + feed("s", 90, [9], latency=40_000_000) + feed("s", 10, [9], landed=False)
    df = ql.flow_golden_signals(make(HEALTH, rows), 0, 10 * MIN, tail_us=2 * MIN)
    got = {r["signal"]: r for r in as_dicts(df)}
    latencies = [1.0] * 900 + [40.0] * 90
    assert got["latency_p95_s"]["value"] == pytest.approx(np.percentile(latencies, 95))
    assert got["latency_p95_s"]["verdict"].startswith("FAIL")
    assert (got["errors"]["value"], got["errors"]["verdict"]) == (0.01, "FAIL: error budget exceeded")
    assert got["traffic_eps"]["value"] == pytest.approx(990 / 600)
    assert got["saturation"]["value"] == pytest.approx(90 / 189, abs=1e-5)  # the tail starts after its first instant
    assert got["saturation"]["verdict"].startswith("WARN")


def test_six_dimensions(make):
    rows = feed("zeek", 96, [0], user="ACME\\u1") + feed("zeek", 2, [1], user="u1") + feed("zeek", 1, [2], user=None)
    rows += feed("zeek", 1, [3], landed=False) + feed("zeek", 1, [0], user="ACME\\u1")
    got = {r["check"]: r for r in as_dicts(ql.dq_six_dimensions(make(HEALTH, rows)))}
    assert (got["accuracy"]["score"], got["accuracy"]["verdict"]) == (None, "unmeasured")
    assert got["timeliness"]["verdict"] == "OK"
    assert got["completeness"]["score"] == pytest.approx(100 / 101, abs=1e-6)
    assert got["uniqueness"]["score"] == pytest.approx(99 / 100)
    assert got["validity"]["score"] == pytest.approx(97 / 100)
    assert got["consistency"]["score"] == pytest.approx(1 - 2 / 99, abs=1e-6)


def test_readiness(make):
    rows = [("1 source", "OK"), ("2 flow", "OK"), ("3 quality", "unmeasured"), ("4 cross-tool", "FAIL")]
    ready = ql.readiness_scorecard(make("layer string, verdict string", rows)).collect()
    assert {r["ready"] for r in ready} == {True}
    assert {r["layer"]: r["gate"] for r in ready}["4 cross-tool"] == "ATTENTION"
    not_ready = ql.readiness_scorecard(make("layer string, verdict string", [*rows, ("2 flow", "FAIL: x")]))
    assert {r["ready"] for r in not_ready.collect()} == {False}


def test_completeness_vs_baseline(make):
    counts = make("source string, n_rows bigint", [("a", 90), ("b", 89), ("c", 5), ("d", 5)])
    baseline = make("source string, baseline bigint", [("a", 100), ("b", 100), ("c", 0)])
    got = {r["source"]: (r["floor"], r["status"]) for r in ql.completeness_vs_baseline(counts, baseline).collect()}
    assert got == {"a": (90, "pass"), "b": (90, "fail"), "c": (None, "pending"), "d": (None, "pending")}


def test_source_audit(make):
    now = 10_000_000
    counts = make(
        "source string, n_rows bigint, last_commit_ms bigint, n_required_null bigint",
        [("ok", 100, now - 1, 0), ("old", 100, 0, 0), ("nulls", 100, now, 3), ("short", 10, now, 0), ("new", 0, None, 0)],
    )
    baseline = make("source string, baseline bigint", [("ok", 100), ("short", 100)])
    got = {r["source"]: r["status"] for r in ql.source_audit(counts, baseline, now, 3600, ["user"]).collect()}
    assert got == {"ok": "pass", "old": "fail", "nulls": "fail", "short": "fail", "new": "unmeasured"}


def test_schema_conformance(make):
    df = make("a int, b string", [(1, "x"), (2, None)])
    one = lambda **o: tuple(ql.schema_conformance(df, **o).first())
    assert one() == ("", "", "unmeasured")
    assert one(expected=["a"], required=["a"]) == ("", "", "pass")
    assert one(required=["a", "b"]) == ("", "b", "fail")
    assert one(expected=["z"], required=["y"]) == ("y,z", "", "fail")


# -- files and commits


def test_files_orphans_and_compaction_pressure(spark, make, tmp_path):
    path = str(tmp_path / "t")
    table = make("class_uid int, v int", [(c, i) for c in (1, 2) for i in range(20)])
    landed = sk.land_replace(table.repartition(10), path)
    listing = fl.list_table_files(spark, path)
    assert listing.count() == fl.files_of(landed).count()
    assert fl.orphan_files(listing, fl.files_of(landed)).count() == 0
    left = fl.orphan_files(listing, fl.files_of(landed.filter("class_uid = 1")))
    assert left.count() == listing.filter(F.col("path").contains("class_uid=2")).count() > 0
    n = listing.count()
    assert as_dicts(fl.small_files(listing, max_small=n))[0]["status"] == "pass"
    assert as_dicts(fl.small_files(listing, max_small=n - 1))[0]["status"] == "fail"
    assert as_dicts(fl.small_files(listing.limit(0)))[0]["status"] == "unmeasured"
    audit = ql.table_audit(landed, listing, None, None, 0, expected=["v"])
    assert {r["check"]: r["status"] for r in audit.collect()} == {
        "freshness": "unmeasured", "small_files": "pass", "orphans": "unmeasured", "schema_conformance": "pass",
        "crc": "unwired", "tombstone": "unwired",
    }
    print_cost = fl.footprint_by_source(
        landed.withColumn("source", F.lit("s")), listing.withColumn("source", F.lit("s"))
    ).first()
    assert print_cost["n_events"] == 40 and print_cost["bytes_per_event"] > 0


def commit_three(spark, path):
    for i in range(3):
        batch = spark.range(i * 100, i * 100 + 100).withColumn("class_uid", F.lit(4001))
        sk.land_append_commit(batch, path, i, 1000 + i, i - 1 if i else None)


def test_commits_time_travel_and_chain(spark, make, tmp_path):
    path = str(tmp_path / "c")
    commit_three(spark, path)
    commit_three(spark, path)  # a retried run lands once
    table = sk.read_commits(spark, path)
    assert [sk.read_as_of(table, i).count() for i in range(3)] == [100, 200, 300]
    log = sk.read_commit_log(spark, path)
    rows = vf.commit_chain_audit(log).orderBy("commit_id").collect()
    assert [(r["records_as_of"], r["chain_ok"]) for r in rows] == [(100, True), (200, True), (300, True)]
    broken = log.filter("commit_id <> 1")
    assert [r["chain_ok"] for r in vf.commit_chain_audit(broken).orderBy("commit_id").collect()] == [True, False]


def test_chain_audit_over_many_blocks(spark):
    n = 3 * vf.CHAIN_BUCKET + 5
    log = spark.range(n).select(
        F.col("id").alias("commit_id"),
        F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"),
        F.lit(2).cast("bigint").alias("added_records"),
    )
    audited = vf.commit_chain_audit(log)
    assert audited.filter(~F.col("chain_ok")).count() == 0
    assert audited.filter(F.col("records_as_of") != (F.col("commit_id") + 1) * 2).count() == 0


def test_uncommitted_data_is_invisible(spark, tmp_path):
    path = str(tmp_path / "c")
    commit_three(spark, path)
    spark.range(7).withColumn("class_uid", F.lit(1)).write.parquet(f"{path}/data/commit_id=9")
    assert sk.read_commits(spark, path).count() == 300


def test_compaction_packs_small_files_only(spark, tmp_path):
    path = str(tmp_path / "c")
    large = spark.range(1000, 60_000).select((F.rand(1) * 1e15).cast("long").alias("id"), F.lit(4001).alias("class_uid"))
    commit_three(spark, path)
    sk.land_append_commit(large.coalesce(1), path, 3, 1003, 2)
    before = sk.live_files(spark, path).collect()
    kept = [r["file_name"] for r in before if r["n_bytes"] >= 50_000]
    assert len(kept) == 1 and len(before) > 6
    under_way, content = sk.read_commits(spark, path), vf.content_hash(sk.read_commits(spark, path)).first()
    assert sk.compact_commits(spark, path, 50_000, ["id"])
    after = sk.live_files(spark, path).collect()
    assert len(after) == 2 and set(kept) < {r["file_name"] for r in after}
    assert sum(int(r["content_hash"]) for r in after) == sum(int(r["content_hash"]) for r in before)
    packed = sk.read_commits(spark, path)
    assert vf.content_hash(packed).first() == content == vf.content_hash(under_way).first()
    assert [sk.read_as_of(packed, i).count() for i in range(4)] == [100, 200, 300, 59_300]
    assert sk.read_commit_log(spark, path).count() == 4
    # a small commit on top is packed with the packed file; a pack of one file is no pack
    sk.append_commit(spark.range(5).withColumn("class_uid", F.lit(1)), path, 2000)
    assert sk.compact_commits(spark, path, 50_000) and sk.live_files(spark, path).count() == 2
    assert sk.compact_commits(spark, path, 50_000) and len(sk.store.entry_numbers(spark, f"{path}/packs")) == 2
    assert sk.read_commits(spark, path).count() == 59_305


def test_a_pack_that_fails_its_check_or_comes_second_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    commit_three(spark, path)
    before = {r["file_name"] for r in sk.live_files(spark, path).collect()}
    monkeypatch.setattr(sk.store, "put_if_absent", lambda *a: False)
    with pytest.raises(sk.CommitConflict):
        sk.compact_commits(spark, path)
    monkeypatch.undo()
    real = vf.file_hashes
    monkeypatch.setattr(vf, "file_hashes", lambda df, *out: real(df, *out).withColumn("content_hash", F.lit("1")))
    assert not sk.compact_commits(spark, path)
    assert {r["file_name"] for r in sk.live_files(spark, path).collect()} == before


def test_two_writers_of_one_id_conflict_and_the_first_stays(spark, tmp_path):
    path = str(tmp_path / "c")
    first, other = spark.range(10), spark.range(20)
    sk.land_append_commit(first, path, 0, 1, None)
    with pytest.raises(sk.CommitConflict):
        sk.land_append_commit(other, path, 0, 2, None)
    assert sk.read_commits(spark, path).count() == 10
    assert tuple(sk.land_append_commit(first, path, 0, 3, None).first())[2:4] == (1, 10)


def test_writers_at_the_same_time_lose_no_row(spark, tmp_path):
    path, n = str(tmp_path / "c"), 6

    def write(i):
        return sk.append_commit(spark.range(i * 100, i * 100 + 10 + i).coalesce(1), path, 1000 + i)

    with ThreadPoolExecutor(n) as pool:
        ids = list(pool.map(write, range(n)))
    assert sorted(ids) == list(range(n))
    table = sk.read_commits(spark, path)
    assert sorted(r["id"] for r in table.collect()) == [x for i in range(n) for x in range(i * 100, i * 100 + 10 + i)]
    audited = vf.commit_chain_audit(sk.read_commit_log(spark, path)).collect()
    assert len(audited) == n and all(r["chain_ok"] for r in audited)


def test_put_if_absent_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "log" / "x.json")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: sk.store.put_if_absent(spark, path, f"writer {i}"), range(24)))
    assert won.count(True) == 1 and (tmp_path / "log" / "x.json").read_text() == f"writer {won.index(True)}"
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["x.json"]


# -- equality and certificates


def test_content_hash_ignores_order_not_content(spark, make):
    rows = [(i, f"s{i}", i / 3) for i in range(50)] + [(None, None, None)]
    df = make("a int, s string, x double", rows)
    same = df.orderBy(F.desc("a")).select("x", "s", "a").repartition(5)
    for portable in (False, True):
        a, b = vf.content_hash(df.drop("x"), portable).first(), vf.content_hash(same.drop("x"), portable).first()
        assert a == b
    assert vf.content_hash(df).first() == vf.content_hash(same).first()
    nudged = df.withColumn("x", F.col("x") + 1e-9)
    assert vf.content_hash(df).first() == vf.content_hash(nudged).first()
    moved = df.withColumn("s", F.when(F.col("a") == 3, "other").otherwise(F.col("s")))
    assert vf.content_hash(df).first() != vf.content_hash(moved).first()
    left, right = make("a int, b int", [(None, 1)]), make("a int, b int", [(1, None)])
    assert vf.content_hash(left).first() != vf.content_hash(right).first()
    assert tuple(vf.content_hash(df.limit(0)).first()) == (0, "0")


def test_hash_sum_is_exact(spark):
    values = [2**63 - 1, -(2**63), -1, 0, 123456789012345678, -987654321098765432]
    df = spark.createDataFrame([(v,) for v in values], "h bigint")
    assert df.agg(vf._hash_sum(F.col("h")).alias("t")).first()["t"] == str(sum(values))


def test_answer_and_workload_equality(make):
    df = make("dst_port int, src_ip string", [(3389, "a")] * 125 + [(443, "b")] * 875)
    short = df.limit(999)
    same = vf.answer_equality(vf.workload_answers(df, "x").unionByName(vf.workload_answers(df.repartition(3), "y")))
    got = {r["query"]: (r["answer"], r["status"]) for r in same.collect()}
    assert got["total"] == ("1000", "pass") and got["needle"] == ("125", "pass")
    differ = vf.answer_equality(vf.workload_answers(df, "x").unionByName(vf.workload_answers(short, "y")))
    assert {r["query"]: r["status"] for r in differ.collect()}["total"] == "fail"
    alone = vf.answer_equality(vf.workload_answers(df, "x"))
    assert {r["status"] for r in alone.collect()} == {"unmeasured"}
    assert tuple(vf.workload_equality(df, df).first()) == (0, 0, True)
    assert tuple(vf.workload_equality(df, short).first()) == (1, 0, False)


def test_certificates(make):
    rows = [
        ("a", "d1", "quality", "pass"), ("a", "d1", "flow", "pass"),
        ("b", "d1", "config_integrity", "fail"), ("b", "d1", "flow", "pass"),
        ("c", "d1", "quality", "fail"), ("c", "d1", "flow", "stale"), ("c", "d1", "quality", "fail"),
        ("d", "d1", "quality", "stale"), ("e", "d1", "quality", "unmeasured"), ("f", "d1", "quality", None),
    ]
    got = vf.certify(make("table_name string, day string, check string, status string", rows))
    head = {r["table_name"]: (r["headline"], r["deploy_ok"], r["blockers"]) for r in got.collect()}
    assert head == {
        "a": ("green", True, ""),
        "b": ("deploy blocked", False, "config_integrity"),
        "c": ("not certified", True, "quality"),
        "d": ("stale", True, ""),
        "e": ("unproven", True, ""),
        "f": ("unproven", True, ""),
    }
