from __future__ import annotations

import json

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from siftlake.sources import sinks as sk
from siftlake.streaming import streams as st


def line(second, result="FAILURE"):
    return json.dumps({"published": f"2026-03-01T00:00:{second:02d}Z", "eventType": "user.session.start",
                       "outcome": {"result": result}, "actor": {"alternateId": "a"}, "client": {"ipAddress": "1.1.1.1"}})


def test_landing_resumes_and_lands_each_line_once(spark, tmp_path):
    raw, table, mark = tmp_path / "raw", str(tmp_path / "table"), str(tmp_path / "mark")
    raw.mkdir()
    (raw / "1.log").write_text("\n".join([line(1), line(2), "not json", ""]))

    def run():
        st.stream_normalize_land(spark, str(raw), table, mark, lambda batch: 1000 + batch).awaitTermination()

    run()
    (raw / "2.log").write_text(line(3, "SUCCESS"))
    run()
    run()
    log = sk.read_commit_log(spark, table).orderBy("commit_id").collect()
    assert [(r["commit_id"], r["parent_id"], r["added_records"]) for r in log] == [(0, None, 2), (1, 0, 1)]
    assert sk.read_commits(spark, table).count() == 3
    assert [r["value"] for r in spark.read.text(f"{table}/quarantine").collect()] == ["not json"]


@pytest.fixture()
def feed(spark, tmp_path):
    """Files that a stream picks up one by one."""

    def build(schema, batches):
        path = str(tmp_path / "feed")
        for i, rows in enumerate(batches):
            df = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
            df.coalesce(1).write.mode("append" if i else "errorifexists").parquet(path)
        one = spark.read.parquet(path).schema
        return spark.readStream.schema(one).option("maxFilesPerTrigger", 1).parquet(path)

    return build


def test_minute_volume_over_several_batches(spark, feed, tmp_path):
    first = [("2026-03-01 00:00:01Z", "a")] * 2 + [("2026-03-01 00:00:59Z", "b")]
    second = [("2026-03-01 00:00:30Z", "a"), ("2026-03-01 00:01:00Z", "a")]
    stream = feed("ts string, source string", [first, second])
    path, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    st.stream_minute_volume(stream, path, mark).awaitTermination()
    got = {(r["minute_ms"] % 3_600_000, r["source"]): r["n"] for r in st.read_minute_volume(spark, path, mark).collect()}
    assert got == {(0, "a"): 3, (0, "b"): 1, (60_000, "a"): 1}


def test_every_row_is_counted_or_reported_late(spark, feed, tmp_path):
    first = [("2026-03-01 00:00:01Z", "a")] * 2 + [("2026-03-01 01:00:00Z", "b")]
    second = [("2026-03-01 00:00:30Z", "a"), ("2026-03-01 00:58:00Z", "a")]
    third = [("2026-03-01 00:00:40Z", "b"), ("2026-03-01 02:00:00Z", "b"), ("2026-03-01 00:00:41Z", "a")]
    stream = feed("ts string, source string", [first, second, third])
    path, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    st.stream_minute_volume(stream, path, mark).awaitTermination()
    counted = {r["source"]: r["n"] for r in st.read_minute_volume(spark, path, mark).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    late = {r["source"]: r["n_late"] for r in st.read_late_rows(spark, path, mark, ["source"]).collect()}
    # the second batch still finds its window in the state, which closes at that batch's end
    assert counted == {"a": 4, "b": 2} and late == {"a": 1, "b": 1}


def test_windows_close_once_and_restart_from_the_state(spark, tmp_path):
    feed, path, mark = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "mark")

    def arrive(*rows):
        df = spark.createDataFrame(list(rows), "ts string, source string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema("ts timestamp, source string").parquet(feed)
        st.stream_minute_volume(stream, path, mark).awaitTermination()
        return {(r["minute_ms"] // 60_000 % 1440, r["source"]): r["n"] for r in st.read_minute_volume(spark, path, mark).collect()}

    def minutes(df):
        return sorted(r["window_ms"] // 60_000 % 1440 for r in df.collect())

    assert arrive(("2026-03-01 00:00:01Z", "a"), ("2026-03-01 00:03:01Z", "a"), (None, "a")) == {(0, "a"): 1, (3, "a"): 1}
    assert minutes(st.open_windows(spark, mark, ["source"])) == [0, 3]
    # a second run goes on with the windows that the first has left open
    assert arrive(("2026-03-01 00:00:31Z", "a"), ("2026-03-01 00:07:00Z", "b")) == {(0, "a"): 2, (3, "a"): 1, (7, "b"): 1}
    assert minutes(st.open_windows(spark, mark, ["source"])) == [3, 7]
    assert minutes(spark.read.parquet(f"{path}/closed")) == [0]
    # the state holds no more than the watermark leaves open, and a late row changes no count
    after = arrive(("2026-03-01 02:00:00Z", "c"), ("2026-03-01 00:00:59Z", "a"), ("2026-03-01 00:03:59Z", "a"))
    assert after == {(0, "a"): 2, (3, "a"): 2, (7, "b"): 1, (120, "c"): 1}
    assert minutes(st.open_windows(spark, mark, ["source"])) == [120]
    assert minutes(spark.read.parquet(f"{path}/closed")) == [0, 3, 7]
    assert [tuple(r) for r in st.read_late_rows(spark, path, mark, ["source"]).collect()] == [("a", 1)]
    # what a batch wrote before it failed is not counted twice
    spark.createDataFrame([(0, "z", 5)], "window_ms bigint, source string, n bigint").write.parquet(f"{path}/closed/batch_id=999")
    assert "z" not in {r["source"] for r in st.read_minute_volume(spark, path, mark).collect()}


def test_dedup_reports_what_came_too_late(spark, feed, tmp_path):
    batches = [[("2026-03-01 01:00:00Z", 1)], [("2026-03-01 01:00:01Z", 2)], [("2026-03-01 00:00:01Z", 3)]]
    stream = feed("ts string, event_id int", batches)
    path = str(tmp_path / "out")
    run = st.stream_dedup(stream, ["event_id"], path, str(tmp_path / "mark"))
    run.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(path).collect()) == [1, 2]
    assert st.dropped_late(run) == 1


def test_dedup_across_batches(spark, feed, tmp_path):
    first = [("2026-03-01 00:00:01Z", 1), ("2026-03-01 00:00:01Z", 1), ("2026-03-01 00:00:02Z", 2)]
    second = [("2026-03-01 00:00:01Z", 1), ("2026-03-01 00:00:03Z", 3)]
    stream = feed("ts string, event_id int", [first, second])
    path = str(tmp_path / "out")
    st.stream_dedup(stream, ["event_id"], path, str(tmp_path / "mark")).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_failed_login_burst(spark, feed, tmp_path):
    def tries(src, n, status=2):
        return [(f"2026-03-01 00:00:{i:02d}Z", 3002, status, src) for i in range(n)]

    stream = feed(
        "ts string, class_uid int, status_id int, src_ip string",
        [tries("x", 3) + tries("y", 4) + tries("z", 9, status=1), tries("x", 2)],
    )
    path, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    st.stream_failed_auth_burst(stream, path, mark).awaitTermination()
    got = [(r["src_ip"], r["fails"]) for r in st.read_failed_auth_burst(spark, path, mark).collect()]
    assert got == [("x", 5)]


def test_rollup_equals_the_batch_answer(spark, feed, tmp_path):
    rows = [("2026-03-01 00:00:00Z", i % 3, i) for i in range(20)]
    stream = feed("ts string, k int, v int", [rows[:7], rows[7:]])
    path = str(tmp_path / "out")
    st.stream_rollup(stream, ["k"], path, str(tmp_path / "mark"), ["v"]).awaitTermination()
    got = {r["k"]: (r["n"], r["sum_v"]) for r in st.read_rollup(spark, path, ["k"], ["v"]).collect()}
    assert got == {k: (len(range(k, 20, 3)), sum(range(k, 20, 3))) for k in range(3)}


def test_drift_is_judged_per_batch(spark, tmp_path):
    path = tmp_path / "feed"
    good = {"Image": "a", "ProcessId": 1, "CommandLine": "x", "ParentImage": "p", "ParentProcessId": 2, "User": "u",
            "Computer": "c"}
    drifted = {k: v for k, v in good.items() if k != "CommandLine"}
    for event in (good, drifted):
        df = spark.createDataFrame([("sysmon", json.dumps(event))], "source string, value string")
        df.coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema("source string, value string").option("maxFilesPerTrigger", 1).parquet(str(path))
    events = stream.select("source", F.parse_json("value").alias("record"))
    out = str(tmp_path / "out")
    st.field_drift_stream(events, out, str(tmp_path / "mark")).awaitTermination()
    rows = as_dicts(spark.read.parquet(f"{out}/status").filter("source = 'sysmon'").orderBy("batch_id"))
    assert [(r["status"], r["n_at_risk"]) for r in rows] == [("pass", 0), ("fail", 2)]
