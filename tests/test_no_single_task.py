"""Fixtures of queries are written by many tasks."""

from __future__ import annotations

from pathlib import Path

from conftest import SMALL
from pyspark.sql import functions as F

from siftlake.plans import scans, streams


def test_late_rows_are_numbered_without_a_window_over_all(make):
    rows = make("us long, event_id long", [(None if i % 50 == 7 else i * 7_919_000 % 600_000_000 // 1000, i) for i in range(400)])
    rows = rows.select(F.timestamp_millis("us").alias("ts"), "event_id")
    got = [r.event_id for r in streams._numbered(rows).orderBy("place").collect()]
    assert got == [r.event_id for r in rows.orderBy("ts", "event_id").collect()]
    assert sorted(r.place for r in streams._numbered(rows).collect()) == list(range(1, 401))


def test_late_rows_come_in_many_files_and_two_batches(spark, tmp_path, monkeypatch):
    made = {}

    def path_of(session, label):
        made[label] = str(tmp_path / label)
        return made[label]

    monkeypatch.setattr(streams, "scratch_path", path_of)
    monkeypatch.setattr(streams, "materialise", lambda df, label: df.repartition(3))
    streams._stream_late_rows(spark, SMALL).collect()
    assert len(list(Path(made["late-source"]).glob("part-*"))) > 2
    assert sorted(p.name for p in Path(made["late-volume"], "arrived").glob("batch_id=*")) == ["batch_id=0", "batch_id=1"]


def test_rotated_log_is_many_files_with_their_own_headers(spark):
    path = Path(scans._rotated_log(spark, SMALL))
    for order in "ab":
        files = list(path.glob(f"order={order}/*/part-*"))
        assert len(files) > 1
        for file in files:
            lines = file.read_text().splitlines()
            assert [x.startswith("#") for x in lines[:4]] == [True, True, True, False][: len(lines)]
            assert not any(x.startswith("#") for x in lines[3:])
