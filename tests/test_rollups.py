"""Rollup rows with sketches: any window is read from them, within the stated errors."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftlake.operators import rollups as rl

SCHEMA = "time long, class_uid int, src_ip string, bytes_out long, dst_port int, slot_ms string"
KEYS = ["class_uid"]


def made(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [
        (
            rng.randrange(-3_600_000, 7_200_000),
            4001 if rng.random() < 0.6 else 3002,
            f"10.0.{rng.randrange(40)}.{rng.randrange(200)}" if rng.random() < 0.9 else None,
            int(rng.paretovariate(1.1) * 100) if rng.random() < 0.9 else None,
            rng.choice([443, 443, 443, 80, 80, 22]) if rng.random() < 0.8 else None,
            "x",
        )
        for _ in range(n)
    ]


def rows_of(spark, rows):
    return rl.rollup_rows(spark.createDataFrame(rows, SCHEMA), KEYS, "src_ip", "bytes_out", "dst_port")


@pytest.mark.parametrize("width", [300_000, 3_600_000])
def test_windows_of_two_batches(spark, width):
    first, second = made(12_000, 1), made(8_000, 2)
    stored = rows_of(spark, first).unionByName(rows_of(spark, second))
    got = rl.read_windows(stored, KEYS, rl.slot_of(F.col("slot_ms"), width)).collect()
    groups: dict = {}
    for r in first + second:
        groups.setdefault((r[0] // width * width, r[1]), []).append(r)
    assert {(r.window_ms, r.class_uid) for r in got} == set(groups)
    for r in got:
        own = groups[r.window_ms, r.class_uid]
        values = sorted(x[3] for x in own if x[3] is not None)
        sources, ports = {x[2] for x in own} - {None}, Counter(x[4] for x in own if x[4] is not None)
        assert (r.n, r.total) == (len(own), sum(values))
        assert abs(r.distinct_estimate - len(sources)) <= 0.05 * len(sources)
        below, upto = (sum(v < r.quantile_estimate for v in values), sum(v <= r.quantile_estimate for v in values))
        assert below <= 0.52 * len(values) and upto >= 0.48 * len(values)
        assert [x["count"] for x in r.top] == [n for _, n in ports.most_common(3)]
        assert all(ports[x["item"]] == x["count"] for x in r.top)


def test_empty_null_and_odd_rows(spark):
    assert rows_of(spark, []).collect() == []
    assert rl.read_windows(rows_of(spark, []), KEYS, F.col("slot_ms")).collect() == []
    rows = [(None, None, None, None, None, None)] * 2 + [(-1, 3002, "10.0.0.1", None, None, "x")] * 3
    got = rl.read_windows(rows_of(spark, rows), KEYS, F.col("slot_ms")).collect()
    kept = {r.window_ms: (r.class_uid, r.n, r.total, r.distinct_estimate, r.quantile_estimate, r.top) for r in got}
    assert kept == {None: (None, 2, None, 0, None, []), -300_000: (3002, 3, None, 1, None, [])}


def test_one_exchange_a_read(spark):
    """Reading a window groups the rows once and joins nothing."""
    plan = rl.read_windows(rows_of(spark, made(10, 3)), KEYS, F.col("slot_ms"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and "Window" not in text.replace("window_ms", "")
