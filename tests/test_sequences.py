"""Chains of events by tables of buckets, against a plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftlake.operators.correlate import correlate_sequence


def plain(rows, k, within):
    out = {}
    for key in {r[0] for r in rows if r[0] is not None}:
        own = sorted((time, step) for x, time, step in rows if x == key and time is not None)
        ends = []
        for time, step in own:
            if step != k:
                continue
            alive = {t for t, s in own if s == 1 and time - within <= t <= time}
            chains = {(t, t) for t in alive}
            for j in range(2, k + 1):
                chains = {(a, t) for a, b in chains for t, s in own if s == j and b <= t <= time}
            if any(t == time for _, t in chains):
                ends.append(time)
        if ends:
            counts = [sum(s == j for _, s in own) for j in range(1, k + 1)]
            out[key] = (*counts, len(ends), min(ends), max(ends))
    return out


@pytest.mark.parametrize("k", [2, 3, 4])
def test_sequences_of_any_length_at_any_bucket(make, k):
    rng = random.Random(k)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(0, 400)]), rng.randint(0, k)) for _ in range(160)]
    rows += [("hot", rng.randint(0, 200), rng.randint(1, k)) for _ in range(40)] + [("tie", 5, j) for j in range(1, k + 1)]
    rows += [("late", 1000 * j, j) for j in range(1, k + 1)]
    events = make("src_ip string, time long, step int", rows)
    steps = [(f"n{j}", F.col("step") == j) for j in range(1, k + 1)]
    for bucket_ms in (1, 7, 86_400_000):
        got = correlate_sequence(events, steps, within_ms=30, bucket_ms=bucket_ms)
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain(rows, k, 30)


def test_sequence_reads_its_events_by_bucket(make):
    events = make("src_ip string, time long, step int", [("a", 1, 1), ("a", 2, 2), ("a", 3, None)])
    steps = [("x", F.col("step") == 1), ("y", F.col("step") == 2), ("z", F.col("step") == 1)]
    found = correlate_sequence(events, steps, within_ms=10)
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        correlate_sequence(events, steps[:1], within_ms=10)
