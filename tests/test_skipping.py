"""The skipping index: no file that holds a value is ever left out, and few others are opened."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftlake.sources import files as fl
from siftlake.sources import skipping as sp


@pytest.fixture()
def folders(tmp_path):
    return str(tmp_path / "table"), str(tmp_path / "index")


def holding(spark, table, column, value):
    return {r["file_key"] for r in fl.files_of(spark.read.parquet(table).where(F.col(column) == value)).collect()}


def opened(spark, table, index, column, value):
    keep = sp.holds_any(spark.read.parquet(index), column, [value])
    return {r["file_key"] for r in sp.files_to_open(spark, table, index, keep).collect()}


def test_no_value_of_any_type_is_missed(spark, make, folders):
    table, index = folders
    rng = random.Random(7)
    day = dt.datetime(2024, 1, 1)
    rows = [
        (rng.choice([None, f"name{rng.randint(0, 90)}", ""]), rng.choice([None, rng.randint(-50, 50)]),
         rng.choice([None, -0.0, float("nan"), rng.random()]), day + dt.timedelta(hours=rng.randint(0, 90)), None)
        for _ in range(300)
    ]
    df = make("name string, n int, x double, at timestamp, nothing string", rows)
    df.repartition(6).write.parquet(table)
    assert sp.extend_index(spark, table, index, ["name", "n", "x", "at", "nothing"]) == 6
    for position, column in enumerate(("name", "n", "x", "at")):
        for value in sorted({r[position] for r in rows if r[position] is not None}, key=str)[:12]:
            assert holding(spark, table, column, value) <= opened(spark, table, index, column, value), (column, value)
    zeros = holding(spark, table, "x", -0.0)  # asked with the other zero, Spark's own filter passes over dictionary pages
    assert zeros and zeros <= opened(spark, table, index, "x", 0.0)
    assert opened(spark, table, index, "nothing", "x") == set()
    assert sp.needle_rows(spark, table, index, "nothing", ["x"]).collect() == []


def test_few_files_without_the_value_are_opened(spark, folders):
    """40,000 values dealt over 20 files without order: the range says nothing, the filter nearly all."""
    table, index = folders
    spark.range(40_000).select(F.concat(F.lit("h"), F.xxhash64("id").cast("string")).alias("v")).repartition(20).write.parquet(table)
    sp.extend_index(spark, table, index, ["v"])
    kept = spark.read.parquet(index)
    values = [r["v"] for r in spark.read.parquet(table).orderBy("v").limit(25).collect()]
    rows = kept.select(*[F.sum(sp.holds_any(kept, "v", [v]).cast("int")) for v in values]).first()
    assert all(n >= 1 for n in rows) and sum(rows) <= len(values) + 0.03 * 20 * len(values)
    absent = kept.select(*[F.sum(sp.holds_any(kept, "v", [f"h{i}"]).cast("int")) for i in range(50)]).first()
    assert sum(absent) <= 0.03 * 20 * 50
    sizes = {len(r["v"]["bloom"]) for r in kept.collect()}
    assert all(s & (s - 1) == 0 and 500 <= s <= 1024 for s in sizes)
    found = sp.needle_rows(spark, table, index, "v", values[:3])
    assert sorted(r["v"] for r in found.collect()) == values[:3]
    assert fl.files_of(found).count() <= 3


def test_files_the_index_does_not_know_are_opened(spark, folders):
    table, index = folders
    spark.range(100).repartition(2).write.parquet(table)
    assert sp.extend_index(spark, table, index, ["id"]) == 2
    spark.range(100, 200).repartition(2).write.mode("append").parquet(table)
    assert sp.needle_rows(spark, table, index, "id", [150, 3]).count() == 2
    assert len(opened(spark, table, index, "id", -1)) == 2
    assert sp.extend_index(spark, table, index, ["id"]) == 2 and sp.extend_index(spark, table, index, ["id"]) == 0
    assert opened(spark, table, index, "id", -1) == set()
    assert sp.needle_rows(spark, table, index, "id", [150, 3]).count() == 2
    overlap = sp.files_to_open(spark, table, index, sp.overlaps("id", 500, 600))
    assert overlap.count() == 0 and sp.read_files(spark, table, overlap).columns == ["id"]


def test_ranks_spread_skewed_columns(spark, tmp_path):
    """A column with most rows in a few small values prunes by its ranks as a uniform one; nulls stay."""
    from siftlake.sources import sinks as sk

    u = lambda seed: F.rand(seed)
    rows = spark.range(20_000).select(
        "id", F.floor(u(1) * 1_000_000).alias("even"), F.floor(F.exp(u(2) * 18)).cast("long").alias("skewed"),
        F.when(u(3) < 0.9, F.floor(u(4) * 1000)).alias("third"),
    ).repartition(4)
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    path = str(tmp_path / "z")
    columns = ["even", "skewed", "third"]
    table = sk.z_layout(rows, path, [F.col(c) for c in columns], bits=6, files=64)
    assert table.count() == 20_000 and table.exceptAll(rows).count() == 0 and table.columns == rows.columns
    zones = sp.index_files(spark.read.parquet(path), columns)
    for column in columns:
        value = rows.where(F.col(column).isNotNull()).agg(F.percentile_approx(column, 0.4)).first()[0]
        n = zones.where(sp.overlaps(column, value, value)).count()
        assert 1 <= n <= 32, (column, n)
    empty = sk.z_layout(rows.limit(0), str(tmp_path / "none"), [F.col("even")])
    assert empty.count() == 0
    with pytest.raises(ValueError):
        sk.interleave([F.col("even")] * 9, 8)


def test_files_hold_whole_cells(spark, tmp_path):
    """A range within the top quarter of a column opens a quarter of the files, whatever sample a range would be cut by."""
    from siftlake.sources import sinks as sk

    rows = spark.range(40_000, numPartitions=3).select(*[F.floor(F.rand(i) * 1_000_000).alias(f"c{i}") for i in range(3)])
    rows.write.parquet(str(tmp_path / "rows"))
    rows, path = spark.read.parquet(str(tmp_path / "rows")), str(tmp_path / "z")
    table = sk.z_layout(rows, path, [F.col(c) for c in rows.columns], bits=6, files=64)
    assert table.count() == 40_000 and table.exceptAll(rows).count() == 0
    zones = sp.index_files(spark.read.parquet(path), rows.columns).cache()
    assert zones.count() == 64 and zones.agg(F.max("n_rows")).first()[0] < 1.5 * 40_000 / 64
    for c in rows.columns:
        assert zones.where(sp.overlaps(c, 860_000, 1_000_000)).count() <= 20


def test_equal_and_nested_keys_fill_the_files(spark, tmp_path):
    """Few keys over many files, all rows of one key, fewer rows than files, and values that rise together."""
    from siftlake.sources import sinks as sk

    cases = [(F.col("id") % 3, 16), (F.lit(5).cast("long"), 7), (F.when(F.col("id") > 9, F.col("id")), 100), (F.col("id"), 13)]
    for i, (value, files) in enumerate(cases):
        rows = spark.range(3 if files == 100 else 4_000).select("id", value.alias("v"))
        path = str(tmp_path / str(i))
        table = sk.z_layout(rows, path, [F.col("v"), F.col("v")], files=files)
        assert sorted(map(tuple, table.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
        zones = sp.index_files(spark.read.parquet(path), ["v"]).collect()
        assert len(zones) == files or files == 100
        if files != 100:
            assert max(r["n_rows"] for r in zones) <= 2.5 * 4_000 / files


def test_a_table_is_read_in_passes_and_listed_once_it_is_whole(spark, tmp_path, monkeypatch):
    """No scan of all files at a time, no listing per needle, and no job with a task per folder."""
    from siftlake.plans import scans as sc

    days = spark.range(2_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id")).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 300).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"),
    )
    days.write.parquet(str(tmp_path / "events.parquet"))
    listed, scanned, list_files, index_files = [], [], fl.list_table_files, sp.index_files
    for module in (fl, sp):
        monkeypatch.setattr(module, "list_table_files", lambda *a: listed.append(a) or list_files(*a))
    monkeypatch.setattr(sp, "index_files", lambda scan, c: scanned.append(len(scan.inputFiles())) or index_files(scan, c))
    monkeypatch.setattr(sp, "FILES_AT_ONCE", 7, raising=False)
    monkeypatch.setattr(sc, "BLOCK_EVENTS", 50)
    got = {r["needle"]: tuple(r)[1:] for r in sc._needle_skipping(spark, str(tmp_path)).collect()}
    ids = [i for i in range(2_000) if i % 300 == 7 and i % 97]
    assert got["10.0.0.7"] == (len(ids), len({i // 50 for i in ids}), 0, True, 40)
    assert got["no address"] == got["10.0.9.9"] == (0, 0, 0, True, 40)
    assert max(scanned) <= 7 and sum(scanned) == 40
    assert len(listed) == 3
    with fl.light_listing(spark):
        assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "200"
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
