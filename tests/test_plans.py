"""The catalogue as a whole: coverage of names, plan shape, and SQL agreement on a few queries."""

from __future__ import annotations

import importlib.util
import os
import sys

import duckdb
import pytest
from conftest import ROOT, SMALL

from siftlake.plans import catalog
from siftlake.plans import tables as t

catalog.load()
STREAMS = {n for n in catalog.QUERIES if n.startswith("stream_")} | {"field_drift_stream"}
WRITERS = {
    "read_ndjson", "read_ndjson_tolerant", "read_zeek_tsv", "read_mapping_csv", "write_parquet", "land_replace",
    "land_append_commit", "read_as_of", "compact_commits", "list_table_files", "footprint_by_source", "orphan_files",
    "small_files", "cluster_layout", "zorder_layout", "workload_equality", "answer_equality", "swap_format_equality",
    "content_hash_fast", "promote_pipeline", "table_audit", "field_diff", "drift_at_risk", "drift_status", "needle_skipping", "zone_map_range",
    "zorder_quantile_layout",
}
LAZY = sorted(set(catalog.QUERIES) - STREAMS - WRITERS)


def load_module(path):
    spec = importlib.util.spec_from_file_location(os.path.basename(path)[:-3], path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = module
    spec.loader.exec_module(module)
    return module


def final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    entry = load_module(os.path.join(ROOT, "__spark_entry__.py"))
    found = entry.entry(spark)
    assert found.columns == ["src_ip", "dst_ip", "connections", "avg_bytes_out"]
    assert found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("part", range(6))
def test_plans_stay_in_the_jvm_and_never_cross_join(spark, part):
    bad = {}
    for name in LAZY[part::6]:
        plan = final_plan(catalog.QUERIES[name](spark, SMALL))
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "Python ", "ArrowEval", "InPandas"):
            if word in plan:
                bad.setdefault(name, []).append(word)
    assert bad == {}


def test_needle_is_pushed_to_the_scan(spark):
    needle = spark.read.parquet(f"{SMALL}/events.parquet").filter("event_type = 'error'").groupBy("user_id").count()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in final_plan(needle)
    plan = final_plan(catalog.QUERIES["detect_exfil_egress"](spark, SMALL))
    schema = plan[plan.index("ReadSchema") :].splitlines()[0]
    assert "props" not in schema and "value" in schema


def test_hunts_over_all_classes_take_one_scan_per_source(spark):
    plan = final_plan(catalog.QUERIES["run_detections"](spark, SMALL))
    assert plan.count("FileScan parquet") == 2
    assert "WindowGroupLimit" in plan


def test_class_partitions_are_pruned(spark, tmp_path):
    from siftlake.operators.detections import BY_ID, findings, run_detections
    from siftlake.sources.sinks import land_replace

    landed = land_replace(t.ocsf(spark, SMALL), str(tmp_path / "ocsf"))
    plan = final_plan(findings(landed, BY_ID["lsass_credential_access"]))
    assert "PartitionFilters: [isnotnull(class_uid" in plan
    assert "dst_port" not in plan
    every = final_plan(run_detections(landed))
    assert "PartitionFilters: [class_uid" in every and " IN (1007,3002,4001,6003)" in every


def test_top_peers_are_limited_before_the_shuffle(spark):
    plan = final_plan(catalog.QUERIES["top_n_per_entity"](spark, SMALL))
    assert plan.count("WindowGroupLimit") == 2


def test_profile_reads_the_table_once(spark):
    plan = final_plan(catalog.QUERIES["analyze_table"](spark, SMALL))
    assert plan.count("FileScan parquet") == 2  # events and documents, once each


CHECKED = [
    "detect_c2_beacon", "correlate_ordered", "cidr_join", "resolve_entities", "dq_scorecard", "coverage_status",
    "normalize_cloudtrail", "safe_key", "stream_rollup", "certify", "mapping_type_lint", "flow_golden_signals",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_its_sql(spark, con, name):
    check = load_module(os.path.join(ROOT, "tools", "check_oracles.py"))
    outcome = check.compare(spark, con, name, SMALL)
    assert outcome.startswith("ok"), outcome


def test_every_oracle_parses_and_runs(con):
    for name, text in catalog.ORACLES.items():
        con.execute(f"SELECT count(*) FROM ({text})").fetchone(), name
