"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then $BENCH_RUNS times; the median is reported, with the spread, and queries whose
spread is over 5 % are named as invalid. Before any time is taken, the answers of the fixed workload must agree between
two layouts of the flow table. `seconds_per_job` is what a job over one row costs here, which no query can go below.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftlake.operators import verify as vf  # noqa: E402
from siftlake.plans import catalog  # noqa: E402
from siftlake.plans import tables as t  # noqa: E402
from siftlake.session import build_session, scratch_path  # noqa: E402
from siftlake.sources.sinks import cluster_layout  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
#: A query whose spread is above this share of its mean has no valid time.
SPREAD = 0.05

HEADLINE = (
    "count_all", "needle_count", "group_port_distribution", "distinct_src_ip", "top_talkers", "byte_rollup",
    "cidr_match", "cidr_join", "class_rollup", "five_minute_series", "failed_auth_by_user",
    "detect_c2_beacon", "detect_exfil_egress", "detect_credential_stuffing", "run_detections",
    "analyze_table", "entity_profile", "top_n_per_entity", "correlate_auth_net", "correlate_ordered",
    "normalize_okta", "normalize_zeek_conn", "normalize_cloudtrail", "mfa_unprotected_structural",
    "dq_scorecard", "source_volume_health", "flow_golden_signals", "flow_reconcile", "roundtrip_validate",
    "gap_exact", "resolve_entities", "derive_counters", "coverage_status", "mapping_type_lint", "certify",
    "land_replace", "compact_commits", "stream_minute_volume",
)


def run_once(spark, name: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def job_cost(spark) -> float:
    times = []
    for _ in range(20):
        start = time.perf_counter()
        spark.range(1).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 4)


def answers_agree(spark) -> bool:
    flows = t.flows(spark, SF_DIR)
    copy = cluster_layout(flows, scratch_path(spark, "bench-sorted"), ["dst_port", "src_ip"])
    answers = vf.workload_answers(flows, "source").unionByName(vf.workload_answers(copy, "sorted"))
    return vf.answer_equality(answers).filter("status <> 'pass'").count() == 0


def main() -> None:
    catalog.load()
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    equal = answers_agree(spark)
    medians, spread = {}, {}
    for name in HEADLINE:
        run_once(spark, name)
        times = [run_once(spark, name) for _ in range(RUNS)]
        medians[name] = round(statistics.median(times), 4)
        mean = statistics.fmean(times)
        spread[name] = round(statistics.pstdev(times) / mean, 3) if mean else 0.0
    rows, per_job = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count(), job_cost(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(medians.values()), 3),
                "unit": "sec",
                "queries": medians,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "runs": RUNS,
                "flow_rows": rows,
                "answers_equal": equal,
                "coefficient_of_variation": spread,
                "invalid": sorted(name for name, s in spread.items() if s > SPREAD),
                "seconds_per_job": per_job,
            }
        )
    )


if __name__ == "__main__":
    main()
