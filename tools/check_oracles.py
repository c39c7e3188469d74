"""Run queries next to their SQL on DuckDB and report rows, columns and values that differ.

    python tools/check_oracles.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftlake.plans import catalog  # noqa: E402
from siftlake.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canonical(rows: list[tuple]) -> list[tuple]:
    def cell(v: object) -> str:
        if v is None:
            return "∅"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = canonical([tuple(r[c] for c in columns) for r in df.collect()])
    if name not in catalog.ORACLES:
        return f"rows={len(mine)} (no SQL)"
    result = con.execute(catalog.ORACLES[name])
    theirs_columns = [d[0] for d in result.description]
    if sorted(theirs_columns) != columns:
        return f"FAIL columns {columns} vs {sorted(theirs_columns)}"
    order = [theirs_columns.index(c) for c in columns]
    theirs = canonical([tuple(r[i] for i in order) for r in result.fetchall()])
    if mine == theirs:
        return f"ok rows={len(mine)}" + (" EMPTY" if not mine else "")
    only_a, only_b = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
    return f"FAIL rows {len(mine)} vs {len(theirs)} {columns}\n    spark {only_a}\n    sql   {only_b}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--plain", action="store_true", help="a session with Spark's own defaults")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    catalog.load()
    if args.plain:
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        settings = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
        spark = build_session("check", "local[8]", **{"spark.ui.showConsoleProgress": "false"}, **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    failed = []
    for name in args.names or catalog.QUERIES:
        start = time.perf_counter()
        try:
            outcome = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            outcome = "FAIL " + type(error).__name__ + " " + str(error)[:700]
        if "FAIL" in outcome:
            failed.append(name)
        print(f"{name:34} {time.perf_counter() - start:5.1f}s {outcome}", flush=True)
    print(f"{len(args.names or catalog.QUERIES)} queries, {len(catalog.ORACLES)} with SQL, failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
