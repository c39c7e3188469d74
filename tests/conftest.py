from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from siftlake.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def make(spark):
    """A DataFrame from rows and a DDL schema."""

    def build(schema: str, rows: list):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture()
def column(spark):
    """Values of a column expression over single-column rows."""

    def run(expression, values, data_type="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {data_type}")
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return run


def as_dicts(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
