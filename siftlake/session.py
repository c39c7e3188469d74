"""Session settings and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_roots: dict[str, str] = {}


def build_session(app_name: str = "siftlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here expects; a cluster's own settings win where given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private folder only for a local master without one."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = sc.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="siftlake-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared area. Nothing is deleted or reused."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a result once and read it back, so that what follows does not recompute it.

    The copy is an ordinary table in the shared folder, so a lost executor costs only a re-read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small constant reference table, built inside the plan instead of shipped from Python rows."""
    fields = T.StructType.fromDDL(schema).fields
    if not rows:
        return spark.createDataFrame([], T.StructType(fields))
    structs = [
        F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _literal(value: object, data_type: T.DataType) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast(data_type)
    return F.lit(value).cast(data_type)
