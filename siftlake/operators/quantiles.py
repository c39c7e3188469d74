"""Exact quantiles of integer columns without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.session import materialise

BUCKETS = 4096
#: Tasks that share the values of one key.
SALTS = 16


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles of an integer column per key, as columns ``q0, q1, …``.

    Values are first counted per (key, value) and the counts are written once, so that the table itself
    is read once; the steps after that read the counts. A key's range is cut into 4096 equal buckets, the bucket of
    each wanted rank is found from bucket counts, and that bucket is cut again, until no slice spans more than 4096
    integers: six rounds for the widest range there is. Only values in the final slices are ranked, so a task ranks
    4096 values at most, however many rows the key holds and however far an outlier lies.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("bigint").alias("v"))
    counted = counted.agg(F.count(F.lit(1)).alias("n"))
    shown = keys
    if not keys:
        keys, counted = ["all_rows"], counted.withColumn("all_rows", F.lit(True))
    counted = materialise(counted, "value-counts")
    bounds = counted.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    # one row per key and wanted rank (two ranks around each probability)
    position = [F.lit(float(p)) * (F.col("total") - 1) for p in probabilities]
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(p) + 1, F.ceil(p) + 1) for p in position]))
    wanted = bounds.select(*keys, "lo", "hi", "total", F.explode(ranks).alias("rank")).withColumn(
        "before", F.lit(0).cast("bigint")
    )
    widest = wanted.agg(F.max(_span())).first()[0] or 0
    while widest >= BUCKETS:
        wanted, widest = _narrow(counted, wanted, keys), widest // BUCKETS
    leaf = (
        _in_range(counted, wanted, keys)
        .withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*keys, "rank").orderBy("v")))
        .filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    )
    at = leaf.groupBy(*keys).agg(
        F.max("total").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"),
    )
    out = []
    for i, p in enumerate(probabilities):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        low = F.col("at")[F.floor(pos) + 1].cast("double")
        high = F.col("at")[F.ceil(pos) + 1].cast("double")
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(f"q{i}"))
    return at.select(*shown, *out)


def _span() -> Column:
    """hi - lo, which need not fit 64 bits."""
    return F.expr("CAST(hi AS DECIMAL(20, 0)) - CAST(lo AS DECIMAL(20, 0))")


def _in_range(counted: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Counted values next to each wanted rank whose range they fall in; the values of a key go to SALTS tasks."""
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copies = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "salt"]).drop("salt").filter(F.col("v").between(F.col("lo"), F.col("hi")))


def _narrow(counted: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Replace each wanted rank's range by the one of its equal-width buckets that holds the rank."""
    slices = wanted.withColumn("width", F.floor(_span() / BUCKETS).cast("bigint") + 1)
    bucket = F.expr("(CAST(v AS DECIMAL(20, 0)) - lo) div width")
    per_bucket = (
        _in_range(counted, slices, keys)
        .groupBy(*keys, "rank", "lo", "hi", "width", "before", "total", bucket.alias("bucket"))
        .agg(F.sum("n").alias("n"))
    )
    upto = F.col("before") + F.sum("n").over(W.partitionBy(*keys, "rank").orderBy("bucket"))
    chosen = per_bucket.withColumn("upto", upto).filter(
        (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))
    )
    low = F.col("lo") + F.col("bucket") * F.col("width")
    return chosen.select(
        *keys,
        low.alias("lo"),
        F.least(low + F.col("width") - 1, F.col("hi")).alias("hi"),
        "total",
        "rank",
        (F.col("upto") - F.col("n")).alias("before"),
    )
