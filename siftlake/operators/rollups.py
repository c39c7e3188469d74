"""Rollup rows that any window can be read from: counts and sums, and mergeable sketches as binary columns.

A row per slot and key is written once per batch of events; a window over any number of slots merges rows, without
reading events again. Rows of one slot that came in several batches merge as well, so late events need no rewrite.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_MS = 300_000
#: Registers of the distinct sketch as a power of two: a standard error of 0.8 %. Sketches of few values stay short.
DISTINCT_LG_K = 14
#: Size of the quantile sketch: the rank of what it returns is off by less than 1 %.
QUANTILE_K = 400
#: Items that the top-k sketch tracks; up to three quarters as many distinct ones are counted exactly, beyond that a
#: count is off by at most 3.5 / TRACKED of the rows.
TRACKED = 1024


def slot_of(time_ms: Column, slot_ms: int = SLOT_MS) -> Column:
    """The start of the slot that a time lies in; also right for times before 1970."""
    return time_ms - F.pmod(time_ms, F.lit(slot_ms))


def rollup_rows(
    events: DataFrame, keys: Sequence[str], distinct: str, measure: str, item: str, slot_ms: int = SLOT_MS
) -> DataFrame:
    """A row per slot and keys: n, total (sum of measure), and sketches of distinct, of measure and of item.

    Nulls enter neither a sum nor a sketch; rows without a time have no slot and make a row of their own.
    """
    return events.groupBy(slot_of(F.col("time"), slot_ms).alias("slot_ms"), *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(measure).alias("total"),
        F.hll_sketch_agg(distinct, DISTINCT_LG_K).alias("distinct_sketch"),
        F.kll_sketch_agg_bigint(F.col(measure).cast("bigint"), QUANTILE_K).alias("quantile_sketch"),
        F.expr(f"approx_top_k_accumulate(`{item}`, {TRACKED}) FILTER (WHERE `{item}` IS NOT NULL)").alias("top_sketch"),
    )


def read_windows(rollups: DataFrame, keys: Sequence[str], window: Column, quantile: float = 0.5, k: int = 3) -> DataFrame:
    """Rollup rows merged by window and keys: n, total, distinct_estimate, quantile_estimate (null without values) and
    top (items with counts, the highest first)."""
    merged = rollups.groupBy(window.alias("window_ms"), *keys).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_estimate"),
        F.kll_merge_agg_bigint("quantile_sketch").alias("q"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(top_sketch, {TRACKED}), {k})").alias("top"),
    )
    held = F.kll_sketch_get_n_bigint("q") > 0
    estimate = F.when(held, F.kll_sketch_get_quantile_bigint("q", F.lit(float(quantile))))
    return merged.withColumn("quantile_estimate", estimate).drop("q")
