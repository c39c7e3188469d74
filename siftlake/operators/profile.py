"""Table profile: counts, low-cardinality breakdowns, top sources and the time bounds, in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.text import safe_key, safe_key_of
from siftlake.operators.schema import SOURCE_FIELDS, TIME_FIELDS, first_present

TOP_N_SOURCES = 10


def count_all(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def group_distribution(df: DataFrame, field: str) -> DataFrame:
    """Count per value, largest first, ties by value."""
    counted = df.groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), F.asc_nulls_first(field))


def distinct_count(df: DataFrame, field: str, approximate: bool = False) -> DataFrame:
    """Exact by default. The sketch is an option and does not belong in an equality check."""
    counted = F.approx_count_distinct(field) if approximate else F.count_distinct(field)
    return df.agg(counted.alias("n_distinct"))


def enum_key(df: DataFrame, field: str) -> Column:
    """An enum as its digits; anything else as a safe key, NULL as ``<null>``."""
    return F.coalesce(F.col(f"`{field}`").try_cast("int").cast("string"), safe_key_of(df, field))


def by_enum(df: DataFrame, field: str) -> DataFrame:
    """Count per enum value with NULL shown."""
    return df.groupBy(enum_key(df, field).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def top_sources(df: DataFrame, top_n: int = TOP_N_SOURCES) -> DataFrame:
    """Most frequent sources; NULL is not a source."""
    field = first_present(df, SOURCE_FIELDS)
    if field is None:
        raise ValueError("no source field present")
    counted = df.filter(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), F.asc(field)).limit(top_n)
    return top.select(safe_key(F.col(field)).alias("source"), "n")


def time_span(df: DataFrame) -> DataFrame:
    """Bounds of the first present time field."""
    field = first_present(df, TIME_FIELDS)
    if field is None:
        raise ValueError("no time field present")
    c = F.col(f"`{field}`")
    return df.agg(F.lit(field).alias("field"), F.min(c).alias("first_time"), F.max(c).alias("last_time"))


def field_population(df: DataFrame) -> DataFrame:
    """Non-null and null counts per column, from one aggregate row."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    )
    rows = [
        F.struct(
            F.lit(c).alias("field"),
            F.col(f"c{i}").alias("non_null"),
            (F.col("__n") - F.col(f"c{i}")).alias("null_count"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counts.select(F.inline(F.array(*rows)))


def analyze_table(df: DataFrame, top_n: int = TOP_N_SOURCES) -> tuple[DataFrame, list[str]]:
    """The whole profile as tidy rows ``(view, key, n, first_time, last_time)``, and the skipped views.

    The table is read once and reduced to (class, activity, source) groups; the views are grouping
    sets over those groups. A column that is absent makes its view skipped, not zero.
    """
    source, time = first_present(df, SOURCE_FIELDS), first_present(df, TIME_FIELDS)
    dims: dict[str, Column] = {}
    skipped = []
    for view, field in (("by_class", "class_uid"), ("by_activity", "activity_id")):
        if field in df.columns:
            dims[view] = enum_key(df, field)
        else:
            skipped.append(field)
    if source:
        dims["top_sources"] = F.col(source).cast("string")
    else:
        skipped.append("top_sources")
    if not time:
        skipped.append("time_span")
    time_col = F.col(f"`{time}`") if time else F.lit(None).cast("bigint")

    base = df.groupBy(*[c.alias(v) for v, c in dims.items()]).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(time_col).alias("first_time"),
        F.max(time_col).alias("last_time"),
        *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    views = list(dims)
    # a group of no rows keeps the totals there when the table is empty
    nothing = df.sparkSession.range(1).select(
        *[F.lit(None).cast("string").alias(v) for v in views],
        F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast(base.schema["first_time"].dataType).alias("first_time"),
        F.lit(None).cast(base.schema["last_time"].dataType).alias("last_time"),
        *[F.lit(0).cast("bigint").alias(f"c{i}") for i in range(len(df.columns))],
    )
    rolled = base.unionByName(nothing).groupingSets([[v] for v in views] + [[]], *views).agg(
        F.grouping_id().alias("gid"),
        F.sum("n").alias("n"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(df.columns))],
    )
    none_grouped = (1 << len(views)) - 1

    def row(view: str, key: Column, n: Column) -> Column:
        return F.struct(
            F.lit(view).alias("view"),
            key.cast("string").alias("key"),
            F.coalesce(n, F.lit(0)).cast("bigint").alias("n"),
        )

    whole = [row("row_count", F.lit(""), F.col("n"))]
    whole += [row("non_null", F.lit(c), F.col(f"c{i}")) for i, c in enumerate(df.columns)]
    out = F.array(*whole)
    for i, view in enumerate(views):
        mine = none_grouped & ~(1 << (len(views) - 1 - i))
        out = F.when(F.col("gid") == mine, F.array(row(view, F.col(view), F.col("n")))).otherwise(out)
    counted = rolled.filter((F.col("gid") == none_grouped) | (F.col("n") > 0))
    tidy = counted.select(F.inline(out), "first_time", "last_time")
    # every key of the other views is a partition of its own, so one rank filter caps the sources only
    own = F.when(F.col("view") != "top_sources", F.col("key"))
    order = W.partitionBy("view", own).orderBy(F.desc("n"), F.asc("key"))
    is_source = F.col("view") == "top_sources"
    ranked = (
        tidy.filter(~(is_source & F.col("key").isNull()))
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= top_n)
    )
    shown = F.when(is_source, safe_key(F.col("key"))).otherwise(F.col("key"))
    return ranked.select("view", shown.alias("key"), "n", "first_time", "last_time"), skipped
