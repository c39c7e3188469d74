"""Hop-by-hop count reconciliation: emitted, ingested, landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.logic import status_rollup
from siftlake.operators.schema import union_sources
from siftlake.session import fixed_table

HOPS = ("emitted", "ingested", "landed")

# Raw event type and the class a router must turn it into.
EVENT_CLASS = {"user.session.start": 3002}


def emitted_counts(raw: DataFrame, event_type: Column, mapping: dict[str, int] | None = None) -> DataFrame:
    """Ground truth at the source: mappable raw events per resulting class."""
    mapping = mapping or EVENT_CLASS
    classes = fixed_table(raw.sparkSession, "event_type string, class_uid int", list(mapping.items()))
    counted = raw.groupBy(event_type.alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(classes), "event_type").groupBy("class_uid").agg(F.sum("n").alias("n"))


def hop_counts(df: DataFrame, hop: str) -> DataFrame:
    """Rows per class at one hop, in long form."""
    return df.groupBy("class_uid").agg(F.count(F.lit(1)).alias("n")).select(F.lit(hop).alias("hop"), "class_uid", "n")


def flow_reconcile(
    emitted: DataFrame | None, ingested: DataFrame | None, landed: DataFrame | None, tolerance: float = 0.0
) -> DataFrame:
    """Per class: counts at each hop, drop, fraction and status.

    Each input is ``(class_uid, n)``. A hop that ran but lost a class reads 0; a hop that did not run
    (None) is NULL and its classes are unmeasured.
    """
    hops = dict(zip(HOPS, (emitted, ingested, landed), strict=True))
    ran = {h: df for h, df in hops.items() if df is not None}
    if not ran:
        raise ValueError("no hop was measured")
    long = union_sources(*[df.select(F.lit(h).alias("hop"), "class_uid", "n") for h, df in ran.items()])
    wide = long.groupBy("class_uid").pivot("hop", list(HOPS)).agg(F.sum("n"))
    zero, unknown = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    wide = wide.select("class_uid", *[(F.coalesce(h, zero) if h in ran else unknown).alias(h) for h in HOPS])
    e, i, n = (F.col(h) for h in HOPS)
    usable = e.isNotNull() & i.isNotNull() & n.isNotNull() & (e > 0) & (i >= 0) & (n >= 0)
    drop = F.when(usable, e - n)
    status = (
        F.when(~F.coalesce(usable, F.lit(False)), "unmeasured")
        .when(drop > e * F.lit(tolerance), "fail")
        .otherwise("pass")
    )
    fraction = F.round(F.when(usable, (e - n) / F.nullif(e, F.lit(0))), 4)
    return wide.select("class_uid", *HOPS, drop.alias("n_dropped"), fraction.alias("drop_frac"), status.alias("status"))


def flow_status(reconciled: DataFrame) -> DataFrame:
    """Rolled-up status and the worst drop fraction."""
    return reconciled.agg(
        status_rollup(F.col("status")).alias("status"),
        F.max("drop_frac").alias("worst_drop"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def flow_gate(emitted: DataFrame, landed: DataFrame) -> DataFrame:
    """Two-hop gate: a class that did not arrive counts as 0 landed, which is a drop."""
    zero = F.lit(0).cast("bigint")
    joined = emitted.select("class_uid", F.col("n").alias("emitted")).join(
        landed.select("class_uid", F.col("n").alias("landed")), "class_uid", "left"
    )
    landed_n = F.coalesce("landed", zero)
    return joined.select(
        "class_uid",
        "emitted",
        landed_n.alias("landed"),
        (F.col("emitted") - landed_n).alias("vanished"),
        F.when(F.col("emitted") == landed_n, "ok").otherwise("DROP").alias("status"),
    )


# Counters read from a router's metrics page, and its own plumbing.
COUNTERS = {
    "events_in": ("vector_component_received_events_total", "source"),
    "events_out": ("vector_component_sent_events_total", "sink"),
    "errors": ("vector_component_errors_total", None),
}
PLUMBING = ("internal_metrics", "prometheus_exporter")


def scrape_counters(
    lines: DataFrame, column: str = "value", by: tuple[str, ...] = (), at: str | None = None
) -> DataFrame:
    """Throughput counters from captured metrics text; all NULL when no data metric was seen.

    ``by`` names columns (a host) to count apart, ``at`` the column that orders the captures. The counters are
    cumulative: of each series what it has grown by since its start counts, a fall being a restart from zero.
    Without ``at`` the highest reading of a series counts.
    """
    line = F.col(column)
    parsed = lines.select(
        *by,
        (F.col(at) if at else F.lit(0)).alias("captured"),
        F.trim(F.substring_index(line, "}", 1)).alias("series"),
        F.regexp_extract(line, r"^([A-Za-z0-9_:]+)\{", 1).alias("name"),
        F.regexp_extract(line, r'[{,]component_kind="([^"]*)"', 1).alias("kind"),
        F.regexp_extract(line, r'[{,]component_type="([^"]*)"', 1).alias("type"),
        F.split(F.trim(F.substring_index(line, "}", -1)), r"\s+")[0].try_cast("double").alias("reading"),
    )
    names = [n for n, _ in COUNTERS.values()]
    usable = parsed.filter(
        F.col("name").isin(names) & ~F.col("type").isin(*PLUMBING) & F.col("reading").isNotNull()
    )
    if at:
        before = F.lag("reading").over(W.partitionBy(*by, "series").orderBy("captured"))
        step = F.col("reading") - F.when(F.col("reading") >= before, before).otherwise(0)
        usable = usable.withColumn("reading", step)
    folded = F.sum("reading") if at else F.max("reading")
    usable = usable.groupBy(*by, "series", "name", "kind").agg(folded.alias("reading"))
    totals = []
    for label, (name, kind) in COUNTERS.items():
        mine = F.col("name") == name
        if kind:
            mine = mine & (F.col("kind") == kind)
        total = F.sum(F.when(mine, F.col("reading")).otherwise(0.0))
        totals.append(F.when(F.count(F.lit(1)) > 0, total.cast("bigint")).alias(label))
    return usable.groupBy(*by).agg(*totals) if by else usable.agg(*totals)
