"""Declarative hunts: a spec is a filter, a group key, measures, a threshold and a rank.

Findings hold bounded group keys and numbers only. ``run_detections`` evaluates every spec in one scan
and one shuffle: each row is tagged with the specs it satisfies, then grouped by (spec, key).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.text import safe_key
from siftlake.operators.predicates import conjunction, key_allow_list
from siftlake.session import fixed_table

TOP_N = 10


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str
    field: str | None = None

    @property
    def slot(self) -> str:
        """The column that carries this measure's input, and then its value, when all hunts run in one pass."""
        return f"{self.agg}({self.field})" if self.field else self.agg

    def column(self) -> Column:
        if self.agg == "count":
            return F.count(F.lit(1)).alias(self.name)
        functions = {"sum": F.sum, "avg": F.avg, "distinct": F.count_distinct}
        if self.agg not in functions:
            raise ValueError(f"unknown aggregate {self.agg!r}")
        return functions[self.agg](F.col(str(self.field))).alias(self.name)


@dataclass(frozen=True)
class DetectionSpec:
    id: str
    technique: str
    tactic: str
    where: tuple[tuple[str, str, object], ...]
    group: tuple[str, ...]
    measures: tuple[Measure, ...]
    having: tuple[tuple[str, str, float], ...]
    rank: str

    def __post_init__(self) -> None:
        key_allow_list(self.group, f"detection {self.id}")

    @property
    def class_uid(self) -> int | None:
        return next((int(v) for f, op, v in self.where if f == "class_uid" and op == "="), None)  # type: ignore[call-overload]

    def required_fields(self) -> set[str]:
        """Every column the hunt reads."""
        fields = {f for f, _, _ in self.where} | set(self.group)
        return fields | {m.field for m in self.measures if m.field}

    def mapped_fields(self) -> set[str]:
        """Columns a source mapping must fill; class and category are set by the router itself."""
        return self.required_fields() - {"class_uid", "category_uid"}


# The hunt inventory (technique ids, classes, thresholds).
DETECTIONS: tuple[DetectionSpec, ...] = (
    DetectionSpec(
        "c2_beacon", "T1071", "Command & Control",
        where=(("class_uid", "=", 4001),),
        group=("src_ip", "dst_ip"),
        measures=(Measure("connections", "count"), Measure("avg_bytes_out", "avg", "bytes_out")),
        having=(("connections", ">=", 3), ("avg_bytes_out", "<", 256)),
        rank="connections",
    ),
    DetectionSpec(
        "exfil_egress", "T1048", "Exfiltration",
        where=(("class_uid", "=", 4001),),
        group=("src_ip",),
        measures=(Measure("total_bytes_out", "sum", "bytes_out"), Measure("flows", "count")),
        having=(("total_bytes_out", ">=", 10_000),),
        rank="total_bytes_out",
    ),
    DetectionSpec(
        "credential_stuffing", "T1110", "Credential Access",
        where=(("class_uid", "=", 3002), ("status_id", "=", 2)),
        group=("src_ip",),
        measures=(Measure("failed_attempts", "count"), Measure("distinct_users", "distinct", "user")),
        having=(("failed_attempts", ">=", 5),),
        rank="failed_attempts",
    ),
    DetectionSpec(
        "shadow_copy_deletion", "T1490", "Impact",
        where=(("class_uid", "=", 1007), ("cmd_line", "contains", "vssadmin delete shadows")),
        group=("device_hostname",),
        measures=(Measure("executions", "count"),),
        having=(("executions", ">=", 1),),
        rank="executions",
    ),
    DetectionSpec(
        "lsass_credential_access", "T1003.001", "Credential Access",
        where=(("class_uid", "=", 1007), ("cmd_line", "contains", "lsass")),
        group=("device_hostname",),
        measures=(Measure("events", "count"),),
        having=(("events", ">=", 1),),
        rank="events",
    ),
    DetectionSpec(
        "api_bulk_retrieval", "T1530", "Collection",
        where=(("class_uid", "=", 6003),),
        group=("actor_user",),
        measures=(Measure("operations", "count"), Measure("total_bytes", "sum", "bytes_out")),
        having=(("total_bytes", ">=", 50_000),),
        rank="total_bytes",
    ),
)

BY_ID = {d.id: d for d in DETECTIONS}

FINDING_SCHEMA = "detection_id string, technique string, finding_key string, measure string, value double, rank int"
VERDICT_SCHEMA = "detection_id string, technique string, verdict string, n_findings bigint"
KEY_ARROW = " → "


def findings(df: DataFrame, spec: DetectionSpec) -> DataFrame:
    """All groups over the threshold for one hunt: raw keys and measures, no cap."""
    grouped = df.filter(conjunction(spec.where)).groupBy(*spec.group)
    return grouped.agg(*[m.column() for m in spec.measures]).filter(conjunction(spec.having))


def _sql_literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def _sql_test(field: str, op: str, value: object) -> str:
    if op == "contains":
        return f"contains(lower(`{field}`), lower({_sql_literal(value)}))"
    return f"`{field}` {op} {_sql_literal(value)}"


def findings_sql(spec: DetectionSpec, table: str) -> str:
    """The hunt as Spark SQL text over a table or view, for those who schedule SQL; same rows as ``findings``."""
    forms = {"count": "count(*)", "sum": "sum(`{}`)", "avg": "avg(`{}`)", "distinct": "count(DISTINCT `{}`)"}
    keys = ", ".join(f"`{g}`" for g in spec.group)
    measures = ", ".join(f"{forms[m.agg].format(m.field)} AS `{m.name}`" for m in spec.measures)
    where = " AND ".join(_sql_test(*t) for t in spec.where) or "true"
    having = " AND ".join(_sql_test(*t) for t in spec.having) or "true"
    return f"SELECT {keys}, {measures} FROM {table} WHERE {where} GROUP BY {keys} HAVING {having}"


def rank_findings(df: DataFrame, spec: DetectionSpec, top_n: int = TOP_N) -> DataFrame:
    """The leading findings by the rank measure; ties break on the key."""
    return df.orderBy(F.desc(spec.rank), *[F.asc_nulls_first(g) for g in spec.group]).limit(top_n)


def split_runnable(df: DataFrame, specs: Iterable[DetectionSpec]) -> tuple[list[DetectionSpec], list[str]]:
    """Hunts whose columns are all present, and the ids of those that must be reported as skipped."""
    specs = list(specs)
    runnable = [s for s in specs if s.required_fields() <= set(df.columns)]
    return runnable, [s.id for s in specs if s not in runnable]


def _key_count(specs: Sequence[DetectionSpec]) -> int:
    return max(len(s.group) for s in specs)


def _slots(specs: Sequence[DetectionSpec]) -> list[Measure]:
    """One measure for each aggregate of a field that any hunt asks for."""
    return list({m.slot: m for s in specs for m in s.measures if m.field}.values())


def _tagged(df: DataFrame, specs: Sequence[DetectionSpec]) -> DataFrame:
    """One row per (event, satisfied spec), carrying keys and measure inputs only, the inputs in their own types."""
    tags = []
    for spec in specs:
        keys = [F.col(g).cast("string") for g in spec.group]
        keys += [F.lit(None).cast("string")] * (_key_count(specs) - len(spec.group))
        used = {m.slot for m in spec.measures}
        inputs = [
            F.when(F.lit(m.slot in used), F.col(str(m.field))).alias(f"in_{i}") for i, m in enumerate(_slots(specs))
        ]
        tag = F.struct(F.lit(spec.id).alias("detection_id"), *[k.alias(f"key_{i}") for i, k in enumerate(keys)], *inputs)
        tags.append(F.when(conjunction(spec.where), tag))
    fields = sorted(set().union(*[s.required_fields() for s in specs]))
    wanted = df.select(*fields)
    classes = sorted({s.class_uid for s in specs if s.class_uid is not None})
    if all(s.class_uid is not None for s in specs):
        # other classes are left out at the scan, as whole partitions where the table has them
        wanted = wanted.filter(F.col("class_uid").isin(*classes))
    return wanted.select(F.inline(F.array_compact(F.array(*tags))))


def _grouped(df: DataFrame, specs: Sequence[DetectionSpec]) -> DataFrame:
    grouped = _tagged(df, specs).groupBy("detection_id", *[f"key_{i}" for i in range(_key_count(specs))])
    values = [Measure(f"m_{m.slot}", m.agg, f"in_{i}").column() for i, m in enumerate(_slots(specs))]
    return grouped.agg(F.count(F.lit(1)).alias("m_count"), *values)


def _value_name(spec: DetectionSpec, name: str) -> str:
    return f"m_{next(m for m in spec.measures if m.name == name).slot}"


def _measure_value(spec: DetectionSpec, name: str) -> Column:
    return F.col(f"`{_value_name(spec, name)}`").cast("double")


def _over_threshold(grouped: DataFrame, specs: Sequence[DetectionSpec]) -> DataFrame:
    keep = F.lit(False)
    rank = F.lit(None).cast("double")
    for spec in specs:
        mine = F.col("detection_id") == F.lit(spec.id)
        keep = keep | (mine & conjunction([(f"`{_value_name(spec, n)}`", op, v) for n, op, v in spec.having]))
        rank = F.when(mine, _measure_value(spec, spec.rank)).otherwise(rank)
    return grouped.filter(keep).withColumn("rank_value", rank)


def run_detections(df: DataFrame, specs: Sequence[DetectionSpec] = DETECTIONS, top_n: int = TOP_N) -> DataFrame:
    """Tidy findings of every runnable hunt: (detection_id, technique, finding_key, measure, value, rank)."""
    runnable, _ = split_runnable(df, specs)
    if not runnable:
        return df.sparkSession.createDataFrame([], FINDING_SCHEMA)
    over = _over_threshold(_grouped(df, runnable), runnable)
    order = W.partitionBy("detection_id").orderBy(
        F.desc("rank_value"), *[F.asc_nulls_first(f"key_{i}") for i in range(_key_count(runnable))]
    )
    # the rank filter becomes a per-task limit before the shuffle, so no task holds all findings of a hunt
    top = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    technique, key, values = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None)
    for spec in runnable:
        mine = F.col("detection_id") == F.lit(spec.id)
        technique = F.when(mine, F.lit(spec.technique)).otherwise(technique)
        shown = F.concat_ws(KEY_ARROW, *[safe_key(F.col(f"key_{i}")) for i in range(len(spec.group))])
        key = F.when(mine, shown).otherwise(key)
        pairs = F.array(
            *[
                F.struct(F.lit(m.name).alias("measure"), _measure_value(spec, m.name).alias("value"))
                for m in spec.measures
            ]
        )
        values = F.when(mine, pairs).otherwise(values)
    return top.select(
        "detection_id", technique.alias("technique"), key.alias("finding_key"), F.inline(values), "rank"
    ).select("detection_id", "technique", "finding_key", "measure", "value", "rank")


def spec_table(spark: SparkSession, specs: Sequence[DetectionSpec] = DETECTIONS) -> DataFrame:
    return fixed_table(
        spark,
        "detection_id string, technique string, tactic string, class_uid int",
        [(s.id, s.technique, s.tactic, s.class_uid) for s in specs],
    )


def finding_counts(df: DataFrame, specs: Sequence[DetectionSpec] = DETECTIONS) -> DataFrame:
    """Number of groups over the threshold per hunt, uncapped."""
    runnable, _ = split_runnable(df, specs)
    if not runnable:
        return df.sparkSession.createDataFrame([], "detection_id string, n_findings bigint")
    over = _over_threshold(_grouped(df, runnable), runnable)
    return over.groupBy("detection_id").agg(F.count(F.lit(1)).alias("n_findings"))


def detection_verdicts(df: DataFrame, specs: Sequence[DetectionSpec] = DETECTIONS) -> DataFrame:
    """FIRED or SILENT per hunt. A hunt whose columns are absent reads SKIPPED, not SILENT."""
    _, skipped = split_runnable(df, specs)
    counts = finding_counts(df, specs)
    verdict = (
        F.when(F.col("detection_id").isin(skipped) if skipped else F.lit(False), "SKIPPED")
        .when(F.col("n_findings") > 0, "FIRED")
        .otherwise("SILENT")
    )
    joined = spec_table(df.sparkSession, specs).join(counts, "detection_id", "left")
    n = F.coalesce("n_findings", F.lit(0).cast("bigint"))
    return joined.select("detection_id", "technique", verdict.alias("verdict"), n.alias("n_findings"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count_if(F.col("verdict") == "FIRED").alias("fired"),
        F.count_if(F.col("verdict") == "SILENT").alias("silent"),
        F.count(F.lit(1)).alias("total"),
    )


def detect_bruteforce(auth: DataFrame, threshold: int = 5) -> DataFrame:
    """Sources with at least ``threshold`` failed logins."""
    failed = auth.filter(F.col("status") == "FAILURE").groupBy("src_ip").agg(F.count(F.lit(1)).alias("fails"))
    return failed.filter(F.col("fails") >= threshold).orderBy(F.desc("fails"), F.asc_nulls_first("src_ip"))


ABSENT = "—absent—"


def _side_by_side(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    old = before.select(key, F.col("verdict").alias("before"))
    new = after.select(key, F.col("verdict").alias("after"))
    return old.join(new, key, "full_outer")


def regression_diff(before: DataFrame, after: DataFrame, key: str = "detection_id") -> DataFrame:
    """Rules whose verdict changed, appeared or vanished."""
    changed = _side_by_side(before, after, key).filter(~F.col("before").eqNullSafe(F.col("after")))
    return changed.select(
        key, F.coalesce("before", F.lit(ABSENT)).alias("before"), F.coalesce("after", F.lit(ABSENT)).alias("after")
    )


def regression_status(before: DataFrame, after: DataFrame, key: str = "detection_id") -> DataFrame:
    """pass when nothing changed, fail otherwise, unmeasured when either side is empty."""
    n = _side_by_side(before, after, key).agg(
        F.count("before").alias("n_before"),
        F.count("after").alias("n_after"),
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_changed"),
    )
    status = (
        F.when((F.col("n_before") == 0) | (F.col("n_after") == 0), "unmeasured")
        .when(F.col("n_changed") == 0, "pass")
        .otherwise("fail")
    )
    return n.withColumn("status", status)
