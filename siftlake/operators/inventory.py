"""Asset inventories across tools: exact gaps, declared-rule resolution, coverage holes.

An inventory is a table ``(tool, raw_id, last_seen timestamp or NULL)``. Only counts leave these
operators, except where a per-id table is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.logic import DEFAULT_TTL_SECONDS, FUTURE_SKEW_SECONDS
from siftlake.functions.text import DOMAIN_SUFFIXES, strip_domain_suffix

MIN_CONFIDENCE = 0.9


@dataclass(frozen=True)
class Rule:
    """One declared normalisation: how sure a match under it is. Rules get weaker down the ladder."""

    name: str
    confidence: float


# The default ladder and its confidences.
EXACT, FOLDED, STRIPPED = Rule("exact", 1.0), Rule("case-insensitive", 0.99), Rule("strip-domain-suffix", 0.9)
LADDER = (EXACT, FOLDED, STRIPPED)


def rule_key(rule: Rule, raw_id: Column, suffixes: Sequence[str] = DOMAIN_SUFFIXES) -> Column:
    if rule == EXACT:
        return raw_id
    if rule == FOLDED:
        return F.lower(raw_id)
    return strip_domain_suffix(raw_id, suffixes)


def match_confidence(a: Column, b: Column, suffixes: Sequence[str] = DOMAIN_SUFFIXES) -> Column:
    """Confidence of the strongest rule under which two ids agree, else 0."""
    out = F.lit(0.0)
    for rule in reversed(LADDER):
        out = F.when(rule_key(rule, a, suffixes) == rule_key(rule, b, suffixes), rule.confidence).otherwise(out)
    return out


def latest_seen(inventory: DataFrame) -> DataFrame:
    """One row per (tool, id) with the newest time, compared as a timestamp. NULL ids are dropped."""
    return (
        inventory.filter(F.col("raw_id").isNotNull())
        .groupBy("tool", "raw_id")
        .agg(F.max("last_seen").alias("last_seen"))
    )


def gap_exact(inventory: DataFrame, primary: str, tolerance: int = 0) -> DataFrame:
    """Primary ids missing from every other tool, by exact id, in one pass.

    Ids are reduced to one row with a flag per tool; no tool is joined to another. Tool names are the
    only thing brought to the driver, to build the flags.
    """
    ids = latest_seen(inventory)
    others = sorted(r[0] for r in inventory.select("tool").distinct().collect() if r[0] != primary)
    held = {t: F.max(F.when(F.col("tool") == t, 1).otherwise(0)) for t in [primary, *others]}
    flags = ids.groupBy("raw_id").agg(*[c.alias(f"t{i}") for i, c in enumerate(held.values())])
    mine = F.col("t0") == 1
    n = flags.agg(
        F.count_if(mine).alias("n0"),
        *[F.count_if(mine & (F.col(f"t{i}") == 0)).alias(f"g{i}") for i in range(1, len(held))],
        *[F.count_if(F.col(f"t{i}") == 1).alias(f"n{i}") for i in range(1, len(held))],
    )
    if not others:
        return n.filter(F.lit(False)).select(
            F.lit("").alias("to_tool"), F.col("n0").alias("gap_count"), F.col("n0").alias("primary_count"),
            F.col("n0").alias("to_count"), F.lit(False).alias("over_tolerance"),
        )
    rows = [
        F.struct(
            F.lit(t).alias("to_tool"),
            F.col(f"g{i}").alias("gap_count"),
            F.col("n0").alias("primary_count"),
            F.col(f"n{i}").alias("to_count"),
            (F.col(f"g{i}") > tolerance).alias("over_tolerance"),
        )
        for i, t in enumerate(others, start=1)
    ]
    return n.select(F.inline(F.array(*rows)))


def _weakest_rule(min_confidence: float) -> Rule:
    usable = [r for r in LADDER if r.confidence >= min_confidence]
    if not usable:
        raise ValueError(f"no rule reaches confidence {min_confidence}")
    return min(usable, key=lambda r: r.confidence)


def ambiguity_flags(
    inventory: DataFrame, min_confidence: float = MIN_CONFIDENCE, suffixes: Sequence[str] = DOMAIN_SUFFIXES
) -> DataFrame:
    """Canonical key per (tool, key): how many ids fall on it and whether that is more than one."""
    key = rule_key(_weakest_rule(min_confidence), F.col("raw_id"), suffixes)
    return (
        latest_seen(inventory)
        .groupBy("tool", key.alias("match_key"))
        .agg(
            F.count(F.lit(1)).alias("n_ids"),
            F.min("raw_id").alias("an_id"),
            F.max("last_seen").alias("last_seen"),
        )
        .withColumn("is_ambiguous", F.col("n_ids") > 1)
    )


def _key_outcomes(
    inventory: DataFrame,
    primary: str,
    now: str,
    min_confidence: float,
    ttl_seconds: int,
    suffixes: Sequence[str],
) -> DataFrame:
    """One row per (other tool, primary key): outcome, ids it stands for, confidence of a match.

    The ladder is nested, so agreeing under any usable rule means agreeing under the weakest one.
    Everything the outcome depends on is a fact about a key, so both sides hold one row per key.
    """
    keys = ambiguity_flags(inventory, min_confidence, suffixes)
    mine = keys.filter(F.col("tool") == primary).select(
        "match_key", F.col("n_ids").alias("n_primary"), F.col("an_id").alias("primary_id")
    )
    theirs = keys.filter(F.col("tool") != primary).select(
        F.col("tool").alias("to_tool"),
        "match_key",
        F.col("n_ids").alias("n_source"),
        F.col("an_id").alias("source_id"),
        "last_seen",
    )
    # per-tool facts: at most one row per tool
    others = inventory.filter((F.col("tool") != primary) & F.col("raw_id").isNotNull())
    dated = others.groupBy(F.col("tool").alias("to_tool")).agg(
        F.bool_or(F.col("last_seen").isNotNull()).alias("has_times")
    )
    tools = dated.agg(F.collect_list(F.struct("to_tool", "has_times"))).scalar()
    wanted = mine.select("match_key", "n_primary", "primary_id", F.inline(tools))
    joined = wanted.join(theirs, ["to_tool", "match_key"], "left")
    age = F.unix_seconds(F.to_timestamp(F.lit(now))) - F.unix_seconds("last_seen")
    fresh = F.coalesce((age <= ttl_seconds) & (age >= -FUTURE_SKEW_SECONDS), F.lit(False))
    outcome = (
        F.when(F.col("n_primary") > 1, "unresolved")
        .when(F.col("n_source").isNull(), "gap")
        .when(F.col("n_source") > 1, "unresolved")
        .when(F.col("has_times") & ~fresh, "stale")
        .otherwise("covered")
    )
    confidence = match_confidence(F.col("primary_id"), F.col("source_id"), suffixes)
    out = joined.withColumn("outcome", outcome)
    return out.withColumn("confidence", F.when(F.col("outcome") == "covered", confidence))


def resolve_entities(
    inventory: DataFrame,
    primary: str,
    now: str,
    min_confidence: float = MIN_CONFIDENCE,
    ttl_seconds: int = DEFAULT_TTL_SECONDS,
    tolerance: int = 0,
    suffixes: Sequence[str] = DOMAIN_SUFFIXES,
) -> DataFrame:
    """Coverage of the primary by every other tool, counts only.

    Ambiguous and stale matches count as uncovered; ids that collapse together are never merged.
    """
    outcomes = _key_outcomes(inventory, primary, now, min_confidence, ttl_seconds, suffixes)

    def ids(name: str) -> Column:
        return F.sum(F.when(F.col("outcome") == name, F.col("n_primary")).otherwise(0))

    per_tool = outcomes.groupBy("to_tool").agg(
        ids("covered").alias("covered"),
        ids("gap").alias("gap"),
        ids("stale").alias("stale"),
        ids("unresolved").alias("unresolved"),
        F.sum("n_primary").alias("primary_count"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.when(F.bool_or("has_times"), "measured").otherwise("unmeasured").alias("freshness"),
    )
    uncovered = F.col("gap") + F.col("stale") + F.col("unresolved")
    return per_tool.withColumn("uncovered_total", uncovered).withColumn(
        "status", F.when(F.col("uncovered_total") > tolerance, "fail").otherwise("pass")
    )


def resolution_status(inventory: DataFrame, resolved: DataFrame, primary: str) -> DataFrame:
    """Layer verdict: unmeasured without ids in the primary or without any other tool."""
    have = inventory.agg(
        F.count_if((F.col("tool") == primary) & F.col("raw_id").isNotNull()).alias("n_primary"),
        F.count_if(F.col("tool") != primary).alias("n_other"),
    )
    failed = resolved.agg(F.count_if(F.col("status") == "fail")).scalar()
    status = (
        F.when((F.col("n_primary") == 0) | (F.col("n_other") == 0), "unmeasured")
        .when(F.col("n_failed") > 0, "fail")
        .otherwise("pass")
    )
    return have.withColumn("n_failed", failed).select(status.alias("status"), "n_failed")


def cross_tool_holes(inventory: DataFrame, cmdb: str = "cmdb", edr: str = "edr", scanner: str = "scanner") -> DataFrame:
    """Size of the union of inventories and the four named coverage holes, in one grouping."""

    def held(tool: str) -> Column:
        return F.max(F.when(F.col("tool") == tool, True).otherwise(False))

    ids = inventory.filter(F.col("raw_id").isNotNull() & F.col("tool").isin(cmdb, edr, scanner))
    flags = ids.groupBy("raw_id").agg(
        held(cmdb).alias("in_cmdb"), held(edr).alias("in_edr"), held(scanner).alias("in_scanner")
    )
    return flags.agg(
        F.count(F.lit(1)).alias("union_size"),
        F.count_if(~F.col("in_edr")).alias("edr_blind"),
        F.count_if(~F.col("in_cmdb")).alias("cmdb_unknown"),
        F.count_if(F.col("in_edr") & ~F.col("in_cmdb")).alias("edr_sees_cmdb_doesnt"),
        F.count_if(F.col("in_scanner") & ~F.col("in_cmdb") & ~F.col("in_edr")).alias("scanner_only"),
    )


def inventory_union(a: DataFrame, b: DataFrame, column: str = "raw_id") -> DataFrame:
    both = a.select(column).unionByName(b.select(column))
    return both.filter(F.col(column).isNotNull()).distinct()


def inventory_difference(a: DataFrame, *others: DataFrame, column: str = "raw_id") -> DataFrame:
    """``a − b − c …``: ids are reduced before the anti joins, NULL ids dropped."""
    out = a.select(column).filter(F.col(column).isNotNull()).distinct()
    for other in others:
        out = out.join(other.select(column).filter(F.col(column).isNotNull()).distinct(), column, "left_anti")
    return out
