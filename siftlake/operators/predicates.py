"""Filters: plain comparisons, contains, Sigma-style rules, MFA states, allow-lists."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.logic import all_of, any_of

_COMPARE = {
    "=": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
}

# Fields that may be a group key. Free text is not among them.
GROUP_KEYS = frozenset(
    {
        "src_ip", "dst_ip", "src_endpoint_ip", "src", "dst_port", "src_port",
        "class_uid", "category_uid", "activity_id", "status_id", "protocol_num",
        "user", "actor_user", "device_hostname",
    }
)

MFA_PATH = "$.userIdentity.sessionContext.attributes.mfaAuthenticated"


def pred_contains(c: Column, needle: str) -> Column:
    """Literal substring match that ignores case."""
    return F.lower(c).contains(F.lower(F.lit(needle)))


def predicate(field: str, op: str, value: object) -> Column:
    """One test on a field, with SQL three-valued logic on NULL."""
    column = F.col(field)
    if op == "contains":
        return pred_contains(column, str(value))
    if op not in _COMPARE:
        raise ValueError(f"unknown operator {op!r}")
    return _COMPARE[op](column, F.lit(value))


def conjunction(tests: Iterable[tuple[str, str, object]]) -> Column:
    return all_of([predicate(*t) for t in tests])


def key_allow_list(keys: Sequence[str], owner: str = "query") -> None:
    """Refuse at plan time to group by anything that could carry a raw record value."""
    refused = [k for k in keys if k not in GROUP_KEYS]
    if refused:
        raise ValueError(f"{owner} groups on {refused}; allowed keys are {sorted(GROUP_KEYS)}")


@dataclass(frozen=True)
class SigmaRule:
    """The selection of one rule: every test must hold."""

    title: str
    selection: tuple[tuple[str, str, object], ...]
    tags: tuple[str, ...] = ()


RDP_RULE = SigmaRule(
    "RDP Network Connection", (("dst_port", "=", 3389),), ("attack.lateral_movement", "attack.t1021.001")
)


def sigma_predicate(df: DataFrame, rules: Sequence[SigmaRule]) -> DataFrame:
    """Matches per rule, all rules counted in one pass.

    A rule whose fields are absent yields ``compiled = false`` and no count, never a zero.
    """
    counters, rows = [], []
    for i, rule in enumerate(rules):
        compiled = all(field in df.columns for field, _, _ in rule.selection)
        matches = F.count_if(conjunction(rule.selection)) if compiled else F.lit(None).cast("bigint")
        counters.append(matches.alias(f"m{i}"))
        rows.append(
            F.struct(
                F.lit(rule.title).alias("rule"),
                F.lit(",".join(rule.tags)).alias("tags"),
                F.lit(compiled).alias("compiled"),
                F.col(f"m{i}").alias("matches"),
            )
        )
    if all(any(f not in df.columns for f, _, _ in r.selection) for r in rules):
        counted = df.sparkSession.range(1).select(*counters)
    else:
        counted = df.agg(*counters)
    return counted.select(F.inline(F.array(*rows)))


def needle_count(df: DataFrame, field: str = "dst_port", value: object = 3389) -> DataFrame:
    """Rows where one field has one value."""
    return df.filter(F.col(field) == F.lit(value)).agg(F.count(F.lit(1)).alias("n"))


def entity_match_any(df: DataFrame, fields: Sequence[str], value: object) -> DataFrame:
    """Rows where any of the role fields equals the value. Absent fields are left out."""
    present = [f for f in fields if f in df.columns]
    return df.filter(any_of([F.col(f) == F.lit(value) for f in present]))


def null_in_exclusion_guard(df: DataFrame, column: str) -> DataFrame:
    """An exclusion list must hold no NULL: with one, NOT IN matches nothing."""
    nulls = F.count_if(F.col(column).isNull())
    return df.agg(nulls.alias("n_null"), (nulls == 0).alias("ok"))


def exclude(df: DataFrame, exclusions: DataFrame, column: str) -> DataFrame:
    """Exclusion as an anti join, which a NULL in the list cannot empty."""
    return df.join(exclusions.select(column).filter(F.col(column).isNotNull()).distinct(), column, "left_anti")


def mfa_unprotected_naive(body: Column, path: str = MFA_PATH) -> Column:
    """The wrong test, kept for contrast: logins without the field are missed."""
    return F.get_json_object(body, path) == F.lit("false")


def mfa_unprotected_null_safe(body: Column, path: str = MFA_PATH) -> Column:
    return ~F.get_json_object(body, path).eqNullSafe(F.lit("true"))


def mfa_state(record: Column, path: str = MFA_PATH) -> Column:
    """present_true, present_false, explicit_null or absent, from a VARIANT."""
    value = F.try_variant_get(record, path, "variant")
    text = F.try_variant_get(record, path, "string")
    return (
        F.when(value.isNull(), "absent")
        .when(F.is_variant_null(value), "explicit_null")
        .when(text == "true", "present_true")
        .otherwise("present_false")
    )


def mfa_unprotected_structural(record: Column, path: str = MFA_PATH) -> Column:
    """True unless MFA was affirmatively asserted; absence stays visible in ``mfa_state``."""
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit("")) != F.lit("true")
