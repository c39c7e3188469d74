"""Value-level mapping checks: does each produced record carry the contract's values?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.logic import field_value_check


def roundtrip_pairs(expected: DataFrame, produced: DataFrame, key: str = "event_key") -> DataFrame:
    """Every event key with how often it was expected and produced; drops and duplicates show up."""
    left = expected.groupBy(key).agg(F.count(F.lit(1)).alias("n_expected"))
    right = produced.groupBy(key).agg(F.count(F.lit(1)).alias("n_produced"))
    zero = F.lit(0).cast("bigint")
    joined = left.join(right, key, "full_outer").select(
        key, F.coalesce("n_expected", zero).alias("n_expected"), F.coalesce("n_produced", zero).alias("n_produced")
    )
    issue = (
        F.when(F.col("n_produced") < F.col("n_expected"), "dropped")
        .when(F.col("n_produced") > F.col("n_expected"), "extra")
        .otherwise("paired")
    )
    return joined.withColumn("pairing", issue)


def field_value_checks(
    expected: DataFrame, produced: DataFrame, fields: Sequence[str], key: str = "event_key"
) -> DataFrame:
    """Mismatches only: ``(key, field, expected, got, why)``. The key names one raw event.

    A field that the produced table does not have is missing for every event. Types are compared
    through the schema, so a boolean never equals the integer that looks like it. NULL counts as a
    value where the produced column exists, as an absent key does where it does not.
    """
    # identical copies are folded first, so a much-repeated event does not multiply in the join
    left = expected.select(key, *[F.col(f).alias(f"e_{f}") for f in fields]).distinct()
    right = (
        produced.select(key, *[F.col(f).alias(f"p_{f}") for f in fields if f in produced.columns])
        .distinct()
        .withColumn("found", F.lit(True))
    )
    checks = []
    for f in fields:
        present = f in produced.columns
        boolean = [present and df.schema[f].dataType.simpleString() == "boolean" for df in (expected, produced)]
        want = F.col(f"e_{f}").cast("string")
        got = F.col(f"p_{f}").cast("string") if present else F.lit(None).cast("string")
        why = field_value_check(want, got, F.lit(present), F.lit(boolean[0] == boolean[1]))
        checks.append(
            F.struct(F.lit(f).alias("field"), want.alias("expected"), got.alias("got"), why.alias("why"))
        )
    joined = left.join(right, key, "left")
    return joined.filter("found").select(key, F.inline(F.array(*checks))).filter(F.col("why").isNotNull())


def _kind(df: DataFrame, field: str) -> str | None:
    """Type class of a field for comparing: booleans apart from the rest, None when absent."""
    if field not in df.columns:
        return None
    return "boolean" if df.schema[field].dataType.simpleString() == "boolean" else "other"


def roundtrip_validate(
    expected: DataFrame, produced: DataFrame, fields: Sequence[str], key: str = "event_key"
) -> DataFrame:
    """One verdict row: unmeasured when nothing was produced, fail on any drop, duplicate or mismatch.

    Both sides go into one grouping by key and compared values: a record that is on both sides is done
    with there, exactly, and a repeated event is one row from then on. A field of an event differs if the
    values expected of it and those produced are not the same; only events with a record on one side alone
    are taken apart to find out, value by value.
    """
    alike = [f for f in fields if _kind(expected, f) == _kind(produced, f)]
    n_unlike = len(fields) - len(alike)

    def side(df: DataFrame, n_expected: int, n_produced: int) -> DataFrame:
        values = [F.col(f).cast("string").alias(f) for f in alike]
        return df.select(key, *values, F.lit(n_expected).alias("e"), F.lit(n_produced).alias("p"))

    both = side(expected, 1, 0).unionAll(side(produced, 0, 1))
    records = both.groupBy(key, *alike).agg(F.sum("e").alias("e"), F.sum("p").alias("p"))
    on_one_side = (F.col("e") > 0) != (F.col("p") > 0)
    events = records.groupBy(key).agg(F.sum("e").alias("e"), F.sum("p").alias("p"), F.count_if(on_one_side).alias("n_odd"))
    odd = records.filter(on_one_side).select(F.col(key).alias("odd_key")).distinct()
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in alike]
    if parts:
        apart = records.join(odd, F.col(key).eqNullSafe(F.col("odd_key")), "left_semi").select(
            key, "e", "p", F.inline(F.array(*parts))
        )
        per_value = apart.groupBy(key, "field", "value").agg((F.max("e") > 0).alias("in_e"), (F.max("p") > 0).alias("in_p"))
        per_field = per_value.groupBy(key, "field").agg(F.max((F.col("in_e") != F.col("in_p")).cast("int")).alias("differs"))
        counted = per_field.groupBy(F.col(key).alias("odd_key")).agg(F.sum("differs").alias("n_alike_differ"))
        events = events.join(counted, F.col(key).eqNullSafe(F.col("odd_key")), "left").drop("odd_key")
    else:
        events = events.withColumn("n_alike_differ", F.lit(0))
    found = (F.col("e") > 0) & (F.col("p") > 0)
    n_differ = F.lit(n_unlike) + F.coalesce("n_alike_differ", F.lit(0))
    bad = found & ((F.col("n_odd") > 0) | F.lit(n_unlike > 0))
    zero = F.lit(0).cast("bigint")
    verdict = events.agg(
        F.coalesce(F.sum("e"), zero).alias("n_expected"),
        F.coalesce(F.sum("p"), zero).alias("n_produced"),
        F.count_if(F.col("e") != F.col("p")).alias("n_unpaired"),
        F.count_if(bad).alias("n_bad_events"),
        F.coalesce(F.sum(F.when(bad, n_differ)), zero).alias("n_mismatches"),
    )
    status = (
        F.when(F.col("n_produced") == 0, "unmeasured")
        .when((F.col("n_unpaired") > 0) | (F.col("n_bad_events") > 0), "fail")
        .otherwise("pass")
    )
    return verdict.withColumn("status", status)
