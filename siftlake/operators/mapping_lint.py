"""Type lint of field mappings: does the source field name one kind of thing and the target another?

The ontology in use holds subclass pairs and one pairwise-disjoint set, so a mapping is impossible
exactly when its two types have ancestors that are disjoint. That is a join, not a reasoner.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.session import fixed_table, materialise

# Artifacts that cannot be the same individual, and the one subclass pair.
DISJOINT_SET = (
    "UserAccount", "UserGroup", "Process", "File",
    "NetworkNode", "NetworkSession", "URL", "ServiceApplication",
)
SUBCLASSES = (("NetworkSession", "Session"),)

# OCSF path segment to artifact.
SEGMENTS = {
    "user": "UserAccount", "group": "UserGroup", "owner": "UserAccount",
    "process": "Process", "file": "File",
    "src_endpoint": "NetworkNode", "dst_endpoint": "NetworkNode",
    "endpoint": "NetworkNode", "device": "NetworkNode",
    "connection_info": "NetworkSession", "session": "Session",
    "url": "URL", "service": "ServiceApplication", "app_name": "ServiceApplication",
}

# Source field token patterns per artifact. Tokens are split on ``_``, so the alternatives
# that hold an underscore can never match; they are listed for completeness.
TOKENS = {
    "File": r"^(executable|image|file|filename|filepath|filehash|md5|sha\d+|dll|binary|exe)$",
    "UserAccount": (
        r"^(user|username|userid|owner|principal|account|sam|upn|real_user|effective_user|target_user|src_user)$"
    ),
    "UserGroup": r"^(group|groupname|usergroup)$",
    "Process": r"^(process|cmdline|commandline|command_line|pid|proc|parent)$",
    "URL": r"^(url|uri|referer|referrer)$",
    "ServiceApplication": r"^(application|service|appname|app)$",
    "NetworkSession": (
        r"^(connection|conn|session|sessionid|flow|socket|netflow|communityid|community_id)$"
    ),
    "NetworkNode": (
        r"^(ip|ipv4|ipv6|host|hostname|src|dst|dest|destination|source|address|addr|endpoint|device|machine|node|port)$"
    ),
}


def source_field_type(field: Column) -> Column:
    """Artifact of a source field: the last token that names one."""
    cleaned = F.lower(F.trim(F.regexp_replace(field, "[`*~]", "")))
    usable = F.when(~cleaned.isin("", "—", "-", "const"), cleaned)

    def artifact(token: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in TOKENS.items():
            out = F.when(token.rlike(pattern), name).otherwise(out)
        return out

    tokens = F.split(usable, "[._ ]")
    return F.try_element_at(F.array_compact(F.transform(tokens, artifact)), F.lit(-1))


def ground_path(path: Column) -> Column:
    """Artifact of an OCSF path: the last segment that names one, also tried as ``<segment>_endpoint``."""

    def artifact(segment: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, kind in SEGMENTS.items():
            if name.endswith("_endpoint"):
                out = F.when(segment == name.removesuffix("_endpoint"), kind).otherwise(out)
        for name, kind in SEGMENTS.items():
            out = F.when(segment == name, kind).otherwise(out)
        return out

    segments = F.transform(F.split(path, "[.]"), lambda s: F.replace(s, F.lit("[]"), F.lit("")))
    return F.try_element_at(F.array_compact(F.transform(segments, artifact)), F.lit(-1))


Subclasses = Sequence[tuple[str, str]] | DataFrame


def transitive_closure(pairs: DataFrame, child: str = "artifact", parent: str = "ancestor") -> DataFrame:
    """Every (child, parent) that a chain of the given pairs leads to, without the rows of a thing and itself that no
    cycle makes.

    Semi-naive: each round joins only what the last one has found anew with all that is known, so chains double and the
    rounds are as many as the logarithm of the depth; cycles add nothing new and end. Each round is a written table.
    """
    edges = pairs.select(F.col(child).alias("child"), F.col(parent).alias("parent")).dropna().distinct()
    known = fresh = materialise(edges, "closure-round")
    while not fresh.isEmpty():
        onward = known.select(F.col("child").alias("parent"), F.col("parent").alias("further"))
        longer = fresh.join(onward, "parent").select("child", F.col("further").alias("parent")).distinct()
        fresh = materialise(longer.join(known, ["child", "parent"], "left_anti"), "closure-round")
        known = known.unionByName(fresh)
    return known.select(F.col("child").alias(child), F.col("parent").alias(parent))


def ancestors(spark: SparkSession, subclasses: Subclasses = SUBCLASSES) -> DataFrame:
    """Reflexive and transitive closure ``(artifact, ancestor)`` of subclass pairs: the constant ones, which are closed
    as constants, or a table ``(artifact, ancestor)`` of any size and depth."""
    names = set(SEGMENTS.values()) | set(DISJOINT_SET)
    schema = "artifact string, ancestor string"
    if isinstance(subclasses, DataFrame):
        each = subclasses.select(F.explode(F.array("artifact", "ancestor")).alias("artifact")).dropna()
        each = each.unionByName(fixed_table(spark, "artifact string", [(n,) for n in sorted(names)])).distinct()
        itself = each.select("artifact", F.col("artifact").alias("ancestor"))
        return transitive_closure(subclasses).unionByName(itself).distinct()
    found, more = {(n, n) for n in names | {n for pair in subclasses for n in pair}}, set(subclasses)
    while more - found:
        found |= more
        more = {(a, c) for a, b in found for x, c in found if b == x}
    return fixed_table(spark, schema, sorted(found))


def kinds(spark: SparkSession, disjoint: Sequence[str] = DISJOINT_SET, subclasses: Subclasses = SUBCLASSES) -> DataFrame:
    """``(artifact, kinds)``: which of the pairwise-disjoint types an artifact is; more than one makes it impossible."""
    own = ancestors(spark, subclasses).filter(F.col("ancestor").isin(*disjoint))
    return own.groupBy("artifact").agg(F.sort_array(F.collect_set("ancestor")).alias("kinds"))


def disjoint_pairs(
    spark: SparkSession,
    disjoint: Sequence[str] = DISJOINT_SET,
    subclasses: Subclasses = SUBCLASSES,
) -> DataFrame:
    """Type pairs that cannot describe one thing. A constant table of at most a few hundred rows."""
    pairs = [p for a, b in combinations(disjoint, 2) for p in ((a, b), (b, a))]
    table = fixed_table(spark, "left string, right string", pairs)
    closure = ancestors(spark, subclasses)
    lefts = closure.select(F.col("artifact").alias("source_type"), F.col("ancestor").alias("left"))
    rights = closure.select(F.col("artifact").alias("target_type"), F.col("ancestor").alias("right"))
    return table.join(lefts, "left").join(rights, "right").select("source_type", "target_type").distinct()


def disjointness_selfcheck(
    spark: SparkSession,
    disjoint: Sequence[str] = DISJOINT_SET,
    subclasses: Subclasses = SUBCLASSES,
) -> DataFrame:
    """Artifacts that would have two disjoint ancestors. Must be empty."""
    return kinds(spark, disjoint, subclasses).filter(F.size("kinds") > 1).select("artifact")


def mapping_type_lint(mappings: DataFrame, with_layer: bool = True, subclasses: Subclasses = SUBCLASSES) -> DataFrame:
    """Adds ``source_type``, ``target_type`` and ``status``: ok, crossing or untestable.

    A mapping crosses if its two types together are of more than one of the disjoint kinds, each of at least one. Give
    it distinct mappings (a count column may ride along): typing is per row. ``with_layer=False`` leaves the
    disjointness out, as a contrast: then nothing is ever flagged.
    """
    typed = mappings.withColumn("source_type", source_field_type(F.col("source_field"))).withColumn(
        "target_type", ground_path(F.col("ocsf_path"))
    )
    untestable = F.col("source_type").isNull() | F.col("target_type").isNull()
    if not with_layer:
        return typed.withColumn("status", F.when(untestable, "untestable").otherwise("ok"))
    known = kinds(mappings.sparkSession, subclasses=subclasses)
    for side in ("source", "target"):
        own = known.select(F.col("artifact").alias(f"{side}_type"), F.col("kinds").alias(f"{side}_kinds"))
        typed = typed.join(own, f"{side}_type", "left")
    # a type of no kind leaves the union null
    crosses = F.size(F.array_union("source_kinds", "target_kinds")) > 1
    status = F.when(untestable, "untestable").when(crosses, "crossing").otherwise("ok")
    return typed.withColumn("status", status).select(*mappings.columns, "source_type", "target_type", "status")


def distinct_mappings(mappings: DataFrame) -> DataFrame:
    """Each mapping once, with how often it occurs as ``n``."""
    return mappings.groupBy("source_field", "ocsf_path").agg(F.count(F.lit(1)).alias("n"))


def lint_summary(linted: DataFrame, allow_untestable: bool = False) -> DataFrame:
    """Counts and verdict. Without any testable row a pass would be empty, so it is an error.

    A column ``n`` weighs the rows.
    """
    weight = F.col("n") if "n" in linted.columns else F.lit(1)
    zero = F.lit(0).cast("bigint")

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, weight)), zero)

    n = linted.agg(
        F.coalesce(F.sum(weight), zero).alias("n_checked"),
        rows(F.col("status") != "untestable").alias("n_testable"),
        rows(F.col("status") == "crossing").alias("n_crossing"),
    )
    empty = (F.col("n_testable") == 0) & F.lit(not allow_untestable)
    status = F.when((F.col("n_checked") == 0) | empty, "error").when(F.col("n_crossing") > 0, "fail").otherwise("pass")
    return n.withColumn("status", status)
