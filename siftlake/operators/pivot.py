"""Entity pivots: what one identity did, when, and with whom. For one entity or for all at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.text import safe_key
from siftlake.operators.predicates import entity_match_any
from siftlake.operators.profile import enum_key
from siftlake.operators.schema import TIME_FIELDS, first_present

TOP_N_PEERS = 10


@dataclass(frozen=True)
class EntityType:
    """Role fields an entity may appear in, and which field holds its counterpart."""

    match: tuple[str, ...]
    peers: tuple[tuple[str, str], ...]


# Pivotable identities. Free-text fields are left out on purpose.
ENTITY_TYPES = {
    "ip": EntityType(("src_ip", "dst_ip", "src_endpoint_ip"), (("src_ip", "dst_ip"), ("dst_ip", "src_ip"))),
    "user": EntityType(("user", "actor_user", "user_name"), (("user", "src_ip"),)),
}


def entity_type(name: str) -> EntityType:
    if name not in ENTITY_TYPES:
        raise ValueError(f"unknown entity type {name!r}; known: {sorted(ENTITY_TYPES)}")
    return ENTITY_TYPES[name]


def _peer_rules(df: DataFrame, kind: EntityType) -> list[tuple[str, str]]:
    return [(m, p) for m, p in kind.peers if m in df.columns and p in df.columns]


def _time(df: DataFrame) -> Column:
    field = first_present(df, TIME_FIELDS)
    return F.col(f"`{field}`") if field else F.lit(None).cast("bigint")


def _tag(view: str, key: Column) -> Column:
    return F.struct(F.lit(view).alias("view"), key.cast("string").alias("key"))


def _class_tags(df: DataFrame) -> list[Column]:
    tags = [_tag("total", F.lit(""))]
    for view, field in (("by_class", "class_uid"), ("by_activity", "activity_id")):
        if field in df.columns:
            tags.append(_tag(view, enum_key(df, field)))
    return tags


def entity_profile(df: DataFrame, kind: str, value: str, top_n: int = TOP_N_PEERS) -> tuple[DataFrame, list[str]]:
    """Tidy profile of one entity, ``(view, key, n, first_seen, last_seen)``, and the skipped views.

    The entity's rows are read once; each yields one tag per view and the tags are counted.
    """
    spec = entity_type(kind)
    rules = _peer_rules(df, spec)
    skipped = [] if first_present(df, TIME_FIELDS) else ["time_span"]
    if not rules:
        skipped.append("peers")
    mine = F.lit(value)
    tags = _class_tags(df)
    for match, peer in rules:
        tags.append(F.when((F.col(match) == mine) & (F.col(peer) != mine), _tag("peer", F.col(peer))))
    hits = entity_match_any(df, spec.match, value).select(
        F.inline(F.array_compact(F.array(*tags))), _time(df).alias("seen")
    )
    counted = hits.groupBy("view", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen")
    )
    own = F.when(F.col("view") != "peer", F.col("key"))
    order = W.partitionBy("view", own).orderBy(F.desc("n"), F.asc("key"))
    top = counted.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top_n)
    shown = F.when(F.col("view") == "peer", safe_key(F.col("key"))).otherwise(F.col("key"))
    return top.select("view", shown.alias("key"), "n", "first_seen", "last_seen"), skipped


def entity_profile_all(df: DataFrame, kind: str) -> DataFrame:
    """The same counts for every entity: ``(entity, view, key, n, first_seen, last_seen)``.

    A row counts once per entity even when the entity fills two roles.
    """
    spec = entity_type(kind)
    roles = [F.col(f) for f in spec.match if f in df.columns]
    entities = F.array_distinct(F.array_compact(F.array(*roles)))
    per_row = df.select(
        F.explode(entities).alias("entity"), F.array(*_class_tags(df)).alias("tags"), _time(df).alias("seen")
    )
    return (
        per_row.select("entity", F.inline("tags"), "seen")
        .groupBy("entity", "view", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    )


def peers_union(df: DataFrame, kind: str) -> DataFrame:
    """Events per (entity, peer) over both role directions, from one scan."""
    pairs = []
    for match, peer in _peer_rules(df, entity_type(kind)):
        entity, other = F.col(match), F.col(peer)
        pairs.append(F.when(entity != other, F.struct(entity.alias("entity"), other.alias("peer"))))
    exploded = df.select(F.inline(F.array_compact(F.array(*pairs))))
    return exploded.groupBy("entity", "peer").agg(F.count(F.lit(1)).alias("n"))


def top_counterparts(df: DataFrame, kind: str, value: str, top_n: int = TOP_N_PEERS) -> DataFrame:
    """Leading peers of one entity."""
    spec = entity_type(kind)
    hits = peers_union(entity_match_any(df, spec.match, value), kind).filter(F.col("entity") == F.lit(value))
    top = hits.orderBy(F.desc("n"), F.asc("peer")).limit(top_n)
    return top.select(safe_key(F.col("peer")).alias("peer"), "n")


def top_n_per_entity(df: DataFrame, kind: str, top_n: int = TOP_N_PEERS) -> DataFrame:
    """Leading peers of every entity.

    Pairs are pre-counted; the rank filter is applied per task before the shuffle, so a hot entity
    never gathers all its peers in one place.
    """
    order = W.partitionBy("entity").orderBy(F.desc("n"), F.asc("peer"))
    ranked = peers_union(df, kind).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top_n)
