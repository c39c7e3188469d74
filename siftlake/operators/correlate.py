"""Correlation across classes and address-block matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.net import ipv4_to_long, prefix_network

RDP_PORT = 3389
BUCKET_MS = 60_000


def correlate_auth_net(auth: DataFrame, net: DataFrame, port: int = RDP_PORT) -> DataFrame:
    """Sources with failed logins and connections to ``port``; each side is counted before the join."""
    fails = auth.filter(F.col("status") == "FAILURE").groupBy("src_ip").agg(F.count(F.lit(1)).alias("fails"))
    rdp = net.filter(F.col("dst_port") == port).groupBy("src_ip").agg(F.count(F.lit(1)).alias("rdp"))
    return fails.join(rdp, "src_ip").orderBy(F.desc("fails"), F.asc("src_ip"))


def correlate_ordered(
    auth: DataFrame, net: DataFrame, within_ms: int, port: int = RDP_PORT, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Sources whose connections to ``port`` follow a failed login by at most ``within_ms``.

    Only the newest earlier failure matters for a connection, so no pairs are built. That newest failure
    is either in the same time bucket of the source (a window per source and bucket) or carried over
    from an earlier bucket (a running maximum over one row per bucket). A hot source is cut by time.
    """
    tagged = (
        auth.filter(F.col("status") == "FAILURE")
        .select("src_ip", "time", F.lit(1).alias("fail"), F.lit(0).alias("rdp"))
        .unionAll(net.filter(F.col("dst_port") == port).select("src_ip", "time", F.lit(0), F.lit(1)))
        .filter(F.col("src_ip").isNotNull() & F.col("time").isNotNull())
    )
    ticks = (
        tagged.groupBy("src_ip", "time")
        .agg(F.sum("fail").alias("fails"), F.sum("rdp").alias("rdp"))
        .withColumn("bucket", F.floor(F.col("time") / F.lit(bucket_ms)))
    )
    fail_time = F.when(F.col("fails") > 0, F.col("time"))
    earlier = W.partitionBy("src_ip").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = (
        ticks.groupBy("src_ip", "bucket")
        .agg(F.max(fail_time).alias("newest"))
        .select("src_ip", "bucket", F.max("newest").over(earlier).alias("carried"))
    )
    here = W.partitionBy("src_ip", "bucket").orderBy("time").rowsBetween(W.unboundedPreceding, W.currentRow)
    newest = F.greatest(F.max(fail_time).over(here), F.col("carried"))
    judged = ticks.join(buckets, ["src_ip", "bucket"]).withColumn("newest", newest)
    follows = F.col("newest") >= F.col("time") - F.lit(within_ms)
    per_source = judged.groupBy("src_ip").agg(
        F.sum("fails").alias("fails"), F.sum(F.when(follows, F.col("rdp")).otherwise(0)).alias("rdp")
    )
    return per_source.filter(F.col("rdp") > 0).orderBy(F.desc("fails"), F.asc("src_ip"))


def correlate_sequence(
    events: DataFrame,
    steps: Sequence[tuple[str, Column]],
    within_ms: int,
    key: str = "src_ip",
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Keys with events of the last step that end a chain of all steps, in order of time, of at most ``within_ms``.

    steps are (name, condition), two or more. Steps at the same millisecond count as in order. Returned per key: the
    events of each step, ``completed`` (events of the last step that end a chain), ``first_ms`` and ``last_ms`` of them.

    Of all chains that end a step, only the one with the latest start matters, so no pairs are built. A key is cut into
    buckets of time. A bucket is summed up in a table: how late a chain that ends step j can start within it, and
    whether it leads from step i on to step j. What enters a bucket follows from the tables before it, one running
    maximum per step over a row per bucket, so a hot key is never in one task with all its events.
    """
    k = len(steps)
    if k < 2:
        raise ValueError("a sequence has two steps or more")
    hit = [F.coalesce(condition, F.lit(False)) for _, condition in steps]
    ticks = events.select(F.col(key).alias("_key"), "time", *[h.cast("long").alias(f"s{j}") for j, h in enumerate(hit, 1)])
    ticks = ticks.where(F.col("_key").isNotNull() & F.col("time").isNotNull() & (sum(F.col(f"s{j}") for j in range(1, k + 1)) > 0))
    ticks = ticks.groupBy("_key", "time").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(1, k + 1)])
    ticks = ticks.withColumn("bucket", F.floor(F.col("time") / F.lit(bucket_ms)))
    here = W.partitionBy("_key", "bucket").orderBy("time").rowsBetween(W.unboundedPreceding, W.currentRow)
    # f{j}: the latest start within the bucket of a chain that ends step j at this tick; r{i}_{j}: the bucket leads here
    for j in range(1, k + 1):
        seen = F.col(f"s{j}") > 0
        start = F.col("time") if j == 1 else F.max(f"f{j - 1}").over(here)
        ticks = ticks.withColumns({
            f"f{j}": F.when(seen, start),
            **{f"r{i}_{j}": seen if i == j - 1 else seen & F.max(f"r{i}_{j - 1}").over(here) for i in range(1, j)},
        })
    inner = range(1, k)
    tables = ticks.groupBy("_key", "bucket").agg(
        *[F.max(f"f{j}").alias(f"f{j}") for j in inner],
        *[F.max(f"r{i}_{j}").alias(f"r{i}_{j}") for j in inner for i in range(1, j)],
    )
    earlier = W.partitionBy("_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    for j in inner:
        led = [F.when(F.col(f"r{i}_{j}"), F.col(f"e{i}")) for i in range(1, j)]
        left = F.greatest(F.col(f"f{j}"), *led) if led else F.col(f"f{j}")
        tables = tables.withColumn(f"e{j}", F.max(left).over(earlier))
    entering = tables.select("_key", "bucket", *[f"e{j}" for j in inner])
    judged = ticks.join(entering, ["_key", "bucket"])
    latest = F.greatest(F.col(f"f{k}"), *[F.when(F.col(f"r{i}_{k}"), F.col(f"e{i}")) for i in inner])
    ends = latest >= F.col("time") - F.lit(within_ms)
    per_key = judged.groupBy(F.col("_key").alias(key)).agg(
        *[F.sum(f"s{j}").alias(name) for j, (name, _) in enumerate(steps, 1)],
        F.sum(F.when(ends, F.col(f"s{k}")).otherwise(0)).alias("completed"),
        F.min(F.when(ends, F.col("time"))).alias("first_ms"),
        F.max(F.when(ends, F.col("time"))).alias("last_ms"),
    )
    return per_key.where(F.col("completed") > 0)


def cidr_table(cidrs: DataFrame, column: str = "cidr") -> DataFrame:
    """CIDR text to (prefix_length, network) columns; the network is NULL for text that does not parse."""
    parts = F.split(F.col(column), "/")
    length = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(32))
    parsed = cidrs.withColumn("prefix_length", length).withColumn("base", ipv4_to_long(parts[0]))
    shift = F.lit(32) - F.col("prefix_length")
    network = F.call_function("shiftleft", F.call_function("shiftright", F.col("base"), shift), shift)
    valid = F.col("base").isNotNull() & F.col("prefix_length").between(0, 32)
    return parsed.withColumn("network", F.when(valid, network)).drop("base")


def network_counts(ips: DataFrame, lengths: Sequence[int], ip_num: str = "ip_num") -> DataFrame:
    """(prefix_length, network, n_ips, n_events) of the addresses at the given prefix lengths."""
    counted = ips.filter(F.col(ip_num).isNotNull()).groupBy(ip_num).agg(F.count(F.lit(1)).alias("n"))
    if not lengths:
        lengths, counted = [32], counted.limit(0)
    keys = [
        F.struct(F.lit(n).alias("prefix_length"), prefix_network(F.col(ip_num), n).alias("network")) for n in lengths
    ]
    per_network = counted.select(F.inline(F.array(*keys)), "n").groupBy("prefix_length", "network")
    return per_network.agg(F.count(F.lit(1)).alias("n_ips"), F.sum("n").alias("n_events"))


def cidr_join(ips: DataFrame, cidrs: DataFrame, ip_num: str = "ip_num", column: str = "cidr") -> DataFrame:
    """Addresses and events per CIDR block, for any number of blocks, overlapping or not.

    An address has one network per prefix length, so membership is an equi-join on (prefix_length, network). Only
    the lengths that the blocks use are looked up, 33 numbers at most, which the driver asks for first; repeated
    addresses are counted, then each network's addresses, before anything is joined. For short prefixes that leaves a
    row per task and network to shuffle, for ``/0`` a row per task. A block that does not parse comes out with the
    status ``unparsable`` and no counts.
    """
    blocks = cidr_table(cidrs.select(column).distinct(), column)
    used = blocks.filter(F.col("network").isNotNull()).select("prefix_length").distinct().orderBy("prefix_length")
    networks = network_counts(ips, [r["prefix_length"] for r in used.collect()], ip_num)
    joined = blocks.join(networks, ["prefix_length", "network"], "left")
    parsed, zero = F.col("network").isNotNull(), F.lit(0).cast("bigint")
    return joined.select(
        column,
        F.when(parsed, "ok").otherwise("unparsable").alias("status"),
        F.when(parsed, F.coalesce("n_ips", zero)).alias("n_ips"),
        F.when(parsed, F.coalesce("n_events", zero)).alias("n_events"),
    )
