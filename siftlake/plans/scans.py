"""Sources, sinks, commits and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftlake.operators import profile as pf
from siftlake.operators import verify as vf
from siftlake.operators.normalize import OKTA_SCHEMA, normalize_okta
from siftlake.operators.schema import union_sources
from siftlake.plans import tables as t
from siftlake.plans.catalog import query
from siftlake.plans.tables import sql
from siftlake.session import materialise, scratch_path
from siftlake.sources import files as fl
from siftlake.sources import readers as rd
from siftlake.sources import sinks as sk
from siftlake.sources import skipping as sp

FLOW_SUMMARY = """
SELECT dst_port, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM fl GROUP BY dst_port"""


def _by_port(df: DataFrame) -> DataFrame:
    return df.groupBy("dst_port").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_out").alias("bytes_out"))


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A router's output: OCSF JSON lines between blank, coloured, broken and unrelated ones."""
    e = t.events(spark, sf_dir)
    n = F.col("event_id")
    record = F.to_json(F.struct("class_uid", "time", "src_ip", "status"))
    line = (
        F.when(n % 5 == 0, F.concat(F.lit("\x1b[32m"), record, F.lit("\x1b[0m")))
        .when(n % 11 == 0, "")
        .when(n % 13 == 0, F.concat(F.lit("started worker "), n.cast("string")))
        .when(n % 17 == 0, '{"class_uid": ')
        .when(n % 19 == 0, '{"level":"info"}')
        .otherwise(record)
    )
    return e.select(line.alias("value"))


@query("read_ndjson", sql("ev", "SELECT status AS result, count(*) AS n, min(time) AS first_ms FROM ev GROUP BY status"))
def _read_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "okta")
    t.okta_raw(spark, sf_dir).select("value").write.text(path)
    events = normalize_okta(rd.read_ndjson(spark, path, OKTA_SCHEMA))
    return events.groupBy(F.col("status").alias("result")).agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first_ms")
    )


@query(
    "read_ndjson_junk",
    sql("ev", """
SELECT coalesce(status, '<none>') AS outcome, count(*) AS n FROM ev WHERE event_id % 7 <> 0 GROUP BY 1
UNION ALL SELECT CASE WHEN event_id % 2 = 0 THEN 'not a JSON object' ELSE 'broken, or a value does not fit the schema' END,
  count(*) FROM ev WHERE event_id % 7 = 0 GROUP BY 1"""),
)
def _read_ndjson_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line is cut short or replaced by junk: none of them may become a login."""
    path = scratch_path(spark, "okta-junk")
    junk = F.when(F.col("event_key") % 2 == 0, F.lit("junk")).otherwise(F.substring("value", 1, 25))
    lines = t.okta_raw(spark, sf_dir).select(F.when(F.col("event_key") % 7 == 0, junk).otherwise(F.col("value")).alias("value"))
    lines.write.text(path)
    records, bad = rd.read_ndjson_checked(spark, path, OKTA_SCHEMA)
    outcome = normalize_okta(records).select(F.coalesce("status", F.lit("<none>")).alias("outcome"))
    return outcome.unionAll(bad.select("reason")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_ndjson_tolerant",
    sql("ev", """
SELECT CASE WHEN kind = 'ocsf' THEN 'class ' || class_uid ELSE kind END AS outcome, count(*) AS n FROM (
  SELECT class_uid, CASE WHEN event_id % 5 = 0 THEN 'ocsf' WHEN event_id % 11 = 0 THEN 'blank'
    WHEN event_id % 13 = 0 THEN 'not a JSON object' WHEN event_id % 17 = 0 THEN 'not a JSON object'
    WHEN event_id % 19 = 0 THEN 'no class_uid' ELSE 'ocsf' END AS kind FROM ev)
WHERE kind <> 'blank' GROUP BY 1"""),
)
def _read_ndjson_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "router-output")
    _noise(spark, sf_dir).write.text(path)
    records, quarantine = rd.read_ndjson_tolerant(spark, path)
    outcome = records.select(F.concat(F.lit("class "), F.col("class_uid").cast("string")).alias("outcome"))
    return (
        outcome.unionAll(quarantine.select("reason")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "read_zeek_tsv",
    sql("zk", """
SELECT conn_state, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS orig_bytes, count(src_ip) AS n_orig,
  min(time) AS first_ms FROM zk GROUP BY conn_state"""),
)
def _read_zeek_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one log; half of them, after a rotation, have their columns the other way round."""
    log = rd.read_zeek_tsv(spark, f"{_rotated_log(spark, sf_dir)}/*/*")
    return log.groupBy("conn_state").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("orig_bytes").alias("orig_bytes"),
        F.count("`id.orig_h`").alias("n_orig"),
        F.min(F.round(F.col("ts") * 1000).cast("bigint")).alias("first_ms"),
    )


def _rotated_log(spark: SparkSession, sf_dir: str) -> str:
    """Log files whose rows follow a header line, many for each of two orders of the columns."""
    path, raw = scratch_path(spark, "conn-log"), t.zeek_raw(spark, sf_dir)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads, values = [], F.lit(None).cast("string")
    for label, names in (("a", t.ZEEK_COLUMNS), ("b", t.ZEEK_COLUMNS[::-1])):
        for n, line in enumerate(["#separator \\x09", "#path\tconn", "\t".join(("#fields", *names))]):
            heads.append(F.struct(F.lit(label).alias("order"), F.lit(n).alias("n"), F.lit(line).alias("value")))
        values = F.when(F.col("order") == label, F.concat_ws("\t", *[F.col(f"`{c}`") for c in names])).otherwise(values)
    order = F.when(F.hash("uid") % 2 == 0, "a").otherwise("b")
    file = F.pmod(F.xxhash64("uid", "ts"), F.lit(files)).cast("int")
    rows = raw.withColumns({"order": order, "file": file}).select("order", "file", F.lit(9).alias("n"), values.alias("value"))
    each = spark.range(files).select(F.col("id").cast("int").alias("file"), F.inline(F.array(*heads)))
    lines = rows.unionByName(each.select("order", "file", "n", "value")).repartition("file")
    # the task that writes a file puts its header first
    lines.sortWithinPartitions("order", "file", "n").select("order", "file", "value").write.partitionBy("order", "file").text(path)
    return path


@query("read_mapping_csv", sql("mp", "SELECT source_field, ocsf_path, count(*) AS n FROM mp GROUP BY 1, 2"))
def _read_mapping_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "mapping-csv")
    header = F.col("source_field") == "source_field"
    t.mappings(spark, sf_dir).filter(~header).write.option("header", True).csv(path)
    return rd.read_mapping_csv(spark, path).groupBy("source_field", "ocsf_path").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_table_columns",
    "SELECT l_shipmode_missing, n_orders, max_qty FROM (SELECT TRUE AS l_shipmode_missing, "
    "count(DISTINCT l_orderkey) AS n_orders, max(l_quantity) AS max_qty FROM lineitem)",
)
def _read_table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/lineitem.parquet"
    absent = rd.read_table_columns(spark, path, ["l_shipmode"]) is None
    table = rd.read_table_columns(spark, path, ["l_orderkey", "l_quantity"])
    assert table is not None
    return table.agg(
        F.lit(absent).alias("l_shipmode_missing"),
        F.count_distinct("l_orderkey").alias("n_orders"),
        F.max("l_quantity").alias("max_qty"),
    )


@query(
    "read_parquet_files",
    "SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS key_sum FROM (SELECT r_regionkey AS k FROM region UNION ALL "
    "SELECT n_regionkey FROM nation)",
)
def _read_parquet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = rd.read_parquet_files(spark, [f"{sf_dir}/region.parquet"]).select(F.col("r_regionkey").alias("k"))
    nation = rd.read_parquet_files(spark, [f"{sf_dir}/nation.parquet"]).select(F.col("n_regionkey").alias("k"))
    return region.unionByName(nation).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("key_sum"))


@query("write_parquet", sql("fl", FLOW_SUMMARY))
def _write_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "flows")
    sk.write_parquet(t.flows(spark, sf_dir), path)
    return _by_port(spark.read.parquet(path))


@query("land_replace", sql("oc", "SELECT class_uid, count(*) AS n, min(time) AS first_ms FROM oc GROUP BY class_uid"))
def _land_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ocsf")
    landed = sk.land_replace(t.ocsf(spark, sf_dir), path)
    return landed.groupBy("class_uid").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_ms"))


def _committed(spark: SparkSession, sf_dir: str, label: str, n_commits: int = 4) -> str:
    """The events table landed as a few commits, by day range."""
    path = scratch_path(spark, label)
    events = t.events(spark, sf_dir)
    width = (t.END_US - t.START_US) // n_commits
    for i in range(n_commits):
        low, high = t.START_US + i * width, t.START_US + (i + 1) * width
        first, last = i == 0, i == n_commits - 1
        batch = events.filter(
            (F.lit(first) | (F.col("time_us") >= low)) & (F.lit(last) | (F.col("time_us") < high))
        )
        sk.land_append_commit(batch, path, i, low // 1000, i - 1 if i else None)
    return path


def _commit_case(n_commits: int = 4) -> str:
    width = (t.END_US - t.START_US) // n_commits
    return f"greatest(0, least({n_commits - 1}, (time_us - {t.START_US}) // {width}))"


@query(
    "land_append_commit",
    sql("ev", f"""
SELECT c AS commit_id, CASE WHEN c > 0 THEN c - 1 END AS parent_id, count(*) AS added_records
FROM (SELECT CAST({_commit_case()} AS BIGINT) AS c FROM ev) GROUP BY c"""),
)
def _land_append_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _committed(spark, sf_dir, "commits")
    return sk.read_commit_log(spark, path).select("commit_id", "parent_id", "added_records")


@query(
    "read_as_of",
    sql("ev", f"""
SELECT class_uid, count(*) AS n, max(time) AS last_ms FROM ev WHERE {_commit_case()} <= 1 GROUP BY class_uid"""),
)
def _read_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _committed(spark, sf_dir, "as-of")
    state = sk.read_as_of(sk.read_commits(spark, path), 1)
    return state.groupBy("class_uid").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("last_ms"))


@query(
    "commit_chain_audit",
    """
WITH log AS (SELECT l_shipdate, l_suppkey % 5 AS table_id, count(*) AS added FROM lineitem GROUP BY 1, 2),
ids AS (SELECT table_id, added, epoch_ms(l_shipdate) // 86400000 AS commit_id FROM log),
seen AS (SELECT table_id, commit_id, added,
  lag(commit_id) OVER (PARTITION BY table_id ORDER BY commit_id) AS previous_id,
  sum(added) OVER (PARTITION BY table_id ORDER BY commit_id) AS records_as_of FROM ids)
SELECT table_id, commit_id, CASE WHEN commit_id % 50 <> 0 THEN previous_id END AS parent_id, previous_id,
  CAST(records_as_of AS BIGINT) AS records_as_of,
  (CASE WHEN commit_id % 50 <> 0 THEN previous_id END) IS NOT DISTINCT FROM previous_id AS chain_ok FROM seen""",
)
def _commit_chain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per table and ship day; every fiftieth day has lost its parent."""
    from pyspark.sql import Window as W

    days = t.read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("table_id"),
        F.expr("unix_millis(cast(l_shipdate as timestamp)) div 86400000").alias("commit_id"),
    )
    log = days.groupBy("table_id", "commit_id").agg(F.count(F.lit(1)).alias("added_records"))
    before = F.lag("commit_id").over(W.partitionBy("table_id").orderBy("commit_id"))
    log = log.withColumn("before", before).withColumn("parent_id", F.when(F.col("commit_id") % 50 != 0, F.col("before")))
    return vf.commit_chain_audit(log.drop("before"), "table_id")


@query(
    "compact_commits",
    sql("ev", "SELECT class_uid, count(*) AS n, TRUE AS same_content, TRUE AS fewer_files FROM ev GROUP BY class_uid"),
)
def _compact_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _committed(spark, sf_dir, "small-commits", n_commits=6)
    n_before = sk.live_files(spark, path).count()
    same = sk.compact_commits(spark, path, sort_by=["time"])
    fewer = sk.live_files(spark, path).count() < n_before
    packed = sk.read_commits(spark, path)
    return packed.groupBy("class_uid").agg(
        F.count(F.lit(1)).alias("n"), F.lit(same).alias("same_content"), F.lit(fewer).alias("fewer_files")
    )


@query(
    "field_population",
    sql("ev", " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(\"{c}\") AS non_null, count(*) - count(\"{c}\") AS null_count FROM ev"
        for c in ("event_id", "time_us", "time", "class_uid", "category_uid", "activity_id", "status_id", "status",
                  "src_ip", "dst_ip", "dst_port", "user", "actor_user", "bytes_out", "bytes_in")
    )),
)
def _field_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.field_population(t.events(spark, sf_dir))


@query(
    "list_table_files",
    sql("oc", "SELECT class_uid, count(*) AS n_rows, TRUE AS has_bytes, TRUE AS all_listed FROM oc GROUP BY class_uid"),
)
def _list_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a landed table: the store's listing and the files a scan opens must be the same set."""
    path = scratch_path(spark, "listed")
    landed = sk.land_replace(t.ocsf(spark, sf_dir), path)
    listing = fl.list_table_files(spark, path)
    opened = fl.files_of(landed)
    class_uid = F.regexp_extract("path", r"class_uid=(\d+)", 1).cast("int")
    joined = listing.select("file_key", class_uid.alias("class_uid"), F.col("file_size").alias("listed_size")).join(
        opened.select("file_key", "n_rows", "file_size"), "file_key", "full_outer"
    )
    listed = F.coalesce(F.col("listed_size") == F.col("file_size"), F.lit(False))
    return joined.groupBy("class_uid").agg(
        F.sum("n_rows").alias("n_rows"),
        (F.sum("listed_size") > 0).alias("has_bytes"),
        F.bool_and(listed).alias("all_listed"),
    )


@query(
    "footprint_by_source",
    sql("oc", "SELECT 'class-' || class_uid AS source, count(*) AS n_events, TRUE AS has_bytes, TRUE AS adds_up FROM oc GROUP BY 1"),
)
def _footprint_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes per event of each class as landed. SQL knows the events, and that bytes are their number times the ratio."""
    path = scratch_path(spark, "footprint")
    landed = sk.land_replace(t.ocsf(spark, sf_dir), path)
    source = F.concat(F.lit("class-"), F.col("class_uid").cast("string"))
    files = fl.list_table_files(spark, path).withColumn(
        "source", F.concat(F.lit("class-"), F.regexp_extract("path", r"class_uid=(\d+)", 1))
    )
    found = fl.footprint_by_source(landed.withColumn("source", source), files)
    adds_up = F.abs(F.col("bytes_per_event") * F.col("n_events") - F.col("total_bytes")) < 0.5
    return found.select("source", "n_events", (F.col("total_bytes") > 0).alias("has_bytes"), adds_up.alias("adds_up"))


@query(
    "orphan_files",
    sql("oc", "SELECT TRUE AS found_all, count(DISTINCT class_uid) AS n_classes FROM oc WHERE class_uid <> 1007"),
)
def _orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the classes a reader does not refer to must all come out, and no others."""
    path = scratch_path(spark, "orphans")
    landed = sk.land_replace(t.ocsf(spark, sf_dir), path)
    listing = fl.list_table_files(spark, path)
    referenced = fl.files_of(landed.filter(F.col("class_uid") == 1007))
    class_uid = F.regexp_extract("path", r"class_uid=(\d+)", 1)
    orphans = fl.orphan_files(listing, referenced).select(class_uid.alias("class_uid"))
    return orphans.agg(
        F.bool_and(F.col("class_uid") != "1007").alias("found_all"), F.count_distinct("class_uid").alias("n_classes")
    )


@query(
    "small_files",
    sql("oc", "SELECT count(DISTINCT class_uid) >= 1 AS has_files, 'pass' AS status, 8 AS max_small FROM oc"),
)
def _small_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of this table are small, but the rebalanced write leaves few enough of them."""
    path = scratch_path(spark, "small-files")
    sk.land_replace(t.ocsf(spark, sf_dir), path)
    checked = fl.small_files(fl.list_table_files(spark, path))
    return checked.select((F.col("total_files") > 0).alias("has_files"), "status", "max_small")


@query("cluster_layout", sql("fl", "SELECT count(*) AS n, min(bytes_out) AS lo, max(time) AS hi FROM fl WHERE dst_port = 3389"))
def _cluster_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "clustered")
    table = sk.cluster_layout(t.flows(spark, sf_dir), path, ["dst_port", "src_ip"])
    return table.filter(F.col("dst_port") == 3389).agg(
        F.count(F.lit(1)).alias("n"), F.min("bytes_out").alias("lo"), F.max("time").alias("hi")
    )


@query(
    "zorder_layout",
    sql("fl", "SELECT count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM fl "
        "WHERE src_ip = '10.1.0.7' AND time >= 900000000000"),
)
def _zorder_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved source and day as the sort key, so filters on either skip row groups."""
    from siftlake.functions import ipv4_to_long

    path = scratch_path(spark, "zorder")
    flows = t.flows(spark, sf_dir)
    low_bits = ipv4_to_long(F.col("src_ip")).bitwiseAND(F.lit(0xFFFF))
    day = F.expr("time div 86400000").bitwiseAND(F.lit(0xFFFF))
    keyed = flows.withColumn("z", sk.z_order_key(low_bits, day))
    table = sk.cluster_layout(keyed, path, ["z", "time"]).drop("z")
    return table.filter((F.col("src_ip") == "10.1.0.7") & (F.col("time") >= 900_000_000_000)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes_out").alias("bytes_out")
    )


@query(
    "zorder_quantile_layout",
    sql("fl", """
SELECT filter, count(fl.time) AS n, CAST(coalesce(sum(bytes_out), 0) AS BIGINT) AS bytes_out, TRUE AS few_opened
FROM (VALUES ('source'), ('day'), ('bytes')) AS v(filter) LEFT JOIN fl ON CASE filter WHEN 'source' THEN src_ip = '10.1.0.7'
  WHEN 'day' THEN time BETWEEN 900000000000 AND 903000000000 ELSE bytes_in > 90000 END GROUP BY filter"""),
)
def _zorder_quantile_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows in 64 files by ranks of source, time and bytes: each of the three filters opens less than half of them."""
    from siftlake.functions import ipv4_to_long

    path, files = scratch_path(spark, "zranks"), 64
    flows = t.flows(spark, sf_dir).withColumn("src_num", ipv4_to_long(F.col("src_ip")))
    table = sk.z_layout(flows, path, [F.col("src_num"), F.col("time"), F.col("bytes_in")], bits=6, files=files)
    source = flows.where("src_ip = '10.1.0.7'").select(F.max("src_num")).first()[0] or 0
    filters = {
        "source": (F.col("src_num") == source, sp.overlaps("src_num", source, source)),
        "day": (F.col("time").between(900_000_000_000, 903_000_000_000), sp.overlaps("time", 900_000_000_000, 903_000_000_000)),
        "bytes": (F.col("bytes_in") > 90_000, sp.overlaps("bytes_in", 90_001, 1 << 62)),
    }
    zones = sp.index_files(spark.read.parquet(path), ["src_num", "time", "bytes_in"])
    opened = zones.agg(*[F.count_if(zone).alias(name) for name, (_, zone) in filters.items()]).first()
    every = F.array(*[
        F.struct(F.lit(name).alias("filter"), rows.alias("holds"), F.lit(2 * opened[name] < files).alias("few_opened"))
        for name, (rows, _) in filters.items()
    ])
    tagged = table.select("bytes_out", F.inline(every))
    return tagged.groupBy("filter", "few_opened").agg(
        F.count_if("holds").alias("n"), F.coalesce(F.sum(F.when(F.col("holds"), F.col("bytes_out"))), F.lit(0)).alias("bytes_out")
    )


BLOCK_EVENTS = 500


def _indexed_events(spark: SparkSession, sf_dir: str) -> tuple[str, str, DataFrame, StructType]:
    """Events as they arrive, in files of one block of numbers each, their index, built in two goes, their listing and schema."""
    table, index = scratch_path(spark, "unsorted"), scratch_path(spark, "skipping")
    blocks = t.events(spark, sf_dir).withColumn("block", F.expr(f"event_id div {BLOCK_EVENTS}"))
    for part in (F.col("block") % 3 != 0, F.col("block") % 3 == 0):
        blocks.where(part).repartition("block").write.mode("append").partitionBy("block").parquet(table)
        sp.extend_index(spark, table, index, ["src_ip", "time"])
    return table, index, materialise(fl.list_table_files(spark, table), "listing"), blocks.schema


NEEDLES = ("10.0.0.7", "10.0.1.101", "10.0.9.9", "no address")


@query(
    "needle_skipping",
    sql("ev", f"""
SELECT needle, count(event_id) AS n, count(DISTINCT event_id // {BLOCK_EVENTS}) AS files_holding, 0 AS files_missed,
  TRUE AS few_opened, (SELECT count(DISTINCT event_id // {BLOCK_EVENTS}) FROM ev) AS files
FROM (VALUES {", ".join(f"('{x}')" for x in NEEDLES)}) AS v(needle) LEFT JOIN ev ON src_ip = needle GROUP BY needle"""),
)
def _needle_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in a table that is not sorted by them: the files opened against those that a full scan finds them in."""
    table, index, listing, schema = _indexed_events(spark, sf_dir)
    total = listing.agg(F.count(F.lit(1)).alias("files"))
    # the full scan, in passes
    scanned, paths = scratch_path(spark, "holding"), [r["path"] for r in listing.select("path").collect()]
    for rows in sp.scans(spark, table, paths, schema):
        fl.files_of(rows.where(F.col("src_ip").isin(*NEEDLES)), "src_ip").write.mode("append").parquet(scanned)
    scanned = spark.read.parquet(scanned)
    found = None
    for needle in NEEDLES:
        keep = sp.holds_any(spark.read.parquet(index), "src_ip", [needle])
        chosen = sp.files_to_open(spark, table, index, keep, listing)
        n = sp.needle_rows(spark, table, index, "src_ip", [needle], listing, schema).agg(F.count(F.lit(1)).alias("n"))
        holding = scanned.where(F.col("src_ip") == needle).select("file_key", F.lit(1).alias("holds"))
        both = chosen.select("file_key", F.lit(1).alias("opened")).join(holding, "file_key", "full").agg(
            F.count("opened").alias("opened"), F.count("holds").alias("files_holding"),
            F.count_if(F.col("opened").isNull()).cast("int").alias("files_missed"),
        )
        one = both.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").join(total.withColumn("k", F.lit(1)), "k")
        few = F.col("opened") <= F.col("files_holding") + 1 + F.col("files") / 20
        one = one.select(F.lit(needle).alias("needle"), "n", "files_holding", "files_missed", few.alias("few_opened"), "files")
        found = one if found is None else found.unionByName(one)
    return found


RANGE = (1_704_500_000_000, 1_704_900_000_000)


@query(
    "zone_map_range",
    sql("ev", f"""
, b AS (SELECT event_id // {BLOCK_EVENTS} AS block, min(time) AS lo, max(time) AS hi FROM ev GROUP BY 1)
SELECT (SELECT count(*) FROM ev WHERE time BETWEEN {RANGE[0]} AND {RANGE[1]}) AS n, count(*) AS files,
  count(*) FILTER (hi >= {RANGE[0]} AND lo <= {RANGE[1]}) AS files_opened FROM b"""),
)
def _zone_map_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of time: exactly the files whose own range meets it are opened."""
    table, index, listing, schema = _indexed_events(spark, sf_dir)
    chosen = sp.files_to_open(spark, table, index, sp.overlaps("time", *RANGE), listing)
    rows = sp.read_files(spark, table, chosen, schema).where(F.col("time").between(*RANGE)).agg(F.count(F.lit(1)).alias("n"))
    total = listing.agg(F.count(F.lit(1)).alias("files"))
    opened = chosen.agg(F.count(F.lit(1)).alias("files_opened"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(rows).join(one(total), "k").join(one(opened), "k").drop("k")


@query("union_sources", sql("oc", """
SELECT class_uid, count(*) AS n, count(src_ip) AS with_src, count(cmd_line) AS with_cmd FROM oc GROUP BY class_uid"""))  # fmt: skip
def _union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = union_sources(t.events(spark, sf_dir), t.processes(spark, sf_dir))
    return table.groupBy("class_uid").agg(
        F.count(F.lit(1)).alias("n"), F.count("src_ip").alias("with_src"), F.count("cmd_line").alias("with_cmd")
    )


@query("distinct_rows", sql("hv", "SELECT source, count(*) AS n FROM (SELECT DISTINCT * FROM hv) GROUP BY source"))
def _distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.operators.quality import distinct_rows

    return distinct_rows(t.health(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# -- answers over several access paths

WORKLOAD = sql("fl", """
SELECT query, CAST(3 AS BIGINT) AS n_paths, CAST(1 AS BIGINT) AS n_answers, answer, 'pass' AS status FROM (
  SELECT 'total' AS query, CAST(count(*) AS VARCHAR) AS answer FROM fl
  UNION ALL SELECT 'needle', CAST(count(*) AS VARCHAR) FROM fl WHERE dst_port = 3389
  UNION ALL SELECT 'group_by',
    CAST(sum(('0x' || substr(md5(dst_port || ':' || n), 1, 15))::BIGINT::HUGEINT) AS VARCHAR)
  FROM (SELECT dst_port, count(*) AS n FROM fl GROUP BY dst_port))""")


@query("workload_equality", sql("fl", "SELECT 0 AS only_left, 0 AS only_right, count(*) > 0 AS equal FROM fl"))
def _workload_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Port distribution from the source files and from a sorted copy."""
    flows = t.flows(spark, sf_dir)
    copy = sk.cluster_layout(flows, scratch_path(spark, "sorted"), ["dst_port", "src_ip"])
    return vf.workload_equality(_by_port(flows), _by_port(copy))


@query(
    "answer_equality",
    WORKLOAD,
)
def _answer_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workload over the source files, over a sorted copy, and through SQL."""
    flows = t.flows(spark, sf_dir)
    copy = sk.cluster_layout(flows, scratch_path(spark, "needle"), ["dst_port", "src_ip"])
    through_sql = spark.sql("SELECT dst_port, src_ip FROM {flows}", flows=flows)
    answers = vf.workload_answers(flows, "source")
    answers = answers.unionByName(vf.workload_answers(copy, "sorted"))
    return vf.answer_equality(answers.unionByName(vf.workload_answers(through_sql, "sql")))


@query(
    "swap_format_equality",
    WORKLOAD,
)
def _swap_format_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "formats")
    formats = {"parquet": "parquet", "orc": "orc", "json": "json"}
    return vf.swap_format_equality(t.flows(spark, sf_dir), folder, formats)


@query(
    "content_hash",
    """
WITH r AS (SELECT concat_ws('|', o_custkey, o_orderkey, o_orderpriority, o_orderstatus) AS row_text FROM orders)
SELECT count(*) AS n_rows, CAST(sum(('0x' || substr(md5(row_text), 1, 15))::BIGINT::HUGEINT) AS VARCHAR) AS content_hash
FROM r""",
)
def _content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portable form, which another engine can compute over the same rows."""
    orders = t.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return vf.content_hash(orders, portable=True)


@query("content_hash_fast", sql("fl", "SELECT count(*) AS n_rows, 2 AS n_layouts, 1 AS n_hashes FROM fl"))
def _content_hash_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The xxhash64 form over every column, compared between two layouts."""
    flows = t.flows(spark, sf_dir)
    copy = sk.cluster_layout(flows, scratch_path(spark, "hashed"), ["time", "src_ip"])
    both = vf.content_hash(flows).unionByName(vf.content_hash(copy))
    return both.agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).cast("int").alias("n_layouts"),
        F.count_distinct("n_rows", "content_hash").cast("int").alias("n_hashes"),
    )


@query(
    "promote_pipeline",
    sql("ev", """
SELECT src_ip, count(*) AS fails FROM ev WHERE class_uid = 3002 AND status = 'FAILURE'
GROUP BY src_ip HAVING count(*) >= 5"""),
)
def _promote_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log lines to OCSF, landed, read back, then the failed-login hunt over the landed table."""
    from siftlake.operators.detections import detect_bruteforce

    raw = scratch_path(spark, "raw")
    lines = t.okta_raw(spark, sf_dir).filter(F.col("value").contains("user.session.start")).select("value")
    lines.write.text(raw)
    events = normalize_okta(rd.read_ndjson(spark, raw, OKTA_SCHEMA))
    landed = sk.land_replace(events, scratch_path(spark, "authentication"))
    return detect_bruteforce(landed)
