"""Adapter views over the driver's tables, each as a DataFrame and as the same SQL text.

The driver's tables are not security data; plain arithmetic gives them that shape. ``VIEWS`` holds the
SQL form for the outside check, the functions hold the Spark form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.schema import union_sources

# Fixed values of the adapter: ports, artifact labels, D3FEND phases, window of the events table.
PORTS = (80, 443, 22, 53, 3389, 445, 8080, 3306)
LABELS = (
    "Network Traffic", "Network Flow", "Credential", "User Account", "Session", "Process",
    "Process Tree", "Cloud Storage", "Database", "Document File", "Firmware", "Clipboard",
)
PHASES = ("Model", "Harden", "Detect", "Isolate", "Deceive", "Evict", "Restore")
CLASS_CYCLE = (1007, 3002, 4001, 6003, 6001)
CHECK_CYCLE = ("config_integrity", "spec_persisted", "source", "flow", "quality", "cross_tool")
CONN_STATES = ("SF", "S0", "REJ", "RSTO", "OTH", "S1", "RSTR", "SH", "SHR", "RSTRH")
API_CALLS = (
    "GetObject", "ListBuckets", "DescribeInstances", "DeleteUser", "RemoveTags", "TerminateInstances",
    "AttachUserPolicy", "DetachVolume", "UpdateStack", "ModifyImage", "PutObject", "CreateUser",
    "AddRole", "RunInstances", "AssumeRole",
)
START_US = 1_704_067_200_000_000
DAY_US = 86_400_000_000
END_US = START_US + 30 * DAY_US
N_TECHNIQUES = 435
N_DEFENSES = 120


# Schemas of the driver's tables; declared, so that no job is spent on reading footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def utc(column: str = "ts") -> Column:
    return F.col(column).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as mixed OCSF records of classes 3002, 4001 and 6003."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    net, api = kind.isin("view", "click"), kind == "purchase"
    time_us = F.unix_micros(utc())
    address = F.concat(
        F.lit("10.0."), F.expr("(user_id div 250) % 250").cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string")
    )
    return e.select(
        "event_id",
        time_us.alias("time_us"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("time"),
        F.when(net, 4001).when(api, 6003).otherwise(3002).alias("class_uid"),
        F.when(net, 4).when(api, 6).otherwise(3).alias("category_uid"),
        F.when(kind == "view", 6).when(kind.isin("click", "purchase"), 2).otherwise(1).alias("activity_id"),
        F.when(kind == "error", 2).otherwise(1).alias("status_id"),
        F.when(kind == "error", "FAILURE").otherwise("SUCCESS").alias("status"),
        F.when(F.col("event_id") % 97 != 0, address).alias("src_ip"),
        F.when(net, F.concat(F.lit("203.0.113."), (F.col("event_id") % 16).cast("string"))).alias("dst_ip"),
        F.when(net, _pick(PORTS, F.col("event_id") % 8)).alias("dst_port"),
        F.when(
            ~net & ~api, F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@acme.example"))
        ).alias("user"),
        F.when(api, F.concat(F.lit("svc"), F.col("user_id").cast("string"), F.lit("@acme.example"))).alias("actor_user"),
        F.when(net, F.floor(F.col("value") * 8)).when(api, F.floor(F.col("value") * 80)).alias("bytes_out"),
        F.when(net, F.floor(F.col("value") * 3)).alias("bytes_in"),
    )


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as process events: the whole text is the command line, the source is the host."""
    d = F.col("doc_id")
    prefix = (
        F.when(d % 7 == 0, "cmd.exe /c VSSADMIN Delete Shadows /all /quiet ")
        .when(d % 11 == 0, "procdump -ma LSASS.exe out.dmp ")
        .otherwise("")
    )
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.lit(START_US // 1000) + d * 1000).alias("time"),
        F.lit(1007).alias("class_uid"),
        F.lit(1).alias("category_uid"),
        F.lit(1).alias("activity_id"),
        F.concat(F.lit("host-"), F.col("source")).alias("device_hostname"),
        F.concat(prefix, F.col("text")).alias("cmd_line"),
    )


def ocsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classes in one wide table."""
    return union_sources(events(spark, sf_dir).drop("event_id", "time_us"), processes(spark, sf_dir).drop("doc_id"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as network flows: the volume table."""

    def address(prefix: str, key: str) -> Column:
        return F.concat(
            F.lit(prefix),
            F.expr(f"({key} div 250) % 250").cast("string"),
            F.lit("."),
            (F.col(key) % 250).cast("string"),
        )

    second = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 86_400
    return read(spark, sf_dir, "lineitem").select(
        (F.unix_millis(utc("l_shipdate")) + second * 1000).alias("time"),
        F.lit(4001).alias("class_uid"),
        F.lit(6).alias("activity_id"),
        address("10.1.", "l_suppkey").alias("src_ip"),
        address("172.16.", "l_partkey").alias("dst_ip"),
        _pick(PORTS, (F.col("l_linenumber") + F.col("l_orderkey")) % 8).alias("dst_port"),
        (F.col("l_quantity").cast("bigint") * 10).alias("bytes_out"),
        F.floor("l_extendedprice").alias("bytes_in"),
    )


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with capture times, clock offsets, identities and some repeated rows."""
    e = read(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    who = F.col("user_id").cast("string")
    identity = (
        F.when(n % 33 == 0, F.lit(None).cast("string"))
        .when(kind == "signup", F.concat(F.lit("u"), who, F.lit("@acme.example")))
        .when(n % 12 == 0, F.concat(F.lit("u"), who))
        .otherwise(F.concat(F.lit("ACME\\u"), who))
    )
    once = e.select(
        "event_id",
        kind.alias("source"),
        F.unix_micros(utc()).alias("event_time_us"),
        (F.unix_micros(utc()) + F.floor(F.col("value") * 200_000)).alias("ingest_time_us"),
        (n * 7919 % 4001 - 2000 + F.when(kind == "error", 90_000).otherwise(0)).alias("clock_offset_ms"),
        identity.alias("user"),
        (n % 50 != 0).alias("landed"),
    )
    copies = F.when(n % 67 == 0, 2).otherwise(1)
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy", "event_id")


def health_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per source and day, from the source's own history."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("source")).agg(
        (F.count(F.lit(1)) / F.lit(30.0)).alias("baseline_per_bucket")
    )


def inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tools' asset lists, with case, suffix, ambiguity and age differences."""
    none = F.lit(None).cast("timestamp")
    customer = read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    twin = F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("web-"), key, F.lit(".local")))
    ids = F.explode(F.array_compact(F.array(F.concat(F.lit("Web-"), key), twin)))
    cmdb = customer.select(F.lit("cmdb").alias("tool"), ids.alias("raw_id"), none.alias("last_seen"))
    edr = read(spark, sf_dir, "orders").select(
        F.lit("edr").alias("tool"),
        F.concat(F.lit("web-"), F.col("o_custkey").cast("string"), F.lit(".corp")).alias("raw_id"),
        utc("o_orderdate").alias("last_seen"),
    )
    scanner = read(spark, sf_dir, "events").select(
        F.lit("scanner").alias("tool"),
        F.concat(F.lit("WEB-"), F.col("user_id").cast("string")).alias("raw_id"),
        utc().alias("last_seen"),
    )
    return cmdb.unionByName(edr).unionByName(scanner)


def _technique(n: Column) -> Column:
    return F.concat(F.lit("T"), (F.lit(1000) + n).cast("string"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technique–defence cells with their shared artifacts, from distinct ``lineitem`` pairs."""
    cells = (
        read(spark, sf_dir, "lineitem")
        .select(
            (F.col("l_partkey") % N_TECHNIQUES).alias("t"),
            ((F.col("l_partkey") % N_TECHNIQUES * 3 + F.col("l_linenumber")) % N_DEFENSES).alias("d"),
        )
        .distinct()
    )
    t, d = F.col("t"), F.col("d")
    mix = t + d
    zero = t % 16 == 0
    n_shared = (1 + mix % 3).cast("int")
    labels = F.slice(
        F.array(_pick(LABELS, mix % 12), _pick(LABELS, (mix + 5) % 12), _pick(LABELS, (mix + 7) % 12)), 1, n_shared
    )
    phase = _pick(PHASES, d % 7)

    def cell(c: Column) -> Column:
        return F.when(zero, "").otherwise(c)

    rows = cells.select(
        _technique(t).alias("off_tech_id"),
        cell(F.concat(F.lit("D3-"), d.cast("string"))).alias("d3fend_id"),
        cell(F.concat(F.lit("Defense "), d.cast("string"))).alias("def_tech"),
        cell(phase).alias("phase"),
        cell(phase).alias("tactic"),
        F.when(zero, "zero_defense").otherwise(F.lower(phase)).alias("band"),
        F.when(zero, 0).otherwise(n_shared).alias("shared_artifacts"),
        cell(F.array_join(labels, "|")).alias("shared_artifact_names"),
        F.when(zero, 0.0).otherwise(0.25).alias("trust"),
    )
    return rows.distinct()


def techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technique inventory with the class a hunt reads and whether there is a hunt."""
    t = F.col("t")
    return (
        read(spark, sf_dir, "part")
        .select((F.col("p_partkey") % N_TECHNIQUES).alias("t"))
        .distinct()
        .select(
            _technique(t).alias("technique"),
            F.concat(F.lit("tactic-"), (t % 14).cast("string")).alias("tactic"),
            _pick(CLASS_CYCLE, t % 5).alias("class_uid"),
            (t % 3 != 0).alias("has_detection"),
        )
    )


def fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per technique: one for each brand-tagged part, none for most techniques."""
    technique = _technique(F.col("p_partkey") % N_TECHNIQUES).alias("technique")
    hit = F.count_if(F.col("p_brand") == "Brand#7")
    return read(spark, sf_dir, "part").groupBy(technique).agg(hit.alias("n_findings"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured verdicts; every fourth technique has none."""
    t = F.col("t")
    state = F.when(t % 4 == 0, "DETECTED").when(t % 4 == 1, "MISSED").when(t % 4 == 2, "NOISY")
    return (
        read(spark, sf_dir, "part")
        .groupBy((F.col("p_partkey") % N_TECHNIQUES).alias("t"))
        .agg(F.count(F.lit(1)).alias("matches"))
        .select(_technique(t).alias("att_ck"), state.alias("state"), (t % 10 / 10.0).alias("precision"), "matches")
        .filter(F.col("state").isNotNull())
    )


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_suppkey") % N_DEFENSES
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("D3-"), d.cast("string")).alias("defense"),
        ((d * 5 + F.col("l_linenumber")) % 97).alias("artifact"),
    )


def produces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("l_partkey") % N_TECHNIQUES
    return read(spark, sf_dir, "lineitem").select(
        _technique(t).alias("offense"), ((t * 7 + F.col("l_linenumber") * 3) % 131).alias("artifact")
    )


def semantic(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine datasets of the metric layer."""
    o = read(spark, sf_dir, "orders")
    cust = F.col("o_custkey")
    opened = utc("o_orderdate")
    hours = F.make_dt_interval(F.lit(0), (cust % 72).cast("int"), (cust % 60).cast("int"))
    finding = o.select(
        F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("finding_uid"),
        opened.alias("event_time"),
        F.when(cust % 10 != 0, opened - hours).alias("first_seen_time"),
        F.when(F.col("o_orderstatus") == "F", "False Positive")
        .when(F.col("o_orderstatus") == "P", "Suspicious")
        .alias("verdict"),
        _technique(cust % 500).alias("technique_id"),
        F.concat(F.lit("R"), (cust % 150).cast("string")).alias("rule_uid"),
    )
    s = F.col("s_suppkey")
    rule = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("R"), s.cast("string")).alias("rule_uid"),
        F.when(s % 9 != 0, _technique(s * 3 % N_TECHNIQUES)).alias("technique_id"),
    )
    technique = techniques(spark, sf_dir).select(F.col("technique").alias("technique_id"))
    p = F.col("p_partkey")
    atlas = read(spark, sf_dir, "part").select(
        F.concat(F.lit("AML.T"), p.cast("string")).alias("atlas_id"),
        _pick(("Feasible", "Demonstrated", "Realized"), p % 3).alias("maturity"),
        F.when(p % 5 == 0, _technique(p % N_TECHNIQUES)).alias("attack_technique_id"),
    )
    cells = corpus(spark, sf_dir).filter(F.col("band") != "zero_defense")
    bridge = cells.select(
        F.col("off_tech_id").alias("attack_technique_id"),
        "d3fend_id",
        F.col("phase").alias("d3fend_tactic"),
        "shared_artifacts",
    )
    defense = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("D3-"), (s % N_DEFENSES).cast("string")).alias("d3fend_id")
    ).distinct()
    t = F.col("l_partkey") % N_TECHNIQUES
    class_map = (
        read(spark, sf_dir, "lineitem")
        .select(_technique(t).alias("attack_technique_id"), _pick(CLASS_CYCLE, t % 5).alias("ocsf_class_uid"))
        .filter(F.col("ocsf_class_uid") != 6001)
        .distinct()
    )
    auth = (
        events(spark, sf_dir)
        .filter(F.col("class_uid") == 3002)
        .select(F.col("time").alias("event_time"), "status_id", "src_ip", F.col("user").alias("user_name"))
    )
    return {
        "detection_finding": finding,
        "authentication": auth,
        "network_activity": events(spark, sf_dir).filter(F.col("class_uid") == 4001),
        "sigma_rule": rule,
        "attack_technique": technique,
        "atlas_technique": atlas,
        "d3fend_technique": defense,
        "technique_defense": bridge,
        "technique_class_map": class_map,
    }


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check results per table and day."""
    n = F.col("event_id")
    status = F.when(n % 29 == 0, "fail").when(n % 31 == 0, "stale").when(n % 37 == 0, "unmeasured").otherwise("pass")
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("table_name"),
        F.date_format(utc(), "yyyy-MM-dd").alias("day"),
        _pick(CHECK_CYCLE, n % 6).alias("check"),
        status.alias("status"),
    )


def okta_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity log lines: ``event_key`` and the JSON text."""
    e = events(spark, sf_dir)
    published = F.concat(F.date_format(F.timestamp_micros("time_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    line = F.to_json(
        F.struct(
            published.alias("published"),
            F.when(F.col("class_uid") == 3002, "user.session.start").otherwise("system.other").alias("eventType"),
            F.struct(F.col("status").alias("result")).alias("outcome"),
            F.struct(F.col("user").alias("alternateId")).alias("actor"),
            F.struct(F.col("src_ip").alias("ipAddress")).alias("client"),
        )
    )
    return e.select(F.col("event_id").alias("event_key"), line.alias("value"))


def zeek_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection log rows with flat dotted names, as text, ``-`` for unknown."""
    e = events(spark, sf_dir).filter(F.col("class_uid") == 4001)
    n = F.col("event_id")

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("-"))

    return e.select(
        n.alias("event_key"),
        F.format_string("%d.%03d", F.expr("time div 1000"), F.col("time") % 1000).alias("ts"),
        F.concat(F.lit("C"), n.cast("string")).alias("uid"),
        text(F.col("src_ip")).alias("id.orig_h"),
        text(F.lit(49_152) + n % 1000).alias("id.orig_p"),
        text(F.col("dst_ip")).alias("id.resp_h"),
        text(F.col("dst_port")).alias("id.resp_p"),
        _pick(("tcp", "udp", "icmp", "gre"), n % 4).alias("proto"),
        text(F.when(n % 13 != 0, F.col("bytes_out"))).alias("orig_bytes"),
        text(F.col("bytes_in")).alias("resp_bytes"),
        _pick(CONN_STATES, n % 10).alias("conn_state"),
        text(n % 50).alias("orig_pkts"),
        text(n % 40).alias("resp_pkts"),
    )


ZEEK_COLUMNS = (
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto",
    "orig_bytes", "resp_bytes", "conn_state", "orig_pkts", "resp_pkts",
)


def sysmon_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process-creation events from ``documents``."""
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    return d.select(
        n.alias("event_key"),
        F.when(n % 9 == 0, 3).otherwise(1).alias("EventID"),
        F.date_format(F.timestamp_millis(F.lit(START_US // 1000) + n * 1001), "yyyy-MM-dd HH:mm:ss.SSS").alias("UtcTime"),
        F.concat(F.lit("C:\\Apps/"), F.col("source"), F.lit("\\p"), (n % 13).cast("string"), F.lit(".exe")).alias("Image"),
        (n % 30_000).cast("int").alias("ProcessId"),
        F.col("text").alias("CommandLine"),
        F.concat(F.lit("C:\\Windows\\"), F.col("lang"), F.lit(".exe")).alias("ParentImage"),
        (n % 700).cast("int").alias("ParentProcessId"),
        F.concat(F.lit("ACME\\u"), (n % 40).cast("string")).alias("User"),
        F.concat(F.lit("WS-"), F.col("source")).alias("Computer"),
    )


def cloudtrail_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud audit events as JSON text, MFA in three states."""
    e = read(spark, sf_dir, "events")
    n, who = F.col("event_id"), F.col("user_id")
    login = F.col("event_type").isin("signup", "error")
    failed = F.col("event_type") == "error"
    mfa = F.when(who % 3 == 0, "Yes").when(who % 3 == 1, "No")
    line = F.to_json(
        F.struct(
            F.concat(F.date_format(utc(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("eventTime"),
            F.when(login, "ConsoleLogin").otherwise(_pick(API_CALLS, n % 15)).alias("eventName"),
            F.concat(F.lit("198.51.100."), (who % 250).cast("string")).alias("sourceIPAddress"),
            F.struct(F.concat(F.lit("user"), who.cast("string")).alias("userName")).alias("userIdentity"),
            F.when(login, F.struct(F.when(failed, "Failure").otherwise("Success").alias("ConsoleLogin"))).alias(
                "responseElements"
            ),
            F.when(login, F.struct(mfa.alias("MFAUsed"))).alias("additionalEventData"),
            F.when(~login & (n % 10 == 0), "AccessDenied").alias("errorCode"),
        )
    )
    return e.select(n.alias("event_key"), line.alias("value"))


def mfa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login records whose MFA attribute is true, false, explicitly null or absent."""
    case = F.col("user_id") % 4
    attributes = (
        F.when(case == 0, '{"mfaAuthenticated":"true"}')
        .when(case == 1, '{"mfaAuthenticated":"false"}')
        .when(case == 2, '{"mfaAuthenticated":null}')
        .otherwise("{}")
    )
    body = F.concat(
        F.lit('{"eventName":"ConsoleLogin","userIdentity":{"sessionContext":{"attributes":'), attributes, F.lit("}}}")
    )
    return read(spark, sf_dir, "events").select(F.col("event_id"), body.alias("body"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field mappings spelled by ``lineitem`` rows: a source field and the path it was mapped to."""
    sources = (
        "username", "process_name", "image", "src_ip", "dst_ip", "group", "url", "file_path",
        "sessionid", "service", "real_user", "note", "Host.Name",
    )
    paths = (
        "actor.user.name", "process.name", "process.file.path", "src_endpoint.ip", "dst_endpoint.ip",
        "actor.group.name", "url", "connection_info.uid", "session.uid", "metadata.version", "src.port",
    )
    return read(spark, sf_dir, "lineitem").select(
        _pick(sources, (F.col("l_partkey") + F.col("l_linenumber")) % len(sources)).alias("source_field"),
        _pick(paths, F.col("l_orderkey") % len(paths)).alias("ocsf_path"),
    )


_IS_NET = "event_type IN ('view', 'click')"
_PREFIX = """CASE WHEN doc_id % 7 = 0 THEN 'cmd.exe /c VSSADMIN Delete Shadows /all /quiet '
     WHEN doc_id % 11 = 0 THEN 'procdump -ma LSASS.exe out.dmp ' ELSE '' END"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), f"""
SELECT event_id, epoch_us(ts) AS time_us, epoch_us(ts) // 1000 AS time,
  CASE WHEN {_IS_NET} THEN 4001 WHEN event_type = 'purchase' THEN 6003 ELSE 3002 END AS class_uid,
  CASE WHEN {_IS_NET} THEN 4 WHEN event_type = 'purchase' THEN 6 ELSE 3 END AS category_uid,
  CASE WHEN event_type = 'view' THEN 6 WHEN event_type IN ('click', 'purchase') THEN 2 ELSE 1 END AS activity_id,
  CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status_id,
  CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_id % 97 <> 0 THEN '10.0.' || ((user_id // 250) % 250) || '.' || (user_id % 250) END AS src_ip,
  CASE WHEN {_IS_NET} THEN '203.0.113.' || (event_id % 16) END AS dst_ip,
  CASE WHEN {_IS_NET} THEN {_sql_list(PORTS)}[event_id % 8 + 1] END AS dst_port,
  CASE WHEN event_type IN ('signup', 'error') THEN 'user' || user_id || '@acme.example' END AS "user",
  CASE WHEN event_type = 'purchase' THEN 'svc' || user_id || '@acme.example' END AS actor_user,
  CAST(CASE WHEN {_IS_NET} THEN floor(value * 8) WHEN event_type = 'purchase' THEN floor(value * 80) END AS BIGINT)
    AS bytes_out,
  CAST(CASE WHEN {_IS_NET} THEN floor(value * 3) END AS BIGINT) AS bytes_in
FROM events"""),
    "pr": ((), f"""
SELECT doc_id, {START_US // 1000} + doc_id * 1000 AS time, 1007 AS class_uid, 1 AS category_uid, 1 AS activity_id,
  'host-' || source AS device_hostname, {_PREFIX} || text AS cmd_line
FROM documents"""),
    "oc": (("ev", "pr"), """
SELECT time, class_uid, category_uid, activity_id, status_id, status, src_ip, dst_ip, dst_port, "user", actor_user,
  bytes_out, bytes_in, NULL AS device_hostname, NULL AS cmd_line FROM ev
UNION ALL
SELECT time, class_uid, category_uid, activity_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  device_hostname, cmd_line FROM pr"""),
    "fl": ((), f"""
SELECT epoch_ms(l_shipdate) + ((l_orderkey * 7 + l_linenumber) % 86400) * 1000 AS time,
  4001 AS class_uid, 6 AS activity_id,
  '10.1.' || ((l_suppkey // 250) % 250) || '.' || (l_suppkey % 250) AS src_ip,
  '172.16.' || ((l_partkey // 250) % 250) || '.' || (l_partkey % 250) AS dst_ip,
  {_sql_list(PORTS)}[(l_linenumber + l_orderkey) % 8 + 1] AS dst_port,
  CAST(l_quantity AS BIGINT) * 10 AS bytes_out, CAST(floor(l_extendedprice) AS BIGINT) AS bytes_in
FROM lineitem"""),
    "hv": ((), r"""
SELECT event_type AS source, epoch_us(ts) AS event_time_us,
  epoch_us(ts) + CAST(floor(value * 200000) AS BIGINT) AS ingest_time_us,
  (event_id * 7919) % 4001 - 2000 + CASE WHEN event_type = 'error' THEN 90000 ELSE 0 END AS clock_offset_ms,
  CASE WHEN event_id % 33 = 0 THEN NULL WHEN event_type = 'signup' THEN 'u' || user_id || '@acme.example'
       WHEN event_id % 12 = 0 THEN 'u' || user_id ELSE 'ACME\u' || user_id END AS "user",
  event_id % 50 <> 0 AS landed
FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 67 = 0)"""),
    "inv": ((), """
SELECT 'cmdb' AS tool, 'Web-' || c_custkey AS raw_id, CAST(NULL AS TIMESTAMP) AS last_seen FROM customer
UNION ALL SELECT 'cmdb', 'web-' || c_custkey || '.local', NULL FROM customer WHERE c_custkey % 50 = 0
UNION ALL SELECT 'edr', 'web-' || o_custkey || '.corp', CAST(o_orderdate AS TIMESTAMP) FROM orders
UNION ALL SELECT 'scanner', 'WEB-' || user_id, CAST(ts AS TIMESTAMP) FROM events"""),
    "ls": (("inv",), """
SELECT tool, raw_id, max(last_seen) AS last_seen FROM inv WHERE raw_id IS NOT NULL GROUP BY tool, raw_id"""),
    "co": ((), f"""
SELECT DISTINCT 'T' || (1000 + t) AS off_tech_id,
  CASE WHEN t % 16 = 0 THEN '' ELSE 'D3-' || d END AS d3fend_id,
  CASE WHEN t % 16 = 0 THEN '' ELSE 'Defense ' || d END AS def_tech,
  CASE WHEN t % 16 = 0 THEN '' ELSE {_sql_list(PHASES)}[d % 7 + 1] END AS phase,
  CASE WHEN t % 16 = 0 THEN '' ELSE {_sql_list(PHASES)}[d % 7 + 1] END AS tactic,
  CASE WHEN t % 16 = 0 THEN 'zero_defense' ELSE lower({_sql_list(PHASES)}[d % 7 + 1]) END AS band,
  CASE WHEN t % 16 = 0 THEN 0 ELSE 1 + (t + d) % 3 END AS shared_artifacts,
  CASE WHEN t % 16 = 0 THEN '' ELSE {_sql_list(LABELS)}[(t + d) % 12 + 1]
    || CASE WHEN (t + d) % 3 >= 1 THEN '|' || {_sql_list(LABELS)}[(t + d + 5) % 12 + 1] ELSE '' END
    || CASE WHEN (t + d) % 3 >= 2 THEN '|' || {_sql_list(LABELS)}[(t + d + 7) % 12 + 1] ELSE '' END
  END AS shared_artifact_names,
  CASE WHEN t % 16 = 0 THEN 0.0 ELSE 0.25 END AS trust
FROM (SELECT DISTINCT l_partkey % {N_TECHNIQUES} AS t,
        (l_partkey % {N_TECHNIQUES} * 3 + l_linenumber) % {N_DEFENSES} AS d FROM lineitem)"""),
    "te": ((), f"""
SELECT DISTINCT 'T' || (1000 + t) AS technique, 'tactic-' || (t % 14) AS tactic,
  {_sql_list(CLASS_CYCLE)}[t % 5 + 1] AS class_uid, t % 3 <> 0 AS has_detection
FROM (SELECT DISTINCT p_partkey % {N_TECHNIQUES} AS t FROM part)"""),
    "fi": ((), f"""
SELECT 'T' || (1000 + p_partkey % {N_TECHNIQUES}) AS technique, count(*) FILTER (p_brand = 'Brand#7') AS n_findings
FROM part GROUP BY 1"""),
    "ms": ((), f"""
SELECT 'T' || (1000 + t) AS att_ck, CASE t % 4 WHEN 0 THEN 'DETECTED' WHEN 1 THEN 'MISSED' ELSE 'NOISY' END AS state,
  (t % 10) / 10.0 AS precision, matches
FROM (SELECT p_partkey % {N_TECHNIQUES} AS t, count(*) AS matches FROM part GROUP BY 1) WHERE t % 4 <> 3"""),
    "mo": ((), f"""
SELECT DISTINCT 'D3-' || (l_suppkey % {N_DEFENSES}) AS defense,
  (l_suppkey % {N_DEFENSES} * 5 + l_linenumber) % 97 AS artifact FROM lineitem"""),
    "po": ((), f"""
SELECT DISTINCT 'T' || (1000 + l_partkey % {N_TECHNIQUES}) AS offense,
  (l_partkey % {N_TECHNIQUES} * 7 + l_linenumber * 3) % 131 AS artifact FROM lineitem"""),
    "finding": ((), """
SELECT 'F' || o_orderkey AS finding_uid, CAST(o_orderdate AS TIMESTAMP) AS event_time,
  CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP)
    - to_hours(CAST(o_custkey % 72 AS INTEGER)) - to_minutes(CAST(o_custkey % 60 AS INTEGER)) END AS first_seen_time,
  CASE o_orderstatus WHEN 'F' THEN 'False Positive' WHEN 'P' THEN 'Suspicious' END AS verdict,
  'T' || (1000 + o_custkey % 500) AS technique_id, 'R' || (o_custkey % 150) AS rule_uid FROM orders"""),
    "rule": ((), f"""
SELECT 'R' || s_suppkey AS rule_uid,
  CASE WHEN s_suppkey % 9 <> 0 THEN 'T' || (1000 + s_suppkey * 3 % {N_TECHNIQUES}) END AS technique_id FROM supplier"""),
    "tech": (("te",), "SELECT technique AS technique_id FROM te"),
    "atlas": ((), f"""
SELECT 'AML.T' || p_partkey AS atlas_id, ['Feasible', 'Demonstrated', 'Realized'][p_partkey % 3 + 1] AS maturity,
  CASE WHEN p_partkey % 5 = 0 THEN 'T' || (1000 + p_partkey % {N_TECHNIQUES}) END AS attack_technique_id FROM part"""),
    "bridge": (("co",), """
SELECT off_tech_id AS attack_technique_id, d3fend_id, phase AS d3fend_tactic, shared_artifacts
FROM co WHERE band <> 'zero_defense'"""),
    "d3": ((), f"SELECT DISTINCT 'D3-' || (s_suppkey % {N_DEFENSES}) AS d3fend_id FROM supplier"),
    "cmap": ((), f"""
SELECT DISTINCT * FROM (SELECT 'T' || (1000 + l_partkey % {N_TECHNIQUES}) AS attack_technique_id,
  {_sql_list(CLASS_CYCLE)}[l_partkey % {N_TECHNIQUES} % 5 + 1] AS ocsf_class_uid FROM lineitem)
WHERE ocsf_class_uid <> 6001"""),
    "auth": (("ev",), "SELECT time AS event_time, status_id FROM ev WHERE class_uid = 3002"),
    "vr": ((), f"""
SELECT event_type AS table_name, strftime(ts, '%Y-%m-%d') AS day,
  {_sql_list(CHECK_CYCLE)}[event_id % 6 + 1] AS "check",
  CASE WHEN event_id % 29 = 0 THEN 'fail' WHEN event_id % 31 = 0 THEN 'stale'
       WHEN event_id % 37 = 0 THEN 'unmeasured' ELSE 'pass' END AS status FROM events"""),
    "zk": (("ev",), f"""
SELECT event_id, time, src_ip, 49152 + event_id % 1000 AS src_port, dst_ip, dst_port,
  CASE event_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 1 END AS protocol_num,
  {_sql_list(CONN_STATES)}[event_id % 10 + 1] AS conn_state,
  CASE WHEN event_id % 10 IN (0, 3, 6, 7, 8, 9) THEN 2 WHEN event_id % 10 = 1 THEN 4
       WHEN event_id % 10 = 2 THEN 5 ELSE 6 END AS activity_id,
  CASE WHEN event_id % 13 <> 0 THEN bytes_out END AS bytes_out, bytes_in,
  event_id % 50 AS packets_out, event_id % 40 AS packets_in FROM ev WHERE class_uid = 4001"""),
    "ct": ((), f"""
SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS time,
  CASE WHEN event_type IN ('signup', 'error') THEN 3002 ELSE 6003 END AS class_uid,
  CASE WHEN event_type IN ('signup', 'error') THEN 3 ELSE 6 END AS category_uid,
  CASE WHEN event_type IN ('signup', 'error') THEN 1
       ELSE [2, 2, 2, 4, 4, 4, 3, 3, 3, 3, 3, 1, 1, 1, 99][event_id % 15 + 1] END AS activity_id,
  CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'signup' THEN 1
       WHEN event_id % 10 = 0 THEN 2 ELSE 1 END AS status_id,
  CASE WHEN event_type IN ('signup', 'error') THEN 'user' || user_id END AS user_name,
  CASE WHEN event_type NOT IN ('signup', 'error') THEN 'user' || user_id END AS actor_user,
  '198.51.100.' || (user_id % 250) AS src_ip,
  CASE WHEN event_type NOT IN ('signup', 'error') THEN {_sql_list(API_CALLS)}[event_id % 15 + 1] END AS api_operation,
  CASE WHEN event_type IN ('signup', 'error') THEN
    CASE user_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END END AS is_mfa,
  CASE WHEN event_type IN ('signup', 'error') THEN user_id % 3 <> 2 END AS is_mfa_present FROM events"""),
    "mp": ((), """
SELECT ['username', 'process_name', 'image', 'src_ip', 'dst_ip', 'group', 'url', 'file_path', 'sessionid', 'service',
        'real_user', 'note', 'Host.Name'][(l_partkey + l_linenumber) % 13 + 1] AS source_field,
  ['actor.user.name', 'process.name', 'process.file.path', 'src_endpoint.ip', 'dst_endpoint.ip', 'actor.group.name',
   'url', 'connection_info.uid', 'session.uid', 'metadata.version', 'src.port'][l_orderkey % 11 + 1] AS ocsf_path
FROM lineitem"""),
}


def sql(views: str, body: str) -> str:
    """A query over the named views, with the views it needs in front.

    A body that starts with a comma adds views of its own.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for dependency in VIEWS[name][0]:
            add(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        add(name)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)
    return f"WITH {ctes}\n{body.strip()}"
