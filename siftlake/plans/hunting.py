"""Predicates, hunts, profiles, pivots, correlation, address blocks and inventories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import cidr_match, ipv4_to_long, strip_domain_suffix
from siftlake.operators import correlate as co
from siftlake.operators import detections as dt
from siftlake.operators import inventory as iv
from siftlake.operators import pivot as pv
from siftlake.operators import predicates as pr
from siftlake.operators import profile as pf
from siftlake.operators import rollups as rl
from siftlake.operators import rules as ru
from siftlake.plans import tables as t
from siftlake.plans.catalog import query
from siftlake.plans.tables import sql
from siftlake.session import materialise


def _count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


@query(
    "pred_compare",
    sql("ev", """
SELECT count(*) FILTER (dst_port = 443) AS eq, count(*) FILTER (dst_port <> 443) AS ne,
  count(*) FILTER (bytes_out > 500) AS gt, count(*) FILTER (bytes_out >= 500) AS ge,
  count(*) FILTER (bytes_out < 500) AS lt, count(*) FILTER (bytes_out <= 500) AS le FROM ev"""),
)
def _pred_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {
        "eq": ("dst_port", "=", 443), "ne": ("dst_port", "!=", 443), "gt": ("bytes_out", ">", 500),
        "ge": ("bytes_out", ">=", 500), "lt": ("bytes_out", "<", 500), "le": ("bytes_out", "<=", 500),
    }
    return t.events(spark, sf_dir).agg(*[F.count_if(pr.predicate(*test)).alias(k) for k, test in tests.items()])


@query(
    "pred_contains",
    sql("pr", """
SELECT device_hostname, count(*) FILTER (lower(cmd_line) LIKE '%lsass%') AS lsass,
  count(*) FILTER (contains(lower(cmd_line), '100%')) AS literal_percent FROM pr GROUP BY device_hostname"""),
)
def _pred_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmd = F.col("cmd_line")
    return t.processes(spark, sf_dir).groupBy("device_hostname").agg(
        F.count_if(pr.pred_contains(cmd, "LSASS")).alias("lsass"),
        F.count_if(pr.pred_contains(cmd, "100%")).alias("literal_percent"),
    )


@query(
    "sigma_predicate",
    sql("ev", """
SELECT 'RDP Network Connection' AS rule, 'attack.lateral_movement,attack.t1021.001' AS tags, TRUE AS compiled,
  count(*) FILTER (dst_port = 3389) AS matches FROM ev
UNION ALL SELECT 'Failed login', 'attack.t1110', TRUE, count(*) FILTER (class_uid = 3002 AND status_id = 2) FROM ev
UNION ALL SELECT 'Shadow copies', 'attack.t1490', FALSE, NULL"""),
)
def _sigma_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        pr.RDP_RULE,
        pr.SigmaRule("Failed login", (("class_uid", "=", 3002), ("status_id", "=", 2)), ("attack.t1110",)),
        pr.SigmaRule("Shadow copies", (("cmd_line", "contains", "vssadmin"),), ("attack.t1490",)),
    ]
    return pr.sigma_predicate(t.events(spark, sf_dir), rules)


_RULE_TREES = (
    ("and", "a", "b"), ("and", "a", ("not", "b")), ("of", 2, "a", "b", "c"), ("or", "c", ("not", ("or", "a", "b"))),
)


def _rule_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A rule per part, its tests and its condition."""
    k = F.col("p_partkey")
    ports = [F.element_at(F.array(*[F.lit(str(p)) for p in t.PORTS]), ((k + shift) % 8 + 1).cast("int")) for shift in (0, 3)]
    dotted = lambda c: F.concat(F.lit("."), c.cast("string"))
    test = lambda s, field, modifier, value: F.struct(
        F.lit(s).alias("selection"), F.lit(field).alias("field"), F.lit(modifier).alias("modifier"),
        F.lit(False).alias("all_of"), value.alias("value"),
    )
    every = F.array(
        test("a", "src_ip", "endswith", dotted(k % 250)), *[test("a", "dst_port", "", p) for p in ports],
        test("b", "dst_ip", "endswith", dotted(k % 16)), test("b", "src_ip", "endswith", dotted(k % 125)),
        test("c", "user", "contains", F.concat(F.lit("ER"), (k % 300).cast("string"), F.lit("@"))),
    )
    parts = t.read(spark, sf_dir, "part").select(F.concat(F.lit("rule "), k.cast("string")).alias("rule"), "p_partkey")
    terms = F.lit(None).cast(ru.TERMS)
    for i, tree in enumerate(_RULE_TREES):
        own = [
            F.struct(*[F.array(*map(F.lit, x)).cast("array<string>").alias(n) for n, x in zip(("need", "forbid"), term, strict=True)])
            for term in ru.terms_of(tree)
        ]
        terms = F.when(k % 4 == i, F.array(*own)).otherwise(terms)
    return parts.select("rule", F.inline(every)), parts.select("rule", F.lit("attack.t1021").alias("tags"), terms.alias("terms"))


@query(
    "sigma_rule_table",
    sql("ev", """
, c AS (SELECT src_ip, dst_ip, dst_port, "user" AS u, count(*) AS n FROM ev GROUP BY ALL),
r AS (SELECT p_partkey AS k, c.n,
  coalesce(ends_with(src_ip, '.' || (p_partkey % 250)), FALSE) AND coalesce(dst_port IN (
    [80, 443, 22, 53, 3389, 445, 8080, 3306][p_partkey % 8 + 1], [80, 443, 22, 53, 3389, 445, 8080, 3306][(p_partkey + 3) % 8 + 1]), FALSE) AS a,
  coalesce(ends_with(dst_ip, '.' || (p_partkey % 16)) AND ends_with(src_ip, '.' || (p_partkey % 125)), FALSE) AS b,
  coalesce(contains(u, 'er' || (p_partkey % 300) || '@'), FALSE) AS c FROM part, c)
SELECT 'rule ' || k AS rule, 'attack.t1021' AS tags, TRUE AS compiled, CAST(coalesce(sum(n) FILTER (CASE k % 4
  WHEN 0 THEN a AND b WHEN 1 THEN a AND NOT b WHEN 2 THEN a::INT + b::INT + c::INT >= 2 ELSE c OR NOT (a OR b) END), 0) AS BIGINT) AS matches
FROM r GROUP BY k"""),
)
def _sigma_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every part, matched against all events at once."""
    return ru.rule_matches(t.events(spark, sf_dir), *_rule_tables(spark, sf_dir))


@query("needle_count", sql("fl", "SELECT count(*) AS n FROM fl WHERE dst_port = 3389"))
def _needle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.needle_count(t.flows(spark, sf_dir))


_IP_NUM = """
  (split_part({c}, '.', 1)::BIGINT * 16777216 + split_part({c}, '.', 2)::BIGINT * 65536
   + split_part({c}, '.', 3)::BIGINT * 256 + split_part({c}, '.', 4)::BIGINT)"""


@query(
    "cidr_match",
    sql("fl", f"""
SELECT count(*) FILTER (ip BETWEEN 2886729728 AND 2886730239) AS in_23,
  count(*) FILTER (ip BETWEEN 2886729760 AND 2886729763) AS in_30, count(*) AS n
FROM (SELECT {_IP_NUM.format(c="dst_ip")} AS ip FROM fl)"""),
)
def _cidr_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips = t.flows(spark, sf_dir).select(ipv4_to_long(F.col("dst_ip")).alias("ip_num"))
    ip = F.col("ip_num")
    return ips.agg(
        F.count_if(cidr_match(ip, "172.16.0.0/23")).alias("in_23"),
        F.count_if(cidr_match(ip, "172.16.0.32/30")).alias("in_30"),
        _count(),
    )


def _cidrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of many sizes, spelled from the part keys; they overlap."""
    p = F.col("p_partkey")
    length = F.element_at(F.array(*[F.lit(n) for n in (12, 16, 20, 24, 27, 30, 32)]), (p % 7 + 1).cast("int"))
    base = F.concat(
        F.lit("172."), (F.lit(16) + p % 3).cast("string"), F.lit("."), F.expr("(p_partkey div 250) % 250").cast("string"),
        F.lit("."), (p % 250).cast("string"), F.lit("/"), length.cast("string"),
    )
    return t.read(spark, sf_dir, "part").select(base.alias("cidr"))


@query(
    "cidr_join",
    sql("fl", f"""
, blocks AS (SELECT DISTINCT cidr, len, {_IP_NUM.format(c="base")} // (1::BIGINT << (32 - len)) AS net
  FROM (SELECT base || '/' || len AS cidr, base, len FROM (
    SELECT '172.' || (16 + p_partkey % 3) || '.' || ((p_partkey // 250) % 250) || '.' || (p_partkey % 250) AS base,
      [12, 16, 20, 24, 27, 30, 32][p_partkey % 7 + 1] AS len FROM part))),
ips AS (SELECT ip, count(*) AS n FROM (SELECT {_IP_NUM.format(c="dst_ip")} AS ip FROM fl) GROUP BY ip)
SELECT cidr, 'ok' AS status, count(ip) AS n_ips, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_events
FROM blocks LEFT JOIN ips ON ip // (1::BIGINT << (32 - len)) = net GROUP BY cidr
UNION ALL SELECT DISTINCT 'block ' || p_size || '/24', 'unparsable', NULL, NULL FROM part"""),
)
def _cidr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips = t.flows(spark, sf_dir).select(ipv4_to_long(F.col("dst_ip")).alias("ip_num"))
    bad = t.read(spark, sf_dir, "part").select(F.concat(F.lit("block "), F.col("p_size").cast("string"), F.lit("/24")).alias("cidr"))
    return co.cidr_join(ips, _cidrs(spark, sf_dir).unionByName(bad))


@query("key_allow_list", sql("ev", "SELECT 'url,cmd_line' AS refused, count(DISTINCT src_ip) AS n_groups FROM ev"))
def _key_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are refused when the plan is built, and a grouping over one that is allowed."""
    refused = []
    for key in ("src_ip", "url", "cmd_line", "dst_port"):
        try:
            pr.key_allow_list([key])
        except ValueError:
            refused.append(key)
    return t.events(spark, sf_dir).agg(
        F.lit(",".join(refused)).alias("refused"), F.count_distinct("src_ip").alias("n_groups")
    )


@query(
    "entity_match_any",
    sql("ev", """
SELECT class_uid, count(*) AS n FROM ev WHERE src_ip = '203.0.113.5' OR dst_ip = '203.0.113.5' GROUP BY class_uid"""),
)
def _entity_match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = pr.entity_match_any(t.events(spark, sf_dir), pv.ENTITY_TYPES["ip"].match, "203.0.113.5")
    return hits.groupBy("class_uid").agg(_count())


@query(
    "null_in_exclusion_guard",
    sql("ev", """
SELECT count(*) FILTER (src_ip IS NULL) AS n_null, count(*) FILTER (src_ip IS NULL) = 0 AS ok,
  count(*) FILTER (src_ip IS NULL OR src_ip NOT IN (SELECT src_ip FROM ev WHERE status_id = 2 AND src_ip IS NOT NULL))
    AS kept FROM ev"""),
)
def _null_in_exclusion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.events(spark, sf_dir)
    kept = pr.exclude(events, events.filter(F.col("status_id") == 2), "src_ip").agg(_count("kept"))
    return pr.null_in_exclusion_guard(events, "src_ip").withColumn("kept", kept.scalar())


# -- counts and profiles


@query("count_all", sql("fl", "SELECT count(*) AS n FROM fl"))
def _count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.count_all(t.flows(spark, sf_dir))


@query("group_port_distribution", sql("fl", "SELECT dst_port, count(*) AS n FROM fl GROUP BY dst_port"))
def _group_port_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.group_distribution(t.flows(spark, sf_dir), "dst_port")


@query("distinct_src_ip", sql("fl", "SELECT count(DISTINCT src_ip) AS n_distinct FROM fl"))
def _distinct_src_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.distinct_count(t.flows(spark, sf_dir), "src_ip")


@query(
    "distinct_src_ip_approx",
    sql("fl", "SELECT count(DISTINCT src_ip) AS n_distinct, TRUE AS within_5_percent FROM fl"),
)
def _distinct_src_ip_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch next to the exact number: only its error is an equality."""
    flows = t.flows(spark, sf_dir)
    sketch = pf.distinct_count(flows, "src_ip", approximate=True).scalar()
    exact = pf.distinct_count(flows, "src_ip")
    off = F.abs(sketch - F.col("n_distinct")) <= 0.05 * F.col("n_distinct")
    return exact.select("n_distinct", off.alias("within_5_percent"))


@query("by_class", sql("oc", "SELECT CAST(class_uid AS VARCHAR) AS key, count(*) AS n FROM oc GROUP BY 1"))
def _by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.by_enum(t.ocsf(spark, sf_dir), "class_uid")


@query("by_activity", sql("oc", "SELECT CAST(activity_id AS VARCHAR) AS key, count(*) AS n FROM oc GROUP BY 1"))
def _by_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.by_enum(t.ocsf(spark, sf_dir), "activity_id")


@query("by_status", sql("oc", """
SELECT coalesce(CAST(status_id AS VARCHAR), '<null>') AS key, count(*) AS n FROM oc GROUP BY 1"""))  # fmt: skip
def _by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enum that is NULL for process events."""
    return pf.by_enum(t.ocsf(spark, sf_dir), "status_id")


@query("time_span", sql("oc", "SELECT 'time' AS field, min(time) AS first_time, max(time) AS last_time FROM oc"))
def _time_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.time_span(t.ocsf(spark, sf_dir))


@query("top_sources", sql("fl", "SELECT src_ip AS source, count(*) AS n FROM fl GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"))
def _top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.top_sources(t.flows(spark, sf_dir))


_PROFILE_FIELDS = (
    "time", "class_uid", "category_uid", "activity_id", "status_id", "status", "src_ip", "dst_ip", "dst_port",
    "user", "actor_user", "bytes_out", "bytes_in", "device_hostname", "cmd_line",
)


@query(
    "analyze_table",
    sql("oc", "SELECT 'row_count' AS view, '' AS key, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM oc"
        + "".join(
            f" UNION ALL SELECT 'non_null', '{c}', count(\"{c}\"), min(time), max(time) FROM oc" for c in _PROFILE_FIELDS
        )
        + """
UNION ALL SELECT 'by_class', CAST(class_uid AS VARCHAR), count(*), min(time), max(time) FROM oc GROUP BY class_uid
UNION ALL SELECT 'by_activity', CAST(activity_id AS VARCHAR), count(*), min(time), max(time) FROM oc GROUP BY activity_id
UNION ALL (SELECT 'top_sources', src_ip, count(*) AS n, min(time), max(time) FROM oc WHERE src_ip IS NOT NULL
  GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10)"""),
)
def _analyze_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.analyze_table(t.ocsf(spark, sf_dir))[0]


_IP = "203.0.113.5"


@query(
    "entity_profile",
    sql("ev", f"""
, hits AS (SELECT * FROM ev WHERE src_ip = '{_IP}' OR dst_ip = '{_IP}')
SELECT 'total' AS view, '' AS key, count(*) AS n, min(time) AS first_seen, max(time) AS last_seen FROM hits
UNION ALL SELECT 'by_class', CAST(class_uid AS VARCHAR), count(*), min(time), max(time) FROM hits GROUP BY class_uid
UNION ALL SELECT 'by_activity', CAST(activity_id AS VARCHAR), count(*), min(time), max(time) FROM hits
  GROUP BY activity_id
UNION ALL (SELECT 'peer', peer, count(*) AS n, min(time), max(time) FROM (
    SELECT dst_ip AS peer, time FROM hits WHERE src_ip = '{_IP}'
    UNION ALL SELECT src_ip, time FROM hits WHERE dst_ip = '{_IP}')
  WHERE peer IS NOT NULL AND peer <> '{_IP}' GROUP BY peer ORDER BY n DESC, peer LIMIT 10)"""),
)
def _entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.entity_profile(t.events(spark, sf_dir), "ip", _IP)[0]


@query(
    "entity_profile_all",
    sql("ev", """
, roles AS (SELECT src_ip AS entity, * FROM ev WHERE src_ip IS NOT NULL
  UNION ALL SELECT dst_ip, * FROM ev WHERE dst_ip IS NOT NULL AND dst_ip IS DISTINCT FROM src_ip)
SELECT entity, 'total' AS view, '' AS key, count(*) AS n, min(time) AS first_seen, max(time) AS last_seen FROM roles
  GROUP BY entity
UNION ALL SELECT entity, 'by_class', CAST(class_uid AS VARCHAR), count(*), min(time), max(time) FROM roles
  GROUP BY entity, class_uid
UNION ALL SELECT entity, 'by_activity', CAST(activity_id AS VARCHAR), count(*), min(time), max(time) FROM roles
  GROUP BY entity, activity_id"""),
)
def _entity_profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.entity_profile_all(t.events(spark, sf_dir), "ip")


_PAIRS = """
SELECT entity, peer, count(*) AS n FROM (SELECT src_ip AS entity, dst_ip AS peer FROM {v}
  UNION ALL SELECT dst_ip, src_ip FROM {v}) WHERE entity <> peer GROUP BY entity, peer"""


@query("peers_union", sql("fl", _PAIRS.format(v="fl")))
def _peers_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.peers_union(t.flows(spark, sf_dir), "ip")


@query(
    "top_counterparts",
    sql("fl", f"SELECT peer, n FROM ({_PAIRS.format(v='fl')}) WHERE entity = '10.1.0.7' ORDER BY n DESC, peer LIMIT 10"),
)
def _top_counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.top_counterparts(t.flows(spark, sf_dir), "ip", "10.1.0.7")


@query(
    "top_n_per_entity",
    sql("fl", f"""
SELECT * FROM (SELECT entity, peer, n, row_number() OVER (PARTITION BY entity ORDER BY n DESC, peer) AS rank
  FROM ({_PAIRS.format(v='fl')})) WHERE rank <= 3"""),
)
def _top_n_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.top_n_per_entity(t.flows(spark, sf_dir), "ip", 3)


# -- hunts


def _hunt(name: str, spec_id: str, oracle: str, source: Callable[[SparkSession, str], DataFrame]) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dt.findings(source(spark, sf_dir), dt.BY_ID[spec_id])


_hunt("detect_c2_beacon", "c2_beacon", sql("ev", """
SELECT src_ip, dst_ip, count(*) AS connections, avg(bytes_out) AS avg_bytes_out FROM ev WHERE class_uid = 4001
GROUP BY src_ip, dst_ip HAVING count(*) >= 3 AND avg(bytes_out) < 256"""), t.events)  # fmt: skip
_hunt("detect_exfil_egress", "exfil_egress", sql("ev", """
SELECT src_ip, CAST(sum(bytes_out) AS BIGINT) AS total_bytes_out, count(*) AS flows FROM ev WHERE class_uid = 4001
GROUP BY src_ip HAVING sum(bytes_out) >= 10000"""), t.events)  # fmt: skip
_hunt("detect_credential_stuffing", "credential_stuffing", sql("ev", """
SELECT src_ip, count(*) AS failed_attempts, count(DISTINCT "user") AS distinct_users FROM ev
WHERE class_uid = 3002 AND status_id = 2 GROUP BY src_ip HAVING count(*) >= 5"""), t.events)  # fmt: skip
_hunt("detect_shadow_copy_deletion", "shadow_copy_deletion", sql("pr", """
SELECT device_hostname, count(*) AS executions FROM pr
WHERE contains(lower(cmd_line), 'vssadmin delete shadows') GROUP BY device_hostname"""), t.processes)  # fmt: skip
_hunt("detect_lsass_access", "lsass_credential_access", sql("pr", """
SELECT device_hostname, count(*) AS events FROM pr WHERE contains(lower(cmd_line), 'lsass')
GROUP BY device_hostname"""), t.processes)  # fmt: skip
_hunt("detect_api_bulk_retrieval", "api_bulk_retrieval", sql("ev", """
SELECT actor_user, count(*) AS operations, CAST(sum(bytes_out) AS BIGINT) AS total_bytes FROM ev
WHERE class_uid = 6003 GROUP BY actor_user HAVING sum(bytes_out) >= 50000"""), t.events)  # fmt: skip


@query("detect_bruteforce", sql("ev", """
SELECT src_ip, count(*) AS fails FROM ev WHERE status = 'FAILURE' GROUP BY src_ip HAVING count(*) >= 5"""))  # fmt: skip
def _detect_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.detect_bruteforce(t.events(spark, sf_dir))


@query("rank_findings", sql("ev", """
SELECT src_ip, CAST(sum(bytes_out) AS BIGINT) AS total_bytes_out, count(*) AS flows FROM ev WHERE class_uid = 4001
GROUP BY src_ip HAVING sum(bytes_out) >= 10000 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 20"""))  # fmt: skip
def _rank_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = dt.BY_ID["exfil_egress"]
    return dt.rank_findings(dt.findings(t.events(spark, sf_dir), spec), spec, 20)


_ALL_HUNTS = """
, f AS (
SELECT 'c2_beacon' AS id, 'T1071' AS tech, src_ip AS k0, dst_ip AS k1, count(*)::DOUBLE AS rk,
    [{'m': 'connections', 'v': count(*)::DOUBLE}, {'m': 'avg_bytes_out', 'v': avg(bytes_out)}] AS ms
  FROM oc WHERE class_uid = 4001 GROUP BY 3, 4 HAVING count(*) >= 3 AND avg(bytes_out) < 256
UNION ALL SELECT 'exfil_egress', 'T1048', src_ip, NULL, sum(bytes_out)::DOUBLE,
    [{'m': 'total_bytes_out', 'v': sum(bytes_out)::DOUBLE}, {'m': 'flows', 'v': count(*)::DOUBLE}]
  FROM oc WHERE class_uid = 4001 GROUP BY 3 HAVING sum(bytes_out) >= 10000
UNION ALL SELECT 'credential_stuffing', 'T1110', src_ip, NULL, count(*)::DOUBLE,
    [{'m': 'failed_attempts', 'v': count(*)::DOUBLE}, {'m': 'distinct_users', 'v': count(DISTINCT "user")::DOUBLE}]
  FROM oc WHERE class_uid = 3002 AND status_id = 2 GROUP BY 3 HAVING count(*) >= 5
UNION ALL SELECT 'shadow_copy_deletion', 'T1490', device_hostname, NULL, count(*)::DOUBLE,
    [{'m': 'executions', 'v': count(*)::DOUBLE}]
  FROM oc WHERE class_uid = 1007 AND contains(lower(cmd_line), 'vssadmin delete shadows') GROUP BY 3
UNION ALL SELECT 'lsass_credential_access', 'T1003.001', device_hostname, NULL, count(*)::DOUBLE,
    [{'m': 'events', 'v': count(*)::DOUBLE}]
  FROM oc WHERE class_uid = 1007 AND contains(lower(cmd_line), 'lsass') GROUP BY 3
UNION ALL SELECT 'api_bulk_retrieval', 'T1530', actor_user, NULL, sum(bytes_out)::DOUBLE,
    [{'m': 'operations', 'v': count(*)::DOUBLE}, {'m': 'total_bytes', 'v': sum(bytes_out)::DOUBLE}]
  FROM oc WHERE class_uid = 6003 GROUP BY 3 HAVING sum(bytes_out) >= 50000)"""


def _hunts_sql(body: str) -> str:
    return sql("oc", _ALL_HUNTS + body)


@query(
    "run_detections",
    _hunts_sql("""
SELECT id AS detection_id, tech AS technique, finding_key, u.m AS measure, u.v AS value, rank FROM (
  SELECT id, tech, coalesce(k0, '<null>') || CASE WHEN id = 'c2_beacon' THEN ' → ' || coalesce(k1, '<null>') ELSE ''
    END AS finding_key, unnest(ms) AS u,
    rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rk DESC, k0 NULLS FIRST, k1 NULLS FIRST) AS rank
      FROM f) WHERE rank <= 10)"""),
)
def _run_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.run_detections(t.ocsf(spark, sf_dir))


_PRICE_HUNT = dt.DetectionSpec(
    "price_sums", "T0000", "Test",
    where=(("class_uid", "=", 4001), ("discount", "<", 0.095)),
    group=("src", "dst_port", "status_id"),
    measures=(dt.Measure("flows", "count"), dt.Measure("price", "sum", "price"), dt.Measure("discount", "sum", "discount"),
              dt.Measure("tax", "avg", "tax")),
    having=(("price", ">=", 100_000), ("discount", "<", 1.25)),
    rank="price",
)


@query(
    "hunt_paths_on_doubles",
    """
WITH f AS (SELECT l_returnflag || ' → ' || l_suppkey || ' → ' || l_linenumber AS finding_key, count(*) AS flows,
  sum(l_extendedprice) AS price, sum(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem WHERE l_discount < 0.095e0
  GROUP BY l_returnflag, l_suppkey, l_linenumber HAVING sum(l_extendedprice) >= 100000 AND sum(l_discount) < 1.25e0)
SELECT path, finding_key, flows, CAST(round(price) AS BIGINT) AS price, CAST(round(discount * 1000) AS BIGINT) AS discount,
  CAST(round(tax * 100000) AS BIGINT) AS tax FROM f, (SELECT unnest(['single', 'one pass']) AS path)""",
)
def _hunt_paths_on_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys and two sums over columns of doubles, through the single hunt and through the one-pass run."""
    lines = t.read(spark, sf_dir, "lineitem").select(
        F.lit(4001).alias("class_uid"), F.col("l_returnflag").alias("src"), F.col("l_suppkey").alias("dst_port"),
        F.col("l_linenumber").alias("status_id"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )
    names = [m.name for m in _PRICE_HUNT.measures]
    one = dt.findings(lines, _PRICE_HUNT)
    key = F.concat_ws(dt.KEY_ARROW, *[F.col(g).cast("string") for g in _PRICE_HUNT.group])
    one = one.select(F.lit("single").alias("path"), key.alias("finding_key"), *[F.col(n).cast("double") for n in names])
    every = dt.run_detections(lines, [_PRICE_HUNT], top_n=1 << 30)
    every = every.groupBy(F.lit("one pass").alias("path"), "finding_key").pivot("measure", names).agg(F.first("value"))
    scale = {"flows": 1, "price": 1, "discount": 1000, "tax": 100_000}
    whole = [F.round(F.col(n) * k).cast("bigint").alias(n) for n, k in scale.items()]
    return one.unionByName(every).select("path", "finding_key", *whole)


@query(
    "finding_counts",
    _hunts_sql("""
SELECT id AS detection_id, count(*) AS n_findings FROM f GROUP BY id"""),
)
def _finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each hunt without the cap of the top list."""
    return dt.finding_counts(t.ocsf(spark, sf_dir))


@query(
    "detection_verdicts",
    _hunts_sql("""
SELECT id AS detection_id, tech AS technique, 'FIRED' AS verdict, count(*) AS n_findings FROM f GROUP BY id, tech"""),
)
def _detection_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.detection_verdicts(t.ocsf(spark, sf_dir))


@query(
    "detection_verdict_counts",
    _hunts_sql("""
SELECT count(DISTINCT id) AS fired, 6 - count(DISTINCT id) AS silent, 6 AS total FROM f"""),
)
def _detection_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.verdict_counts(dt.detection_verdicts(t.ocsf(spark, sf_dir)))


@query(
    "regression_diff",
    _hunts_sql("""
SELECT DISTINCT id AS detection_id, 'FIRED' AS before, 'SILENT' AS after FROM f WHERE tech IN ('T1490', 'T1003.001')"""),
)
def _regression_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over all classes against a run that lost the process class."""
    whole = t.ocsf(spark, sf_dir)
    return dt.regression_diff(
        dt.detection_verdicts(whole), dt.detection_verdicts(whole.filter(F.col("class_uid") != 1007))
    )


@query("regression_status", _hunts_sql("""
SELECT 6 AS n_before, 6 AS n_after, count(DISTINCT id) AS n_changed,
  CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status FROM f WHERE tech IN ('T1490', 'T1003.001')"""))  # fmt: skip
def _regression_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = t.ocsf(spark, sf_dir)
    return dt.regression_status(
        dt.detection_verdicts(whole), dt.detection_verdicts(whole.filter(F.col("class_uid") != 1007))
    )


# -- correlation


@query(
    "correlate_auth_net",
    sql("ev", """
SELECT src_ip, fails, rdp FROM (SELECT src_ip, count(*) AS fails FROM ev WHERE status = 'FAILURE' GROUP BY src_ip)
JOIN (SELECT src_ip, count(*) AS rdp FROM ev WHERE dst_port = 3389 GROUP BY src_ip) USING (src_ip)"""),
)
def _correlate_auth_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.events(spark, sf_dir)
    return co.correlate_auth_net(events, events)


@query(
    "correlate_ordered",
    sql("ev", """
SELECT r.src_ip, any_value(a.fails) AS fails, count(*) AS rdp FROM ev AS r
JOIN (SELECT src_ip, count(*) AS fails FROM ev WHERE status = 'FAILURE' GROUP BY src_ip) AS a ON a.src_ip = r.src_ip
WHERE r.dst_port = 3389 AND EXISTS (SELECT 1 FROM ev AS f WHERE f.src_ip = r.src_ip AND f.status = 'FAILURE'
  AND r.time BETWEEN f.time AND f.time + 43200000) GROUP BY r.src_ip"""),
)
def _correlate_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t.events(spark, sf_dir)
    return co.correlate_ordered(events, events, within_ms=43_200_000)


@query(
    "correlate_sequence",
    sql("ev", """
, f AS (SELECT src_ip, time FROM ev WHERE status = 'FAILURE'), c AS (SELECT src_ip, time FROM ev WHERE dst_port = 3389),
r AS (SELECT src_ip, time, event_id FROM ev WHERE class_uid = 6003),
done AS (SELECT DISTINCT r.src_ip, r.time, r.event_id FROM r JOIN f ON f.src_ip = r.src_ip
  AND f.time BETWEEN r.time - 172800000 AND r.time JOIN c ON c.src_ip = r.src_ip AND c.time BETWEEN f.time AND r.time),
n AS (SELECT src_ip, count(*) FILTER (status = 'FAILURE') AS failed_logins, count(*) FILTER (dst_port = 3389) AS rdp,
  count(*) FILTER (class_uid = 6003) AS api_calls FROM ev GROUP BY src_ip)
SELECT src_ip, any_value(failed_logins) AS failed_logins, any_value(rdp) AS rdp, any_value(api_calls) AS api_calls,
  count(*) AS completed, min(time) AS first_ms, max(time) AS last_ms FROM done JOIN n USING (src_ip) GROUP BY src_ip"""),
)
def _correlate_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed login, then remote desktop, then an API call, within two days."""
    steps = [
        ("failed_logins", F.col("status") == "FAILURE"), ("rdp", F.col("dst_port") == 3389), ("api_calls", F.col("class_uid") == 6003),
    ]
    return co.correlate_sequence(t.events(spark, sf_dir), steps, within_ms=172_800_000)


# -- inventories

NOW = "2003-01-01T00:00:00Z"
TTL = 1000 * 86_400
_KEY = r"regexp_replace(lower(raw_id), '(\.internal|\.local|\.corp)$', '')"
_AGE = "epoch(TIMESTAMP '2003-01-01') - epoch(s.last_seen)"
_RESOLVED = f"""
, k AS (SELECT tool, {_KEY} AS key, count(*) AS n, min(raw_id) AS id, max(last_seen) AS last_seen FROM ls GROUP BY 1, 2),
o AS (SELECT d.tool, p.n, p.id AS pid, s.id AS sid, d.has_times,
  CASE WHEN p.n > 1 THEN 'unresolved' WHEN s.key IS NULL THEN 'gap' WHEN s.n > 1 THEN 'unresolved'
    WHEN d.has_times AND NOT coalesce({_AGE} BETWEEN -300 AND {TTL}, FALSE) THEN 'stale' ELSE 'covered' END AS outcome
  FROM k AS p CROSS JOIN (SELECT tool, bool_or(last_seen IS NOT NULL) AS has_times FROM k WHERE tool <> 'edr'
    GROUP BY tool) AS d
  LEFT JOIN k AS s ON s.tool = d.tool AND s.key = p.key WHERE p.tool = 'edr')"""


def _inv_sql(body: str) -> str:
    return sql("ls", _RESOLVED + body)


@query("latest_seen", sql("ls", "SELECT tool, raw_id, epoch_us(last_seen) // 1000 AS last_ms FROM ls"))
def _latest_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = iv.latest_seen(t.inventories(spark, sf_dir))
    return seen.select("tool", "raw_id", F.unix_millis("last_seen").alias("last_ms"))


@query(
    "gap_exact",
    sql("inv", """
SELECT o.tool AS to_tool, count(*) FILTER (NOT o.has) AS gap_count, count(*) AS primary_count,
  (SELECT count(DISTINCT raw_id) FROM inv WHERE tool = o.tool) AS to_count, count(*) FILTER (NOT o.has) > 5
    AS over_tolerance
FROM (SELECT p.raw_id, d.tool, EXISTS (SELECT 1 FROM inv AS x WHERE x.tool = d.tool AND x.raw_id = p.raw_id) AS has
  FROM (SELECT DISTINCT raw_id FROM inv WHERE tool = 'edr') AS p, (VALUES ('cmdb'), ('scanner')) AS d(tool)) AS o
GROUP BY o.tool"""),
)
def _gap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.gap_exact(t.inventories(spark, sf_dir), "edr", tolerance=5)


@query(
    "resolve_entities",
    _inv_sql("""
SELECT tool AS to_tool, CAST(sum(CASE WHEN outcome = 'covered' THEN n ELSE 0 END) AS BIGINT) AS covered,
  CAST(sum(CASE WHEN outcome = 'gap' THEN n ELSE 0 END) AS BIGINT) AS gap,
  CAST(sum(CASE WHEN outcome = 'stale' THEN n ELSE 0 END) AS BIGINT) AS stale,
  CAST(sum(CASE WHEN outcome = 'unresolved' THEN n ELSE 0 END) AS BIGINT) AS unresolved,
  CAST(sum(n) AS BIGINT) AS primary_count,
  round(avg(CASE WHEN outcome = 'covered' THEN CASE WHEN pid = sid THEN 1.0 WHEN lower(pid) = lower(sid) THEN 0.99
    ELSE 0.9 END END), 4) AS mean_confidence,
  CASE WHEN bool_or(has_times) THEN 'measured' ELSE 'unmeasured' END AS freshness,
  CAST(sum(CASE WHEN outcome <> 'covered' THEN n ELSE 0 END) AS BIGINT) AS uncovered_total,
  CASE WHEN sum(CASE WHEN outcome <> 'covered' THEN n ELSE 0 END) > 0 THEN 'fail' ELSE 'pass' END AS status
FROM o GROUP BY tool"""),
)
def _resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.resolve_entities(t.inventories(spark, sf_dir), "edr", NOW, ttl_seconds=TTL)


@query("resolution_status", _inv_sql("""
SELECT 'fail' AS status, count(*) AS n_failed FROM (SELECT tool FROM o WHERE outcome <> 'covered' GROUP BY tool)"""))  # fmt: skip
def _resolution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = t.inventories(spark, sf_dir)
    return iv.resolution_status(inventory, iv.resolve_entities(inventory, "edr", NOW, ttl_seconds=TTL), "edr")


@query(
    "ambiguity_flags",
    sql("ls", f"""
SELECT tool, {_KEY} AS match_key, count(*) AS n_ids, count(*) > 1 AS is_ambiguous FROM ls GROUP BY 1, 2"""),
)
def _ambiguity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.ambiguity_flags(t.inventories(spark, sf_dir)).select("tool", "match_key", "n_ids", "is_ambiguous")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.inventories(spark, sf_dir).withColumn("raw_id", strip_domain_suffix(F.col("raw_id")))


@query(
    "cross_tool_holes",
    sql("inv", f"""
SELECT count(*) AS union_size, count(*) FILTER (NOT e) AS edr_blind, count(*) FILTER (NOT c) AS cmdb_unknown,
  count(*) FILTER (e AND NOT c) AS edr_sees_cmdb_doesnt, count(*) FILTER (s AND NOT c AND NOT e) AS scanner_only
FROM (SELECT {_KEY} AS id, bool_or(tool = 'cmdb') AS c, bool_or(tool = 'edr') AS e, bool_or(tool = 'scanner') AS s
  FROM inv GROUP BY 1)"""),
)
def _cross_tool_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.cross_tool_holes(_folded(spark, sf_dir))


@query(
    "inventory_union",
    sql("inv", f"SELECT DISTINCT {_KEY} AS raw_id FROM inv WHERE tool IN ('edr', 'scanner')"),
)
def _inventory_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _folded(spark, sf_dir)
    return iv.inventory_union(ids.filter(F.col("tool") == "edr"), ids.filter(F.col("tool") == "scanner"))


@query(
    "inventory_difference",
    sql("inv", f"""
SELECT {_KEY} AS raw_id FROM inv WHERE tool = 'edr' EXCEPT
SELECT {_KEY} FROM inv WHERE tool = 'cmdb' AND raw_id LIKE '%.local'
EXCEPT SELECT {_KEY} FROM inv WHERE tool = 'scanner'"""),
)
def _inventory_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts the EDR reports that are neither known to the CMDB by local name nor ever scanned."""
    raw = t.inventories(spark, sf_dir)
    local = raw.filter((F.col("tool") == "cmdb") & F.col("raw_id").endswith(".local"))
    edr, known, scanned = (
        df.withColumn("raw_id", strip_domain_suffix(F.col("raw_id")))
        for df in (raw.filter(F.col("tool") == "edr"), local, raw.filter(F.col("tool") == "scanner"))
    )
    return iv.inventory_difference(edr, known, scanned)


# -- rollups named in printed benchmark output


@query("class_rollup", sql("oc", """
SELECT class_uid, activity_id, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM oc GROUP BY 1, 2"""))  # fmt: skip
def _class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.ocsf(spark, sf_dir).groupBy("class_uid", "activity_id").agg(
        _count(), F.sum("bytes_out").alias("bytes_out")
    )


@query("five_minute_series", sql("ev", """
SELECT time // 300000 * 300000 AS slot_ms, class_uid, count(*) AS n FROM ev GROUP BY 1, 2"""))  # fmt: skip
def _five_minute_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.expr("time div 300000 * 300000")
    return t.events(spark, sf_dir).groupBy(slot.alias("slot_ms"), "class_uid").agg(_count())


@query("failed_auth_by_user", sql("ev", """
SELECT "user" AS user_name, count(*) AS fails, max(time) AS last_ms FROM ev WHERE class_uid = 3002 AND status_id = 2
GROUP BY 1"""))  # fmt: skip
def _failed_auth_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = t.events(spark, sf_dir).filter((F.col("class_uid") == 3002) & (F.col("status_id") == 2))
    return failed.groupBy(F.col("user").alias("user_name")).agg(_count("fails"), F.max("time").alias("last_ms"))


DAY_MS = 86_400_000


@query("rollup_sketch_windows", sql("ev", """
SELECT time // 86400000 * 86400000 AS window_ms, class_uid, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS total,
  count(DISTINCT src_ip) AS n_src, TRUE AS distinct_within_5_percent, TRUE AS median_rank_within_2_percent,
  max(top_n) AS top_port_n
FROM (SELECT *, time // 86400000 AS day FROM ev) LEFT JOIN (SELECT day, class_uid, max(n) AS top_n FROM (
  SELECT time // 86400000 AS day, class_uid, dst_port, count(*) AS n FROM ev WHERE dst_port IS NOT NULL GROUP BY 1, 2, 3)
  GROUP BY 1, 2) p USING (day, class_uid) GROUP BY 1, 2"""))  # fmt: skip
def _rollup_sketch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days read from five-minute rows, next to the exact numbers: of the sketches only the stated errors are equalities."""
    events = t.events(spark, sf_dir)
    rows = materialise(rl.rollup_rows(events, ["class_uid"], "src_ip", "bytes_out", "dst_port"), "rollups")
    days = rl.read_windows(rows, ["class_uid"], rl.slot_of(F.col("slot_ms"), DAY_MS))
    days = materialise(days, "windows")
    window = rl.slot_of(F.col("time"), DAY_MS).alias("window_ms")
    medians = days.select("window_ms", "class_uid", "quantile_estimate")
    exact = events.select(window, "class_uid", "src_ip", "bytes_out").join(medians, ["window_ms", "class_uid"])
    exact = exact.groupBy("window_ms", "class_uid").agg(
        F.count_distinct("src_ip").alias("n_src"),
        F.count("bytes_out").alias("held"),
        F.count_if(F.col("bytes_out") < F.col("quantile_estimate")).alias("below"),
        F.count_if(F.col("bytes_out") <= F.col("quantile_estimate")).alias("upto"),
    )
    near = (F.col("below") <= 0.52 * F.col("held")) & (F.col("upto") >= 0.48 * F.col("held"))
    return days.join(exact, ["window_ms", "class_uid"]).select(
        "window_ms", "class_uid", "n", "total", "n_src",
        (F.abs(F.col("distinct_estimate") - F.col("n_src")) <= 0.05 * F.col("n_src")).alias("distinct_within_5_percent"),
        near.alias("median_rank_within_2_percent"),
        F.get("top", F.lit(0))["count"].alias("top_port_n"),
    )


@query("top_talkers", sql("fl", """
SELECT src_ip, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, count(*) AS n FROM fl GROUP BY 1 ORDER BY 2 DESC, 1
LIMIT 10"""))  # fmt: skip
def _top_talkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = t.flows(spark, sf_dir).groupBy("src_ip").agg(F.sum("bytes_out").alias("bytes_out"), _count())
    return totals.orderBy(F.desc("bytes_out"), "src_ip").limit(10)


@query("byte_rollup", sql("fl", """
SELECT dst_port, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out,
  max(bytes_in) AS peak_in FROM fl GROUP BY 1"""))  # fmt: skip
def _byte_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.flows(spark, sf_dir).groupBy("dst_port").agg(
        F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.max("bytes_in").alias("peak_in")
    )


@query("row_policy_view", sql("fl", """
SELECT dst_port, count(*) AS n, 0 AS differs FROM fl WHERE src_ip LIKE '10.1.0.%' GROUP BY 1"""))  # fmt: skip
def _row_policy_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row-policy view and the same predicate written inline must answer alike."""
    from siftlake.operators.verify import workload_equality

    flows = t.flows(spark, sf_dir)
    allowed = F.col("src_ip").startswith("10.1.0.")
    view = spark.sql("SELECT * FROM {flows} WHERE startswith(src_ip, '10.1.0.')", flows=flows)
    through_view = view.groupBy("dst_port").agg(_count())
    inline = flows.filter(allowed).groupBy("dst_port").agg(_count())
    differs = workload_equality(through_view, inline).select((F.col("only_left") + F.col("only_right")).alias("d"))
    return through_view.withColumn("differs", differs.scalar())
