"""Column functions, each run over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import functions as fn
from siftlake.functions.text import HTML_ESCAPES
from siftlake.operators.inventory import match_confidence
from siftlake.operators.mapping_lint import ground_path, source_field_type
from siftlake.plans import tables as t
from siftlake.plans.catalog import query
from siftlake.plans.tables import sql


def _safe_key_sql(value: str) -> str:
    out = f"replace(regexp_replace({value}, '[^ -~]', '', 'g'), '`', '')"
    out = f"regexp_replace({out}, '^(.{{64}}).+$', '\\1…')"
    for old, new in HTML_ESCAPES:
        out = "replace({}, '{}', '{}')".format(out, old.replace("'", "''"), new)
    return f"coalesce({out}, '<null>')"


@query("safe_key", f"SELECT page_id, {_safe_key_sql('html')} AS html_key, {_safe_key_sql('url')} AS url_key FROM pages")
def _safe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t.read(spark, sf_dir, "pages")
    return pages.select("page_id", fn.safe_key(F.col("html")).alias("html_key"), fn.safe_key_of(pages, "url").alias("url_key"))


@query("safe_key_null", sql("ev", f"SELECT {_safe_key_sql('src_ip')} AS key, count(*) AS n FROM ev GROUP BY 1"))
def _safe_key_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.events(spark, sf_dir).groupBy(fn.safe_key(F.col("src_ip")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "safe_text",
    "SELECT page_id, substr(regexp_replace(html, '[\\x00-\\x1f\\x7f-\\x{9f}]', ' ', 'g'), 1, 80) AS shown FROM pages",
)
def _safe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "pages").select("page_id", fn.safe_text(F.col("html")).alias("shown"))


@query("strip_ansi", "SELECT doc_id, md5(source || text) AS plain_md5 FROM documents")
def _strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured log lines back to the whole plain text."""
    coloured = F.concat(F.lit("\x1b[1;31m"), F.col("source"), F.lit("\x1b[0m\x1b[2K"), F.col("text"), F.lit("\x1b[m"))
    return t.read(spark, sf_dir, "documents").select("doc_id", F.md5(fn.strip_ansi(coloured)).alias("plain_md5"))


@query("json_path_string", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _json_path_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


_IP_PARTS = "string_split(ip, '.')"


@query(
    "ipv4_to_long",
    sql("fl", """
, ips AS (SELECT dst_ip AS ip, count(*) AS n FROM fl GROUP BY 1)
SELECT ip, split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536
  + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT AS ip_num, n FROM ips"""),
)
def _ipv4_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips = t.flows(spark, sf_dir).groupBy(F.col("dst_ip").alias("ip")).agg(F.count(F.lit(1)).alias("n"))
    return ips.withColumn("ip_num", fn.ipv4_to_long(F.col("ip")))


@query(
    "is_ipv4",
    sql("ev", r"""
SELECT kind, regexp_matches(v, '^[0-9]+(\.[0-9]+){3}$') AS ok, count(*) AS n FROM (
  SELECT 'src' AS kind, src_ip AS v FROM ev UNION ALL SELECT 'user', "user" FROM ev
  UNION ALL SELECT 'short', '10.' || event_id FROM ev) GROUP BY 1, 2"""),
)
def _is_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(
        F.lit("src"), F.col("src_ip"), F.lit("user"), F.col("user"),
        F.lit("short"), F.concat(F.lit("10."), F.col("event_id").cast("string")),
    )
    rows = t.events(spark, sf_dir).select(F.explode(values).alias("kind", "v"))
    return rows.groupBy("kind", fn.is_ipv4(F.col("v")).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "user_format_valid",
    sql("hv", r"""
SELECT source, coalesce(regexp_matches("user", '@acme\.example$') OR regexp_matches("user", '^ACME\\u\d+$'), FALSE)
  AS valid, count(*) AS n FROM hv GROUP BY 1, 2"""),
)
def _user_format_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.health(spark, sf_dir)
    return rows.groupBy("source", fn.user_format_valid(F.col("user")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "minute_bucket",
    f"SELECT (epoch_us(ts) - {t.START_US}) // 60000000 AS minute, count(*) AS n FROM events GROUP BY 1",
)
def _minute_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = fn.minute_bucket(F.col("time_us"), t.START_US)
    return t.events(spark, sf_dir).groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "latency_seconds",
    sql("hv", """
SELECT source, max((ingest_time_us - event_time_us) / 1000000) AS worst_s,
  count(*) FILTER ((ingest_time_us - event_time_us) / 1000000 > 5) AS n_slow FROM hv GROUP BY source"""),
)
def _latency_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = fn.latency_seconds(F.col("ingest_time_us"), F.col("event_time_us"))
    return t.health(spark, sf_dir).groupBy("source").agg(
        F.max(seconds).alias("worst_s"), F.count_if(seconds > 5).alias("n_slow")
    )


@query(
    "datediff_seconds",
    sql("finding", """
SELECT finding_uid, date_diff('second', first_seen_time, event_time) AS seconds FROM finding"""),
)
def _datediff_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = t.semantic(spark, sf_dir)["detection_finding"]
    seconds = fn.datediff_seconds(F.col("first_seen_time"), F.col("event_time"))
    return findings.select("finding_uid", seconds.alias("seconds"))


@query(
    "null_sentinel_key",
    sql("hv", """
SELECT source || '|' || event_time_us || '|' || coalesce("user", '∅') AS key, count(*) AS n FROM hv GROUP BY 1"""),
)
def _null_sentinel_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = fn.null_sentinel_key(F.col("source"), F.col("event_time_us"), F.col("user"))
    return t.health(spark, sf_dir).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "case_flag",
    sql("finding", """
SELECT verdict, CASE WHEN verdict = 'False Positive' THEN 1 ELSE 0 END AS flag, count(*) AS n FROM finding
GROUP BY 1, 2"""),
)
def _case_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = t.semantic(spark, sf_dir)["detection_finding"]
    flag = fn.case_flag(F.col("verdict"), "False Positive")
    return findings.groupBy("verdict", flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "safe_ratio",
    sql("ev", """
SELECT src_ip, count(bytes_out)::DOUBLE / nullif(count(*) FILTER (status_id = 2), 0) AS ratio FROM ev GROUP BY 1"""),
)
def _safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = fn.safe_ratio(F.count("bytes_out"), F.count_if(F.col("status_id") == 2))
    return t.events(spark, sf_dir).groupBy("src_ip").agg(ratio.alias("ratio"))


@query(
    "basename",
    "SELECT page_id, split_part(regexp_replace(url, '/+$', ''), '/', -1) AS name, split_part(url, '/', -1) AS raw_name "
    "FROM pages",
)
def _basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    slashed = fn.basename(F.concat(url, F.lit("//")))
    return t.read(spark, sf_dir, "pages").select(
        "page_id", slashed.alias("name"), F.substring_index("url", "/", -1).alias("raw_name")
    )


@query(
    "strip_domain_suffix",
    sql("ls", r"""
SELECT tool, raw_id, regexp_replace(lower(raw_id), '(\.internal|\.local|\.corp)$', '') AS stripped FROM ls"""),
)
def _strip_domain_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = t.inventories(spark, sf_dir).select("tool", "raw_id").distinct()
    return ids.withColumn("stripped", fn.strip_domain_suffix(F.col("raw_id")))


@query(
    "match_confidence",
    """
SELECT c_custkey % 5 AS kind, [1.0, 0.99, 0.9, 0.9, 0.0][c_custkey % 5 + 1]::DOUBLE AS confidence, count(*) AS n
FROM customer GROUP BY 1, 2""",
)
def _match_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's host name against five spellings of it."""
    key = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 5
    mine = F.concat(F.lit("Web-"), key)
    other: Column = (
        F.when(kind == 0, mine)
        .when(kind == 1, F.lower(mine))
        .when(kind == 2, F.concat(mine, F.lit(".corp")))
        .when(kind == 3, F.concat(F.upper(mine), F.lit(".LOCAL")))
        .otherwise(F.concat(mine, F.lit("-b")))
    )
    rows = t.read(spark, sf_dir, "customer").select(kind.alias("kind"), match_confidence(mine, other).alias("confidence"))
    return rows.groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_field_type",
    sql("mp", """
SELECT source_field, CASE source_field WHEN 'username' THEN 'UserAccount' WHEN 'process_name' THEN 'Process'
  WHEN 'image' THEN 'File' WHEN 'src_ip' THEN 'NetworkNode' WHEN 'dst_ip' THEN 'NetworkNode' WHEN 'group' THEN 'UserGroup'
  WHEN 'url' THEN 'URL' WHEN 'file_path' THEN 'File' WHEN 'sessionid' THEN 'NetworkSession'
  WHEN 'service' THEN 'ServiceApplication' WHEN 'real_user' THEN 'UserAccount' WHEN 'Host.Name' THEN 'NetworkNode' END
  AS source_type, count(*) AS n FROM mp GROUP BY 1, 2"""),
)
def _source_field_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.mappings(spark, sf_dir)
    return rows.groupBy("source_field", source_field_type(F.col("source_field")).alias("source_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "ground_path",
    sql("mp", """
SELECT ocsf_path, CASE ocsf_path WHEN 'actor.user.name' THEN 'UserAccount' WHEN 'process.name' THEN 'Process'
  WHEN 'process.file.path' THEN 'File' WHEN 'src_endpoint.ip' THEN 'NetworkNode' WHEN 'dst_endpoint.ip' THEN 'NetworkNode'
  WHEN 'actor.group.name' THEN 'UserGroup' WHEN 'url' THEN 'URL' WHEN 'connection_info.uid' THEN 'NetworkSession'
  WHEN 'session.uid' THEN 'Session' WHEN 'src.port' THEN 'NetworkNode' END AS target_type, count(*) AS n
FROM mp GROUP BY 1, 2"""),
)
def _ground_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.mappings(spark, sf_dir)
    return rows.groupBy("ocsf_path", ground_path(F.col("ocsf_path")).alias("target_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "freshness_check",
    f"""
SELECT event_type, CASE WHEN greatest(0, {t.END_US // 1000} - max(epoch_us(ts) // 1000)) <= 3600000 THEN 'pass'
  ELSE 'fail' END AS within_hour, CASE WHEN greatest(0, {t.END_US // 1000} - max(epoch_us(ts) // 1000)) <= 86400000
  THEN 'pass' ELSE 'fail' END AS within_day, 'unmeasured' AS never_written FROM events GROUP BY event_type""",
)
def _freshness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = t.read(spark, sf_dir, "events").groupBy("event_type").agg(F.max(F.unix_millis(t.utc())).alias("ms"))
    now = t.END_US // 1000
    return newest.select(
        "event_type",
        fn.freshness_check(F.col("ms"), now).alias("within_hour"),
        fn.freshness_check(F.col("ms"), now, 86_400).alias("within_day"),
        fn.freshness_check(F.lit(None).cast("bigint"), now).alias("never_written"),
    )


def _stamp() -> Column:
    """A stamp in one of six spellings; only the first three carry a zone."""
    n = F.col("event_id")
    text = F.date_format(t.utc(), "yyyy-MM-dd'T'HH:mm:ss")
    return (
        F.when(n % 6 == 0, F.concat(text, F.lit("Z")))
        .when(n % 6 == 1, F.concat(text, F.lit("+00:00")))
        .when(n % 6 == 2, F.concat(text, F.lit("-03:30")))
        .when(n % 6 == 3, text)
        .when(n % 6 == 4, F.date_format(t.utc(), "yyyy-MM-dd"))
        .otherwise("Tuesday or so")
    )


@query("trustworthy_stamp", "SELECT event_id, event_id % 6 <= 2 AS trusted FROM events")
def _trustworthy_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read(spark, sf_dir, "events").select("event_id", fn.trustworthy_stamp(_stamp()).alias("trusted"))


@query(
    "decay_status",
    """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'view' THEN 'unmeasured'
  WHEN event_id % 6 <= 2 AND 1705276800 - (epoch_us(ts) // 1000000 + CASE WHEN event_id % 6 = 2 THEN 12600 ELSE 0 END)
    BETWEEN -300 AND 604800 THEN 'pass' ELSE 'stale' END AS status FROM events""",
)
def _decay_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "fail").when(kind == "view", "unmeasured").otherwise("pass")
    aged = fn.decay_status(status, _stamp(), "2024-01-15T00:00:00Z", ttl_seconds=7 * 86_400)
    return t.read(spark, sf_dir, "events").select("event_id", aged.alias("status"))
