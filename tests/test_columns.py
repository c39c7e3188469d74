from __future__ import annotations

import html
import ipaddress

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake import functions as fn
from siftlake.operators.inventory import match_confidence
from siftlake.operators.mapping_lint import ground_path, source_field_type

NOW = "2026-01-02T00:00:00Z"


def expected_key(value):
    if value is None:
        return "<null>"
    shown = "".join(c for c in value if " " <= c <= "~").replace("`", "")
    if len(shown) > 64:
        shown = shown[:64] + "…"
    return html.escape(shown, quote=True)


HOSTILE = [
    None, "", "10.0.0.1", "<img src=x onerror=alert(1)>", "a`b`c", "x" * 64, "x" * 65, "x" * 500, "a\x1b[31mb\x07",
    "naïve ünïcode", "&amp; & \"quoted\" 'single'", "line\nbreak\ttab", "<" * 70, "`" * 80 + "z",
]


def test_safe_key_neutralises_hostile_values(column):
    assert column(fn.safe_key(F.col("v")), HOSTILE) == [expected_key(v) for v in HOSTILE]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(max_size=90)), min_size=1, max_size=40))
def test_safe_key_equals_the_rule_on_random_text(column, values):
    values = [None if v is None else v.encode("utf-16", "surrogatepass").decode("utf-16", "ignore") for v in values]
    assert column(fn.safe_key(F.col("v")), values) == [expected_key(v) for v in values]


def test_safe_key_of_non_scalars(make):
    df = make("a array<int>, b boolean, s string", [([1], True, "x"), (None, None, None)])
    rows = df.select(*[fn.safe_key_of(df, c).alias(c) for c in df.columns]).collect()
    assert tuple(rows[0]) == ("<non-scalar>", "<non-scalar>", "x")
    assert tuple(rows[1]) == ("<null>", "<null>", "<null>")


def test_text_helpers(column):
    assert column(fn.safe_text(F.col("v")), ["a\x00b\x9fc", "y" * 100]) == ["a b c", "y" * 80]
    assert column(fn.strip_ansi(F.col("v")), ["\x1b[1;31mred\x1b[0m\x1b[2K"]) == ["red"]
    assert column(fn.basename(F.col("v")), ["/a/b.parquet", "/a/b//", "c"]) == ["b.parquet", "b", "c"]
    hosts = ["Web-01.CORP", "db.local.corp", "app-1", "x.internal", "corp"]
    assert column(fn.strip_domain_suffix(F.col("v")), hosts) == ["web-01", "db.local", "app-1", "x", "corp"]


def test_user_format(column):
    values = ["a@acme.example", "ACME\\u12", "u12", "ACME\\jdoe", "a@acme.example.org", None]
    assert column(fn.user_format_valid(F.col("v")), values) == [True, True, False, False, False, False]


ADDRESSES = ["10.5.3.4", "0.0.0.0", "255.255.255.255", "192.168.1.256", "1.2.3", "a.b.c.d", "", None, "1.2.3.4.5"]


def test_ipv4_to_long(column):
    def truth(v):
        try:
            return int(ipaddress.IPv4Address(v))
        except (ipaddress.AddressValueError, TypeError):
            return None

    assert column(fn.ipv4_to_long(F.col("v")), ADDRESSES) == [truth(v) for v in ADDRESSES]
    assert column(fn.ipv4_to_long(F.col("v")), ["10.5.3.4"]) == [168100612]


@pytest.mark.parametrize("cidr", ["10.5.0.0/16", "0.0.0.0/0", "10.5.3.4/32", "10.5.3.7/29"])
def test_cidr_match(column, cidr):
    block = ipaddress.ip_network(cidr, strict=False)
    ips = ["10.5.3.4", "10.5.255.255", "10.6.0.0", "10.4.255.255", "10.5.3.8"]
    got = column(fn.cidr_match(fn.ipv4_to_long(F.col("v")), cidr), ips)
    assert got == [ipaddress.ip_address(i) in block for i in ips]


def test_epoch_ms_does_not_depend_on_the_session_zone(spark, column):
    values = ["2026-01-01T00:00:01Z", "2026-01-01T02:00:01+02:00", "2026-01-01 00:00:01.500", "noise", None]
    want = [1767225601000, 1767225601000, 1767225601500, None, None]
    assert column(fn.epoch_ms_utc(F.col("v")), values) == want
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert column(fn.epoch_ms_utc(F.col("v")), values) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


STAMPS = [
    "2026-01-01T12:00:00Z",  # half a day old
    "2026-01-01T00:00:00Z",  # exactly at the limit
    "2025-12-31T23:59:59Z",  # one second past it
    "2026-01-02T00:05:00Z",  # 300 s ahead: tolerated skew
    "2026-01-02T00:05:01Z",  # 301 s ahead
    "2026-01-01T23:00:00",  # no zone
    "2026-01-01",
    "garbage",
    None,
]


def test_decay_only_ages_a_pass(make):
    df = make("status string, stamp string", [("pass", s) for s in STAMPS] + [("fail", None), ("unmeasured", "x")])
    got = [r[0] for r in df.select(fn.decay_status(F.col("status"), F.col("stamp"), NOW)).collect()]
    assert got == ["pass", "pass", "stale", "pass", "stale", "stale", "stale", "stale", "stale", "fail", "unmeasured"]


def test_trustworthy_stamp(column):
    values = ["2026-01-01T00:00:00Z", "2026-01-01T00:00:00+02:00", "2026-01-01T00:00:00", "2026-01-01", "TZ", None]
    assert column(fn.trustworthy_stamp(F.col("v")), values) == [True, True, False, False, False, False]


def test_freshness(column):
    now = 1_000_000_000
    values = [now - 3_600_000, now - 3_600_001, now + 50, None]
    got = column(fn.freshness_check(F.col("v"), now), values, "bigint")
    assert got == ["pass", "fail", "pass", "unmeasured"]


def test_status_rollup(make):
    rows = [("a", "pass"), ("a", "fail"), ("b", "pass"), ("b", "unwired"), ("c", "unmeasured")]
    df = make("k string, s string", rows).groupBy("k").agg(fn.status_rollup(F.col("s")).alias("s"))
    assert {r["k"]: r["s"] for r in df.collect()} == {"a": "fail", "b": "pass", "c": "unmeasured"}


def test_small_rules(make):
    df = make("a bigint, b bigint, s string", [(3, 2, None), (1, 0, "False Positive")])
    rows = df.select(
        fn.safe_ratio(F.col("a"), F.col("b")).alias("r"),
        fn.case_flag(F.col("s"), "False Positive").alias("f"),
        fn.null_sentinel_key(F.col("a"), F.col("s")).alias("k"),
        fn.minute_bucket(F.col("a") * 60_000_000 - 1, 0).alias("m"),
        fn.latency_seconds(F.col("a") * 1_000_000, F.col("b")).alias("l"),
    ).collect()
    assert tuple(rows[0]) == (1.5, 0, "3|∅", 2, 2.999998)
    assert tuple(rows[1]) == (None, 1, "1|False Positive", 0, 1.0)


def test_match_confidence(make):
    pairs = [("web-01", "web-01"), ("DB-01", "db-01"), ("app-01", "APP-01.corp"), ("web-01", "web-02")]
    df = make("a string, b string", pairs)
    got = [r[0] for r in df.select(match_confidence(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.99, 0.9, 0.0]


def test_field_typing(column):
    fields = ["username", "process_name", "src_ip", "file_path", "real_user", "`Image`", "note", "—", "sha256", None]
    types = ["UserAccount", "Process", "NetworkNode", "File", "UserAccount", "File", None, None, "File", None]
    assert column(source_field_type(F.col("v")), fields) == types
    paths = ["actor.user.name", "process.file.path", "src.port", "session.uid", "metadata.x", "user[].name"]
    kinds = ["UserAccount", "File", "NetworkNode", "Session", None, "UserAccount"]
    assert column(ground_path(F.col("v")), paths) == kinds
