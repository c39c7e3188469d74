"""Raw source events to flat OCSF records, one select per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.time import epoch_ms_utc, instant_of

# Raw schemas.
OKTA_SCHEMA = (
    "published string, eventType string, outcome struct<result:string>, "
    "actor struct<alternateId:string>, client struct<ipAddress:string>"
)
SYSMON_SCHEMA = (
    "EventID int, UtcTime string, Image string, ProcessId int, CommandLine string, "
    "ParentImage string, ParentProcessId int, User string, Computer string"
)

# Connection state to activity, protocol to number, API verb to activity (first prefix wins).
CONN_STATE_ACTIVITY = {2: ("SF", "RSTO", "RSTR", "RSTRH", "SH", "SHR"), 4: ("S0",), 5: ("REJ",)}
OTHER_TRAFFIC = 6
PROTOCOL_NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1}
API_VERBS = (
    (2, ("Get", "List", "Describe")),
    (4, ("Delete", "Remove", "Terminate")),
    (3, ("Attach", "Detach", "Update", "Modify", "Put")),
    (1, ("Create", "Add", "Run")),
)
OTHER_API = 99


def zeek_activity_id(state: Column) -> Column:
    """Activity of a connection from its state; unknown and NULL states are traffic."""
    ladder = F.lit(OTHER_TRAFFIC)
    for activity, states in CONN_STATE_ACTIVITY.items():
        ladder = F.when(state.isin(*states), activity).otherwise(ladder)
    return ladder


def protocol_num(proto: Column) -> Column:
    """IANA number of a protocol name, NULL when unknown."""
    out = F.lit(None).cast("int")
    for name, number in PROTOCOL_NUMBERS.items():
        out = F.when(proto == name, number).otherwise(out)
    return out


def api_activity_id(operation: Column) -> Column:
    """Activity of a cloud API call from its verb."""
    out = F.lit(OTHER_API)
    for activity, verbs in reversed(API_VERBS):
        out = F.when(operation.rlike("^(" + "|".join(verbs) + ")"), activity).otherwise(out)
    return out


def _carried(df: DataFrame, carry: tuple[str, ...]) -> list[Column]:
    return [F.col(c) for c in carry if c in df.columns]


def normalize_okta(raw: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Identity log to Authentication: the operation in activity_id, the outcome in status_id."""
    result = F.col("outcome.result")
    return raw.select(
        *_carried(raw, carry),
        epoch_ms_utc(F.col("published")).alias("time"),
        F.lit(3002).alias("class_uid"),
        F.lit("Authentication").alias("class_name"),
        F.lit(3).alias("category_uid"),
        F.lit(1).alias("activity_id"),
        F.when(result == "SUCCESS", 1).otherwise(2).alias("status_id"),
        F.col("actor.alternateId").alias("user"),
        F.col("client.ipAddress").alias("src_ip"),
        result.alias("status"),
    )


def okta_contract(raw: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """What a correct transform must yield, written apart from ``normalize_okta`` to check it."""
    succeeded = F.expr("outcome.result <=> 'SUCCESS'")
    return raw.select(
        *_carried(raw, carry),
        F.expr("3002").alias("class_uid"),
        F.expr("3").alias("category_uid"),
        F.expr("1").alias("activity_id"),
        F.expr("if(outcome.result <=> 'SUCCESS', 1, 2)").alias("status_id"),
        F.col("actor")["alternateId"].alias("user"),
        F.col("client")["ipAddress"].alias("src_ip"),
        F.coalesce(F.when(succeeded, F.lit("SUCCESS")), F.col("outcome")["result"]).alias("status"),
    )


def normalize_zeek_conn(raw: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Connection log to Network Activity.

    Direction is seen from the source endpoint: what the originator sent is bytes_out, what the
    responder sent is bytes_in.
    """

    def number(name: str, data_type: str) -> Column:
        return F.col(f"`{name}`").cast("string").try_cast(data_type)

    return raw.select(
        *_carried(raw, carry),
        F.round(number("ts", "double") * 1000).cast("bigint").alias("time"),
        F.lit(4001).alias("class_uid"),
        F.lit(4).alias("category_uid"),
        zeek_activity_id(F.col("conn_state")).alias("activity_id"),
        F.col("`id.orig_h`").alias("src_ip"),
        number("id.orig_p", "int").alias("src_port"),
        F.col("`id.resp_h`").alias("dst_ip"),
        number("id.resp_p", "int").alias("dst_port"),
        protocol_num(F.col("proto")).alias("protocol_num"),
        number("resp_bytes", "bigint").alias("bytes_in"),
        number("orig_bytes", "bigint").alias("bytes_out"),
        number("resp_pkts", "bigint").alias("packets_in"),
        number("orig_pkts", "bigint").alias("packets_out"),
    )


def normalize_sysmon(raw: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Process-creation events to Process Activity: the new process, its parent, the launching user."""
    path = F.replace(F.col("Image"), F.lit("/"), F.lit("\\"))
    return raw.filter(F.col("EventID") == 1).select(
        *_carried(raw, carry),
        F.unix_millis(instant_of(F.col("UtcTime"))).alias("time"),
        F.lit(1007).alias("class_uid"),
        F.lit(1).alias("category_uid"),
        F.lit(1).alias("activity_id"),
        F.substring_index(path, "\\", -1).alias("process_name"),
        F.col("Image").alias("process_path"),
        F.col("ProcessId").alias("process_pid"),
        F.col("CommandLine").alias("cmd_line"),
        F.col("ParentImage").alias("parent_path"),
        F.col("ParentProcessId").alias("parent_pid"),
        F.col("User").alias("user"),
        F.col("Computer").alias("device_hostname"),
    )


def normalize_cloudtrail(raw: DataFrame, record: str = "record", carry: tuple[str, ...] = ()) -> DataFrame:
    """Cloud audit events (a VARIANT column) to Authentication and API Activity.

    MFA keeps three states: true, false, and absent (``is_mfa`` NULL with ``is_mfa_present`` false).
    """

    def text(path: str) -> Column:
        return F.try_variant_get(record, path, "string")

    base = raw.select(
        *_carried(raw, carry),
        epoch_ms_utc(text("$.eventTime")).alias("time"),
        text("$.eventName").alias("event_name"),
        text("$.userIdentity.userName").alias("who"),
        text("$.sourceIPAddress").alias("src_ip"),
        text("$.responseElements.ConsoleLogin").alias("outcome"),
        (text("$.errorCode").isNotNull() | text("$.errorMessage").isNotNull()).alias("errored"),
        text("$.additionalEventData.MFAUsed").alias("mfa"),
    )
    login = F.coalesce(F.col("event_name") == "ConsoleLogin", F.lit(False))
    login_status = F.when(F.col("outcome") == "Success", 1).otherwise(2)
    call_status = F.when(F.col("errored"), 2).otherwise(1)
    return base.select(
        *_carried(base, carry),
        "time",
        F.when(login, 3002).otherwise(6003).alias("class_uid"),
        F.when(login, 3).otherwise(6).alias("category_uid"),
        F.when(login, 1).otherwise(api_activity_id(F.col("event_name"))).alias("activity_id"),
        F.when(login, login_status).otherwise(call_status).alias("status_id"),
        F.when(login, F.col("who")).alias("user"),
        F.when(~login, F.col("who")).alias("actor_user"),
        "src_ip",
        F.when(login, F.col("outcome")).alias("status"),
        F.when(~login, F.col("event_name")).alias("api_operation"),
        F.when(login, F.col("mfa") == "Yes").alias("is_mfa"),
        F.when(login, F.col("mfa").isNotNull()).alias("is_mfa_present"),
    )


def lead_technique(tags: Column) -> Column:
    """First technique of a tag list. Lossy by design; ``technique_bridge`` keeps them all."""
    return F.try_element_at(tags, F.lit(1))


def technique_bridge(df: DataFrame, key: str, tags: str) -> DataFrame:
    """One row per (key, technique)."""
    return df.select(key, F.explode(tags).alias("technique")).distinct()
