"""Answer equality, content hashes, commit-chain audit and certification."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT_DIGITS = 6
CHAIN_BUCKET = 10_000

# Checks that block a deployment, not only a certificate.
HARD_CHECKS = ("config_integrity", "spec_persisted")


def _canonical(df: DataFrame) -> list[Column]:
    """Columns in name order; floating point is rounded, because engines differ in the last bits."""
    out = []
    for field in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, FLOAT_DIGITS)
        out.append(c)
    return out


PIECE_BITS = 22


def _text_hash(text: Column) -> Column:
    """Sixty bits of the MD5 of a row's text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _hash_sum(row_hash: Column) -> Column:
    """Aggregate: the exact sum of 64-bit hashes as text.

    Each hash is summed in three short pieces that stay plain longs for up to 2^41 rows; only the three
    totals are put together as a decimal.
    """
    mask = F.lit((1 << PIECE_BITS) - 1).cast("bigint")
    pieces = (
        F.shiftright(row_hash, 2 * PIECE_BITS),
        F.shiftright(row_hash, PIECE_BITS).bitwiseAND(mask),
        row_hash.bitwiseAND(mask),
    )
    total = F.lit(0).cast("decimal(38,0)")
    for i, piece in enumerate(reversed(pieces)):
        weight = F.lit(1 << (PIECE_BITS * i)).cast("decimal(15,0)")
        summed = F.coalesce(F.sum(piece), F.lit(0)).cast("decimal(20,0)")
        total = (total + (summed * weight).cast("decimal(37,0)")).cast("decimal(38,0)")
    return total.cast("string")


def content_hash(df: DataFrame, portable: bool = False) -> DataFrame:
    """Row count and an order-free hash of the logical content.

    The default sums xxhash64 per row. ``portable`` uses MD5 over the text of the row instead, which
    other engines can compute too; columns must then be text, integers or booleans.
    """
    hashed = df.select(row_hash(df, portable).alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("n_rows"), _hash_sum(F.col("h")).alias("content_hash"))


def row_hash(df: DataFrame, portable: bool = False) -> Column:
    """The hash of a whole row that content_hash adds up."""
    columns = _canonical(df)
    if portable:
        text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("∅")) for c in columns])
        return _text_hash(text)
    # a NULL leaves xxhash64 unchanged, so each column's NULL flag is hashed with it
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def file_hashes(df: DataFrame, *leave_out: str) -> DataFrame:
    """content_hash and n_rows of every file of a scan, by name, without the named columns.

    The hashes of the files of a table add up to the table's.
    """
    meta = F.col("_metadata")
    hashed = df.select(meta["file_name"].alias("file_name"), meta["file_size"].alias("n_bytes"), row_hash(df.drop(*leave_out)).alias("h"))
    return hashed.groupBy("file_name", "n_bytes").agg(F.count(F.lit(1)).alias("n_rows"), _hash_sum(F.col("h")).alias("content_hash"))


def workload_answers(df: DataFrame, path_name: str, port: int = 3389) -> DataFrame:
    """Answers of the fixed workload over one access path: ``(path, query, value)``.

    One grouping by port serves the total, the needle and the distribution.
    """
    text = F.concat_ws(":", F.coalesce(F.col("dst_port").cast("string"), F.lit("∅")), F.col("n").cast("string"))
    ports = df.groupBy("dst_port").agg(F.count(F.lit(1)).alias("n")).withColumn("h", _text_hash(text))
    folded = ports.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("total"),
        F.coalesce(F.sum(F.when(F.col("dst_port") == port, F.col("n"))), F.lit(0)).cast("string").alias("needle"),
        _hash_sum(F.col("h")).alias("group_by"),
    )
    rows = [
        F.struct(F.lit(q).alias("query"), F.col(q).alias("value")) for q in ("total", "needle", "group_by")
    ]
    return folded.select(F.lit(path_name).alias("path"), F.inline(F.array(*rows)))


def answer_equality(answers: DataFrame) -> DataFrame:
    """Per query: number of paths, number of different answers, the agreed answer, pass or fail.

    One path alone has nothing to agree with and is unmeasured.
    """
    n_paths, n_answers = F.count_distinct("path"), F.count_distinct(F.coalesce("value", F.lit("∅")))
    # a workload is a handful of queries over a handful of paths
    per = answers.groupBy("query").agg(
        n_paths.alias("n_paths"), n_answers.alias("n_answers"), F.max("value").alias("value")
    )
    status = F.when(F.col("n_paths") < 2, "unmeasured").when(F.col("n_answers") == 1, "pass").otherwise("fail")
    agreed = F.when(F.col("n_answers") == 1, F.col("value"))
    return per.select("query", "n_paths", "n_answers", agreed.alias("answer"), status.alias("status"))


def workload_equality(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows held by only one of two results, as bags, from a single grouping of both."""
    columns = left.columns
    signed = left.select(*columns, F.lit(1).alias("__sign")).unionByName(
        right.select(*columns, F.lit(-1).alias("__sign"))
    )
    net = signed.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.sum("__sign").alias("net"))
    counted = net.agg(
        F.coalesce(F.sum(F.when(F.col("net") > 0, F.col("net"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("net") < 0, -F.col("net"))), F.lit(0)).alias("only_right"),
    )
    return counted.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def swap_format_equality(df: DataFrame, folder: str, formats: Mapping[str, str]) -> DataFrame:
    """Write the table once per format below ``folder``, read it back, compare the workload answers."""
    spark = df.sparkSession
    answers = None
    for label, fmt in formats.items():
        path = f"{folder}/{label}"
        df.write.format(fmt).mode("errorifexists").save(path)
        copy = spark.read.schema(df.schema).format(fmt).load(path)
        found = workload_answers(copy, label)
        answers = found if answers is None else answers.unionByName(found)
    assert answers is not None
    return answer_equality(answers)


def commit_chain_audit(log: DataFrame, table: str | None = None) -> DataFrame:
    """Each commit's parent must be the commit before it; record counts accumulate.

    Commits are looked at in blocks of consecutive ids, with one row per block carrying the last id and
    the running total over, so that a long history is not one sorted group.
    """
    keys = [table] if table else []
    blocks = log.withColumn("block", F.expr(f"commit_id div {CHAIN_BUCKET}"))
    by_block = W.partitionBy(*keys).orderBy("block")
    carried = (
        blocks.groupBy(*keys, "block")
        .agg(F.max("commit_id").alias("last_id"), F.sum("added_records").alias("added"))
        .select(
            *keys,
            "block",
            F.lag("last_id").over(by_block).alias("carried_id"),
            F.sum("added").over(by_block.rowsBetween(W.unboundedPreceding, -1)).alias("carried_n"),
        )
    )
    inside = W.partitionBy(*keys, "block").orderBy("commit_id")
    previous = F.coalesce(F.lag("commit_id").over(inside), F.col("carried_id"))
    running = F.sum("added_records").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = blocks.join(carried, [*keys, "block"])
    return joined.select(
        *keys,
        "commit_id",
        "parent_id",
        previous.alias("previous_id"),
        (running + F.coalesce("carried_n", F.lit(0))).alias("records_as_of"),
        F.col("parent_id").eqNullSafe(previous).alias("chain_ok"),
    )


def certify(verdicts: DataFrame, *keys: str) -> DataFrame:
    """One certificate per table and day from ``(…keys, check, status)``.

    A failed hard check blocks deployment; any other failure blocks the certificate; stale and
    unmeasured checks keep it from green. The check names are a small closed set.
    """
    keys = keys or ("table_name", "day")

    def names(status: str) -> Column:
        hit = F.when(F.col("status") == status, F.col("check"))
        return F.array_join(F.array_sort(F.collect_set(hit)), ",")

    hard_fail = F.col("check").isin(*HARD_CHECKS) & (F.col("status") == "fail")
    grouped = verdicts.groupBy(*keys).agg(
        (F.count_if(hard_fail) == 0).alias("deploy_ok"),
        (F.count_if(F.coalesce(F.col("status") != "pass", F.lit(True))) == 0).alias("all_green"),
        names("fail").alias("blockers"),
        names("unmeasured").alias("unmeasured"),
        names("stale").alias("stale"),
    )
    headline = (
        F.when(F.col("all_green"), "green")
        .when(~F.col("deploy_ok"), "deploy blocked")
        .when(F.col("blockers") != "", "not certified")
        .when(F.col("stale") != "", "stale")
        .otherwise("unproven")
    )
    return grouped.withColumn("headline", headline)
