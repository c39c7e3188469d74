"""Sinks and the commit-partitioned table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.sources import store

_FILES = "files array<struct<file_name: string, n_bytes: bigint, n_rows: bigint, content_hash: string>>"
COMMIT_LOG_SCHEMA = (
    f"commit_id bigint, parent_id bigint, committed_ms bigint, added_records bigint, content_hash string, {_FILES}"
)
PACK_SCHEMA = f"replaced array<string>, {_FILES}"
#: Files below it are packed.
TARGET_FILE_BYTES = 128 * 1024 * 1024


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def land_replace(df: DataFrame, path: str, partition_by: Sequence[str] = ("class_uid",)) -> DataFrame:
    """Replace the table by this run's rows and return it as read back.

    ``rebalance`` lets AQE size the write tasks by bytes: small classes share a file and a class that
    holds most of the rows is split over many.
    """
    df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


class CommitConflict(RuntimeError):
    """Another writer has made the commit, with other content."""


def _entry_file(path: str, folder: str, number: int) -> str:
    return f"{path}/{folder}/{number:020d}.json"


def _stage(df: DataFrame, path: str) -> tuple[str, list[dict]]:
    """Write a batch where no reader looks; its files with their sizes, row counts and content hashes."""
    from siftlake.operators.verify import file_hashes

    staged = f"{path}/staging/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staged)
    # a row per file of the batch
    found = file_hashes(df.sparkSession.read.schema(df.schema).parquet(staged)).collect()
    return staged, [r.asDict() for r in found]


def _log_commit(
    spark: SparkSession, path: str, staged: str, files: list[dict], commit_id: int, committed_ms: int, parent_id: int | None
) -> tuple[bool, str]:
    """Move staged files to the commit's folder and put its log entry if there is none; where the files are then."""
    folder = f"data/commit_id={commit_id}"
    for f in files:
        store.move(spark, f"{staged}/{f['file_name']}", f"{path}/{folder}/{f['file_name']}")
    entry = {
        "commit_id": commit_id,
        "parent_id": parent_id,
        "committed_ms": committed_ms,
        "added_records": sum(f["n_rows"] for f in files),
        "content_hash": str(sum(int(f["content_hash"]) for f in files)),
        "files": [{**f, "file_name": f"{folder}/{f['file_name']}"} for f in files],
    }
    return store.put_if_absent(spark, _entry_file(path, "log", commit_id), json.dumps(entry)), f"{path}/{folder}"


def land_append_commit(df: DataFrame, path: str, commit_id: int, committed_ms: int, parent_id: int | None) -> DataFrame:
    """Append one batch as the commit of that id; returns its log row.

    The log entry is put only if there is none and names the files of the commit, so readers see all of it or nothing.
    A retried batch finds its own entry and lands once; other content under an id that is taken raises CommitConflict
    and changes nothing that readers see.
    """
    spark = df.sparkSession
    staged, files = _stage(df, path)
    done, _ = _log_commit(spark, path, staged, files, commit_id, committed_ms, parent_id)
    row = read_commit_log(spark, path).filter(F.col("commit_id") == commit_id)
    if not done:
        mine = (sum(f["n_rows"] for f in files), str(sum(int(f["content_hash"]) for f in files)))
        if tuple(row.select("added_records", "content_hash").first()) != mine:
            raise CommitConflict(f"commit {commit_id} of {path} holds another batch")
    return row


def append_commit(df: DataFrame, path: str, committed_ms: int, tries: int = 20) -> int:
    """Append one batch as the next commit, whatever it is by then; returns its id.

    Optimistic: the batch is written first, then its entry is tried under the id after the last one, with that one as
    parent. If another writer was faster, the files move on to the next id; they are not written again.
    """
    spark = df.sparkSession
    staged, files = _stage(df, path)
    for _ in range(tries):
        taken = store.entry_numbers(spark, f"{path}/log")
        last = max(taken, default=None)
        commit_id = 0 if last is None else last + 1
        done, staged = _log_commit(spark, path, staged, files, commit_id, committed_ms, last)
        if done:
            return commit_id
    raise CommitConflict(f"{path}: {tries} ids in a row were taken by others")


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT_LOG_SCHEMA).json(f"{path}/log").select(
        "commit_id", "parent_id", "committed_ms", "added_records", "content_hash"
    )


def live_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that make up the table: what commits and packs have added, without what packs have replaced."""
    added = spark.read.schema(COMMIT_LOG_SCHEMA).json(f"{path}/log").select(F.inline("files"))
    if store.entry_numbers(spark, f"{path}/packs"):
        packs = spark.read.schema(PACK_SCHEMA).json(f"{path}/packs")
        replaced = packs.select(F.explode("replaced").alias("file_name"))
        added = added.unionByName(packs.select(F.inline("files"))).join(replaced, "file_name", "left_anti")
    return added.select("file_name", "n_bytes", "n_rows", "content_hash")


def _read_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The rows of the named files of a table, with ``commit_id``: a folder of data/, a column of packed/."""
    kinds = [[f"{path}/{n}" for n in names if n.startswith(k)] for k in ("data/", "packed/")]
    found = None
    for folder, own in zip(("data", "packed"), kinds, strict=True):
        if own:
            rows = spark.read.option("basePath", f"{path}/{folder}").parquet(*own)
            rows = rows.withColumn("commit_id", F.col("commit_id").cast("int"))
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError(f"{path} has no committed rows")
    return found


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows, with their ``commit_id``.

    Only files that the log names are opened: a batch whose writer died before its entry was put, or came second, stays
    invisible, and a packed file is seen from the moment on at which those it replaces are not.
    """
    return _read_files(spark, path, [r["file_name"] for r in live_files(spark, path).select("file_name").collect()])


def read_as_of(table: DataFrame, commit_id: int, commit_column: str = "commit_id") -> DataFrame:
    """State as of a commit: partition pruning leaves later commits unread."""
    return table.filter(F.col(commit_column) <= F.lit(commit_id))


def compact_commits(
    spark: SparkSession, path: str, target_bytes: int = TARGET_FILE_BYTES, sort_by: Sequence[str] = ()
) -> bool:
    """Pack the files below the target size into files of about that size; whether the content is as before.

    Larger files are neither read nor renamed. One log entry replaces the small files by the packed ones, so readers see
    the ones or the others. It is put only if the rows of every commit are as many as before and the hashes of the
    packed files add up to those that the log keeps for the small ones, which are not hashed again. Replaced files stay
    in the store for readers that are under way. Where another pack came first, CommitConflict is raised.
    """
    from siftlake.operators.verify import file_hashes

    number = max(store.entry_numbers(spark, f"{path}/packs"), default=-1) + 1
    small = [r for r in live_files(spark, path).collect() if r["n_bytes"] < target_bytes]
    if len(small) < 2:
        return True
    old = _read_files(spark, path, [r["file_name"] for r in small])
    files = max(1, -(-sum(r["n_bytes"] for r in small) // target_bytes))
    packed = old.repartitionByRange(files, *sort_by).sortWithinPartitions(*sort_by) if sort_by else old.repartition(files)
    folder = f"packed/{uuid.uuid4().hex}"
    packed.write.mode("errorifexists").parquet(f"{path}/{folder}")
    new = spark.read.schema(old.schema).parquet(f"{path}/{folder}")
    added = [r.asDict() for r in file_hashes(new, "commit_id").collect()]
    by_commit = [df.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).collect() for df in (old, new)]
    total = lambda rows: sum(int(r["content_hash"]) for r in rows)
    if total(small) != total(added) or sorted(by_commit[0]) != sorted(by_commit[1]):
        return False
    entry = {
        "replaced": [r["file_name"] for r in small],
        "files": [{**f, "file_name": f"{folder}/{f['file_name']}"} for f in added],
    }
    if not store.put_if_absent(spark, _entry_file(path, "packs", number), json.dumps(entry)):
        raise CommitConflict(f"{path}: pack {number} was made by another writer")
    return True


def cluster_layout(df: DataFrame, path: str, sort_by: Sequence[str], files: int | None = None) -> DataFrame:
    """Write sorted ranges, so that a needle query opens few row groups.

    The range is cut on all sort columns, which splits a hot first value over several files.
    """
    keys: list[Column] = [F.col(c) for c in sort_by]
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def interleave(ranks: Sequence[Column], bits: int) -> Column:
    """The low bits of non-negative integers, highest first and the first integer before the others: one sort key."""
    m = len(ranks)
    if not 0 < m * bits < 64:
        raise ValueError(f"{m} columns of {bits} bits do not fit a sort key")
    key = F.lit(0).cast("bigint")
    for i in range(bits):
        for j, rank in enumerate(ranks):
            bit = F.shiftright(rank, i).bitwiseAND(F.lit(1)).cast("bigint")
            key = key.bitwiseOR(F.shiftleft(bit, m * i + m - 1 - j))
    return key


def z_order_key(first: Column, second: Column, bits: int = 16) -> Column:
    """Interleaved low bits of two non-negative integers: one sort key that serves filters on either."""
    return interleave([first, second], bits)


def quantile_ranks(df: DataFrame, values: Sequence[Column], bits: int = 8) -> list[Column]:
    """The rank of each value among 2 ** bits classes that hold about as many rows each; nulls have rank 0.

    The bounds are quantiles of all rows, from one aggregate whose result is 2 ** bits numbers per column. A value that
    fills several classes is given the last of them, so the ranks of a skewed column spread as those of a uniform one.
    """
    classes = 1 << bits
    shares = [i / classes for i in range(1, classes)]
    bounds = df.agg(*[F.percentile_approx(v, shares, 100 * classes).alias(f"b{i}") for i, v in enumerate(values)]).first()
    powers = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])

    def rank(value: Column, own: list) -> Column:
        if own is None:
            return F.lit(0)
        literal = F.array(*map(F.lit, own))
        return F.aggregate(powers, F.lit(0), lambda r, p: F.when(value >= F.get(literal, r + p - 1), r + p).otherwise(r))

    return [rank(v, bounds[f"b{i}"]) for i, v in enumerate(values)]


#: Bits of the sort key that one pass over the rows resolves when files are dealt out.
CELL_BITS = 6


def z_cells(keyed: DataFrame, column: str, width: int, files: int) -> list[tuple[int, int, int]]:
    """(lowest key, first file, number of files) of cells of a sort key of that many bits, in ascending order.

    A cell holds all keys with the same highest bits. It is halved, and its files are dealt to the halves by their rows,
    until it has one file; more than one stays only with a single key. Each pass counts rows of the cells still open, of
    which there are half as many as files at most; only those counts come to the driver.
    """
    closed, open_cells, depth = [], {0: (0, files)}, 0
    while open_cells and depth < width:
        step = min(width - depth, max(CELL_BITS, (files - 1).bit_length() - depth))
        rest = width - depth - step
        own = keyed.where(F.shiftright(column, rest + step).isin(list(open_cells))) if depth else keyed
        counted = own.groupBy(F.shiftright(column, rest).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
        levels = [{r["cell"]: r["n"] for r in counted}]
        for _ in range(step):
            above: dict[int, int] = {}
            for cell, n in levels[-1].items():
                above[cell >> 1] = above.get(cell >> 1, 0) + n
            levels.append(above)
        for level in range(step, 0, -1):
            halves = {}
            for cell, (first, own_files) in open_cells.items():
                if own_files == 1:
                    closed.append((cell << (rest + level), first, 1))
                    continue
                n0, n1 = (levels[level - 1].get(2 * cell + i, 0) for i in (0, 1))
                share = 0 if not n0 else own_files if not n1 else round(own_files * n0 / (n0 + n1))
                share = min(max(share, n0 > 0), own_files - (n1 > 0))
                for half, at, count in ((2 * cell, first, share), (2 * cell + 1, first + share, own_files - share)):
                    if count:
                        halves[half] = (at, count)
            open_cells = halves
        depth += step
        closed += [(cell << rest, first, 1) for cell, (first, n) in open_cells.items() if n == 1]
        open_cells = {cell: x for cell, x in open_cells.items() if x[1] > 1}
    return sorted([*closed, *((cell, *x) for cell, x in open_cells.items())])


def _last_at_most(value: Column, bounds: Sequence) -> Column:
    """The number, from 0, of the last of the ascending bounds that is not above the value; 0 where all are."""
    literal = F.array(*map(F.lit, bounds))
    powers = F.array(*[F.lit(1 << b) for b in range(max(1, (len(bounds) - 1).bit_length()) - 1, -1, -1)])
    return F.aggregate(powers, F.lit(0), lambda r, p: F.when(value >= F.get(literal, r + p), r + p).otherwise(r))


def z_layout(df: DataFrame, path: str, values: Sequence[Column], bits: int = 8, files: int | None = None) -> DataFrame:
    """Write df sorted by the interleaved ranks of any number of numeric values, so filters on any of them skip files.

    With a number of files each holds whole cells of the key (z_cells), so where a file ends follows from the rows and
    not from a sample of them, and no file lies across two halves of a column that it could be kept out of. Rows of one
    key that fill several files are spread over them. The key is not stored. An empty table is written as one.
    """
    keyed = df.withColumn("_z", interleave(quantile_ranks(df, values, bits), bits))
    if files:
        lows, firsts, counts = zip(*z_cells(keyed, "_z", len(values) * bits, files), strict=True)
        cell = _last_at_most(F.col("_z"), lows)
        file = F.get(F.array(*map(F.lit, firsts)), F.col("_cell"))
        if max(counts) > 1:
            spread = F.pmod(F.xxhash64(*df.columns), F.get(F.array(*map(F.lit, counts)), F.col("_cell")))
            file = file + spread.cast("int")
        ranged = keyed.withColumn("_cell", cell).repartitionById(files, file).drop("_cell")
    else:
        ranged = keyed.repartitionByRange("_z")
    ranged.sortWithinPartitions("_z").drop("_z").write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
