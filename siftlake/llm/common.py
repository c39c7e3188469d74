"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.session import scratch_path

#: The bytes and the characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as classes of a regular expression, in Spark and in DuckDB.
WORD_RE = r"[^\x20\x09-\x0D]+"
BLANK_RE = r"[\x20\x09-\x0D]+"

#: Arrow rows per batch where rows hold whole texts (Spark bounds the bytes of a batch as well), and where
#: they hold a few numbers.
TEXT_BATCH_ROWS, NUMBER_BATCH_ROWS = 2_000, 20_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, as spark-submit --py-files does, once per application.

    Nothing is done where the package is not a folder of the driver's, as it has come to the driver that way itself.
    """
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if context.applicationId in _shipped or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix=f"{root.name}-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Ready the Python workers, and bound the Arrow batches of the Python stages that run from here on."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Whether Spark removes a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a step's result as a small table in the shared folder and read it back; its shuffle files go at once.

    For jobs of many steps over whole texts, whose shuffles would otherwise lie side by side until the driver collects
    its garbage. A lost executor costs a re-read, as the table is all that later steps need.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body uses it inside another lambda."""
    return F.transform(F.array(value), body)[0]


def map_arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, *columns: str
) -> DataFrame:
    """mapInArrow on the named columns, one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.select(*columns).mapInArrow(run, schema)


def text_list(column: pa.Array) -> list[str]:
    """The texts of a batch; a null text is empty."""
    return [x or "" for x in column.to_numpy(zero_copy_only=False).tolist()]


def slices(texts: list[str], most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about so many characters, one text at least."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most_chars:
            yield begin, i
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def gathered(batches: Iterator[pa.RecordBatch], most_chars: int) -> Iterator[tuple[list, list[str]]]:
    """The first two columns, doc_id and text, of batches put together up to about so many characters."""
    ids, texts, total = [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        own = text_list(batch.column(1))
        texts += own
        total += sum(map(len, own))
        if total >= most_chars:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


@functools.cache
def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files of this machine keep the named tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)
