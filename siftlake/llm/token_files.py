"""Token ids as compact files: frequency-ranked ids, byte-aligned lengths, control bytes apart from the data.

File format, version 1. A folder holds two Parquet tables, so that any store Spark can write to will do and a file
counts only once its task has committed:

`vocabulary`  id, rank: rank 0 is the most frequent id of the corpus, ties to the smaller id.
`blocks`      one row per block of whole documents, in ascending doc_id order by (part, block):
    part, block        place in the order; parts are ranges of doc_id
    start              tokens of the same part before the block
    n_tokens           tokens in the block
    doc_ids, doc_lens  the documents and their tokens, arrays
    control            two bits per token, four tokens a byte, first token in the low bits: bytes of its rank less one
    data               the ranks, little-endian, each in as many bytes as control says

Reading needs no loop over tokens: a table of 256 rows gives the four lengths of a control byte, running sums give the
places, and the bytes of each length are gathered together.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import map_arrow, shuffle_width, slices, text_batches, text_list
from siftlake.llm.encoder import encoder
from siftlake.session import scratch_path

#: Tokens in a block before it is closed; a block holds whole documents, one at least.
BLOCK_TOKENS = 1 << 19

#: For each control byte, the bytes of its four ranks.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.int64) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of ranks below 2**32."""
    ranks = ranks.astype(np.int64)
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    lengths = codes.astype(np.int64) + 1
    places = np.cumsum(lengths) - lengths
    data = np.zeros(int(lengths.sum()), np.uint8)
    for k in range(4):
        longer = np.flatnonzero(codes >= k) if k else slice(None)
        data[places[longer] + k] = ranks[longer] >> 8 * k & 0xFF
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks again."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    places = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[places].astype(np.int64)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        ranks[longer] |= raw[places[longer] + k].astype(np.int64) << 8 * k
    return ranks


def _staged(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """doc_id and the ids of each document as bytes, written once so that texts are encoded once."""
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder, texts = encoder(tokenizer, end_id), text_list(batch.column(1))
        for begin, end in slices(texts):
            ids, offsets = coder.encode(texts[begin:end])
            raw, size = memoryview(ids.astype(width).tobytes()), np.dtype(width).itemsize
            offsets = (offsets * size).tolist()
            own = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[begin:end], pa.array(own, pa.binary())], names=["doc_id", "ids"]
            )

    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "token-ids")
    staged = map_arrow(docs, run, "doc_id long, ids binary", "doc_id", "text")
    staged.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(staged.schema).parquet(path).withColumn("width", F.lit(width))


def _ranked(staged: DataFrame, vocabulary: int) -> np.ndarray:
    """The ids by falling frequency; what reaches the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            if batch.num_rows:
                own = b"".join(batch.column(0).to_pylist())
                counts += np.bincount(np.frombuffer(own, batch.column(1)[0].as_py()), minlength=vocabulary)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])

    counted = staged.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([i for _, i in sorted((-n, i) for i, n in counted.collect())], np.int64)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every document (null text: empty), append end_id, and write the folder described above."""
    spark = docs.sparkSession
    text_batches(spark)
    vocabulary = max(encoder(tokenizer, end_id).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    staged = _staged(docs, tokenizer, end_id, vocabulary)
    by_rank = _ranked(staged, vocabulary)
    ranks = np.zeros(vocabulary, np.int64)
    ranks[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(ranks.astype(np.uint32))  # bounded by the vocabulary
    rows = list(zip(range(len(by_rank)), by_rank.tolist(), strict=True))
    spark.createDataFrame(rows, "rank long, id long").coalesce(1).write.parquet(f"{path}/vocabulary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids, lens, raw, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, start, held
            count = held
            control, data = encode_ranks(shared.value[np.concatenate(raw)])
            row = {
                "part": part, "block": block, "start": start, "n_tokens": count,
                "doc_ids": list(ids), "doc_lens": list(lens), "control": control, "data": data,
            }
            block, start, held = block + 1, start + count, 0
            ids.clear(), lens.clear(), raw.clear()
            return pa.RecordBatch.from_pylist([row], BLOCKS)

        for batch in batches:
            for doc_id, own, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                raw.append(np.frombuffer(own, width))
                lens.append(len(raw[-1]))
                held += lens[-1]
                if held >= BLOCK_TOKENS:
                    yield close()
        if ids:
            yield close()

    ordered = staged.repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id")
    written = ordered.select("doc_id", "ids", "width").mapInArrow(blocks, BLOCKS_DDL)
    written.write.option("compression", "none").parquet(f"{path}/blocks")


BLOCKS_DDL = (
    "part long, block long, start long, n_tokens long, doc_ids array<long>, doc_lens array<long>, control binary, "
    "data binary"
)
BLOCKS = pa.schema(
    [(x, pa.int64()) for x in ("part", "block", "start", "n_tokens")]
    + [(x, pa.list_(pa.int64())) for x in ("doc_ids", "doc_lens")]
    + [(x, pa.binary()) for x in ("control", "data")]
)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the folder."""
    by_rank = np.array(
        [r["id"] for r in spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()], np.uint32
    )  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(by_rank)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals, seen = {}, 0
    for part, n in sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_tokens")).collect())):  # a number per part
        totals[part], seen = seen, seen + n
    bases = spark.sparkContext.broadcast(totals)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            ids = shared.value[decode_ranks(row["control"], row["data"], row["n_tokens"])].astype("<u4")
            lens = np.array(row["doc_lens"], np.int64)
            ends = np.cumsum(lens)
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - lens + row["start"] + bases.value[row["part"]]),
                    pa.array(lens),
                    pa.array(crcs, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return map_arrow(
        blocks, run, "doc_id long, start long, n_tokens long, ids_crc32 long",
        "part", "start", "n_tokens", "doc_ids", "doc_lens", "control", "data",
    )


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens, ids_crc32 per document.

    A null or empty text holds the end id alone. Equal rows are written once each, in any order among equal doc_ids.
    An empty table gives no rows. A null doc_id sorts first and is kept. Other columns are ignored.
    """
    path = path or os.path.join(scratch_path(docs.sparkSession, "token-files"), "v1")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
