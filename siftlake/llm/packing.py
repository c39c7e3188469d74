"""Packing of documents into sequences of bounded length by online best fit with a bounded number of open bins.

The free space of the open bins is kept as a bitset: bit f is set while some open bin has f tokens left. The bin for a
piece is the lowest set bit at or above the piece's length. A full bin closes at once; where no bin fits and the bound
is reached, the fullest one closes, which is the lowest set bit of all.

Each Spark task packs the documents of its input split as they come, so no state crosses tasks and a lost task is
repeated with the same result. A task leaves at most `open_bins` bins that are not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siftlake.llm.common import slices, text_batches, text_list
from siftlake.llm.encoder import encoder

PIECES_SCHEMA = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
)


class BestFit:
    """Online best fit over bins of a fixed capacity, at most open_bins of them open."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # the bitset
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0
        self.n_bins = 0

    def _take(self, space: int) -> int:
        bins = self.by_free[space]
        chosen = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.n_open -= 1
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of 1 to capacity tokens."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.n_open == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
            chosen, space = self.n_bins, self.capacity
            self.n_bins += 1
        left = space - length
        if left:
            self.by_free[left].append(chosen)
            self.free |= 1 << left
            self.n_open += 1
        return chosen, self.capacity - space


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, open_bins: int = 2048, end_id: int = 1
) -> DataFrame:
    """One row per piece of every document, with its sequence and its place there.

    A document is its token ids and end_id. Documents longer than capacity are cut into pieces of capacity tokens, the
    last one shorter. A null or empty text is the end id alone; equal rows are packed once each; an empty table gives
    no rows; a null doc_id is carried through. Other columns are ignored.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bins = encoder(tokenizer, end_id), BestFit(capacity, open_bins)
        first_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), text_list(batch.column(1))
            for begin, end in slices(texts):
                ids, offsets = coder.encode(texts[begin:end])
                rows = []
                for doc_id, a, b in zip(doc_ids[begin:end], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    for piece, start in enumerate(range(0, b - a, capacity)):
                        length = min(capacity, b - a - start)
                        crc = zlib.crc32(ids[a + start : a + start + length].astype("<u4", copy=False))
                        sequence, offset = bins.place(length)
                        rows.append((doc_id, piece, start, length, crc, first_id + sequence, offset))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(columns)],
                        names=[x.split()[0] for x in PIECES_SCHEMA.split(", ")],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES_SCHEMA)


def sequence_fill(lengths: np.ndarray, capacity: int) -> float:
    """Share of used places if these lengths are packed into this many full sequences; a check for tests."""
    return float(lengths.sum() / (capacity * max(1, -(-int(lengths.sum()) // capacity))))
