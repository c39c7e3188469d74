"""Passages that occur again, by automata of the phrases that recur.

A window is `window` consecutive words of a document. Each word of a window goes that has occurred earlier: in a
document with a smaller doc_id, or before in the same one. Three passes over the texts, with two exchanges of hashes:

1. Each document names its phrases: runs of `phrase` words with the smallest hash among those of some window, so that
   equal windows name equal phrases. The hashes meet in buckets, which confirm those that occur at least twice.
2. Documents are dealt to shards. A shard gets the confirmed hashes that it asked for, compiles their phrases into an
   Aho-Corasick automaton over word numbers, and streams all its documents through it. Only windows that hold a located
   phrase can recur; their hashes meet in buckets again, which find the first document of each.
3. A shard gets the hashes of which an earlier document lies elsewhere, and takes the words out.

Hashes travel as packed arrays with one entry per shard and hash, so a passage that a third of all documents share
weighs no more than one entry for each shard. Words are compared byte by byte through 64-bit hashes, windows by 64-bit
hashes of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import ranges, text_batches
from siftlake.llm.wordhash import chosen, hash_words, runs_of
from siftlake.session import materialise

WINDOW, PHRASE = 20, 8
#: Documents in a shard, and documents whose hashes meet in a bucket, on average.
SHARD_DOCS, BUCKET_DOCS = 1024, 4096
#: Hashes that a task of the first pass holds before it hands them on.
HELD = 2_000_000
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(1 << 63)

ASKED = "bucket int, shard long, hashes binary, docs binary"
SHARD_ROWS = "shard long, hashes binary"
_CUT = (("doc_id", "long"), ("kept_text", "string"), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"))


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def _within(counts: np.ndarray, size: int) -> np.ndarray:
    """Marks the words that begin a run of size words within their text, among the first len - size + 1 words."""
    total = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return (np.arange(total) + size <= ends)[: max(0, total - size + 1)]


def phrase_marks(hashes: np.ndarray, counts: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the run of phrase words at each word, and which of them a text names."""
    runs = runs_of(hashes, phrase)
    named = np.zeros(len(runs), bool)
    begin = 0
    for count in counts.tolist():
        if count >= window:
            own = runs[begin : begin + count - phrase + 1]
            named[begin : begin + count - phrase + 1] = chosen(own, window - phrase + 1)
        begin += count
    return runs, named


def _packed(shard: int, hashes: np.ndarray, docs: np.ndarray | None, buckets: int) -> Iterator[dict]:
    """Rows of ASKED: the hashes, and the document of each, by bucket."""
    bucket = (hashes >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    narrow = docs is not None and len(docs) and docs.min() >= 0 and docs.max() < 1 << 31
    for b in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[b] : bounds[b + 1]]
        named = b"" if docs is None else docs[own].astype("<i4" if narrow else "<i8").tobytes()
        yield {"bucket": int(b), "shard": shard, "hashes": hashes[own].tobytes(), "docs": named}


_ASKED_ARROW = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary())])
_SHARD_ARROW = pa.schema([("shard", pa.int64()), ("hashes", pa.binary())])


def _unpacked(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    docs = [
        np.frombuffer(x, "<i4" if len(x) == 4 * len(h) else "<i8").astype(np.int64) if len(x) else np.zeros(0, np.int64)
        for x, h in zip(table.column("docs").to_pylist(), hashes, strict=True)
    ]
    return hashes, docs


def _confirm(table: pa.Table) -> pa.Table:
    """Of the hashes in a bucket, those that occur twice or more, for each shard that asked.

    A shard may ask in several rows. A hash that one row has seen twice stands in it twice.
    """
    hashes, _ = _unpacked(table)
    every, counts = np.unique(np.concatenate(hashes), return_counts=True)
    recurring = every[counts > 1]
    shards = np.array(table.column("shard").to_pylist(), np.int64)
    rows = []
    for shard in np.unique(shards).tolist():
        own = np.unique(np.concatenate([hashes[i] for i in np.flatnonzero(shards == shard)]))
        own = own[np.isin(own, recurring, assume_unique=True)]
        if len(own):
            rows.append({"shard": shard, "hashes": own.tobytes()})
    return pa.Table.from_pylist(rows, _SHARD_ARROW)


def _earlier(table: pa.Table) -> pa.Table:
    """Of the hashes in a bucket, for each shard those whose first document lies in another shard."""
    hashes, docs = _unpacked(table)
    shards = table.column("shard").to_pylist()
    every, doc = np.concatenate(hashes), np.concatenate(docs)
    shard = np.repeat(np.array(shards, np.int64), [len(h) for h in hashes])
    order = np.lexsort((shard, doc, every))
    every, shard = every[order], shard[order]
    later = np.append(False, every[1:] == every[:-1])
    every, shard = every[later], shard[later]
    rows = []
    by_shard = np.argsort(shard, kind="stable")
    names, begins = np.unique(shard[by_shard], return_index=True)
    for name, own in zip(names.tolist(), np.split(by_shard, begins[1:]), strict=False):
        rows.append({"shard": name, "hashes": every[own].tobytes()})
    return pa.Table.from_pylist(rows, _SHARD_ARROW)


def _located(hashes: np.ndarray, counts: np.ndarray, confirmed: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Marks the words that begin a window with a confirmed phrase, by an automaton over the words' numbers.

    The automaton reads the stretches covered by windows that hold a phrase which their own text names: equal windows
    name equal phrases, so no other window can recur.
    """
    total = len(hashes)
    marks = np.zeros(total + 1, np.int64)
    runs, named = phrase_marks(hashes, counts, window, phrase)
    places = np.flatnonzero(named)
    places = places[np.isin(runs[places], confirmed)]
    if len(places):
        ends = np.cumsum(counts)
        text = np.searchsorted(ends, places, side="right")
        first = np.maximum(places - (window - phrase), ends[text] - counts[text])
        last = np.minimum(places + window, ends[text])
        fresh = np.append(True, (first[1:] > last[:-1]) | (text[1:] != text[:-1]))
        first, last = first[fresh], last[np.append(fresh[1:], True)]
        sizes = last - first
        read = ranges(first, sizes)
        _, numbers = np.unique(hashes[read], return_inverse=True)
        begins = np.cumsum(sizes) - sizes
        _, once = np.unique(runs[places], return_index=True)
        within = np.searchsorted(first, places[once], side="right") - 1
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for place in (begins[within] + places[once] - first[within]).tolist():
            automaton.add_word(tuple(numbers[place : place + phrase].tolist()))
        automaton.make_automaton()
        numbers = numbers.tolist()
        found, of = [], []
        for stretch, (begin, size) in enumerate(zip(begins.tolist(), sizes.tolist(), strict=True)):
            before = len(found)
            found += [end for end, _ in automaton.iter(tuple(numbers[begin : begin + size]))]
            of.append(len(found) - before)
        of = np.repeat(np.arange(len(of)), of)
        ended = first[of] + np.array(found, np.int64)
        np.add.at(marks, np.maximum(ended - window + 1, first[of]), 1)
        np.add.at(marks, np.minimum(ended - phrase + 1, last[of] - window) + 1, -1)
    return np.cumsum(marks)[:total] > 0


def _in_order(docs: pa.Table) -> tuple[list[int], list, list[str | None]]:
    """The order of a shard's rows by doc_id, then text, nulls first; and doc_id and text in that order."""
    ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i] or ""))
    return order, [ids[i] for i in order], [texts[i] for i in order]


def _replies(table: pa.Table) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def cut_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """One row per row of docs: doc_id, kept_text without the words taken out, n_words, n_removed, kept_sha256 of the
    words that stay, joined by blanks, and rest, a struct of the other columns.

    kept_text is the text itself where nothing goes; else each run of words that goes is cut out from its first byte to
    the next word that stays. A null or short text has no window and stays as it is. Rows with the same doc_id come in
    the order of their texts, and a null doc_id before all others; where such rows lie in two shards the order is that
    of the shards. Equal rows therefore count as repeats of each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None).cast("int")).alias("rest"))
    total = docs.count()
    shards, buckets = max(1, total // SHARD_DOCS), max(64, total // BUCKET_DOCS)
    shard = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(shards))
    dealt = docs.withColumn("shard", shard)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            shard, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            for own in np.unique(shard).tolist():
                every, counts = np.unique(hashes[shard == own], return_counts=True)
                twice = np.concatenate([every, every[counts > 1]])
                yield pa.RecordBatch.from_pylist(list(_packed(own, twice, None, buckets)), _ASKED_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, _, _, counts = hash_words(_texts(batch.column(0)))
            runs, named = phrase_marks(hashes, counts, window, phrase)
            of_word = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), counts)[: len(runs)]
            held.append((of_word[named], runs[named]))
            size += int(named.sum())
            if size > HELD:
                yield from rows()
                held, size = [], 0
        if size:
            yield from rows()

    def find(key, own: pa.Table, replies: pa.Table) -> pa.Table:
        _, ids, texts = _in_order(own)
        hashes, _, _, counts = hash_words([(x or "").encode() for x in texts])
        marked = _located(hashes, counts, _replies(replies), window, phrase)
        windows = runs_of(hashes, window)
        at = np.flatnonzero(marked[: len(windows)] & _within(counts, window))
        every, first = np.unique(windows[at], return_index=True)  # the first in the shard, which is in order
        numbers = np.repeat(np.array([NO_ID if i is None else i for i in ids], np.int64), counts)
        rows = list(_packed(key[0].as_py(), every, numbers[at[first]], buckets)) if len(every) else []
        return pa.Table.from_pylist(rows, _ASKED_ARROW)

    def cut(key, own: pa.Table, replies: pa.Table) -> pa.Table:
        order, ids, texts = _in_order(own)
        raw = [(x or "").encode() for x in texts]
        hashes, starts, ends, counts = hash_words(raw)
        windows = runs_of(hashes, window)
        at = np.flatnonzero(_within(counts, window))
        repeats = np.ones(len(at), bool)
        repeats[np.unique(windows[at], return_index=True)[1]] = False
        repeats |= np.isin(windows[at], _replies(replies))
        covered = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(covered, at[repeats], 1)
        np.add.at(covered, at[repeats] + window, -1)
        gone = np.cumsum(covered)[:-1] > 0
        rows, begin = [], 0
        for doc_id, text, data, count in zip(ids, texts, raw, counts.tolist(), strict=True):
            rows.append(_cut_one(doc_id, text, data, starts[begin : begin + count], ends[begin : begin + count], gone[begin : begin + count]))
            begin += count
        return pa.Table.from_pylist(rows, _CUT_ARROW).append_column("rest", own.column("rest").take(pa.array(order, pa.int64())))

    def asked_of(rows: DataFrame, answer) -> DataFrame:
        return rows.groupBy("bucket").applyInArrow(answer, SHARD_ROWS)

    asked = dealt.select("text", "shard").mapInArrow(ask, ASKED)
    confirmed = asked_of(asked, _confirm)
    found = dealt.drop("rest").groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(find, ASKED)
    repeats = materialise(asked_of(found, _earlier), "repeated-windows")
    schema = ", ".join(f"{name} {kind}" for name, kind in _CUT) + f", rest {docs.schema['rest'].dataType.simpleString()}"
    return dealt.groupBy("shard").cogroup(repeats.groupBy("shard")).applyInArrow(cut, schema)


_CUT_ARROW = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in _CUT])


def _cut_one(doc_id, text, data: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> dict:
    words = [data[a:b] for a, b, g in zip(starts.tolist(), ends.tolist(), gone.tolist(), strict=True) if not g]
    kept = text
    if gone.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        parts, at = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            parts.append(data[at : starts[a]])
            at = int(starts[b]) if b < len(starts) else int(ends[b - 1])
        kept = b"".join([*parts, data[at:]]).decode()
    return {
        "doc_id": doc_id,
        "kept_text": kept,
        "n_words": len(gone),
        "n_removed": int(gone.sum()),
        "kept_sha256": sha256(b" ".join(words)).hexdigest(),
    }


def repeat_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of cut_repeats."""
    return cut_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
