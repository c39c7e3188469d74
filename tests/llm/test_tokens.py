"""Encoding, packing and token files against the tokenizers library."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, SMOKE, odd_docs  # noqa: F401
from tokenizers import Tokenizer

from siftlake.llm import bpe, packing, token_files
from siftlake.llm.common import tokenizer_path
from siftlake.llm.encoder import PieceEncoder

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(1, 0x250), 0x300, 0x301, 0x3A3, 0x2003, 0x1E9E, 0x1F600, 0x4E2D, 0x212B]]
    letters += ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " ", "\n"] * 20
    return ["".join(rng.choice(letters) for _ in range(200)) for _ in range(200)] + ["", " ", "a" * 3000, "x\x1cy\x85z"]


def test_encoder_gives_the_librarys_ids(library):
    texts = odd_texts()
    ids, offsets = PieceEncoder(PATH, 1).encode(texts)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*ids_of(library, text), 1]


def test_trie_gives_the_librarys_ids_and_texts(library):
    codec, texts = bpe.Codec(PATH), odd_texts()
    codec.learn(texts)
    for text in texts:
        ids, own = ids_of(library, text), codec.encode(text)
        assert " ".join(x[0] for x in own) == " ".join(map(str, ids))
        assert " ".join(x[2] for x in own) == library.decode(ids, skip_special_tokens=False)


def test_trie_on_a_vocabulary_without_end_mark():
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "a"), ("ca", "ca")]
    vocabulary = {t: i for i, t in enumerate([*"abc", *(x + y for x, y in merges)])}
    trie = bpe.TrieBpe(vocabulary, merges, "")
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    for word, ids in trie.encode(words).items():
        assert [trie.tokens[i] for i in ids] == trie.merged(list(word))


def test_two_merges_of_one_token_are_refused():
    with pytest.raises(ValueError, match="two merges"):
        bpe.TrieBpe({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("aa", "a"), ("a", "aa")], "")


def test_op5_on_odd_documents(odd_docs, library):
    got = sorted(map(tuple, bpe.encode_documents(odd_docs, PATH).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        ids = ids_of(library, r.text)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_op4_on_odd_documents(odd_docs, library, tmp_path):
    docs = odd_docs.where("doc_id > 1")
    got = sorted(map(tuple, token_files.token_file_digest(docs, PATH, path=str(tmp_path / "files")).collect()))
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*ids_of(library, r.text), 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    every = token_files.token_file_digest(odd_docs, PATH).collect()
    assert len(every) == odd_docs.count()
    ends = sorted((r.start, r.start + r.n_tokens) for r in every)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_empty_tables(make):
    empty = make(DOCS, [])
    assert token_files.token_file_digest(empty, PATH).collect() == []
    assert packing.pack_documents(empty, PATH).collect() == []
    assert bpe.encode_documents(empty, PATH).collect() == []


@given(st.lists(st.integers(0, 2**32 - 1)))
@settings(max_examples=60, deadline=None)
def test_ranks_come_back(ranks):
    control, data = token_files.encode_ranks(np.array(ranks, np.int64))
    assert token_files.decode_ranks(control, data, len(ranks)).tolist() == ranks
    assert len(control) == -(-len(ranks) // 4)


def test_frequent_ids_take_one_byte(spark, make, tmp_path):
    token_files.write_token_files(make(DOCS, [(1, "the the the of", "en", "s", 1)]), str(tmp_path / "f"), PATH)
    block = spark.read.parquet(str(tmp_path / "f/blocks")).collect()[0]
    assert block.n_tokens == 5 and len(block.data) == 5 and block.control[0] == 0


def check_packing(rows, capacity):
    for sequence in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == sequence)
        end = 0
        for offset, length in own:
            assert offset == end
            end += length
        assert end <= capacity


def test_op3_on_odd_documents(odd_docs, library):
    rows = packing.pack_documents(odd_docs, PATH, capacity=256).collect()
    check_packing(rows, 256)
    want = []
    for r in odd_docs.collect():
        ids = np.array([*ids_of(library, r.text), 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 256)):
            own = ids[start : start + 256]
            want.append((r.doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == sorted(want, key=str)


def test_few_sequences(spark):
    rows = packing.pack_documents(spark.read.parquet(f"{SMOKE}/documents.parquet"), PATH).collect()
    check_packing(rows, 4096)
    least = -(-sum(r.length for r in rows) // 4096)
    assert len({r.sequence_id for r in rows}) <= 1.1 * least + 1


@given(st.lists(st.integers(1, 16), max_size=120), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_best_fit_against_a_plain_one(lengths, open_bins):
    """The fitting bin with the least space takes a piece; the fullest closes when too many are open."""
    fast, free = packing.BestFit(16, open_bins), {}
    for length in lengths:
        chosen, offset = fast.place(length)
        fitting = [f for f in free.values() if f >= length]
        if fitting:
            assert free[chosen] == min(fitting) and offset == 16 - free[chosen]
        else:
            assert chosen not in free and offset == 0
            if len(free) == open_bins:
                fullest = [b for b, f in free.items() if f == min(free.values())]
                still = {b for bins in fast.by_free for b in bins} | {chosen}
                closed = [b for b in fullest if b not in still]
                assert len(closed) == 1
                del free[closed[0]]
            free[chosen] = 16
        free[chosen] -= length
        if not free[chosen]:
            del free[chosen]
        assert fast.n_open == len(free) <= open_bins
