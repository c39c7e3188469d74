"""Line dedup, SimHash and substring dedup against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from llm_cases import DOCS, SMALL, words, odd_docs  # noqa: F401

from siftlake.llm import line_dedup, simhash, substring_dedup
from siftlake.llm.components import components


def closure(nodes, links):
    """The smallest node of each node's component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    for _ in range(n):
        k, kind = rng.randrange(len(text) + 1), rng.randrange(3)
        text = text[:k] + ("" if kind == 1 else rng.choice("abé")) + text[k + (kind > 0) :]
    return text


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(30)]])
def test_components(make, links):
    got = {r.node: r.root for r in components(make("a long, b long", [*links, (None, 3)])).collect()}
    nodes = {n for link in links for n in link}
    assert got == closure(nodes, links)


@pytest.mark.parametrize("t", [1, 2])
def test_banded_distance(make, t):
    rng = random.Random(t)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.randrange(12))) for _ in range(200)]
    pairs = [(a, edited(rng, a, rng.randrange(4))) for a in texts]
    got = make("a string, b string", pairs).select(line_dedup.edits_within(F.col("a"), F.col("b"), t).alias("d")).collect()
    assert [r.d for r in got] == [d if (d := edits(a, b)) <= t else None for a, b in pairs]


def bound(length, bounds):
    return max((b for b in bounds if length >= b[0]), default=(0, 0))[1]


@pytest.mark.parametrize("bounds", [((8, 1),), ((8, 1), (20, 2))])
@pytest.mark.parametrize("crowd", [100, 1])
def test_line_links(make, bounds, crowd):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 12, 20, 26, 33]))) for _ in range(40)]
    lines = list(dict.fromkeys(edited(rng, rng.choice(base), rng.randrange(3)) for _ in range(250)))
    near = lambda a, b: abs(len(a) - len(b)) < 3 and edits(a, b) <= bound(min(len(a), len(b)), bounds)
    want = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[i + 1 :] if near(a, b)}
    df = make("line string", [(x,) for x in lines]).withColumn("h", F.xxhash64("line"))
    name = {r.h: r.line for r in df.collect()}
    keyed = df.select("h", *line_dedup.line_keys(F.col("line"), bounds))
    got = line_dedup.line_links(keyed, df.union(df), bounds, crowd).collect()
    assert {frozenset((name[r.a], name[r.b])) for r in got} == want


def plain_line_dedup(rows, bounds):
    """Kept text, lines with a word and lines taken out of each (doc_id, text)."""
    key = lambda i: -(1 << 63) if i is None else i
    split = [(i, t, (t or "").split("\n")) for i, t in rows]
    lines = {x for _, _, own in split for x in own if words(x)}
    by_length = {}
    for x in lines:
        by_length.setdefault(len(x), []).append(x)
    most, links = max((t for _, t in bounds), default=0), []
    for a in lines:
        t = bound(len(a), bounds)
        for d in range(t + 1):
            links += [(a, b) for b in by_length.get(len(a) + d, ()) if a != b and edits(a, b) <= t]
    assert most < 3
    root = closure(lines, links)
    first = {}
    for i, _, own in split:
        for x in own:
            if x in root:
                first[root[x]] = min(first.get(root[x], key(i)), key(i))
    out = []
    for i, text, own in split:
        seen, kept = set(), []
        for x in own:
            gone = x in root and (first[root[x]] != key(i) or root[x] in seen)
            seen.add(root.get(x))
            if not gone:
                kept.append(x)
        out.append((i, None if text is None else "\n".join(kept), sum(x in root for x in own), len(own) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup_on_odd_documents(odd_docs, make):
    docs = odd_docs.where("doc_id is null or doc_id not in (5, 6)")
    near = "a line of twenty-five chars\nanother one that is quite long, too\nshort\n\n \nshort"
    more = [(20, near, "en", "s", 1), (21, near.replace("chars", "char"), "en", "s", 1), (22, near.replace("too", "two"), "en", "s", 1)]
    docs = docs.unionByName(make(DOCS, more), allowMissingColumns=True)
    done = line_dedup.drop_repeated_lines(docs)
    assert done.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_removed"]
    got = sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in done.collect()], key=str)
    assert got == plain_line_dedup([(r.doc_id, r.text) for r in docs.collect()], line_dedup.BOUNDS)


def test_digest_of_lines_with_one_and_two_edits(make):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (22, 24, 25, 94, 95, 96, 97, 98, 130)]
    texts = ["\n".join(edited(rng, x, e) for x in rng.sample(base, 5) for e in (0, rng.randrange(4))) for _ in range(12)]
    done = line_dedup.line_digest(make(DOCS, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()
    want = [
        (i, n, gone, hashlib.sha256(text.encode()).hexdigest())
        for i, text, n, gone in plain_line_dedup(list(enumerate(texts)), line_dedup.BOUNDS)
    ]
    assert sorted(map(tuple, done), key=str) == sorted(want, key=str) and sum(r.n_removed for r in done) > 60


def test_line_dedup_long_texts_and_empty_table(odd_docs, make):
    done = {r.doc_id: r for r in line_dedup.drop_repeated_lines(odd_docs.where("doc_id in (5, 6)")).collect()}
    assert done[6].text == "" and done[6].n_removed == done[6].n_lines == 4000
    assert done[5].n_lines - done[5].n_removed >= 10  # numbers one edit apart make chains
    assert line_dedup.line_digest(make(DOCS, [])).collect() == []


def fingerprint(text):
    own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_on_odd_documents(odd_docs):
    rng = random.Random(2)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "Eps"]) + str(rng.randrange(50)) for _ in range(300)]
    rows = [r for r in odd_docs.collect()]
    docs = odd_docs.select("doc_id", "text")
    copies = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(300)] = f"changed{i}"
        copies.append((100 + i, " ".join(own)))
    docs = docs.union(docs.sparkSession.createDataFrame(copies, "doc_id long, text string"))
    pairs = [(r.doc_id, r.text) for r in rows] + copies
    prints = [fingerprint(t) for _, t in pairs]
    near = [(a, b) for a in range(len(pairs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = closure(range(len(pairs)), near)
    assert 1 < len(set(prints[-60:])) and len({root[len(pairs) - 1 - k] for k in range(60)}) < 60
    want = []
    for k, (i, _) in enumerate(pairs):
        ids = [pairs[x][0] for x in root if root[x] == root[k] and pairs[x][0] is not None]
        want.append((i, format(prints[k], "016x"), min(ids, default=None)))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert {i for i in kept if i is not None} == {c for _, _, c in want if c is not None}


@pytest.mark.parametrize("block", [2, 512])
def test_fingerprint_links_connect_what_is_near(make, block):
    rng = random.Random(4)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 90])):
            x = center
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    links = simhash.fingerprint_links(make("fp long", [(x,) for x in prints]), 3, block).collect()
    assert closure(prints, [(r.a, r.b) for r in links]) == closure(prints, near)


@pytest.mark.parametrize("m", [2, 3, 4])
def test_thresholds_and_partitions(m):
    both = np.eye(64) * 50
    parts = simhash.correlated_partitions(100, both, m)
    assert sorted(b for p in parts for b in p) == list(range(64)) and max(map(len, parts)) - min(map(len, parts)) <= 1
    costs = [{t: (t + 1) * (i + 1) ** 2 for t in range(-1, 4)} for i in range(m)]
    cost, chosen = simhash.best_thresholds([{t: float(c) for t, c in x.items()} for x in costs], 4 - m)
    assert sum(chosen) == 4 - m and cost == sum(costs[i][t] for i, t in enumerate(chosen))
    assert chosen[0] == 3  # the cheapest takes all, the others are left out


def test_near_duplicates_of_nothing(make):
    assert simhash.near_duplicates(make(DOCS, [])).collect() == []


def plain_cut(rows, window):
    """Words, words taken out and the digest of the others, of each (doc_id, text)."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or "")):
        own = words(text)
        gone = [False] * len(own)
        for p in range(len(own) - window + 1):
            run = tuple(own[p : p + window])
            if run in seen:
                gone[p : p + window] = [True] * window
            seen.add(run)
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out.append((i, len(own), sum(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()], key=str)


def test_substring_dedup_on_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert digests(substring_dedup.repeat_digest(docs)) == plain_cut([(r.doc_id, r.text) for r in docs.collect()], 20)


@pytest.mark.parametrize("shard_docs", [5, 1024])
def test_substring_dedup_on_dense_repeats(make, monkeypatch, shard_docs):
    monkeypatch.setattr(substring_dedup, "SHARD_DOCS", shard_docs)
    rng = random.Random(3)
    blank = lambda: rng.choice([" ", "\n", " \t "])
    rows = [(i * 1000003 % 977, blank().join(rng.choice("abé") for _ in range(rng.choice([0, 3, 6, 40, 200])))) for i in range(90)]
    rows += [(None, "a b c a b c a b"), (None, None), (9999, "")]
    done = substring_dedup.cut_repeats(make("doc_id long, text string", rows), 6, 3)
    assert digests(done) == plain_cut(rows, 6)
    for r in done.collect():
        assert sha256(" ".join(words(r.kept_text)).encode()).hexdigest() == r.kept_sha256


def test_substring_dedup_on_odd_documents(odd_docs, make):
    done = substring_dedup.cut_repeats(odd_docs)
    assert digests(done) == plain_cut([(r.doc_id, r.text) for r in odd_docs.collect()], 20)
    assert done.select("rest.*").columns == [c for c in odd_docs.columns if c not in ("doc_id", "text")]
    assert substring_dedup.repeat_digest(make(DOCS, [])).collect() == []


def test_automaton_reads_only_what_may_recur(monkeypatch):
    """Two texts of 3,000 words share 30; one shares nothing. Windows that recur are marked, and little else is read."""
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(30)]
    texts = [[f"w{rng.random()}" for _ in range(3000)] for _ in range(3)]
    texts[0][1000:1030] = texts[2][2970:] = shared
    hashes, _, _, counts = substring_dedup.hash_words([" ".join(t).encode() for t in texts])
    runs, named = substring_dedup.phrase_marks(hashes, counts, 20, 8)
    every, times = np.unique(runs[named], return_counts=True)
    read = []

    class Counting:
        def __init__(self, *kinds):
            self.real = real(*kinds)

        def __getattr__(self, name):
            return getattr(self.real, name)

        def iter(self, words):
            read.append(len(words))
            return self.real.iter(words)

    real = substring_dedup.ahocorasick.Automaton
    monkeypatch.setattr(substring_dedup.ahocorasick, "Automaton", Counting)
    marked = np.flatnonzero(substring_dedup._located(hashes, counts, every[times > 1], 20, 8))
    assert {*range(1000, 1011), *range(8970, 8981)} <= {*marked.tolist()} and len(marked) < 60
    assert 0 < sum(read) < 150


def test_copies_with_changed_words_do_not_all_meet(make):
    """70 copies of a long line, each with two words changed, and 20 of them edited: few of their pairs are made."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshrdl") for _ in range(8))
    base = [word() for _ in range(30)]
    lines = []
    for _ in range(70):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(30)] = word()
        lines.append(" ".join(own))
    lines = list(dict.fromkeys([*lines, *(edited(rng, x, rng.randrange(1, 3)) for x in lines[:20])]))
    df = make("line string", [(x,) for x in lines]).withColumn("h", F.xxhash64("line"))
    keyed = df.select("h", *line_dedup.line_keys(F.col("line"), line_dedup.BOUNDS))
    keys = [line_dedup._first_keys(keyed, line_dedup.BOUNDS, own) for own in (True, False)]
    name = {r.h: r.line for r in df.collect()}
    met = {frozenset((name[r.a], name[r.b])) for r in line_dedup._meet(*keys, 2).collect()}
    near = {frozenset((x, y)) for x in lines[70:] for y in lines[:70] if abs(len(x) - len(y)) < 3 and edits(x, y) <= 2}
    assert near <= met and len(near) >= 20 and len(met) < 1000


def test_counts_and_parities_never_part_near_lines(make):
    rng = random.Random(10)
    texts = ["".join(rng.choice("eatnio xé\U0001f600") for _ in range(rng.choice([0, 3, 60, 200]))) for _ in range(300)]
    df = make("a string, b string", [(a, edited(rng, a, 2)) for a in texts])
    letters, parities = ([f(F.col(c)) for c in "ab"] for f in (line_dedup.letter_counts, line_dedup.char_parities))
    kept = df.where(line_dedup._counts_allow(*letters, 2) & line_dedup._parities_allow(*parities, 2))
    assert kept.count() == len(texts)


def test_keys_are_made_in_methods_that_the_jvm_compiles(make, capsys):
    """Beyond 8000 bytes a generated method is interpreted at every row."""
    df = make("line string", [("a line of thirty characters or so",)]).withColumn("h", F.xxhash64("line"))
    keyed = df.select("h", *line_dedup.line_keys(F.col("line"), line_dedup.BOUNDS))
    for own in (True, False):
        line_dedup._first_keys(keyed, line_dedup.BOUNDS, own).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
