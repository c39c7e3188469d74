"""Toxicity, source divergence and centroid clustering against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from llm_cases import SMALL
from pyspark.sql import functions as F

from siftlake.llm import centroids as ce
from siftlake.llm import divergence as dv
from siftlake.llm import toxicity as tx


# --- source divergence


def plain_divergence(rows, least, top):
    groups, langs, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang or "", source or ""].update(words)
        langs[lang or ""].update(words)
        docs[lang or ""].update(set(words))
    found = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p(counts, t, kept=kept):
            return 1 + 1000000000 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept))

        others = [s for k, s in groups if k == lang and s != source]
        pairs = [(s, sum(abs(p(own, t) - p(groups[lang, s], t)) for t in kept)) for s in others]
        terms = [(t, p(own, t) - p(langs[lang], t)) for t in kept if own[t] and p(own, t) > p(langs[lang], t)]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            found += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(found)


def audited(df, least, top=50):
    rows = dv.source_divergence(df, least, top).select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(tuple(r) for r in rows)


ROWS = [
    ("Der Hund und die Katze", "de", "a"), ("der Hund, der HUND", "de", "b"), (None, "de", "c"), ("", "de", "d"),
    ("Ärger ärger x der", "de", "a"), ("x der Hund", "de", None), ("x y", None, None), ("y", None, "q"), ("y", None, "q"),
    ("only here", "fr", "z"), ("der\x0bHund\tKatze-Katze", "de", "b"),
]


@pytest.mark.parametrize(("blocks", "least"), [((512, 64, 2048), 1), ((2, 2, 3), 2), ((16, 4, 50), 30)])
def test_divergence_against_a_plain_one(spark, make, monkeypatch, blocks, least):
    for name, value in zip(("BLOCK_TERMS", "TILE_SOURCES", "LEVELS_AT_ONCE"), blocks, strict=True):
        monkeypatch.setattr(dv, name, value)
    rng = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    many = [
        (" ".join(rng.choice(words[: 5 + 5 * s]) for _ in range(rng.randrange(40))), "en", f"s{s}")
        for s in range(11)
        for _ in range(6)
    ]
    rows = ROWS + many
    df = make("text string, lang string, source string", rows)
    assert audited(df, least, 7) == plain_divergence(rows, least, 7)


def test_divergence_of_nothing(make):
    empty = make("text string, lang string, source string, rank int, n int", [])
    assert audited(empty, 30) == []
    one = make("text string, lang string, source string, rank int, n int", [("a b", "x", "y", 1, 2)])
    assert audited(one, 30) == []


def test_shares_are_exact(spark):
    n, total, terms = 9_999_999_999_999, 10_000_000_000_000, 99_999
    share = dv.share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(terms).cast("long"))
    assert spark.range(1).select(share).first()[0] == 1 + 1000000000 * (n + 5) // (total + 5 * terms)


# --- centroid clustering


def plain_clusters(rows, clusters=8, rounds=10):
    def usable(v):
        return v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)

    kept = [(i, [floor(1024 * Fraction(x)) for x in v]) for i, v in rows if usable(v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds if centres else 0):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for k, vs in own.items():
            centres[k] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept] if centres else []
    inertia = Counter()
    for _, k, d in found:
        inertia[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    long = lambda x: x if x < 1 << 63 else None
    return [(i, k, long(d), long(inertia[k]), long(sum(inertia.values())), sha[k]) for i, k, d in found]


def clustered(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return [tuple(r) for r in ce.cluster_vectors(df).select(names).collect()]


def by_id(rows):
    return sorted(rows, key=str)


def vectors(n, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (5, 64))
    return [(i, (centres[i % 5] + rng.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(n)]


def test_clusters_against_a_plain_version(make):
    rows = vectors(150)
    rows += [(7, rows[7][1]), (None, rows[3][1]), (900, None), (901, [1.0] * 63), (902, [float("nan")] * 64)]
    rows += [(903, [float("inf")] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [0.0] * 64), (906, [-0.00001] * 64)]
    df = make("vec_id long, embedding array<float>, cluster int", [(*r, 1) for r in rows])
    assert by_id(clustered(df)) == by_id(plain_clusters(rows))


def test_clusters_of_few_or_no_vectors(make):
    for rows in ([], vectors(3), [(None, [1.0] * 64)], [(i, [0.5] * 64) for i in range(20)]):
        df = make("vec_id long, embedding array<double>", rows)
        assert by_id(clustered(df)) == by_id(plain_clusters(rows))


def test_clusters_of_very_large_components(make):
    rows = vectors(40) + [(100 + i, [(-1) ** i * 10.0 ** (i * 20) + i] * 64) for i in range(16)]
    df = make("vec_id long, embedding array<double>", rows)
    assert by_id(clustered(df)) == by_id(plain_clusters(rows))


def test_search_rejects_by_its_bounds_and_stays_exact():
    rng = np.random.default_rng(3)
    centres = [(rng.integers(-300, 300, 64) + 40 * i).tolist() for i in range(24)]
    rows = np.concatenate([rng.integers(-9, 9, (500, 64)) + np.array(centres)[rng.integers(0, 24, 500)], np.zeros((1, 64), int)])
    search = ce.Search([*centres, centres[4], centres[0]])
    number, distance = search.nearest(rows)
    every = ((rows[:, None] - np.array([*centres, centres[4], centres[0]])[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert search.compared < search.seen / 3


# --- toxicity


def toxic_rows(n=900):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "elo", "iru", "otem", "usan", "anir")]
    bad = ["grubfoul", "vilecroak", "snarlmaw"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_texts_are_found_and_clean_ones_left_alone(make):
    rows, labels = toxic_rows()
    rows += [(None, rows[0][1]), (5000, None), (5001, ""), (5002, "…!"), (5003, "bana " * 60_000 + "Grubfoul!")]
    docs = make("doc_id long, text string, score string", [(*r, "x") for r in rows])
    scored = tx.detect_toxicity(docs, make("doc_id long, toxic int, n int", [(*r, 1) for r in labels]))
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    found = {r["doc_id"]: r for r in scored.collect()}
    assert len(found) == len(rows)
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in found.items() if r["held_out"]} == held
    right = sum(found[i]["predicted"] == int(i % 8 == 0) for i in held if i < 5000)
    assert right >= 0.98 * sum(i < 5000 for i in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    assert found[5000]["score"] == found[5001]["score"] == found[5002]["score"] and found[5000]["predicted"] == 0
    assert found[5003]["predicted"] == 1 and found[None]["predicted"] == found[0]["predicted"]


def test_labels_of_held_out_rows_and_other_columns_are_never_used(make):
    rows, labels = toxic_rows(300)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    flipped = [(i, 1 - y if held(i) else y) for i, y in labels]
    docs = make("doc_id long, text string, lang string", [(*r, "x") for r in rows])
    scores = [
        sorted(tuple(r) for r in tx.detect_toxicity(docs, make("doc_id long, toxic int", own)).collect())
        for own in (labels, flipped)
    ]
    assert scores[0] == scores[1]


def test_without_examples_every_text_gets_the_prior(make):
    docs = make("doc_id long, text string", [(1, "a b"), (2, None)])
    for labels in ([], [(1, 0)], [(9, None)], [(77, 1)]):
        scored = tx.detect_toxicity(docs, make("doc_id long, toxic int", labels)).collect()
        assert [round(r["score"], 6) for r in scored] == [tx.PRIOR, tx.PRIOR]
    assert tx.detect_toxicity(docs.limit(0), make("doc_id long, toxic int", [])).collect() == []


def test_scores_follow_from_the_model_plainly(make):
    rows, labels = toxic_rows(400)
    bad = {i for i, y in labels if y}
    model = tx.train([t for i, t in rows if i in bad], [t for _, t in rows], 0.125)
    coder = tx.Coder()
    names = lambda t: {n for n, k in coder.names.items() if k in set(coder.features(t).tolist())}
    scorer = tx.Scorer(model)
    texts = ["", "bana Grubfoul", "gruBfoulish\x0bbana", *[t for _, t in rows[:20]]]
    for text, score in zip(texts, scorer.score(texts).tolist(), strict=True):
        total = 0.0
        for n in [coder.features(text), names(text)][1]:
            total += model.weights[model.features[n]] if n in model.features else 0.0
        assert score == pytest.approx(1 / (1 + np.exp(-(model.scale * (model.bias + total) + model.offset))))


def test_risk_estimate_is_unbiased_and_bounded():
    toxic, clean = np.array([2.0, 1.0]), np.array([-1.0, -3.0, 0.5])
    mixed = np.concatenate([np.repeat(toxic, 3), np.repeat(clean, 6)])  # a quarter is toxic
    positive, rest = tx.pu_risk(toxic, mixed, 0.25)
    assert positive == pytest.approx(0.25 * np.logaddexp(0, -toxic).mean())
    assert rest == pytest.approx(0.75 * np.logaddexp(0, clean).mean())


def test_audits_run_on_the_given_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scored = tx.detect_toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert scored.count() == docs.count()
