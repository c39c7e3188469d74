"""Quality rules, licence scan, top-k search and language identification, and the pipeline as a whole."""

from __future__ import annotations

import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from llm_cases import DOCS, SMALL, SMOKE, odd_docs, words  # noqa: F401
from pyspark.sql import functions as F
from test_near import closure, fingerprint, plain_cut, plain_line_dedup
from tokenizers import Tokenizer

from siftlake.llm import catalog, langid, line_dedup, license_scan, quality_rules, topk
from siftlake.llm.common import tokenizer_path


def duck(sql, df):
    """The rows of a DuckDB query over a table documents."""
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    return sorted(con.sql(sql).fetchall(), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


FLOORS = np.diag([f**2.0 for _, f in quality_rules.FEATURES])


def distance(m, mean, cov):
    return np.einsum("ij,jk,ik->i", m - mean, np.linalg.inv(cov), m - mean)


def concentrate(m, mean, cov, last=False):
    """One step by numpy: the estimate from the nearest three quarters, or from all within the 0.975 quantile."""
    classes = np.floor(32 * np.sqrt(distance(m, mean, cov)))
    limit = quality_rules.REWEIGHT_CLASS if last else np.sort(classes)[-(-3 * len(m) // 4) - 1]
    near = m[classes <= limit]
    factor = quality_rules.REWEIGHT_CONSISTENT if last else quality_rules.CONSISTENT
    mean = near.mean(0)
    return mean, factor * (near.T @ near / len(near) - np.outer(mean, mean)) + FLOORS


def searched(m):
    """The estimate of the start with the smallest determinant, before the last step."""
    by_value, n, found = np.sort(m, 0), len(m), []
    quartile = {q: by_value[-(-q * n // 4) - 1] for q in (1, 2, 3)}
    scale = np.maximum(np.sqrt(np.diag(FLOORS)), 0.7413 * (quartile[3] - quartile[1]))
    for q, only in quality_rules.STARTS:
        wide = [1 if only in (0, j) else 1000 for j in range(1, 6)]
        est = quartile[q], np.diag((scale * wide) ** 2)
        for _ in range(quality_rules.SEARCH_STEPS):
            est = concentrate(m, *est)
        found.append(est)
    est = min(found, key=lambda e: np.linalg.det(e[1]) * (1 + 1e-12))
    for _ in range(quality_rules.SETTLE_STEPS):
        est = concentrate(m, *est)
    return est


def pooled(n, own, wider):
    w = n / (n + quality_rules.PRIOR)
    return w * own[0] + (1 - w) * wider[0], w * own[1] + (1 - w) * wider[1]


def vector(n, chars, symbols, lines, repeat):
    return tuple(np.floor([256 * np.log(n), 1024 * np.log(chars / n), 1024 * np.sqrt(symbols / chars),
                           1024 * np.sqrt(lines / n), 1024 * repeat / n]))


def plain_verdicts(stats):
    """kept by doc_id, from (doc_id, lang, source, five counts), by numpy."""
    x, keys, kept = {}, {}, {}
    for i, lang, source, n, *counts in stats:
        if n < 50 or 100 * counts[-1] > 50 * n:
            kept[i] = False
            continue
        x[i] = vector(n, *counts)
        for key in ((), (lang,), (lang, source)):
            keys.setdefault(key, {}).setdefault(x[i], []).append(i)
    found = {}
    for key, rows in sorted(keys.items(), key=lambda e: len(e[0])):
        m = np.array(list(rows))
        own = concentrate(m, *searched(m), last=True)
        found[key] = pooled(len(m), own, found[key[:-1]]) if key else own
        if len(key) == 2:
            near = distance(m, *found[key]) <= quality_rules.CUTOFF
            kept |= {i: bool(ok) for ids, ok in zip(rows.values(), near, strict=True) for i in ids}
    return kept


def plain_statistics(text):
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    runs = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics(odd_docs):
    few = odd_docs.where("doc_id is null or doc_id not in (5, 6)")
    more = few.sparkSession.createDataFrame(
        [(50, "a b c a b c x a b c\n| # <\n| # <\n\n"), (51, "a a a a"), (52, "q w e r q w")], "doc_id long, text string"
    )
    docs = few.select("doc_id", "text").union(more)
    got = rows_of(quality_rules.text_statistics(docs))
    assert got == sorted([(r.doc_id, *plain_statistics(r.text)) for r in docs.collect()], key=str)


def test_verdicts_against_numpy_and_duckdb(spark):
    """A third of the rows of one source, and symbol-laden texts that are outliers of their source."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    noisy = docs.where("doc_id % 40 = 1").select(
        (F.col("doc_id") + 100_000).alias("doc_id"), F.regexp_replace("text", "([a-z]) ", "$1### ").alias("text"),
        "lang", F.lit("hot").alias("source"), "n_chars",
    )
    docs = docs.unionByName(noisy)
    got = quality_rules.judge(docs)
    assert rows_of(got) == duck(quality_rules.ORACLE_SQL, docs)
    stats = quality_rules.text_statistics(docs.select("doc_id", "lang", "source", "text")).collect()
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert kept == plain_verdicts([tuple(r) for r in stats])
    judged = [r for r in got.collect() if not r.base_failed]
    planted = [r for r in judged if r.doc_id >= 100_000 and r.n_symbols > r.word_chars / 3]
    assert planted and not any(r.kept for r in planted)
    assert all(50 * r.n_symbols > r.word_chars for r in judged if not r.kept)


def made_statistics(rng, source, n, junk):
    """n rows of ordinary statistics of one source, of which the share junk is laden with symbols."""
    rows = []
    for i in range(n):
        words_ = int(np.exp(rng.normal(5.5, 0.5))) + 50
        chars = int(words_ * rng.uniform(4.6, 5.4))
        symbols = int(chars * rng.uniform(0.3, 0.4)) if i < junk * n else int(rng.integers(0, 3))
        rows.append((int(rng.integers(1 << 40)), "en", source, words_, chars, symbols, 0, int(rng.integers(0, 9))))
    return rows


def test_small_and_large_groups_judge_alike(spark):
    """The same documents, ordinary and laden, get the same verdict among 20, among 2,000 and alone; in no group do the
    laden ones make up more than the quarter that an estimate leaves out."""
    rng = np.random.default_rng(7)
    rows = made_statistics(rng, "large", 2000, 0.2) + made_statistics(rng, "small", 20, 0.2)
    probes = made_statistics(rng, "large", 40, 0.5)
    for k, probe in enumerate(probes):
        for base, source in ((1 << 50, "large"), (1 << 51, f"tiny{k}"), (1 << 52, "small")):
            if source != "small" or k in (0, 20, 21):
                rows.append((base + k, "en", source, *probe[3:]))
    columns = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    columns = "doc_id long, lang string, source string, " + columns
    kept = {r.doc_id: r.kept for r in quality_rules._verdict(spark.createDataFrame(rows, columns)).collect()}
    for k, probe in enumerate(probes):
        clean = probe[5] < 10
        assert kept[(1 << 50) + k] == kept[(1 << 51) + k] == kept.get((1 << 52) + k, clean) == clean, probe
    assert kept == plain_verdicts(rows)


def test_no_random_start_finds_a_smaller_determinant():
    """Groups with up to a fifth of outliers on one side or in a second crowd, against 300 starts from six rows each."""
    rng = np.random.default_rng(3)
    for share, gap in ((0.0, 0), (0.1, 300), (0.2, 900)):
        mix = rng.normal(0, 1, (5, 5)) * 120
        m = np.floor(rng.normal(0, 1, (400, 5)) @ mix + 1000)
        far = int(share * len(m))
        m[:far] = np.floor(m[:far] * 0.2 + gap)
        best = np.inf
        for _ in range(300):
            few = m[rng.choice(len(m), 6, replace=False)]
            est = few.mean(0), np.cov(few.T) + FLOORS
            for _ in range(8):
                est = concentrate(m, *est)
            best = min(best, np.linalg.det(est[1]))
        assert np.linalg.det(searched(m)[1]) <= 1.05 * best


def test_quality_on_odd_documents(odd_docs, make):
    got = quality_rules.judge(odd_docs)
    assert rows_of(got) == duck(quality_rules.ORACLE_SQL, odd_docs.select("doc_id", "text", "lang", "source"))
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got.where("kept").collect())
    assert quality_rules.judge(make(DOCS, [])).collect() == []


def test_licenses(odd_docs, make):
    mit = license_scan.TEMPLATES["MIT"]
    more = make(DOCS, [
        (70, "Some words.\n\n" + mit.replace(" the ", "\nthe ") + "\n\nmore words", "en", "s", 1),
        (71, mit.lower().replace("free of charge", "free of any charge"), "en", "s", 1),
        (72, "RELEASED under the MIT license!", "en", "s", 1), (73, "under the MIT", "en", "s", 1),
    ])
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    got = rows_of(license_scan.scan_licenses(docs))
    assert got == duck(license_scan.oracle_sql(), docs.select("doc_id", "text"))
    found = {r[0]: r[1] for r in got}
    assert [found[i] for i in (70, 71, 72, 73)] == ["MIT", "MIT", "MIT-short", None]
    assert license_scan.scan_licenses(make(DOCS, [])).collect() == []


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_size_bounds_lose_nothing(size):
    low, high = license_scan.size_bounds(size, 0.8)
    fits = [n for n in range(1, 200) if 2 * min(n, size) / (n + size) >= 0.8]
    assert (low, high) == (fits[0], fits[-1])


def plain_top(rows, k=20, every=20):
    ok = [
        (i, [int(np.floor(64 * float(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, v in {i: min(x for j, x in ok if j == i) for i, _ in ok if i % every == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in ok if i != q and len(x) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_rows", [16_384, 60])
def test_top_products(spark, shard_rows):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = rows_of(topk.top_products(topk.whole_vectors(table), shard_rows=shard_rows))
    assert got == plain_top([(r.vec_id, r.embedding) for r in table.collect()])


def test_top_products_odd_rows(make, monkeypatch):
    monkeypatch.setattr(topk, "PORTION_ROWS", 2)
    monkeypatch.setattr(topk, "LEAF_ROWS", 3)
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (20, [1.0, 2.0]), (5, [float("inf"), 0.0]),
            (7, [-1.0, 0.5]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (60, []), (80, [1.0, 2.0]), (80, [0.5, 0.5])]
    rows += [(100 + i, [0.25, 0.25]) for i in range(30)]
    table = make("vec_id long, embedding array<float>, score int, shard int", [(*r, 1, 2) for r in rows])
    got = rows_of(topk.top_products(topk.whole_vectors(table), k=4, shard_rows=5))
    assert got == plain_top(rows, k=4)
    assert topk.top_products(topk.whole_vectors(table.limit(0))).collect() == []


def test_top_products_beyond_the_exact_floats(make, monkeypatch):
    """Scores near 2 ** 62 that differ by one or two, ties among them, and those that only a long's end can show."""
    monkeypatch.setattr(topk, "LEAF_ROWS", 3)
    big, rng = 1 << 31, np.random.default_rng(5)
    whole = [(0, [big + 1, 3]), (20, [big, -1])] + [(100 + i, [big + int(rng.integers(0, 3)), int(rng.integers(-4, 5))]) for i in range(21, 60)]
    rows = [(i, [x / 64 for x in v]) for i, v in whole]
    for shard_rows in (100, 9):
        table = make("vec_id long, embedding array<double>", rows)
        assert rows_of(topk.top_products(topk.whole_vectors(table), k=7, shard_rows=shard_rows)) == plain_top(rows, k=7)
    huge = make("vec_id long, embedding array<double>", [(0, [1e300, 0.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])])
    got = [tuple(r) for r in topk.top_products(topk.whole_vectors(huge)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 0), (0, 3, 2, -(2**63))]


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in catalog.op10_language_id(spark, SMALL).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert rows.keys() == lang.keys() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out and r.lang_pred != "und"]
    assert sum(rows[i].lang_pred == lang[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())
    sure = [i for i in held if rows[i].accepted]
    assert len(sure) > 0.8 * len(held) and sum(rows[i].lang_pred == lang[i] for i in sure) >= 0.97 * len(sure)


def test_languages_of_odd_documents(odd_docs, make):
    model = langid.train(["the cat and the dog of it"] * 6 + ["der hund und die katze"] * 6, ["en"] * 6 + ["de"] * 6)
    got = langid.predict_languages(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id not in (2, 3, 4, None)} <= {"en", "de"}
    same = [tuple(r)[1:] for r in got if r.doc_id in (5, 6)]
    assert same[0] == same[1]
    assert langid.identify(make(DOCS, [])).collect() == []
    assert langid.identify(make(DOCS, [(1, "no language is known", None, "s", 1)])).collect()[0].lang_pred == "und"


def test_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts, labels = langid.labelled_sample(docs, per_language=30, most=100)
    assert len(texts) == len(labels) <= 100 and max(labels.count(x) for x in set(labels)) <= 30


def plain_pipeline(docs, capacity):
    """Pieces (doc_id, piece, start, length, ids_crc32) of the documents that stay."""
    verdict = {r[0]: r[7] for r in duck(quality_rules.ORACLE_SQL, docs)}
    rows = [(r.doc_id, r.text) for r in docs.collect() if verdict[r.doc_id]]
    rows = [(i, text) for i, text, _, _ in plain_line_dedup(rows, line_dedup.BOUNDS)]
    prints = {i: fingerprint(text) for i, text in rows}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    root = closure(prints, near)
    rows = [(i, text) for i, text in rows if root[i] == i]
    library, out = Tokenizer.from_file(tokenizer_path()), []
    for i, kept in plain_cut_texts(rows, 20):
        ids = np.array([*library.encode(kept, add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            out.append((i, piece, start, len(own), zlib.crc32(own.tobytes())))
    return sorted(out)


def plain_cut_texts(rows, window):
    """The words that stay, joined by blanks; the tokenizer drops white space."""
    seen = set()
    for i, text in sorted(rows):
        own = words(text)
        gone = [False] * len(own)
        for p in range(len(own) - window + 1):
            run = tuple(own[p : p + window])
            if run in seen:
                gone[p : p + window] = [True] * window
            seen.add(run)
        yield i, " ".join(w for w, g in zip(own, gone, strict=True) if not g)


def test_pipeline_against_a_plain_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").where("n_chars < 700 and doc_id < 60")
    copies = docs.where("doc_id % 4 = 0").withColumn("doc_id", F.col("doc_id") + 1000)
    joined = docs.where("doc_id % 5 = 0").select(
        (F.col("doc_id") + 2000).alias("doc_id"), F.concat(F.regexp_replace("text", "\n", " "), F.lit(" and more words")).alias("text"),
        "lang", "source", "n_chars",
    )
    docs = docs.unionByName(copies).unionByName(joined)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == plain_pipeline(docs, 4096)
    assert len({r.doc_id for r in rows}) < docs.count()


def test_stages_keep_the_columns(odd_docs, spark):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, plain.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == plain.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 0


def test_every_operator_has_a_query():
    names = catalog.queries()
    assert [n for n in range(1, 14) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    assert set(catalog.oracle_sql()) <= set(names) and plain_cut


def test_two_language_models_in_one_session(spark):
    """A worker that has one model loaded answers with the other when it is asked with it."""
    docs = spark.createDataFrame([(1, "aba bab abba"), (2, "xyz zyx yzx")], "doc_id long, text string").coalesce(1)
    texts = ["aba bab abba"] * 40 + ["xyz zyx yzx"] * 40
    for labels in (["p"] * 40 + ["q"] * 40, ["q"] * 40 + ["p"] * 40) * 2:
        got = {r.doc_id: r.lang_pred for r in langid.predict_languages(docs, langid.train(texts, labels)).collect()}
        assert got == {1: labels[0], 2: labels[-1]}
