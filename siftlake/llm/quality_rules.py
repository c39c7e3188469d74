"""Quality rules and robust multivariate outliers. DataFrame and SQL functions only.

Documents that fail a base rule go. The others are judged by five statistics, transformed so that they spread evenly and
kept as whole numbers, against the minimum-covariance-determinant estimate of their language and source: the mean and
the covariance of the COVERED share of the group whose covariance has the smallest determinant. The search has STARTS:
medians, lower and upper quartiles with the scales of all statistics, and medians with the scale of one statistic
alone. Each takes SEARCH_STEPS concentration steps, which measure every document with the estimate of the step before
and estimate anew from the nearest; the start with the smallest determinant goes on for SETTLE_STEPS more, and a last
step estimates from all documents within the 0.975 quantile. Rejected are documents beyond the 0.999 quantile of the
squared Mahalanobis distance.

Equal statistics count once in a group, so copies do not make a group look narrow. Languages and the corpus are
estimated in the same way, and a group is pooled with PRIOR documents' worth of its language, a language with as much of
the corpus: a document of a small source is judged as one of a large source is.

A step is one grouping: documents are counted and their sums and products added up by group and distance, in classes of
1/32, and running totals over the classes give the estimate of all whole classes up to the covered share. The sums are
exact, so the result does not depend on how the rows lie, and no group is ever held in one place: a window holds the
classes of one group and start, 65,537 at most.

Every standard deviation has a floor of a twentieth (lengths: a half, as natural logarithm; repeated words: a tenth), so
that a statistic that is zero nearly everywhere does not make outliers of ordinary documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import BLANK_RE, BLANKS, WORD_RE, let
from siftlake.session import materialise

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

#: Transformed statistics: SQL over the counts, and the floor of the standard deviation in the same whole numbers.
FEATURES = (
    ("256 * ln(CAST(n_words AS DOUBLE))", 128),
    ("1024 * ln(CAST(word_chars AS DOUBLE) / n_words)", 51),
    ("1024 * sqrt(CAST(n_symbols AS DOUBLE) / word_chars)", 51),
    ("1024 * sqrt(CAST(n_dup_lines AS DOUBLE) / n_words)", 51),
    ("1024.0e0 * n_repeat_words / n_words", 102),
)
#: The share that an estimate covers (3 of 4) and what makes its covariance fit normal data: COVERED / P(chi2_7 <= q)
#: with q the quantile of chi2_5 at that share.
COVERED, CONSISTENT = (3, 4), 1.412
#: The last step: the distance class of the 0.975 quantile of chi2_5, and the factor for that share.
REWEIGHT_CLASS, REWEIGHT_CONSISTENT = 114, 1.0555
#: Quartile of the centre, and the one statistic whose scale counts (0: all).
STARTS = ((2, 0), (1, 0), (3, 0), *((2, j) for j in range(1, len(FEATURES) + 1)))
SEARCH_STEPS, SETTLE_STEPS = 2, 3
#: The greatest squared distance that stays: the quantile of chi2_5 at 0.999.
CUTOFF = 20.515
#: Documents that the estimate one level up weighs as much as.
PRIOR = 30


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs without text, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    text = F.coalesce("text", F.lit(""))

    def windows(words: Column) -> Column:
        entry = lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
        return F.when(F.size(words) >= 3, F.slice(F.transform(words, entry), F.lit(1), F.size(words) - 2))

    def repeated(own: Column) -> Column:
        beside = lambda i: F.coalesce(F.get(own, i)["h"], F.lit(None).cast("long"))
        twice = F.filter(own, lambda x, i: F.coalesce((beside(i - 1) == x["h"]) | (beside(i + 1) == x["h"]), F.lit(False)))
        return F.transform(twice, lambda x: x["i"])

    def covered(places: Column) -> Column:
        parts = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(parts, F.lit(0), lambda a, b: a + b)

    words = F.filter(F.split(text, BLANK_RE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD_RE))
    counted = docs.select(
        *[c for c in docs.columns if c != "text"],
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.sort_array(let(words, windows)).alias("windows"),
        ).alias("s"),
    )
    positions = F.sort_array(let(F.col("s.windows"), repeated))
    n_repeat = F.coalesce(let(positions, covered), F.lit(0)).cast("long")
    plain = [f"s.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
    return counted.select(*[c for c in docs.columns if c != "text"], *plain, n_repeat.alias("n_repeat_words"))


_P = range(1, len(FEATURES) + 1)
_PAIRS = [(j, k) for j in _P for k in _P if j <= k]
#: The distance of a document by forward substitution with the factor L of the covariance, L times its transpose.
_SOLVED = ", ".join(
    f"((x{j} - m{j})" + "".join(f" - l{j}{i} * y{i}" for i in _P if i < j) + f") / l{j}{j} AS y{j}" for j in _P
)
_SQUARE = " + ".join(f"y{j} * y{j}" for j in _P)
_MEANS = ", ".join(f"m{j}" for j in _P)
_COVARIANCES = ", ".join(f"c{k}{j}" for j, k in _PAIRS)
_FACTORS = ", ".join(f"l{k}{j}" for j, k in _PAIRS)


def _factored() -> str:
    """The factor of the covariance c, column by column."""
    terms = []
    for j in _P:
        terms.append(f"sqrt(c{j}{j}" + "".join(f" - l{j}{i} * l{j}{i}" for i in _P if i < j) + f") AS l{j}{j}")
        for k in _P:
            if k > j:
                terms.append(f"(c{k}{j}" + "".join(f" - l{k}{i} * l{j}{i}" for i in _P if i < j) + f") / l{j}{j} AS l{k}{j}")
    return ", ".join(terms)


def _starts() -> list[tuple[str, str]]:
    """Per key and start: quartiles of each statistic as the centre, and its interquartile range as the scale."""
    quartile = "min(CASE WHEN j = {j} AND 4 * upto >= {q} * total THEN x END) AS q{j}{q}"
    quartiles = ", ".join(quartile.format(j=j, q=q) for j in _P for q in (1, 2, 3))
    starts = []
    for s, (q, only) in enumerate(STARTS):
        centre = ", ".join(f"CAST(q{j}{q} AS DOUBLE) AS m{j}" for j in _P)
        wide = {j: 1 if only in (0, j) else 1000 for j in _P}
        scale = ", ".join(
            f"{wide[j]}.0e0 * greatest({FEATURES[j - 1][1]}.0e0, 0.7413e0 * (q{j}3 - q{j}1)) AS l{j}{j}"
            if j == k
            else f"0.0e0 AS l{k}{j}"
            for j, k in _PAIRS
        )
        starts.append(f"SELECT k, {s} AS s, {centre}, {scale} FROM {{quartiles}}")
    return [("quartiles", f"SELECT k, {quartiles} FROM {{run}} GROUP BY k"), ("e0", " UNION ALL ".join(starts))]


def _step(step: int, last: bool) -> list[tuple[str, str]]:
    """A concentration step of every key and start: from the estimates e{step - 1} to t (mean, covariance) and e{step}."""
    columns = ", ".join(f"x{j}" for j in _P)
    names = ["n", *[f"s{j}" for j in _P], *[f"q{j}{k}" for j, k in _PAIRS]]
    sums = ", ".join([f"sum(x{j}) AS s{j}" for j in _P] + [f"sum(x{j} * x{k}) AS q{j}{k}" for j, k in _PAIRS])
    running = ", ".join(f"sum(a.{c}) OVER (PARTITION BY k, s ORDER BY c) AS {c}" for c in names)
    mean = ", ".join(f"CAST(s{j} AS DOUBLE) / n AS m{j}" for j in _P)
    factor = REWEIGHT_CONSISTENT if last else CONSISTENT
    cov = ", ".join(
        f"{factor}e0 * (CAST(q{j}{k} AS DOUBLE) / n - m{j} * m{k})"
        + (f" + {FEATURES[j - 1][1] ** 2}.0e0" if j == k else "")
        + f" AS c{k}{j}"
        for j, k in _PAIRS
    )
    near, order = (f"c <= {REWEIGHT_CLASS}", "c DESC") if last else (f"{COVERED[1]} * n >= {COVERED[0]} * total", "c")
    determinant = " * ".join(f"l{j}{j}" for j in _P)
    return [
        (
            f"d{step}",
            f"SELECT k, s, {columns}, {_SOLVED}, CAST(least(floor(32 * sqrt({_SQUARE})), 65536) AS BIGINT) AS c"
            f" FROM {{u}} JOIN {{e{step - 1}}} USING (k)",
        ),
        (f"a{step}", f"SELECT k, s, c, count(*) AS n, {sums} FROM {{d{step}}} GROUP BY k, s, c"),
        (f"r{step}", f"SELECT k, s, c, sum(a.n) OVER (PARTITION BY k, s) AS total, {running} FROM {{a{step}}} a"),
        (f"h{step}", f"SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY {order}) AS place FROM {{r{step}}} WHERE {near}"),
        (f"t{step}", f"SELECT k, s, total, n, {mean}, {cov} FROM {{h{step}}} WHERE place = 1"),
        (f"v{step}", f"SELECT *, {_factored()} FROM {{t{step}}}"),
        (
            f"e{step}",
            f"SELECT k, s, total, {_MEANS}, {_COVARIANCES}, {_FACTORS} FROM {{v{step}}}"
            if step != SEARCH_STEPS
            else f"SELECT * FROM (SELECT k, s, total, {_MEANS}, {_COVARIANCES}, {_FACTORS},"
            f" row_number() OVER (PARTITION BY k ORDER BY {determinant}, s) AS place FROM {{v{step}}}) WHERE place = 1",
        ),
    ]


def _pooled(own: str, wider: str) -> str:
    """Columns of the estimate that own documents and PRIOR ones of the wider level give together. The gap between the
    two means adds nothing to the spread, as a source of a few bad documents would widen itself by it."""
    w = f"(o.total / (o.total + {PRIOR}.0e0))"
    means = [f"{w} * o.m{j} + (1 - {w}) * p.m{j} AS m{j}" for j in _P]
    covs = [f"{w} * o.c{k}{j} + (1 - {w}) * p.c{k}{j} AS c{k}{j}" for j, k in _PAIRS]
    return ", ".join(means + covs) + f" FROM {own} o JOIN {wider} p"


def verdict_steps() -> list[tuple[str, str]]:
    """Named queries, for Spark and DuckDB alike; {name} stands for an earlier one, {stats} for the statistics with lang
    and source. The last adds base_failed and kept to them. Keys k: G and a group, L and a language, or C, the corpus."""
    features = ", ".join(f"CAST(floor({sql}) AS BIGINT) AS x{j}" for j, (sql, _) in enumerate(FEATURES, 1))
    language = "coalesce('=' || lang, '-')"
    columns = ", ".join(f"x{j}" for j in _P)
    last = SEARCH_STEPS + SETTLE_STEPS + 1
    steps = [
        (
            "judged",
            f"SELECT *, 'L' || {language} AS l, 'G' || {language} || chr(31) || coalesce('=' || source, '-') AS g,"
            f" n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM {{stats}}",
        ),
        ("f", f"SELECT *, {features} FROM {{judged}} WHERE NOT base_failed"),
        ("ug", f"SELECT l, g, {columns} FROM {{f}} GROUP BY l, g, {columns}"),
        ("ul", f"SELECT l, {columns} FROM {{ug}} GROUP BY l, {columns}"),
        (
            "u",
            f"SELECT g AS k, {columns} FROM {{ug}} UNION ALL SELECT l AS k, {columns} FROM {{ul}}"
            f" UNION ALL SELECT 'C' AS k, {columns} FROM {{ul}} GROUP BY {columns}",
        ),
        ("long", " UNION ALL ".join(f"SELECT k, {j} AS j, x{j} AS x, count(*) AS n FROM {{u}} GROUP BY k, x{j}" for j in _P)),
        (
            "run",
            "SELECT *, sum(n) OVER (PARTITION BY k, j ORDER BY x) AS upto, sum(n) OVER (PARTITION BY k, j) AS total"
            " FROM {long}",
        ),
        *_starts(),
    ]
    for step in range(1, last + 1):
        steps += _step(step, step == last)
    counts = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    final = f"{{e{last}}}"
    steps += [
        ("levels", "SELECT g, l FROM {ug} GROUP BY g, l"),
        ("pl", f"SELECT o.k AS l, {_pooled(final, final)} ON p.k = substr(o.k, 1, 0) || 'C' WHERE o.k LIKE 'L%'"),
        ("og", f"SELECT l, g, total, {_MEANS}, {_COVARIANCES} FROM {final} JOIN {{levels}} ON k = g"),
        ("pg", f"SELECT o.g, {_pooled('{og}', '{pl}')} ON o.l = p.l"),
        ("vg", f"SELECT *, {_factored()} FROM {{pg}}"),
        ("eg", f"SELECT g, {_MEANS}, {_FACTORS} FROM {{vg}}"),
        ("far", f"SELECT *, {_SOLVED} FROM {{f}} JOIN {{eg}} USING (g)"),
        (
            "verdict",
            f"SELECT {counts}, base_failed, FALSE AS kept FROM {{judged}} WHERE base_failed UNION ALL"
            f" SELECT {counts}, base_failed, {_SQUARE} <= {CUTOFF}e0 AS kept FROM {{far}}",
        ),
    ]
    return steps


def _verdict(stats: DataFrame) -> DataFrame:
    frames = {"stats": stats}
    for name, sql in verdict_steps():
        used = {x: df for x, df in frames.items() if f"{{{x}}}" in sql}
        frames[name] = stats.sparkSession.sql(sql, **used)
        if name == "u":
            frames[name] = materialise(frames[name], "vectors")
        elif name.startswith("e"):
            # a row per key and start; written, as a plan of all steps in one would unfold their terms again and again
            frames[name] = materialise(frames[name], "estimates")
    return frames["verdict"]


#: The statistics in DuckDB's SQL.
STATISTICS_SQL = r"""
numbered AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM numbered),
windows AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
    FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) t(k) GROUP BY row),
stats AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM split LEFT JOIN covered USING (row))"""

_NAMES = {name: name for name, _ in verdict_steps()} | {"stats": "stats"}
ORACLE_SQL = (
    "WITH "
    + ",\n".join([STATISTICS_SQL.strip(), *[f"{name} AS MATERIALIZED ({sql.format(**_NAMES)})" for name, sql in verdict_steps()]])
    + "\nSELECT * FROM verdict"
)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept, one row per row of docs (doc_id, text, lang, source).

    A null or empty text has no word and fails the base rule. A null language or source is a group of its own. Equal
    rows get equal verdicts and count once in the estimate. Groups of a few documents are judged mostly by their
    language; an empty table gives no rows. Other columns are ignored.
    """
    stats = materialise(text_statistics(docs.select("doc_id", "text", "lang", "source")), "text-statistics")
    return _verdict(stats)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge keeps; a row is named by doc_id and the hash of its text, lang and source."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"))
    parts = [F.col("_doc").getField(c) for c in ("doc_id", "text", "lang", "source")]
    named = rows.withColumn("_row", F.xxhash64(*parts))
    judged = named.select(F.col("_row").alias("doc_id"), "_doc.text", "_doc.lang", "_doc.source")
    verdict = _verdict(materialise(text_statistics(judged), "text-statistics")).select("doc_id", "kept")
    # written before it is filtered: a filter on kept would be pushed into the steps and unfold their terms
    kept = materialise(verdict, "verdicts").where("kept")
    return named.join(kept.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_semi").select("_doc.*")
