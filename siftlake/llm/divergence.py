"""How far the sources of a language differ in their terms, by one-hot products of count levels.

A term's p in a (language, source) group depends only on the group and on how often the term occurs there, its count
level. So the distance of two groups, the sum of abs(p - q) over all kept terms of the language, follows from their joint
table: how many terms have level c in the one and level d in the other. The joint tables of all pairs of groups come
from one product: with a 0/1 matrix whose rows are (group, level) and whose columns are terms, rows times transpose
counts the terms that any two (group, level) share. Level 0 has its row too.

The product is exact and goes by blocks. Terms are dealt by hash into blocks of about BLOCK_TERMS; sources by hash into
tiles of about TILE_SOURCES; a task multiplies the rows of two tiles over one block, prices its joint tables in whole
numbers, and passes on one number per pair of sources, added up over the blocks. A source that has no term of a block
is known there by a row of its own, so the absent terms are counted without being listed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import text_batches
from siftlake.session import materialise

#: A kept term occurs in at least so many documents of its language.
LEAST_DOCS = 30
#: p is in parts of SCALE, with PLUS added to every count.
SCALE, PLUS = 1_000_000_000, 5
#: Ranks of the part `term`.
TOP_TERMS = 50
#: Terms of a block and sources of a tile, on average; levels of each side that are multiplied at once.
BLOCK_TERMS, TILE_SOURCES, LEVELS_AT_ONCE = 512, 64, 2_048
#: Distinct terms of all groups that a task adds up before it passes them on.
HELD_TERMS = 300_000

TALLY = "lang string, source string, term string, n long, docs long"
PRICED = "lang string, source_a string, source_b string, value long"

#: ASCII letters in lower case, blanks for the rest of ASCII, and other bytes as they are.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _tally_rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """A row per term of each group, and one without a term for the group itself."""
    for (lang, source), (n, docs) in held.items():
        terms = list(n)
        size = len(terms) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * size, pa.string()),
                pa.array([source] * size, pa.string()),
                pa.array([*terms, None], pa.binary()).cast(pa.string()),
                pa.array([*n.values(), 0], pa.int64()),
                pa.array([*map(docs.__getitem__, terms), 0], pa.int64()),
            ],
            names=[x.split()[0] for x in TALLY.split(", ")],
        )


def term_tallies(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it; a null term stands for the group."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
                n, found = held.setdefault((lang, source), (Counter(), Counter()))
                words = _terms(text.as_py())
                n.update(words)
                found.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from _tally_rows(held)
                held = {}
        yield from _tally_rows(held)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(run, TALLY)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PLUS) / (total + PLUS * terms)), in decimals of 38 digits, so exact."""
    over = (F.lit(SCALE).cast("decimal(10,0)") * (n + PLUS).cast("decimal(19,0)"), (total + PLUS * terms).cast("decimal(19,0)"))
    return F.call_function("div", over[0], F.nullif(over[1], F.lit(0).cast("decimal(19,0)"))).cast("long") + 1


def _levels(rows: dict[str, np.ndarray], side: np.ndarray, sources: list[str], width: int) -> tuple:
    """The (source, level) rows of one tile: the source's number and p of each row, the (row, term) cells that are 1 in
    the one-hot matrix, and the rows of level 0."""
    number = {s: i for i, s in enumerate(sources)}
    mine = np.flatnonzero(side)
    own = np.fromiter((number[s] for s in rows["source"][mine].tolist()), np.int64, len(mine))
    marks = rows["column"][mine] < 0
    keys = np.stack([own, np.where(marks, 0, rows["n"][mine])], 1)
    distinct, first, where = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    where = where.ravel()
    price = rows["p"][mine][first]
    cells = (where[~marks], rows["column"][mine][~marks])
    zero_row = np.searchsorted(distinct[:, 0], np.arange(len(sources)))  # the level 0 of a source is its first row
    has = np.zeros((len(sources), width), bool)
    has[own[~marks], cells[1]] = True
    absent = np.nonzero(~has)
    cells = (np.concatenate([cells[0], zero_row[absent[0]]]), np.concatenate([cells[1], absent[1]]))
    return distinct[:, 0], price, cells, zero_row


def _added(priced: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each owner added up; owner is in ascending order."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.add.reduceat(priced, starts, axis=0), owner[starts]


def _one_hot(cells: tuple[np.ndarray, np.ndarray], begin: int, end: int, width: int) -> np.ndarray:
    inside = (cells[0] >= begin) & (cells[0] < end)
    matrix = np.zeros((end - begin, width), np.float32)  # whole numbers below 2**24 are exact
    matrix[cells[0][inside] - begin, cells[1][inside]] = 1
    return matrix


def price_tiles(rows: dict[str, np.ndarray], terms: int, same: bool) -> Iterator[tuple[str, str, int]]:
    """(source a, source b, value) of every pair with a in the first tile and b in the second, over one block of terms.

    rows holds source, side (0 or 1, its tile; all 0 where a tile meets itself, which is same), term (None: the row of
    the source, whose p is that of level 0), n and p. terms is how many terms the block has in its whole language.
    """
    sides = [rows["side"] == 0, rows["side"] == (0 if same else 1)]
    names = [sorted(set(rows["source"][s].tolist())) for s in sides]
    if not all(names):
        return
    listed = rows["term"].tolist()
    known = {t: i for i, t in enumerate(dict.fromkeys(t for t in listed if t is not None))}
    rows = rows | {"column": np.fromiter((-1 if t is None else known[t] for t in listed), np.int64, len(listed))}
    width = len(known)
    left, right = (_levels(rows, s, n, width) for s, n in zip(sides, names, strict=True))
    value = np.zeros((len(names[0]), len(names[1])), np.int64)
    for b in range(0, len(left[0]), LEVELS_AT_ONCE):
        e = min(b + LEVELS_AT_ONCE, len(left[0]))
        first = _one_hot(left[2], b, e, width)
        for c in range(0, len(right[0]), LEVELS_AT_ONCE):
            f = min(c + LEVELS_AT_ONCE, len(right[0]))
            joint = (first @ _one_hot(right[2], c, f, width).T).astype(np.int64)
            zeros = [z[(z >= lo) & (z < hi)] - lo for z, lo, hi in ((left[3], b, e), (right[3], c, f))]
            joint[np.ix_(*zeros)] += terms - width  # terms of the block that neither tile has
            priced = joint * np.abs(left[1][b:e, None] - right[1][None, c:f])
            by_left, at = _added(priced, left[0][b:e])
            by_both, to = _added(by_left.T, right[0][c:f])
            value[np.ix_(at, to)] += by_both.T
    for i, a in enumerate(names[0]):
        for j, b in enumerate(names[1]):
            if a < b or not same:
                yield a, b, int(value[i, j])


def _priced_block(table: pa.Table) -> pa.Table:
    rows = {c: table.column(c).to_numpy() for c in ("source", "side", "term", "n", "p")}
    lang, terms, low, high = (table.column(c)[0].as_py() for c in ("lang", "block_terms", "low", "high"))
    found = list(price_tiles(rows, terms, low == high))
    a, b, value = zip(*found, strict=True) if found else ([], [], [])
    return pa.table(
        {
            "lang": pa.array([lang] * len(found), pa.string()),
            "source_a": pa.array(a, pa.string()),
            "source_b": pa.array(b, pa.string()),
            "value": pa.array(value, pa.int64()),
        }
    )


def pair_values(counts: DataFrame, groups: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, source_a, source_b, value) for every two sources of a language, once.

    counts: (lang, source, term, n, p) of kept terms; groups: (lang, source, p0, sources, terms), p0 the p of level 0;
    vocabulary: (lang, term) of all kept terms, with terms, how many they are.
    """
    block = F.pmod(F.xxhash64("term"), F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK_TERMS))).cast("long")
    tiles = F.greatest(F.lit(1), F.ceil(F.col("sources") / TILE_SOURCES)).cast("long")
    tile = F.pmod(F.xxhash64("source"), tiles)
    sizes = vocabulary.select("lang", block.alias("block")).groupBy("lang", "block").agg(F.count("*").alias("block_terms"))
    known = groups.select("lang", "source", "p0", "sources", tile.alias("tile"), tiles.alias("tiles"), "terms")
    cells = counts.join(known.drop("p0"), ["lang", "source"]).withColumn("block", block)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK_TERMS)).cast("long")
    marks = known.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    marks = marks.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"),
        F.col("p0").alias("p"), "tile", "tiles", "block",
    )
    every = cells.select(marks.columns).unionByName(marks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    met = every.withColumn("other", other).select(
        "lang", "source", "term", "n", "p", "block",
        F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        (F.col("tile") > F.col("other")).cast("int").alias("side"),
    )
    met = met.join(sizes, ["lang", "block"], "left").withColumn("block_terms", F.coalesce("block_terms", F.lit(0)))
    priced = met.groupBy("lang", "block", "low", "high").applyInArrow(_priced_block, PRICED)
    return priced.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of an audit of sources, language by language.

    Part `pair`: for each other source of the language the sum of abs(p - q) over all kept terms, all ranks. Part
    `term`: the kept terms that the group has and whose p exceeds the language's, up to rank top, with the difference.
    Ranks go by value, the largest first, then by the item's UTF-8 bytes.

    Null text, lang and source are empty; a repeated row counts again; doc_id and other columns are ignored. A group
    without terms takes part with the p of level 0; a language without kept terms has pairs of value 0; a language of
    one source has no pairs; an empty table gives no rows.
    """
    tallies = materialise(term_tallies(docs), "term-tallies")
    found = tallies.where("term IS NOT NULL")
    vocabulary = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    vocabulary = materialise(vocabulary.where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    kept = found.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    kept = materialise(kept, "kept-counts")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    langs = materialise(langs, "kept-terms-by-lang")
    groups = tallies.where("term IS NULL").select("lang", "source")
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").join(groups.groupBy("lang").agg(F.count("*").alias("sources")), "lang")
    groups = groups.na.fill(0, ["total", "terms", "lang_total"])
    groups = groups.withColumn("p0", F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(1)))
    groups = materialise(groups, "divergence-groups")
    sized = kept.join(groups.drop("p0", "sources"), ["lang", "source"])
    sized = sized.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    sized = materialise(sized.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))), "term-shares")

    once = pair_values(
        sized.select("lang", "source", "term", "n", "p"), groups, vocabulary.join(langs.select("lang", "terms"), "lang")
    )
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
                   F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    pairs = materialise(once, "pair-values").select("lang", F.explode(both).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    above = sized.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(above.withColumn("rank", place).where(F.col("rank") <= top))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word FROM d),
t AS (SELECT k, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
  1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PLUS})) // (s.n + {PLUS} * l.v) AS p,
  1 + ({SCALE}::HUGEINT * (v.n + {PLUS})) // (l.n + {PLUS} * l.v) AS q
  FROM g JOIN v USING (lang) JOIN l USING (lang) JOIN s USING (lang, source)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
