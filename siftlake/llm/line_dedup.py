"""Line dedup with an edit-distance join by segment partition. DataFrame functions only.

Lines are the parts of a text between line feeds. Two lines are near-equal if their edit distance is at most the bound
that belongs to the length of the shorter one. Near-equality, followed transitively, makes classes of lines. A class
keeps its first line in the document with the smallest doc_id that has one; its other occurrences in the corpus go.

A line of bound t is cut into t + 1 segments. t edits leave one segment whole, so a near-equal line holds one of them
at nearly the same place; which places can occur follows from the difference in length and from the edits left on
either side. Distinct lines therefore meet on hashes of (length, number of the segment, its characters). What meets is
verified with the diagonals of the band as the bits of a word, one word per error level.

A segment that very many lines of one length share says little. Lines that meet in such a crowded segment must share a
second one in what is left of them without the first, by the same argument, and only then are they compared.

Lines that meet become a pair only if the counts of a few letters allow it: an edit adds one character at most and
takes one away at most, so no pair within the bound is lost. Lines that have met are judged by the parities of all
their characters too, before they are compared. Copies of one text with some words changed share segments with one
another and mostly differ in these.

Distinct lines are told apart by a 64-bit hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import WORD_RE, let, settle
from siftlake.llm.components import components

#: (characters, edits): lines of at least so many characters may differ by so many edits; shorter ones must be equal.
BOUNDS = ((24, 1), (96, 2))
#: Lines with the same segment before a second one is asked for.
CROWDED = 100

#: Letters that are counted in each line, modulo 32. Any would be right; frequent ones tell more lines apart.
LETTERS = "eatnio"

Bounds = tuple[tuple[int, int], ...]


def _bound(length: Column, bounds: Bounds) -> Column:
    chosen = F.lit(0)
    for least, t in sorted(bounds):
        chosen = F.when(length >= least, t).otherwise(chosen)
    return chosen


def places(t: int) -> list[tuple[int, int, int]]:
    """(difference in length, segment, shift of its place) at which a line may hold a segment of one within t edits.

    Of two lines of one length with one insertion and one deletion between them, that finds the other which has the
    added character first. Up to three edits hold no second such pair, so its shifts are never negative.
    """
    return [
        (d, j, shift)
        for d in range(t + 1)
        for j in range(t + 1)
        for shift in range(max(-j, d - (t - j)), min(j, d + (t - j)) + 1)
        if d or shift >= 0 or t > 3
    ]


def _segment(length: Column, t: Column, j: Column) -> tuple[Column, Column]:
    """Start, from 0, and length of segment j of t + 1 in a line of that length; the last ones are longer by one."""
    size, over = F.floor(length / (t + 1)), length % (t + 1) + (j - t - 1)
    return (size * j + F.greatest(F.lit(0), over)).cast("int"), (size + F.when(over >= 0, 1).otherwise(0)).cast("int")


def _choices(bounds: Bounds) -> list[tuple[int, int, int, int]]:
    """(bound, difference, segment, shift) of every key that a line may have."""
    return [(t, *place) for t in sorted({t for _, t in bounds}) for place in places(t)]


def _exact(choice: tuple[int, int, int, int]) -> bool:
    """Whether the key is of a segment of the line itself, by which others find it."""
    return choice[1] == choice[3] == 0


def _table(bounds: Bounds, own: bool = False) -> Column:
    """A constant array of all choices, or of those that are exact, as structs."""
    names = ("choice", "t", "d", "j", "shift", "exact")
    rows = [(i, *c, _exact(c)) for i, c in enumerate(_choices(bounds)) if _exact(c) or not own]
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row, strict=True)]) for row in rows])


def _key(line: Column, length: Column, c: Column, *salt: Column) -> Column:
    """The key of choice c. Where each character is a byte, none is stepped over to get to the segment."""
    of = length - c["d"]
    start, size = _segment(of, c["t"], c["j"])
    start = start + c["shift"] + 1
    by_char = F.substring(line, start, size).cast("binary")
    part = F.when(F.octet_length(line) == length, F.substring(line.cast("binary"), start, size)).otherwise(by_char)
    return F.xxhash64(*salt, of, c["j"], part)


def letter_counts(line: Column) -> Column:
    """How often each of LETTERS is in a line, modulo 32, side by side in an int."""
    packed = F.lit(0)
    for i, letter in enumerate(LETTERS):
        rest = F.replace(line, F.lit(letter), F.lit(""))
        count = (F.octet_length(line) - F.octet_length(rest)).bitwiseAND(F.lit(31))
        packed, line = packed.bitwiseOR(F.shiftleft(count, 5 * i)), rest
    return packed


def _counts_allow(a: Column, b: Column, t: int) -> Column:
    """Whether letter_counts a and b fit lines within t edits; t is below 16."""
    more, fewer = F.lit(0), F.lit(0)
    for i in range(len(LETTERS)):
        of = lambda x: F.shiftright(x, 5 * i).bitwiseAND(F.lit(31))  # noqa: B023, E731
        differ = (of(a) - of(b) + 16).bitwiseAND(F.lit(31)) - 16
        more, fewer = more + F.greatest(differ, F.lit(0)), fewer + F.greatest(-differ, F.lit(0))
    return (more <= t) & (fewer <= t)


def char_parities(line: Column) -> Column:
    """Bit i is set if an odd number of the line's characters have code point i modulo 64."""
    flip = lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c).bitwiseAND(F.lit(63))))
    return F.aggregate(F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, "")), F.lit(0).cast("long"), flip)


def _parities_allow(a: Column, b: Column, t: int) -> Column:
    """Whether char_parities a and b fit lines within t edits, each of which flips two bits at most."""
    return F.bit_count(a.bitwiseXOR(b)) <= 2 * t


def line_keys(line: Column, bounds: Bounds) -> list[Column]:
    """What the keys of a line are made of: line, null where it is too short for any, its length and letters, its letter_counts."""
    length = F.length(line)
    usable = F.when(length >= min(least for least, _ in bounds), line)
    return [usable.alias("line"), length.alias("length"), letter_counts(line).alias("letters")]


def _first_keys(keyed: DataFrame, bounds: Bounds, own: bool = False) -> DataFrame:
    """(h, letters, key, exact, choice), a row for each key of each line, or for those of its own segments.

    The choices are rows, and one expression makes the key of each: an expression for every choice, side by side, is
    more than the JVM compiles as one method.
    """
    rows = keyed.where("line is not null").select("h", "letters", "line", "length", F.explode(_table(bounds, own)).alias("c"))
    fit = rows.where(_bound(F.col("length") - F.col("c.d"), bounds) == F.col("c.t"))
    return fit.select("h", "letters", _key(F.col("line"), F.col("length"), F.col("c")).alias("key"), "c.exact", "c.choice")


def _second_keys(crowded: DataFrame, bounds: Bounds) -> DataFrame:
    """From (h, letters, key, exact, choice, line, parities): the keys of crowded rows, each joined with a segment of the rest of the line."""
    cut, first = crowded.withColumn("first", F.get(_table(bounds), F.col("choice"))), F.col("first")
    start, size = _segment(F.length("line") - first["d"], first["t"], first["j"])
    cut = cut.withColumns({"begin": start + first["shift"], "size": size})
    rest = F.concat(F.expr("substring(line, 1, begin)"), F.expr("substring(line, begin + size + 1)"))
    rows = cut.select("h", "letters", "parities", "key", "first", rest.alias("rest"))
    rows = rows.withColumn("length", F.length("rest")).withColumn("c", F.explode(_table(bounds)))
    same = rows.where("c.t = first.t and c.d = first.d")  # the same bound and difference in length
    key = _key(F.col("rest"), F.col("length"), F.col("c"), F.col("key"))
    return same.select("h", "letters", "parities", key.alias("key"), F.expr("first.exact and c.exact").alias("exact"))


def edits_within(a: Column, b: Column, t: int) -> Column:
    """The edit distance of two strings if it is at most t, else null.

    Bit t + k of level e says that some prefix of a turns into the prefix of b longer by k characters with e edits at
    most; the levels lie side by side in one number, which a character of a carries on to the next.
    """
    width, band = 2 * t + 2, (1 << (2 * t + 1)) - 1
    long = lambda x: F.lit(x).cast("long")
    begin = sum(sum(1 << (t + k) for k in range(e + 1)) << e * width for e in range(t + 1))

    def level(state: Column, e: int) -> Column:
        return F.shiftrightunsigned(state, e * width).bitwiseAND(long(band))

    def advance(state: Column, same: Column) -> Column:
        now = [level(state, e) for e in range(t + 1)]
        result = packed = now[0].bitwiseAND(same)
        for e in range(1, t + 1):
            kept = now[e].bitwiseAND(same).bitwiseOR(now[e - 1]).bitwiseOR(F.shiftrightunsigned(now[e - 1], 1))
            result = kept.bitwiseOR(F.shiftleft(result, 1)).bitwiseAND(long(band))
            packed = packed.bitwiseOR(F.shiftleft(result, e * width))
        return packed

    def over(chars: Column) -> Column:
        equal = lambda c, i: sum(
            (F.when(F.get(chars, i + (k - t)) == c, long(1 << k)).otherwise(long(0)) for k in range(1, 2 * t + 1)),
            F.when(F.get(chars, i - t) == c, long(1)).otherwise(long(0)),
        )
        masks = F.transform(F.when(a == "", F.array().cast("array<string>")).otherwise(F.split(a, "")), equal)
        return F.aggregate(masks, long(begin), advance)

    target = F.length(b) - F.length(a) + t
    bit = F.when(target.between(0, 2 * t), F.pow(F.lit(2), target)).otherwise(0).cast("long")

    def distance(state: Column) -> Column:
        least = F.lit(None).cast("int")
        for e in range(t, -1, -1):
            least = F.when(level(state, e).bitwiseAND(bit) != 0, e).otherwise(least)
        return least

    return let(let(F.when(b == "", F.array().cast("array<string>")).otherwise(F.split(b, "")), over), distance)


def line_links(keyed: DataFrame, lines: DataFrame, bounds: Bounds = BOUNDS, crowd: int = CROWDED) -> DataFrame:
    """(a, b): the hashes of near-equal distinct lines.

    keyed has a row (h, *line_keys) for each distinct line; lines has (h, line), and may repeat.
    """
    keys, own = _first_keys(keyed, bounds), _first_keys(keyed, bounds, own=True)
    most = max(t for _, t in bounds)
    crowds = settle(own.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowds")
    if crowds.isEmpty():
        pairs = settle(_meet(own, keys, most).distinct(), "line-pairs")
        met = pairs.select(F.explode(F.array("a", "b")).alias("h"))
    else:
        crowded = settle(keys.join(crowds, "key", "left_semi"), "crowded-segments")
        pairs = settle(_meet(*(k.join(crowds, "key", "left_anti") for k in (own, keys)), most).distinct(), "line-pairs")
        met = pairs.select(F.explode(F.array("a", "b")).alias("h")).unionByName(crowded.select("h"))
    # a merge join at every size: the lines met grow with the corpus, so their broadcast would only suit small ones
    wanted = lines.join(met.distinct().hint("merge"), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    wanted = settle(wanted.withColumn("parities", char_parities(F.col("line"))), "line-texts")
    if not crowds.isEmpty():
        second = settle(_second_keys(crowded.join(wanted, "h"), bounds), "second-segments")
        pairs = pairs.unionByName(_meet(second.where("exact"), second, most)).distinct()
    left = wanted.select(F.col("h").alias("a"), F.col("line").alias("la"), F.col("parities").alias("pa"))
    right = wanted.select(F.col("h").alias("b"), F.col("line").alias("lb"), F.col("parities").alias("pb"))
    shorter = _bound(F.least(F.length("la"), F.length("lb")), bounds)
    near = edits_within(F.col("la"), F.col("lb"), most)
    allowed = _parities_allow(F.col("pa"), F.col("pb"), most)
    return pairs.join(left, "a").join(right, "b").where(allowed & (near <= shorter)).select("a", "b")


def _meet(own: DataFrame, keys: DataFrame, t: int) -> DataFrame:
    """(a, b): different lines of one key, whose counts and parities, where there are any, allow t edits."""
    tests = {c: f for c, f in (("letters", _counts_allow), ("parities", _parities_allow)) if c in keys.columns}
    own = own.select("key", F.col("h").alias("x"), *[F.col(c).alias(f"{c}_x") for c in tests])
    met = F.col("x") != F.col("h")
    for c, allow in tests.items():
        met = met & allow(F.col(f"{c}_x"), F.col(c), t)
    pairs = own.join(keys.select("key", "h", *tests), "key").where(met)
    return pairs.select(F.least("x", "h").alias("a"), F.greatest("x", "h").alias("b"))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame) -> DataFrame:
    """_doc, the whole row as a struct, and what names it: doc_id, null as the smallest number, and a hash of the text."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"))
    named = {"_k": F.coalesce("_doc.doc_id", F.lit(-(1 << 63))), "_th": F.xxhash64("_doc.text")}
    return rows.withColumns(named)


def repeated_lines(docs: DataFrame, bounds: Bounds = BOUNDS, crowd: int = CROWDED) -> DataFrame:
    """(_k, _th, _gone): the numbers, from 0, of the lines to take out of each row of docs that has such lines."""
    own = docs.select("doc_id", "text")
    lines = _keyed(own).select("_k", "_th", F.posexplode(_split(F.col("_doc.text"))).alias("pos", "line"))
    lines = lines.where(F.col("line").rlike(WORD_RE)).withColumn("h", F.xxhash64("line"))
    seen = settle(lines.select("_k", "_th", "pos", "h"), "lines")
    counted = settle(seen.groupBy("h").agg(F.min("_k").alias("k"), F.count("*").alias("n")), "distinct-lines")
    if bounds:
        long = lines.where(F.length("line") >= min(least for least, _ in bounds))
        texts = long.groupBy("h").agg(F.first("line").alias("line"))
        keyed = settle(texts.select("h", *line_keys(F.col("line"), bounds)), "distinct-texts")
        links = line_links(keyed, keyed.select("h", "line"), bounds, crowd)
        roots = components(settle(links, "line-links")).withColumnRenamed("node", "h")
    else:
        roots = counted.select("h", F.col("h").alias("root")).limit(0)
    rooted = counted.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    classes = rooted.groupBy("root").agg(F.min("k").alias("first_k"), F.sum("n").alias("total")).where("total > 1")
    repeated = settle(rooted.select("h", "root").join(classes.drop("total"), "root"), "repeated-lines")
    entry = F.struct("root", "pos", (F.col("first_k") == F.col("_k")).alias("first"))
    per_row = seen.join(repeated, "h").groupBy("_k", "_th").agg(F.sort_array(F.collect_set(entry)).alias("own"))

    def later(own: Column) -> Column:
        before = lambda i: F.coalesce(F.get(own, i - 1)["root"], F.lit(None).cast("long"))
        return F.filter(own, lambda x, i: ~x["first"] | ((i > 0) & before(i).eqNullSafe(x["root"])))

    gone = F.transform(let(F.col("own"), later), lambda x: x["pos"])
    return per_row.select("_k", "_th", gone.alias("_gone")).where(F.size("_gone") > 0)


def drop_repeated_lines(docs: DataFrame, bounds: Bounds = BOUNDS, crowd: int = CROWDED) -> DataFrame:
    """docs with the repeated lines taken out of text, and two more columns: n_lines and n_removed.

    Only lines with a word count as repeated; others stay where they are, as do all rows, even those left without a
    line. A null text stays null and has no line. Rows equal in doc_id and text are taken as one document and get the
    same result; rows of one doc_id and different texts are each searched, and each keep a class's first line. A null
    doc_id comes before all others. Other columns are passed on, but for two of the new columns' names; an empty table
    stays empty.
    """
    gone = repeated_lines(docs, bounds, crowd)
    found = _keyed(docs).join(gone, ["_k", "_th"], "left")

    def kept(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    text = F.col("_doc.text")
    new_text = F.when(F.col("_gone").isNull(), text).otherwise(let(_split(text), kept))
    passed = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    words = F.filter(_split(text), lambda line: line.rlike(WORD_RE))
    return found.select(
        *[(new_text if c == "text" else F.col("_doc").getField(c)).alias(c) for c in passed],
        F.size(words).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """Per document: lines with a word, those taken out, and the SHA-256 of the text that is left."""
    done = drop_repeated_lines(docs.select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))
