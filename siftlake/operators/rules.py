"""Detection rules given as tables, matched in one pass by an inverted index from their literals.

A rule has named selections and a condition over them. A selection holds on an event if all its groups do; a group is
one field with one modifier and a list of values, of which one must match, or all. The condition is a tree of names,
``("and", ...)``, ``("or", ...)``, ``("not", x)`` and ``("of", n, ...)``, kept as terms: a rule fires if the selections
that some term needs hold and none that it forbids does. As in the rule format, text is compared without case, a field
that is NULL matches nothing, and what does not match is negated as false.

Equal groups, selections and whole rules are told by digests of what they ask for and judged once, whatever their names.
Values meet literals on keys: equal text, the longest beginning, end or part of it that a literal must have. Values that
no test tells apart are one class, and events are counted by the classes of their fields, so the work grows with what
the rules can tell apart and not with rules times events. Thousands of rules are rows of joins and not columns of a plan.
Of a selection the group that fewest counted events match finds candidates; the others are looked up for these alone.
Events on which no selection of a rule holds are counted as the rest, for rules that fire on them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.session import materialise

TESTS = "rule string, selection string, field string, modifier string, all_of boolean, value string"
TERMS = "array<struct<need: array<string>, forbid: array<string>>>"
CONDITIONS = f"rule string, tags string, terms {TERMS}"
EQUAL, PARTS, BOUNDS = ("",), ("contains", "startswith", "endswith"), ("gt", "gte", "lt", "lte")
#: Letters of the keys by which parts of text are looked up: a literal uses the longest that it has.
GRAMS = (1, 2, 3, 6, 12)

Terms = list[tuple[list[str], list[str]]]


def terms_of(tree: str | tuple, holds: bool = True) -> Terms:
    """The terms, (needed, forbidden) selections, under which a condition tree is true, or false."""
    if isinstance(tree, str):
        return [([tree], []) if holds else ([], [tree])]
    kind, parts = tree[0], list(tree[1:])
    if kind == "not":
        return terms_of(parts[0], not holds)
    if kind == "of":
        n, parts = parts[0], parts[1:]
        # fewer than n hold if some len - n + 1 of them do not
        size = n if holds else len(parts) - n + 1
        if size <= 0:
            return [([], [])]
        return _distinct(t for own in combinations(parts, size) for t in _joined([terms_of(p, holds) for p in own]))
    if kind not in ("and", "or"):
        raise ValueError(f"unknown condition {kind}")
    each = [terms_of(p, holds) for p in parts]
    return _joined(each) if (kind == "and") == holds else _distinct(t for own in each for t in own)


def _joined(parts: list[Terms]) -> Terms:
    found: Terms = [([], [])]
    for own in parts:
        found = [(sorted({*a, *c}), sorted({*b, *d})) for a, b in found for c, d in own]
    return _distinct((a, b) for a, b in found if not set(a) & set(b))


def _distinct(terms) -> Terms:
    return [(list(a), list(b)) for a, b in dict.fromkeys((tuple(a), tuple(b)) for a, b in terms)]


def _kind(modifier: Column) -> Column:
    return F.when(modifier.isin(*EQUAL), "eq").when(modifier.isin(*PARTS), modifier).when(modifier.isin(*BOUNDS), "bound")


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(",", *parts), 256)


def _matches(value: Column, modifier: Column, literal: Column) -> Column:
    number, limit = value.try_cast("decimal(38,9)"), literal.try_cast("decimal(38,9)")
    return (
        F.when(modifier == "", value == literal)
        .when(modifier == "contains", F.contains(value, literal))
        .when(modifier == "startswith", F.startswith(value, literal))
        .when(modifier == "endswith", F.endswith(value, literal))
        .when(modifier == "gt", number > limit)
        .when(modifier == "gte", number >= limit)
        .when(modifier == "lt", number < limit)
        .when(modifier == "lte", number <= limit)
    )


def _literal_key(kind: Column, literal: Column) -> Column:
    """The key of a literal: itself, the letters that a part of text must have, or none."""
    size = F.lit(0)
    for n in GRAMS:
        size = F.when(F.length(literal) >= n, n).otherwise(size)
    first = F.substring(literal, F.lit(1), size)
    return (
        F.when(kind == "eq", literal).when(kind.isin("contains", "startswith"), first)
        .when(kind == "endswith", F.right(literal, size)).otherwise("")
    )


def _keys_of(value: Column, kind: str, size: int) -> Column:
    """The keys of one kind and size in a value that has so many letters."""
    if kind == "eq":
        keys = F.array(value)
    elif kind == "contains" and size:
        starts = F.sequence(F.lit(1), F.greatest(F.length(value) - size + 1, F.lit(1)))
        keys = F.array_distinct(F.transform(starts, lambda i: F.substring(value, i, F.lit(size))))
    elif kind == "endswith":
        keys = F.array(F.right(value, F.lit(size)))
    else:
        keys = F.array(F.substring(value, 1, size))
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))


def _value_keys(values: DataFrame, in_use: dict[tuple[str, int], list[str]]) -> DataFrame:
    """The keys by which each value may be found, of the kinds and sizes that tests of its field use."""
    value, none = F.col("value"), F.array().cast("array<struct<kind: string, key: string>>")
    each = [
        F.when(F.col("field").isin(*fields) & (F.length(value) >= size), _keys_of(value, kind, size)).otherwise(none)
        for (kind, size), fields in in_use.items()
    ]
    return values.select("field", "value", F.inline(F.concat(none, *each)))


def _rules_by_content(listed: DataFrame, conditions: DataFrame) -> DataFrame:
    """(rule, tags, shape, sids, terms, selections, on_none) of every row of conditions; shape is NULL if it does not compile.

    A selection has its groups and a digest of them as its sid, sids are the rule's own in order, terms name them by their
    place in it, and shape is the digest of both. on_none is whether the rule fires where no selection holds. The tables
    are dealt by rule once and merged: a file of a million rules is small enough to mislead the size check of a broadcast.
    """
    groups = listed.repartition("rule").groupBy("rule", "selection", "field", "modifier", "kind", "all_of").agg(
        F.sort_array(F.collect_set("literal")).alias("literals"), F.bool_and("usable").alias("usable")
    )
    asks = _digest(F.sha2("field", 256), F.col("modifier"), F.col("all_of").cast("string"), F.transform("literals", lambda x: F.sha2(x, 256)))
    group = F.struct(asks.alias("gid"), "field", "modifier", "kind", "all_of", "literals")
    selections = groups.groupBy("rule", "selection").agg(
        F.sort_array(F.collect_list(group)).alias("groups"), F.bool_and("usable").alias("usable")
    )
    selections, named = selections.withColumn("sid", _digest(F.col("groups.gid"))), F.col("selection").isNotNull()
    by_rule = selections.groupBy("rule").agg(
        F.collect_list(F.when(named, F.struct("selection", "sid", "groups"))).alias("own"), F.bool_and("usable").alias("usable")
    )
    rules = conditions.join(by_rule.hint("merge"), "rule", "left")
    none = F.array().cast("array<string>")
    rules = rules.withColumn("ids", F.map_from_arrays(F.col("own.selection"), F.col("own.sid")))
    rules = rules.withColumn("sids", F.coalesce(F.array_sort(F.array_distinct("own.sid")), none))
    names = F.flatten(F.transform("terms", lambda t: F.coalesce(F.concat(t["need"], t["forbid"]), none)))
    unknown = F.size(F.array_except(F.coalesce(names, none), F.coalesce(F.map_keys("ids"), none))) > 0
    compiled = F.coalesce("usable", F.lit(True)) & ~unknown
    place = lambda n: F.array_position("sids", F.try_element_at("ids", n))
    places = lambda t: F.struct(F.transform(t["need"], place).alias("need"), F.transform(t["forbid"], place).alias("forbid"))
    rules = rules.withColumn("compiled", compiled)
    content = F.array_distinct(F.transform("own", lambda x: F.struct(x["sid"].alias("sid"), x["groups"].alias("groups"))))
    rules = rules.withColumn("terms", F.when(F.col("compiled"), F.transform("terms", places)))
    shape = F.when(F.col("compiled"), F.sha2(F.to_json(F.struct("sids", "terms")), 256))
    on_none = F.exists("terms", lambda t: F.size(t["need"]) == 0)
    return rules.select("rule", "tags", shape.alias("shape"), "sids", "terms", content.alias("selections"), on_none.alias("on_none"))


def _numbered(df: DataFrame, key: str, number: str, label: str) -> DataFrame:
    """The rows of df, one per key, with a number."""
    return materialise(df.dropDuplicates([key]).withColumn(number, F.monotonically_increasing_id()), label)


def rule_matches(df: DataFrame, tests: DataFrame, conditions: DataFrame) -> DataFrame:
    """(rule, tags, compiled, matches) of every row of conditions: events of df on which the rule fires.

    tests has the columns of TESTS, conditions those of CONDITIONS, one row per rule. A rule that asks for a field that
    df lacks, an unknown modifier, or a selection without tests, is not compiled and has no count, never a zero.
    """
    kind = _kind(F.col("modifier"))
    usable = F.col("field").isin(*df.columns) & kind.isNotNull() & F.col("value").isNotNull()
    listed = tests.select(
        "rule", "selection", "field", "modifier", F.coalesce("all_of", F.lit(False)).alias("all_of"),
        F.lower("value").alias("literal"), kind.alias("kind"), F.coalesce(usable, F.lit(False)).alias("usable"),
    )
    rules = materialise(_rules_by_content(listed, conditions), "rules")
    whole = rules.filter("shape IS NOT NULL")
    shapes = _numbered(whole.select("shape", "sids", "terms", "selections"), "shape", "h", "rule-shapes")
    selections = _numbered(shapes.select(F.inline("selections")), "sid", "s", "rule-selections")
    groups = _numbered(selections.select(F.inline("groups")), "gid", "g", "rule-groups")
    tests_of = groups.select("g", "field", "modifier", "kind", F.explode("literals").alias("literal"))
    texts = tests_of.select("field", "modifier", "kind", "literal").distinct()
    texts = texts.withColumn("key", _literal_key(F.col("kind"), F.col("literal"))).withColumn("test", F.monotonically_increasing_id())
    texts = materialise(texts, "rule-tests")
    # a row per column of df, kind of test and size of key
    size = F.when(F.col("kind") == "eq", 0).otherwise(F.length("key")).alias("size")
    in_use: dict[tuple[str, int], list[str]] = {}
    for r in texts.select("field", "kind", size).distinct().collect():
        in_use.setdefault((r["kind"], r["size"]), []).append(r["field"])
    fields = sorted({f for own in in_use.values() for f in own})

    combos = df.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")) if fields else df.agg(F.count(F.lit(1)).alias("n"))
    combos = materialise(combos.withColumn("row", F.monotonically_increasing_id()), "rule-events")
    cell = lambda f: F.struct(F.lit(f).alias("field"), F.lower(F.col(f"`{f}`").cast("string")).alias("value"))
    none = F.array().cast("array<struct<field: string, value: string>>")
    cells = combos.select("row", "n", F.inline(F.array(*map(cell, fields)) if fields else none)).filter("value IS NOT NULL")

    keyed = _value_keys(cells.select("field", "value").distinct(), in_use)
    hits = keyed.join(texts, ["field", "kind", "key"]).filter(_matches(F.col("value"), F.col("modifier"), F.col("literal")))
    values = materialise(hits.groupBy("field", "value").agg(F.sort_array(F.collect_set("test")).alias("tests")), "rule-values")
    classes = materialise(values.select("field", "tests").distinct().withColumn("class", F.monotonically_increasing_id()), "rule-classes")
    values = values.join(classes, ["field", "tests"]).select("field", "value", "class")
    rows = cells.join(values, ["field", "value"]).groupBy("row", "n").agg(F.sort_array(F.collect_list("class")).alias("classes"))
    rows = rows.groupBy("classes").agg(F.sum("n").alias("n")).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "rule-rows")
    cells = rows.select("row", F.explode("classes").alias("class")).join(classes.select("class", "field"), "class")

    asked_by = tests_of.join(texts.drop("key"), ["field", "modifier", "kind", "literal"]).select("g", "test")
    needed = groups.select("g", F.when(F.col("all_of"), F.size("literals")).otherwise(1).alias("need"))
    found = classes.select("class", F.explode("tests").alias("test")).join(asked_by, "test")
    found = found.groupBy("class", "g").agg(F.count(F.lit(1)).alias("m")).join(needed, "g").filter("m >= need").select("class", "g")
    found = materialise(found, "rule-found")

    met = found.join(cells.groupBy("class").agg(F.count(F.lit(1)).alias("n_rows")), "class").groupBy("g").agg(F.sum("n_rows").alias("n_rows"))
    parts = selections.select("s", F.explode("groups.gid").alias("gid")).join(groups.select("gid", "g", "field"), "gid").drop("gid")
    parts = parts.join(met, "g", "left").na.fill(0, ["n_rows"])
    anchor = F.min_by("g", F.struct("n_rows", "g")).alias("anchor")
    anchors = parts.groupBy("s").agg(anchor, F.count(F.lit(1)).alias("n_groups"))
    by_anchor = found.join(anchors, F.col("g") == F.col("anchor")).select("class", "s", "n_groups")
    candidates = materialise(cells.join(by_anchor, "class").select("row", "s", "n_groups"), "rule-candidates")
    rest = parts.join(anchors, "s").filter(F.col("g") != F.col("anchor")).select("s", "g", "field")
    asked = candidates.filter("n_groups > 1").join(rest, "s")
    answered = asked.join(cells, ["row", "field"]).join(found, ["class", "g"], "left_semi")
    others = answered.groupBy("row", "s", "n_groups").agg(F.count(F.lit(1)).alias("m")).filter("m = n_groups - 1")
    held = candidates.filter("n_groups = 1").select("row", "s").unionByName(others.select("row", "s"))

    places = shapes.select("h", F.posexplode("sids").alias("place", "sid")).join(selections.select("sid", "s"), "sid")
    per = held.join(places.select("h", "s", (F.col("place") + 1).cast("bigint").alias("place")), "s")
    per = per.groupBy("row", "h").agg(F.collect_set("place").alias("held"))
    per = per.join(shapes.select("h", "terms"), "h").join(rows.select("row", "n"), "row")
    met_term = lambda t: (F.size(F.array_except(t["need"], F.col("held"))) == 0) & ~F.arrays_overlap(t["forbid"], F.col("held"))
    counted = per.withColumn("fires", F.exists("terms", met_term)).groupBy("h").agg(
        F.sum("n").alias("n_held"), F.coalesce(F.sum(F.when(F.col("fires"), F.col("n"))), F.lit(0)).alias("n_fired")
    )
    total = combos.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = shapes.select("shape", "h").join(counted, "h").drop("h")
    judged = whole.select("rule", "shape", "on_none").join(counted, "shape", "left").na.fill(0, ["n_held", "n_fired"])
    # rows of conditions that share a name are counted together
    own = W.partitionBy("rule")
    n_held, n_fired = F.sum("n_held").over(own), F.sum("n_fired").over(own)
    judged = judged.select("rule", (n_fired + F.when(F.col("on_none"), F.lit(total) - n_held).otherwise(0)).alias("matches"))
    compiled = F.col("matches").isNotNull()
    judged = rules.select("rule", "tags").join(judged.hint("merge"), "rule", "left")
    return judged.select("rule", "tags", compiled.alias("compiled"), F.col("matches").cast("bigint").alias("matches"))
