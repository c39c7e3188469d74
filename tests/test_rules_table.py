"""Rules given as tables: condition trees, value lists, modifiers, and many rules at once."""

from __future__ import annotations

import random
from itertools import product

import pytest

from siftlake.operators import rules as ru

EVENTS = "port int, user string, cmd string, bytes bigint"


def holds(tree, held):
    if isinstance(tree, str):
        return tree in held
    kind, *parts = tree
    if kind == "not":
        return not holds(parts[0], held)
    if kind == "of":
        return sum(holds(p, held) for p in parts[1:]) >= parts[0]
    return (all if kind == "and" else any)(holds(p, held) for p in parts)


def one(value, modifier, literal):
    if value is None:
        return False
    v, x = str(value).lower(), literal.lower()
    if modifier in ru.BOUNDS:
        a, b = float(v), float(x)
        return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[modifier]
    return {"": v == x, "contains": x in v, "startswith": v.startswith(x), "endswith": v.endswith(x)}[modifier]


def plain(events, tests, trees):
    names = ["port", "user", "cmd", "bytes"]
    out = {}
    for rule, tree in trees.items():
        selections = {}
        for r, s, field, modifier, all_of, value in tests:
            if r == rule:
                selections.setdefault(s, {}).setdefault((field, modifier, all_of), []).append(value)
        n = 0
        for e in events:
            row = dict(zip(names, e, strict=True))
            held = {
                s for s, groups in selections.items()
                if all((all if a else any)(one(row[f], m, x) for x in own) for (f, m, a), own in groups.items())
            }
            n += holds(tree, held)
        out[rule] = n
    return out


TREES = [
    "a", ("not", "a"), ("and", "a", ("not", "b")), ("or", "a", ("and", "b", "c")), ("of", 2, "a", "b", "c"),
    ("not", ("of", 2, "a", "b", "c")), ("and", ("of", 1, "a", "b"), ("not", ("or", "c", "b"))), ("and", "a", ("not", "a")),
    ("not", ("and", "a", ("not", "b"))),
]


@pytest.mark.parametrize("tree", TREES)
def test_terms_are_the_condition(tree):
    for bits in product([0, 1], repeat=3):
        held = {n for n, b in zip("abc", bits, strict=True) if b}
        fires = any(set(need) <= held and not set(forbid) & held for need, forbid in ru.terms_of(tree))
        assert fires == holds(tree, held)


def test_many_random_rules_against_a_plain_version(make):
    rng = random.Random(4)
    words = ["cmd", "powershell", "vssadmin delete", "ab", "x", "é_9%"]
    events = [
        (
            rng.choice([22, 80, 3389, None]), rng.choice(["Root", "root", "guest", None]),
            rng.choice([None, "", *(rng.choice(words).upper() + " " + rng.choice(words) for _ in range(4))]), rng.choice([0, 5, 10**12, None]),
        )
        for _ in range(150)
    ]
    tests, trees = [], {}
    for k in range(60):
        rule, trees[f"r{k}"] = f"r{k}", rng.choice(TREES)
        for s in "abc":
            for field in rng.sample(["port", "user", "cmd", "bytes"], rng.randrange(1, 4)):
                if field == "bytes":
                    tests.append((rule, s, field, rng.choice(ru.BOUNDS), False, rng.choice(["0", "5", "999"])))
                elif field == "cmd":
                    modifier, all_of = rng.choice(ru.PARTS), rng.random() < 0.4
                    tests += [(rule, s, field, modifier, all_of, w) for w in rng.sample(words, rng.randrange(1, 3))]
                else:
                    own = ["22", "3389", "443"] if field == "port" else ["ROOT", "guest"]
                    tests += [(rule, s, field, "", False, w) for w in rng.sample(own, rng.randrange(1, 3))]
    conditions = [(r, "t", ru.terms_of(tree)) for r, tree in trees.items()]
    got = ru.rule_matches(make(EVENTS, events), make(ru.TESTS, tests), make(ru.CONDITIONS, conditions)).collect()
    assert {r["rule"]: r["matches"] for r in got} == plain(events, tests, trees)
    assert all(r["compiled"] for r in got) and len({r["matches"] for r in got}) > 10


def test_rules_that_do_not_compile_have_no_count(make):
    tests = [("a", "s", "port", "", False, "22"), ("b", "s", "nowhere", "", False, "1"), ("c", "s", "port", "regex", None, "2"), ("e", "s", "port", "", False, None)]
    conditions = [(r, "t", ru.terms_of(tree)) for r, tree in (("a", "s"), ("b", ("not", "s")), ("c", "s"), ("d", ("or", "s", "t")), ("e", "s"))]
    events = make(EVENTS, [(22, None, None, None), (80, None, None, None)])
    got = ru.rule_matches(events, make(ru.TESTS, tests), make(ru.CONDITIONS, conditions)).collect()
    assert {r["rule"]: (r["compiled"], r["matches"]) for r in got} == {
        "a": (True, 1), "b": (False, None), "c": (False, None), "d": (False, None), "e": (False, None),
    }
    assert ru.rule_matches(events, make(ru.TESTS, []), make(ru.CONDITIONS, [])).collect() == []
    empty = ru.rule_matches(events.limit(0), make(ru.TESTS, tests[:1]), make(ru.CONDITIONS, [("a", "t", ru.terms_of(("not", "s")))]))
    assert [r["matches"] for r in empty.collect()] == [0]


def test_equal_rules_and_like_events_are_judged_once(make, monkeypatch):
    """No table on the way has a row per rule and event, though each rule holds on half of the events or on all."""
    sizes = {}

    def counting(df, label, write=ru.materialise):
        out = write(df, label)
        sizes[label] = max(out.count(), sizes.get(label, 0))
        return out

    monkeypatch.setattr(ru, "materialise", counting)
    events = [(22 if i % 2 else 80, f"user{i}", f"run {i}.exe", None) for i in range(600)]
    tests, trees = [], {}
    for k in range(200):
        rule, trees[f"r{k}"] = f"r{k}", TREES[k % 9]
        tests += [(rule, "a", "cmd", "endswith", False, ".EXE"), (rule, "a", "port", "", False, "22")]
        tests += [(rule, "b", "user", "contains", False, x) for x in ("ER7", "er8")] + [(rule, "c", "cmd", "startswith", False, "ru")]
    conditions = [(r, "t", ru.terms_of(tree)) for r, tree in trees.items()]
    got = ru.rule_matches(make(EVENTS, events), make(ru.TESTS, tests), make(ru.CONDITIONS, conditions)).collect()
    assert {r["rule"]: r["matches"] for r in got} == plain(events, tests, trees)
    assert max(sizes.values()) <= 2 * (len(events) + len(trees)), sizes


def test_literals_of_every_length(make):
    text = "abcdefghijklmnopqrst"
    events = [(1, None, x, None) for x in (text, text[:12], text[-12:], text[3:7], "a", "t", "", None, "ABC" + text, "xx")]
    literals = ["", "a", "t", "ab", "st", "abc", "rst", text[:6], text[-6:], text[:12], text[-12:], text[:17], text[-17:], text, "ijk"]
    tests = [(f"{m} {x}", "a", "cmd", m, False, x) for m in (*ru.PARTS, "") for x in literals]
    trees = {f"{m} {x}": "a" for m in (*ru.PARTS, "") for x in literals}
    conditions = [(r, "t", ru.terms_of(tree)) for r, tree in trees.items()]
    got = ru.rule_matches(make(EVENTS, events), make(ru.TESTS, tests), make(ru.CONDITIONS, conditions)).collect()
    assert {r["rule"]: r["matches"] for r in got} == plain(events, tests, trees)
