from __future__ import annotations

import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL, SMOKE = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


@pytest.fixture()
def odd_docs(make):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    long_text = "\n".join(f"line {i} of a very long text with number {i * i}" for i in range(4000))
    rows = [
        (1, "a b c", "en", "s", 5),
        (1, "a b c", "en", "s", 5),
        (1, "another text of the same document", "en", "s", 5),
        (2, None, None, None, None),
        (3, "", "de", "s", 0),
        (4, " \t\n \x0b ", "de", None, 0),
        (None, "no id but some words", "en", "s", 20),
        (None, None, None, None, None),
        (5, long_text, "en", "s", len(long_text)),
        (6, long_text, "en", "t", len(long_text)),
        (7, "é́ ß x \U0001f600 <|endoftext|> don't", "fr", "s", 1),
        (-8, "x" * 5000, "en", "s", 5000),
    ]
    clash = "_row string, _doc int, _k int, shard int, rest int, h int, s int, n_lines int, fp int, score int, kept int"
    return make(f"{DOCS}, {clash}", [(*r, "r", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for r in rows])
