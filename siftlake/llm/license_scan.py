"""Licence scan: passages against licence texts by the Dice coefficient of their word bigrams. DataFrame functions only.

The passages of a document are its lines, its paragraphs and the whole text. A passage in normal form is lower-case
words of a-z and 0-9; its size is the number of its distinct bigrams. A coefficient of `least` or more needs sizes whose
ratio is at most (2 - least) / least, so a template is compared only with passages of fitting size, and passages that
fit no template are dropped before their bigrams are compared with anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import let

LEAST = 0.8

#: Names and the wording of notices by which texts are put under a licence.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
    "the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause-name": "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-short": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
    "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(size: int, least: float) -> tuple[int, int]:
    """The fewest and the most distinct bigrams of a passage that can reach the coefficient least."""
    fits = [n for n in range(1, int(size * (2 - least) / least) + 2) if 2 * min(n, size) >= least * (n + size)]
    return fits[0], fits[-1]


def _words(passage: Column) -> Column:
    normal = F.trim(F.regexp_replace(F.lower(passage), "[^a-z0-9]+", " "))
    return F.filter(F.split(normal, " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, dice, n_passages for every row of docs.

    license is the template with the highest coefficient over all passages, ties to the first name; it and dice are null
    where none reaches least. n_passages counts the different passages that reach it. A null or empty text has no
    passage. Equal rows get equal results; an empty table gives no rows. Other columns are ignored.
    """
    known = sorted((name, template_bigrams(text)) for name, text in (templates or TEMPLATES).items())
    bounds = {name: size_bounds(len(own), least) for name, own in known}
    low, high = min(a for a, _ in bounds.values()), max(b for _, b in bounds.values())
    text = F.coalesce("text", F.lit(""))
    parts = [F.split(text, "\n", -1), F.split(text, "\n[ \t]*\n", -1), F.array(text)]
    passages = F.array_distinct(F.flatten(F.array(*parts)))
    # n distinct bigrams need n + 1 words, and those at least 2 n + 1 characters
    long_enough = F.filter(passages, lambda p: F.length(p) > 2 * low)
    sets = F.transform(F.transform(long_enough, _words), lambda w: F.when(F.size(w) > low, let(w, _bigrams)))
    fitting = F.filter(sets, lambda b: F.size(b).between(low, high))

    def best(own: Column) -> Column:
        found = []
        for rank, (name, other) in enumerate(known):
            shared = F.size(F.array_intersect(own, F.array(*map(F.lit, other))))
            dice = F.lit(2.0) * shared / (F.size(own) + len(other))
            entry = F.struct(dice.alias("dice"), F.lit(-rank).alias("place"), F.lit(name).alias("license"))
            found.append(F.when(F.size(own).between(*bounds[name]) & (dice >= least), entry))
        return F.array_max(F.array(*found))

    hits = F.filter(F.transform(fitting, best), lambda x: x.isNotNull())
    scanned = docs.select("doc_id", hits.alias("hits")).select("doc_id", "hits", F.array_max("hits").alias("best"))
    return scanned.select(
        "doc_id", F.col("best.license"), F.col("best.dice"), F.size("hits").cast("long").alias("n_passages")
    )


def oracle_sql(templates: dict[str, str] | None = None, least: float = LEAST) -> str:
    """The same in DuckDB's SQL, by comparing every passage with every template."""
    known = sorted((name, template_bigrams(text)) for name, text in (templates or TEMPLATES).items())
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(n)}, [{', '.join(map(quoted, own))}])" for i, (n, own) in enumerate(known))
    return f"""
WITH templates(place, license, bigrams) AS (VALUES {values}),
numbered AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
passages AS (SELECT DISTINCT row, unnest(list_concat(list_concat(string_split(text, chr(10)),
    string_split_regex(text, '\\n[ \\t]*\\n')), [text])) AS p FROM numbered),
words AS (SELECT row, p, list_filter(string_split(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
    FROM passages),
bigrams AS (SELECT row, p, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM words),
compared AS (SELECT row, p, place, license, 2.0e0 * len(list_intersect(own, bigrams)) / (len(own) + len(bigrams)) AS dice
    FROM bigrams CROSS JOIN templates),
best AS (SELECT *, row_number() OVER (PARTITION BY row, p ORDER BY dice DESC, place) AS r FROM compared WHERE dice >= {least}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY dice DESC, place) AS n,
    count(*) OVER (PARTITION BY row) AS n_passages FROM best WHERE r = 1)
SELECT doc_id, license, dice, coalesce(n_passages, 0) AS n_passages
FROM numbered LEFT JOIN (SELECT * FROM ranked WHERE n = 1) USING (row)
"""
