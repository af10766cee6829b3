"""Licence scans: Dice coefficients over word bigrams between a text's units and licence templates.

Units of a text are its lines, its paragraphs (cut at blank lines) and the whole text. Normalised words
are runs of a-z and 0-9 of the lower-cased unit; a unit's bigrams are a set. As ``2 * both / (a + b)`` is
at most ``2 * min(a, b) / (a + b)``, a template of b bigrams needs a unit of between
``limit / (2 - limit) * b`` and ``(2 - limit) / limit * b`` bigrams, and a unit only meets templates whose
bounds it fits. Everything is a DataFrame expression on the row: no shuffle, no explode, so neither hot
sources nor copies matter; templates are a literal of the plan (a parameter, bounded by ``MAX_TEMPLATES``).

Defined results: null or empty texts, and units of fewer than two words, match nothing. Per document the
best template is given; ties: the first by name. Rows that repeat give as many rows; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

MAX_TEMPLATES = 2_000
LIMIT = 0.8
#: Public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_bigrams(text: str) -> list[tuple[str, str]]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted(set(zip(words, words[1:])))


def size_bounds(n: int, limit: float) -> tuple[float, float]:
    """A little wide, so that rounding leaves out no size that reaches the limit exactly."""
    return limit / (2 - limit) * n - 1e-6, (2 - limit) / limit * n + 1e-6


def _bigrams(unit: Column) -> Column:
    """The set of hashed word bigrams of a unit; empty for fewer than two words."""
    words = F.regexp_extract_all(F.lower(unit), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = lambda w: F.when(
        F.size(w) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))
    ).otherwise(F.array().cast("array<bigint>"))
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """A row for each document: doc_id, license (the best template's name or null), dice (6 decimals, or
    null) and n_units (units that match a template)."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    known = [(name, bigrams) for name, text in sorted(templates.items()) if (bigrams := template_bigrams(text))]

    def literal(name: str, bigrams: list[tuple[str, str]]) -> Column:
        low, high = size_bounds(len(bigrams), limit)
        hashes = F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in bigrams])
        return F.struct(F.lit(name).alias("name"), hashes.alias("grams"), F.lit(len(bigrams)).alias("n"), F.lit(low).alias("low"), F.lit(high).alias("high"))

    table = F.array(*[literal(*x) for x in known])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n", -1), F.split(text, r"\n[ \t\r]*\n", -1), F.array(text)))

    def dice(grams: Column, t: Column) -> Column:
        n = F.size(grams)
        both = F.when((n >= t.low) & (n <= t.high), F.size(F.array_intersect(grams, t.grams))).otherwise(0)
        return F.struct((2.0 * both / (n + t.n)).alias("dice"), t["name"].alias("name"))

    # Sets of units that fit no template's bounds go before any is compared.
    least = min((size_bounds(len(b), limit)[0] for _, b in known), default=0.0)
    most = max((size_bounds(len(b), limit)[1] for _, b in known), default=0.0)
    best = lambda grams: F.array_sort(
        F.filter(F.transform(table, lambda t: dice(grams, t)), lambda x: x.dice >= limit), lambda a, b: F.when(a.dice > b.dice, -1).when(a.dice < b.dice, 1).when(a["name"] < b["name"], -1).otherwise(1)
    )
    sets = docs.select("doc_id", F.filter(F.transform(F.filter(units, lambda u: F.length(u) >= 2 * least), _bigrams), lambda g: (F.size(g) >= F.lit(least)) & (F.size(g) <= F.lit(most))).alias("_sets"))
    found = sets.select("doc_id", F.filter(F.transform("_sets", best), lambda x: F.size(x) > 0).alias("_found"))
    first = F.transform("_found", lambda x: F.get(x, F.lit(0)))
    top = F.aggregate(
        first,
        F.struct(F.lit(-1.0).alias("dice"), F.lit("").alias("name")),
        lambda a, x: F.when((x.dice > a.dice) | ((x.dice == a.dice) & (x["name"] < a["name"])), x).otherwise(a),
    )
    out = found.select("doc_id", top.alias("_top"), F.size("_found").cast("long").alias("n_units"))
    hit = F.col("n_units") > 0
    return out.select("doc_id", F.when(hit, F.col("_top.name")).alias("license"), F.when(hit, F.round(F.col("_top.dice"), 6)).alias("dice"), "n_units")


def oracle(templates: dict[str, str] = TEMPLATES, limit: float = LIMIT) -> str:
    """The same result in DuckDB SQL, every unit against every template."""
    rows = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in sorted(templates.items()))
    bigrams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
WITH templates(license, body) AS (VALUES {rows}),
t AS (SELECT license, {bigrams} AS b FROM (SELECT license, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM templates)),
units AS (
  SELECT DISTINCT doc_id, unit FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents
    UNION ALL SELECT doc_id, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) FROM documents
    UNION ALL SELECT doc_id, text FROM documents)
),
u AS (SELECT doc_id, unit, {bigrams} AS a FROM (SELECT doc_id, unit, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM units)),
hits AS (
  SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM u JOIN t ON 2.0 * least(len(a), len(b)) >= {limit} * (len(a) + len(b))
),
good AS (SELECT * FROM hits WHERE dice >= {limit}),
best AS (SELECT doc_id, license, dice FROM good QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license) = 1),
counts AS (SELECT doc_id, count(DISTINCT unit) AS n_units FROM good GROUP BY doc_id)
SELECT d.doc_id, best.license, round(best.dice, 6) AS dice, coalesce(n_units, 0) AS n_units
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN counts USING (doc_id)"""
