"""License scans: Dice coefficient over word bigrams, with DataFrame functions only.

A unit is a line of a text, the whole text, or any run of its words, across line ends too. Its words are
maximal runs of letters and digits, lower-cased; its bigrams the distinct pairs of neighbouring words. A
template matches when 2 * common / (unit + template) bigrams is at least the threshold t. Then the unit has
at least t / (2 - t) times the template's bigrams in common and at most (2 - t) / t times as many in all, so
a text without so many of a template's bigrams is not compared with it.

A run that begins or ends with a foreign bigram is never better than the shorter one, so runs begin and end
with a bigram of the template; from each begin the best end is taken, and of overlapping runs the best. A
run that shares a line with a line that matches the same licence is that occurrence, and not given again;
so are all runs of a text that matches it as a whole.

Each row is handled on its own: no shuffle, no join. Templates are literals of fixed size.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import shielded

#: Short licence statements and notices of public licences.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit": "Released under the MIT License.",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Full licence texts, beside the notices.
FULL_TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
ALL_TEMPLATES = TEMPLATES | FULL_TEXTS
THRESHOLD = 0.8


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def bigrams(text: str) -> list[str]:
    w = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and largest bigram count of a unit that can match a template of n bigrams."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.lower(unit), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _pairs(w: str) -> str:
    """All bigrams of an array of words, in order."""
    return f"zip_with(slice({w}, 1, greatest(size({w}) - 1, 0)), slice({w}, 2, greatest(size({w}) - 1, 0)), (a, b) -> concat(a, ' ', b))"


#: Each bigram of a text: place `i`, the place `p` before where it stood last (or -1), itself.
_LINKED = """transform(array(sort_array(transform(_pairs, (b, i) -> named_struct('b', b, 'i', i)))), o -> sort_array(zip_with(o,
    concat(array(CAST(NULL AS struct<b: string, i: int>)), slice(o, 1, greatest(size(o) - 1, 0))),
    (x, y) -> named_struct('i', x.i, 'p', IF(y.b = x.b, y.i, -1), 'b', x.b))))[0]"""


def _runs_sql(threshold: float) -> str:
    """Runs of a text that match a template `t`: best end of each begin, then the best of overlapping ones.

    `v`: the text's bigrams with `h`, whether of the template; `g`: the places of these. A run has `lo` of them
    at least, so begins whose next `lo` span more than `hi` bigrams are left out, as are ends twice `hi` away
    unless repeated bigrams keep the run that small.
    """
    dice = "2.0D * (a.c + 1) / (a.n + 1 + t.n)"
    step = f"""CASE WHEN q.p >= s THEN a WHEN NOT q.h THEN named_struct('n', a.n + 1, 'c', a.c, 'dice', a.dice, 'e', a.e)
        WHEN {dice} > a.dice THEN named_struct('n', a.n + 1, 'c', a.c + 1, 'dice', {dice}, 'e', q.i)
        ELSE named_struct('n', a.n + 1, 'c', a.c + 1, 'dice', a.dice, 'e', a.e) END"""
    near = "IF(size(array_distinct(slice(_pairs, s + 1, 2 * t.hi + 1))) > t.hi, least(2 * t.hi + 1, g[size(g) - 1] - s + 1), g[size(g) - 1] - s + 1)"
    best = f"aggregate(slice(v, s + 1, {near}), named_struct('n', 0, 'c', 0, 'dice', 0.0D, 'e', -1), (a, q) -> {step}, a -> named_struct('s', s, 'e', a.e, 'dice', a.dice))"
    begins = "filter(slice(g, 1, greatest(size(g) - t.lo + 1, 0)), (s, j) -> size(array_distinct(slice(_pairs, s + 1, g[j + t.lo - 1] - s + 1))) <= t.hi)"
    found = f"filter(transform({begins}, s -> {best}), r -> r.dice >= {threshold!r}D)"
    apart = f"""aggregate({found}, CAST(array() AS array<struct<s: int, e: int, dice: double>>), (k, r) ->
        CASE WHEN size(k) = 0 OR r.s > element_at(k, -1).e THEN concat(k, array(r))
        WHEN r.dice > element_at(k, -1).dice THEN concat(slice(k, 1, size(k) - 1), array(r)) ELSE k END)"""
    marked = "transform(_linked, q -> named_struct('i', q.i, 'p', q.p, 'h', array_contains(t.b, q.b)))"
    return f"transform(array({marked}), v -> transform(array(transform(filter(v, q -> q.h), q -> q.i)), g -> {apart})[0])[0]"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = ALL_TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """All columns of `docs` with `matches`: array<struct<license, dice, line, last>>.

    `line` and `last` are the first and last line of the unit, -1 for the whole text. Null, empty and one-word
    units have no bigrams and match nothing. A one-line text is not compared as a whole. Columns named
    `matches` are replaced; all others stay, whatever their names. Templates without bigrams never match.
    Every row stays, rows that repeat too; an empty table gives no rows.
    """
    known = [(k, b, *bounds(len(b), threshold)) for k, v in sorted(templates.items()) if (b := bigrams(v))]
    kind = "array<struct<license: string, dice: double, line: int, last: int>>"
    if not known:
        return docs.drop("matches").withColumn("matches", F.expr(f"CAST(array() AS {kind})"))
    literal = F.array(*[F.struct(F.lit(k).alias("id"), F.split(F.lit("|".join(b)), "[|]").alias("b"), F.lit(len(b)).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, b, lo, hi in known])
    every = ", ".join(f"'{p}'" for p in sorted({p for _, b, _, _ in known for p in b}))
    kept = docs.drop("matches")
    out, back = shielded(kept, ("_lines", "_templates", "_pairs", "_hits", "_near", "_units", "_far", "_linked", "_at", "_runs"))
    out = out.withColumn("_lines", F.transform(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n"), _words)).withColumn("_templates", literal)
    out = out.withColumn("_pairs", F.expr(f"transform(array(flatten(_lines)), w -> {_pairs('w')})[0]"))
    out = out.withColumn("_hits", F.expr(f"array_distinct(filter(_pairs, b -> b IN ({every})))"))
    out = out.withColumn("_near", F.expr("filter(_templates, t -> size(_hits) >= t.lo AND size(array_intersect(_hits, t.b)) >= t.lo)"))
    units = f"concat(transform(_lines, (w, i) -> named_struct('b', array_distinct({_pairs('w')}), 'line', i)), IF(size(_lines) > 1, array(named_struct('b', array_distinct(_pairs), 'line', -1)), array()))"
    compared = "transform(filter(_near, t -> size(u.b) BETWEEN t.lo AND t.hi), t -> named_struct('license', t.id, 'dice', 2.0D * size(array_intersect(u.b, t.b)) / (size(u.b) + t.n), 'line', u.line, 'last', u.line))"
    units = f"filter(flatten(transform({units}, u -> {compared})), m -> m.dice >= {threshold!r}D)"
    out = out.withColumn("_units", F.expr(f"IF(size(_near) = 0, CAST(array() AS {kind}), {units})"))
    out = out.withColumn("_far", F.expr("filter(_near, t -> NOT exists(_units, m -> m.license = t.id AND m.line = -1))"))
    out = out.withColumn("_linked", F.expr(f"IF(size(_far) = 0, CAST(array() AS array<struct<i: int, p: int, b: string>>), {_LINKED})"))
    out = out.withColumn("_at", F.expr("IF(size(_far) = 0, CAST(array() AS array<int>), flatten(transform(_lines, (w, i) -> transform(w, x -> i))))"))
    runs = f"flatten(transform(_far, t -> transform({_runs_sql(threshold)}, r -> named_struct('license', t.id, 'dice', r.dice, 'line', _at[r.s], 'last', _at[r.e + 1]))))"
    out = out.withColumn("_runs", F.expr(runs))
    alone = "filter(_runs, r -> NOT exists(_units, m -> m.license = r.license AND m.line BETWEEN r.line AND r.last))"
    return out.select(*back, F.expr(f"CAST(concat(_units, {alone}) AS {kind})").alias("matches"))
