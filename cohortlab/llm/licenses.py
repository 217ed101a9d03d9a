"""Licence scans with DataFrame functions only.

Normalised text is compared with licence templates by the Dice coefficient of
their word bigrams, counted with multiplicity. Two bags of sizes a and b can
only reach t where a lies in [b t/(2 - t), b (2 - t)/t], so the word count of
a text says which templates are compared at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""

_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

# Notices by which public licences are commonly given.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", _APACHE),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", _GPL),
    ("isc", _ISC),
    ("mit", "Released under the MIT License."),
    ("mit", _MIT),
    ("mpl-2.0", _MPL),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: ASCII characters that are neither kept nor lower-cased.
_OTHER = "".join(chr(c) for c in range(1, 128) if c != 10 and not chr(c).isalnum())


def normalised(text: Column) -> Column:
    """A-Z lower-cased; every run of other characters than a-z, 0-9 and line feeds is one space.

    A table maps ASCII, one expression what is not ASCII (and U+0000), another
    joins spaces: Java is six times slower with one negated class that holds
    the line feed.
    """
    mapped = F.translate(text, UPPER + _OTHER, LOWER + " " * len(_OTHER))
    return F.regexp_replace(F.regexp_replace(mapped, r"[\x00\x80-\x{10FFFF}]+", " "), "  +", " ")


def bounds(size: int, percent: int) -> tuple[int, int]:
    """Sizes of a bag that can reach percent/100 with a bag of ``size``."""
    return math.ceil(size * percent / (200 - percent)), size * (200 - percent) // percent


def with_bag(df: DataFrame) -> DataFrame:
    """Add ``bag``, the hashes of the word bigrams of the one-line normalised ``text``, in order."""
    words = df.withColumn("words", F.split("text", " "))
    return words.withColumn("bag", F.expr("IF(size(words) > 1, transform(sequence(0, size(words) - 2), i -> xxhash64(words[i], words[i + 1])), array())")).drop("words")


def templates_sql(spark: SparkSession, templates: tuple[tuple[str, str], ...], percent: int) -> tuple[str, list[tuple[int, int]]]:
    """The templates as a constant array of (id, license, n, low, high, g, c), and their size bounds.

    ``g`` are a template's distinct bigrams and ``c`` how often each occurs.
    The templates are a parameter, a list of a few short texts.
    """
    given = spark.createDataFrame(list(templates), "license string, text string")
    bags = with_bag(given.select("license", F.trim(F.regexp_replace(normalised(F.col("text")), "[ \n]+", " ")).alias("text"))).where(F.size("bag") > 0)
    entries, sizes = [], []
    for license_, bag in sorted((r["license"], tuple(r["bag"])) for r in bags.collect()):
        low, high = bounds(len(bag), percent)
        sizes.append((low, high))
        distinct = sorted(set(bag))
        name = license_.replace("'", "''")
        entries.append(f"named_struct('id', {len(entries)}, 'license', '{name}', 'n', {len(bag)}, 'low', {low}, 'high', {high}, "
                       f"'g', array({', '.join(f'bigint({g!s})' if g != -2**63 else 'bigint(-9223372036854775807 - 1)' for g in distinct)}), "
                       f"'c', array({', '.join(str(bag.count(g)) for g in distinct)}))")
    none = "cast(array() as array<struct<id:int,license:string,n:int,low:int,high:int,g:array<bigint>,c:array<int>>>)"
    return f"array({', '.join(entries)})" if entries else none, sizes


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, unit, text, norm) of the parts of each text that are compared.

    ``line``: each line with a word. ``paragraph``: each run of two or more
    such lines between blank lines, if there are at least two runs; ``whole``:
    all lines of a text that has two or more. Numbers count from 0, also over
    lines and paragraphs without words. ``norm``, of the whole only, still has
    the line feeds.
    """
    # A column of its own, or each use below would normalise the text again.
    norm = docs.where("text is not null").select("doc_id", normalised(F.col("text")).alias("norm"))
    norm = norm.withColumn("blocks", F.split("norm", "\n ?(?:\n ?)+"))
    part = lambda kind, i, x, norm=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("unit"), F.trim(x).alias("text"), norm.alias("norm"))
    joined = lambda x: F.regexp_replace(x, " ?\n[ \n]*", " ")
    lines = F.transform(F.split("norm", "\n"), lambda x, i: part("line", i, x))
    blocks = F.transform(F.filter(F.transform("blocks", lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(" \n")).alias("x"))), lambda b: b["x"].contains("\n")),
                         lambda b: part("paragraph", b["i"], joined(b["x"])))
    none = F.array().cast("array<struct<kind:string,unit:int,text:string,norm:string>>")
    whole = F.when(F.trim("norm", F.lit(" \n")).contains("\n"), F.array(part("whole", F.lit(0), joined(F.trim("norm", F.lit(" \n"))), F.col("norm")))).otherwise(none)
    some = F.when(F.size("blocks") > 1, blocks).otherwise(none)
    return norm.select("doc_id", F.explode(F.concat(lines, some, whole)).alias("x")).where("x.text <> ''").select("doc_id", "x.kind", "x.unit", "x.text", "x.norm")


def best_sql(templates: str, n: str, bag: str, percent: int) -> str:
    """The best of ``templates`` for a bag of ``n`` bigrams: an array of one or no (less, license, id)."""
    # Each distinct bigram of a template that a part lacks is lost to it at least once.
    possible = f"({n} between t.low and t.high) and 200 * (t.n - size(t.g) + size(array_intersect(t.g, {bag}))) >= {percent} * ({n} + t.n)"
    shared = f"aggregate(zip_with(t.g, t.c, (g, c) -> least(c, size(filter({bag}, b -> b = g)))), 0, (s, k) -> s + k)"
    found = f"transform(filter({templates}, t -> {possible}), t -> named_struct('both', {shared}, 'n', t.n, 'license', t.license, 'id', t.id))"
    return (f"slice(array_sort(transform(filter({found}, f -> 200 * f.both >= {percent} * ({n} + f.n)), "
            f"f -> named_struct('less', -2 * f.both / ({n} + f.n), 'license', f.license, 'id', f.id))), 1, 1)")


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def runs_sql(templates: str, percent: int) -> str:
    """The runs of two or more consecutive lines of ``norm`` that are notices, as an array of (kind, unit, less, license).

    ``bag`` is the whole's.

    Only templates of whose bigrams the text has enough are looked for, from
    each line on as far as their sizes allow. Lines, paragraphs and the whole
    have rows of their own (``free`` is 0): here they only stand against worse
    runs of their template that share a line with them, as better runs do.
    """
    kind = "array<struct<less:double,free:int,license:string,id:int,i:int,j:int,unit:int>>"
    none = f"cast(array() as {kind})"
    # As many bigrams as any bag that reaches the least Dice must share with the template.
    enough = lambda bag: f"{200 - percent} * (t.n - size(t.g) + size(array_intersect(t.g, {bag}))) >= {percent} * t.n"
    ends = ("aggregate(slice(lines, i + 1, top + 1), named_struct('n', 0, 'ends', cast(array() as array<int>)), (s, x) -> IF(s.n + x.n > top + 1, "
            "named_struct('n', top + 2, 'ends', s.ends), named_struct('n', s.n + x.n, 'ends', array_append(s.ends, s.n + x.n))), s -> s.ends)")
    window = "split(array_join(transform(slice(lines, i + 1, size(ends)), x -> x.text), ' '), ' ')"
    bigrams = "IF(size(words) > 1, transform(sequence(0, size(words) - 2), p -> xxhash64(words[p], words[p + 1])), cast(array() as array<bigint>))"
    alone = ("j = 0 or (i = 0 and i + j = size(lines) - 1) or (lines[i + j].unit - lines[i].unit = j and "
             "coalesce(get(lines, i - 1).unit < lines[i].unit - 1, true) and coalesce(get(lines, i + j + 1).unit > lines[i + j].unit + 1, true))")
    one = (f"transform({let('slice(near, 1, e - 1)', 'part', best_sql('usable', '(e - 1)', 'part', percent))}, x -> named_struct('less', x.less, "
           f"'free', IF({alone}, 0, 1), 'license', x.license, 'id', x.id, 'i', i, 'j', i + j, 'unit', lines[i].unit))")
    at_start = let(f"filter(found, t -> {enough('near')})", "usable", f"IF(size(usable) = 0, {none}, flatten(transform(ends, (e, j) -> {one})))")
    starts = let(ends, "ends", f"IF(size(ends) = 0, {none}, {let(window, 'words', let(bigrams, 'near', at_start))})")
    listed = let("array_max(transform(found, t -> t.high))", "top", f"flatten(transform(sequence(0, size(lines) - 1), i -> {starts}))")
    picked = (f"aggregate(array_sort({listed}), {none}, (kept, x) -> IF(x.free = 1 and exists(kept, y -> y.id = x.id and y.i <= x.j and x.i <= y.j), kept, array_append(kept, x)), "
              "kept -> transform(filter(kept, x -> x.free = 1), x -> named_struct('kind', 'run', 'unit', x.unit, 'less', x.less, 'license', x.license)))")
    picked = let("transform(filter(transform(split(norm, '\\n'), (x, i) -> named_struct('unit', i, 'text', trim(x))), x -> x.text <> ''), "
                 "x -> named_struct('unit', x.unit, 'text', x.text, 'n', size(split(x.text, ' '))))", "lines", picked)
    no_rows = "cast(array() as array<struct<kind:string,unit:int,less:double,license:string>>)"
    seen = f"array_intersect(bag, flatten(transform({templates}, t -> t.g)))"
    return let(seen, "seen", let(f"filter({templates}, t -> {enough('seen')})", "found", f"IF(size(found) = 0, {no_rows}, {picked})"))


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, unit, license, dice) of every part of a text, see
    ``units``, that is a licence notice: its best template (ties: first by
    name) at a Dice coefficient of percent/100 or more.

    A notice of several paragraphs, or between other lines, is a ``run``: two
    or more consecutive lines, blank ones between them left out, whose unit
    is the first one's. Runs of one template that share lines are one notice,
    and the best is given (ties: the first, then the shortest), unless a
    line, paragraph or whole that shares lines with it is as good.

    Null and empty texts have no parts and give no rows; null ids stay null;
    repeated rows give their matches again; other columns are not read. Each
    part is judged alone, in one pass and without a shuffle, so copies, hot
    sources and long texts only make more parts; runs are judged text by text.
    """
    spark = docs.sparkSession
    constant, sizes = templates_sql(spark, templates, percent)
    parts = units(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")))
    n = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))  # words less one: bigrams
    fits = F.lit(False)
    for low, high in merged(sizes):
        fits = fits | F.col("n").between(low, high)
    least = min((low for low, _ in sizes), default=0)
    bags = with_bag(parts.withColumn("n", n).withColumn("fits", fits).where(F.col("fits") | ((F.col("kind") == "whole") & (F.col("n") >= least))))
    none = "cast(array() as array<struct<kind:string,unit:int,less:double,license:string>>)"
    alone = f"IF(fits, transform({best_sql(constant, 'n', 'bag', percent)}, x -> named_struct('kind', kind, 'unit', unit, 'less', x.less, 'license', x.license)), {none})"
    runs = f"IF(kind = 'whole', {runs_sql(constant, percent)}, {none})"
    # As a generator the match is worked out once; as a column Catalyst would move its null test down and repeat it all.
    found = bags.select("doc_id", F.explode(F.expr(f"concat({alone}, {runs})")).alias("x"))
    return found.select("doc_id", "x.kind", "x.unit", "x.license", (-F.col("x.less")).alias("dice"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same numbers in as few ranges as possible."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 80) -> str:
    """DuckDB SQL of the lines, paragraphs and wholes of ``licenses`` over the view documents; it looks for no runs."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in templates)
    norm = lambda x: f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g')"
    flat = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    bigrams = lambda x: f"list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"
    return f"""
    WITH given(license, raw) AS (VALUES {rows}),
    t0 AS (SELECT row_number() OVER () AS tid, license, string_split({flat(norm('raw'))}, ' ') AS w FROM given),
    t1 AS (SELECT tid, license, len(w) - 1 AS tn, unnest({bigrams('w')}) AS g FROM t0),
    tc AS (SELECT tid, license, tn, g, count(*) AS c FROM t1 GROUP BY ALL),
    d AS (SELECT doc_id, row_number() OVER () AS rid, {norm('text')} AS x FROM documents WHERE text IS NOT NULL),
    ln AS (SELECT doc_id, rid, 'line' AS kind, unnest(string_split(x, chr(10))) AS y, generate_subscripts(string_split(x, chr(10)), 1) - 1 AS unit FROM d),
    ps AS (SELECT doc_id, rid, string_split_regex(x, '\\n ?(?:\\n ?)+') AS b FROM d),
    pg AS (SELECT doc_id, rid, 'paragraph' AS kind, unnest(b) AS y, generate_subscripts(b, 1) - 1 AS unit FROM ps WHERE len(b) > 1),
    u0 AS (SELECT doc_id, rid, kind, unit, y FROM ln
           UNION ALL SELECT doc_id, rid, kind, unit, y FROM pg WHERE contains(trim(y, ' ' || chr(10)), chr(10))
           UNION ALL SELECT doc_id, rid, 'whole', 0, x FROM d WHERE contains(trim(x, ' ' || chr(10)), chr(10))),
    u1 AS (SELECT doc_id, rid, kind, unit, string_split({flat('y')}, ' ') AS w FROM u0 WHERE {flat('y')} <> ''),
    u2 AS (SELECT doc_id, rid, kind, unit, len(w) - 1 AS n, unnest({bigrams('w')}) AS g FROM u1 WHERE len(w) <= 1000),
    uc AS (SELECT doc_id, rid, kind, unit, n, g, count(*) AS c FROM u2 GROUP BY ALL),
    m AS (SELECT u.doc_id, u.rid, u.kind, u.unit, u.n, t.tid, t.license, t.tn, sum(least(u.c, t.c)) AS common
          FROM uc u JOIN tc t ON u.g = t.g GROUP BY ALL),
    k AS (SELECT *, 2 * common / (n + tn) AS dice FROM m WHERE 200 * common >= {percent} * (n + tn)),
    r AS (SELECT *, row_number() OVER (PARTITION BY rid, kind, unit ORDER BY dice DESC, license) AS place FROM k)
    SELECT doc_id, kind, CAST(unit AS INTEGER) AS unit, license, CAST(dice AS DOUBLE) AS dice FROM r WHERE place = 1
    """
