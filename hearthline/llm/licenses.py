"""Licence scan by canonical digests: a text that is a known licence or notice, whatever its spelling, case or year.

Texts are brought to a canonical form by built-in functions, digested, and hash-joined with the digests of known licences.
Only whole texts match: the whole document, or one whole line of it, which is how notices are placed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_digests import DIGESTS

#: Short licences and the notices that stand for longer ones, under their public identifiers.
LICENSES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "You just DO WHAT THE FUCK YOU WANT TO."),
    ("0BSD",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
     'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
     "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
     "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT",
     'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
     'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
     "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
     'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
     "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
     "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
     "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
     "IN THE SOFTWARE."),
)

#: Spellings that count as the same, applied in order to lower-cased text.
SAME = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("copyright holder's", "copyright holders"),
    ("&", " and "),
    ("http://", "https://"),
)
COPYRIGHT_LINE = r"^[ \t]*(copyright|\(c\)|©|all rights reserved).*$"
#: Of lines that start with "copyright", only notices: licences wrap so that "COPYRIGHT HOLDERS" may start a line.
NOTICE_LINE = r"^[ \t]*(copyright[ \t:,]*(\(c\)|©|&copy;|[\[<({]?([0-9]{4}|yyyy|year))|\(c\)|©|all rights reserved).*$"
OUTSIDE_WORDS = r"[^\p{L}\p{N}]+"


def canonical_line(line: Column) -> Column:
    """Lower case, nothing of a copyright line, one spelling of each variant, words separated by one blank."""
    out = F.regexp_replace(F.lower(line), f"(?s){NOTICE_LINE}", "")
    for a, b in SAME:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, OUTSIDE_WORDS, " "))


def canonical_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), canonical_line)


def joined(lines: Column) -> Column:
    """The canonical text of its canonical lines."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known(spark: SparkSession, licenses: tuple[tuple[str, str], ...] = LICENSES) -> DataFrame:
    """``digest, license_id``, one row for each canonical text."""
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("license_id"), F.lit(t).alias("text")) for a, t in licenses)))
    table = spark.range(1).select(rows.alias("r")).select("r.license_id", F.sha2(joined(canonical_lines(F.col("r.text"))), 256).alias("digest"))
    return table.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def standard(spark: SparkSession) -> DataFrame:
    """``digest, license_id`` of the fixed list and of whole licences."""
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("license_id"), F.lit(d).alias("digest")) for a, d in DIGESTS)))
    whole = spark.range(1).select(rows.alias("r")).select("r.digest", "r.license_id")
    return known(spark).unionByName(whole).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line, license_id``: line 0 for a document that as a whole is a known licence, else the line's number from 1.

    ``licenses``: ``digest, license_id`` with unique digests, by default the fixed list with the
    whole licences, which is broadcast; a table of the
    caller's is joined as its size allows.  A document of one line that is a licence gives line 0 only.  Null and empty texts,
    and texts that are empty in canonical form, match nothing.  Rows with null or repeated ids give their own matches; other
    columns play no part; an empty table gives no row.
    """
    table = F.broadcast(standard(docs.sparkSession)) if licenses is None else licenses.select("digest", "license_id")
    table = table.where(F.col("digest") != F.sha2(F.lit(""), 256))
    # Each line is brought to its form once; the whole text's form is made of them.
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col).cast("string")).alias("lines"))
    alone = F.array().cast("array<string>")
    whole = F.array(joined(F.col("lines")))
    units = rows.select(
        "doc_id", F.posexplode(F.concat(whole, F.when(F.size("lines") > 1, F.col("lines")).otherwise(alone))).alias("line", "unit")
    )
    return units.select("doc_id", "line", F.sha2("unit", 256).alias("digest")).join(table, "digest").select("doc_id", "line", "license_id")


def oracle() -> str:
    """The same in DuckDB SQL over ``documents``."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"regexp_replace(lower({x}), {quoted('(?m)' + COPYRIGHT_LINE)}, '', 'g')"
        for a, b in SAME:
            x = f"replace({x}, {quoted(a)}, {quoted(b)})"
        return f"trim(regexp_replace({x}, {quoted(OUTSIDE_WORDS)}, ' ', 'g'))"

    values = ", ".join(f"({quoted(a)}, {quoted(t)})" for a, t in LICENSES)
    return f"""
with known as (select {form('t')} as unit, min(a) as license_id from (values {values}) v(a, t) group by 1),
parts as (select doc_id, string_split(text, chr(10)) as l, text from documents),
units as (
  select doc_id, 0 as line, text as unit from parts
  union all
  select doc_id, unnest(range(1, len(l) + 1)) as line, unnest(l) as unit from parts where len(l) > 1)
select doc_id, cast(line as integer) as line, license_id
from (select doc_id, line, {form('unit')} as unit from units) u join known using (unit) where unit <> ''
"""
