"""Licence scan by canonical digests: whole texts joined to known licence texts by hash.

A text and a licence count as equal when their canonical forms are equal: lower case, no copyright
lines, one spelling of words that are written in two ways, no punctuation, single spaces. Only the
digest of the canonical form is compared, so that the join moves 32 characters per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as one, and notices and licences as their stewards publish them.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("organisation", "organization"),
    ("favour", "favor"), ("honour", "honor"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("sub license", "sublicense"),
    ("while at", "whilst"), ("https", "http"),
)
_DISCLAIMED = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
    "OF THIS SOFTWARE."
)
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.\n" + _DISCLAIMED,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted.\n" + _DISCLAIMED,
    ),
)
# What starts a copyright line, and what counts as punctuation.
COPYRIGHT = r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[!-/:-@\[-`{-~\t\r\x0B\x0C“”‘’«»–—…· ]+"


def canonical(text: Column) -> Column:
    """Canonical form, line by line: lines stay apart, each trimmed. Null is the empty text."""
    form = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    form = F.regexp_replace(form, PUNCTUATION, " ")
    for written, common in SPELLINGS:
        form = F.replace(form, F.lit(written), F.lit(common))
    return F.regexp_replace(form, r"(?m)^ +| +$", "")


def _joined(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, "[\n ]+", " "))


def known_licences(spark: SparkSession, known: tuple = KNOWN) -> DataFrame:
    """(license, digest) of licence texts given as (name, text)."""
    table = spark.createDataFrame(list(known), "license string, _text string")
    return table.select("license", F.md5(_joined(canonical(F.col("_text")))).alias("digest")).distinct()


def license_matches(docs: DataFrame, known: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line, license) for every whole text (line 0) and whole line (from 1) that is a licence.

    Null and empty texts match nothing; a text of one line is judged as a text only. Repeated rows
    give repeated results. Other columns are ignored. A licence text is a rare find, so what
    follows the join is small; Spark broadcasts ``known`` only by its own size limit.
    """
    form = docs.select(F.col(id).alias("_id"), canonical(F.col(text)).alias("_form"))
    lines = F.split("_form", "\n")
    whole = F.array(_joined(F.col("_form")))
    parts = form.select("_id", F.posexplode(F.when(F.size(lines) > 1, F.concat(whole, lines)).otherwise(whole)))
    digests = parts.where("col <> ''").select("_id", F.col("pos").alias("line"), F.md5("col").alias("digest"))
    return digests.join(known, "digest").select(F.col("_id").alias(id), "line", "license")


def oracle() -> str:
    """The same rows from ``documents``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        made = f"regexp_replace(lower(coalesce({text}, '')), {quoted(COPYRIGHT)}, '', 'g')"
        made = f"regexp_replace({made}, {quoted(PUNCTUATION)}, ' ', 'g')"
        for written, common in SPELLINGS:
            made = f"replace({made}, {quoted(written)}, {quoted(common)})"
        return f"regexp_replace({made}, '(?m)^ +| +$', '', 'g')"

    joined = lambda t: f"trim(regexp_replace({t}, '[\\n ]+', ' ', 'g'))"
    rows = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license, md5({joined(form('body'))}) AS digest
               FROM (VALUES {rows}) AS k(license, body)),
forms AS (SELECT doc_id, {form('text')} AS form FROM documents),
lines AS (SELECT doc_id, {joined('form')} AS part, 0 AS line FROM forms
          UNION ALL
          SELECT doc_id, unnest(string_split(form, chr(10))), unnest(range(1, len(string_split(form, chr(10))) + 1))
          FROM forms WHERE contains(form, chr(10)))
SELECT doc_id, CAST(line AS INTEGER) AS line, license
FROM lines JOIN known ON digest = md5(part) WHERE part <> ''"""
