"""Licence scans by digest of canonical texts.

A text is brought to a canonical form: letters lowered, copyright lines left out, everything but
letters and digits read as one blank, equivalent spellings made equal. Whole documents, and each of
their lines as a text of its own (for notices), are joined by digest to the known licences: the notices
below, and the whole texts in ``license_texts.json`` with and without their titles.
"""

from __future__ import annotations

import json
import re
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Spellings that licence matching treats as equal.
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("initialise", "initialize"), ("merchantibility", "merchantability"), ("whilst", "while"),
)
#: Short licence texts and the usual notices of longer ones.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
            "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
            "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
            "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:\nThe above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", "
            "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
            "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
            "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
            "THE SOFTWARE."),
)
_COPYRIGHT = r"^(portions )?(copyright( c)?|c) [0-9]{4}( .*)?$|^all rights reserved$"

#: Whole texts by licence, each in the wordings in use, and the titles that may stand above any of them.
TEXTS = Path(__file__).with_name("license_texts.json")
_WORD, _SIGNS = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}\n]"


@cache
def whole_texts() -> tuple:
    """(license_id, text) of the known notices and whole texts in all their variants.

    Links count with http and https. As a text may be one line, copyright lines and all, each is also
    known as one.
    """
    out = dict.fromkeys(KNOWN)
    for name, entry in json.loads(TEXTS.read_text(encoding="utf-8")).items():
        for text in entry["texts"]:
            for linked in {text, text.replace("http:", "https:"), text.replace("https:", "http:")}:
                for title in ("", *entry["titles"]):
                    out[name, f"{title}\n{linked}"] = None
                    out[name, f"{title}\n{linked}".replace("\n", " ")] = None
    return tuple(out)


def _prose(mark: str) -> str:
    """Pattern of what follows ``mark`` inside the known licences, where it begins no copyright line."""
    follow: dict = {}
    for text in dict.fromkeys(t for _, t in whole_texts()):
        for m in re.finditer(rf"(?i)(?<![^\W_]){mark}(?=[\W_]+([^\W_]+)[\W_]+([^\W_]+)(?:[\W_]+([^\W_]+))?)", text):
            first, second, third = (x and x.lower() for x in m.groups())
            if first == "c" and not second.isdigit():  # the templates in the appendices of some licences
                follow.setdefault(first, set()).add(rf"{second}{_SIGNS}++{third}")
            elif first not in ("c", "yyyy") and not first.isdigit():
                follow.setdefault(first, set()).add(second)
    for new, old in (("license", "licence"), ("licensed", "licenced"), ("organization", "organisation")):
        for after in follow.values():
            after |= {old} if new in after else set()
        if new in follow:
            follow[old] = follow[new]
    return "|".join(f"{first}(?!{_WORD}){_SIGNS}*+(?:$|(?:{'|'.join(sorted(after))})(?!{_WORD}))"
                    for first, after in sorted(follow.items()))


@cache
def _copyright_lines() -> str:
    """Pattern of the lines that start with a copyright mark, whatever follows.

    Wherever a licence is wrapped, a line may start in the middle of a sentence on copyright, or with the
    item (c) of a list: those go on as the known licences do.
    """
    named = f"copyright(?!{_WORD})(?:{_SIGNS}*©|{_SIGNS}++(?={_WORD})(?!{_prose('copyright')}))"
    sign = rf"\(c\){_SIGNS}*+(?={_WORD})(?!{_prose(r'c')})"
    return rf"(?md)^{_SIGNS}*?(?:portions\s+)?(?:{named}|©|{sign})[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line with something left in it; none of a null text."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _copyright_lines(), "")
    plain = F.replace(plain, F.lit("©"), F.lit(" c "))
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", " ")
    plain = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, plain)
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(_COPYRIGHT))


def _whole(lines: Column) -> Column:
    """Canonical form of a whole text, in which a spelling of two words may stand across two lines."""
    pairs = [(old, new) for old, new in SPELLINGS if " " in old]
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), pairs, F.concat_ws(" ", lines))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_licenses(spark: SparkSession, texts=None) -> DataFrame:
    """(license_id, digest) of the given (license_id, text) pairs; of ``whole_texts`` without any."""
    rows = spark.createDataFrame(list(whole_texts() if texts is None else texts), "license_id string, text string")
    return rows.select("license_id", digest(_whole(canonical_lines(F.col("text")))).alias("digest")).distinct()


def license_matches(docs: DataFrame, texts=None) -> DataFrame:
    """Documents, and lines of documents, whose entire text is a known licence.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id, license_id, unit (``text``
    for whole documents, ``line`` for lines) and n, the number of matching units, a row for each doc_id,
    licence and unit that matches. Lines that start with a copyright mark count for nothing, wherever they
    stand; a copyright inside another line counts as text. Null and empty texts match nothing, nor do lines that are only signs
    or a copyright line. Repeated rows of a doc_id add up, rows without doc_id share a null one. An empty
    table gives an empty result.
    """
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines")).filter(F.size("lines") > 0)
    whole = F.struct(F.lit("text").alias("unit"), _whole(F.col("lines")).alias("form"))
    each = F.transform("lines", lambda x: F.struct(F.lit("line").alias("unit"), x.alias("form")))
    units = lines.select("doc_id", F.explode(F.concat(F.array(whole), each)).alias("u"))
    coded = units.select("doc_id", "u.unit", digest(F.col("u.form")).alias("digest"))
    # Each task adds up its own matches before they are shuffled.
    return (coded.join(F.broadcast(known_licenses(docs.sparkSession, texts)), "digest")
            .groupBy("doc_id", "license_id", "unit").agg(F.count(F.lit(1)).alias("n")))


def _sql_form(text: str) -> str:
    plain = f"regexp_replace(replace(lower(coalesce({text}, '')), '©', ' c '), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for old, new in SPELLINGS:
        plain = f"replace({plain}, '{old}', '{new}')"
    lines = f"list_transform(string_split({plain}, chr(10)), lambda x: trim(x, ' '))"
    return f"list_filter({lines}, lambda x: x <> '' AND NOT regexp_matches(x, '{_COPYRIGHT}'))"


def matches_sql(texts=KNOWN) -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in texts)
    return f"""
WITH known AS (SELECT DISTINCT license_id, array_to_string({_sql_form('text')}, ' ') AS form
               FROM (VALUES {rows}) AS k(license_id, text)),
lined AS (SELECT doc_id, {_sql_form('text')} AS lines FROM documents),
units AS (SELECT doc_id, 'text' AS unit, array_to_string(lines, ' ') AS form FROM lined WHERE len(lines) > 0
          UNION ALL SELECT doc_id, 'line', unnest(lines) FROM lined)
SELECT doc_id, license_id, unit, count(*) AS n FROM units JOIN known USING (form) GROUP BY ALL"""
