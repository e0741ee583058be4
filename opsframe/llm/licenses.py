r"""Find licence texts by canonical digest.

A text becomes canonical by lower case, without copyright lines, with spellings that
licences treat as equal made the same, and with each run of anything but letters and
digits as one blank. The SHA-256 of the canonical form is looked up among the digests
of known licences. Looked up are the whole document and each of its parts, blocks
between empty lines and single lines, always as entire texts.

Known licences are a table of few rows; digests are made where a text is read and
nothing but hits is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment",
    "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize",
    "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "http": "https",
}

# Known licence texts and notices.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]
_COPYRIGHT = r"(?m)^[^\n\p{L}\p{N}]*(?:copyright\b[^\n]*(?:[0-9]|\(c\)|©)|\(c\)|©)[^\n]*$"
_BETWEEN = r"\n[\x20\x09\x0B\x0C]*\n[\x20\x09-\x0D]*"


def canonical(text: Column) -> Column:
    """The form whose digest is compared; empty where nothing is left."""
    plain = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    plain = F.regexp_replace(plain, _COPYRIGHT, " ")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    same = F.create_map(*[F.lit(word) for pair in SPELLINGS.items() for word in pair])
    words = F.transform(F.split(plain, " "), lambda w: F.coalesce(F.try_element_at(same, w), w))
    return F.array_join(words, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, null where that is empty."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    return spark.createDataFrame(texts, "license string, text string")


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document: doc_id, whole, licenses, n_parts.

    ``known`` is (license, text). ``whole`` is the licence that the entire document is
    (the first by name of several with one text; null if none), ``licenses`` all that
    the document or a part of it is, sorted and joined by commas, ``n_parts`` how many
    parts are one. A part is a line, or a block of several lines between empty ones. Known
    texts that are null or empty in canonical form say nothing; so do null and empty
    documents. Null doc_ids and repeated rows are documents of their own; texts of any
    length are taken whole; an empty table gives an empty result.
    """
    table = known.select(digest(F.col("text")).alias("digest"), "license").where("digest is not null and license is not null")
    table = table.groupBy("digest").agg(F.min("license").alias("license"))
    text = F.regexp_replace("text", r"\r\n?", "\n")
    blocks = F.filter(F.split(text, _BETWEEN), lambda b: F.trim(b, F.lit("\n")).contains("\n"))
    part = lambda is_whole: lambda t: F.struct(t.alias("text"), F.lit(is_whole).alias("is_whole"))
    parts = F.concat(
        F.array(F.struct(text.alias("text"), F.lit(True).alias("is_whole"))),
        F.transform(blocks, part(False)),
        F.transform(F.split(text, "\n"), part(False)),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The number holds within this one pass: parts and their document come from one task.
    each = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", "doc_id", F.explode(parts).alias("_part"))
    each = each.select("_row", "doc_id", "_part.is_whole", digest(F.col("_part.text")).alias("digest"))
    found = each.join(table, "digest", "left")
    return (
        found.groupBy("_row", "doc_id")
        .agg(
            F.max(F.when(F.col("is_whole"), F.col("license"))).alias("whole"),
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
            F.count(F.when(~F.col("is_whole"), F.col("license"))).alias("n_parts"),
        )
        .drop("_row")
    )


def _sql_canonical(text: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({text}), '\\r\\n?', '\n', 'g'), '{_COPYRIGHT}', ' ', 'g')"
    plain = f"trim(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    pairs = ", ".join(f"'{spelling}': '{same}'" for spelling, same in SPELLINGS.items())
    return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: coalesce(map {{{pairs}}}[w], w)), ' ')"


_VALUES = ", ".join(f"('{name}', '{text}')" for name, text in KNOWN)
SQL = f"""
with k as (select {_sql_canonical("text")} as form, min(license) as license from (values {_VALUES}) v(license, text) group by 1),
d as (select doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', '\n', 'g') as text from documents),
p as (
  select doc_id, text, true as is_whole from d
  union all select doc_id, unnest(string_split(text, '\n')), false from d
  union all select doc_id, b, false
    from (select doc_id, unnest(regexp_split_to_array(text, '{_BETWEEN}')) as b from d) where contains(trim(b, '\n'), '\n')
), f as (select doc_id, is_whole, {_sql_canonical("text")} as form from p)
select f.doc_id, max(case when is_whole then k.license end) as whole,
       coalesce(array_to_string(list_sort(list(distinct k.license) filter (k.license is not null)), ','), '') as licenses,
       count(case when not is_whole then k.license end) as n_parts
from f left join k on f.form = k.form and f.form <> '' group by 1
"""
