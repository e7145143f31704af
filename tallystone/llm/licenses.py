"""License scans by canonical digest, in DataFrame functions alone.

A text is brought to a canonical form: ASCII lower case, copyright statements out, equivalent
spellings made one, punctuation and white space as single spaces. The SHA-256 of the whole
canonical text is hash-joined to the digests of known licences; a text's lines are held
against the known notices in the same form.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spellings that mean the same in licences (fixed values): pattern of whole words, and what it becomes.
EQUIVALENT = [
    ("licen[cs](e|es|ed|ing|ee|or)", r"licens\1"),
    ("sub[ -]licens(e|es|ed|ing)", r"sublicens\1"),
    ("non[ -]commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("(author|organ|recogn|util|initial)is(e|es|ed|ing|ation)", r"\1iz\2"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("copyright owner(s?)", r"copyright holder\1"),
]
#: Words after 'copyright' that go on with a sentence; any other is the name in a statement.
SPARED = (
    "notices? holders? owners? laws? licen[cs]\\w* legends? statements? disclaimers? treat\\w* conventions? acts? interests? protections? permissions? claims? rights? patents? trademarks? ownership status "
    "and or in is on of to for the that this these those which was were are as at be an any its it if not with from under may shall must will can such also "
    "infring\\w* relat\\w* proprietary policy policies information conditions? terms? list material works? subsist\\w* exceptions? limitations? duration appear\\w* itself over all including resulting details solely doctrines purposes"
).replace(" ", "|")
#: Lines that begin a copyright statement: the word with a sign or a year, or a sign with a year.
STATEMENT = r"^[^a-z0-9]*(?:copyright[^a-z0-9]*\(c\)|copyright[^a-z0-9]*©|copyright[^a-z0-9]*(?:\d{4}|yyyy|years?\b)|\(c\)[^a-z0-9]*(?:copyright\b|\d{4})|©)"
#: The word with a name; not where a sentence goes on, unless a year or a sign says that it is a name after all.
NAMED_STATEMENT, SPARED_LINE = r"^[^a-z0-9]*copyright[ \t:]+[\[<{]?[a-z\x{80}-\x{10FFFF}]", rf"^[^a-z0-9]*copyright[ \t:]+[\[<{{]?(?:{SPARED})\b"
DATED, LAWFUL = r"\b(?:19|20)\d\d\b[^a-z0-9]*$|\(c\)|©", r"^[^a-z0-9]*copyright[ \t:]+(?:treat\w*|laws?|acts?|conventions?)\b"
#: '(c)' with a name: only in texts without a list item '(b)', where it isn't an item itself.
SIGNED_LINE = r"^[^a-z0-9]*\(c\)"
#: A statement goes on over lines of text, up to an empty one or to one that begins as a licence does; so many at most.
GOES_ON = 20
_STARTS, _STOPS = "\x01", "\x02"
_WHOLE_STATEMENT = f"{_STARTS}(?:\n[^{_STARTS}{_STOPS}\n][^\n]*){{0,{GOES_ON}}}"
#: Names in BSD licences, which their users put in, in the canonical form; of any length.
NAMED = [
    ("neither the names? of [^\n]+? nor the names of (?:its|their|the|any) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("this software is provided by [^\n]+? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    ("in no event shall [^\n]+? be liable for any direct indirect", "in no event shall the copyright holder or contributors be liable for any direct indirect"),
]
BLANKS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

#: Words that EQUIVALENT can write: a line may hold another spelling.
_RESPELT = re.compile("noncommercial|acknowledgment|iz(e|ation|ing)|favor|behavior|fulfillment|judgment|while|percent|copyright|holder|contributors|^names?$|^its$")

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Notices (fixed values), each a whole text, beside the shipped table.
_FIRST = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Public-Domain", "This work is in the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
]
#: Known licences and notices, each a whole text: those above and the shipped table.
KNOWN = _FIRST + license_table.texts(_MIT, _ISC) + license_table.notices()


def openers(known: list[tuple[str, str]]) -> str:
    """A pattern of lines that begin as a known text does, or as its first paragraphs and those after its statements do."""
    words = set()
    for _, text in known:
        parts = [p.strip() for p in re.split(r"\n\s*\n", text.lower()) if p.strip()]
        after = [b for a, b in zip(parts, parts[1:], strict=False) if re.match(STATEMENT, a)]
        words |= {m[1] for p in [*parts[:3], *after] if not re.match(STATEMENT, p) and (m := re.match(r"[^a-z0-9]*([a-z]+)", p))}
    return rf"^[^a-z0-9]*(?:{'|'.join(sorted(words | {'all'}))})\b"


OPENERS = openers(KNOWN)


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.translate(text, UPPER + _STARTS + _STOPS, LOWER + "  ")
    may_sign = low.contains("(c)") & ~low.contains("(b)")

    def marked(line: Column, signs: bool) -> Column:
        statement = line.rlike(STATEMENT) | (line.rlike(NAMED_STATEMENT) & (~line.rlike(SPARED_LINE) | (line.rlike(DATED) & ~line.rlike(LAWFUL))))
        statement = statement | line.rlike(SIGNED_LINE) if signs else statement
        return F.when(statement, F.lit(_STARTS)).when(line.rlike(f"^{BLANKS[:-1]}*$") | line.rlike(OPENERS), F.concat(F.lit(_STOPS), line)).otherwise(line)

    lines = F.split(low, "\n")
    # two forms, as what a lambda asks of the whole text is asked for each line
    lines = F.when(may_sign, F.transform(lines, lambda x: marked(x, True))).otherwise(F.transform(lines, lambda x: marked(x, False)))
    without = F.regexp_replace(F.array_join(lines, "\n"), _WHOLE_STATEMENT, "\n")
    out = F.when(low.contains("copyright") | low.contains("(c)") | low.contains("©"), without).otherwise(low)
    out = plain = F.trim(F.regexp_replace(out, BLANKS, " "))
    for pattern, becomes in EQUIVALENT:
        out = F.regexp_replace(out, rf"\b{pattern}\b", becomes.replace("\\", "$"))
    for pattern, becomes in NAMED:
        out = F.regexp_replace(out, rf"\b{pattern}\b", becomes)
    # one look at a text tells whether any spelling needs changing
    return F.when(plain.rlike("|".join([*(p for p, _ in EQUIVALENT), "neither the name", "this software is provided", "in no event shall"])), out).otherwise(plain)


def _forms(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> list[tuple[str, str, str]]:
    """(form, digest, license) of known texts: one row a form, the first name of equals."""
    form = canonical(F.col("text"))
    listed = spark.createDataFrame(KNOWN if known is None else known, "license string, text string").groupBy(form.alias("form")).agg(F.min("license").alias("license"))
    return sorted((r.form, r.digest, r.license) for r in listed.withColumn("digest", F.sha2("form", 256)).collect())


def _fixed(value: dict, kind: str) -> Column:
    """A dictionary as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _digests(spark: SparkSession, forms: list[tuple[str, str, str]]) -> DataFrame:
    return spark.range(1).select(F.explode(_fixed({d: n for _, d, n in forms}, "map<string,string>")).alias("digest", "license"))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of known texts; one row a digest, the first name of equals."""
    return _digests(spark, _forms(spark, known))


def mark(form: str) -> str:
    """A pattern found in the lower case of every line that has this form; empty if none is sure."""
    words = form.split()
    if any("licens" in w for w in words):
        return "licen[cs]"
    return max((w for w in words if not _RESPELT.search(w)), key=len, default="")


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest, license and notices of every row.

    ``license`` names the known licence whose canonical text is the whole text's, else null;
    ``notices`` lists, sorted, the distinct licences that single lines of the text name.
    Null and empty texts have the digest of nothing and no licence. Ids may be null or repeat; each of
    repeated rows is scanned, texts of any length whole; other columns are not looked at, and an empty table
    gives no rows. The known list is a parameter of the job, so its broadcast doesn't grow with the data.
    """
    spark = docs.sparkSession
    forms = _forms(spark, known)
    digests = _digests(spark, forms)
    named = [(f, d, n) for f, d, n in forms if f]
    by_start: dict[str, dict[str, str]] = {}
    for _, d, n in named:
        by_start.setdefault(d[:2], {})[d] = n
    lookup = _fixed(by_start, "map<string,map<string,string>>")  # a map is searched from its beginning, so two short ones
    # only lines that could be a notice are brought to canonical form
    marks = sorted({mark(f) for f, _, _ in named})
    could = F.lit(bool(named)) if "" in marks or not marks else None
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.translate(x, UPPER, LOWER).rlike("|".join(marks)) if could is None else could)
    found = F.transform(F.transform(lines, lambda x: F.sha2(canonical(x), 256)), lambda d: F.try_element_at(F.try_element_at(lookup, F.substring(d, 1, 2)), d))
    notices = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text")), 256).alias("digest"), notices.alias("notices"))
    return base.join(F.broadcast(digests), "digest", "left").select("doc_id", "digest", "license", F.concat_ws(",", "notices").alias("notices"))


def scan_sql() -> str:
    """The same in DuckDB SQL over ``documents``, from the same list, patterns and spellings."""

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        low = f"translate(coalesce({x}, ''), {quote(UPPER)} || chr(1) || chr(2), {quote(LOWER + '  ')})"
        is_like = lambda p: f"regexp_matches(s, {quote(p)})"
        statement = f"{is_like(STATEMENT)} OR ({is_like(NAMED_STATEMENT)} AND (NOT {is_like(SPARED_LINE)} OR ({is_like(DATED)} AND NOT {is_like(LAWFUL)})))"
        stop = f"{is_like(f'^{BLANKS[:-1]}*$')} OR {is_like(OPENERS)}"
        marked = lambda test: f"list_transform(string_split({low}, chr(10)), lambda s: CASE WHEN {test} THEN chr(1) WHEN {stop} THEN chr(2) || s ELSE s END)"
        lines = f"CASE WHEN contains({low}, '(c)') AND NOT contains({low}, '(b)') THEN {marked(f'{statement} OR {is_like(SIGNED_LINE)}')} ELSE {marked(statement)} END"
        out = f"regexp_replace(array_to_string({lines}, chr(10)), {quote(_WHOLE_STATEMENT)}, chr(10), 'g')"
        out = f"trim(regexp_replace({out}, {quote(BLANKS)}, ' ', 'g'))"
        for pattern, becomes in [*EQUIVALENT, *NAMED]:
            out = f"regexp_replace({out}, {quote(rf'\b{pattern}\b')}, {quote(becomes)}, 'g')"
        return out

    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN)
    return f"""
WITH known AS (SELECT {form('t')} AS form, min(n) AS license FROM (VALUES {rows}) v(n, t) GROUP BY 1),
base AS (SELECT row_number() OVER () AS k, doc_id, text, sha256({form('text')}) AS digest FROM documents),
lines AS (SELECT k, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM base),
named AS (SELECT k, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT k, {form('line')} AS form FROM lines) JOIN known USING (form) WHERE form <> '' GROUP BY k)
SELECT b.doc_id, b.digest, d.license, coalesce(n.notices, '') AS notices
FROM base b LEFT JOIN (SELECT sha256(form) AS digest, license FROM known) d ON b.digest = d.digest LEFT JOIN named n ON b.k = n.k
"""
