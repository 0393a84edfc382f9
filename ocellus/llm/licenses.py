"""Licence scan by canonical digests of whole texts."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.llm.common import text_or_empty

# Spellings that count as equal, as patterns over lower-case text
EQUIVALENT = {
    r"\b(sub)?[- ]?licenc(e[sder]?|ees?|ors?|ing)\b": "$1licens$2", r"\bsub[- ]licen": "sublicen",
    r"\b(author|capital|categor|emphas|initial|maxim|optim|organ|real|recogn|util)is(e[sd]?|ing|ations?)\b": "$1iz$2",
    r"\b(acknowledg|judg)ement": "$1ment", r"\b(fav|lab)our": "$1or", r"\bmerchantibility\b": "merchantability",
    r"\bnon[- ](infring|commercial|exclusive)": "non$1", r"\bcopyright owner": "copyright holder", r"\bhttps:": "http:",
    r"\bneither the names? of [^.]{1,150}? nor the names? of (its|their) contributors\b": "neither the name of the copyright holder nor the names of its contributors",
}
# Texts of known licences
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_NO_ENDING = re.compile(r"(?is)(?:how to apply these terms|appendix: how to apply|addendum: how to use|exhibit a\b).*\Z")


def _known() -> dict[str, tuple[str, ...]]:
    """Texts by SPDX name (of the GNU family without "-only" or "-or-later"), each whole and without its advice on how to apply it."""
    out = {"MIT": (MIT, MIT.replace("this permission notice shall", "this permission notice (including the next paragraph) shall"))}
    for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = f.read_text()
        at = [m.start() for m in _NO_ENDING.finditer(text)]
        out[f.stem] = (text, text[: at[0]]) if at and at[0] > len(text) // 2 else (text,)
    return out


KNOWN = _known()
# A title line; a line that names a holder; what may stand before the terms. Wrapped lines of the terms may begin with "copyright".
_TITLE = r"[^\s\w]*(?:[^\s]*[^\s.][ \t]+){0,7}[^\s\w]*licen[sc]e[^\s\w]*(?:[ \t]*\([^)\n]{1,30}\)|[ \t,-]*(?:version|v)?[ \t]*\d[\d.]*[^\n]{0,30})?[^\w\n]*"
_HOLDER = r"(?m)^[ \t/*#;>-]*(?:copyrights?[ \t]*(?:\(c\)|©|\d{4}|[\[<{:])|\(c\)[ \t]*(?:copyright|\d{4})|©|all rights reserved\.?[ \t]*$).*$"
_HEAD = rf"\A(?:\s*(?:copyright\b[^\n]*|\(c\)[^\n]*|all rights reserved[^\n]*|{_TITLE})(?:\n|\z)){{1,20}}"


#: Pattern and replacement, in turn, over lower-case text. No look-around, so that any engine of regular expressions takes them.
STEPS = [
    (r"\r\n?", "\n"), (_HOLDER, " "), (_HEAD, " "), (r"(?m)^[ \t]*\d{1,2}[.)][ \t]", " "), (r"[\x09-\x0D\x20]+", " "),
    *EQUIVALENT.items(), (r"[^\p{L}\p{N}]+", " "),
]


def canonical(text: Column) -> Column:
    """Lower case without copyright lines, title line "... license", numbers of list items, punctuation and runs of white space; equal spellings made one."""
    x = F.lower(text)
    for pattern, same in STEPS:
        x = F.regexp_replace(x, pattern, same)
    return F.trim(x)


def bodies(known: dict[str, str | tuple[str, ...]]) -> list[tuple[str, str]]:
    return [(k, body) for k, v in sorted(known.items()) for body in ((v,) if isinstance(v, str) else v)]


def scan_sql(known: dict[str, str | tuple[str, ...]]) -> str:
    """``license_scan`` of the table ``documents`` in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"lower({x})"
        for pattern, same in STEPS:
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(same.replace('$', chr(92)))}, 'g')"
        return f"sha256(trim({x}))"

    rows = ", ".join(f"({quoted(k)}, {quoted(body)})" for k, body in bodies(known))
    return f"""
        WITH k AS (SELECT {form("body")} AS canonical_sha256, min(license) AS license FROM (VALUES {rows}) v(license, body) GROUP BY 1),
             d AS (SELECT doc_id, {form("coalesce(text, '')")} AS canonical_sha256 FROM documents)
        SELECT d.doc_id, d.canonical_sha256, k.license FROM d LEFT JOIN k USING (canonical_sha256)"""


def license_scan(df: DataFrame, known: dict[str, str | tuple[str, ...]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, canonical_sha256, license (null if none of ``known``).

    A null or empty text counts as empty and has none; whole texts are compared, so
    a licence inside a longer text is not found; repeated rows and ids are scanned
    each for itself. Of two names with one canonical text the first by name is
    given. An empty table gives no rows; other columns are not read.
    """
    table = df.sparkSession.createDataFrame(bodies(known), "license string, body string")
    table = table.select("license", F.sha2(canonical(F.col("body")), 256).alias("canonical_sha256")).groupBy("canonical_sha256").agg(F.min("license").alias("license"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(canonical(text_or_empty(text_col)), 256).alias("canonical_sha256"))
    return rows.join(F.broadcast(table), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license")  # as many rows as known licences
