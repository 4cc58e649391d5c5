"""Licence scan: whole texts and whole lines against the digests of known licences."""

from __future__ import annotations

import itertools
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changemap.llm.text import aside

# Spellings that licence texts use for each other.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("fulfil ", "fulfill "), ("merchantibility", "merchantability"), ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("copyright holder", "copyright owner"), ("favour", "favor"),
)

# Public licence texts and the notices that stand for them.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
KNOWN = (
    ("MIT", MIT), ("MIT", f"MIT License\n{MIT}"), ("MIT", f"The MIT License (MIT)\n{MIT}"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC), ("ISC", f"ISC License\n{ISC}"), ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
)

# Published whole texts, a file a licence, and the headings that stand above texts without one.
TEXTS_VERSION = "1"
TEXTS = {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
HEADINGS = {
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License"),
    "Unlicense": ("The Unlicense",),
    "Zlib": ("zlib License", "The zlib License"),
}
# what follows is advice on how to apply the licence
LAST = "END OF TERMS AND CONDITIONS"


def _forms(name: str, text: str) -> list[str]:
    bodies = [text]
    if name.startswith("BSD"):  # items with marks, which go, or with numbers
        bare = re.sub(r"(?m)^[ \t]*(?:\*|\d\.) ", "* ", text)
        number = itertools.count(1)
        bodies = [bare, re.sub(r"(?m)^\* ", lambda _: f"{next(number)}. ", bare)]
    out = [f"{h}{body}" for body in bodies for h in ("", *(f"{x}\n" for x in HEADINGS.get(name, ())))]
    if LAST in text:
        out += [text[:text.index(LAST)], text[:text.index(LAST) + len(LAST)]]
    return out


KNOWN += tuple((name, form) for name, text in TEXTS.items() for form in _forms(name, text))

# digests held by every task
MAX_KNOWN = 10_000

# (pattern, replacement), applied in order; patterns mean the same to Java and to RE2
# comment marks and space before a line
LINE_START = r"\n(\(\*|[^\p{L}\p{N}\n©(])+"
# words behind "copyright" or "(c)" where a wrapped line or an item of a licence begins with it
AFTER_COPYRIGHT = (
    "notice", "holder", "owner", "law", "licen", "interest", "act ", "statement", "treat", "and ", "or ", "in ", "to ", "on ", "is ",
    "of ", "as ", "for ", "which ", "the program", "the software", "the library", "protect", "claim", "status", "permission",
    "disclaimer", "right", "doctrine", "assign", "year", "resulting", "infring", "material", "information", "applies", "are ", "will ",
)
AFTER_C = ("you ", "if ", "the ", "any ", "a ", "an ", "to ", "in ", "for ", "all ", "under ", "no ", "affirmer", "each ", "prohibit", "keep ", "use ")
COPYRIGHT_LINE = r"\n(copyright([ \t]|\(c\)|©|:)|\(c\)[ \t]*(©|copyright|[0-9])|\(c\)[ \t]|©)[^\n]*"
STEPS = (
    (LINE_START, "\n"),
    # a mark, which goes later, keeps these lines
    *((f"\\ncopyright {word}", f"\n.copyright {word}") for word in AFTER_COPYRIGHT),
    *((f"\\n\\(c\\) {word}", f"\n.c {word}") for word in AFTER_C),
    (COPYRIGHT_LINE, ""),
    (r"\nall rights reserved[^\p{L}\p{N}\n]*", ""),
    (r"https?://(www\.)?", ""),
    (r"&", " and "),
    (r"[^\p{L}\p{N}\n]+", " "),
    # spellings of two words, across the end of a line
    *((old.replace(" ", r" ?\n ?"), new) for old, new in SPELLINGS if " " in old.strip()),
    (r"fulfil ?\n", "fulfill\n"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_lines(text: Column) -> Column:
    """Lower case, no copyright lines, no marks, one spelling; the line ends stay."""
    out = F.translate(F.concat(F.lit("\n"), text), _UPPER, _LOWER)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _whole(lines: Column) -> Column:
    return F.btrim(F.regexp_replace(lines, r"[ \n]+", " "))


def canonical(text: Column) -> Column:
    """The canonical form of a whole text, on one line."""
    return _whole(canonical_lines(text))


def known(spark: SparkSession, texts=KNOWN) -> DataFrame:
    """``(digest, licence)``: one row a digest, of the first licence in order of names."""
    rows = spark.createDataFrame(list(texts), "licence string, text string")
    rows = rows.select(F.sha2(canonical("text"), 256).alias("digest"), "licence")
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, digests: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_licence``, the licence that the whole text is, or null, and
    ``line_licences``, the sorted licences that whole lines of it are.

    Digests of canonical forms are compared by a hash join; ``digests`` is a list of
    published licences, so Spark broadcasts it by its size. Only lines that name
    a licence word are hashed. A null or empty text is no licence. Rows keep their number, repeated
    ones too, and an empty table gives an empty table; a digest of several licences stands for the first in
    order of names; texts are looked at whole, of any length. Other columns pass through, whatever their
    names; both columns replace others of their names.
    """
    docs, new, back = aside(docs, {"_lines", "_digest", "_of_lines"})
    text_col = new.get(text_col, text_col)
    cols = [F.col(f"`{c}`") for c in docs.columns if c not in ("text_licence", "line_licences")]
    named = digests.where(F.col("digest") != F.sha2(F.lit(""), 256))
    listed = named.limit(MAX_KNOWN + 1).collect()
    if len(listed) > MAX_KNOWN:
        raise ValueError(f"over {MAX_KNOWN} licence digests")
    of = F.create_map(*[F.lit(x) for r in listed for x in (r["digest"], r["licence"])]) if listed else F.create_map().cast("map<string,string>")
    # each canonical form is made once: a generator keeps it from being copied
    a = docs.select(*cols, F.explode_outer(F.array(canonical_lines(F.col(text_col)))).alias("_lines"))
    lines = F.filter(F.split("_lines", "\n"), lambda x: x.contains("licens") | x.contains("permission"))
    found = F.filter(F.transform(lines, lambda x: of[F.sha2(F.btrim(x), 256)]), lambda x: x.isNotNull())
    a = a.select(*cols, F.sha2(_whole(F.col("_lines")), 256).alias("_digest"), F.array_sort(F.array_distinct(found)).alias("_of_lines"))
    out = a.join(named.select(F.col("digest").alias("_digest"), F.col("licence").alias("text_licence")), "_digest", "left")
    return back(out.select(*cols, "text_licence", F.coalesce("_of_lines", F.array().cast("array<string>")).alias("line_licences")))
