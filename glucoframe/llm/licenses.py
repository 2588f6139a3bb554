"""Licence scan: canonical digests of whole texts, looked up among those of known licences."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoframe.session import broadcast_if_small, cut_lineage

MOST_BROADCAST = 100_000

# Licence texts and the short notices by which works name their licence, as published.
_AS_IS_COPYRIGHT_HOLDERS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": (
        "MIT License\n\nCopyright (c) 2000 Holder\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        "ISC License\n\nCopyright (c) 2000 Holder\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
        "Released under the ISC License.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
    ),
    "BSD-2-Clause": (
        "BSD 2-Clause License\n\nCopyright (c) 2000, Holder\n\n" + _BSD_START + _AS_IS_COPYRIGHT_HOLDERS,
        "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "BSD 3-Clause License\n\nCopyright (c) 2000, Holder\n\n" + _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS_COPYRIGHT_HOLDERS,
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
}


def _full_texts() -> dict[str, tuple[str, ...]]:
    """The licences of the folder license_texts, each whole and, where it has an appendix on how to apply it, without that."""
    found = {}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        found[path.stem] = (text, *([terms, terms + end] if end else []))
    return found


KNOWN |= {name: KNOWN.get(name, ()) + texts for name, texts in _full_texts().items()}
# Spellings that count as one: license/licence, favor/favour, organize/organise, center/centre, acknowledgment/acknowledgement,
# noncommercial/non-commercial, merchantability/merchantibility, willful/wilful, http/https. The letters in which they
# differ are taken out, so canonical text is made for comparing, not for reading.
EQUIVALENT = r"(licen)[cs](?:e|ing)|(fav|hon|lab)ou?r|(author|organ|recogn)i[sz]|(cent)(?:er|re)|(acknowledg|judg)ement|(non) commercial|(merchant)[ai]bility|(wil)l?ful|(http)s"
_KEEP = "$1$2$3$4$5$6$7$8$9"
# A copyright line: the word or sign before a year, or "all rights reserved", from the start of a line to its end. The sign
# is one character here, (c) is made one beforehand. Every repetition is of single characters and gives nothing back, so that
# the expression needs neither a stack nor more than one pass, whatever the line holds.
COPYRIGHT = r"(^|\n)(?:[^a-z0-9\n]*+copyright[^a-z0-9\n]*+[0-9]{4}|[^a-z0-9\n©]*+©[^a-z0-9\n]*+[0-9]{4}|[^a-z0-9\n]*+all rights reserved)[^\n]*+"
# Letters beyond ASCII are part of a word and stay.
PUNCTUATION = r"[^a-z0-9\x80-\x{10FFFF}\n]+"


def canonical_lines(text: Column) -> Column:
    """Lower case (A-Z), without copyright lines, punctuation as one space, equivalent spellings as one; © and (c) are one. Lines stay."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    signed = F.replace(lower, F.lit("(c)"), F.lit("©"))
    spoken = F.replace(F.regexp_replace(signed, COPYRIGHT, "$1"), F.lit("©"), F.lit(" c "))
    cleaned = F.regexp_replace(spoken, PUNCTUATION, " ")
    return F.regexp_replace(cleaned, EQUIVALENT, _KEEP)


def canonical(lines: Column) -> Column:
    """Canonical lines as one text."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """(known, license, size) for every known text, size in code points; of licences with the same canonical text the
    first by name."""
    rows = spark.createDataFrame([(name, text) for name, texts in known.items() for text in texts], "license string, text string")
    canon = rows.select("license", canonical(canonical_lines(F.col("text"))).alias("text"))
    return canon.groupBy(F.sha2("text", 256).alias("known")).agg(F.min("license").alias("license"), F.first(F.char_length("text")).alias("size"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", known: Mapping[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    """One row per document: doc_id, text_digest, license, notices.

    `license` is the licence whose text the whole document is, null if none. `notices` lists the licences named by
    lines that are, each by itself, an entire known text (sorted, distinct; empty if none).

    Texts are read once: the digest of the whole and those of lines as long as a known text go to a narrow table in the
    shared folder (a line of another length matches nothing). They are looked up by hash joins; the known side is
    broadcast up to MOST_BROADCAST texts. Lines that hit are reduced to one row per canonical text before the shuffle.

    Null or empty texts and texts of punctuation have the digest of the empty text and match nothing. Null or repeated
    ids: every row is judged by its text. Further columns are ignored; an empty table gives no rows.
    """
    digests = cut_lineage(known_digests(docs.sparkSession, known))
    sizes = sorted({row.size for row in digests.select("size").collect()})
    digests = broadcast_if_small(digests.drop("size"), MOST_BROADCAST)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), canonical_lines(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))).alias("lines"))
    trimmed = F.transform(F.split("lines", "\n"), lambda line: F.trim(line))
    possible = F.filter(trimmed, lambda line: (line != "") & F.array_contains(F.lit(sizes), F.char_length(line)))
    read = cut_lineage(rows.select(
        "doc_id", F.sha2(canonical(F.col("lines")), 256).alias("text_digest"), F.transform(possible, lambda line: F.sha2(line, 256)).alias("found")
    ))
    line = read.select(F.col("text_digest").alias("of"), F.explode("found").alias("line"))
    notices = line.join(digests, F.col("line") == F.col("known")).groupBy("of").agg(F.sort_array(F.collect_set("license")).alias("notices"))
    whole = read.select("doc_id", "text_digest").join(digests, F.col("text_digest") == F.col("known"), "left")
    result = whole.join(notices, F.col("text_digest") == F.col("of"), "left")
    return result.select("doc_id", "text_digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
