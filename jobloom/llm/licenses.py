"""Licence scans by sentence rules, in Spark SQL functions alone.

A text is cut into sentences; each normalised sentence that belongs to a known licence text
gets that sentence's identifier; a document's sequence of identifiers is matched against
ordered rules, longest first. A rule is the sequence of sentences of one licence text.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import lower_ascii, text_of

#: Ends of sentences: closing punctuation before white space, and empty lines.
CUT = r"[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*"
#: Comment markers at a line's start; a line of markers alone becomes an empty line.
MARKERS = r"(?<![^\n])[\x20\x09]*(?:#+|//[/!]*|/\*[*!]*|\*+/?|--+>?|;+|%+|<!--+)[\x20\x09]*"
#: What normalising turns into a space: ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Numbers of a list's entries, at the start of a line or of a sentence: no text. What stands before stays.
NUMBERS = r"(^|\n|[.!?;:][\x20\x09-\x0D])[\x20\x09]*\(?(?:[0-9]{1,2}|[a-h])[.)][\x20\x09]+"
#: In normalised sentences, places for names of holders: (what may stand there, what is put for it).
SLOTS = (
    (r"neither the names? of .{1,200}? nor the names of (?:(?:its|his|her|their) )?contributors", "neither the name of x nor the names of its contributors"),
    (r"provided by .{1,200}? as is", "provided by x as is"),
    (r"in no event shall .{1,200}? be liable", "in no event shall x be liable"),
)
#: Sentences of other kinds, such as names of holders, that may stand inside a rule's sequence.
MOST_BETWEEN = 3

# Licence texts and notices, as published.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL = (
    "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {1}General Public License for more details."
)
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_AS_IS),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0-or-later", _GPL.format(";", "", ";", "2")),
    ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-or-later", _GPL.format(":", "", ",", "3")),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("AGPL-3.0-or-later", _GPL.format(":", "Affero ", ",", "3")),
    ("LGPL-3.0-or-later", _GPL.format(":", "Lesser ", ",", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
]


def known_sentences(text: str) -> list[str]:
    """The normalised sentences of a known text; as ``sentences`` finds them in documents."""
    found = (re.sub(BETWEEN, " ", part).strip().lower() for part in re.split(CUT, re.sub(NUMBERS, r"\1", text)))
    return [s for s in map(_slotted, found) if s]


def _slotted(sentence: str) -> str:
    for pattern, by in SLOTS:
        sentence = re.sub(pattern, by, sentence)
    return sentence


def known(texts: list[tuple[str, str]] = TEXTS) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Sentence -> identifier, and the rules: (licence, its identifiers as " a b c "), longest first."""
    ids: dict[str, str] = {}
    rules = {}
    for licence, text in texts:
        own = [ids.setdefault(s, f"s{len(ids) + 1}") for s in known_sentences(text)]
        rules[f" {' '.join(own)} "] = licence
    return ids, sorted(((licence, rule) for rule, licence in rules.items()), key=lambda x: (-x[1].count(" "), x))


def telling_words(sentences: list[str]) -> list[str]:
    """Few words of which each of the sentences has one, so a text without any of them has none of the sentences.

    Taken from the sentences themselves: again and again the word that, weighed by its length, most of those left have.
    Sentences of a single word or of no word of three letters, such as the name at the end of a line of two sentences, say
    nothing by themselves: they count only in texts that have a word of another one.
    """
    left, chosen = [set(s.split()) - {"x", "its"} for s in sentences if " " in s and re.search("[a-z]{3}", s)], []
    while left := [s for s in left if s.isdisjoint(chosen)]:
        score = Counter(w for s in left for w in s)
        if not score:  # a sentence of nothing but a name's place: every text may have it
            return [""]
        chosen.append(max(score, key=lambda w: (score[w] * len(w), w)))
    return chosen


def uncommented(text: Column) -> Column:
    """``text`` without the comment markers at its lines' starts."""
    return F.regexp_replace(text, MARKERS, "")


def sentences(text: Column) -> Column:
    """The normalised sentences of a text."""
    return F.transform(F.split(F.regexp_replace(lower_ascii(text), NUMBERS, "$1"), CUT), normalised)


def normalised(part: Column) -> Column:
    """A lower-case part of a text with single spaces between its words, and names of holders replaced."""
    part = F.trim(F.regexp_replace(part, BETWEEN, " "))
    for pattern, by in SLOTS:
        part = F.regexp_replace(part, pattern, by)
    return part


def scan(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licences that each document's text states.

    Returns one row per document row: id, n_sentences (known sentences), sentence_ids (in text order, space-joined),
    n_licenses, licenses (distinct, sorted, comma-joined). Up to ``MOST_BETWEEN`` other
    sentences may stand between two of a rule. Where a licence names its holders, any name of up to 200 characters stands, and
    numbers of a list's entries are no text. Texts without any of the ``telling_words`` of the known sentences aren't cut. A rule takes its sentences, so a notice inside a
    longer text counts once. A line that is a whole known text counts even where the
    lines beside it have no closing punctuation. Comment markers at line starts are no text. A known
    sentence may be cut by one or two empty lines. Null text is empty; no row is dropped; there is no shuffle.
    """
    ids, rules = known(texts)
    lookup = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    whole = F.create_map(*(F.lit(x) for pair in {" ".join(known_sentences(t)): licence for licence, t in texts}.items() for x in pair))
    text = uncommented(F.col("text"))
    lines = F.transform(F.split(lower_ascii(text), "\n"), normalised)
    notices = F.filter(F.transform(lines, lambda s: F.element_at(whole, s)), lambda x: x.isNotNull())
    parts = sentences(text)
    cut = lambda i, n: F.element_at(lookup, F.array_join(F.slice(F.col("parts"), i + 1, n), " "))
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", "text", F.lower("text").alias("low"))
    # only texts that have a word of a known sentence are cut
    may = reduce(or_, (F.contains("low", F.lit(w)) for w in telling_words(list(ids))), F.lit(False))
    base = base.select("id", F.when(may, F.col("text")).alias("text")).select("id", "text", parts.alias("parts"))
    found = base.select(
        "id",
        F.transform("parts", lambda s, i: F.coalesce(F.element_at(lookup, s), cut(i, 2), cut(i, 3))).alias("ids"),
        F.array_distinct(notices).alias("notices"),
    )
    # known ones in order, with a bar wherever too many others stand between
    start = F.struct(F.lit(" ").alias("seq"), F.lit(0).alias("others"))
    step = lambda a, x: F.struct(
        F.when(x.isNull(), a["seq"]).otherwise(F.concat(a["seq"], F.when(a["others"] > MOST_BETWEEN, F.lit("| ")).otherwise(F.lit("")), x, F.lit(" "))).alias("seq"),
        F.when(x.isNull(), a["others"] + 1).otherwise(F.lit(0)).alias("others"),
    )
    sequence = F.aggregate(F.coalesce("ids", F.array().cast("array<string>")), start, step, lambda a: a["seq"])
    rule_table = F.array(*(F.struct(F.lit(licence).alias("licence"), F.lit(rule).alias("rule")) for licence, rule in rules))
    matched = F.aggregate(
        rule_table,
        F.struct(F.col("seq").alias("seq"), F.array().cast("array<string>").alias("hits")),
        lambda a, r: F.struct(F.replace(a["seq"], r["rule"], F.lit(" | ")).alias("seq"), F.when(F.contains(a["seq"], r["rule"]), F.array_append(a["hits"], r["licence"])).otherwise(a["hits"]).alias("hits")),
        lambda a: a["hits"],
    )
    with_seq = found.select("id", "notices", F.filter("ids", lambda x: x.isNotNull()).alias("known"), sequence.alias("seq"))
    licences = F.when(F.size("known") > 0, matched).otherwise(F.array().cast("array<string>"))
    all_ = with_seq.select("id", "known", F.array_sort(F.array_distinct(F.concat(licences, F.coalesce("notices", F.array().cast("array<string>"))))).alias("licences"))
    return all_.select(
        F.col("id").alias(id_col),
        F.coalesce(F.size("known"), F.lit(0)).cast("long").alias("n_sentences"),
        F.coalesce(F.array_join("known", " "), F.lit("")).alias("sentence_ids"),
        F.size("licences").cast("long").alias("n_licenses"),
        F.array_join("licences", ",").alias("licenses"),
    )
