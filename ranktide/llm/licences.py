"""Licence scan by canonical digest.

A text is put in canonical form (case, punctuation, copyright lines, spelling
and white space no longer matter) and its SHA-256 is looked up among the
digests of known licences and licence notices, with one hash join.  Whole
texts are looked up; so are single lines, since corpora quote notices inside
longer pages.

Nulls and edges: a null or empty text, or one of punctuation only, has a null
digest and matches nothing; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import documents

# Texts of public licences and the notices by which works name them.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
KNOWN: list[tuple[str, str]] = [
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n" + ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n" + ZLIB), ("Unlicense", UNLICENSE),
    ("Apache-2.0", APACHE_NOTICE), ("GPL-3.0-or-later", GPL_NOTICE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
]
#: Whole texts, one file for each SPDX id.
TEXTS = Path(__file__).parent / "licence_texts"
#: Where the terms of a licence end and advice on its use begins; the terms alone are the licence, too.
END = re.compile(r"^[^\S\n]*END OF TERMS AND CONDITIONS[^\n]*$", re.M)
for _file in sorted(TEXTS.glob("*.txt")):
    _text = _file.read_text(encoding="utf-8")
    KNOWN += [(_file.stem, t) for t in [_text, *[_text[:k] for m in END.finditer(_text) for k in m.span()]]]
#: Ids named by a line only, besides those of the texts and notices above.
IDS = """AGPL-3.0-only AGPL-3.0-or-later GPL-2.0-or-later LGPL-2.0-or-later LGPL-2.1-or-later LGPL-3.0-or-later GPL-1.0-or-later GFDL-1.2-or-later GFDL-1.3-or-later CC-BY-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-3.0 CC-BY-SA-3.0 BSL-1.0 EPL-2.0 Artistic-2.0 0BSD MIT-0""".split()
KNOWN += [(i, f"SPDX-License-Identifier: {i}") for i in sorted({i for i, _ in KNOWN} | set(IDS))]
#: Spellings that licence comparison treats as one, in canonical form.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"), ("judgement", "judgment"),
    ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("organisation", "organization"), ("recognise", "recognize"), ("https", "http"),
]


def canonical(text: Column) -> Column:
    """The form whose digest is looked up: words of letters and digits with a space on either side."""
    c = F.regexp_replace(text, r"(?im)^[^\p{L}\p{N}\n]*(?:copyright\b(?!\s+(?:notices?|holders?|owners?|laws?|licen[cs]es?)\b)|\(c\)|©|all rights reserved[^\p{L}\p{N}\n]*$).*$", " ")  # whole copyright lines; a wrapped line of a text may begin with "copyright holders"
    c = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(c)


def with_digest(df: DataFrame, text: str) -> DataFrame:
    """Adds ``digest`` of the named column: null where nothing is left of the text."""
    df = df.withColumn("_canonical", canonical(F.col(text)))  # a step of its own, so that it is computed once
    return df.withColumn("digest", F.when(F.col("_canonical") != "", F.sha2("_canonical", 256))).drop("_canonical")


def hint(words: Column) -> Column:
    """A word that every spelling of a text with these canonical words holds: license, released, or its longest; null if there is none."""
    spelled = [w for _, b in SPELLINGS for w in b.split()]
    rest = F.filter(words, lambda w: ~w.isin(spelled))
    longest = F.array_max(F.transform(rest, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return F.when(F.array_contains(words, "license"), "license").when(F.array_contains(words, "released"), "released").otherwise(longest)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """digest, licence, hint: one row for each known text."""
    rows = with_digest(spark.createDataFrame(known, "licence string, text string"), "text").withColumn("words", F.array_distinct(F.split(canonical(F.col("text")), " ")))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"), F.first(hint(F.col("words"))).alias("hint"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``digest`` and ``licence`` of the whole text to (doc_id, text, ...).

    The known digests are a fixed list, so Spark sends them to the tasks and the texts stay where they are.
    """
    k = F.broadcast(known.select(F.col("digest").alias("k_digest"), "licence"))
    return with_digest(docs, "text").join(k, F.col("digest") == F.col("k_digest"), "left").drop("k_digest")


def scan_lines(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, licence for every line that is itself a known notice, one row for each pair.

    Lines without any of the hints of the known texts are not digested; a list without hints has all lines digested.
    """
    hints = [r["hint"] for r in known.select("hint").distinct().collect()] if "hint" in known.columns else [None]
    pattern = "" if None in hints else "|".join(sorted(h.replace("license", "licen[cs]e") for h in hints)) or "(?!)"
    lines = docs.filter(F.lower("text").rlike(pattern)).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = with_digest(lines.filter(F.lower("line").rlike(pattern)), "line")
    return lines.join(F.broadcast(known), "digest", "left").filter("licence is not null").select("doc_id", "licence").distinct()


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest and licence of the whole text, and the licences its lines name."""
    docs, known = documents(spark, sf_dir).select("doc_id", "text"), known_digests(spark)
    whole = scan(docs, known).select("doc_id", "digest", "licence")
    named = scan_lines(docs, known).groupBy("doc_id").agg(F.array_sort(F.collect_set("licence")).alias("named"))
    named = named.withColumn("named", F.array_join("named", ","))
    return whole.join(named.withColumnRenamed("doc_id", "n_doc_id"), F.col("doc_id").eqNullSafe(F.col("n_doc_id")), "left").select("doc_id", "digest", "licence", F.coalesce("named", F.lit("")).alias("named"))
