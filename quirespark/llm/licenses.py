"""License scans by canonical digest lookup, with DataFrame functions only.

A text is made canonical: A-Z lowered, copyright lines dropped, equivalent
spellings unified, everything but letters and digits turned into single spaces.
Its SHA-256 is looked up among the digests of known license texts and notices,
made the same way. Whole texts meet the table of digests in a hash join; the
table has a row a known text and is broadcast, its size being fixed by this
module. Notices that stand as a line of their own inside longer documents are
found by the same digests, line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: equivalent spellings: regular expression over lowered text, and what it becomes
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("sub-licens", "sublicens"), ("organis", "organiz"), ("recognis", "recogniz"), ("authoris", "authoriz"),
    ("favour", "favor"), ("honour", "honor"), ("judgement", "judgment"), ("merchantib", "merchantab"), ("non-commercial", "noncommercial"), ("non-infring", "noninfring"),
    ("copy-left", "copyleft"), ("fulfil ", "fulfill "), ("while ", "whilst "), ("https://", "http://"), ("&", " and "), ("v\\.? ?([0-9])", "version $1"), ("per cent", "percent"),
)
#: rows of a caller's table of digests (64 letters and a name each), which tasks hold as a map
MOST_KNOWN = 100_000
#: a word that every known text holds one of
STEMS = "licen[cs]|permi|public domain|warrant"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_3RD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

KNOWN = (
    ("MIT", _MIT), ("MIT", "The MIT License\n\n" + _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("0BSD", _0BSD), ("0BSD", "BSD Zero Clause License\n\n" + _0BSD),
    ("BSD-2-Clause", _BSD_TOP + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_TOP + _BSD_END),
    ("BSD-3-Clause", _BSD_TOP + _BSD_3RD + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_TOP + _BSD_3RD + _BSD_END),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB), ("Unlicense", _UNLICENSE), ("Apache-2.0", _APACHE),
    ("GPL-3.0-or-later", _GPL.format(3)), ("GPL-2.0-or-later", _GPL.format(2)),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This work is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("ISC", "SPDX-License-Identifier: ISC"),
)


#: a line that opens with a copyright mark or claims all rights, whatever follows on it
COPYRIGHT = r"^[ \t/*#;>-]*(?:(?:portions )?copyright\b(?: *(?:\(c\)|©|:|[0-9])).*|©.*|\(c\) *[0-9].*|all rights reserved\.?[ \t]*)$"
#: besides, a line that names a holder: copyright and no word that follows it inside known texts
HOLDER = (
    r"^[ \t/*#;>-]*(?:portions )?copyright\b[ \t]+(?!(?:notices?|holders?|and|laws?|disclaimer|owners?|ownership|interests?|on|permission|the (?:software|library|program|work)|licen[cs]e|treaty|are|is|if|in|to|for|doctrines?|statement|or|of|rights?|protection)\b)\S.*$"
)

#: digests of whole texts that are too long to stand here; each with what follows its terms and without
WHOLE = (
    ("Apache-2.0", "c5dac4348a7d36acbad686da4b896cfe6401bb1333cb065ec000031cac7a5501"),
    ("Apache-2.0", "138b93e853ec1c18e14c8cfe2b9fe385e5683f67bf0b00ab0ac57de99e08c764"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "f75ba27ad72fc3a55fbb9ebdea4448b578f3f7ef3f4269fb069eaf5e19c35e8e"),
    ("LGPL-2.0", "8f106f3528fe0d3acfdfed658d64d89fe6148d1265c0acb38ac115033bd30ada"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "b4fb601cd1d708fd4d48958cfaecb8bb919d60af95b4704afb85d1a886f8b303"),
    ("MPL-2.0", "cf4fdc07202ec6d5439f2c5b5c7fefab577065eb74b364e6c6166bad4880fc48"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "d7b4fa98c0201b101d2035c8ce5216ecd9d6468e8c8027a7ca54c3340f919d08"),
    ("GFDL-1.3", "438ae846690e15ae7957a7e816e4b191e39c6de2a061ce3d3573ba5a22d5e15a"),
    ("CC-BY-SA-4.0", "03d8a3b9c6db6790c3520a25812373d89c7f2a005ef01b18a0abcd015657a456"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text: what known texts and candidates are digested in."""
    low = F.translate(text, _UPPER, _LOWER)
    low = F.regexp_replace(low, "(?md)" + COPYRIGHT, "")
    low = F.regexp_replace(low, "(?md)" + HOLDER, "")
    for found, spelled in SPELLINGS:
        if any(c in found for c in "\\?(["):
            low = F.regexp_replace(low, found, spelled)
        else:
            low = F.replace(low, F.lit(found), F.lit(spelled))
    return F.trim(F.regexp_replace(low, r"[^a-z0-9\u0080-\x{10FFFF}]+", " "))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license) of every known text; one row a digest."""
    rows = spark.createDataFrame(list(KNOWN), "license string, body string")
    short = rows.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "license")
    return short.unionByName(spark.createDataFrame(list(WHOLE), "license string, digest string")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(doc_id, license, notices, n_notices) for every row.

    license is set where the whole text is a known one; notices lists, comma-
    joined in order, the licenses of lines that are known notices, n_notices
    their number. Null and empty texts match nothing. A text without any of the
    stems that every built-in text holds is not digested. Repeated rows give
    repeated results; extra columns are not read. ``known`` (digest, license)
    replaces the built-in table; it is broadcast, so more than ``MOST_KNOWN`` rows
    are refused. Lines and texts of any length are digested whole.
    """
    table = known_digests(spark) if known is None else known
    if known is not None and known.limit(MOST_KNOWN + 1).count() > MOST_KNOWN:
        raise ValueError(f"the table of known digests has more than {MOST_KNOWN} rows")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # a caller's own texts may hold none of the stems
    stem = f"(?i){STEMS}" if known is None else r"\S"
    asks = F.col("text").rlike(stem)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(stem))
    rows = rows.select("doc_id", F.when(asks, F.sha2(canonical(F.col("text")), 256)).alias("digest"), F.when(asks, F.transform(lines, lambda x: F.sha2(canonical(x), 256))).alias("lines"))
    whole = rows.join(F.broadcast(table), "digest", "left")
    # the table as one map value, for look-ups inside a row's list
    as_map = table.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("by_digest"))
    found = F.filter(F.transform(F.col("lines"), lambda d: F.try_element_at(F.col("by_digest"), d)), lambda x: x.isNotNull())
    out = whole.join(F.broadcast(as_map)).withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    return out.select("doc_id", "license", F.array_join("found", ",").alias("notices"), F.size("found").cast("long").alias("n_notices"))


def _oracle() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"

    mark = r"^[ \t/*#;>-]*(?:portions )?copyright\b[ \t]+"
    words = HOLDER[HOLDER.index("(?!") + 3 : HOLDER.index(r")\S.*$")]

    def canon(x: str) -> str:
        x = f"translate({x}, '{_UPPER}', '{_LOWER}')"
        x = f"regexp_replace({x}, {quote('(?m)' + COPYRIGHT)}, '', 'g')"
        # no look-ahead here: a holder's line is one that opens so and goes on with none of the words
        holder = f"regexp_matches(z, {quote(mark + chr(92) + 'S')}) AND NOT regexp_matches(z, {quote(mark + words)})"
        x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda z: CASE WHEN {holder} THEN '' ELSE z END), chr(10))"
        for found, spelled in SPELLINGS:
            regular = any(c in found for c in "\\?([")
            x = f"regexp_replace({x}, {quote(found)}, {quote(spelled.replace('$1', chr(92) + '1'))}, 'g')" if regular else f"replace({x}, {quote(found)}, {quote(spelled)})"
        return f"trim(regexp_replace({x}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"

    known = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN)
    whole = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in WHOLE)
    return f"""
WITH k AS (SELECT digest, min(license) AS license FROM (SELECT sha256({canon('body')}) AS digest, license FROM (VALUES {known}) v(license, body) UNION ALL SELECT digest, license FROM (VALUES {whole}) v(license, digest)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, sha256({canon('text')}) AS digest FROM d WHERE regexp_matches(text, '(?i){STEMS}')),
l AS (SELECT r, n, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d WHERE regexp_matches(text, '(?i){STEMS}')) WHERE regexp_matches(line, '(?i){STEMS}')),
f AS (SELECT l.r, string_agg(k.license, ',' ORDER BY l.n) AS notices, count(*) AS n_notices FROM (SELECT r, n, sha256({canon('line')}) AS digest FROM l) l JOIN k ON l.digest = k.digest GROUP BY l.r)
SELECT d.doc_id, k.license, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0) AS n_notices FROM d LEFT JOIN w ON d.r = w.r LEFT JOIN k ON w.digest = k.digest LEFT JOIN f ON d.r = f.r
"""


ORACLE_OP2 = _oracle()
