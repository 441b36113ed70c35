"""License scans: canonical digests of whole texts, joined to the digests of known licences.

A text is made canonical by expressions alone: lower case, copyright lines out, equivalent spellings to one
spelling, punctuation to spaces, white space to single spaces. Its SHA-256 is looked up in the known digests by a
hash join whose known side is this module's list (a fixed, small number of rows, so it is broadcast) and, if it is given,
a table of further texts of any size. The same is
done for each whole line against known notices of one line, row by row, without exploding the text.

Texts that are null are empty and match nothing; every row of the input comes back once, whatever its id, and rows
may repeat. Columns of the input that are called like a result come back as ``in_`` and their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The wording of public licences.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

LICENSES: dict[str, tuple[str, ...]] = {
    "MIT": (_MIT_BODY, "MIT License\n\n" + _MIT_BODY, "The MIT License\n\n" + _MIT_BODY, "The MIT License (MIT)\n\n" + _MIT_BODY),
    "ISC": (_ISC_BODY, "ISC License\n\n" + _ISC_BODY),
    "BSD-2-Clause": (_BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    "BSD-3-Clause": (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    "Zlib": (_ZLIB, "zlib License\n\n" + _ZLIB),
    "Apache-2.0": (_APACHE_NOTICE,),
    "Unlicense": (_UNLICENSE,),
    "0BSD": (_0BSD, "BSD Zero Clause License\n\n" + _0BSD, "Zero-Clause BSD\n\n" + _0BSD),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST,),
}
# Canonical digests of long texts as published, whole and up to the end of their terms.
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
        "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",
        "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f",
    ),
    "GPL-2.0": (
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
    ),
    "GPL-3.0": (
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
    ),
    "LGPL-2.1": (
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-2.0": (
        "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ),
    "Artistic-1.0-Perl": (
        "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    ),
    "GFDL-1.3": (
        "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
    ),
}
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "ISC": ("Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
}
_GNU = (
    ("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",)),
)
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_CC_SCOPE = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_UNDER = ("Licensed under", "This work is licensed under")


def _add(name: str, *lines: str) -> None:
    NOTICES[name] = tuple(dict.fromkeys(NOTICES.get(name, ()) + lines))


for _short, _long, _versions in _GNU:
    for _v in _versions:
        _plain = _v.removesuffix(".0")
        _names = [f"the {_long}{_sep}{_w}" for _sep in (", version ", " version ", " v") for _w in dict.fromkeys((_plain, _v))]
        _add(
            f"{_short}-{_v}", *[f"{_by} {_n}{_later}" for _by in (*_UNDER, "Released under") for _n in _names for _later in ("", " or later")],
            *[f"SPDX-License-Identifier: {_short}-{_v}{_end}" for _end in ("", "-only", "-or-later")],
        )
for _by in (*_UNDER, "Released under"):
    _add("MPL-2.0", *[f"{_by} the Mozilla Public License{_sep}2.0" for _sep in (", version ", " version ", ", v. ", " ")])
    _add("Unlicense", f"{_by} the Unlicense")
    _add("MIT", f"{_by} the MIT License")
    _add("Apache-2.0", f"{_by} the Apache License, Version 2.0")
_add("MPL-2.0", "SPDX-License-Identifier: MPL-2.0")
_add("Unlicense", "SPDX-License-Identifier: Unlicense")
_add("CC0-1.0", *[f"{_by} CC0 1.0" for _by in _UNDER], "SPDX-License-Identifier: CC0-1.0")
for _short, _long in _CC:
    for _v, _scope in _CC_SCOPE.items():
        _name = _long if _v == "4.0" else _long.replace("NoDerivatives", "NoDerivs")
        _add(
            f"CC-{_short}-{_v}", *[f"{_by} CC {_short} {_v}" for _by in _UNDER], f"SPDX-License-Identifier: CC-{_short}-{_v}",
            *[f"{_by} a Creative Commons {_name} {_v}{_end} License" for _by in _UNDER for _end in ("", f" {_scope}")],
        )
#: Every notice's canonical line holds this, so lines without it needn't be hashed.
NOTICE_STEM = "license"
#: Equivalent spellings, the one used and the ones replaced by it.
SPELLINGS = (
    ("license", "licence"), ("sublicense", "sub-license"), ("acknowledgment", "acknowledgement"), ("organization", "organisation"),
    ("authorization", "authorisation"), ("authorized", "authorised"), ("recognize", "recognise"), ("utilization", "utilisation"),
    ("noninfringement", "non-infringement"), ("noncommercial", "non-commercial"), ("merchantability", "merchantibility"),
    ("favor", "favour"), ("copyright holder", "copyright owner"), ("http:", "https:"), ("percent", "per cent"),
)
#: Copyright lines, with whatever comment marks open them: the word with a sign, year, placeholder or company behind it, or a sign
#: with the word or a year; lines of a licence's own text that happen to begin with the word stay.
COPYRIGHT = (
    r"(^|\n)[ \t*#/;-]*(portions )?(copyright[ \t:,]*(\(c\)|\x{a9}|&copy;|[\[<{]*(year|yyyy|[12][0-9]{3}))|copyright[ \t,:][^\n;]{0,60}[ \t,-]((19|20)[0-9]{2})|"
    r"copyright[ \t][^\n,;.]{1,60}[ \t,]+(inc|ltd|llc|corp|co|gmbh)\.|"
    r"\(c\)[ \t]*(copyright|[12][0-9]{3})|(\x{a9}|&copy;))[^\n]*"
)
PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f\x{2013}\x{2014}\x{2018}\x{2019}\x{201c}\x{201d}\x{2026}]+"


RESULTS = ("canonical_sha256", "license_id", "notices")


def _canonical_lines(text: Column) -> Column:
    """Canonical text that still has its line feeds; lines may begin and end with a space."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, by in ((r"\r\n?", "\n"), (COPYRIGHT, "\n")):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(by))
    out = F.replace(out, F.lit("all rights reserved"), F.lit(""))
    for used, other in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(used))
    return F.regexp_replace(out, F.lit(PUNCTUATION), F.lit(" "))


def _whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, F.lit("[ \n]+"), F.lit(" ")))


def _known(spark: SparkSession, texts: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(name, t) for name, every in texts.items() for t in every]
    known = spark.createDataFrame(rows, "license_id string, t string")
    return known.select("license_id", F.sha2(_whole(_canonical_lines(F.col("t"))), 256).alias("known_sha256")).dropDuplicates(["known_sha256"])


def known_digests(spark: SparkSession) -> DataFrame:
    """(license_id, known_sha256) of this module's licences."""
    fixed = spark.createDataFrame([(name, d) for name, every in DIGESTS.items() for d in every], "license_id string, known_sha256 string")
    return _known(spark, LICENSES).unionByName(fixed)


def scan(docs: DataFrame, text: str = "text", more: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``canonical_sha256``, ``license_id`` (of the whole text, else null) and ``notices`` (licences of
    known one-line notices among its lines, ascending; empty if none).

    ``more``: further known texts (license_id, text), of any number; of texts alike the least id counts.
    """
    spark = docs.sparkSession
    notices = {r.known_sha256: r.license_id for r in _known(spark, NOTICES).collect()}
    longest = max(len(t) for every in NOTICES.values() for t in every)
    names = F.create_map(*[F.lit(x) for pair in sorted(notices.items()) for x in pair])
    lined = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}" if c in RESULTS else c) for c in docs.columns], _canonical_lines(F.col(f"`{text}`")).alias("_lic_lines"))
    # a canonical line longer than any notice, or without what all of them hold, can't be one
    short = F.filter(F.transform(F.split("_lic_lines", "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) <= longest) & F.contains(x, F.lit(NOTICE_STEM)))
    hits = F.filter(F.transform(short, lambda x: F.try_element_at(names, F.sha2(x, 256))), lambda x: x.isNotNull())
    out = lined.withColumns({"canonical_sha256": F.sha2(_whole(F.col("_lic_lines")), 256), "notices": F.array_sort(F.array_distinct(hits))}).drop("_lic_lines")
    known = known_digests(spark)
    if more is not None:
        theirs = more.select("license_id", F.sha2(_whole(_canonical_lines(F.col("text"))), 256).alias("known_sha256"))
        known = known.unionByName(theirs)
    known = known.groupBy(F.col("known_sha256").alias("_lic_known")).agg(F.min("license_id").alias("license_id"))
    # the module's own list is a fixed, small number of rows
    known = F.broadcast(known) if more is None else known
    return out.join(known, F.col("canonical_sha256") == F.col("_lic_known"), "left").drop("_lic_known")


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    from .common import tables

    out = scan(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "canonical_sha256", "license_id", F.array_join("notices", ",").alias("notices"))


def _sql(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"lower(coalesce({text}, ''))"
    out = f"regexp_replace({out}, {quote(chr(92) + 'r' + chr(92) + 'n?')}, chr(10), 'g')"
    out = f"regexp_replace({out}, {quote(COPYRIGHT)}, chr(10), 'g')"
    out = f"replace({out}, 'all rights reserved', '')"
    for used, other in SPELLINGS:
        out = f"replace({out}, {quote(other)}, {quote(used)})"
    return f"regexp_replace({out}, {quote(PUNCTUATION)}, ' ', 'g')"


def _values(texts: dict[str, tuple[str, ...]]) -> str:
    return ", ".join("('" + name + "', '" + t.replace("'", "''") + "')" for name, every in texts.items() for t in every)


OP7_SQL = f"""
WITH licenses AS (
  SELECT min(name) AS license_id, sha256(trim(regexp_replace({_sql('t')}, '[ \\n]+', ' ', 'g'))) AS k
  FROM (VALUES {_values(LICENSES)}) v(name, t) GROUP BY k
  UNION ALL SELECT * FROM (VALUES {_values(DIGESTS)}) v(license_id, k)
), notices AS (
  SELECT name, trim({_sql('t')}) AS line FROM (VALUES {_values(NOTICES)}) v(name, t)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_sql('text')} AS c FROM documents
), hits AS (
  SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
  FROM (SELECT rid, trim(unnest(string_split(c, chr(10)))) AS line FROM d) JOIN notices USING (line) GROUP BY rid
), w AS (
  SELECT rid, doc_id, sha256(trim(regexp_replace(c, '[ \\n]+', ' ', 'g'))) AS canonical_sha256 FROM d
)
SELECT doc_id, canonical_sha256, license_id, coalesce(notices, '') AS notices
FROM w LEFT JOIN licenses ON k = canonical_sha256 LEFT JOIN hits USING (rid)
"""
