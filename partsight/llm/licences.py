"""Licence scan by canonical digest lookup, in native column functions only.

A text is normalised (case, copyright lines, equivalent spellings, punctuation and white space) and
its digest joined to the digests of known licence texts and notices. Only an entire text matches:
the whole document, or a whole line of it.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known texts by licence, as their stewards publish them. Callers may give others.
KNOWN_TEXTS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "MIT License",
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "ISC License",
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License, Version 2.0",
        "Apache License Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        "zlib License",
        "SPDX-License-Identifier: Zlib",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}

for _name, _notices in {
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "Unlicense": ["SPDX-License-Identifier: Unlicense"],
    "BSL-1.0": ["SPDX-License-Identifier: BSL-1.0", "Distributed under the Boost Software License, Version 1.0"],
}.items():
    KNOWN_TEXTS[_name] = [*_notices]
    if "GPL" in _name:
        KNOWN_TEXTS[_name] += [f"SPDX-License-Identifier: {_name}-{_which}" for _which in ("only", "or-later")]

#: Titles that stand over a body which does not hold its own.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)", "Licensed under the MIT License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD License", "The BSD License", "License"],
    "BSD-3-Clause": [
        "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License",
        "New BSD License", "The New BSD License", "Modified BSD License", "BSD License", "The BSD License", "License",
    ],
    "Unlicense": ["The Unlicense", "Unlicense"],
}

#: Whole texts by licence, as files beside this module.
_TEXTS = Path(__file__).parent / "licence_texts"


def _forms(name: str, body: str) -> list[str]:
    """The forms in which a whole text goes round, without titles of its own."""
    forms = [body]
    if name == "Apache-2.0":  # the owner of the notice filled in; without the appendix
        forms.append(body.replace("Copyright [yyyy] [name of copyright owner]", ""))
        forms.append(body[: body.index("APPENDIX: How to apply")])
    if "END OF TERMS AND CONDITIONS" in body and "How to Apply These Terms" in body:  # without the last part
        forms.append(body[: body.index("END OF TERMS AND CONDITIONS")] + "END OF TERMS AND CONDITIONS")
        forms.append(body[: body.index("END OF TERMS AND CONDITIONS")])
    if name == "MPL-2.0":
        forms.append(body[: body.index("Exhibit A - Source Code Form License Notice")])
    if name == "MIT":
        forms.append(body.replace("this permission notice shall", "this permission notice (including the next paragraph) shall"))
    if name == "Unlicense":
        forms.append(body[: body.index("For more information")])
    if name.startswith("BSD-"):  # numbered or not; persons named in other ways
        parts = body.replace("* Redistributions", "Redistributions").replace("1. R", "R").replace("2. R", "R").replace("3. N", "N")
        numbered = parts.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in")
        forms = [parts, numbered.replace("Neither the", "3. Neither the")]
        for old, new in (("COPYRIGHT\nOWNER", "COPYRIGHT HOLDER"), ("COPYRIGHT\nHOLDER", "COPYRIGHT OWNER")):
            forms += [f.replace(old, new) for f in forms if old in f]
        forms += [f.replace("copyright holder nor", f"{who} nor") for f in forms for who in ("author", "University") if "copyright holder nor" in f]
        forms += [f.replace("name of the copyright holder", "names of the copyright holders") for f in forms]
    return forms


def _whole_texts() -> dict[str, list[str]]:
    bodies = {name: texts[0] for name, texts in KNOWN_TEXTS.items() if name in ("MIT", "ISC", "Zlib")}
    bodies |= {path.stem: path.read_text(encoding="utf-8") for path in sorted(_TEXTS.glob("*.txt"))}
    return {
        name: [f"{title}\n\n{form}" for form in _forms(name, body) for title in ("", *TITLES.get(name, ()))]
        for name, body in bodies.items()
    }


for _name, _texts in _whole_texts().items():
    KNOWN_TEXTS[_name] = [*KNOWN_TEXTS.get(_name, []), *_texts]

#: Rewrites in order, on lower-cased text: (pattern, replacement). The same in Java and RE2 syntax.
#: First whole copyright lines go, then spellings become one, then all that is no letter or digit a space.
REWRITES = (
    (r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|all rights reserved)[^\n]*$", " "),
    (r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$", " "),
    (r"https?://(www\.)?", " "),
    (r"&", " and "),
    (r"[’‘'`]", ""),
    (r"[^a-z0-9à-öø-ÿ]+", " "),
    (r"\b(sub)?licence(s|d|)\b", "${1}license${2}"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bauthoris", "authoriz"),
    (r"\brecognis", "recogniz"),
    (r"\borganis", "organiz"),
    (r"\bfavour", "favor"),
    (r"\bfulfil\b", "fulfill"),
    (r"\bnon infring", "noninfring"),
    (r"\bwhilst\b", "while"),
    (r"\bneighbour", "neighbor"),
    (r"\bversion ([0-9])", "v ${1}"),
    (r"\bv([0-9])", "v ${1}"),
)
#: Each text of ``KNOWN_TEXTS`` has one of these (a test holds it); other tables are looked up without them.
HINTS = ("licen", "permission", "as-is", "as is", "free software", "mozilla", "waived")


def normalised(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.lower(text)
    for pattern, into in REWRITES:
        for n in (1, 2):
            into = into.replace(f"${{{n}}}", f"${n}")
        out = F.regexp_replace(out, pattern, into)
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def known_digests(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """licence, digest: one row for each known text; a fixed table of a few hundred rows by default."""
    rows = [(name, t) for name, kinds in (texts or KNOWN_TEXTS).items() for t in kinds]
    found = spark.createDataFrame(rows, "licence string, known string")
    return found.groupBy(digest(F.col("known")).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(
    docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", hints: tuple[str, ...] | None = None
) -> DataFrame:
    """The entire texts that are a known licence text: ``key``, whole boolean, licence, n.

    whole: the document itself; otherwise one of its lines, n times. Null and empty texts match
    nothing. With ``hints`` only units that hold one of them (lower case) are looked up, which saves time
    where each known text has one; without, all. Rows of one key count together. The known side is joined by hash; Spark's own size check
    decides whether it is sent to all.
    """
    lines = F.explode(F.split(F.col(text), r"\r\n|\n|\r"))
    hint = F.lit(hints is None)
    for word in hints or ():
        hint = hint | F.lower("unit").contains(word)
    # A document of one line is looked up as a whole only.
    several = F.col(text).rlike(r"[\r\n]")
    units = (
        docs.select(F.col(key), F.lit(True).alias("whole"), F.col(text).alias("unit"))
        .unionByName(docs.where(several).select(F.col(key), F.lit(False).alias("whole"), lines.alias("unit")))
        .where(hint)
    )
    return (
        units.select(key, "whole", digest(F.col("unit")).alias("digest"))
        .join(known, "digest")
        .groupBy(key, "whole", "licence")
        .agg(F.count("*").alias("n"))
    )


def summary(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document: ``key``, whole_licence, n_notices, licences (names, comma-joined)."""
    each = found.groupBy(F.col(key).alias("found_key")).agg(
        F.min(F.when(F.col("whole"), F.col("licence"))).alias("whole_licence"),
        F.sum(F.when(F.col("whole"), 0).otherwise(F.col("n"))).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),  # of the known names
    )
    return docs.select(key).join(each, F.col(key).eqNullSafe(F.col("found_key")), "left").select(
        key,
        "whole_licence",
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("licences", F.lit("")).alias("licences"),
    )


def rewrites_sql(column: str) -> str:
    """``normalised`` as DuckDB text."""
    out = f"lower({column})"
    for pattern, into in REWRITES:
        for n in (1, 2):
            into = into.replace(f"${{{n}}}", f"\\{n}")
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{into}', 'g')"
    return f"trim({out})"
