"""Licence scan: whole texts, and single lines, looked up by canonical digest.

Two copies of a licence differ in case, punctuation, line breaks, spelling and
the copyright line. Canonical form removes those differences; its SHA-256 then
finds the licence in a hash join. The known digests are a fixed list (a few
hundred rows), so that side is broadcast and the texts are never shuffled. A text
that is not found so is looked up once more without the title, the copyright
notices and the reservation of rights that licence files begin with.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labmesh.llm.common import lower_ascii

# Spellings that count as equal, rare form first.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("colour", "color"),
    ("copyright holder", "copyright owner"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("recognised", "recognized"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Texts of short public licences and usual notices.
KNOWN = {
    "MIT": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE
        OR PERFORMANCE OF THIS SOFTWARE.""",
        "SPDX-License-Identifier: ISC",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event
        will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following
        restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as
        being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
        "SPDX-License-Identifier: Zlib",
    ),
    "Apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions
        and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
        """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0
        International License.""",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related rights.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "reserved": ("All rights reserved.",),
}

# Titles that stand above licences which do not begin with their own name.
TITLES = (
    "0BSD", "BSD", "BSD 2-Clause", "BSD 2-Clause \"Simplified\"", "BSD 3-Clause",
    "BSD 3-Clause \"New\" or \"Revised\"", "BSD Zero Clause", "BSL-1.0", "Boost Software", "BSD-2-Clause",
    "BSD-3-Clause", "Expat", "ISC", "Internet Systems Consortium", "MIT", "MIT (MIT)", "MIT No Attribution",
    "Modified BSD", "New BSD", "Revised BSD", "Simplified BSD", "Two-Clause BSD", "Three-Clause BSD",
    "Unlicense", "X11", "Zero-Clause BSD", "zlib", "zlib/libpng",
)
_FOLDER = Path(__file__).parent / "licence_texts"
_END = re.compile(r"END OF TERMS AND CONDITIONS")
_ADDRESS = re.compile(
    r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA"
)


def _between(text: str, first: str, last: str) -> str:
    start = text.rindex(first)
    return text[start : text.index(last, start) + len(last)]


def _file_texts(name: str) -> list[str]:
    """A licence file whole and in the forms that its copies have."""
    text = (_FOLDER / f"{name}.txt").read_text("utf-8")
    out = [text]
    if _END.search(text):
        out.append(text[: _END.search(text).end()])
        out.append(text[: _END.search(text).start()])
    if _ADDRESS.search(text):
        # The address before 2005, and none at all.
        old = [_ADDRESS.sub("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", t) for t in out]
        old += [_ADDRESS.sub("59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", t) for t in out]
        out += old + [re.sub(r"(?m)^.*51 Franklin.*\n", "", t, count=1) for t in out]
    if name == "Apache-2.0":
        # The example of a notice filled in: its line goes as a copyright line.
        out.append(re.sub(r"(?m)^ *Copyright \[yyyy\].*\n", "", text))
        out.append(text[: text.index("APPENDIX:")])
    elif name == "MPL-2.0":
        out.append(text[: text.index("Exhibit A - Source")])
    elif name == "MPL-1.1":
        out.append(text[: text.index("EXHIBIT A -")])
    elif name == "CC0-1.0":
        out.append(text[text.index("CC0 1.0 Universal") :])
        out.append(text[text.index("Statement of Purpose") :])
    elif name == "BSL-1.0":
        out.append(text[text.index("Permission is") :])
    elif name == "Unlicense":
        out.append(text[: text.index("For more information")])
    elif name == "WTFPL":
        # The file of its author has a copyright line of another name.
        kept = [line for line in text.split("\n") if "Copyleft" not in line]
        out = [text, "\n".join(kept)]
    return out


def _free_software(kind: str, version: str) -> list[str]:
    """Notices that the GNU licences tell authors to put on their files."""
    out = []
    thing = "library" if kind == "Lesser" else "program"
    for colon in ("", ":"):
        for later in (
            f"either version {version} of the License, or (at your option) any later version",
            f"version {version} of the License",
            f"version {version}",
        ):
            name = f"GNU {kind} General Public License".replace("  ", " ")
            for ending in (
                f" You should have received a copy of the {name} along with this {thing}. If not, see "
                "<http://www.gnu.org/licenses/>.",
                f" You should have received a copy of the {name} along with this {thing}; if not, write "
                "to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
                "02110-1301 USA.",
                "",
            ):
                out.append(
                    f"This {thing} is free software{colon or ';'} you can redistribute it and/or modify it "
                    f"under the terms of the {name} as published by the Free Software Foundation"
                    f"{',' if colon else ';'} {later}. This {thing} is distributed in the hope that it will "
                    "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
                    f"{name} for more details.{ending}"
                )
    return out


def _bsd(clauses: int) -> list[str]:
    """The BSD licences by who disclaims, and by how the clauses are numbered."""
    names = (
        "Neither the name of the copyright holder nor the names of its contributors",
        "The name of the author may not",
    )
    out = []
    for who, owner in (
        ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"),
        ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
        ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDERS OR CONTRIBUTORS"),
        ("THE COPYRIGHT HOLDER AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"),
        ("THE AUTHOR AND CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS"),
        ("THE AUTHORS AND CONTRIBUTORS", "THE AUTHORS OR CONTRIBUTORS"),
        ("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"),
        ("THE AUTHOR", "THE AUTHOR"),
    ):
        for marks in (("", "", ""), "123", "abc"):
            for third in names if clauses == 3 else ("",):
                if third.startswith("The name"):
                    third += (
                        " be used to endorse or promote products derived from this software without "
                        "specific prior written permission."
                    )
                elif third:
                    third += (
                        " may be used to endorse or promote products derived from this software without "
                        "specific prior written permission."
                    )
                out.append(
                    "Redistribution and use in source and binary forms, with or without modification, are "
                    f"permitted provided that the following conditions are met: {marks[0]} "
                    "Redistributions of source code must retain the above copyright notice, this list of "
                    f"conditions and the following disclaimer. {marks[1]} Redistributions in binary form "
                    "must reproduce the above copyright notice, this list of conditions and the following "
                    "disclaimer in the documentation and/or other materials provided with the "
                    f"distribution. {marks[2] if third else ''} {third} THIS SOFTWARE IS PROVIDED BY {who} "
                    '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
                    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
                    f"DISCLAIMED. IN NO EVENT SHALL {owner} BE LIABLE FOR ANY DIRECT, INDIRECT, "
                    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
                    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
                    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
                    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
                    "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
                    "DAMAGE."
                )
    return out


def _more_texts() -> dict[str, list[str]]:
    """Whole licences and notices besides those written out above."""
    mit, isc, zlib = KNOWN["MIT"][0], KNOWN["ISC"][0], KNOWN["Zlib"][0]
    found = {path.stem: _file_texts(path.stem) for path in sorted(_FOLDER.glob("*.txt"))}
    apart = mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    also = mit.replace("this permission notice shall", "this permission notice (including the next paragraph) shall")
    titled = [f"{title}\n{mit}" for title in ("MIT License", "The MIT License", "The MIT License (MIT)")]
    found["MIT"] = [apart, also, *titled]
    kept = "The above copyright notice"
    found["MIT-0"] = [
        re.sub(r",\s+subject to the following conditions:", ".", mit[: mit.index(kept)])
        + mit[mit.index("THE SOFTWARE IS") :]
    ]
    plural = isc.replace("AUTHOR DISCLAIMS", "AUTHORS DISCLAIM").replace("THE AUTHOR BE", "THE AUTHORS BE")
    forms = [isc, plural, isc.replace("THE AUTHOR", "ISC")]
    forms += [form.replace("and/or distribute", "and distribute") for form in forms]
    found["ISC"] = [*forms, *(f"{title}\n{form}" for title in ("ISC License", "The ISC License") for form in forms)]
    granted = re.compile(r", provided that.*?copies\.", re.S)
    found["0BSD"] = [granted.sub(".", form) for form in (isc, plural)]
    found["Zlib"] = [re.sub(r"(?m)^ *[123]\. ", "", zlib)]
    found["BSD-2-Clause"], found["BSD-3-Clause"] = _bsd(2), _bsd(3)
    for name, kind, version in (
        ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"),
        ("AGPL-3.0", "Affero", "3"),
    ):
        found.setdefault(name, []).extend(_free_software(kind, version))
    found["MPL-2.0"].append(
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    )
    for name, texts in found.items():
        if re.match("A?GPL|LGPL|GFDL", name):
            texts += [f"SPDX-License-Identifier: {name}{end}" for end in ("", "-only", "-or-later", "+")]
        else:
            texts.append(f"SPDX-License-Identifier: {name}")
    return found


for _name, _texts in _more_texts().items():
    KNOWN[_name] = (*KNOWN.get(_name, ()), *(t for t in _texts if t not in KNOWN.get(_name, ())))

# Runs of ASCII signs and blanks but the line feed, and typographic signs.
_SIGNS = r"[\x00-\x09\x0B-/:-@\[-`{-\x{bf}\x{2010}-\x{206f}]+"
_COPYRIGHT = r"(^|\n) *copyright (copyright )?(by|[0-9]{4}) [^\n]*"

# What licence files begin with, in the text as it is. Signs may stand before words.
_BEFORE = r"[^\p{L}\p{N}\n\u00a9(]*+"
_BLANK = r"[^\p{L}\p{N}\n]*+\n"
_NAME = "|".join(r"[\W_]+".join(re.findall(r"\w+", t)) for t in sorted(TITLES, key=len, reverse=True))
_TITLE = rf"(?:the\b[^\p{{L}}\p{{N}}\n]*+)?(?:{_NAME})(?:[\W_&&[^\n]]+licen[cs]e)?(?:[\W_&&[^\n]]*\(?(?:mit|isc|bsd)\)?)?[^\p{{L}}\p{{N}}\n]*"
_RIGHTS = r"all rights reserved[^\p{L}\p{N}\n]*"
_NOTICE = (
    r"(?:portions )?(?:copyright(?!\s+(?:notice|law|license|act|holder|owner|and|is|in|or)s?\b)"
    r"|\(c\)|\u00a9)[^\n]*"
)
# How known texts begin: a copyright notice that is wrapped ends there at the latest.
_OPENINGS = "|".join(
    sorted({r"\W+".join(re.findall(r"\w+", text.lower())[:2]) for texts in KNOWN.values() for text in texts})
)
_HEAD = (
    rf"(?iu)\A(?:{_BLANK}|{_BEFORE}{_TITLE}\n|{_BEFORE}{_RIGHTS}\n"
    rf"|{_BEFORE}{_NOTICE}\n(?:(?!{_BLANK})(?!{_BEFORE}(?:{_OPENINGS}|{_TITLE}\n|{_RIGHTS}\n|{_NOTICE}\n))[^\n]*\n)*+)++"
)
_NAMED = (
    r"neither the names? (?:of )?.+? nor the names? of (?:its|their|his|her|any|other|the|any other)? ?"
    "contributors may"
)
_UNNAMED = "neither the name of the copyright owner nor the names of its contributors may"


def canonical_lines(text: Column) -> Column:
    """The text with each line in canonical form; empty for NULL.

    A-Z in lower case, signs as blanks, one blank between words, equal spellings
    in one form. Letters beyond ASCII stay, so that other languages do not
    collapse into short forms.
    """
    form = lower_ascii(F.coalesce(text, F.lit("")))
    form = F.replace(form, F.lit("(c)"), F.lit(" copyright "))
    form = F.replace(form, F.lit("\u00a9"), F.lit(" copyright "))
    form = F.regexp_replace(form, r"[\r\n]+", "\n")
    # Two blanks between words, so that neighbouring words can both be replaced.
    form = F.regexp_replace(form, _SIGNS, "  ")
    form = F.concat(F.lit("  "), F.replace(form, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    for rare, usual in SPELLINGS:
        rare = rare.replace(" ", "  ")
        usual = usual.replace(" ", "  ")
        form = F.replace(form, F.lit(f" {rare} "), F.lit(f" {usual} "))
    return F.regexp_replace(form, " +", " ")


def canonical_text(lines: Column) -> Column:
    """Canonical lines as one line, without copyright lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(lines, _COPYRIGHT, "\n"), r"[ \n]+", " "))


def body_digest(text: Column) -> Column:
    """Digest of a licence without what is put above it; NULL for a text that has nothing such.

    Above the licence may stand its title, copyright notices, which may be wrapped
    and need no year, and 'all rights reserved'. Whoever the BSD licence names is
    put as the copyright owner.
    """
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    body = F.regexp_replace(text, _HEAD, "")
    form = canonical_text(canonical_lines(body))
    form = F.regexp_replace(form, _NAMED, _UNNAMED)
    form = F.trim(F.regexp_replace(form, r"(^| )all rights reserved (?=redistribution and use|permission )", " "))
    differs = (F.length(body) < F.length(text)) | F.contains(text, F.lit("either the name"))
    return F.when(differs & (form != ""), F.sha2(form, 256))


def known_digests(
    spark: SparkSession, known: dict[str, tuple[str, ...]] = KNOWN
) -> DataFrame:
    """digest, license: one row per known text; the first licence by name if two share one."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    found = spark.createDataFrame(rows, "license string, text string")
    form = canonical_text(canonical_lines(F.col("text")))
    return (
        found.filter(form != "")
        .groupBy(F.sha2(form, 256).alias("digest"))
        .agg(F.min("license").alias("license"))
    )


def licence_scan(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    known: dict[str, tuple[str, ...]] = KNOWN,
) -> DataFrame:
    """One row per document: id, digest, license, line_licenses.

    `digest` is the SHA-256 of the canonical form of the whole text and `license`
    the known licence with that digest, or else with the digest of the text below
    its title, copyright notices and reservation of rights (`body_digest`), else
    NULL. `line_licenses` lists, sorted, the licences of single lines that are known
    notices as a whole; an empty array if none. NULL and empty texts have the digest
    of the empty form and no licence. Repeated rows are scanned one by one, rows with
    a NULL id too. Other columns are not read.
    """
    digests = known_digests(docs.sparkSession, known)
    # As bounded as the list of known texts: a literal map, read only where a digest is known.
    listed = digests.collect()
    notices = F.create_map(*[F.lit(x) for row in listed for x in row])
    known_ones = [row.digest for row in listed]
    rows = docs.select(
        F.col(f"`{id}`").alias(id),
        canonical_lines(F.col(f"`{text}`")).alias("__lines"),
        body_digest(F.col(f"`{text}`")).alias("__body"),
    ).select(
        id,
        F.sha2(canonical_text(F.col("__lines")), 256).alias("digest"),
        "__body",
        F.array_sort(
            F.array_distinct(
                F.transform(
                    F.filter(
                        F.transform(F.split("__lines", "\n"), lambda line: F.sha2(F.trim(line), 256)),
                        lambda digest: digest.isin(known_ones),
                    ),
                    lambda digest: F.try_element_at(notices, digest),
                )
            )
        ).alias("line_licenses"),
    )
    found = rows.join(F.broadcast(digests), "digest", "left")
    bodies = F.broadcast(digests.select(F.col("digest").alias("__body"), F.col("license").alias("__below")))
    found = found.join(bodies, "__body", "left")
    return found.select(id, "digest", F.coalesce("license", "__below").alias("license"), "line_licenses")
