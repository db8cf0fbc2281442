"""Licence scans by canonical digest lookup.

A text's canonical form is lower case, without copyright lines, with one
spelling of words that licences spell in several ways, and with every run of
other characters than letters and digits as one space.  Whole documents and
single lines (notices) are brought to that form, digested, and hash-joined to
the digests of known licence texts and notices.  Whole documents that this
does not find are looked up by a looser form too, without title lines, "all
rights reserved" and list markers.  The registry is the constants of this
module and the full texts in ``licenses/``, so broadcasting it is bounded.

Everything is DataFrame operations.  Lines are looked up inside their row, in
a literal map of the notices' digests, so that nothing is shuffled.

Defined results: a null or empty text has no licence; a document may be a
licence text as a whole (license_id) and carry notices in lines; of several
known texts with one canonical form the first id in order is reported;
repeated rows are reported one by one, each with its own notices; a text of
any length is read whole; a null id is kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices, and spellings that count as equal.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_TERMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ISC = _ISC_GRANT + """, provided that the above copyright notice and this permission notice appear in all copies.
""" + _ISC_TERMS
_0BSD = _ISC_GRANT + """.
""" + _ISC_TERMS
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
KNOWN: tuple[tuple[str, str], ...] = (
    ("0BSD", _0BSD),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + "\n" + _BSD_THIRD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", _MPL_HEADER),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Zlib", _ZLIB),
)
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("http www", "https www"),
)
_COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
_OTHER = r"[^\p{L}\p{N}]+"
#: Lines around a licence's own words, and marks of list items, in lower case.
_FRAME_LINES = (
    r"(?m)^[ \t]*(copyright[ \t]+(\(c\)|©|[\[<{0-9]|by\b)|(\(c\)|©)[ \t]*[\[<{0-9])[^\n]*$",
    r"(?m)^[ \t]*all rights reserved[ \t.]*\r?$",
    r"""(?m)^[ \t#=*]*(the[ \t]+)?((new|revised|modified|simplified|zero[- ]clause|[0-4][- ]clause)[ \t]+)?(mit|expat|isc|0?bsd|zlib)([ \t/:,"'-]+(libpng|zero|0|2|3|two|three|clause|new|or|revised|modified|simplified|licen[cs]e|\([^)\n]*\)))*[ \t:."']*\r?$""",
)
_LIST_MARK = r"(?m)^[ \t]*([*•-]|\(?([0-9]{1,2}|[a-z])[.)])[ \t]+"
#: Where the terms of some licences end; what follows tells how to apply them.
_END = "END OF TERMS AND CONDITIONS"


def canonical(text: Column) -> Column:
    """The form in which two copies of a licence are equal."""
    out = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _COPYRIGHT_LINE, " ")
    return _words(out)


def _words(out: Column) -> Column:
    out = F.trim(F.regexp_replace(out, _OTHER, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def loose(text: Column) -> Column:
    """The form in which whole licence documents are equal, whatever their title, copyright lines and list marks."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for lines in _FRAME_LINES:
        out = F.regexp_replace(out, lines, " ")
    return _words(F.regexp_replace(out, _LIST_MARK, " "))


def full_texts() -> tuple[tuple[str, str], ...]:
    """Licence files, as wholes and up to the end of their terms."""
    out = []
    for file in sorted((resources.files(__package__) / "licenses").iterdir(), key=lambda f: f.name):
        text = file.read_text("utf-8")
        out.append((file.name.removesuffix(".txt"), text))
        if _END in text:
            out.append((file.name.removesuffix(".txt"), text[: text.index(_END) + len(_END)]))
            out.append((file.name.removesuffix(".txt"), text[: text.index(_END)]))
    return tuple(out)


def registry(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, form: Callable[[Column], Column] = canonical) -> DataFrame:
    """(digest, found): digests of the forms of known texts."""
    rows = spark.createDataFrame(list(known), "license string, text string").withColumn("form", form(F.col("text"))).where("form <> ''")
    return rows.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("found"))


def scan_licenses(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """doc_id, license_id (of the whole text or null), n_notices (lines), notices (ids, sorted, joined by comma)."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    rows = registry(spark, known)  # one row per constant above
    wholes = F.broadcast(registry(spark, known + full_texts(), loose).toDF("loose", "like"))
    notices = F.create_map(*[F.lit(x) for r in rows.collect() for x in (r.digest, r.found)])
    license_of = lambda line: F.try_element_at(notices, F.sha2(canonical(line), 256))
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), license_of), lambda x: x.isNotNull())
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text")), 256).alias("digest"), F.sha2(loose(F.col("text")), 256).alias("loose"), found.alias("lines")
    )
    joined = base.join(F.broadcast(rows), "digest", "left").join(wholes, "loose", "left")
    return joined.select(
        "doc_id",
        F.coalesce("found", "like").alias("license_id"),
        F.size("lines").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("lines")), ",").alias("notices"),
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_sql_text(_COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"trim(regexp_replace({out}, {_sql_text(_OTHER)}, ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


ORACLE_SQL = f"""
with known(license, text) as (values {', '.join(f'({_sql_text(k)}, {_sql_text(t)})' for k, t in KNOWN)}),
r as (select {_sql_canonical('text')} as form, min(license) as found from known group by 1),
d as (select row_number() over () as row, doc_id, text from documents),
l as (select row, unnest(string_split(text, chr(10))) as line from d),
h as (
  select row, count(*) as n, string_agg(distinct found, ',' order by found) as ids
  from l join r on {_sql_canonical('l.line')} = r.form group by row)
select d.doc_id, r.found as license_id, coalesce(h.n, 0) as n_notices, coalesce(h.ids, '') as notices
from d left join r on {_sql_canonical('d.text')} = r.form left join h on d.row = h.row
"""
