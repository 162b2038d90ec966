"""Licence scan: TF-IDF cosine of licence statements to templates, then inheritance along directories.

Statements are the lines of a text that hold an anchor word ("licen", "copyright", ...),
the paragraphs and the blocks of comment lines around them, and the whole text of a
licence file. So a header is found however its lines are broken, and whole headers tell
apart licences that begin alike. A statement's words are
weighted by term frequency and by inverse document frequency over all files;
words outside the templates weigh as if no file had them, so other text dilutes a
statement. The template with the highest cosine of at least ``LEAST_COSINE`` is the
file's own licence; a tag (SPDX-License-Identifier) has to match by ``LEAST_TAG``, so an
unknown identifier, or a choice of several, gives none. A file without one takes the licence of the nearest directory
above it (its own first) that holds a licence file, found by joining directories
with their ancestors; each directory is resolved once, whatever number of files it has.

Defined results: a NULL or empty text has no statement; a NULL path has no directory
and inherits nothing; repeated rows are files of their own. Equal cosines are settled
by the template's name, several licence files of a directory by the higher cosine,
then the smaller path. An empty table gives no rows. Columns that are kept give
way to output columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from condense.llm.rows import arrow_schema, field, map_texts
from condense.session import written

LEAST_COSINE = 0.55
LEAST_TAG = 0.95

#: Parts in which the files of one directory meet its licence.
PARTS = 32

#: Usual statements and openings of licence texts (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Proprietary", "Copyright. All rights reserved. Proprietary and confidential"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("ISC", "Licensed under the ISC License"),
    ("Unlicense", "Released under the Unlicense"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
        OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
        or non-commercial, and by any means."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]

_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
    and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
    conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_NO_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission. """
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
    NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
    OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
    (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
    SUCH DAMAGE."""
TEMPLATES += [
    ("BSD-2-Clause", _CONDITIONS),
    ("BSD-2-Clause", _CONDITIONS + _DISCLAIMER),
    ("BSD-3-Clause", _CONDITIONS + _NO_NAMES),
    ("BSD-3-Clause", _CONDITIONS + _NO_NAMES + _DISCLAIMER),
]

#: The notice of the GNU licences, by kind and version.
_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public
    License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
    version."""
_NO_WARRANTY = """ This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
    of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have
    received a copy of the GNU {kind}General Public License along with this program. If not, see https://www.gnu.org/licenses/."""
for _name, _kind, _version in [
    ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"),
]:
    for _text in (_NOTICE, _NOTICE + _NO_WARRANTY):
        TEMPLATES.append((_name, _text.format(kind=_kind, version=_version)))

#: Tags by identifier; those of the GNU licences also in their longer forms.
NAMES = sorted({name for name, _ in TEMPLATES} - {"Proprietary"})
FIRST_TAG = len(TEMPLATES)
for _name in NAMES:
    for _form in ("", "-only", "-or-later") if "GPL" in _name else ("",):
        TEMPLATES.append((_name, f"SPDX-License-Identifier: {_name}{_form}"))

ANCHORS = ("licen", "copyright", "permission", "redistribution", "public domain", "spdx", "cc0", "rights reserved")
LICENCE_FILE = re.compile(r"(?i)(licen[sc]e|copying|copyright|unlicense)([.-].*)?\Z")

_TERM = re.compile(r"[a-z0-9]+")


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.lower())


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms_of(text)})
_PLACE = {t: i for i, t in enumerate(VOCABULARY)}


_COMMENT = re.compile(r"[ \t]*(#|//|/\*|\*|--|;|%|<!--|\"\"\"|rem\b|dnl\b)", re.I)
_WORDY = re.compile(r"[A-Za-z0-9]")


def _run(lines: Sequence[str], at: int, inside) -> tuple[int, int]:
    """The run of lines around ``at`` that pass ``inside``: first, one past the last."""
    first, end = at, at + 1
    while first and inside(lines[first - 1]):
        first -= 1
    while end < len(lines) and inside(lines[end]):
        end += 1
    return first, end


def statements(text: str, whole: bool) -> list[str]:
    """Lines with an anchor word, the paragraphs and blocks of comments around them; all of a licence file."""
    found = [text] if whole and text.strip() else []
    low = text.lower()
    if not any(anchor in low for anchor in ANCHORS):
        return found
    lines = text.split("\n")
    hits = [at for at, line in enumerate(lines) if any(anchor in line.lower() for anchor in ANCHORS)]
    spans = {(at, at + 1) for at in hits}
    for inside in (_WORDY.search, _COMMENT.match):
        last = (0, 0)
        for at in hits:
            if at >= last[1] and inside(lines[at]):
                last = _run(lines, at, inside)
                spans.add(last)
    return found + ["\n".join(lines[first:end]) for first, end in sorted(spans)]


def weights(files: int, seen: dict[int, int]) -> tuple[np.ndarray, float]:
    """Inverse document frequencies of the vocabulary, and that of any other word."""
    counts = np.array([seen.get(i, 0) for i in range(len(VOCABULARY))], dtype=float)
    return np.log((1 + files) / (1 + counts)) + 1, float(np.log(1 + files) + 1)


def vector(text: str, idf: np.ndarray, other: float) -> tuple[dict[int, float], float]:
    """Sparse TF-IDF weights of the vocabulary words, and the length with all words."""
    own, rest = {}, 0.0
    for term, n in Counter(terms_of(text)).items():
        at = _PLACE.get(term)
        if at is None:
            rest += (n * other) ** 2
        else:
            own[at] = n * idf[at]
    return own, float(np.sqrt(rest + sum(w * w for w in own.values())))


def best_match(texts: Sequence[str], idf: np.ndarray, other: float, templates) -> tuple[str | None, float]:
    """Licence and cosine of the best template; ``templates`` holds (name, vector) in the order of ``TEMPLATES``."""
    best: tuple[float, str | None] = (0.0, None)
    for text in texts:
        own, length = vector(text, idf, other)
        for at, (name, (goal, goal_length)) in enumerate(templates):
            shared = sum(w * goal[i] for i, w in own.items() if i in goal)
            if shared:
                cosine = round(shared / (length * goal_length), 9)
                if cosine >= (LEAST_COSINE if at < FIRST_TAG else LEAST_TAG) and (cosine > best[0] or (cosine == best[0] and name < best[1])):
                    best = (cosine, name)
    return best[1], best[0]


def scan(df: DataFrame, path: str = "path", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, ``path``, ``own`` (licence or NULL) and ``cosine`` of each file."""
    held = "__kept"
    rows = df.select(
        F.struct(F.col(path).alias("path"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]).alias(held),
        F.concat(F.coalesce(F.col(path), F.lit("")), F.lit("\x00"), F.coalesce(F.col(text), F.lit(""))).alias("both"),
    )

    def make():
        def read(pairs: list[str]):
            known, said = [], []
            for pair in pairs:
                name, _, body = pair.partition("\x00")
                known.append(sorted({_PLACE[t] for t in set(terms_of(body)) if t in _PLACE}))
                said.append(statements(body, bool(LICENCE_FILE.match(name.rpartition("/")[2]))))
            return [known, said]

        return read

    listed = written(map_texts(rows, "both", [held], [field("terms", "array_int"), field("said", "array_string")], make), "licence-lines")
    files = listed.count()
    seen = {r["term"]: r["count"] for r in listed.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    idf, other = weights(files, seen)
    templates = [(name, vector(text_, idf, other)) for name, text_ in TEMPLATES]

    fields = [listed.schema[held], field("own", "string"), field("cosine", "double")]
    schema = arrow_schema(fields)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_match(s, idf, other, templates) for s in batch.column("said").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(held).cast(schema[0].type),
                    pa.array([f[0] for f in found], schema[1].type),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                schema=schema,
            )

    scored = listed.select(held, "said").mapInArrow(match, T.StructType(fields))
    names = [c for c in keep if c not in ("path", "own", "cosine")]
    kept = [F.col(f"{held}.k{keep.index(c)}").alias(c) for c in names]
    return scored.select(*kept, F.col(f"{held}.path").alias("path"), "own", "cosine")


def directory(path: str = "path"):
    """The directory of a path; "" for a file at the top, NULL without path."""
    return F.regexp_replace(F.col(path), r"(^|/)[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """Add ``licence`` and ``licence_from``: own, or that of the nearest directory above with a licence file."""
    base = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    whole = F.struct(*[F.col(f"`{c}`") for c in scanned.columns]).alias("_row")
    part = F.pmod(F.xxhash64("path"), F.lit(PARTS)).alias("_part")  # a directory may hold a third of all files
    files = scanned.select(whole, "path", "own", "cosine", directory().alias("_dir"), part)
    given = files.filter(F.col("own").isNotNull() & base.rlike(LICENCE_FILE.pattern.replace(r"\Z", "$")))
    given = given.groupBy("_dir").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), F.col("path").alias("p"), F.col("own").alias("o"))).alias("of")
    )
    parts = F.split("_dir", "/")
    ups = F.when(F.col("_dir") == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    )
    places = files.filter(F.col("own").isNull() & F.col("_dir").isNotNull()).select("_dir", "_part").distinct()
    above = places.select("_dir").distinct().select("_dir", F.explode(F.array_distinct(ups)).alias("up"))
    found = above.join(given.select(F.col("_dir").alias("up"), "of"), "up").groupBy("_dir").agg(
        F.max_by("of", F.length("up")).alias("of")
    )
    out = files.join(places.join(found, "_dir"), ["_dir", "_part"], "left")
    return out.select(
        *[F.col("_row")[c].alias(c) for c in scanned.columns if c not in ("licence", "licence_from")],
        F.coalesce("own", F.col("of.o")).alias("licence"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("of.p")).alias("licence_from"),
    )
