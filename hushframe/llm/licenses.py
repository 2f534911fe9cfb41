"""Licence scans: sparse TF-IDF cosine of lines, headers and licence files to templates, then inheritance by directory.

Terms are words and word pairs.  Document frequencies are counted over all lines of all files, for the terms of the
templates; any other term has the frequency zero, so the vocabulary that is sent round is bounded by the templates.

A run of lines grows from each line that shares enough with the templates, for as long as its cosine to some template
grows: it ends where ``PATIENCE`` further words have raised none.  Each template's best run from each line is a candidate,
and the candidate that explains most of a template (squared cosine times the template's squared weight) is taken first;
those that overlap a taken one go.  So a whole header comes before the short notice that it begins with, and a file has
every licence that it names, however its lines are wrapped.  A taken run is named by its nearest template.  For licence
files the whole text is compared as well.

A file that says nothing takes the licence of the nearest directory above it that holds a licence file: a file whose name
says so (LICENSE, COPYING, ...) or whose whole text is one of the templates.

Cases: null text is empty and matches nothing; a null path lies in no directory and inherits nothing; of equally near
templates the first by name wins, of runs that explain as much the first and then the shorter; a bare rights notice
('Proprietary') beside another licence, with ``BESIDE`` lines between them at most, is part of it; of several licence files
in a directory the most similar counts and then the first by path; repeated rows are scanned each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import written

# The wording of permissive licences.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, '
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD = (
    f"{_BSD_HEAD} 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
    "You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_GNU = [("AGPL-3.0", "Affero General Public License", 3), ("GPL-2.0", "General Public License", 2), ("GPL-3.0", "General Public License", 3), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", 3)]
#: Short notices, headers of files and whole licences. Fixed values.
TEMPLATES: list[tuple[str, str]] = [
    *((spdx, f"This work is licensed under the GNU {name}, version {version}.") for spdx, name, version in _GNU),
    *((spdx, _GPL.format(name=name, version=version)) for spdx, name, version in _GNU),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD_HEAD),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", _MIT + _WARRANTY),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Cosine from which a line or a file counts as a template.
THRESHOLD = 0.7
#: Cosine from which a file that is named like a licence counts as a template.
NAMED = 0.5
#: A run of lines is given up when so many words have not brought it nearer to any template.
PATIENCE = 40
#: The licence of a bare rights notice.
NOTICE = "Proprietary"
#: Lines between a rights notice and the licence that it belongs to, at most.
BESIDE = 2
_FOUND = pa.list_(pa.struct([("licence", pa.string()), ("similarity", pa.float64()), ("first_line", pa.int64()), ("last_line", pa.int64())]))
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
_FILE_NAME = r"(?i)^(un)?licen[cs]es?(\.\w+)?$|^copying(\.\w+)?$|^copyright(\.\w+)?$"


def terms(text: str) -> Counter:
    """Words and word pairs of a text."""
    words = _WORD.findall(text.lower())
    out = Counter(words)
    out.update(map(" ".join, zip(words, words[1:])))
    return out


class Model:
    """Template vectors and the inverse document frequencies of their terms."""

    def __init__(self, templates: list[tuple[str, str]], lines: int, frequency: dict[str, int]):
        self.idf = {t: log((1 + lines) / (1 + n)) + 1 for t, n in frequency.items()}
        self.other = log(1 + lines) + 1
        self.holders: dict[str, list[tuple[int, float]]] = {}
        self.names = [name for name, _ in templates]
        self.sizes: list[float] = []
        for i, (_, text) in enumerate(templates):
            own = {t: n * self.idf[t] for t, n in terms(text).items()}
            size = sqrt(sum(x * x for x in own.values()))
            self.sizes.append(size)
            for t, x in own.items():
                self.holders.setdefault(t, []).append((i, x / size))

    def best(self, text: str, own: Counter | None = None) -> tuple[float, str | None]:
        """The largest cosine to a template and its licence."""
        dots: dict[int, float] = {}
        total = 0.0
        for t, n in (terms(text) if own is None else own).items():
            x = n * self.idf.get(t, self.other)
            total += x * x
            for i, y in self.holders.get(t, ()):
                dots[i] = dots.get(i, 0.0) + x * y
        if not dots:
            return 0.0, None
        i = min(dots, key=lambda i: (-dots[i], self.names[i], i))
        return dots[i] / sqrt(total), self.names[i]

    def grown(self, lines: list[str], shared: list[bool], first: int, threshold: float) -> list[tuple[float, int, int]]:
        """What each template's best run from line ``first`` explains of it, and the run: its first and last line."""
        held: Counter = Counter()
        dots: dict[int, float] = {}
        nearest: dict[int, tuple[float, int]] = {}
        total, idle, before = 0.0, 0, None
        for at in range(first, len(lines)):
            words = _WORD.findall(lines[at].lower())
            for word in words:
                for t in (word,) if before is None else (word, f"{before} {word}"):
                    w = self.idf.get(t, self.other)
                    total += (2 * held[t] + 1) * w * w
                    held[t] += 1
                    for i, y in self.holders.get(t, ()):
                        dots[i] = dots.get(i, 0.0) + w * y
                before = word
            idle += len(words)
            if shared[at]:
                size = sqrt(total)
                for i, dot in dots.items():
                    if dot / size > nearest.get(i, (0.0, 0))[0] + 1e-12:
                        nearest[i] = (dot / size, at)
                        idle = 0
            if idle > PATIENCE:
                break
        return [((s * self.sizes[i]) ** 2, first, last) for i, (s, last) in nearest.items() if s >= threshold]

    def runs(self, lines: list[str], threshold: float) -> list[tuple[float, str, int, int]]:
        """Runs of lines that do not overlap: similarity, licence, first and last line, what explains most first."""
        # a cosine of t needs a share of t * t of the squared weight in known terms
        share = threshold * threshold
        shared = [known > 0 and known >= share * (known + other) for known, other in map(self.weights, lines)]
        found = [x for at, begins in enumerate(shared) if begins for x in self.grown(lines, shared, at, threshold)]
        taken: set[int] = set()
        out: list[tuple[float, str, int, int]] = []
        for _, first, last in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if taken.isdisjoint(range(first, last + 1)):
                taken.update(range(first, last + 1))
                s, name = self.best(" ".join(lines[first : last + 1]))
                if name is not None:
                    out.append((s, name, first, last))
        near = {k for _, name, first, last in out if name != NOTICE for k in range(first - BESIDE - 1, last + BESIDE + 2)}
        return [x for x in out if x[1] != NOTICE or near.isdisjoint(x[2:])]

    def weights(self, line: str) -> tuple[float, float]:
        """What the template terms of a line weigh, squared, and what its other terms do."""
        words = _WORD.findall(line.lower())
        idf = self.idf
        own = [idf.get(w) for w in words]
        if not any(own):
            return 0.0, 1.0
        if len(set(words)) < len(words):  # repeated terms count by the square of their number
            weights = [(idf.get(t), n) for t, n in terms(line).items()]
            return sum((x * n) ** 2 for x, n in weights if x), sum((self.other * n) ** 2 for x, n in weights if not x)
        pairs = [idf.get(f"{a} {b}") for a, b, x, y in zip(words, words[1:], own, own[1:]) if x and y]
        known = sum(x * x for x in own if x) + sum(x * x for x in pairs if x)
        other = own.count(None) + len(own) - 1 - sum(x is not None for x in pairs)
        return known, other * self.other * self.other


def frequencies(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[int, dict[str, int]]:
    """The number of lines in all files and of those that hold each template term."""
    known = {t for _, text in templates for t in terms(text)}
    single = frozenset(t for t in known if " " not in t)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for line in (text or "").split("\n"):
                    seen[""] += 1
                    words = _WORD.findall(line.lower())
                    # only template terms are counted: pairs matter where both words are known
                    hits = single.intersection(words)
                    if hits:
                        seen.update(hits)
                        seen.update({p for a, b in zip(words, words[1:]) if a in hits and b in hits and (p := f"{a} {b}") in known})
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    got = files.select("text").mapInArrow(tally, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a template term
    found = {r["term"]: int(r["n"]) for r in got}
    return found.pop("", 0), {t: found.get(t, 0) for t in known}


def scan(files: DataFrame, path: Column, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, licence, similarity, place ('line', 'file' or null), line, is_file (a licence file) and licences of every
    file.

    licences: every licence of the file by its lines (licence, similarity, first_line, last_line; lines from 0), empty if there
    is none.  licence: the one that explains most, or that of the whole file if it is as near.
    """
    templates = templates or TEMPLATES
    model = files.sparkSession.sparkContext.broadcast(Model(templates, *frequencies(files, templates)))
    rows = files.select("doc_id", path.alias("path"), "text")

    def found_in(m: Model, text: str, named: bool) -> tuple[str | None, float | None, str | None, int | None, bool, list[dict]]:
        lines = text.split("\n")
        runs = m.runs(lines, threshold)
        listed = [dict(zip(("licence", "similarity", "first_line", "last_line"), (name, s, first, last))) for s, name, first, last in sorted(runs, key=lambda x: x[2])]
        found: tuple[float, str | None, str | None, int | None] = (runs[0][0], runs[0][1], "line", runs[0][2]) if runs else (0.0, None, None, None)
        alone = False
        if named or runs:
            s, name = m.best(text)
            alone = s >= threshold
            if (alone or (named and s >= NAMED)) and s >= found[0]:
                found = (s, name, "file", None)
                if not listed:
                    listed = [{"licence": name, "similarity": s, "first_line": 0, "last_line": len(lines) - 1}]
        return found[1], found[0] if found[1] else None, found[2], found[3], (named and found[1] is not None) or alone, listed

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.string(), pa.int64(), pa.bool_(), _FOUND]
        names = ["doc_id", "path", "licence", "similarity", "place", "line", "is_file", "licences"]
        for batch in batches:
            paths = batch.column("path").to_pylist()
            named = [p is not None and re.search(_FILE_NAME, p.rpartition("/")[2]) is not None for p in paths]
            out = [found_in(model.value, text or "", own) for text, own in zip(batch.column("text").to_pylist(), named, strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), *columns], names)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(look, f"doc_id {kind}, path string, licence string, similarity double, place string, line long, is_file boolean, licences array<struct<licence:string,similarity:double,first_line:long,last_line:long>>")


def inherit(scanned: DataFrame) -> DataFrame:
    """``scanned`` with effective_licence, basis ('own', 'inherited' or null) and from_directory.

    Directories, not files, are joined with the directories above them; files then look up their own directory.
    """
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    rows = written(scanned.withColumn("directory", directory), "scanned")
    # the most similar licence file of each directory, then the first by path
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "path", "licence"))
    holders = rows.where("is_file and directory is not null").groupBy("directory").agg(best.alias("x")).select(F.col("directory").alias("above"), F.col("x.licence").alias("given"))
    # a directory may hold a third of all files: its answer is there once for each even share of them
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, rows.count() // width)
    asking = rows.where("licence is null and directory is not null").groupBy("directory").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    levels = F.split("directory", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(levels)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(levels, F.lit(1), k), "/").alias("above")))
    pairs = asking.select("directory", "parts", F.explode(ups).alias("x")).select("directory", "parts", "x.depth", "x.above").dropDuplicates(["directory", "above"])
    near = pairs.join(holders, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "given")).alias("x"), F.max("parts").alias("parts"))
    near = near.select("directory", F.col("x.above").alias("from_directory"), F.col("x.given").alias("given"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    counts = near.groupBy("directory").agg(F.count("*").alias("parts")).where("parts > 1")  # as many as the width at most
    part = F.pmod(F.xxhash64("path", "doc_id"), F.coalesce("parts", F.lit(1))).cast("int")
    out = rows.join(F.broadcast(counts), "directory", "left").withColumn("part", part).join(near, ["directory", "part"], "left")
    silent = F.col("licence").isNull()
    return out.select(
        *scanned.columns,
        F.coalesce("licence", "given").alias("effective_licence"),
        F.when(~silent, "own").when(F.col("given").isNotNull(), "inherited").alias("basis"),
        F.when(silent, F.col("from_directory")).alias("from_directory"),
    )
