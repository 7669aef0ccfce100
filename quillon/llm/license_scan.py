"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Terms are words and numbers, and a term's document frequency is counted over all files. The templates' terms
are few and their frequencies go to every task, which gives each passage its product with the best template.
The other terms only add to a passage's length: those of passages that could still reach the threshold, if
they weighed the least a term can, are joined with the table of all terms' frequencies.
A file's passages are its lines that name a licence, the paragraphs that do (so a wrapped notice, and the notice
that the text of a long licence ends with, are one passage), runs of comment lines and block comments (headers),
and, for licence files, the whole text; the passage and template of the largest cosine decide, if it is THRESHOLD
or more. Templates are whole texts of the short licences, and the notices that the long ones ask for.
A licence file also licenses its directory: a file without a licence of its own inherits that of the
nearest ancestor directory that has one, found by joining each directory's ancestors with them.

Cases: null and empty texts have no licence of their own; a null path has no directory and inherits
nothing; repeated rows each give a row; an empty table gives an empty result; extra columns are ignored.
Ties between templates go to the first name, between licence files of one directory to the larger
cosine, then the first licence name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import arrow_batches, joined, materialize, project, salted, small, table

THRESHOLD = 0.8
#: terms that a task holds at most before it passes their counts on
HELD_TERMS = 500_000
#: terms of passages, and files with a licence, that are broadcast at most; more are joined by shuffling
BROADCAST_TERMS = BROADCAST_FILES = 500_000
# Texts and notices of public licences, by their SPDX names.
_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_REST = " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."


def _gnu(name: str, number: str) -> str:
    """The notice of the GNU licences."""
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version."


TEMPLATES = {
    "AGPL-3.0": (_gnu("Affero General Public License", "3"),),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "BSD-2-Clause": (_CONDITIONS + _WARRANTY,),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        _CONDITIONS + _THIRD + _WARRANTY,
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-2.0": (_gnu("General Public License", "2"),),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _gnu("General Public License", "3")),
    "ISC": (_ISC, _ISC + _ISC_REST),
    "LGPL-3.0": (_gnu("Lesser General Public License", "3"),),
    "MIT": ("Released under the MIT License.", _MIT, _MIT + _MIT_REST),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (_UNLICENSE, _UNLICENSE + _UNLICENSE_REST),
}
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)(\.(txt|md))?$"
_TERM = re.compile(r"[^\W_]+")
#: words of which every template has one: a line without them can't name a licence
_NAMES = re.compile(r"licen[sc]|permission|redistribut|public domain|public license", re.I)
_COMMENT = re.compile(r"^[ \t]*(?:#|//|/?\*|;|--|%|<!--)", re.M)


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


_VECTORS = [(name, Counter(terms(t))) for name, group in sorted(TEMPLATES.items()) for t in group]
VOCABULARY = sorted(set().union(*(v for _, v in _VECTORS)))
_KNOWN = frozenset(VOCABULARY)
_CANDIDATE = pa.struct({"place": pa.int32(), "name": pa.string(), "dot": pa.float64(), "square": pa.float64(), "terms": pa.list_(pa.string()), "counts": pa.list_(pa.int32())})


def _around(text: str, found: int, gap: str) -> tuple[int, int]:
    """The range between gaps that holds a place."""
    first, last = text.rfind(gap, 0, found), text.find(gap, found)
    return (first + len(gap) if first >= 0 else 0), (last if last >= 0 else len(text))


def passages(text: str, whole: bool):
    """Lines and paragraphs that name a licence, runs of comment lines, block comments, and the whole text of a licence file."""
    for gap in ("\n", "\n\n"):
        done = -1
        for found in _NAMES.finditer(text):
            if found.start() >= done:
                first, done = _around(text, found.start(), gap)
                if gap == "\n" or "\n" in text[first:done].strip("\n"):
                    yield text[first:done]
    run: list[str] = []
    if _COMMENT.search(text):
        for line in text.split("\n"):
            if _COMMENT.match(line):
                run.append(line)
            elif run:
                yield " ".join(run)
                run = []
        if run:
            yield " ".join(run)
    for begin, end in (("/*", "*/"), ("<!--", "-->")):
        at = text.find(begin)
        while at >= 0 and (close := text.find(end, at + len(begin))) >= 0:
            yield text[at + len(begin) : close]
            at = text.find(begin, close)
    if whole and text:
        yield text


class Matcher:
    """Cosines to the templates under document frequencies of files."""

    def __init__(self, files: int, frequency: dict[str, int]):
        self.most = self._weight(files, 0)
        self.idf = {t: self._weight(files, frequency.get(t, 0)) for t in _KNOWN.union(frequency)}
        self.templates = []
        for name, counts in _VECTORS:
            vector = {t: n * self.idf[t] for t, n in counts.items()}
            self.templates.append((name, vector, math.sqrt(sum(w * w for w in vector.values()))))

    @staticmethod
    def _weight(files: int, having: int) -> float:
        return math.log((1 + files) / (1 + having)) + 1

    def weigh(self, passage: str) -> tuple[float, str, float, dict[str, int]]:
        """The best template's dot product over its length, its name, the square of the length that the templates' terms give, and the other terms."""
        counts = Counter(terms(passage))
        vector = {t: n * self.idf[t] for t, n in counts.items() if t in _KNOWN}
        dot, name = 0.0, ""
        for other, template, length in self.templates:
            product = sum(w * template[t] for t, w in vector.items() if t in template) / length
            if product > dot + 1e-12:
                dot, name = product, other
        return dot, name, sum(w * w for w in vector.values()), {t: n for t, n in counts.items() if t not in _KNOWN}

    def best(self, passage: str) -> tuple[float, str]:
        dot, name, square, others = self.weigh(passage)
        size = math.sqrt(square + sum((n * self.idf.get(t, self.most)) ** 2 for t, n in others.items()))
        return (dot / size, name) if size and name else (0.0, "")

    def file(self, text: str, whole: bool) -> tuple[float, str]:
        found = (0.0, "")
        for passage in passages(text, whole):
            if (own := self.best(passage))[0] > found[0] + 1e-12:
                found = own
        return found

    def candidates(self, text: str, whole: bool, threshold: float):
        """(place, name, dot, square, other terms, their counts) of the passages that reach the threshold if other terms weigh 1, the least weight."""
        for place, passage in enumerate(passages(text, whole)):
            dot, name, square, others = self.weigh(passage)
            if name and dot >= (threshold - 1e-9) * math.sqrt(square + sum(n * n for n in others.values())):
                yield {"place": place, "name": name, "dot": dot, "square": square, "terms": list(others), "counts": list(others.values())}


def term_counts(spark: SparkSession, files: DataFrame) -> tuple[int, DataFrame]:
    """The number of files, and the table (term, n) of how many have each term."""

    def count(batches):
        held, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                n += 1
                held.update(set(terms(text.as_py() or "")))
                if len(held) > HELD_TERMS:
                    yield from arrow_batches(held.items(), {"term": pa.string(), "n": pa.int64()})
                    held.clear()
        held[""] = n
        yield from arrow_batches(held.items(), {"term": pa.string(), "n": pa.int64()})

    rows = materialize(spark, files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "term-counts")
    return sum(r.n for r in rows.where("term = ''").collect()), rows.where("term <> ''")


def similarities(spark: SparkSession, found: DataFrame, counts: DataFrame, n_files: int, threshold: float) -> DataFrame:
    """(key, similarity, own) of the stored files (key, candidates) with a passage at the threshold."""
    passage = found.select("key", F.explode("candidates").alias("c"))
    term = passage.select("key", "c.place", F.explode(F.arrays_zip("c.terms", "c.counts")).alias("t")).select("key", "place", "t.terms", "t.counts").toDF("key", "place", "term", "times")
    needed = materialize(spark, counts.join(term.select("term").distinct(), "term", "left_semi"), "needed-terms")
    if needed.count() <= BROADCAST_TERMS:
        met = term.join(F.broadcast(needed), "term", "left")
    else:
        term, needed = salted(term, needed, 16, "term")
        met = term.join(needed, ["term", "salt"], "left")
    weight = F.log((1.0 + n_files) / (1 + F.coalesce("n", F.lit(0)))) + 1
    rest = met.groupBy("key", "place").agg(F.sum((F.col("times") * weight) ** 2).alias("rest"))
    plain = passage.select("key", "c.place", "c.name", "c.dot", "c.square")
    size = F.sqrt(F.col("square") + F.coalesce("rest", F.lit(0.0)))
    scored = plain.join(rest, ["key", "place"], "left").withColumn("similarity", F.col("dot") / size).where(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("similarity", "name"), F.struct(F.round("similarity", 12), -F.col("place"))).alias("b")
    return scored.groupBy("key").agg(best).select("key", "b.similarity", F.col("b.name").alias("own"))


def scan(spark: SparkSession, files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, license, similarity, origin, from_dir) of every file; origin is own, inherited or none."""
    files = project(files, id=id_col, path=path_col, text=text_col)
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    files = files.select("id", "path", directory.alias("dir"), F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)).alias("is_license"), "text")
    kind = files.schema["id"].dataType.simpleString()
    n_files, counts = term_counts(spark, files)
    known = counts.where(F.col("term").isin(VOCABULARY)).collect()  # a row for each term of the templates
    matcher = Matcher(n_files, {r.term: r.n for r in known})

    def match(batches):
        for batch in batches:
            found = [list(matcher.candidates(t.as_py() or "", w.as_py(), threshold)) for w, t in zip(batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(_CANDIDATE))], names=["id", "path", "dir", "is_license", "candidates"])

    kinds = f"id {kind}, path string, dir string, is_license boolean, candidates array<struct<place: int, name: string, dot: double, square: double, terms: array<string>, counts: array<int>>>"
    found = materialize(spark, files.mapInArrow(match, kinds).withColumn("key", F.monotonically_increasing_id()), "candidates")
    similar = materialize(spark, similarities(spark, found, counts, n_files, threshold), "similarities")
    own = materialize(spark, found.drop("candidates").join(small(similar, BROADCAST_FILES), "key", "left"), "own-licenses")
    best = own.where("is_license and own is not null and dir is not null").groupBy("dir", "own").agg(F.max("similarity").alias("s"))
    granted = materialize(spark, best.groupBy("dir").agg(F.min_by("own", F.struct(-F.col("s"), F.col("own"))).alias("granted")), "granted")
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts)))
    climbs = own.where("own is null and dir is not null").select("dir").distinct()
    climbs = climbs.select("dir", F.explode(depths).alias("depth")).withColumn("above", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    met = joined(climbs, granted.withColumnRenamed("dir", "above"), "above")  # the root is above all
    nearest = met.groupBy("dir").agg(F.max_by(F.struct("granted", "above"), "depth").alias("near")).select("dir", "near.granted", F.col("near.above").alias("from_dir"))
    out = joined(own, materialize(spark, nearest, "nearest"), "dir", how="left")  # one folder may hold most files
    license_ = F.coalesce("own", "granted")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("granted").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", license_.alias("license"), "similarity", origin.alias("origin"), F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))


def path_of_document():
    """A path for a document: source, language and a folder; one in twenty is a licence file, at one of three levels. A null is "-" in it."""
    top, lang, folder, name = (F.coalesce(c.cast("string"), F.lit("-")) for c in (F.col("source"), F.col("lang"), F.col("doc_id") % 8, F.col("doc_id")))
    level = F.col("doc_id") % 60
    return (
        F.when(level == 0, F.concat_ws("/", top, F.lit("LICENSE")))
        .when(level == 20, F.concat_ws("/", top, lang, F.lit("LICENSE")))
        .when(level == 40, F.concat_ws("/", top, lang, folder, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", top, lang, folder, F.concat(name, F.lit(".txt"))))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = project(table(spark, sf_dir, "documents"), doc_id="doc_id", lang="lang", source="source", text="text")
    return scan(spark, docs.withColumn("path", path_of_document())).withColumnRenamed("id", "doc_id")
