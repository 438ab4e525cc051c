"""Licence scans: sparse TF-IDF cosine to templates, then nearest-ancestor inheritance by path joins.

Templates are notices, and texts or openings of texts of public licences. Each is a sparse TF-IDF vector
without function words; words that no template has count with the largest weight in a candidate's norm.
Compared with them are a text's lines, its windows of each template's own number of words, at every
quarter of it, and the whole text, however long. So notices are found inline, wrapped over lines and as
files of their own.

A candidate can only reach the limit if it holds one of the anchors: content words of each template, rare
ones first, as many as it takes for the rest of its vector to stay below the limit. Texts and candidates
without an anchor as a whole word need no vector. A match shares at least three of the template's content
words with it, or all if there are fewer. Of several matches the one of most evidence is the text's licence:
the cosine to the third times the length of the template's vector, so that a licence's text outweighs a short notice in it.

A file declares its directory's licence if its name is a licence file's, if its licence words are most
of its text, or if it opens as a licence's text. A file without a licence of its own takes that of its
nearest ancestor directory that has one: directories are joined with all their ancestors' declarations and
the deepest wins; of declarations in one directory the best score does, then the smaller licence, then the
smaller path.

Defined cases: null and empty texts and texts of blanks have no licence of their own; a null path has no
directory and inherits nothing; rows that repeat a path are each returned; very long texts are scanned
whole; ties in evidence go to the licence that is first in the alphabet, then to the candidate that starts
first, then to the longer one. Columns of the input that have the name of a result are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.support import append_columns, settle, small_batches

_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Notices, texts and openings of texts of public licences.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "text", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("MIT", "notice", "Released under the MIT License"),
    ("MIT", "notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("MIT", "text", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "text", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "notice", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "text", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "notice", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "text", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-2.0", "text", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This is the first released version of the library GPL."),
    ("LGPL-2.1", "text", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This is the first released version of the Lesser GPL."),
    ("BSD-3-Clause", "notice", _BSD_OPENING),
    ("BSD-3-Clause", "notice", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "text", f"{_BSD_OPENING} {_BSD_TWO} {_BSD_THIRD} {_BSD_END}"),
    ("BSD-2-Clause", "text", f"{_BSD_OPENING} {_BSD_TWO} {_BSD_END}"),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("GFDL-1.3", "text", "GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "text", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related rights: CC0 1.0 public domain dedication"),
    ("CC0-1.0", "text", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP."),
    ("Proprietary", "notice", "All rights reserved"),
    ("Proprietary", "notice", "Proprietary and confidential. All rights reserved. Unauthorized copying of this file is strictly prohibited"),
)

#: Function words, which have no weight.
STOP = frozenset(
    "a all an and any are as at be been but by can do does either for from has have if in into is it its may must no nor not of on or other "
    "out over shall such than that the their them these they this those to under use used was were which who whom with without you your".split()
)

#: Base names of licence files.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([-_.][a-z0-9._-]+)?$"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]")
#: Blanks all but letters and digits, so that a text splits into the parts of its words.
_PARTS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    """The words of a text with A-Z lower-cased."""
    return [w.decode() for w in _WORD.findall(text.encode("utf-8").translate(_LOWER))]


@dataclass(frozen=True)
class LicenceScan:
    """limit: least cosine; most: share of a text's words in licence candidates that makes it a licence
    file; head: words from a text's start within which a licence's text must begin to open it; shared:
    least content words in common with a template that has as many."""

    limit: float = 0.7
    shared: int = 3
    most: float = 0.5
    head: int = 40


@dataclass(frozen=True)
class Found:
    """The best match: licence, cosine, line from 0, whether it opens the text; and the licence words' share of all words."""

    name: str | None = None
    score: float = 0.0
    line: int = -1
    opens: bool = False
    share: float = 0.0


class Matcher:
    """Templates as sparse vectors, with the anchors that a match must touch."""

    def __init__(self, p: LicenceScan):
        self.p = p
        lists = [words_of(text) for _, _, text in TEMPLATES]
        bags = [Counter(w for w in words if w not in STOP) for words in lists]
        df = Counter(w for bag in bags for w in bag)
        n = len(bags)
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
        self.unseen = math.log(1 + n) + 1
        self.names = [name for name, _, _ in TEMPLATES]
        self.kinds = [kind for _, kind, _ in TEMPLATES]
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        #: Templates of each number of words.
        self.classes: dict[int, set[int]] = {}
        self.weight: list[float] = []
        self.needed = [min(p.shared, len(bag)) for bag in bags]
        self.anchors: set[bytes] = set()
        self.class_anchors: dict[int, set[str]] = {}
        for i, (words, bag) in enumerate(zip(lists, bags, strict=True)):
            v = {w: k * self.idf[w] for w, k in bag.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.weight.append(norm)
            v = {w: x / norm for w, x in v.items()}
            for w, x in v.items():
                self.by_word.setdefault(w, []).append((i, x))
            self.classes.setdefault(len(words), set()).add(i)
            rest = 1.0
            # Long words are rarer in other texts than short ones; any order is sound.
            for w in sorted(v, key=lambda w: (-min(len(w), 9), -v[w], w)):
                if math.sqrt(max(rest, 0.0)) < p.limit - 1e-9:
                    break
                self.class_anchors.setdefault(len(words), set()).add(w)
                # A word with points or dashes holds its longest part as a whole word.
                self.anchors.add(max(re.split(r"[.+-]+", w), key=lambda x: (len(x), x)).encode())
                rest -= v[w] ** 2
        self.any_anchor = set().union(*self.class_anchors.values())

    def best(self, bag: Counter, among: set[int] | None = None) -> tuple[float, str, int, float]:
        """(evidence, licence, template, cosine) of the best match, the template -1 if there is none."""
        dots: dict[int, float] = {}
        common: dict[int, int] = {}
        norm = 0.0
        for w, k in bag.items():
            if w in STOP:
                continue
            x = k * self.idf.get(w, self.unseen)
            norm += x * x
            for i, weight in self.by_word.get(w, ()):
                if among is None or i in among:
                    dots[i] = dots.get(i, 0.0) + x * weight
                    common[i] = common.get(i, 0) + 1
        top = (0.0, "", -1, 0.0)
        for i, dot in dots.items():
            score = round(dot / math.sqrt(norm), 9)
            if score >= self.p.limit and common[i] >= self.needed[i]:
                evidence = round(score**3 * self.weight[i], 9)
                if (-evidence, self.names[i], i) < (-top[0], top[1], top[2]):
                    top = (evidence, self.names[i], i, score)
        return top

    def candidates(self, words: list[str], line_of: list[int], hits: list[int]):
        """(first word, end word, templates or None) of the lines, windows and whole text that hold an anchor."""
        n = len(words)
        at = 0
        for line in dict.fromkeys(line_of[h] for h in hits):
            first = bisect_left(line_of, line, at)
            at = bisect_left(line_of, line + 1, first)
            yield first, at, None
        for size, among in self.classes.items():
            step = max(1, size // 4)
            upto = -1
            mine = self.class_anchors[size]
            for h in hits:
                if words[h] not in mine:
                    continue
                # Windows start at multiples of the step; those that hold word h and were not given before.
                for k in range(max(upto + 1, (h - size) // step + 1, 0), h // step + 1):
                    yield k * step, min(k * step + size, n), among
                    upto = k
        yield 0, n, None

    def scan(self, raw: bytes) -> Found:
        if self.anchors.isdisjoint(raw.translate(_PARTS).split()):
            return Found()
        words: list[str] = []
        line_of: list[int] = []
        for number, line in enumerate(raw.translate(_LOWER).split(b"\n")):
            found = _WORD.findall(line)
            words += [w.decode() for w in found]
            line_of += [number] * len(found)
        hits = [i for i, w in enumerate(words) if w in self.any_anchor]
        top: tuple = (0.0,)
        best = Found()
        inside: list[tuple[int, int]] = []
        for first, end, among in self.candidates(words, line_of, hits):
            evidence, name, i, score = self.best(Counter(words[first:end]), among)
            if i < 0:
                continue
            inside.append((first, end))
            key = (-evidence, name, first, -end)
            if top == (0.0,) or key < top:
                top = key
                best = Found(name, score, line_of[first], self.kinds[i] == "text" and first < self.p.head)
        if best.name is None:
            return best
        covered, at = 0, 0
        for first, end in sorted(inside):
            covered += max(0, end - max(first, at))
            at = max(at, end)
        return Found(best.name, best.score, best.line, best.opens, covered / len(words))


def own_licences(files: DataFrame, p: LicenceScan = LicenceScan(), text_col: str = "text") -> DataFrame:
    """files, without the text, with own_licence, own_score, own_line, own_opens and own_share."""
    small_batches(files.sparkSession)

    def maker():
        matcher = Matcher(p)

        def compute(column: pa.Array) -> list[pa.Array]:
            got = [matcher.scan(t or b"") for t in column.cast(pa.binary()).to_pylist()]
            return [
                pa.array([x.name for x in got], pa.string()), pa.array([x.score for x in got], pa.float64()), pa.array([x.line for x in got], pa.int32()),
                pa.array([x.opens for x in got], pa.bool_()), pa.array([x.share for x in got], pa.float64()),
            ]

        return compute

    fields = [
        T.StructField("own_licence", T.StringType()), T.StructField("own_score", T.DoubleType()), T.StructField("own_line", T.IntegerType()),
        T.StructField("own_opens", T.BooleanType()), T.StructField("own_share", T.DoubleType()),
    ]
    return append_columns(files, fields, maker, text_col, drop=(text_col,))


def inherited(files: DataFrame, p: LicenceScan = LicenceScan()) -> DataFrame:
    """files (path and the own_ columns) with licence, licence_from (directory or null) and depth_up."""
    files = files.drop("licence", "licence_from", "depth_up")
    rows = files.withColumn("__lw_dir", F.when(F.col("path").isNotNull(), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES)
    declares = F.col("own_licence").isNotNull() & ((F.col("own_share") >= p.most) | F.col("own_opens") | named)
    order = F.struct((-F.col("own_score")).alias("s"), F.col("own_licence").alias("l"), F.col("path").alias("f"))
    declared = rows.where(declares & F.col("__lw_dir").isNotNull()).groupBy(F.col("__lw_dir").alias("__lw_up")).agg(F.min(order).alias("__lw_d")).select("__lw_up", F.col("__lw_d.l").alias("__lw_l"))
    # Directories, not files, are joined with their ancestors, so a directory of many files costs one row.
    parts = F.split("__lw_dir", "/")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up"), k.alias("k")))
    ups = rows.select("__lw_dir").where("__lw_dir IS NOT NULL").distinct().select("__lw_dir", F.explode(prefixes).alias("__lw_u"))
    ups = ups.select("__lw_dir", F.col("__lw_u.up").alias("__lw_up"), F.col("__lw_u.k").alias("__lw_k"))
    nearest = ups.join(declared, "__lw_up").groupBy("__lw_dir").agg(F.max_by(F.struct("__lw_l", "__lw_up", "__lw_k"), "__lw_k").alias("__lw_x"))
    joined = rows.join(nearest, "__lw_dir", "left")
    own = F.col("own_licence").isNotNull()
    level = F.when(F.col("__lw_dir") == "", 0).otherwise(F.size(parts))
    up = F.col("__lw_x.__lw_up")
    return joined.select(
        *files.columns,
        F.when(own, F.col("own_licence")).otherwise(F.col("__lw_x.__lw_l")).alias("licence"),
        F.when(~own, up).alias("licence_from"),
        F.when(~own & F.col("__lw_x").isNotNull(), level - F.when(up == "", 0).otherwise(F.col("__lw_x.__lw_k"))).alias("depth_up"),
    )


def scan(files: DataFrame, p: LicenceScan = LicenceScan(), text_col: str = "text") -> DataFrame:
    """files (path, text and any other columns) with own and inherited licences."""
    return inherited(settle(own_licences(files, p, text_col)), p)


def with_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path and text of documents, filed by source, language and hundreds of ids.

    The tables have no paths. Of ten documents one lies in its source's directory, two in its language's
    and the others below that; every twentieth is named as a licence file.
    """
    part = lambda c: F.coalesce(F.replace(F.col(c), F.lit("/"), F.lit("_")), F.lit("_"))
    ident = F.col("doc_id").cast("string")
    kind = F.pmod("doc_id", F.lit(10))
    name = F.when(F.pmod("doc_id", F.lit(20)) == 7, F.concat(F.lit("LICENSE-"), ident)).otherwise(F.concat(ident, F.lit(".txt")))
    below = F.when(kind == 0, F.array(part("source"))).when(kind <= 2, F.array(part("source"), part("lang"))).otherwise(F.array(part("source"), part("lang"), F.floor(F.col("doc_id") / 100).cast("string")))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.concat(F.array_join(below, "/"), F.lit("/"), name)).alias("path"), "text")
