"""License scans: notices matched to templates by sparse TF-IDF cosine, and inheritance by path.

Each line of a file is compared with license templates. Document frequencies of the templates'
terms are counted over all lines of all files that hold one of them. A file whose text is mostly a
license notice is a licence file of its directory; a file without a notice of its own takes the
license of the nearest ancestor directory that has one, found by joining paths level by level.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: SPDX identifiers and the notices by which texts name the licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, a Creative Commons Attribution license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("LicenseRef-Proprietary", "All rights reserved. Proprietary and confidential."),
)
#: Standard headers and short licences, compared with runs of adjacent lines and with whole files.
HEADERS = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
    ("GPL-2.0-only", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License.'),
    ("GPL-2.0-only", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.'),
    ("GPL-2.0-or-later", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.'),
    ("GPL-2.0-or-later", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.'),
    ("GPL-3.0-only", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.'),
    ("GPL-3.0-only", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.'),
    ("GPL-3.0-or-later", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("GPL-3.0-or-later", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.'),
    ("LGPL-2.1-only", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 2.1 of the License.'),
    ("LGPL-2.1-only", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 2.1 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.'),
    ("LGPL-2.1-or-later", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.'),
    ("LGPL-2.1-or-later", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.'),
    ("LGPL-3.0-only", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3 of the License.'),
    ("LGPL-3.0-only", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.'),
    ("LGPL-3.0-or-later", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("LGPL-3.0-or-later", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.'),
)
#: Licences by the files of their whole texts in ``licence_texts``, read on the driver.
TEXTS = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
THRESHOLD = 0.75
#: A file is a licence file if notices hold at least this share of its words.
FILE_SHARE = 0.5
SLICE = 128

_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(line: str) -> list[str]:
    return _TERM.findall(line.lower())


_MARKED = re.compile(r"\s*(?:#|//|/\*|\*|--|;|%|<!--|\"\"\")")


def blocks(lines: list[str]) -> list[tuple[int, int]]:
    """Runs of two or more adjacent lines as ``(first, end)``: lines that are not empty, comment
    lines and others apart, and the whole."""
    kind = [1 if _MARKED.match(x) else 2 if x.strip() else 0 for x in lines]
    edges = [0, *(i for i in range(1, len(lines)) if kind[i] != kind[i - 1]), len(lines)]
    runs = {(a, b) for a, b in zip(edges, edges[1:]) if kind[a]}
    solid = [0, *(i for i in range(1, len(lines)) if (kind[i] == 0) != (kind[i - 1] == 0)), len(lines)]
    runs |= {(a, b) for a, b in zip(solid, solid[1:]) if kind[a]} | {(0, len(lines))}
    return sorted((a, b) for a, b in runs if b - a > 1)


def whole_texts() -> tuple[tuple[str, str], ...]:
    folder = Path(__file__).resolve().parent / "licence_texts"
    return tuple((name, (folder / f"{f}.txt").read_text("utf-8")) for f, name in TEXTS.items())


class Matcher:
    """Templates as sparse vectors. Lines can only reach the threshold if they hold a core term;
    the other terms are those that together carry too little of every template's weight."""

    def __init__(self, templates: tuple[tuple[str, str], ...], lines: int, frequency: dict[str, int], threshold: float = THRESHOLD):
        self.threshold = threshold
        counted = [(name, Counter(terms(t))) for name, t in templates]
        known = {t for _, c in counted for t in c}
        in_templates = Counter(t for _, c in counted for t in c)
        # rare in lines that hold template terms, and telling between templates
        self.idf = {t: math.log((1 + lines) / (1 + frequency.get(t, 0))) + math.log((1 + len(counted)) / in_templates[t]) + 0.1 for t in known}
        self.templates = [(name, self._unit(c)) for name, c in counted]
        self.core = set(known)
        for t in sorted(known, key=lambda t: self.idf[t]):  # terms that no line needs, cheapest first
            rest = self.core - {t}
            if all(math.sqrt(sum(w * w for k, w in v.items() if k not in rest)) < threshold for _, v in self.templates):
                self.core = rest
        self.top = max(self.idf.values())
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for i, (_, v) in enumerate(self.templates):
            for t, w in v.items():
                self.by_term.setdefault(t, []).append((i, w))

    def _unit(self, counts: Counter) -> dict[str, float]:
        v = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items() if t in self.idf}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / size for t, w in v.items()} if size else {}

    def match(self, line: list[str]) -> tuple[str, float] | None:
        """The nearest template's license and cosine, if that reaches the threshold. Terms that no
        template has count with the largest weight, so a notice inside a long line is not one."""
        if self.core.isdisjoint(line):
            return None
        counts = Counter(line)
        size, dot = 0.0, [0.0] * len(self.templates)
        for t, n in counts.items():
            w = (1 + math.log(n)) * self.idf.get(t, self.top)
            size += w * w
            for i, x in self.by_term.get(t, ()):
                dot[i] += w * x
        best = max(range(len(dot)), key=lambda i: (dot[i], -i))
        score = dot[best] / math.sqrt(size)
        return (self.templates[best][0], min(1.0, score)) if score >= self.threshold else None


def _frequencies(files: DataFrame, vocabulary: frozenset[str]) -> tuple[int, dict[str, int]]:
    """How many lines of all files hold a template term, and each term; at most as many numbers as
    the templates have terms come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.column("text").slice(at, SLICE).to_pylist():
                    for line in (text or "").split("\n"):
                        own = vocabulary.intersection(terms(line))
                        if own:
                            found.update(own)
                            found[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    rows = files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, path, own_license, score, license_file, license, license_path)`` for every row.

    ``own_license`` is that of the line, run of adjacent lines or whole file nearest to a template (of
    equal ones the first), null if none reaches the threshold; a
    whole file that reaches it goes before its parts. ``license`` is the own one, or else that of the nearest ancestor
    directory holding a licence file; of several in a directory the one with the smallest path
    counts. ``license_path`` says where it came from. Null and empty texts have no license of their
    own, null paths no ancestors. Whole texts are scanned; repeated rows each keep their row.

    Licences by directory are far fewer than files, and a directory appears once on that side of
    the joins; a directory with very many files is a skew that adaptive execution splits.
    """
    slim = files.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), F.col(text).alias("text"))
    vocabulary = frozenset(t for _, x in templates for t in terms(x))
    lines, frequency = _frequencies(slim, vocabulary)
    long = HEADERS + whole_texts()
    both = (Matcher(templates, lines, frequency, threshold), Matcher(long, *_frequencies(slim, frozenset(t for _, x in long for t in terms(x))), threshold))
    matcher = files.sparkSession.sparkContext.broadcast(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, wide = matcher.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                names, scores, whole = [], [], []
                for text in rows.column("text").to_pylist():
                    best, file, notices = None, None, set()
                    split = (text or "").split("\n")
                    own = [terms(line) for line in split]
                    hits = [(i, i + 1, m.match(x)) for i, x in enumerate(own)]
                    hits += [(i, j, wide.match([t for x in own[i:j] for t in x])) for i, j in ([(0, 1)] if len(own) == 1 else blocks(split))]
                    for i, j, hit in hits:
                        if hit:
                            notices.update(range(i, j))
                            if best is None or hit[1] > best[1]:
                                best = hit
                            if (i, j) == (0, len(own)) and j > 1:  # a licence text quotes headers of its own
                                file = hit
                    best = file or best
                    words, in_notices = sum(map(len, own)), sum(len(own[i]) for i in notices)
                    names.append(best and best[0])
                    scores.append(best and best[1])
                    whole.append(best is not None and in_notices >= FILE_SHARE * words)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(whole, pa.bool_())], names=["id", "path", "own_license", "score", "license_file"])

    schema = slim.select("id", "path", F.lit(None).cast("string").alias("own_license"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("license_file")).schema
    found = written(slim.mapInArrow(run, schema), "licenses")
    directory = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    held = found.where("license_file and path is not null").groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct("path", "own_license")).alias("from"))
    held = written(held, "held")
    # each directory in use with its ancestors, itself first: joined to the licences on the path
    used = found.where("own_license is null and path is not null").select(directory(F.col("path")).alias("home")).distinct()
    parts = F.split("home", "/")
    levels = used.select("home", F.explode(F.sequence(F.size(parts), F.lit(0))).alias("depth"))
    levels = levels.withColumn("dir", F.array_join(F.slice(F.split("home", "/"), 1, F.col("depth")), "/"))
    nearest = written(levels.join(held, "dir").groupBy("home").agg(F.max_by("from", "depth").alias("from")), "nearest")
    joined = found.withColumn("home_of", F.when(F.col("own_license").isNull(), directory(F.col("path")))).join(nearest, F.col("home_of") == F.col("home"), "left")
    return joined.select(F.col("id").alias(id_col), "path", "own_license", "score", "license_file", F.coalesce("own_license", "from.own_license").alias("license"), F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("from.path")).alias("license_path"))
