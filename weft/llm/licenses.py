"""Licence scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

Every line of a text, and every run of up to ``WRAP`` lines around one with a word of ``KEYS``, is compared with the header templates; the whole text of a file that is
named like a licence file, or of any file if that is asked for, with all templates, whole licences among them. Terms that templates lack count in a text's norm at the
highest weight, so prose around a few matching words keeps the cosine low. Texts without any of the templates' strong terms are passed over: the other
terms alone can't reach the threshold with any template, so no match is lost.

A licence file is its directory's licence. Files without a licence of their own have that of the nearest directory above them that has one, found by
joining the directories' ancestors with the directories that have one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

THRESHOLD = 0.6

# Names and notices of public licences.
HEADERS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]
#: Whole licences, one file each in ``license_texts``.
NAMES = "MIT BSD-3-Clause BSD-2-Clause ISC Apache-2.0 MPL-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 CC0-1.0 Artistic-1.0".split()
FILES = [(name, (resources.files(__package__) / "license_texts" / f"{name}.txt").read_text()) for name in NAMES]
#: Lines that a wrapped notice takes at most.
WRAP = 4

# Each header has one of these words. Notices that are wrapped over lines are sought around lines that do.
KEYS = set(b"license licensed mit apache gnu cc cc0 creative mozilla spdx-license-identifier bsd-style".split())

_TERM = re.compile(rb"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
_LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense|copyright)([._-].*)?$"


class Templates:
    """Unit TF-IDF vectors of templates and an index of their terms."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        bags = [Counter(_TERM.findall(text.lower().encode())) for _, text in templates]
        frequency = Counter(t for bag in bags for t in bag)
        n = len(bags)
        self.idf = {t: math.log((1 + n) / (1 + f)) + 1 for t, f in frequency.items()}
        self.unknown = math.log(1 + n) + 1
        self.vectors = []
        for bag in bags:
            weights = {t: (1 + math.log(c)) * self.idf[t] for t, c in bag.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors.append({t: w / norm for t, w in weights.items()})
        self.holding: dict[bytes, list[tuple[int, float]]] = {}
        for k, v in enumerate(self.vectors):
            for t, w in v.items():
                self.holding.setdefault(t, []).append((k, w))
        # terms are weak, commonest first, while weak terms alone keep every template below the threshold
        weak = [0.0] * n
        self.strong = set(self.idf)
        for t in sorted(self.idf, key=lambda t: (self.idf[t], t)):
            more = dict(self.holding[t])
            if any(weak[k] + w * w >= threshold**2 for k, w in more.items()):
                continue
            for k, w in more.items():
                weak[k] += w * w
            self.strong.discard(t)

    def best(self, text: bytes) -> tuple[str, float] | None:
        """The nearest template's licence and cosine, if it reaches the threshold; ties go to the first in order."""
        terms = _TERM.findall(text)
        if self.strong.isdisjoint(terms):
            return None
        squares, dots = 0.0, [0.0] * len(self.vectors)
        for t, c in Counter(terms).items():
            tf = 1 + math.log(c)
            squares += (tf * self.idf.get(t, self.unknown)) ** 2
            for k, w in self.holding.get(t, ()):
                dots[k] += w * tf * self.idf[t]
        top = max(range(len(dots)), key=lambda k: (dots[k], -k))
        cosine = dots[top] / math.sqrt(squares)
        return (self.names[top], cosine) if cosine >= self.threshold else None


def scan(files: DataFrame, id_column: str, path_column: str, text_column: str, threshold: float = THRESHOLD, whole_texts: bool = False) -> DataFrame:
    """``id``, ``path``, ``own_license``, ``score`` and ``line`` (from 0, where a notice begins; null for a whole file) of every file.

    ``whole_texts`` compares every whole text with whole licences, not those of licence files alone. Of several matching runs of lines the best counts, ties by the first and
    then the shortest. A null or empty text has none; a null path stays null. Every line of every whole text is read. Repeated rows stay; an empty table gives no rows.
    """
    headers, whole = Templates(HEADERS, threshold), Templates(HEADERS + FILES, threshold)
    named = re.compile(_LICENCE_FILE)
    kinds = [pa.string(), pa.float64(), pa.int64()]

    def own(path: str | None, raw: bytes) -> tuple[str | None, float | None, int | None]:
        low = raw.lower()
        if (whole_texts or (path and named.match(path.rsplit("/", 1)[-1]))) and (found := whole.best(low)):
            return (*found, None)
        best: tuple = (None, None, None)
        if not any(t in low for t in headers.strong):
            return best
        lines = low.split(b"\n")
        seen: set[tuple[int, int]] = set()
        length = 0
        for k, line in enumerate(lines):
            terms = _TERM.findall(line)
            if headers.strong.isdisjoint(terms):
                continue
            spans = [(k, k + 1)]
            if not KEYS.isdisjoint(terms):
                spans += [(i, j) for i in range(max(0, k - WRAP + 1), k + 1) for j in range(max(k, i + 1) + 1, min(len(lines), i + WRAP) + 1)]
            for begin, end in spans:
                if (begin, end) not in seen:
                    seen.add((begin, end))
                    found = headers.best(b" ".join(lines[begin:end]))
                    if found and (best[1] is None or (found[1], -begin, begin - end) > (best[1], -best[2], -length)):
                        best, length = (*found, begin), end - begin
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [own(p, (t or "").encode()) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "path", "own_license", "score", "line"])

    source = files.select(files[id_column].cast("long"), files[path_column].cast("string"), files[text_column].cast("string"))
    return map_batches(source, run, "id long, path string, own_license string, score double, line long")


def folder(path: Column) -> Column:
    """The directory of a path; '' for a file at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def inherit(scanned: DataFrame, declares: Column) -> DataFrame:
    """Scanned files with ``license`` and ``inherited_from`` (a directory; null if the licence is the file's own or there is none).

    ``declares`` says which files stand for their directory; if they have several licences, the one of most files counts, ties
    by name. Only distinct directories are joined with their ancestors; a file meets one row of its directory.
    """
    files = scanned.withColumn("folder", folder(F.col("path")))
    declared = files.where(declares & F.col("own_license").isNotNull() & F.col("folder").isNotNull()).groupBy("folder", "own_license").agg(F.count("*").alias("n"))
    chosen = written(declared.groupBy("folder").agg(F.min(F.struct((-F.col("n")).alias("n"), "own_license")).alias("c")).select(F.col("folder").alias("above"), F.col("c.own_license").alias("found")), "declared")
    parts = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))
    folders = files.where(F.col("folder").isNotNull()).select("folder").distinct().withColumn("a", F.explode(F.array_distinct(ancestors))).select("folder", "a.depth", "a.above")
    nearest = folders.join(chosen, "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "found")).alias("near"))
    nearest = written(nearest.select("folder", F.col("near.above").alias("above"), F.col("near.found").alias("found")), "nearest")
    met = files.join(nearest, "folder", "left")
    lacking = F.col("own_license").isNull()
    return met.select(
        "id", "path", "own_license", "score", "line", F.coalesce("own_license", "found").alias("license"), F.when(lacking & F.col("found").isNotNull(), F.col("above")).alias("inherited_from")
    )


def license_scan(files: DataFrame, id_column: str = "id", path_column: str = "path", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Scans files and lets those without a licence inherit from licence files (LICENSE, COPYING, NOTICE ...) above them.

    Null paths neither declare nor inherit; null texts have no licence of their own; repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    scanned = written(scan(files, id_column, path_column, text_column, threshold), "scanned")
    return inherit(scanned, F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(_LICENCE_FILE), F.lit(False)))
