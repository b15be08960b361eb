"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, runs, skew_join, span_hashes, stored

#: Notices by which licences are known (fixed values: usual short forms and opening clauses).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
)
#: The GNU licences (fixed values): name, kind, version, what is licensed, date of the whole text; and the forms of their notices and titles.
GNU = (
    ("GPL-2.0", "General", "2", "program", "June 1991"),
    ("GPL-3.0", "General", "3", "program", "29 June 2007"),
    ("LGPL-2.1", "Lesser General", "2.1", "library", "February 1999"),
    ("LGPL-3.0", "Lesser General", "3", "library", "29 June 2007"),
    ("AGPL-3.0", "Affero General", "3", "program", "19 November 2007"),
)
GNU_FORMS = (
    "This {thing} is licensed under the GNU {kind} Public License, version {version}.",
    "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License, version {version}",
    "This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License version {version} as published by the Free Software Foundation.",
    "This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.",
    "GNU {kind} Public License Version {version}, {date}",
)
#: Titles of other whole texts (fixed values).
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("BSD-2-Clause", "BSD 2-Clause License. Redistribution and use in source and binary forms"),
    ("BSD-3-Clause", "BSD 3-Clause License. Redistribution and use in source and binary forms"),
)
#: Function words, which vectors leave out (fixed values).
STOP = frozenset("a an and any are as at be been by can could do for from had has have if in into is it its may more no not of on or other shall should so such than that the their them then there these they this to was were which will with would you your".split())
#: Names as SPDX writes them, the GNU ones also with -only and -or-later; licences whose whole text is in licence_texts/.
SPDX = ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")
WHOLE = ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0")
#: Least cosine of a match; that at which a whole text goes before notices and opening clauses; lines that a window joins at most.
LEAST_COSINE, SURE_COSINE, WINDOW_LINES = 0.75, 0.9, 3
#: Share of a template's squared weight whose tokens must stand in a window: one word said over and over is no notice.
COVER = 0.75
#: A template of more tokens is a whole text.
SHORT = 400
#: Names of licence files, whose verdict their directory hands down.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.].*)?$"
_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

@cache
def every_template() -> tuple[tuple[str, str], ...]:
    """Notices and opening clauses, SPDX lines, and whole texts."""
    tags = [(name, f"SPDX-License-Identifier: {name}{end}") for name in SPDX for end in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    gnu = [(name, form.format(kind=kind, version=version, thing=thing, date=date)) for name, kind, version, thing, date in GNU for form in GNU_FORMS]
    return (*TEMPLATES, *gnu, *TITLES, *tags, *((name, pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()) for name in WHOLE))


def tokens_of(text: str) -> list[str]:
    """Runs of letters a-z (A-Z lower-cased) and digits, numbers of versions whole; function words left out."""
    return [t for t in _TOKEN.findall(text.translate(_LOWER)) if t not in STOP]


_LOWER = {c: c + 32 for c in range(65, 91)}


class Templates:
    """Templates as unit TF-IDF vectors. A token of no template has the weight of the rarest.

    A window matches by its cosine, if the template's tokens that stand in it have COVER of its squared
    weight. So a window needs one of the template's key tokens, the heaviest ones whose absence alone forbids
    a match; and a stretch of text whose distinct tokens have less is of no use for that template.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...] | None = None):
        texts = every_template() if templates is None else templates
        tokens = [(name, Counter(tokens_of(text))) for name, text in texts]
        n = len(tokens)
        df = Counter(t for _, c in tokens for t in c)
        self.idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
        self.rarest = math.log(1 + n) + 1
        self.index: dict[str, list[tuple[int, float]]] = {}
        self.names = [name for name, _ in tokens]
        self.lengths = [sum(c.values()) for _, c in tokens]
        self.whole = [k > SHORT or text.count("\n\n") > 1 for k, (_, text) in zip(self.lengths, texts, strict=True)]
        self.ids = {t: k for k, t in enumerate(df)}
        self.id_idf = np.array([*self.idf.values(), self.rarest])
        self.gain = np.zeros((n, len(df) + 1))  # what one token adds to the dot product; the last is of no template
        self.square = np.zeros((n, len(df) + 1))  # squared weights
        self.key = np.zeros(len(df) + 1, bool)
        for i, (_, counts) in enumerate(tokens):
            weights = {t: k * self.idf[t] for t, k in counts.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            for t, w in weights.items():
                self.index.setdefault(t, []).append((i, w / norm))
                self.gain[i, self.ids[t]] = self.idf[t] * w / norm
                self.square[i, self.ids[t]] = (w / norm) ** 2
            left = 1.0
            for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
                if left < COVER - 1e-6:
                    break
                left -= (w / norm) ** 2
                self.key[self.ids[t]] = True
        keys = [t.split(".")[0].encode() for t, k in self.ids.items() if self.key[k]]
        raw, ends = np.frombuffer(b"".join(keys), np.uint8), np.cumsum([len(k) for k in keys], dtype=np.int64)
        self.gate = np.unique(span_hashes(raw, ends - [len(k) for k in keys], ends)) if keys else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.gate & np.uint64(0xFFFF)).astype(np.int64)] = True

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rows of a block with a run of letters and digits that a key token begins with; no other row can match."""
        low = data + (32 * ((data >= 65) & (data <= 90))).astype(np.uint8)
        starts, ends = runs(((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)), offsets)
        found = span_hashes(low, starts, ends)
        at = np.flatnonzero(self.seen[(found & np.uint64(0xFFFF)).astype(np.int64)])
        at = at[np.isin(found[at], self.gate)]
        return np.unique(np.searchsorted(offsets, starts[at], "right") - 1)

    def rank(self, i: int, cosine: float) -> tuple[bool, float, str]:
        """The order of matches, best first: whole texts that are sure, the cosine, the name."""
        return not (self.whole[i] and cosine >= SURE_COSINE), -cosine, self.names[i]

    def best(self, tokens: list[str]) -> tuple[bool, float, str]:
        """The first match of these tokens as a whole, by rank."""
        counts = Counter(tokens)
        norm = math.sqrt(sum((k * self.idf.get(t, self.rarest)) ** 2 for t, k in counts.items()))
        dots: dict[int, list[float]] = {}
        for t, k in counts.items():
            for i, w in self.index.get(t, ()):
                dot = dots.setdefault(i, [0.0, 0.0])
                dot[0] += k * self.idf[t] * w
                dot[1] += w * w
        return min((self.rank(i, round(d / norm, 9)) for i, (d, held) in dots.items() if held >= COVER), default=_NONE)

    def slide(self, tokens: list[str], chosen: list[int]) -> tuple[bool, float, str]:
        """The first match by rank of any window of the length of a chosen template, against that template.

        Dot products are differences of running sums; a token counts for COVER in the windows that begin after its
        last place before. The squared norm changes by idf**2 (2 k + 1) as a token
        enters or leaves that stands k more times in the window; k comes from the token's sorted places.
        """
        own: dict[str, int] = {}
        ids = np.array([self.ids.get(t, -1) for t in tokens])
        for at in np.flatnonzero(ids < 0).tolist():
            ids[at] = own.setdefault(tokens[at], len(self.ids) + len(own))
        n, known = len(ids), np.minimum(ids, len(self.ids))
        square = self.id_idf[known] ** 2
        order = np.argsort(ids, kind="stable")
        keys = ids[order] * (n + 1) + order
        nth = np.arange(n)
        last = np.full(n, -1)
        repeated = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
        last[order[repeated + 1]] = order[repeated]
        top = _NONE
        for length in sorted({min(n, self.lengths[i]) for i in chosen}):
            enters, leaves = np.empty(n), np.empty(n)
            enters[order] = nth - np.searchsorted(keys, ids[order] * (n + 1) + np.maximum(order - length + 1, 0))
            leaves[order] = np.searchsorted(keys, ids[order] * (n + 1) + np.minimum(order + length, n)) - nth - 1
            plus, minus = np.cumsum(square * (2 * enters + 1)), np.cumsum(square * (2 * leaves + 1))
            norms = plus[length - 1 :] - np.concatenate([[0.0], minus[: n - length]])
            norms = np.sqrt(np.maximum(norms, 1e-6))
            for i in chosen:
                if min(n, self.lengths[i]) != length:
                    continue
                total = np.concatenate([[0.0], np.cumsum(self.gain[i][known])])
                cosines = (total[length:] - total[: n - length + 1]) / norms
                own_at = np.flatnonzero(self.square[i][known] > 0)
                steps = np.zeros(n + 2)
                np.add.at(steps, np.maximum(last[own_at] + 1, np.maximum(own_at - length + 1, 0)), self.square[i][known[own_at]])
                np.add.at(steps, own_at + 1, -self.square[i][known[own_at]])
                cosines = np.where(np.cumsum(steps)[: n - length + 1] >= COVER - 1e-9, cosines, 0.0)
                at = int(np.argmax(cosines))
                if cosines[at] >= LEAST_COSINE - 1e-6:
                    top = min(top, self.rank(i, self.cosine(tokens[at : at + length], i)))
        return top

    def cosine(self, tokens: list[str], i: int) -> float:
        """The cosine of tokens and template i, without running sums; 0 below COVER."""
        counts = Counter(tokens)
        if sum(self.square[i, self.ids[t]] for t in counts if t in self.ids) < COVER - 1e-9:
            return 0.0
        norm = math.sqrt(sum((k * self.idf.get(t, self.rarest)) ** 2 for t, k in counts.items()))
        return round(float(sum(k * self.gain[i, self.ids[t]] for t, k in counts.items() if t in self.ids)) / norm, 9)

    def scan(self, text: str) -> tuple[str | None, float]:
        """The best match of any window, or none below LEAST_COSINE.

        Windows are up to WINDOW_LINES whole lines, and as many tokens as each template has, wherever they
        begin: the first find notices with a line of their own, the second those inside longer lines and
        across lines. Only those with a key token are looked at, as no other one can match.
        """
        lines = [t for x in text.split("\n") if (t := tokens_of(x))]
        tokens = [t for x in lines for t in x]
        none = len(self.ids)
        ids = np.array([self.ids.get(t, none) for t in tokens], np.int64)
        hits = np.flatnonzero(self.key[ids])
        if not len(hits):
            return None, 0.0
        top = _NONE
        for i in np.unique(np.searchsorted(np.cumsum([len(x) for x in lines]), hits, "right")).tolist():
            for at in range(max(0, i - WINDOW_LINES + 1), i + 1):
                for to in range(i + 1, min(len(lines), at + WINDOW_LINES) + 1):
                    top = min(top, self.best([t for x in lines[at:to] for t in x]))
        for length, chosen in self.groups():
            for a, b in regions(hits.tolist(), length, len(tokens)):
                held = self.square[chosen][:, np.unique(ids[a:b])].sum(axis=1)
                able = [i for i, x in zip(chosen, held.tolist(), strict=True) if x >= COVER - 1e-6]
                if able:
                    top = min(top, self.slide(tokens[a:b], able))
        return (top[2], -top[1]) if -top[1] >= LEAST_COSINE else (None, 0.0)

    def groups(self) -> list[tuple[int, list[int]]]:
        """Templates of about one length, by doubling, with the longest's length."""
        by: dict[int, list[int]] = {}
        for i, n in enumerate(self.lengths):
            by.setdefault(max(n, 16).bit_length(), []).append(i)
        return [(max(self.lengths[i] for i in chosen), chosen) for _, chosen in sorted(by.items())]


_NONE = (True, 0.0, "")


def regions(hits: list[int], reach: int, end: int) -> list[tuple[int, int]]:
    """Spans of reach on either side of each place, joined where they meet."""
    out: list[tuple[int, int]] = []
    for h in hits:
        a, b = max(0, h - reach), min(end, h + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@cache
def every() -> Templates:
    """The templates, once a process."""
    return Templates()


def scan_files(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(doc_id, path, own_license, cosine) for every file: the licence that its whole text states, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = every()
        for batch in batches:
            found = []
            for _, data, offsets in blocks(batch.column(2)):
                own: list[tuple[str | None, float]] = [(None, 0.0)] * (len(offsets) - 1)
                for r in known.candidates(data, offsets).tolist():
                    own[r] = known.scan(data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "path", "own_license", "cosine"])

    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, path string, own_license string, cosine double")


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(doc_id, path, own_license, cosine, license, inherited_from) for every row of files.

    license is the file's own, else that of the nearest ancestor directory (its own directory first) that
    holds a licence file with a recognised text; inherited_from names that directory ('' is the root). Of
    several licence files in a directory the higher cosine wins, then the first name. Null texts state
    nothing; a null path inherits nothing; repeated rows stay repeated; an empty table gives none; other
    columns are ignored. Paths are separated by '/'.

    Method: texts are scanned in one pass. Inheritance runs over distinct directories only: each explodes to
    its ancestors, joins those with a licence by equality (an ancestor of very many directories, as the root
    is of all, by skew_join) and keeps the deepest. Files then meet their directory; directories with very
    many files are broadcast (skew_join).
    """
    own = stored(scan_files(files, id_col, path_col, text_col).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    given = own.where(F.col("own_license").isNotNull() & name.rlike(LICENCE_FILE)).groupBy("dir").agg(F.min(F.struct(-F.col("cosine"), F.col("own_license"))).getField("own_license").alias("dir_license"))
    dirs = own.where("dir is not null").groupBy("dir").agg(F.count("*").alias("files"))
    parts = F.split("dir", "/")
    ancestors = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    up = stored(dirs.select("dir", "files", F.posexplode(ancestors).alias("depth", "above")))
    below = up.groupBy("above").agg(F.count("*").alias("weight"))
    # Every ancestor is on the right side, with a licence or without, so that a hot one is known as such.
    every_above = below.join(given.withColumnRenamed("dir", "above"), "above", "left")
    nearest = skew_join(up, every_above, "above", "weight", up.count()).where("dir_license is not null").groupBy("dir", "files").agg(F.max(F.struct("depth", "above", "dir_license")).alias("n"))
    nearest = nearest.select("dir", "files", F.col("n.dir_license").alias("dir_license"), F.col("n.above").alias("above"))
    out = skew_join(own, nearest, "dir", "files", own.count(), "left")
    inherits = F.col("own_license").isNull()
    return out.select("doc_id", "path", "own_license", "cosine", F.coalesce("own_license", "dir_license").alias("license"), F.when(inherits, F.col("above")).alias("inherited_from"))


def op7_rows(docs: DataFrame) -> DataFrame:
    """Every document as a file of a tree by its source and id; every 11th is a licence file."""
    path = F.expr("concat(coalesce(source, 'none'), case when doc_id % 22 = 0 then concat('/a', doc_id % 7, '/LICENSE') when doc_id % 11 = 0 then '/LICENSE' else concat('/a', doc_id % 7, '/b', doc_id % 29, '/f', doc_id, '.txt') end)")
    out = license_scan(docs.select("doc_id", path.alias("path"), "text"))
    return out.select("doc_id", "path", "own_license", F.round("cosine", 6).alias("cosine"), "license", "inherited_from")
