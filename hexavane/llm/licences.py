"""Licence scan: sparse TF-IDF cosine of notices and licence files to templates, then inheritance from the nearest ancestor
directory by path joins.

Lines, sentences and paragraphs are compared with the notices, and so is each stretch of a notice's length that has a word
in the notice's place, so a notice counts wherever a longer paragraph goes on. Where a notice is found, stretches and the
whole text are compared with full licence texts, too. An SPDX tag names its licence itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .scratch import materialize
from .words import slices

# Short notices, headers, titles and opening sentences by which licences are known.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("proprietary", "All rights reserved."),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License that can be found in the LICENSE file."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "ISC License"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution."),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "Mozilla Public License, Version 1.1"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GFDL-1.2", "GNU Free Documentation License, Version 1.2"),
    ("GFDL-1.3", "GNU Free Documentation License, Version 1.3"),
    ("Artistic-1.0", "The Artistic License"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
]
TEMPLATES += [("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"), ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008")]
_GNU = [("GPL", "", {"1": "February 1989", "2": "June 1991", "3": "29 June 2007"}), ("LGPL", "Library ", {"2": "June 1991"}), ("LGPL", "Lesser ", {"2.1": "February 1999", "3": "29 June 2007"}), ("AGPL", "Affero ", {"3": "19 November 2007"})]
for _short, _kind, _versions in _GNU:
    for _v, _day in _versions.items():
        _name, _free = f"{_short}-{_v}" + ("" if "." in _v else ".0"), "library" if _short == "LGPL" else "program"
        _told = f"under the terms of the GNU {_kind}General Public License as published by the Free Software Foundation"
        TEMPLATES += [(_name, t) for t in (
            f"GNU {_kind.upper()}GENERAL PUBLIC LICENSE Version {_v}",
            f"GNU {_kind.upper()}GENERAL PUBLIC LICENSE Version {_v}, {_day}",
            f"Licensed under the GNU {_kind}General Public License, version {_v}.",
            f"This {_free} is free software; you can redistribute it and/or modify it {_told}; either version {_v} of the License, or (at your option) any later version.",
            f"This {_free} is free software; you can redistribute it and/or modify it {_told}; version {_v} of the License.",
            f"Licensed under the {_short}v{_v}.",
        )]
for _short, _long in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC", "-NonCommercial"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")):
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        TEMPLATES += [(f"CC-{_short}-{_v}", f"This work is licensed under a Creative Commons Attribution{_long} {_v} International License.")]
        TEMPLATES += [(f"CC-{_short}-{_v}", t) for t in [f"Licensed under CC {_short} {_v}."] if (f"CC-{_short}-{_v}", t) not in TEMPLATES]
#: Words that name a licence: a template that has one is met only by a stretch that has it, as with numbers, its version.
NAMES = frozenset("mit apache bsd isc mozilla boost eclipse artistic creative gnu".split())
#: Needed likewise, and rare enough in other texts to look for.
RARE = frozenset("license permission redistribution endorse unencumbered reserved neighboring cc cc0 gplv1 gplv2 gplv3 lgplv2 lgplv2.1 lgplv3 agplv3".split())
#: Words that tell a licence from its nearest kin: a stretch and its template have the same ones.
KINDS = frozenset("lesser affero sa nc nd sharealike noncommercial noderivatives noderivs".split())
#: A notice of fewer words counts as a line, sentence or paragraph alone, not amid a sentence about something else.
AMID = 8
#: Full texts of more words are compared with whole texts alone.
STRETCH = 400
GENERIC = "proprietary"
SPDX = re.compile(r"spdx-license-identifier:[ \t]*([( \t]*[a-z0-9][a-z0-9.+:-]*(?:[ \t)]+(?:and|or|with)[ \t(]+[a-z0-9][a-z0-9.+:-]*)*(?:[ \t]*\))*)", re.I)
LICENCE_FILE = re.compile(r"^(?:licen[cs]e|copying|unlicense|notice)(?:[.-].*)?$", re.I)
_TOKEN = re.compile(r"[a-z]+(?:\d+)?(?:\.\d+)?|\d+(?:\.\d+)?")
_VERSION = re.compile(r"\bv(?:er|ersion)?\.?[ \t]*(?=\d)")
PIECE = 2 << 20


@cache
def full_texts() -> list[tuple[str, str]]:
    """Name and full text of each licence in the folder beside this module; read on the driver alone."""
    return [(f.stem, f.read_text(encoding="utf-8", errors="replace")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def tokens(text: str) -> list[str]:
    """Words and numbers; v2, v. 2.0 and version 2 are the same, and licence and license."""
    return [t.removesuffix(".0") for t in _TOKEN.findall(_VERSION.sub("version ", text.lower()).replace("licence", "license"))]


class Matcher:
    """Unit TF-IDF vectors of the templates; weights come from the templates alone, so they are the same for any corpus."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float, anchors: list[str] | None = None):
        """``anchors``: given for full texts, which count only where a notice does; their numbers are not looked at."""
        self.threshold = threshold
        words = [tokens(t) for _, t in templates]
        bags = [Counter(w) for w in words]
        spread = Counter(w for b in bags for w in b)
        self.idf = {w: math.log(1 + len(bags) / n) for w, n in spread.items()}
        self.unknown = math.log(1 + len(bags))
        self.rows = []
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, ((name, _), bag) in enumerate(zip(templates, bags, strict=True)):
            raw = {w: c * self.idf[w] for w, c in bag.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.rows.append(name)
            for w, x in raw.items():
                self.postings.setdefault(w, []).append((i, x / norm))
        self.lengths = [len(w) for w in words]
        self.vectors: list[dict[str, float]] = [{} for _ in bags]
        for w, rows in self.postings.items():
            for i, x in rows:
                self.vectors[i][w] = x
        self.must = [frozenset(w for w in b if anchors is None and (w[0].isdigit() or w in NAMES or w in RARE)) for b in bags]
        self.kinds = [None if anchors is not None else KINDS & b.keys() for b in bags]
        self.anchors = self._anchors(len(bags)) if anchors is None else anchors
        self.places: dict[str, list[tuple[int, int]]] = {a: [] for a in self.anchors}
        for i, ((name, _), row) in enumerate(zip(templates, words, strict=True)):
            if name == GENERIC or (AMID <= len(row) if anchors is None else len(row) <= STRETCH):
                for q, w in enumerate(row):
                    if w in self.places:
                        self.places[w].append((i, q))

    def _anchors(self, n: int) -> list[str]:
        """Tokens without any of which no text fits a template: it lacks a needed word, or the rest of the template has too
        little weight to reach the threshold."""
        chosen: list[str] = []
        for needed in self.must:
            if needed & RARE and not needed & RARE & set(chosen):
                chosen.append("license" if "license" in needed else max(needed & RARE))
        left: dict[int, dict[str, float]] = {i: {} for i in range(n) if not self.must[i] & set(chosen)}
        for w, rows in self.postings.items():
            for i, x in rows:
                if i in left and w not in chosen:
                    left[i][w] = x
        while True:
            short = [i for i, r in left.items() if math.sqrt(sum(x * x for x in r.values())) >= self.threshold]
            if not short:
                return sorted(chosen)
            heaviest = max(left[short[0]], key=lambda w: (w != "version" and not w[-1].isdigit(), len(w), left[short[0]][w], w))  # long words are rare in other texts
            chosen.append(heaviest)
            for r in left.values():
                r.pop(heaviest, None)

    def pattern(self) -> str:
        return r"(?<![a-z0-9])(?:spdx-license-identifier|" + "|".join(re.escape(a).replace("license", "licen[cs]e") for a in self.anchors) + r")(?![a-z])"

    def fits(self, i: int, words: Counter) -> bool:
        """Whether the names, numbers and kind of template ``i`` are those of the words."""
        return self.must[i] <= words.keys() and (self.kinds[i] is None or self.kinds[i] == KINDS & words.keys())

    def best(self, text: str) -> tuple[str, float] | None:
        """Name and cosine of the nearest template, if it reaches the threshold; ties go to the earlier one."""
        found = self.nearest(tokens(text))
        return found and (self.rows[found[0]], found[1])

    def nearest(self, words: list[str]) -> tuple[int, float] | None:
        bag = Counter(words)
        raw = {w: c * self.idf.get(w, self.unknown) for w, c in bag.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        score: dict[int, float] = {}
        for w, x in raw.items():
            for i, y in self.postings.get(w, ()):
                score[i] = score.get(i, 0.0) + x * y
        reach = [i for i, x in score.items() if x >= self.threshold * norm and self.fits(i, bag)]
        if not reach:
            return None
        top = min(reach, key=lambda i: (-score[i], i))
        return top, score[top] / norm

    def stretches(self, words: list[str]) -> Iterator[tuple[int, float]]:
        """Templates that a stretch of their length reaches, an anchor of theirs in its place."""
        every, seen = frozenset(words), set()
        possible = [m <= every for m in self.must]
        for p, w in enumerate(words):
            for i, q in self.places.get(w, ()):
                start = max(p - q, 0)
                if not possible[i] or (i, start) in seen:
                    continue
                seen.add((i, start))
                bag = Counter(words[start : start + self.lengths[i]])
                own, dot, norm = self.vectors[i], 0.0, 0.0
                for word, c in bag.items():
                    x = c * self.idf.get(word, self.unknown)
                    norm += x * x
                    dot += x * own.get(word, 0.0)
                if dot >= self.threshold * math.sqrt(norm) and self.fits(i, bag):
                    yield i, dot / math.sqrt(norm)


def tagged(text: str) -> str | None:
    """Licence of the first SPDX tag; or-later and only are left out of names, as the templates have them."""
    tag = SPDX.search(text)
    if not tag:
        return None
    name = re.sub(r"\s*\)", ")", re.sub(r"\(\s*", "(", " ".join(tag[1].split())))
    while name.endswith(")") and name.count(")") > name.count("("):
        name = name[:-1]
    return re.sub(r"(?<=\d)(?:-only|-or-later|\+)(?![\w.-])", "", name)


class Scanner:
    """Licence and score of the best notice of a text, and of the full licence text that it is as a whole."""

    def __init__(self, matcher: Matcher):
        self.notice, self.full = matcher, Matcher(full_texts(), matcher.threshold, matcher.anchors)
        self.has = re.compile(matcher.pattern())

    def scan(self, text: str) -> tuple[tuple[str, float] | None, tuple[str, float] | None]:
        """An SPDX tag comes first, then a full text, then a notice, then a mere reservation of rights; of several, the best
        score, then the longest template."""
        tag = tagged(text)
        parts = [*text.split("\n"), *(y for x in re.split(r"\n\s*\n", text) for y in [x, *re.split(r"(?<=[.!?;])\s+", x)])]
        pairs = [m for m in (self.notice.nearest(tokens(x)) for x in dict.fromkeys(parts) if self.has.search(x.lower())) if m]
        words = tokens(text)
        pairs += self.notice.stretches(words)
        ranked = [(self.notice.rows[i] != GENERIC, round(v, 9), self.notice.lengths[i], self.notice.rows[i]) for i, v in pairs]
        whole = None
        if any(r[0] for r in ranked):
            ranked += [(2, round(v, 9), self.full.lengths[i], self.full.rows[i]) for i, v in self.full.stretches(words)]
            if all_of := self.full.nearest(words):
                whole = self.full.rows[all_of[0]], all_of[1]
                ranked.append((2, round(all_of[1], 9), self.full.lengths[all_of[0]], whole[0]))
        best = max(ranked, default=None)
        return whole, (tag, 1.0) if tag else best and (best[3], best[1])


def notices(files: DataFrame, matcher: Matcher, *, path: str, text: str) -> DataFrame:
    """path, whole (licence and score, if all of it is a full licence text), header (of its best notice) for files that have either.

    Only texts with an anchor token or an SPDX tag are sent to Python; that filter runs on the JVM and can lose nothing.
    """
    ship(files.sparkSession)
    anchored = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where(F.lower("text").rlike(matcher.pattern()))
    scanner = Scanner(matcher)
    kind = pa.struct([("licence", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            both = [scanner.scan(t) for t in piece.column(1).to_pylist()]
            whole, header = ([m and {"licence": m[0], "score": m[1]} for m in column] for column in zip(*both, strict=True)) if both else ([], [])
            yield pa.record_batch([piece.column(0), pa.array(whole, kind), pa.array(header, kind)], ["path", "whole", "header"])

    schema = "path string, whole struct<licence:string,score:double>, header struct<licence:string,score:double>"
    return anchored.mapInArrow(run, schema).where("whole IS NOT NULL OR header IS NOT NULL")


def parent(path: Column) -> Column:
    """Directory of a path, without a closing slash; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, *, threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES, path: str = "path", text: str = "text") -> DataFrame:
    """path, licence, score, scope (file, header, inherited or none), licence_path: one row for each distinct path.

    A file named like a licence, or whose whole text is a full licence text, is a licence file and covers its directory and all
    below it, but where a nearer one does; a file that is a short notice and no more is licensed by it and covers no other. A
    notice in a file itself comes first. Null paths are left out; null and empty texts have no notice; files that repeat a path
    count once, by their best notice; an empty table gives no rows; other columns are ignored, whatever their names. Of several
    licence files in a directory the best score, then the first path, counts. Long texts are scanned whole.
    """
    matcher = Matcher(templates, threshold)
    known = files.where(F.col(path).isNotNull())
    found = materialize(notices(known, matcher, path=path, text=text), "notices")
    own = found.groupBy("path").agg(F.max_by("header", F.struct("header.score", "header.licence")).alias("header"), F.max_by("whole", F.struct("whole.score", "whole.licence")).alias("whole"))
    named = F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENCE_FILE.pattern.replace("^(?:", "(?i)^(?:", 1))
    best = F.when(F.col("whole").isNotNull(), F.col("whole")).when(named, F.col("header"))
    own = materialize(own.withColumn("file", best), "own")
    order = F.struct((-F.col("file.score")).alias("score"), "path")
    covers = own.where("file IS NOT NULL").withColumn("dir", parent(F.col("path"))).groupBy("dir").agg(F.min_by("file", order).alias("given"), F.min_by("path", order).alias("licence_path"))
    paths = known.select(F.col(path).alias("path")).distinct()
    dirs = paths.select(parent(F.col("path")).alias("dir")).distinct()
    depth = F.size(F.split("dir", "/"))
    ups = F.transform(F.sequence(F.lit(0), depth), lambda n: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), n), "/"))
    above = dirs.select("dir", F.explode(F.array_distinct(ups)).alias("up"))
    nearest = above.join(covers.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("given", F.length("up")).alias("given"), F.max_by("licence_path", F.length("up")).alias("licence_path"))
    out = paths.join(own, "path", "left").withColumn("dir", parent(F.col("path"))).join(nearest, "dir", "left")
    scope = F.when(F.col("file").isNotNull(), "file").when(F.col("header").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    chosen = F.coalesce("file", "header", "given")
    source = F.when(F.coalesce("file", "header").isNotNull(), F.col("path")).otherwise(F.col("licence_path"))
    return out.select("path", chosen["licence"].alias("licence"), chosen["score"].alias("score"), scope.alias("scope"), source.alias("licence_path"))
