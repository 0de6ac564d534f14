"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

Every file's whole text is scanned. Where words of licensing occur, runs of sentences around them are compared to the
templates; the best cosine names the license. An SPDX tag names it outright. A file whose name says that it is a license file also speaks for its
directory: files without a notice of their own take the license of the nearest directory above them that has one. Where
names say nothing, files whose whole text is a notice can count as license files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..workspace import by_size, materialize, plain, small_enough

#: The templates, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]
# Notices that name no version say no more than the family.
TEMPLATES += [
    ("GPL", "Licensed under the GNU General Public License."),
    ("LGPL", "Licensed under the GNU Lesser General Public License."),
    ("AGPL", "Licensed under the GNU Affero General Public License."),
]
#: The titles of licenses; each stands bare and in the usual short sentences.
TITLES = {
    "MIT": ["MIT License", "The MIT License (MIT)"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache License Version 2.0, January 2004"],
    "GPL-3.0": ["GNU General Public License v3.0", "GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007", "GPL v3 license"],
    "GPL-2.0": ["GNU General Public License v2.0", "GNU General Public License, version 2", "GNU General Public License Version 2, June 1991", "GPL v2 license"],
    "LGPL-3.0": ["GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License Version 3, 29 June 2007", "Lesser GPL, version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License Version 2.1, February 1999", "Lesser GPL, version 2.1"],
    "AGPL-3.0": ["GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "GNU Affero General Public License Version 3, 19 November 2007"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"],
    "GPL": ["GNU General Public License", "GNU GPL"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License Version 2.0"],
    "ISC": ["ISC License"],
    "CC0-1.0": ["CC0 1.0 Universal license"],
    "Unlicense": ["The Unlicense"],
}
SHORT = ("{}", "Licensed under the {}", "Released under the {}", "This project is licensed under the {}", "Licensed under the {}. See the LICENSE file for details.")
#: Strings one of which every notice holds, and the names of license files.
HINTS = ("licen", "permission", "redistribut", "public domain", "free software", "spdx", "gpl")
#: Fixed value: a sentence that says of a license that it does not hold.
DENIED = r"\b(?:not|never|no longer|isn't|aren't|wasn't|cannot be)\s+(?:\w+\s+){0,2}(?:licen[sc]ed|released|distributed|available|covered)\b"
#: Sentences round a hint that tell it from others.
NEAR = 12
LICENSE_FILE = r"(?i)^(un)?licen[sc]e([-_.].*)?$|^copying([-_.].*)?$|^notice([-_.].*)?$"
LEAST_COSINE = 0.8
#: Licenses that a notice may name without a version.
FAMILIES = ("GPL", "LGPL", "AGPL")
#: Directories up to which their licenses are broadcast; more are shuffled.
BROADCAST_ROWS = 200_000

_WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
_DENIED = re.compile(DENIED)
_UNIT = re.compile(r"(?<=[.!?;:])\s+|\n")
_SPDX = re.compile(r"(?i:spdx-license-identifier:)[ \t]*(\(*[\w.+:-]+\)*(?:[ \t]+(?i:and|or|with)[ \t]+\(*[\w.+:-]+\)*)*)")
_OPERATOR = re.compile(r"(?i)\b(and|or|with)\b(?=[ \t])")
_THIRD_CLAUSE = re.compile(r"neither the names? .{1,300}?endorse or promote")


class Templates(NamedTuple):
    """names by column and words by row of a table of unit columns, the weights of the words, and the longest template's length."""

    names: list[str]
    place: dict[str, int]
    table: np.ndarray
    idf: np.ndarray
    rarest: float
    longest: int


def templates() -> Templates:
    docs = [(name, _WORD.findall(text.lower())) for name, text in TEMPLATES]
    df = Counter(w for _, words in docs for w in set(words))
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
    rare = max(idf.values())
    short = [(name, form.format(title)) for name, titles in TITLES.items() for title in titles for form in SHORT]
    short += [(name, f"License: {name}") for name in dict(TEMPLATES)]
    docs += [(name, _WORD.findall(text.lower())) for name, text in short]
    for _, words in docs:
        for w in words:
            idf.setdefault(w, rare)
    place = {w: k for k, w in enumerate(idf)}
    table = np.zeros((len(idf), len(docs)))
    for k, (_, words) in enumerate(docs):
        for w, n in Counter(words).items():
            table[place[w], k] = n * idf[w]
    return Templates([name for name, _ in docs], place, table / np.sqrt((table * table).sum(axis=0)), np.array(list(idf.values())), rare, max(len(words) for _, words in docs))


class _Run:
    """A bag of words that grows, and its cosines to all templates; words that no template has weigh as the rarest."""

    def __init__(self, t: Templates) -> None:
        self.t, self.counts, self.sums, self.square, self.words = t, Counter(), np.zeros(len(t.names)), 0.0, 0

    def add(self, words: list[str]) -> None:
        for w in words:
            k = self.t.place.get(w)
            weight = self.t.rarest if k is None else self.t.idf[k]
            self.square += (2 * self.counts[w] + 1) * weight * weight
            self.counts[w] += 1
            if k is not None:
                self.sums += weight * self.t.table[k]
        self.words += len(words)

    def best(self) -> tuple[float, str | None]:
        k = int(self.sums.argmax())
        return (float(self.sums[k]) / math.sqrt(self.square), self.t.names[k]) if self.sums[k] > 0 else (0.0, None)


def _tagged(text: str) -> str | None:
    """The SPDX expression that a text's tags declare, known names in their usual case; several tags all hold."""
    usual = {n.lower(): n for n, _ in TEMPLATES}
    found = {}
    for x in _SPDX.findall(text):
        x = x.strip(" \t.:-")
        x = x.rstrip(")") + ")" * min(x.count("("), x.count(")")) if x.count(")") != x.count("(") else x
        x = _OPERATOR.sub(lambda m: m[0].upper(), re.sub(r"[\w.+:-]+", lambda m: usual.get(m[0].lower(), m[0]), x))
        if x and x.upper() not in ("NONE", "NOASSERTION"):
            found[x] = None
    if len(found) > 1:
        return " AND ".join(f"({x})" if " " in x else x for x in found)
    return next(iter(found), None)


def detect(text: str | None, t: Templates) -> tuple[float, str | None]:
    """(cosine, license) of the best run of sentences in one whole text; (0, None) if none has a hint of a license.

    An SPDX tag goes first and has cosine 1. A run also starts at the first word with a hint, so that what is licensed
    may have any name. A sentence that denies a license is no notice. A version that some run names well enough goes
    before the bare family.
    """
    low = (text or "").lower()
    if not any(h in low for h in HINTS):
        return 0.0, None
    if "spdx" in low and (tag := _tagged(text)):
        return 1.0, tag
    units = [u for u in _UNIT.split(low) if u.strip()]
    words = [_WORD.findall(u) for u in units]
    best: dict[str, float] = {}
    places = set()
    for k, u in enumerate(units):
        if not any(h in u for h in HINTS) or _DENIED.search(u):
            continue
        place = hash(tuple(units[max(0, k - 2) : k + NEAR]))
        if place in places:  # the same sentences stood here before
            continue
        places.add(place)
        hint = next((i for i, w in enumerate(words[k]) if any(h in w for h in HINTS)), 0)
        before = next((n for n in range(k - 1, max(-1, k - 3), -1) if _DENIED.search(units[n])), k - 3)
        for first, skip in [(n, 0) for n in range(k, max(-1, before), -1)] + [(k, hint)] * (hint > 0):
            run = _Run(t)
            for last in range(first, len(units)):
                run.add(words[last][skip:] if last == first else words[last])
                if last < k or not run.words:
                    continue
                if run.words > 1.5 * t.longest:
                    break
                cosine, name = run.best()
                if name and cosine > best.get(name, 0.0):
                    best[name] = cosine
                if cosine < 0.5 and last - k > NEAR:
                    break
    if not best:
        return 0.0, None
    name = max(best, key=lambda n: (best[n], n))
    versions = [n for n in best if n.startswith(f"{name}-") and best[n] >= LEAST_COSINE] if name in FAMILIES else []
    name = max(versions, key=lambda n: (best[n], n), default=name)
    # the two clauses of BSD-2-Clause are a part of BSD-3-Clause
    if name == "BSD-2-Clause" and _THIRD_CLAUSE.search(" ".join(w for u in words for w in u)):
        return best[name], "BSD-3-Clause"
    return best[name], name


def all_notice(text: str, t: Templates, least: float = LEAST_COSINE) -> bool:
    """True if a text as a whole, all its words, is as near to a template as a notice has to be."""
    words = _WORD.findall(text.lower())
    if len(words) > 1.5 * t.longest:
        return False
    run = _Run(t)
    run.add(words)
    return run.best()[0] >= least


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: list[str] | None = None, least: float = LEAST_COSINE, by_content: bool = False) -> DataFrame:
    """(path, license, score, origin, inherited_from) for each row of files, and the columns in keep.

    origin is `file` for a notice of the file's own, `directory` for one inherited, `none` else. score is the cosine of
    the notice, also of the inherited one. Of several license files in a directory the best cosine holds, ties to the
    first name. With `by_content` a file whose whole text is a notice is a license file too; those called so go first. A null path has no directory and inherits nothing; a null or empty text has no notice. Rows that repeat
    come back as often. Other columns are not read; an empty table gives an empty result.
    """
    keep = [c for c in keep or [] if c != "path"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = templates()
        for x in by_size(batches, "_text"):
            found = [detect(t, known) for t in x["_text"]]
            speaks = [by_content and s >= least and all_notice(t, known, least) for (s, _), t in zip(found, x["_text"], strict=True)]
            yield plain(x.drop(columns="_text").assign(_own=[n if s >= least else None for s, n in found], _score=[float(s) for s, _ in found], _speaks=speaks))

    named = files.select(*keep, F.col(path_col).alias("path"), F.col(text_col).alias("_text"))
    kept = ", ".join(f"`{c}` {t}" for c, t in named.drop("_text").dtypes)
    rows = named.mapInPandas(run, f"{kept}, _own string, _score double, _speaks boolean")
    rows = rows.withColumn("_dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("_name", F.regexp_extract("path", r"([^/]*)$", 1))
    rows = materialize(rows, "notices")
    called = F.col("_name").rlike(LICENSE_FILE)
    dirs = rows.filter(F.col("_own").isNotNull() & F.col("path").isNotNull() & (called | F.col("_speaks")))
    dirs = dirs.groupBy("_dir").agg(F.min(F.struct((~called).alias("f"), (-F.col("_score")).alias("s"), "_name", F.col("_own").alias("own"))).alias("b"))
    dirs = dirs.select(F.col("_dir").alias("_up"), F.col("b.own").alias("_got"), (-F.col("b.s")).alias("_got_score"))
    # only directories are joined, each once: a directory with a third of all files is one row
    own = rows.filter(F.col("path").isNotNull()).select("_dir").distinct()
    parts = F.split("_dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ups = own.select("_dir", F.posexplode(chain).alias("_depth", "_up"))
    nearest = ups.join(dirs, "_up").groupBy("_dir").agg(F.max(F.struct("_depth", "_up", "_got", "_got_score")).alias("n"))
    nearest = nearest.select(F.col("_dir").alias("_d"), "n._up", "n._got", "n._got_score")
    nearest = materialize(nearest, "nearest")
    nearest = F.broadcast(nearest) if small_enough(nearest, BROADCAST_ROWS) else nearest
    out = rows.join(nearest, (F.col("_dir") == F.col("_d")) & F.col("path").isNotNull(), "left")
    mine = F.col("_own").isNotNull()
    theirs = ~mine & F.col("_got").isNotNull()
    return out.select(*keep, "path", F.coalesce("_own", "_got").alias("license"), F.when(mine, F.col("_score")).when(theirs, F.col("_got_score")).otherwise(F.lit(0.0)).alias("score"), F.when(mine, "file").when(theirs, "directory").otherwise("none").alias("origin"), F.when(theirs, F.col("_up")).alias("inherited_from"))
