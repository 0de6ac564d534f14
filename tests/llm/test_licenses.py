"""Standard notices, headers and texts, each by its own license."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenarc.llm import licenses, queries

GNU = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
BSD = "Copyright (c) 2020, Someone\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
THIRD = "3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
NOTICES = [
    ("MIT", "MIT License"), ("MIT", "License: MIT"), ("MIT", "Licensed under the MIT license"), ("MIT", "Frobnicator is licensed under the MIT License."),
    ("MIT", "# SPDX-License-Identifier: MIT\nimport os"), ("Apache-2.0", "// SPDX-License-Identifier: apache-2.0"), ("GPL-2.0-only WITH Linux-syscall-note", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */"),
    ("(MIT OR Apache-2.0) AND ISC", "SPDX-License-Identifier: MIT or Apache-2.0\nSPDX-License-Identifier: ISC\n"), (None, "SPDX-License-Identifier: NOASSERTION"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004"), ("GPL-3.0", GNU.format("")), ("AGPL-3.0", GNU.format("Affero ")), ("LGPL-3.0", GNU.format("Lesser ")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"),
    ("BSD-2-Clause", BSD.format("")), ("BSD-3-Clause", BSD.format(THIRD.format("the copyright holder"))), ("BSD-3-Clause", BSD.format(THIRD.format("Frobnicator Incorporated"))), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("LGPL-2.1", "Lesser GPL, version 2.1"), ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"), ("GPL", "Licensed under the GNU General Public License."),
    (None, "This file is not licensed under the terms of the MIT license."), ("MIT", "The fonts are not licensed under the Apache License, Version 2.0. The code is licensed under the MIT License."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MIT", "Released under the MIT License. " * 3000), ("ISC", "word " * 50_000 + ". ISC License"), (None, "license text permission here. " * 5000),
    (None, "She had no license to drive, and permission was never asked."), (None, "Die Lizenz gilt nur mit license plate und mit Ausweis."), (None, "the licensed driver had a word with us about the weather and more"),
]


@pytest.mark.parametrize(("want", "text"), NOTICES)
def test_notice(want, text):
    score, name = licenses.detect(text, licenses.templates())
    assert (name if score >= licenses.LEAST_COSINE else None) == want


def test_scan_of_odd_tables(spark):
    rows = [("a/LICENSE", "MIT License", 1), ("a/LICENCE.txt", "MIT License", 2), ("a/x", None, 3), ("a/x", None, 3), ("a/b/COPYING", "GNU General Public License, version 2", 4), ("a/b/LICENSE", "GNU General Public License, version 3", 5), ("a/b/c/d", "", 6), (None, "MIT License", 7), (None, None, 8), ("top", "x", 9)]
    files = spark.createDataFrame(rows, "path string, text string, _dir int").withColumns({"license": F.lit("clash"), "_own": F.lit("clash")})
    got = sorted(((r.path or "", r.license, r.origin, r.inherited_from) for r in licenses.scan(files, keep=["path"]).collect()), key=repr)
    # equal cosines: the file that comes first by name speaks for its directory
    want = [("a/LICENSE", "MIT", "file", None), ("a/LICENCE.txt", "MIT", "file", None), ("a/x", "MIT", "directory", "a"), ("a/x", "MIT", "directory", "a"), ("a/b/COPYING", "GPL-2.0", "file", None), ("a/b/LICENSE", "GPL-3.0", "file", None), ("a/b/c/d", "GPL-2.0", "directory", "a/b"), ("", "MIT", "file", None), ("", None, "none", None), ("top", None, "none", None)]
    assert got == sorted(want, key=repr)


def slow_cosines(text):
    """The best cosine of any run of whole sentences with any template, by plain vectors."""
    t = licenses.templates()
    units = [licenses._WORD.findall(u) for u in licenses._UNIT.split(text.lower()) if u.strip()]
    best = 0.0
    for i in range(len(units)):
        for j in range(i + 1, len(units) + 1):
            own = Counter(w for u in units[i:j] for w in u)
            x = {w: n * (t.idf[t.place[w]] if w in t.place else t.rarest) for w, n in own.items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            for k in range(len(t.names)):
                best = max(best, sum(v * t.table[t.place[w], k] for w, v in x.items() if w in t.place) / norm if norm else 0.0)
    return best


@pytest.mark.parametrize("text", ["One. Released under the MIT License. Two words.", "A b c. License: ISC\nfoo", "Licensed under CC BY 4.0. And more. Then again: Apache License 2.0."])
def test_cosine_by_brute_force(text):
    assert licenses.detect(text, licenses.templates())[0] == pytest.approx(slow_cosines(text))


def test_query_inherits_from_a_document_that_is_all_notice(spark, tmp_path):
    """A document of nothing but a notice speaks for its source and language; prose that ends in one does not."""
    prose = "She went down to the river and looked for the boat that was not there. "
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.", "en", "a"), (2, prose, "en", "a"), (3, prose, "de", "a"), (4, None, "en", "a"), (5, prose + "Released under the MIT License.", "en", "a"),
        (6, prose * 3 + "Released under the MIT License.", "en", "b"), (7, prose, "en", "b"), (8, "Not licensed under the MIT License.", "fr", "b"), (9, prose, "fr", "b"), (10, "Released under the MIT License.", None, None), (11, "", None, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.origin, r.inherited_from) for r in queries.op2_licenses(spark, str(tmp_path)).collect()}
    none, apache = (None, "none", None), ("Apache-2.0", "directory", "a/en")
    mit = ("MIT", "file", None)
    assert got == {1: ("Apache-2.0", "file", None), 2: apache, 3: none, 4: apache, 5: mit, 6: mit, 7: none, 8: none, 9: none, 10: mit, 11: none}
    files = spark.createDataFrame([("a/LICENSE-x", "See the file for details of the thing. Released under the MIT License."), ("a/b", rows[0][1]), ("a/c", ""), (None, rows[0][1])], "path string, text string")
    assert {(r.path, r.license) for r in licenses.scan(files, by_content=True).collect()} == {("a/LICENSE-x", "MIT"), ("a/b", "Apache-2.0"), ("a/c", "MIT"), (None, "Apache-2.0")}
