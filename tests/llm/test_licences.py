import math
import re
from collections import Counter

from tessella.llm.licences import LICENCE_FILE, TEMPLATES, TERM, TRIGGER, licence_scan


def brute(rows, threshold=0.45, share=0.25):
    terms = lambda t: re.findall(TERM, t.lower())
    found = []
    for k, (i, path, text) in enumerate(rows):
        if text:
            named = bool(path and re.search(LICENCE_FILE, path))
            lines = list(x for x in text.split("\n") if re.search(TRIGGER, x))
            found += [(k, n, named) for n in (list(dict.fromkeys([*lines, text])) if named else lines)]
    df, total = Counter(), len(found)
    for _, n, _ in found:
        df.update(set(terms(n)))
    idf = lambda w: math.log((1 + total) / (1 + df[w])) + 1

    def vector(t):
        v = {w: c * idf(w) for w, c in Counter(terms(t)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    templates = [(lic, vector(t)) for lic, t in TEMPLATES]

    def best(n):
        v = vector(n)
        s, lic = min((-round(sum(x * t.get(w, 0) for w, x in v.items()), 9), lic) for lic, t in templates)
        return (-s, lic) if -s >= threshold else None

    own, gives = {}, {}
    for k, (i, path, text) in enumerate(rows):
        b = [(best(n), n, named) for kk, n, named in found if kk == k]
        b = [x for x in b if x[0]]
        if b:
            own[k] = min(((-s, lic) for (s, lic), _, _ in b))
            if path is not None and (b[0][2] or sum(len(terms(n)) for _, n, _ in b) >= share * len(text.split())):
                folder = re.sub(r"/?[^/]*$", "", path)
                gives[folder] = min(gives.get(folder, (1, "", "")), (*own[k], path))
    out = []
    for k, (i, path, _) in enumerate(rows):
        if k in own:
            out.append((i, path, own[k][1], "header", -own[k][0], path))
            continue
        g = None
        if path is not None:
            f = re.sub(r"/?[^/]*$", "", path)
            while g is None:
                g = gives.get(f)
                if not f:
                    break
                f = f.rpartition("/")[0]
        out.append((i, path, g[1], "inherited", -g[0], g[2]) if g else (i, path, None, "none", None, None))
    return out


ROWS = [
    (1, "a/b/c/x.py", "some words here\nReleased under the MIT License.\nmore " + "words " * 40),
    (2, "a/b/c/y.py", "nothing " * 30), (3, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (4, "a/b/z.py", "nothing"), (5, "q/w/z.py", "nothing"), (6, "q/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    (7, "q/w/e/r/deep.py", ""), (8, "top.py", None), (9, None, "nothing"), (10, None, "x " * 50 + "\nAll rights reserved."),
    (11, "n/notice.md", "hello there"), (12, "n/f.c", "we talk about a licence for dogs and many other things that are not about it at all"),
    (13, "m/short.txt", "Licensed under CC BY-NC 4.0."), (14, "m/f.c", "code"), (15, "abc/f.c", "code"), (4, "a/b/z.py", "nothing"),
    (16, "a/b/LICENCE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
]


def clean(rows):
    return sorted([(a, b, c, d, None if e is None else round(e, 6), f) for a, b, c, d, e, f in rows], key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 1, "own") for r in ROWS], "file_id long, path string, text string, licence int, folder string")
    got = licence_scan(df)
    assert got.columns == ["file_id", "path", "licence", "origin", "score", "source_path"]
    assert clean(map(tuple, got.collect())) == clean(brute(ROWS))
    by = {r.file_id: (r.licence, r.origin) for r in got.collect()}
    assert by[2] == ("MIT", "inherited") and by[4] == ("MIT", "inherited") and by[7] == ("GPL-3.0", "inherited") and by[15] == (None, "none") and by[14] == ("CC-BY-NC-4.0", "inherited")
    assert licence_scan(df.limit(0)).count() == 0
    root = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b", "x")], "file_id long, path string, text string")
    assert {r.licence for r in licence_scan(root).collect()} == {"MIT"}


HEADERS = {
    "// Licensed under the MIT license. See LICENSE file in the project root.": "MIT", "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "/* SPDX-License-Identifier: BSD-3-Clause */": "BSD-3-Clause", "SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
    "SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1", "SPDX-License-Identifier: ISC": "ISC", "SPDX-License-Identifier: EPL-2.0": "EPL-2.0", "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0",
    "// Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "BSD-3-Clause",
    "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n# 1. Redistributions of source code must retain the above copyright\n"
    "#    notice, this list of conditions and the following disclaimer.\n# 2. Redistributions in binary form must reproduce the above copyright\n#    notice, this list of conditions and the following disclaimer in the\n"
    "#    documentation and/or other materials provided with the distribution.\nimport os": "BSD-2-Clause",
    "/*\n * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n"
    " * version 2.1 of the License, or (at your option) any later version.\n */\nint x;": "LGPL-2.1",
    "// See LICENSE file in the project root.": "Apache-2.0", "// Licensed under the Frobnicate license. See LICENSE file in the project root.": None, "Licensed under the Frobnicate terms only, licence 7.": None, "nothing": "Apache-2.0",
}


def test_usual_headers(spark):
    rows = [(0, "t/LICENSE", "Licensed under the Apache License, Version 2.0."), *((i, f"t/src{i}/f.c", h + "\n\n" + "code " * 60) for i, h in enumerate(HEADERS, 1))]
    got = {r.file_id: r for r in licence_scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert {h: got[i].licence for i, h in enumerate(HEADERS, 1)} == HEADERS
    assert [got[i].origin for i in range(len(HEADERS) - 3, len(HEADERS) + 1)] == ["inherited", "none", "none", "inherited"]


def test_long_texts_and_texts_without_terms(spark):
    """What the bound of the length rules out is what the brute-force form rules out; a licence file may hold no term at all.
    No folder here gives a licence to a file with an unmatched notice: the brute-force form has no rule for these."""
    filler = [f"term{i} licence word{i % 7}" for i in range(400)]
    rows = [
        (1, "l/LICENSE", "***\n---"), (2, "l/a.c", "x"), (3, "m/COPYING", " ".join(filler)), (4, "m/a.c", "x"), (5, "o5/a.c", " ".join(filler) + " Released under the MIT License. " + " ".join(filler)),
        (6, "o6/b.c", "Released under the MIT License." * 300), (7, "o7/c.c", "Licensed under the Apache License, Version 2.0, with some other words that the template does not hold."), (8, "p/LICENSE", "\u8a31\u53ef"),
        *((100 + i, f"r/f{i}.c", f"license {f}") for i, f in enumerate(filler[:50])),
    ]
    df = spark.createDataFrame(rows, "file_id long, path string, text string")
    assert clean(map(tuple, licence_scan(df).collect())) == clean(brute(rows))
