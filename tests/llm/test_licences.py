"""Operator 9: texts that wrap, notices of families it was and wasn't fitted to, verdicts against a plain version."""

import re

from lexiloom.llm import license

MIT = '''Copyright (c) 2019 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
'''
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""
NAMED = {
    "Licensed under the Eclipse Public License 2.0": "EPL", "License: AGPL-3.0": "AGPL", "SPDX-License-Identifier: ISC": "ISC", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "MIT OR Apache-2.0 license": "Apache-2.0,MIT",
    "Licensed under the Mozilla Public License 2.0": "MPL-2.0", "released into the public domain, see Unlicense": "Public-Domain", MIT: "MIT", GPL: "GPL", "// SPDX-License-Identifier: GPL-2.0-only\nint x;": "GPL",
}
NONE = ("Licensed under the Artistic License 2.0.", "SIL Open Font License", "Licensed under the Upstream Compatibility License v1.0", "Licensed under the Nokia Open Source License", "License: Sleepycat", "mit der Bahn", "The public library", "a boost for the eclipse", "", None, "copyright " * 40_000)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], "doc_id bigint, text string, families string, line string")


def test_families(spark):
    rows = [*NAMED, *NONE]
    got = {r.doc_id: r.families for r in license.scan(docs(spark, rows)).collect()}
    assert {t: got[i] for i, t in enumerate(rows) if t in NAMED} == NAMED
    assert [got[len(NAMED) + i] for i in range(len(NONE))] == [""] * len(NONE)


def test_wrapped_paragraphs_are_one(spark):
    found = license.paragraphs(docs(spark, [MIT, GPL])).collect()
    assert sorted((r.doc_id, len(r.line.split()), r.family) for r in found) == [(0, 4, "unknown"), (0, 20, "MIT"), (0, 66, "MIT"), (1, 42, "GPL")]


def plain_verdict(line, m):
    """families of a paragraph without Spark."""
    w, p = license.tokens(line), m.probabilities(line)
    out = []
    for i, f in enumerate(m.families):
        for t in [*license.TEMPLATES[f], *(t for t, names in license.DUAL if f in names)]:
            all_, own = license.confirms(f, t)
            both = len(w & set(all_))
            if p[i] >= m.threshold and both >= license.SHARED * min(len(w), len(all_)) and both >= max(2, min(3, len(w))) and (not own or w & set(own)):
                out.append(f)
                break
    return sorted(out)


def test_verdicts_equal_a_plain_version(spark):
    m = license.train()
    rows = [t for t, _ in license.made_rows(seed=41, limit=600)] + list(NONE[:8])
    got = license.paragraphs(docs(spark, rows)).collect()
    assert len(got) > 400
    for r in got:
        assert r.families == plain_verdict(r.line, m), r.line
    cue = re.compile(license._CUE)
    assert {r.doc_id for r in got} == {i for i, t in enumerate(rows) if cue.search(t)}


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "MIT License"), (None, "MIT License"), (1, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_paragraphs, r.families) for r in license.scan(rows).collect()) == [(0, 1, "MIT"), (0, 1, "MIT"), (1, 0, "")]
    assert license.scan(rows.limit(0)).count() == 0


def test_held_out_notices():
    """Threshold and slope were set on other rows; these come from sources that the first fit didn't see."""
    m = license.train()
    rows = license.made_rows(seed=99, limit=1500, held=True)
    said = [plain_verdict(t, m) for t, _ in rows]
    plain = [s for s, (_, names) in zip(said, rows, strict=True) if not names]
    assert sum(map(bool, plain)) <= 0.02 * len(plain)
    assert sum(bool(set(s) & set(n)) for s, (_, n) in zip(said, rows, strict=True)) / sum(bool(n) for _, n in rows) > 0.9
