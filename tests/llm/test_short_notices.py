"""Operator 9 on notices of a few words, and on as short lines that state no licence."""

from lexiloom.llm import license

NOTICES = {
    "License: MIT": "MIT", "MIT License": "MIT", "SPDX-License-Identifier: MIT": "MIT", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "Licensed under GPL": "GPL",
    "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL", "BSD License": "BSD", "License: BSD-3-Clause": "BSD", "License: MPL-2.0": "MPL-2.0", "License: CC-BY-4.0": "CC-BY",
}
PLAIN = ("mit", "mit der", "mit der Bahn", "mit dem", "MIT campus", "MIT students", "the license", "license plate", "liquor license", "Apache helicopter", "license: expired", "copyright law", "Permission", "public library")


def test_short_notices(spark):
    lines = [*NOTICES, *PLAIN]
    got = license.paragraphs(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()
    said = {r.line: r.family for r in got}
    assert {t: said[t] for t in NOTICES} == NOTICES
    assert {said.get(t, "unknown") for t in PLAIN} == {"unknown"}
