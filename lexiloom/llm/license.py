"""Licence scans: paragraphs classified by sparse word n-gram logistic regression.

Wrapped lines are joined to paragraphs: a line of JOINED characters or more that doesn't end a sentence goes on in the
next one, without the sign that may begin a comment line. Paragraphs with a licence word are cut into words and
word pairs; each family's score is a bias and the sum of the weights of the paragraph's n-grams, made a probability
by the logistic function of the calibrated score. A paragraph all of whose probabilities stay under the threshold is
of the unknown class. A likely family is reported only if one of its templates confirms it: the paragraph has enough of
the template's words, and one at least of those that no other family's templates have. A paragraph may name several
families. All of this is DataFrame functions; weights and templates are literals of fixed size.

A paragraph without a cue (a word that begins like one of CUES) is of no licence and isn't scored. Features are all its
words, word pairs and marks. A mark is a name whose version or variant a pattern tells from its relatives (MARKS): Apache 2 from
Apache 1, the GPL from the LGPL, AGPL and GFDL, Creative Commons with and without NC and ND, and a reservation of rights that
states one from rights reserved for somebody in a sentence. Where a template has a mark, only that mark confirms it. In a text's
verdict, a reservation above a licence (HEADER lines at most) is the licence's header and no licence.

Training (train()) runs on the driver over TRAINING_ROWS labelled rows at most, made from the templates below, from
notices of other licences and from plain sentences that use the same words; nothing is learnt from the corpus. Slope and
threshold come from a first fit: a quarter of the templates, of the other licences and of the plain sentences takes no part
in it, and the threshold is the least, from LEAST_PROBABILITY on, at which FALSE_POSITIVES of the rows made from those others and
plain ones would be reported, their confirmation counted in. The weights are then fitted to all, for n-grams of LEAST_ROWS rows.

Defined results: a null, empty or licence-less text has no paragraphs and no families; repeated
rows each get a row; rows with a null doc_id too; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cache, lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAINING_ROWS = 6000
FALSE_POSITIVES = 0.005
LEAST_PROBABILITY = 0.5
LEAST_ROWS = 4
MOMENTUM = 0.8
SHARED = 0.5
JOINED = 30
HEADER = 20
SLOTS = 1024

# Texts and notices of common licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "Use of this source code is governed by the MIT license found in the LICENSE file.",
        "Distributed under the MIT licence.",
        "MIT License", "License: MIT", "Licensed under MIT", "SPDX-License-Identifier: MIT", "This code is MIT licensed.",
        "MIT-Lizenz", "Unter MIT-Lizenz.", "Publicado bajo la licencia MIT.", "Distribué sous licence MIT.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "Released under the Apache 2.0 license.", "Distributed under the terms of the Apache License 2.0.",
        "Apache License 2.0", "License: Apache-2.0", "Licensed under Apache 2.0", "SPDX-License-Identifier: Apache-2.0",
        "Apache-Lizenz 2.0", "Lizenziert unter der Apache-Lizenz, Version 2.0.", "Bajo la licencia Apache 2.0.", "Sous licence Apache 2.0.",
        "Each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You must cause any modified files to carry prominent notices stating that You changed the files; and You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "Distributed under the GPL version 2 or later.", "Released under the GNU GPL v2.",
        "GPL-Lizenz", "Veröffentlicht unter der GPL-Lizenz.", "Licencia GPL", "Publicado bajo la licencia GPL versión 3.", "Sous licence GPL.", "GNU General Public License v3.0",
        "GPL License", "License: GPL", "License: GPL-2.0", "License: GPLv3", "Licensed under GPL", "Licensed under GPLv3", *(f"SPDX-License-Identifier: GPL-{v}" for v in ("2.0-only", "2.0-or-later", "3.0-only", "3.0-or-later")),
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL; you can redistribute this library under the terms of the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.", "Released under the LGPL version 3.",
        "GNU Lesser General Public License v2.1", "Unter der LGPL-Lizenz.", "Licencia LGPL", "Sous licence LGPL.", "This library is free software under the GNU Library General Public License, version 2.",
        "LGPL License", "License: LGPL", "License: LGPL-3.0", "Licensed under LGPL", *(f"SPDX-License-Identifier: LGPL-{v}" for v in ("2.1-only", "2.1-or-later", "3.0-only", "3.0-or-later")),
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL version 3.", "Distributed under the terms of the GNU AGPL.",
        "GNU Affero General Public License v3.0", "If your software can interact with users remotely through a computer network, you should also make sure that it provides a way for users to get its source, as the AGPL requires.",
        "AGPL License", "License: AGPL", "License: AGPL-3.0", "Licensed under AGPLv3", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "BSD-Lizenz", "Licencia BSD", "Sous licence BSD.", "Released under the BSD license.", "Distributed under the 2-Clause BSD licence.", "Licensed under the Simplified BSD License.",
        "In no event shall the copyright owner or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability.",
        "BSD License", "License: BSD", "Licensed under BSD", "License: BSD-2-Clause", "License: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action.",
        "Licensed under the ISC License.", "Released under the ISC license.", "Distributed under the terms of the ISC licence.",
        "ISC License", "License: ISC", "Licensed under ISC", "SPDX-License-Identifier: ISC",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0.",
        "Mozilla Public License 2.0", "License: MPL-2.0", "Licensed under MPL 2.0", "SPDX-License-Identifier: MPL-2.0",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License 2.0.", "Released under the Eclipse Public License, version 1.0.", "Distributed under the EPL 2.0.",
        "Eclipse Public License 2.0", "License: EPL-2.0", "Licensed under EPL 2.0", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: EPL-1.0",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
        "Licensed under the Boost Software License 1.0.", "Released under the Boost license.",
        "Boost Software License 1.0", "License: BSL-1.0", "SPDX-License-Identifier: BSL-1.0",
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "Licensed under the zlib license.", "Released under the zlib/libpng license.",
        "zlib License", "License: Zlib", "SPDX-License-Identifier: Zlib",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This work has been released into the public domain by its author.", "This file is in the public domain.",
        "Released into the public domain under the Unlicense.", "Dedicated to the public domain under CC0 1.0.",
        "The Unlicense", "License: Unlicense", "License: CC0-1.0", "SPDX-License-Identifier: Unlicense", "SPDX-License-Identifier: CC0-1.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License, CC BY-SA 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use.",
        "License: CC BY 4.0", "License: CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC-SA 4.0, for noncommercial use only.", "Released under a Creative Commons NonCommercial licence.",
        "License: CC BY-NC 4.0", "License: CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ),
    "CC-BY-ND": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0.",
        "Available under the Creative Commons Attribution-NoDerivs licence.", "License: CC BY-ND 4.0", "License: CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "CC-BY-NC-ND": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0.",
        "Available under the Creative Commons Attribution-NonCommercial-NoDerivs licence.", "License: CC BY-NC-ND 4.0", "License: CC-BY-NC-ND-4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ),
    "GFDL": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
        "Licensed under the GNU Free Documentation License 1.3.", "Text is available under the GFDL.", "Released under the GFDL version 1.2.", "License: GFDL-1.3", "SPDX-License-Identifier: GFDL-1.3-or-later",
    ),
    "CDDL": (
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
        "Licensed under the CDDL 1.0.", "Released under the CDDL, version 1.1.", "Licensed under the Common Development and Distribution License 1.0.", "License: CDDL-1.0", "SPDX-License-Identifier: CDDL-1.0",
    ),
    "EUPL": (
        "Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL (the Licence).",
        "Licensed under the European Union Public Licence 1.2.", "Released under the EUPL 1.2.", "License: EUPL-1.2", "SPDX-License-Identifier: EUPL-1.2", "Lizenziert unter der EUPL.",
    ),
    "SSPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the Server Side Public License, version 1.",
        "You should have received a copy of the Server Side Public License along with this program.", "Licensed under the SSPL.", "Released under the Server Side Public License v1.", "License: SSPL-1.0", "SPDX-License-Identifier: SSPL-1.0",
    ),
    "BUSL": (
        "Use of this software is governed by the Business Source License included in the file LICENSE.", "Licensed under the Business Source License 1.1.",
        "Released under the BUSL 1.1.", "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work.", "License: BUSL-1.1", "SPDX-License-Identifier: BUSL-1.1",
    ),
    "Proprietary": (
        "All rights reserved.", "Copyright 2024 Example Ltd. All rights reserved.", "Alle Rechte vorbehalten.",
        "No part of this publication may be reproduced without prior written permission.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "This software is proprietary and may not be used without a commercial license.",
        "License: Proprietary", "Proprietary License",
    ),
}
# Notices that name two families.
DUAL: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ("Apache-2.0", "MIT")),
    ("License: MIT OR Apache-2.0", ("Apache-2.0", "MIT")), ("SPDX-License-Identifier: Apache-2.0 OR MIT", ("Apache-2.0", "MIT")), ("Dual licensed under MIT and Apache 2.0.", ("Apache-2.0", "MIT")),
    ("Dual-licensed under the MIT and GPL licenses.", ("MIT", "GPL")), ("SPDX-License-Identifier: GPL-2.0-only OR MIT", ("MIT", "GPL")), ("License: GPL-2.0 OR BSD-3-Clause", ("BSD", "GPL")), ("SPDX-License-Identifier: (GPL-2.0 OR BSD-3-Clause)", ("BSD", "GPL")),
)
# Licences that are of no family above.
OTHER = tuple(
    form.format(x)
    for x in ("Artistic License 2.0", "SIL Open Font License 1.1", "Open Software License 3.0", "Mulan Permissive Software License", "Microsoft Public License", "Python Software Foundation License", "PostgreSQL License", "Open Database License", "Open Government Licence 3.0", "Apache License 1.1", "Apache Software License, Version 1.0", "University of Illinois Open Source License", "Upstream Compatibility License", "Reciprocal Public License 1.5", "Sleepycat License", "Academic Free License 3.0", "CeCILL license", "Q Public License 1.0")
    for form in ("Licensed under the {}.", "{}", "Released under the {}.", "License: {}", "Distributed under the terms of the {}.")
)
# Sentences that use licence words and state no licence.
PLAIN = (
    "The driver showed an expired license to the officer.", "She asked for permission to leave early.", "The committee debated copyright law for hours.",
    "The car came with a two year warranty.", "He was licensed as a pilot in 1998.", "The apache helicopter landed near the river.",
    "Free software is discussed in the next chapter.", "They redistribute income through taxes.", "The public library opens at nine.",
    "All rights of way are marked on the map.", "Human rights groups criticised the decision.", "A fishing licence costs ten euros a year.",
    "The general public was invited to the opening.", "Mozilla was the code name of an old browser.", "Creative writing is taught on Mondays.",
    "The commons was grazed by sheep.", "He reserved a table for two.", "The MIT campus is in Cambridge.", "The restaurant lost its liquor license.",
    "Copyright infringement cases are rising.", "Warranty claims must be filed in writing.", "Our licence to operate depends on trust.", "The version of events she gave was different.",
    "The source of the river is in the mountains.", "Permission slips must be returned by Friday.", "The license plate was covered in mud.",
    "She works in the public domain of policy.", "The domain name expired in May.", "A public hearing is set for June.", "They gave a boost to local trade.", "The eclipse was seen in the south.", "Der Zug kommt mit der Bahn.", "Er kommt mit dem Auto und mit seinem Hund.", "Mit Recht gilt das als gut.",
    "No warranty was given for the roof.", "The permission notice hung on the wall.", "You may copy the recipe and share it.", "The software crashed without warning.", "The attribution of the painting is disputed.", "The rights of the child are protected by law.", "Reserved seats are at the front.", "A proprietary blend of herbs was used.",
    "Disclaimer: the author owns two cats.", "The copyright page lists the printer.", "She received a copy of the general rules along with the program.", "The law requires a license for each dog.", "The source code of life is written in genes.", "The bank redistributes the fees among members.",
    "The museum shows the photographs with all rights reserved by the artists.", "All rights reserved for the heirs were sold at auction.", "The song is used with all rights reserved to the composer in mind.", "Film rights to the novel were sold last year.",
    "Unter der Lizenz mit dem Sender entstanden drei Folgen.", "Die Lizenz wurde mit Auflagen erteilt.", "Der Verein spielt mit neuer Lizenz.", "La licencia de obras fue concedida en mayo.", "Perdió su licencia de conducir.", "Il a perdu sa licence de pilote.", "Elle prépare une licence de droit à Paris.",
    "MIT researchers built a small robot.", "She studied physics at MIT and moved to Boston.", "The GNU project began in 1983.", "The BSD socket interface is old.", "Creative Commons held its summit in Lisbon.", "The Apache people live in the Southwest.", "The Mozilla foundation hired a new director.",
    "Permission to film in the station was refused.", "He obtained permission from the owner of the land.", "The above notice hangs in all copies of the poster.", "The council granted permission for the new bridge.", "Copyright lawyers met in Geneva.", "The copyright expires seventy years after death.",
    "The warranty covers parts and labour for three years.", "The dealer offers a limited warranty, express or implied.", "Redistribution of land began in the spring.", "Software licensing costs rose again.", "The company changed its software license policy.", "You need a license to sell spirits.", "The licence fee pays for the broadcaster.", "The court ruled on the GPL case.",
    "Our lawyers compared the MIT and Apache licenses.", "A license is a contract between two parties.", "Choose a license before you publish your work.", "The license of the restaurant was revoked.", "The permission system of the server was rewritten.", "Public licences are explained in chapter two.", "They discussed the license for an hour.", "The attribution of the quote is unclear.", "Domain names and public records are separate.", "Confidential reports were found in the bin.", "Unauthorized entry is an offence.", "The authorities reserved the right to close the road.",
)
#: What words of licences begin with.
STEMS = ("licen", "copyright", "permission", "permitted", "warrant", "redistribut", "gnu", "gpl", "lgpl", "agpl", "affero", "apache", "mit", "bsd", "isc", "mozilla", "mpl", "eclipse", "epl", "boost", "bsl", "zlib", "unlicense", "cc0", "creative", "commons", "cc", "noncommercial", "attribution", "public", "domain", "rights", "reserved", "proprietary", "unauthorized", "disclaimer", "spdx", "lizenz", "sublicen", "gfdl", "cddl", "eupl", "sspl", "busl", "rechte vorbehalten")
_STEM = re.compile(f"^(?:{'|'.join(STEMS)})")
#: A paragraph without one of these is of no licence.
CUES = tuple(x for x in STEMS if x not in ("public", "domain", "boost", "eclipse", "attribution", "isc"))
_CUE = rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(CUES)}|public domain|in no event shall|anyone is free|misrepresented)"
#: A name that its version or variant tells from its relatives, as patterns over the paragraph in lower case.
_CC, _NC, _ND = "(?:creative commons|(?<![a-z0-9])cc[ -]by|creativecommons)", "(?:by-nc|by nc|non-?commercial)", "(?:[a-z]-nd(?![a-z])|no-?deriv)"
_has = lambda p, yes=True: rf"(?{'=' if yes else '!'}[^\n]*{p})"
MARKS: dict[str, str] = {
    "=apache-2": "^" + _has("apache") + _has(r"apache[^.]{0,30}[ v-]1\.[01]", False),
    "=gpl": "(?<![a-z])gpl|(?<!lesser )(?<!library )(?<!affero )general public licen[cs]e",
    "=lgpl": "(?<![a-z])lgpl|(?:lesser|library) general public licen[cs]e",
    "=agpl": "(?<![a-z])agpl|affero",
    "=gfdl": "(?<![a-z])gfdl|free documentation licen[cs]e",
    "=cc-by": "^" + _has(_CC) + _has(_NC, False) + _has(_ND, False) + _has("(?:cc0|commons zero)", False),
    "=cc-by-nc": "^" + _has(_CC) + _has(_NC) + _has(_ND, False),
    "=cc-by-nd": "^" + _has(_CC) + _has(_NC, False) + _has(_ND),
    "=cc-by-nc-nd": "^" + _has(_CC) + _has(_NC) + _has(_ND),
    "=busl": "business source licen[cs]e|(?<![a-z])busl",
    "=reserved": r"(?:^ *|[^a-z ] *|copyright[^\n]{0,99} )(?:all rights reserved|alle rechte vorbehalten)(?! *(?!worldwide)[a-z])",
}
_WORD = "[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str) -> list[str]:
    return re.findall(_WORD, lowered(text))


@lru_cache(3 * TRAINING_ROWS)
def tokens(text: str) -> frozenset[str]:
    """Words, the letters that a word like gpl-2.0 begins with as a word of their own, and marks."""
    w, low = words(text), lowered(text)
    return frozenset({*w, *(h for x in w if (h := re.match("[a-z]*", x)[0])), *(m for m, p in MARKS.items() if re.search(p, low))})


def features(text: str) -> frozenset[str]:
    w = words(text)
    return tokens(text) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    slope: float  # of the calibrated score
    threshold: float

    def probabilities(self, text: str) -> list[float]:
        z = list(self.bias)
        for g in features(text):
            for i, w in enumerate(self.weights.get(g, ())):
                z[i] += w
        return [1 / (1 + math.exp(-self.slope * x)) for x in z]


@dataclass(frozen=True)
class Source:
    """A text to make labelled rows of, and its families."""

    text: str
    families: tuple[str, ...]
    held: bool  # out of the first fit


def sources() -> list[Source]:
    """Templates, notices of two families, other licences and plain sentences; every fourth of each kind is held out."""
    kinds = [[(t, (family,)) for t in texts] for family, texts in TEMPLATES.items()]
    kinds += [list(DUAL), [(t, ()) for t in OTHER], [(t, ()) for t in PLAIN]]
    return [Source(t, names, k % 4 == 3) for kind in kinds for k, (t, names) in enumerate(kind)]


def made_rows(seed: int = 7, limit: int = TRAINING_ROWS, held: bool | None = None) -> list[tuple[str, tuple[str, ...]]]:
    """(text, families) of sources (all, held out or not), with words lost, cut, and put between other words; a third
    of the rows is of no family."""
    rng = random.Random(seed)
    some = [s for s in sources() if held is None or s.held == held]
    by_family: dict[tuple[str, ...], list[Source]] = {}
    for s in some:
        by_family.setdefault(s.families, []).append(s)
    none, named = by_family.pop((), []), list(by_family.values())
    filler = sorted({w for s in PLAIN for w in words(s) if not _STEM.match(w)})
    rows = []
    while len(rows) < limit:
        source = rng.choice(none) if rng.random() < 1 / 3 else rng.choice(rng.choice(named))
        w = source.text.split()
        if len(w) > 8 and rng.random() < 0.5:
            at = rng.randrange(0, len(w) // 3)
            w = w[at : at + rng.randint(max(8, len(w) // 6), len(w))]
        elif len(w) > 4 and rng.random() < 0.3:
            w = [x for x in w if rng.random() > 0.1]
        if rng.random() < 0.4:
            w = rng.choices(filler, k=rng.randint(1, 8)) + w
        text = " ".join(w)
        # what is left of the text must still name each family, or it is of none
        own = tokens(text)
        families = tuple(f for f in source.families if own & distinctive(f) or len(own) > 12)
        if source.families and not families:
            continue
        rows.append((text, families))
    return rows


def labelled_rows(seed: int = 7, limit: int = TRAINING_ROWS) -> list[tuple[str, int]]:
    """made_rows() of one family or none: (text, place of the family or -1)."""
    place = {f: i for i, f in enumerate(TEMPLATES)}
    return [(t, place[names[0]] if names else -1) for t, names in made_rows(seed, limit) if len(names) < 2]


@cache
def distinctive(family: str) -> frozenset[str]:
    """Words that only this family's templates have."""
    mine = {w for t in TEMPLATES[family] for w in tokens(t)}
    return frozenset(mine - {w for f, texts in TEMPLATES.items() if f != family for t in texts for w in tokens(t)})


def templates_of(family: str) -> list[str]:
    """Its own and the notices that name it beside another."""
    return [*TEMPLATES[family], *(t for t, names in DUAL if family in names)]


def confirmed(text: str) -> set[str]:
    """Families that a template confirms for a paragraph; paragraphs() does the same in columns."""
    w = tokens(text)
    enough = max(2, min(3, len(w)))

    def shares(listed: list[str], own: list[str]) -> bool:
        both = len(w.intersection(listed))
        return both >= max(SHARED * min(len(w), len(listed)), enough) and (not own or not w.isdisjoint(own))

    return {f for f in TEMPLATES if any(shares(*confirms(f, t)) for t in templates_of(f))}


def _fit(rows: list[tuple[str, tuple[str, ...]]], rounds: int, rate: float, decay: float) -> tuple:
    """Vocabulary, weights and a function to the matrix of rows: one logistic regression for each family,
    by gradient descent with momentum."""
    import numpy as np

    counts = Counter(g for t, _ in rows for g in features(t))
    vocabulary = sorted(g for g, n in counts.items() if n >= LEAST_ROWS)
    place = {g: i for i, g in enumerate(vocabulary)}
    families = tuple(TEMPLATES)

    def matrix(rows: list) -> tuple:
        x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
        y = np.zeros((len(rows), len(families)), np.float32)
        for r, (t, names) in enumerate(rows):
            x[r, [place[g] for g in features(t) if g in place]] = 1
            x[r, -1] = 1
            for f in names:
                y[r, families.index(f)] = 1
        return x, y

    x, y = matrix(rows)
    w = np.zeros((x.shape[1], len(families)), np.float32)
    w[-1] = -3
    step, back = np.zeros_like(w), np.ascontiguousarray(x.T)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        step = MOMENTUM * step - rate * (back @ (p - y) / len(x) * 20 + decay * w)
        w += step
    return place, w, matrix


@cache
def train(rounds: int = 50, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Slope and threshold from the held-out sources, weights from all of them."""
    import numpy as np

    _, w, matrix = _fit(made_rows(held=False), rounds, rate, decay)
    held = made_rows(seed=8, held=True)
    x, y = matrix(held)
    z = x @ w
    slope = min((k / 10 for k in range(2, 31)), key=lambda k: float(np.mean(np.logaddexp(0, -k * z) * y + np.logaddexp(0, k * z) * (1 - y))))
    sure = np.array([[f in said for f in TEMPLATES] for said in (set() if names else confirmed(t) for t, names in held)])
    wrong = np.sort(np.where(sure, 1 / (1 + np.exp(-slope * z)), 0).max(1)[y.sum(1) == 0])
    rest = wrong[: math.floor(len(wrong) * (1 - FALSE_POSITIVES))]  # of equal ones all are kept out
    threshold = max(math.nextafter(round(float(rest[-1]), 4), 1) + 5e-5, LEAST_PROBABILITY)
    place, w, _ = _fit(made_rows(), rounds, rate, decay)
    w = np.round(w.astype(float), 3)
    return Model(tuple(TEMPLATES), tuple(w[-1].tolist()), {g: tuple(w[i].tolist()) for g, i in place.items() if np.abs(w[i]).max() >= 0.05}, slope, round(threshold, 4))


def _table(value: object, schema: str) -> Column:
    """A constant as one literal: the optimiser folds it, where thousands of literals would be planned one by one."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _scores(grams: Column, m: Model) -> Column:
    """Bias and weights of the grams summed. Weights lie in SLOTS maps by checksum, as a map is searched from its beginning."""
    slots: list[dict[str, list[float]]] = [{} for _ in range(SLOTS)]
    for g, w in m.weights.items():
        slots[zlib.crc32(g.encode()) % SLOTS][g] = list(w)
    table = _table(slots, "array<map<string,array<double>>>")
    weights = F.transform(grams, lambda g: F.try_element_at(F.get(table, (F.crc32(g.cast("binary")) % SLOTS).cast("int")), g))
    return F.aggregate(F.filter(weights, lambda w: w.isNotNull()), _table(list(m.bias), "array<double>"), lambda z, w: F.zip_with(z, w, lambda a, b: a + b))


def joined_lines(text: Column) -> Column:
    """text with wrapped lines joined, without the signs that begin the comment lines so joined."""
    sign = r"(?://++|#++|\*++|;++|--++|%++|>++)"
    return F.regexp_replace(text, rf"(?<=[^\n]{{{JOINED - 1}}}[^\s.!?:;])[ \t\r]*+\n(?![ \t]*+{sign}?+[ \t\r]*+(?:\n|\z))[ \t]*+(?:{sign}[ \t]++)?+", " ")


@cache
def confirms(family: str, template: str) -> tuple[list[str], list[str]]:
    """Distinct words of a template, and those of them that are the family's alone: of marks and words the marks, if any."""
    t = sorted(tokens(template))
    own = [w for w in t if w in distinctive(family)]
    return t, [w for w in own if w in MARKS] or own


def paragraphs(docs: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each paragraph with a licence word: keep, paragraph (its place from 0), line (the paragraph in one
    line), family (the likeliest that is confirmed, else 'unknown'), families (all that are likely and confirmed), probability
    (the greatest of all families)."""
    m = model or train()
    ascii_lower = F.translate(F.col("line"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.where(F.col("text").rlike(_CUE)).select(*keep, F.posexplode(F.split(joined_lines(F.col("text")), "\n")).alias("paragraph", "line")).where(F.col("line").rlike(_CUE))
    rows = rows.withColumn("w", F.regexp_extract_all(ascii_lower, F.lit(_WORD), F.lit(0)))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    heads = F.filter(F.transform("w", lambda x: F.regexp_extract(x, "^[a-z]*", 0)), lambda x: x != "")
    marks = F.array_compact(F.array(*(F.when(ascii_lower.rlike(p), F.lit(m)) for m, p in MARKS.items())))
    rows = rows.withColumn("pairs", pairs).withColumn("w", F.array_distinct(F.concat("w", heads, marks)))
    rows = rows.withColumn("z", _scores(F.array_distinct(F.concat("w", "pairs")), m))
    rows = rows.withColumn("probability", F.round(1 / (1 + F.exp(-F.lit(m.slope) * F.array_max("z"))), 4))
    least = math.log(m.threshold / (1 - m.threshold)) / m.slope  # the score of the threshold
    named = F.arrays_zip(_table(list(m.families), "array<string>").alias("family"), F.col("z").alias("score"), _template_table().alias("templates"))

    def shares(t: Column) -> Column:
        both, n = F.size(F.array_intersect("w", t["words"])), F.size("w")
        enough = (both >= F.lit(SHARED) * F.least(n, F.size(t["words"]))) & (both >= F.greatest(F.lit(2), F.least(F.lit(3), n)))
        return enough & ((F.size(t["own"]) == 0) | F.arrays_overlap("w", t["own"]))

    likely = F.filter(named, lambda x: x["score"] >= least)
    sure = F.filter(likely, lambda x: F.exists(x["templates"], shares))
    rows = rows.withColumn("sure", F.when(F.col("probability") >= m.threshold, F.transform(F.sort_array(F.transform(sure, lambda x: F.struct(x["score"].alias("score"), x["family"].alias("family"))), asc=False), lambda x: x["family"])).otherwise(F.array().cast("array<string>")))
    return rows.select(*keep, "paragraph", "line", F.coalesce(F.try_element_at("sure", F.lit(1)), F.lit("unknown")).alias("family"), F.array_sort("sure").alias("families"), "probability")


def _template_table() -> Column:
    """For each family an array of its templates' words and own words."""
    listed = [[dict(zip(("words", "own"), confirms(f, t), strict=True)) for t in templates_of(f)] for f in TEMPLATES]
    return _table(listed, "array<array<struct<words:array<string>,own:array<string>>>>")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (with a licence word), n_licensed, families (sorted, comma-joined, empty if none)
    for every row of docs. Reservations of rights above a licence count as unlicensed paragraphs. Rows are told apart by
    doc_id and a fingerprint of the text."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    found = paragraphs(rows, keep=("doc_id", "print"))
    reserves = (F.array_join("families", ",") == "Proprietary") & F.translate("line", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").rlike(MARKS["=reserved"])
    found = found.select("doc_id", "print", "paragraph", "families", reserves.alias("reserves")).distinct()
    below = Window.partitionBy("doc_id", "print").orderBy("paragraph").rangeBetween(1, HEADER)
    grants = (F.size("families") > 0) & ~F.array_contains("families", "Proprietary")
    header = F.col("reserves") & F.coalesce(F.max(grants).over(below), F.lit(False))
    found = found.withColumn("families", F.when(header, F.array().cast("array<string>")).otherwise(F.col("families")))
    per = found.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.count_if(F.size("families") > 0).alias("n_licensed"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("families"))
    on = rows.select("doc_id", "print").alias("d").join(per.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.print") == F.col("p.print")), "left")
    return on.select("d.doc_id", *(F.coalesce(F.col(f"p.{c}"), F.lit(0).cast("long")).alias(c) for c in ("n_paragraphs", "n_licensed")), F.coalesce("p.families", F.lit("")).alias("families"))
