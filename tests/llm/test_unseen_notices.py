"""Operator 9 on notices and clauses that are in none of its sources, and on sentences that state no licence. They were
written before the operator was first run on them."""

from lexiloom.llm import license

#: Family, notices and clauses as projects and licences word them.
UNSEEN = {
    "MIT": (
        "This plugin is open source software released under the MIT License.", "MIT licensed, see LICENSE for details", "Copyright (c) 2021 Jane Doe, MIT License", "The code in this repository is available under the MIT license.",
        "Licence : MIT", "Dieses Projekt steht unter der MIT-Lizenz.", "license = \"MIT\"",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY",
    ),
    "Apache-2.0": (
        "This project is under the Apache 2.0 license. See the LICENSE file for details.", "Apache License, Version 2.0, January 2004", "Licensed under the Apache License v2.0 with LLVM Exceptions.", "All code is Apache-2.0 licensed", "The contents of this package are distributed under the Apache Software License 2.0.",
        "you may not use this file except in compliance with the Apache License, Version 2.0", "license = \"Apache-2.0\"",
    ),
    "GPL": (
        "This package is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "Copyright (C) 2007 Free Software Foundation: GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "The game is licensed under GPLv2 or later.", "license: gpl-3.0", "You can use this module under the terms of the GNU GPL, version 2.", "Ce programme est distribué sous licence GNU GPL v3.",
    ),
    "LGPL": (
        "The library is distributed under the terms of the GNU LGPL, version 3.", "licensed under LGPL-2.1 or any later version", "Qt is available under the GNU Lesser General Public License version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ),
    "AGPL": ("The server is licensed under the AGPL v3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "license: agpl-3.0-or-later", "This service is available under the terms of the GNU Affero General Public License."),
    "BSD": (
        "This code is released under a three-clause BSD license.", "BSD 3-Clause License", "The module is available under the New BSD License.", "license: bsd-2-clause",
        "Redistributions of source code must retain the copyright notice, this list of conditions and the disclaimer below.", "Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": ("This package is available under the ISC License.", "license: ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "The browser is available under the terms of the Mozilla Public License, version 2.0.", "license: mpl-2.0", "This file is licensed under the MPL, v. 2.0."),
    "EPL": ("This plug-in is made available under the terms of the Eclipse Public License v1.0.", "Eclipse Public License - v 2.0", "license: EPL-2.0"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "This header is distributed under the Boost Software License.", "license: BSL-1.0"),
    "Zlib": ("This library is released under the zlib license, see below.", "license: zlib", "Permission is granted to anyone to use this software for any purpose, and to alter it and redistribute it freely"),
    "Public-Domain": ("I hereby place this code in the public domain.", "This data set is released under CC0.", "license: Unlicense", "The author dedicates this work to the public domain.", "CC0 1.0 Universal Public Domain Dedication"),
    "CC-BY": ("Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 licence.", "Photo: Jane Doe, CC BY-SA 3.0", "This page is available under CC BY 3.0.", "Open access under the Creative Commons Attribution License 4.0."),
    "CC-BY-NC": ("The lecture notes are licensed under CC BY-NC-SA 3.0.", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "This book is available under a Creative Commons non-commercial licence."),
    "CC-BY-ND": ("Articles may be republished under a Creative Commons Attribution-NoDerivatives licence.", "Our texts are licensed under CC BY-ND 3.0."),
    "CC-BY-NC-ND": ("This is an open access article under the CC BY-NC-ND license.", "Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License"),
    "GFDL": ("Permission is granted to copy this manual under the terms of the GNU Free Documentation License.", "This text is available under the GNU Free Documentation License, version 1.2 or later."),
    "CDDL": ("This file is available under the Common Development and Distribution License, version 1.0.", "license: CDDL-1.1"),
    "EUPL": ("This software is made available under the EUPL, version 1.1.", "European Union Public Licence v. 1.2"),
    "SSPL": ("The database is available under the Server Side Public License.", "license: SSPL-1.0"),
    "BUSL": ("The product is licensed under the Business Source License 1.1.", "license: BUSL-1.1"),
    "Proprietary": ("© 2020 Example Corp. All rights reserved.", "Copyright © 2018-2022 Jane Doe, all rights reserved", "This document is proprietary and confidential to Example Corp.", "No part of this book may be reproduced in any form without prior written permission from the publisher.", "Copyright Example Ltd 2011. All Rights Reserved."),
}
NONE = (
    "Licensed under the Apache License, Version 1.1", "Released under the Ruby License.", "Licensed under the Vim license.", "License: WTFPL", "Licensed under the PHP License 3.01.", "Released under the Perl Artistic License.", "Licensed under the Elastic License 2.0.",
    "The photographs are shown with all rights reserved by the artists.", "Pictures of the exhibition, all rights reserved by the painters, hang upstairs.", "A licence to fish in the lake costs ten pounds.", "MIT students licensed the patent to a company.", "The minister granted permission for the march.",
    "The engineer wrote about the history of BSD and the GNU tools.", "Apache tribes signed the treaty with permission of the council.", "Which licence should I choose for my project?", "The GPL is discussed in chapter nine of the book.", "The public domain is a topic of copyright law.", "He reserved all rights to the film.",
    "Die Mannschaft reiste mit der Bahn und mit dem Bus.", "Er bekam die Lizenz mit drei Jahren Laufzeit.", "La licencia de construcción fue denegada.", "Sa licence de chauffeur a été retirée.", "The warranty of the washing machine covers two years.", "The software of the car was updated without permission.", "Creative people gathered on the commons.",
    "Copyright in the letters belongs to the heirs.", "The creative commons of ideas is shrinking.", "She holds a license to practise medicine.", "Zlib and gzip compress streams of bytes.", "The eclipse drew a crowd to the public square.",
)
HEADED = "Copyright (c) 2015, Jane Doe. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"

#: Lines that an earlier version got wrong.
PROBES = {
    "Copyright (c) 2015, Jane Doe. All rights reserved.": "Proprietary", "Pictures are shown with all rights reserved by the artists.": "", "Licensed under the Apache License, Version 1.1": "", "MIT-Lizenz": "MIT", "licencia GPL": "GPL",
    "# Permission is hereby granted, free of charge, to any person obtaining a copy": "MIT", "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files": "MIT",
}


def verdicts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {texts[r.doc_id]: r.families for r in license.scan(rows).collect()}


def test_precision_and_recall_on_unseen_notices(spark):
    wanted = {t: f for f, texts in UNSEEN.items() for t in texts} | dict.fromkeys(NONE, "")
    seen = {t for s in license.sources() for t in [s.text]}
    assert not seen & set(wanted)
    got = verdicts(spark, list(wanted))
    said = {t: f for t, f in got.items() if f}
    right = sum(wanted[t] == f for t, f in said.items())
    precision, recall = right / len(said), right / sum(map(bool, wanted.values()))
    missed = {t: got[t] for t in wanted if got[t] != wanted[t]}
    assert precision >= 0.9 and recall >= 0.9, (precision, recall, missed)


def test_lines_that_went_wrong(spark):
    assert verdicts(spark, list(PROBES)) == PROBES


def test_reservations_above_a_licence_are_headers(spark):
    far = HEADED.replace("\n\n", "\n" * (license.HEADER + 2))
    below = "Released under the MIT License.\nAll rights reserved."
    got = verdicts(spark, [HEADED, far, below, "All rights reserved."])
    assert got == {HEADED: "BSD", far: "BSD,Proprietary", below: "MIT,Proprietary", "All rights reserved.": "Proprietary"}


def test_every_template_names_its_family(spark):
    wanted = {t: f for f, texts in license.TEMPLATES.items() for t in texts} | {t: ",".join(sorted(names)) for t, names in license.DUAL}
    got = verdicts(spark, list(wanted))
    assert got == wanted
