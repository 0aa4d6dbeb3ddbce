"""Every rule's notice, plain and in comment blocks."""

import textwrap

import pytest

from quorumlab.llm import licenses

GNU = 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.'
ASIS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DAMAGES.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice in the documentation.\n\n"
ADVERT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement.\n\n"
ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
NOTICES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0'),
    ("AGPL-3.0-or-later", GNU.format("Affero ", ",", "3")), ("LGPL-3.0-or-later", GNU.format("Lesser ", ",", "3")), ("LGPL-2.1-or-later", GNU.format("Lesser ", ";", "2.1")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("GPL-3.0-or-later", GNU.format("", ",", "3")), ("GPL-2.0-or-later", GNU.format("", ";", "2")),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\". IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM."),
    ("MIT", "Released under the MIT License."), ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\"."),
    ("BSD-4-Clause", BSD + ADVERT + ENDORSE + ASIS), ("BSD-3-Clause", BSD + ENDORSE + ASIS), ("BSD-2-Clause", BSD + ASIS), ("BSD", "Released under the modified BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "Dedicated by CC0 1.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-4.0", "Licensed under Creative Commons Attribution 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."), ("Public-Domain", "This work was placed in the public domain."), ("All-Rights-Reserved", "Copyright (c) 2020 Some Body. All rights reserved."),
] + [(x, f"SPDX-License-Identifier: {y}\nCopyright 2020 Some Body") for x, y in (("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("BSD-3-Clause", "BSD-3-Clause"), ("BSD-2-Clause", "BSD-2-Clause"), ("GPL-3.0", "GPL-3.0"), ("GPL-2.0", "GPL-2.0"), ("MPL-2.0", "MPL-2.0"))]
STYLES = {"plain": ("", "", ""), "hash": ("", "# ", ""), "slashes": ("", "// ", ""), "stars": ("/*\n", " * ", " */\n"), "dashes": ("", "-- ", "")}


def block(notice, style, width=50):
    """The notice wrapped as in a file's head, with code before and after it."""
    before, sign, after = STYLES[style]
    lines = [x for p in notice.split("\n") for x in (textwrap.wrap(p, width) if p else [""])]
    return "start()\n" + before + "".join((sign + x).rstrip() + "\n" for x in lines) + after + "\nend()\n"


@pytest.fixture(scope="module")
def found(spark):
    cases = [(n, style) for n in range(len(NOTICES)) for style in STYLES]
    docs = spark.createDataFrame([(i, block(NOTICES[n][1], style)) for i, (n, style) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    return {case: got[i] for i, case in enumerate(cases)}


@pytest.mark.parametrize("style", STYLES)
@pytest.mark.parametrize("n", range(len(NOTICES)), ids=[f"{i}-{x}" for i, (x, _) in enumerate(NOTICES)])
def test_notice_is_found(found, n, style):
    assert found[n, style].licenses == NOTICES[n][0], found[n, style].sentences


def test_every_rule_has_a_notice(found):
    assert {x for x, _ in licenses.RULES} | {x.removeprefix("CC=") + "-4.0" for x, _ in licenses.SENTENCES if x.startswith("CC=")} == {x for x, _ in NOTICES}
    named = set(" ".join(r.sentences for r in found.values()).split())
    assert {"ASIS", "MPL2_COPY", "BSD_ADVERT", "LIABILITY", "GPL_HOPE", "GPL_SEE"} <= named


def test_bullets_are_sentences_of_their_own(spark):
    docs = spark.createDataFrame([(1, "Parts:\n* under the MIT License\n* licensed under the MIT license\n- licensed under CC BY 4.0\n")], "doc_id long, text string")
    assert licenses.scan_licenses(docs).first().licenses == "MIT|CC-BY-4.0"


CASES = [
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("# SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"), ("// SPDX-License-Identifier: MIT-0", "MIT-0"),
    ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", "MIT|Apache-2.0"), ("SPDX-License-Identifier: ISC", "ISC"), ("SPDX-License-Identifier: LGPL-2.1-only.", "LGPL-2.1-only"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note AND (BSD-3-Clause OR MIT)", "GPL-2.0-only|BSD-3-Clause|MIT"), ("SPDX-License-Identifier: LicenseRef-Own", ""),
    ("<!-- SPDX-License-Identifier: cc-by-sa-4.0 -->", "CC-BY-SA-4.0"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY.", "CC-BY"), ("Creative Commons Attribution-ShareAlike 2.5 applies.", "CC-BY-SA-2.5"),
    ("This work is not licensed under the MIT license.", ""), ("It is no longer available under the BSD license. It is licensed under the MIT license.", "MIT"),
    ("public\n# domain", ""), ("# released into the public\n# domain", "Public-Domain"), ("all rights\n// reserved", ""), ("nothing here", ""), (None, ""), ("", ""),
]


def test_expressions_versions_and_denials(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    assert [(CASES[i][0], got[i]) for i in sorted(got)] == [(t, want) for t, want in CASES]


def test_unknown_sentences_inside_a_notice(spark):
    mit = next(t for n, t in NOTICES if n == "MIT")
    grant, notice, rest = mit.split("\n\n", 2)
    texts = [
        "Copyright (c) 2020 Some Body. All rights reserved.\n\n" + "\n\n".join([grant, "This licence is meant for everyone.", notice, rest]),
        "\n\n".join([grant, "A warranty may be bought apart.", "Another licence sentence.", notice]),
        NOTICES[0][1] + '\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS. See the License for the specific language governing permissions and limitations under the License.',
        "A licence of its own. Released under the MIT License. Some other licence.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan_licenses(docs).collect()}
    assert got == {0: ("All-Rights-Reserved|MIT", 0), 1: ("MIT", 0), 2: ("Apache-2.0", 0), 3: ("MIT", 2)}
