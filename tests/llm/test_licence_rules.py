"""Every licence rule finds its own sentences, and published headers are found as they are printed."""

import random
import re
import textwrap

import pytest

from morphlake.llm import op10_license_sentences as op10

GPL3 = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language."""


def found(text):
    return [m[0] for m in op10.recognise(op10.identify(text))]


@pytest.mark.parametrize("rule", [r for r in op10.RULES if not r[2][0].startswith("notice-")], ids=lambda r: "+".join(r[2]))
def test_every_rule_recognises_its_sentences(rule):
    parts = [op10.SENTENCES[s].replace("{}", "Example Widgets Inc. and others") for s in rule[2]]
    forms = [" ".join(parts), "\n".join(parts), "\n\n".join(parts), "Intro text.\n" + " ".join(parts) + " More text."]
    forms += [textwrap.fill(" ".join(parts), width, break_long_words=False, break_on_hyphens=False) for width in (30, 47, 72, 90)]
    for form in forms:
        assert op10.identify(form) and [x[1] for x in op10.identify(form)] == list(rule[2]), form
        assert found(form) == [rule[0]], form


def test_published_headers():
    assert found(GPL3) == ["GPL-3.0-or-later"] and [x[1] for x in op10.identify(GPL3)] == ["gpl-redistribute", "gpl-hope"]
    assert found(MPL) == ["MPL-2.0"]
    for text in (APACHE, textwrap.indent(APACHE, "# ", lambda line: True).replace("# \n", "#\n")):
        assert found(text) == ["Apache-2.0"]
        assert [x[1] for x in op10.identify(text)] == ["apache-2.0-header", "apache-2.0-use", "apache-2.0-copy", "apache-2.0-basis"]


def test_hints_over_line_ends_and_no_pieces_alone():
    assert [x[1] for x in op10.identify("All rights\nreserved.")] == ["all-rights-reserved"]
    assert found("# This work has been dedicated to the public\n# domain under CC0 1.0.") == ["CC0-1.0"]
    assert op10.identify("This program is free software: buy it. Version 2.0. License 2.0.") == []


HOLDER = "Example Works Inc. and its friends"


def plain_identify(text):
    """Known sentences by trying every run of words of every paragraph against the catalogue, longest first."""
    known = {tuple(op10.normalised(s.replace("{}", HOLDER)).split()): i for i, s in op10.SENTENCES.items()}
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        words, at = op10.normalised(paragraph).split(), 0
        while at < len(words):
            hit = next(((n, known[w]) for n in range(len(words) - at, 0, -1) if (w := tuple(words[at : at + n])) in known), None)
            out += [hit[1]] if hit else []
            at += hit[0] if hit else 1
    return out


def test_sentences_equal_the_plain_search():
    rng = random.Random(6)
    names = [n for n in op10.SENTENCES if not n.startswith("tag-") and n != "mit-licensed"]
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(op10.SENTENCES[rng.choice(names)].replace("{}", HOLDER) if rng.random() < 0.6 else " ".join(rng.choice(("some", "other", "licence", "words")) for _ in range(rng.randint(1, 9))) + ".")
        text = rng.choice((" ", "\n", "\n\n")).join(parts)
        text = text if "\n" in text else textwrap.fill(text, rng.choice((40, 72)), break_long_words=False, break_on_hyphens=False)
        assert [i for _, i in op10.identify(text)] == plain_identify(text), text


def test_tags_and_ids(spark):
    big = 2**60 + 1
    rows = [(1, "// SPDX-License-Identifier: LGPL-3.0-or-later\nint x;"), (None, "All rights reserved."), (big, "Released under the MIT License."), (big, None), (2, "line of a licence\n" * 20000)]
    docs = spark.createDataFrame([(i, t, ["x"]) for i, t in rows], "doc_id long, text string, licenses array<string>")
    got = sorted(((r.doc_id, tuple(r.licenses)) for r in op10.scan_licenses(docs).collect()), key=str)
    assert got == sorted([(1, ("LGPL-3.0-or-later",)), (None, ("All-Rights-Reserved",)), (big, ("MIT",)), (big, ()), (2, ())], key=str)


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * {name}
promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY {by} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED."""
HOLDERS = (
    "Neither the name of Google Inc. nor the names of its\ncontributors may be used to endorse or",
    "Neither the name of the University of California, Berkeley nor the\nnames of its contributors may be used to endorse or",
    "Neither the name of the Python Software Foundation nor the names of its contributors may be used to endorse or",
    "Neither the names of the copyright owners nor the names of their\ncontributors may be used to endorse or",
    "The name of the author may not be used to endorse or",
    "Neither the\nname of Acme Co. Ltd., Inc. nor the names of its contributors may be used to endorse or",
)


@pytest.mark.parametrize("name", HOLDERS)
@pytest.mark.parametrize("by", ["THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "GOOGLE INC. AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS"])
def test_a_named_holder_is_a_slot(name, by):
    assert found(BSD.format(name=name, by=by)) == ["BSD-3-Clause"]
    assert found(BSD.format(name="Neither the name of " + "x " * 40 + "nor the names of its contributors may be used to endorse or", by=by)) == ["BSD-2-Clause"]


NOTICES = {
    "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;": ["Apache-2.0", "MIT"],
    "# SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0": ["GPL-2.0-or-later"],
    "/* SPDX-License-Identifier: GPL-2.0-only OR BSD-2-Clause */": ["BSD-2-Clause", "GPL-2.0-only"],
    "This file is licensed under the MIT License.": ["MIT"],
    "Foo is licensed under either of Apache License, Version 2.0\nor the MIT license at your option.": ["Apache-2.0", "MIT"],
    "Bar is distributed under the terms of the GNU General Public\nLicense, version 2.": ["GPL-2.0-only"],
    "Use is available under the BSD 3-Clause License, see LICENSE.": ["BSD-3-Clause"],
    "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\n\nhttps://www.eclipse.org/legal/epl-2.0/": ["EPL-2.0"],
    "The driver was licensed under the bridge, by permission.": [],
    "SPDX-License-Identifier: Whatever-1.0": [],
}


@pytest.mark.parametrize("text", NOTICES)
def test_notices_and_tags_name_licences(text):
    assert sorted(found(text)) == NOTICES[text]


def test_long_texts_are_scanned_whole(spark):
    text = "All rights are with the licensor of this permission. " * 20_000 + "Released under the MIT License."
    docs = spark.createDataFrame([((1 << 60) + 1, text, 1), (None, None, 2), (None, "", 3)], "doc_id long, text string, licenses int")
    assert {(r.doc_id, tuple(r.licenses)) for r in op10.scan_licenses(docs).collect()} == {((1 << 60) + 1, ("MIT",)), (None, ())}
    assert op10.scan_licenses(docs.limit(0)).count() == 0
