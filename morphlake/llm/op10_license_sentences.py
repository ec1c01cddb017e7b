"""Licence scan by sentence rules.

A text is split at end signs; the catalogue's sentences are split by the same rule, and pieces in a row that make up one
that the catalogue knows become its identifier. A sentence of the catalogue may hold a slot for a name, which any few words
fill, and a notice ("licensed under ...") or an SPDX tag may name several licences. A licence is recognised where its rule's identifiers occur in order, with at most ``GAP`` unknown sentences between neighbours. Where
rules overlap the one of most sentences wins, then the one that comes first in the rules.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.shared import id_text, table

GAP = 2

# Licence sentences by identifier, as their publishers word them.
SENTENCES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-2.0-use": "you may not use this file except in compliance with the License.",
    "apache-2.0-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is-software": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-names": "Neither the names of {} nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-author": "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-2.0-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-1.0-work": "This work has been dedicated to the public domain under CC0 1.0.",
    "lgpl-2.1-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-redistribute": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "agpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
    "gpl-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "isc-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense-release": "This is free and unencumbered software released into the public domain.",
    "epl-2.0-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by-nd-4.0-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "gpl-2.0-preamble": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "gpl-3.0-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "lgpl-2.1-preamble": "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "lgpl-3.0-text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "agpl-3.0-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "mpl-2.0-grant": "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:",
}
# Licence names of the tag "SPDX-License-Identifier: NAME", with their kind.
TAGS = {
    "Apache-2.0": "permissive", "MIT": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "ISC": "permissive", "Zlib": "permissive", "BSL-1.0": "permissive", "Unlicense": "permissive",
    "CC0-1.0": "permissive", "CC-BY-4.0": "permissive", "CC-BY-SA-4.0": "copyleft", "CC-BY-NC-4.0": "restricted", "CC-BY-ND-4.0": "restricted", "MPL-2.0": "copyleft", "EPL-2.0": "copyleft",
    "GPL-2.0-only": "copyleft", "GPL-2.0-or-later": "copyleft", "GPL-3.0-only": "copyleft", "GPL-3.0-or-later": "copyleft", "LGPL-2.1-only": "copyleft", "LGPL-2.1-or-later": "copyleft",
    "LGPL-3.0-only": "copyleft", "LGPL-3.0-or-later": "copyleft", "AGPL-3.0-only": "copyleft", "AGPL-3.0-or-later": "copyleft",
}
SENTENCES |= {f"tag-{name}": f"SPDX-License-Identifier: {name}" for name in TAGS}
# Names of licences in notices, as they are written there, and older SPDX names.
NAMES = {
    "MIT License": "MIT", "MIT": "MIT", "Expat License": "MIT", "ISC License": "ISC", "zlib License": "Zlib", "Unlicense": "Unlicense",
    "Apache License, Version 2.0": "Apache-2.0", "Apache License 2.0": "Apache-2.0", "Apache License Version 2": "Apache-2.0", "Apache 2.0 License": "Apache-2.0", "Apache 2.0": "Apache-2.0", "Apache-2.0 License": "Apache-2.0",
    "BSD 2-Clause License": "BSD-2-Clause", "2-Clause BSD License": "BSD-2-Clause", "Simplified BSD License": "BSD-2-Clause",
    "BSD 3-Clause License": "BSD-3-Clause", "3-Clause BSD License": "BSD-3-Clause", "New BSD License": "BSD-3-Clause", "Modified BSD License": "BSD-3-Clause", "BSD-3-Clause License": "BSD-3-Clause",
    "Boost Software License, Version 1.0": "BSL-1.0", "Boost Software License 1.0": "BSL-1.0",
    "Mozilla Public License, v. 2.0": "MPL-2.0", "Mozilla Public License Version 2.0": "MPL-2.0", "Mozilla Public License 2.0": "MPL-2.0", "MPL 2.0": "MPL-2.0",
    "Eclipse Public License 2.0": "EPL-2.0", "Eclipse Public License v2.0": "EPL-2.0", "Eclipse Public License, Version 2.0": "EPL-2.0",
    "GNU General Public License, version 2": "GPL-2.0-only", "GNU General Public License v2.0": "GPL-2.0-only", "GPL-2.0": "GPL-2.0-only", "GPLv2": "GPL-2.0-only", "GPLv2+": "GPL-2.0-or-later", "GPL-2.0+": "GPL-2.0-or-later",
    "GNU General Public License version 2 or later": "GPL-2.0-or-later", "GNU General Public License, version 3": "GPL-3.0-only", "GNU General Public License v3.0": "GPL-3.0-only", "GPL-3.0": "GPL-3.0-only", "GPLv3": "GPL-3.0-only",
    "GPLv3+": "GPL-3.0-or-later", "GPL-3.0+": "GPL-3.0-or-later", "GNU General Public License version 3 or later": "GPL-3.0-or-later",
    "GNU Lesser General Public License, version 2.1": "LGPL-2.1-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPLv2.1": "LGPL-2.1-only", "GNU Lesser General Public License, version 3": "LGPL-3.0-only", "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "LGPLv3": "LGPL-3.0-only",
    "GNU Affero General Public License, version 3": "AGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only", "AGPLv3": "AGPL-3.0-only",
}
# Licence, its kind, and the sentences that make it up, in order.
RULES = (
    ("Apache-2.0", "permissive", ("apache-2.0-header", "apache-2.0-use", "apache-2.0-copy", "apache-2.0-basis")),
    ("Apache-2.0", "permissive", ("apache-2.0-header", "apache-2.0-use")),
    ("Apache-2.0", "permissive", ("apache-2.0-notice",)),
    ("MIT", "permissive", ("mit-grant", "mit-condition", "as-is-software")),
    ("MIT", "permissive", ("mit-notice",)),
    ("MIT", "permissive", ("mit-licensed",)),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", "permissive", ("isc-grant",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl-redistribute", "gpl-hope")),
    ("GPL-3.0-or-later", "copyleft", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl-2.0-redistribute", "gpl-hope")),
    ("GPL-2.0-or-later", "copyleft", ("gpl-2.0-redistribute",)),
    ("GPL-3.0-only", "copyleft", ("gpl-3.0-work",)),
    ("MPL-2.0", "copyleft", ("mpl-2.0-notice",)),
    ("CC-BY-4.0", "permissive", ("cc-by-4.0-notice",)),
    ("CC-BY-4.0", "permissive", ("cc-by-4.0-work",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-4.0-notice",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-4.0-work",)),
    ("CC-BY-NC-4.0", "restricted", ("cc-by-nc-4.0-notice",)),
    ("CC-BY-NC-4.0", "restricted", ("cc-by-nc-4.0-work",)),
    ("CC0-1.0", "permissive", ("cc0-1.0-work",)),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-disclaimer")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer")),
    ("ISC", "permissive", ("isc-grant", "isc-disclaimer")),
    ("Zlib", "permissive", ("zlib-grant",)),
    ("BSL-1.0", "permissive", ("bsl-1.0-notice",)),
    ("Unlicense", "permissive", ("unlicense-release",)),
    ("EPL-2.0", "copyleft", ("epl-2.0-terms",)),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl-2.1-redistribute", "lgpl-hope", "lgpl-details")),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl-2.1-redistribute", "lgpl-hope")),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl-2.1-redistribute",)),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl-3.0-redistribute", "lgpl-hope")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl-3.0-redistribute",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl-redistribute", "gpl-hope", "agpl-details")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl-redistribute", "gpl-hope")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl-redistribute",)),
    ("AGPL-3.0-only", "copyleft", ("agpl-only", "gpl-hope")),
    ("AGPL-3.0-only", "copyleft", ("agpl-only",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl-redistribute", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", "copyleft", ("gpl-2.0-redistribute", "gpl-hope", "gpl-details")),
    ("GPL-3.0-only", "copyleft", ("gpl-only", "gpl-hope")),
    ("GPL-3.0-only", "copyleft", ("gpl-only",)),
    ("GPL-2.0-only", "copyleft", ("gpl-2.0-only", "gpl-hope")),
    ("GPL-2.0-only", "copyleft", ("gpl-2.0-only",)),
    ("CC-BY-ND-4.0", "restricted", ("cc-by-nd-4.0-work",)),
    ("CC-BY-NC-SA-4.0", "restricted", ("cc-by-nc-sa-4.0-work",)),
    ("CC-BY-NC-ND-4.0", "restricted", ("cc-by-nc-nd-4.0-work",)),
    *((name, kind, (f"tag-{name}",)) for name, kind in TAGS.items()),
    ("BSD-3-Clause", "permissive", ("all-rights-reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-3-Clause", "permissive", ("all-rights-reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-disclaimer")),
    ("BSD-2-Clause", "permissive", ("all-rights-reserved", "bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", "permissive", ("all-rights-reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer")),
    ("All-Rights-Reserved", "restricted", ("all-rights-reserved",)),
    ("Apache-2.0", "permissive", ("apache-2.0-grant",)),
    ("GPL-2.0-only", "copyleft", ("gpl-2.0-preamble",)),
    ("GPL-3.0-only", "copyleft", ("gpl-3.0-preamble",)),
    ("LGPL-2.1-only", "copyleft", ("lgpl-2.1-preamble",)),
    ("LGPL-3.0-only", "copyleft", ("lgpl-3.0-text",)),
    ("AGPL-3.0-only", "copyleft", ("agpl-3.0-preamble",)),
    ("MPL-2.0", "copyleft", ("mpl-2.0-grant",)),
)
# A holder may be named in other words than the rules' own sentence has.
RULES += tuple((licence, kind, tuple(other if i == "bsd-name" else i for i in rule)) for other in ("bsd-names", "bsd-author") for licence, kind, rule in RULES if "bsd-name" in rule)
RULES += tuple((name, kind, (f"notice-{name}",)) for name, kind in TAGS.items())

_SIGNS = re.compile(r"[^0-9a-z\u0080-\U0010ffff]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
#: A sentence also ends after the last word of one that the catalogue has without an end sign.
_END = re.compile("|".join([r"[.;:!?](?=\s|$)", *(rf"(?<={re.escape(s.split()[-1])})(?=\s)" for s in SENTENCES.values() if s[-1] not in ".;:!?")]))
#: Comment and list marks; a number is one only where the line before ends in a sign.
_MARK = re.compile(r"(?m)^[ \t]*(?:[#*/>%-]+|\([a-z0-9]\))[ \t]+|^(?<![^.;:!?\n]\n)[ \t]*\d{1,2}[.)][ \t]+")


def normalised(sentence: str) -> str:
    """Lower case, every run of signs and spaces one space; a plus after a version is "or later"."""
    return _SIGNS.sub(" ", _PLUS.sub(" or later", sentence.lower())).strip()


_PLUS = re.compile(r"(?<=\d)\+")
#: A slot takes one to so many words; a name may hold end signs.
_SLOT_WORDS = 16
_KNOWN = {normalised(s): i for i, s in SENTENCES.items()}
#: One word of each sentence that is rare outside licences: a paragraph without any holds no sentence of the catalogue.
_HINTS = ("licens", "permission", "disclaim", "warrant", "redistribut", "copyright", "public domain", "all rights reserved", "free software")
if any(not any(h in s for h in _HINTS) for s in _KNOWN):
    raise ValueError("a catalogue sentence has none of the hint words")
_FIRST_HINTS = ("licens", "permission", "disclaim", "disclaim", "warrant", "redistribut", "copyright", "public", "rights", "software")


def _catalogue() -> dict[str, list[tuple[tuple[str, ...], str]]]:
    """By first piece: (pieces, identifier) of each sentence, longest first; an address may also stand after a blank line."""
    out: dict[str, list[tuple[tuple[str, ...], str]]] = {}
    for identifier, sentence in SENTENCES.items():
        for form in () if "{}" in sentence else {sentence, re.sub(r" (?=https?://)", "\n\n", sentence)}:
            stops = sorted({0, len(form), *(m.end() for m in _END.finditer(form)), *(m.start() for m in _PARAGRAPH.finditer(form))})
            pieces = tuple(p for a, b in zip(stops, stops[1:], strict=False) if (p := normalised(form[a:b])))
            out.setdefault(pieces[0], []).append((pieces, identifier))
    return {k: sorted(v, key=lambda x: -len(x[0])) for k, v in out.items()}


_STARTS = _catalogue()
_PIECES = {p for forms in _STARTS.values() for pieces, _ in forms for p in pieces}


def _hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in _FIRST_HINTS) and any(h in normalised(low) for h in _HINTS)


_LONGEST = max(map(len, _PIECES))
#: What stands before a slot, what after it, and the identifier.
_SLOTTED = [(normalised(s.split("{}")[0]) + " ", " " + normalised(s.split("{}")[1]), i) for i, s in SENTENCES.items() if "{}" in s]


def _slotted(keys: list[str], at: int) -> tuple[str, int] | None:
    """The catalogue's sentence with a slot that the pieces from ``at`` on make up, and the number of pieces."""
    for before, after, identifier in _SLOTTED:
        whole, longest = "", len(before) + len(after) + 20 * _SLOT_WORDS
        for n, key in enumerate(keys[at : at + longest // 2], 1):
            whole = f"{whole} {key}".strip()
            begun = whole.startswith(before)
            if len(whole) > longest or not begun and not before.startswith(f"{whole} "):
                break
            if begun and whole.endswith(after) and 1 <= len(whole[len(before) : len(whole) - len(after)].split()) <= _SLOT_WORDS:
                return identifier, n
    return None


_LICENCES = {normalised(n): n for n in TAGS} | {normalised(n): licence for n, licence in NAMES.items()}
_NAME = re.compile("|".join(re.escape(n) + r"(?= |$)" for n in sorted(_LICENCES, key=len, reverse=True)))
_JOINT = re.compile(r"(?:and or|or|and)(?= |$)")
_FILLER = re.compile(r"(?:the|a|an|either of|either|one of|any of|both|terms of|conditions of)(?: |$)")
#: A notice: a few words of what is licensed, "licensed under", then names.
_NOTICE = re.compile(r"^(?:\S+ ){0,12}?(?:licensed|released|distributed|available|provided|published|covered) (?:under|by) ")


def _names(text: str) -> tuple[list[str], str]:
    """Licences named one after another with "or" or "and" between, from the text's start; and what is left."""
    out: list[str] = []
    while True:
        rest = _JOINT.sub("", text, count=1).strip() if out and _JOINT.match(text) else text if not out else None
        while rest and (filler := _FILLER.match(rest)):
            rest = rest[filler.end() :]
        m = _NAME.match(rest) if rest else None
        if not m:
            return out, text
        out.append(_LICENCES[m.group()])
        text = rest[m.end() :].strip()


def _named(keys: list[str], at: int) -> tuple[list[str], int] | None:
    """Identifiers of the licences that a notice or an SPDX tag names from piece ``at`` on, and the number of pieces."""
    if keys[at] == _TAG:
        found, n = [], 1
        while at + n < len(keys):
            key = keys[at + n]
            names, left = _names_after(key) if found else _names(key)
            if not names:
                break
            found, n = found + names, n + 1
            if left:
                break
        return ([f"tag-{x}" for x in dict.fromkeys(found)], n) if found else None
    m = _NOTICE.match(keys[at])
    best: tuple[list[str], int] = ([], 0)
    for n in range(1, 4) if m else ():  # a notice may run over lines, or a name over an end sign
        names = _names(" ".join(keys[at : at + n])[m.end() :])[0]
        if len(names) > len(best[0]):
            best = names, n
    return ([f"notice-{x}" for x in dict.fromkeys(best[0])], best[1]) if best[0] else None


def _names_after(key: str) -> tuple[list[str], str]:
    """Licences of a piece that goes on with "or" or "and"."""
    m = _JOINT.match(key)
    return _names(key[m.end() :].strip()) if m else ([], key)


_TAG = "spdx license identifier"


def sentences(paragraph: str) -> Iterator[str]:
    """Normalised pieces of a paragraph between end signs, in order: each line's own first, then, where one runs over line ends, the whole."""
    plain = _MARK.sub("", paragraph)
    at, lines = 0, [i + 1 for i, c in enumerate(plain) if c == "\n"]
    stops = [m.end() for m in _END.finditer(plain)]
    if not stops or stops[-1] < len(plain):
        stops.append(len(plain))
    for stop in stops:
        starts = [at, *lines[bisect_left(lines, at + 1) : bisect_left(lines, stop)]]
        yield from _split([normalised(plain[a:b]) for a, b in zip(starts, [*starts[1:], stop], strict=True)])
        at = stop


def _split(lines: list[str]) -> list[str]:
    """The longest known ending of a sentence over several lines that starts at a line's start, or its lines one by one.

    Only endings no longer than the longest known piece are tried, so the work grows with the lines.
    """
    ending, known = "", None
    for k in range(len(lines) - 1, -1, -1):
        ending = f"{lines[k]} {ending}".strip()
        if len(ending) > _LONGEST:
            break
        if ending in _PIECES:
            known = k, ending
    return lines if known is None else [*lines[: known[0]], known[1]]


def identify(text: str) -> list[tuple[int, str]]:
    """(number of the sentence, identifier) of every known sentence of a text; a paragraph without a hint is one unknown."""
    found, number, at = [], 0, 0
    if not _hinted(text):
        return found
    keys: list[str] = []
    for paragraph in _PARAGRAPH.split(text):
        keys += [key for key in sentences(paragraph) if key] if _hinted(paragraph) or "http" in paragraph else [""]
    while at < len(keys):
        n, known = 1, next((x for x in _STARTS.get(keys[at], ()) if tuple(keys[at : at + len(x[0])]) == x[0]), None)
        tag = keys[at] == _TAG
        if known and not tag:
            found.append((number, known[1]))
            n = len(known[0])
        elif slot := None if tag else _slotted(keys, at):
            found.append((number, slot[0]))
            n = slot[1]
        elif names := _named(keys, at):
            found += [(number, i) for i in names[0]]
            n = names[1]
        at += n
        number += 1
    return found


_ORDER = sorted(RULES, key=lambda rule: -len(rule[2]))


def recognise(found: list[tuple[int, str]], gap: int = GAP) -> list[tuple[str, str, int]]:
    """(licence, kind, number of its first sentence) of all matches in order of place."""
    out, used, present = [], set(), {i for _, i in found}
    for licence, kind, rule in _ORDER:
        for start in range(len(found)) if present.issuperset(rule) else ():
            if found[start][1] != rule[0] or start in used:
                continue
            path = [start]
            for want in rule[1:]:
                at = path[-1] + 1
                while at < len(found) and found[at][0] - found[path[-1]][0] <= gap + 1 and (found[at][1] != want or at in used):
                    at += 1
                if at == len(found) or found[at][0] - found[path[-1]][0] > gap + 1:
                    break
                path.append(at)
            if len(path) == len(rule):
                used.update(path)
                out.append((licence, kind, found[start][0]))
    return sorted(out, key=lambda m: (m[2], m[0]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, kinds, n_matches, n_sentences) for every row of ``docs``.

    licenses: distinct licence names in alphabetical order; kinds: the distinct kinds of them; n_matches counts every
    recognised passage, n_sentences every known sentence. Null and empty texts have none, an empty table gives no rows.
    Null and shared ids are kept as they are, each row is scanned by itself, a text of any length whole and in time that
    grows with it. Other columns, whatever their names, are ignored.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                found = identify(t) if isinstance(t, str) else []
                hits = recognise(found) if found else []
                out.append((sorted({h[0] for h in hits}), sorted({h[1] for h in hits}), len(hits), len(found)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c: [o[i] for o in out] for i, c in enumerate(("licenses", "kinds", "n_matches", "n_sentences"))}})

    found = docs.select(id_text(), "text").mapInPandas(scan, "doc_id string, licenses array<string>, kinds array<string>, n_matches long, n_sentences long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op10_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("kinds", ",").alias("kinds"), "n_matches", "n_sentences")
