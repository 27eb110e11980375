"""Licence scans by sentence rules.

A text becomes its words (runs of ASCII letters and digits, lower-cased) with the places where a sentence may begin or end: after an end
mark before white space, at line starts and ends, and after a list mark at the start of a line. A known sentence is a sequence of words from a possible
begin to a possible end; it may hold one or more holes for a holder's name or years, a few words each. So line breaks, comment marks, punctuation and case
don't matter. Every possible begin is looked up by its first two words, and the longest known sentence that fits there gives its
identifier; other sentences have none. What remains of a text is a sequence of identifiers with their places. Ordered rules say which
sequences are a licence; the longest rule that matches at a place wins, then the earlier in the list, and the search goes on after
it. Identifiers of one match may stand apart by a few unknown sentences.

The time is in proportion to the text, times the few known sentences that share their first two words. The table and the rules are parameters.

Null and empty texts hold no licence. Texts of any length are scanned whole, in memory of some thirty times their size; repeated rows are each
answered; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from tidewright.llm.shared import map_rows

SCHEMA = "doc_id bigint, n_sentences bigint, n_known bigint, licenses array<string>, spans array<struct<license:string,start:bigint,end:bigint>>"
#: Unknown sentences that may stand between two of one rule.
GAP = 2
#: What stands for a name in a known sentence, and the words that it may take.
HOLE, HOLE_WORDS = "<>", 14

# Sentences of well-known licences and notices, as published; <> stands for names.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-keep-2": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liable": "IN NO EVENT SHALL <> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "x11-name": "Except as contained in this notice, the name of <> shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from <>.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND <> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-liable": "IN NO EVENT SHALL <> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by <>.",
    "bsd-endorse": "Neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-2": "The name of <> may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-asis": 'THIS SOFTWARE IS PROVIDED BY <> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liable": "IN NO EVENT SHALL <> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ncsa-grant": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "zlib-credit": "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-keep": "This notice may not be removed or altered from any source distribution.",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0.",
    "postgres-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "wtfpl": "You just DO WHAT THE FUCK YOU WANT TO.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache-under": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-2": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-asf": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    "apache-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-define": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    "gpl-hope": "This <> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-everyone": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl-preamble-3": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl-preamble-2": "The licenses for most software are designed to take away your freedom to share and change it.",
    "agpl-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "lgpl-incorporates": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-text": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").',
    "ofl-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "cc0": "To the extent possible under law, <> waived all copyright and related or neighboring rights to this work.",
    "cc0-text": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\").",
}

# Licences by their public short names and the sequences of sentences that state them.
RULES = [
    ("X11", ["mit-grant", "mit-keep", "mit-asis", "mit-liable", "x11-name"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-asis", "mit-liable"]), ("MIT", ["mit-grant", "mit-keep-2", "mit-asis", "mit-liable"]), ("MIT", ["mit-grant", "mit-keep"]), ("MIT", ["mit-grant", "mit-keep-2"]), ("MIT", ["mit-grant"]),
    ("MIT-0", ["mit-0-grant", "mit-asis", "mit-liable"]), ("MIT-0", ["mit-0-grant"]),
    ("ISC", ["isc-grant", "isc-asis", "isc-liable"]), ("ISC", ["isc-grant-2", "isc-asis", "isc-liable"]), ("ISC", ["isc-grant"]), ("ISC", ["isc-grant-2"]),
    ("0BSD", ["0bsd-grant", "isc-asis", "isc-liable"]), ("0BSD", ["0bsd-grant"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-asis", "bsd-liable"]), ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis", "bsd-liable"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-2", "bsd-asis", "bsd-liable"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-2"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liable"]), ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]), ("BSD-1-Clause", ["bsd-grant", "bsd-source", "bsd-asis", "bsd-liable"]),
    ("NCSA", ["ncsa-grant"]), ("Zlib", ["zlib-asis", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-credit", "zlib-altered", "zlib-keep"]), ("Zlib", ["zlib-asis", "zlib-liable", "zlib-grant"]), ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl-grant"]), ("BSL-1.0", ["bsl-notice"]), ("PostgreSQL", ["postgres-grant"]), ("WTFPL", ["wtfpl"]), ("Unlicense", ["unlicense", "unlicense-2"]), ("Unlicense", ["unlicense"]),
    ("Apache-2.0", ["apache-under", "apache-use", "apache-copy", "apache-asis", "apache-see"]), ("Apache-2.0", ["apache-under", "apache-use", "apache-copy-2", "apache-asis", "apache-see"]), ("Apache-2.0", ["apache-under", "apache-use"]), ("Apache-2.0", ["apache-asf"]),
    ("Apache-2.0", ["apache-title", "apache-terms", "apache-define"]), ("Apache-2.0", ["apache-title"]), ("Apache-2.0", ["apache-define"]),
    ("GPL-3.0-only", ["gpl-everyone", "gpl-preamble-3"]), ("GPL-3.0-only", ["gpl-preamble-3"]), ("GPL-2.0-only", ["gpl-everyone", "gpl-preamble-2"]), ("AGPL-3.0-only", ["gpl-everyone", "agpl-preamble"]), ("AGPL-3.0-only", ["agpl-preamble"]),
    ("LGPL-3.0-only", ["gpl-everyone", "lgpl-incorporates"]), ("LGPL-3.0-only", ["lgpl-incorporates"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy"]), ("MPL-2.0", ["mpl-notice", "mpl-copy-2"]), ("MPL-2.0", ["mpl-notice"]), ("EPL-2.0", ["epl-notice"]), ("EPL-2.0", ["epl-text"]), ("OFL-1.1", ["ofl-notice"]), ("CC0-1.0", ["cc0"]), ("CC0-1.0", ["cc0-text"]),
]

# Public short names that a tag or a plain notice may give, with the name in words where a notice uses one.
NAMED = {
    "MIT": "MIT License", "MIT-0": "", "Apache-2.0": "Apache License, Version 2.0", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "BSD-4-Clause": "", "0BSD": "", "ISC": "ISC License", "Zlib": "zlib License",
    "BSL-1.0": "Boost Software License, Version 1.0", "MPL-2.0": "Mozilla Public License, v. 2.0", "EPL-2.0": "Eclipse Public License 2.0", "Unlicense": "Unlicense", "WTFPL": "", "OFL-1.1": "SIL Open Font License, Version 1.1", "CC0-1.0": "", "PostgreSQL": "PostgreSQL License", "NCSA": "", "Artistic-2.0": "Artistic License 2.0",
    "EUPL-1.1": "European Union Public Licence v. 1.1", "EUPL-1.2": "European Union Public Licence v. 1.2", "CDDL-1.0": "Common Development and Distribution License, Version 1.0", "CDDL-1.1": "Common Development and Distribution License, Version 1.1",
    "MS-PL": "Microsoft Public License", "MS-RL": "Microsoft Reciprocal License", "AFL-3.0": "Academic Free License version 3.0", "OSL-3.0": "Open Software License version 3.0", "EPL-1.0": "Eclipse Public License v1.0", "MPL-1.1": "Mozilla Public License Version 1.1",
    "Artistic-1.0": "Artistic License 1.0", "Apache-1.1": "Apache License, Version 1.1", "CPL-1.0": "Common Public License Version 1.0", "BlueOak-1.0.0": "Blue Oak Model License 1.0.0", "PSF-2.0": "", "Python-2.0": "", "X11": "", "CC-PDDC": "",
}

# Public short names of exceptions, and of the licences that they are given with.
EXCEPTIONS = {
    "Classpath-exception-2.0": ("GPL",), "Autoconf-exception-3.0": ("GPL",), "Bison-exception-2.2": ("GPL",), "Font-exception-2.0": ("GPL",), "GCC-exception-2.0": ("GPL",), "GCC-exception-3.1": ("GPL",), "Linux-syscall-note": ("GPL", "LGPL"),
    "OpenSSL-exception": ("GPL", "LGPL"), "LLVM-exception": ("Apache",),
}
#: What a tag begins with, and its expression: names, brackets and AND, OR, WITH up to the end of the line.
TAG, _EXPRESSION = "SPDX-License-Identifier:", re.compile(r"[ \t]*((?:[A-Za-z0-9.+:-]+|[ \t()])+)")


def families() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences and rules that follow a pattern: tags, plain notices, the GNU licences and those of Creative Commons."""
    known, rules = {}, []

    def add(name: str, *texts: str) -> None:
        for text in texts:
            known[f"{name}: {text}"] = text
            rules.append((name, [f"{name}: {text}"]))

    def noticed(name: str, words: str) -> None:
        add(name, f"Licensed under the {words}.", f"Released under the {words}.", f"Distributed under the {words}.", f"This <> is licensed under the {words}.", f"This <> is released under the {words}.")

    for name, words in NAMED.items():
        add(name, f"SPDX-License-Identifier: {name}")
        if words:
            noticed(name, words)
    gnu = (
        ("GPL", "GNU General Public License", "123"), ("LGPL", "GNU Library General Public License", "2"), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
        ("AGPL", "GNU Affero General Public License", "3"),
    )
    for short, long, versions in gnu:
        for v in versions:
            full = v if "." in v else f"{v}.0"
            add(f"{short}-{full}-only", f"SPDX-License-Identifier: {short}-{full}-only", f"SPDX-License-Identifier: {short}-{full}")
            add(f"{short}-{full}-or-later", f"SPDX-License-Identifier: {short}-{full}-or-later")
            noticed(f"{short}-{full}-only", f"{long}, version {v}")
            noticed(f"{short}-{full}-only", f"{long} v{full}")
            given = f"This <> is free software; you can redistribute it and/or modify it under the terms of the {long} as published by the Free Software Foundation, "
            see = f"See the {long} for more details."
            known[see] = see
            for name, which in ((f"{short}-{full}-or-later", f"either version {v} of the License, or (at your option) any later version."), (f"{short}-{full}-only", f"version {v} of the License."), (f"{short}-{full}-only", f"version {v}.")):
                known[f"{name}: {given + which}"] = given + which
                rules.extend((name, [f"{name}: {given + which}", *more]) for more in (["gpl-hope", see], []))
    parts = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    for short, long in parts:
        name = f"CC-{short}-4.0"
        add(name, f"SPDX-License-Identifier: {name}", f"Licensed under CC {short} 4.0.", f"This <> is licensed under CC {short} 4.0.", f"This <> is licensed under a Creative Commons {long} 4.0 International License.", f"Creative Commons {long} 4.0 International Public License")
        for v in ("2.0", "3.0"):
            name = f"CC-{short}-{v}"
            add(name, f"SPDX-License-Identifier: {name}", f"Licensed under CC {short} {v}.", f"This <> is licensed under CC {short} {v}.", f"This <> is licensed under a Creative Commons {long} {v} Unported License.", f"Creative Commons {long} {v} Unported")
    # A name in a tag, followed by an exception that it is given with.
    for exception, shorts in EXCEPTIONS.items():
        known[f"with: {exception}"] = f"SPDX-License-Exception {exception}"
        for name, ids in list(rules):
            if ids[0].startswith(f"{name}: {TAG}") and name.startswith(tuple(f"{x}-" for x in shorts)) and len(ids) == 1:
                rules.append((f"{name} WITH {exception}", [*ids, f"with: {exception}"]))
    return known, rules


_WORDS = re.compile(r"[0-9A-Za-z]+")
#: Between two words: an end mark before white space, or a line end, parts sentences.
_PART = re.compile(r"[.!?;:]['\")\]]*\s|\n")
#: A sentence as it is counted ends with a mark before white space, or with an empty line.
_END = re.compile(r"[.!?;:]['\")\]]*\s+|\n\s*\n\s*")


def sentence_ends(text: str | None) -> list[int]:
    """Where the sentences that hold a word end."""
    out, at = [], 0
    for m in _END.finditer(text or ""):
        if _WORDS.search(text, at, m.end()):
            out.append(m.end())
        at = m.end()
    if text and _WORDS.search(text, at):
        out.append(len(text))
    return out


class Recogniser:
    """Known sentences by their first two words, and rules by their first identifier."""

    def __init__(self, known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, gap: int = GAP):
        if known is None:
            more_known, more_rules = families()
            known, rules = SENTENCES | more_known, RULES + more_rules
        self.gap = gap
        # (words, holes apart) per sentence; longer ones first. A sentence of one word, or with a hole in its place, has none for the second.
        self.known: dict[tuple[str, str | None], list[tuple[int, str, list[list[str]]]]] = {}
        texts: dict[tuple, str] = {}
        same: dict[str, str] = {}
        for name, text in known.items():
            parts = [[w.lower() for w in _WORDS.findall(part)] for part in text.split(HOLE)]
            same[name] = texts.setdefault(tuple(map(tuple, parts)), name)
            if same[name] == name and parts[0]:
                self.known.setdefault((parts[0][0], parts[0][1] if len(parts[0]) > 1 else None), []).append((-sum(map(len, parts)), name, [p for p in parts if p]))
        for found in self.known.values():
            found.sort()
        # Names that a tag may give, and exceptions.
        self.named = {text.removeprefix(TAG).strip().lower(): same[name] for name, text in known.items() if text.startswith(TAG)}
        self.excepted = {name.removeprefix("with: ").lower(): name for name in known if name.startswith("with: ")}
        self.rules: dict[str, list[tuple[int, int, str, list[str]]]] = {}
        for rank, (name, sequence) in enumerate(rules):
            ids = [same[s] for s in sequence]
            self.rules.setdefault(ids[0], []).append((-len(ids), rank, name, ids))
        for found in self.rules.values():
            found.sort()

    @staticmethod
    def _fits(words: list[str], at: int, parts: list[list[str]], closes: list[bool]) -> int:
        """The end of a known sentence that begins at a word, or 0; the words of a hole lie between two parts."""
        for k, part in enumerate(parts):
            if not k:
                begins = (at,)
            else:
                begins = range(at + 1, min(at + HOLE_WORDS, len(words) - len(part)) + 1)
            for begin in begins:
                end = begin + len(part)
                if words[begin] == part[0] and words[begin:end] == part and (k + 1 < len(parts) or closes[end - 1]):
                    at = end
                    break
            else:
                return 0
        return at

    def identify(self, text: str | None) -> tuple[int, list[tuple[int, str, int, int, int]]]:
        """The number of sentences, and of the known ones the number where they begin, identifier, place, and the number where they end."""
        found = list(_WORDS.finditer(text or ""))
        ends = sentence_ends(text)
        words = [m[0].lower() for m in found]
        opens, closes, line = [True] * len(words), [True] * len(words), True
        for k in range(1, len(words)):
            low, high = found[k - 1].end(), found[k].start()
            parted = high - low > 1 and _PART.search(text, low, high) is not None or text[low] == "\n"
            closes[k - 1] = parted
            # After a list mark that opens a line, a number or a single letter, a sentence may begin as well.
            opens[k] = parted or line and high - low > 1 and (len(words[k - 1]) == 1 or words[k - 1].isdigit() and len(words[k - 1]) == 2)
            line = "\n" in text[low:high]
        out, at = [], 0
        while at < len(words):
            if opens[at]:
                first = words[at]
                if first == "spdx" and (last := self._tag(text, words, found, at, ends, out)) is not None:
                    at = last + 1
                    continue
                for pair in ((first, words[at + 1] if at + 1 < len(words) else None), (first, None)):
                    for _, name, parts in self.known.get(pair, ()):
                        end = self._fits(words, at, parts, closes)
                        if end:
                            break
                    else:
                        continue
                    stop = found[end - 1].end()
                    while stop < len(text) and text[stop] in ".!?;:":
                        stop += 1
                    out.append((bisect_right(ends, found[at].start()), name, found[at].start(), stop, bisect_right(ends, found[end - 1].start())))
                    at = end - 1
                    break
            at += 1
        return len(ends), out

    def _tag(self, text: str, words: list[str], found: list[re.Match], at: int, ends: list[int], out: list) -> int | None:
        """The known names of a tag's expression, in their order, added to out; gives the last word that belongs to it, None where the tag has one plain name.

        Brackets and AND and OR say how a user may choose, not which licences there are; a known exception follows the name that it belongs to; a plus
        stands for later versions. The expression ends before the first word that can't go on with it.
        """
        if words[at : at + 3] != ["spdx", "license", "identifier"] or not text.startswith(":", found[at + 2].end()):
            return None
        after = _EXPRESSION.match(text, found[at + 2].end() + 1)
        names, operator = [], ""
        for m in re.finditer(r"[^ \t()]+", after[1]) if after else ():
            if (len(names) > 0) != bool(operator):
                if m[0] not in ("AND", "OR", "WITH", "and", "or", "with"):
                    break
                operator = m[0].lower()
            else:
                names.append((operator, m))
                operator = ""
        if len(names) < 2 and not (names and names[0][1][0].endswith("+")):
            return None
        for operator, m in names:
            name = m[0].lower()
            name = f"{name[:-1]}-or-later" if name.endswith("+") else name
            ident = self.excepted.get(name) if operator == "with" else self.named.get(name)
            begin, end = after.start(1) + m.start(), after.start(1) + m.end()
            if ident:
                number = bisect_right(ends, begin)
                out.append((number, ident, begin, end, number))
        while at + 1 < len(words) and found[at + 1].end() <= end:
            at += 1
        return at

    def scan(self, text: str | None) -> tuple[int, int, list[tuple[str, int, int]]]:
        """Sentences, known ones, and licences with their places."""
        n, found = self.identify(text)
        out, at = [], 0
        while at < len(found):
            for _, _, name, ids in self.rules.get(found[at][1], ()):
                end = at + len(ids)
                row = found[at:end]
                if [x[1] for x in row] == ids and all(y[0] - x[4] <= self.gap + 1 for x, y in zip(row, row[1:], strict=False)):
                    out.append((name, row[0][2], row[-1][3]))
                    at = end
                    break
            else:
                at += 1
        return n, len(found), out


def license_scan(documents: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """doc_id, n_sentences, n_known, licenses (sorted, distinct), spans in characters, for every document.

    known and rules: sentences by identifier and ordered (licence, identifiers), instead of the module's own.
    """

    def start():
        scan = Recogniser(known, rules).scan

        def each(cols: dict) -> dict:
            got = [scan(t) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"], "n_sentences": [n for n, _, _ in got], "n_known": [k for _, k, _ in got], "licenses": [sorted({x[0] for x in found}) for _, _, found in got],
                "spans": [[{"license": x, "start": a, "end": b} for x, a, b in found] for _, _, found in got],
            }

        return each

    return map_rows(documents, ["doc_id", "text"], SCHEMA, start)
