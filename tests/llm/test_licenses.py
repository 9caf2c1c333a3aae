from __future__ import annotations

import hashlib
import textwrap
from pathlib import Path

import pytest

from textloom.llm import licenses as m

OWN = "The Sample Licence\n\nCopyright (c) 2020 A. Uthor\n\nUse it, copy it -- but keep this acknowledgement & notice.\nAll rights reserved. Really"


def test_canonical_forms_agree(spark):
    from pyspark.sql import functions as F

    texts = [OWN, "", "   ", "ÉTÉ, Straße!\r\n© 2020 x\nend", "copyright mid-line stays: x copyright y", "(C) gone\n(c) gone too", "sub-license sub licence", "日本語 licence"]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(m.canonical(F.col("t")).alias("c")).collect()]
    assert got == [m.canonical_text(t) for t in texts]
    assert m.canonical_text(OWN) == "the sample license use it copy it but keep this acknowledgment notice"


def test_entire_texts_and_lines(docs):
    variant = "THE SAMPLE LICENSE.\n   copyright 1999 somebody else\nuse it; copy it; but keep this acknowledgment, notice"
    rows = [(1, OWN), (2, variant), (3, "before " + variant), (4, "text\n  Released under the M.I.T. License!\nmore"), (5, "Released under the MIT licence"), (6, None), (7, ""), (8, "x\nLICENSED UNDER CC BY-NC 4.0\nReleased under the MIT License.\nlicensed under cc-by-nc 4.0"), (None, "Released under the MIT License.\nx"), (9, "y " * 300_000), (5, "Released under the MIT licence")]
    d = docs(rows).selectExpr("*", "1 as license", "2 as notices", "3 as `__digest`", "4 as `__id`")
    out = m.license_scan(d, extra=(("Sample-1.0", OWN), ("Sample-0.9", "the sample licence use it copy it but keep this acknowledgement notice"))).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: (r.license, r.notices) for r in out}
    assert by == {1: ("Sample-0.9", ""), 2: ("Sample-0.9", ""), 3: (None, ""), 4: (None, ""), 5: ("MIT", "MIT"), 6: (None, None), 7: (None, ""), 8: (None, "CC-BY-NC-4.0,MIT"), None: (None, "MIT"), 9: (None, "")}
    assert m.license_scan(docs([])).count() == 0


def test_known_table_has_one_row_a_digest():
    rows = m.known()
    assert len({d for *_, d in rows}) == len(rows) and all(len(d) == 64 and n > 0 for _, n, d in rows)


GIVEN = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ENTIRE = {
    "MIT": [GIVEN, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", AS_IS],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", AS_IS],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.", "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "3. This notice may not be removed or altered from any source distribution."],
    "BSD-2-Clause": [BSD_START, BSD_1, BSD_2, BSD_END],
    "BSD-3-Clause": [BSD_START, BSD_1, BSD_2, BSD_3, BSD_END],
}


def wrapped(paragraphs, width):
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in paragraphs)


def test_known_texts_at_any_line_width(docs):
    digests = {d: i for i, _, d in m.known()}
    rows, want = [], {}
    for name, paragraphs in ENTIRE.items():
        for width in (*range(15, 120), 10_000):
            assert digests[hashlib.sha256(m.canonical_text(wrapped(paragraphs, width)).encode()).hexdigest()] == name, width
        for width in (15, 40, 60, 66, 72, 78, 80, 10_000):
            want[len(rows)] = name
            rows.append((len(rows), "Copyright (c) 2020, A. Uthor\nCopyright The Authors\n(c) Some Body\nAll rights reserved.\n\n" + wrapped(paragraphs, width)))
    assert {r.doc_id: r.license for r in m.license_scan(docs(rows)).collect()} == want


def test_only_statements_are_dropped():
    for line in ("Copyright 2020 X", "copyright (C) X", "Copyright © X", "Copyright, 1999 X", "Copyrighted 2001 by X", "Copyright X and contributors", "(c) 2020 X", "(c) Some Body", "Copyright [yyyy] [name]", "© X", "Copyright by X"):
        assert m.canonical_text(line) == "", line
    for line in ("copyright notice and this", "COPYRIGHT HOLDERS BE LIABLE", "copyright", "copyright, patent, trademark", "copyrighted by the Free", "(c) You must retain", "copyrights", "copyright on the Program"):
        assert m.canonical_text(line), line


LONG = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/Apache-2.0").exists(), reason="texts come from Debian's base-files")
def test_long_texts(docs):
    rows, want = [], {}
    for file, name in LONG.items():
        text = (Path("/usr/share/common-licenses") / file).read_text()
        end = text.find("END OF TERMS AND CONDITIONS")
        for x in (text, text.upper(), text.replace("\n", "\r\n"), text[:end] if end > 0 else text, text[: len(text) // 2]):
            want[len(rows)] = name if x != text[: len(text) // 2] else None
            rows.append((len(rows), x))
    assert {r.doc_id: r.license for r in m.license_scan(docs(rows)).collect()} == want
