import textwrap

from specloom.llm import licenses

MIT = """MIT License

Copyright (c) 2020 A Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, A Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""


def test_published_texts(spark):
    comment = lambda x, lead: textwrap.indent(x, lead, lambda line: True)
    texts = [MIT, MIT.split("\n", 2)[2], BSD, BSD + ENDORSE, GPL, comment(MIT, " * "), comment(BSD, "// "), comment(GPL, "# "), BSD.replace("\n", "\r\n"), "prose before\n" + GPL, " ".join(BSD.split()), GPL.replace("Foundation", "House"), BSD.replace("2. Re", "2. Perhaps re"), "\n" * 100_000 + ". " * 100_000 + GPL]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.licences for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]
    bsd = ["BSD-2-Clause"]
    assert got == [["MIT"], ["MIT"], bsd, ["BSD-3-Clause"], ["GPL-3.0"], ["MIT"], bsd, ["GPL-3.0"], bsd, ["GPL-3.0"], bsd, [], [], ["GPL-3.0"]]


NOTICES = {
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n",
    "ISC": "Copyright (c) 2021, A Holder\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
    "AGPL-3.0": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU Affero General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n",
    "CC0-1.0": "words before\n\nCC0 1.0 Universal\n\nwords after",
    "BSD-3-Clause": "# SPDX-License-Identifier: BSD-3-Clause\nimport x\n",
    "EUPL-1.2": "/* SPDX-License-Identifier: EUPL-1.2 */",
    "MIT": "// SPDX-License-Identifier: MIT\n",
}


def test_notices_and_identifiers(spark):
    texts = [*NOTICES.values(), "SPDX-License-Identifier: Nothing-1.0", "they permit a mit in a commit"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan_licenses(df).orderBy("doc_id").collect()
    assert [r.licences for r in rows] == [[x] for x in NOTICES] + [[], []]
    assert all(len(r.kinds) == len(r.licences) for r in rows)


def test_clashing_names(spark):
    df = spark.createDataFrame([("MIT License", 1, 2, 3, 4)], "text string, kinds int, Sequence int, row int, t int")
    out = licenses.scan_licenses(df)
    assert out.columns == ["text", "kinds_", "Sequence_", "row", "t", "n_sentences", "n_known", "sequence", "licences", "kinds"]
    assert out.first()[:5] == ("MIT License", 1, 2, 3, 4) and out.first()["licences"] == ["MIT"]
