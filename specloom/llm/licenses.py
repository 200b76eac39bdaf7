"""License scans by sentence rules.

Texts are normalised (letters and digits, lower case, single blanks) and known
licence sentences sought between the ends of lines, sentences and paragraphs; a
known sentence may itself be wrapped over lines, with comment leaders, but not
over paragraphs. List marks are skipped. The sequence of identifiers is then
matched against ordered licence rules, each of which consumes what it matches.
Only built-in expressions are used; the lookup tables are a fixed vocabulary and
sit in the plan as literals.

Defined results: a null or empty text has no sentences and no licence; an
unknown sentence breaks a sequence; a licence found twice is listed once.
``n_sentences`` and ``n_known`` count as the SQL does, which ends a sentence at
every line's end too and knows ``SENTENCES`` only. Copies and repeated rows are
scanned alike, very long texts whole; an input column called like an output is
passed on with an underscore appended.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, nested, unnested

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "mit-notice": "Released under the MIT License.",
    "apache2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache2-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2-comply": "you may not use this file except in compliance with the License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.',
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
}
# Licence, kind, identifiers that follow one another. Longer rules come first.
RULES = (
    ("BSD-2-Clause", "permissive", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("MIT", "permissive", ("mit-grant", "mit-keep", "as-is")),
    ("MIT", "permissive", ("mit-grant", "mit-keep")),
    ("Apache-2.0", "permissive", ("apache2-grant", "apache2-comply")),
    ("GPL-3.0", "copyleft", ("gpl3-notice",)),
    ("GPL-3.0", "copyleft", ("gpl-redistribute",)),
    ("GPL-3.0", "copyleft", ("spdx-gpl3",)),
    ("CC-BY-NC-4.0", "restricted", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", "permissive", ("cc-by-notice",)),
    ("MIT", "permissive", ("mit-notice",)),
    ("MIT", "permissive", ("spdx-mit",)),
    ("MIT", "permissive", ("mit-grant",)),
    ("Apache-2.0", "permissive", ("apache2-notice",)),
    ("Apache-2.0", "permissive", ("apache2-grant",)),
    ("Apache-2.0", "permissive", ("spdx-apache2",)),
)
# Published sentences in full, besides those above.
PUBLISHED = {
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License (MIT)",
    "mit-grant-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "as-is-full": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "eclipse2-title": "Eclipse Public License - v 2.0",
    "cc0-title": "CC0 1.0 Universal",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-notice": "Licensed under CC BY-ND 4.0.",
}
PUBLISHED_RULES = (
    ("BSD-3-Clause", "permissive", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("MIT", "permissive", ("mit-grant-full", "mit-keep", "as-is-full")),
    ("MIT", "permissive", ("mit-grant-full", "mit-keep")),
    ("MIT", "permissive", ("mit-grant-full",)),
    ("GPL-3.0", "copyleft", ("gpl3-title",)),
    ("GPL-2.0", "copyleft", ("gpl2-title",)),
    ("GPL-2.0", "copyleft", ("gpl2-redistribute",)),
    ("LGPL-2.1", "copyleft", ("lgpl21-title",)),
    ("LGPL-2.1", "copyleft", ("lgpl21-redistribute",)),
    ("LGPL-3.0", "copyleft", ("lgpl3-title",)),
    ("LGPL-3.0", "copyleft", ("lgpl3-redistribute",)),
    ("AGPL-3.0", "copyleft", ("agpl3-title",)),
    ("AGPL-3.0", "copyleft", ("agpl3-redistribute",)),
    ("Apache-2.0", "permissive", ("apache2-title",)),
    ("MPL-2.0", "copyleft", ("mpl2-notice",)),
    ("MPL-2.0", "copyleft", ("mpl2-title",)),
    ("ISC", "permissive", ("isc-grant",)),
    ("0BSD", "permissive", ("0bsd-grant",)),
    ("Unlicense", "public domain", ("unlicense",)),
    ("BSL-1.0", "permissive", ("boost-title",)),
    ("EPL-2.0", "copyleft", ("eclipse2-title",)),
    ("CC0-1.0", "public domain", ("cc0-title",)),
    ("CC-BY-4.0", "permissive", ("cc-by-work",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-work",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-notice",)),
    ("CC-BY-NC-4.0", "restricted", ("cc-by-nc-work",)),
    ("CC-BY-ND-4.0", "restricted", ("cc-by-nd-notice",)),
    ("MIT", "permissive", ("mit-title",)),
    ("MIT", "permissive", ("mit-title-the",)),
)
# Identifiers of the SPDX list by kind; "SPDX-License-Identifier: X" names X. Those of SENTENCES are there.
SPDX = {
    "permissive": "0BSD AFL-3.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 ISC MIT-0 MS-PL NCSA PostgreSQL PSF-2.0 Python-2.0 Unicode-3.0 UPL-1.0 X11 Zlib",
    "copyleft": "AGPL-3.0-only AGPL-3.0-or-later CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-or-later LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MPL-1.1 MPL-2.0 MS-RL OSL-3.0",
    "public domain": "CC0-1.0 Unlicense WTFPL",
    "restricted": "BUSL-1.1 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 Elastic-2.0 SSPL-1.0",
}
#: Most known sentences have one of these words; texts without need no search for them.
ANCHORS = ("licens", "permission", "software", "redistribut", "copyright")
#: Ends of paragraphs, sentences and lines in a normalised text.
PARAGRAPH, SENTENCE, LINE = "|", "~", "^"
#: A sentence ends at a line's end, or after . ; : ! ? before a blank.
ENDS = r"\n|(?<=[.;:!?])[ \t\x0B\f\r]+"


def normalised(sentence: str) -> str:
    """What the SQL makes of a sentence."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence).split()).lower()


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gate(sentences) -> str:
    """SQL, true of any lower-case text ``low`` that holds one of ``sentences``: an anchor, or a sentence without any as a whole."""
    own = sorted({normalised(x) for x in sentences if not re.search("|".join(ANCHORS), normalised(x))})
    tests = [f"contains(low, {_quoted(x)})" for x in ANCHORS]
    for x in own:
        first, *_ = words = x.split()
        tests.append(f"(contains(low, {_quoted(first)}) AND low rlike {_quoted('(?<![a-z0-9])' + '[^a-z0-9]+'.join(words) + '(?![a-z0-9])')})")
    return " OR ".join(tests)


def identifiers(sentences: dict[str, str] = SENTENCES) -> tuple[dict[str, str], dict[str, str]]:
    """Identifier of each normalised sentence; and each entry's own sequence of them.

    An entry that a text's punctuation would cut is known by its parts.
    """
    known: dict[str, str] = {}
    parts = {}
    for name, whole in sentences.items():
        cut = [normalised(x) for x in re.split(r"(?<=[.;:!?])\s+", whole)]
        for x in cut:
            known.setdefault(x, name if len(cut) == 1 else f"{name}~{len(known)}")
        parts[name] = "|".join(known[x] for x in cut)
    return known, parts


def _pattern(sentence: str) -> str:
    """A regular expression for a normalised sentence that may be wrapped, and cut where its own punctuation cuts it."""
    parts = [normalised(x).split() for x in re.split(r"(?<=[.;:!?])\s+", sentence)]
    return r"[|~^]".join("[ ^]".join(words) for words in parts)


def _marked(t: str) -> str:
    """SQL for text ``t`` normalised, its ends marked."""
    steps = (
        (r"\r\n?", "\n"),
        (r"\n[^A-Za-z0-9\n]*(?=\n)", "|"),  # blank lines, or bare comment leaders
        (r"(^|\n)([^A-Za-z0-9\n|]*)(?:[0-9]{1,2}|[A-Za-z]|[ivx]{1,4})[.)][ \t]+", "$1$2"),  # list marks
        (r"[.;:!?](?=[ \t\x0B\f\n|]|$)", "~"),
        (r"\n", "^"),
        (r"[^A-Za-z0-9|~^]+", " "),
        (r"[ ^]*~[ ~^]*", "~"),  # before paragraphs, so that no run is scanned twice
        (r"[ ~^]*\|[ |~^]*", "|"),
        (r" ?\^[ ^]*", "^"),
    )
    out = f"translate({t}, '|~^{{}}', '     ')"
    for pattern, by in steps:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by)})"
    out = f"lower(concat('|', trim({out}), '|'))"
    return f"regexp_replace({out}, '(?<=[|~^])[0-9]{{1,2}}[~^]', '')"


def _mark(identifier: str) -> str:
    """An identifier as it stands in a sequence: no later pattern finds it again."""
    return "{SPDX" + identifier[4:] + "}" if identifier.startswith("spdx:") else "{" + identifier.upper() + "}"


def _sequence(t: str, known: dict[str, str], spdx: tuple[str, ...] = ()) -> str:
    """SQL for the identifiers in ``t``, each in braces; ``|`` stands for anything unknown."""
    out = _marked(t)
    if spdx:
        ids = "|".join(sorted((normalised(x) for x in spdx), key=lambda x: (-len(x), x)))
        out = f"regexp_replace({out}, {_quoted('(?<=[|~^])spdx license identifier[ ~^](' + ids + ')(?=[|~^])')}, '{{SPDX:$1}}')"
    for name, whole in sorted(known.items(), key=lambda x: (-len(normalised(x[1])), x[0])):
        out = f"regexp_replace({out}, {_quoted('(?<=[|~^])' + _pattern(whole) + '(?=[|~^])')}, {_quoted(_mark(name))})"
    out = f"regexp_replace({out}, '[|~^]+(?=\\\\{{)|(?<=\\\\}})[|~^]+', '')"
    return f"regexp_replace({out}, '(^|\\\\}})[^{{}}]+', '$1|')"


def scan_licenses(df: DataFrame, text: str = "text", rules=None, sentences=None) -> DataFrame:
    """``df`` with n_sentences, n_known, sequence, licences and kinds (arrays by rule order)."""
    known, _ = identifiers(sentences or SENTENCES)
    published = sentences or SENTENCES | PUBLISHED
    # A longer rule of the published texts goes before the rules that it contains.
    listed = () if sentences else tuple(x for ids in SPDX.values() for x in ids.split())
    kinds = {x: kind for kind, ids in SPDX.items() for x in ids.split()}
    rules = rules or PUBLISHED_RULES[:1] + RULES + PUBLISHED_RULES[1:] + tuple((x, kinds[x], (f"spdx:{normalised(x)}",)) for x in listed)
    anchored, countable = _gate(published.values()), _gate(known)
    inner = nested(df, F.coalesce(F.col(named(text)).cast("string"), F.lit("")).alias("t"))
    inner = inner.withColumn("low", F.lower("t")).withColumn("anchored", F.expr(anchored)).withColumn("countable", F.expr(countable)).drop("low")
    clean = "lower(trim(regexp_replace(x, '[^A-Za-z0-9]+', ' ')))"
    lows = min(map(len, known))
    inner = inner.withColumn("s", F.expr(f"filter(split(t, {_quoted(ENDS)}), x -> x rlike '[^ \\t\\x0B\\f\\r]')"))
    names = ", ".join(map(_quoted, known))
    # Cleaned first: a lookup over the cleaning itself would repeat it.
    counted = f"size(filter(transform(s, x -> if(char_length(x) < {lows}, '', {clean})), y -> y IN ({names})))"
    inner = inner.withColumn("n_known", F.expr(f"cast(if(countable, {counted}, 0) as bigint)"))
    inner = inner.withColumn("sequence", F.expr(f"if(anchored, {_sequence('t', published, listed)}, '|')"))
    table = ", ".join(f"named_struct('ids', {_quoted(''.join(_mark(i) for i in ids))}, 'name', {_quoted(name)}, 'kind', {_quoted(kind)})" for name, kind, ids in rules)
    empty = "cast(array() as array<string>)"
    step = "if(contains(a.seq, r.ids), named_struct('seq', replace(a.seq, r.ids, '|'), 'names', array_append(a.names, r.name), 'kinds', array_append(a.kinds, r.kind)), a)"
    start = f"named_struct('seq', sequence, 'names', {empty}, 'kinds', {empty})"
    inner = inner.withColumn("hit", F.expr(f"if(sequence <> '|', aggregate(array({table}), {start}, (a, r) -> {step}), {start})"))
    out = {"n_sentences": F.expr("cast(size(s) as bigint)"), "n_known": F.col("n_known"), "sequence": F.col("sequence")}
    return unnested(inner, df, **out, licences=F.expr("array_distinct(hit.names)"), kinds=F.expr("array_distinct(hit.kinds)"))
