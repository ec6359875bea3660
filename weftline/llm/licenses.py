"""License scans by sentence rules (operator 9), in DataFrame functions only.

A text is cut into sentences, each is normalised (a to z and digits, single
spaces) and looked up among the sentences of known licences and notices. The
identifiers, in order, are matched against licence rules: ordered sequences that
may have other known sentences between them. Sentences are cut twice, once with a
line break as a boundary and once with it as a space, so that both one-line notices
and wrapped licence texts are recognised; a licence counts if either sequence
matches. Full stops, semicolons, colons and list marks end a sentence; of the second
kind also empty lines and those with comment marks only.

The known sentences come from the licence texts below by the same cut. A rule is
the sequence of a text's sentences, so a text is recognised plain, wrapped, in
comments or as one paragraph, however its lists are marked.

Defined cases: a null or empty text has no sentence and no licence; repeated
sentences repeat in the sequence; every row is judged alone, so repeated rows,
extra columns and empty tables need no care; only doc_id and text are read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._graph import table

# Parts of public licence texts that several licences share.
_NO_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of {} may be used to endorse or promote products derived from this software without specific prior written permission."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_LATER = ", either version {} of the License, or (at your option) any later version."
_ONLY = "; version {} of the License."
_LESSER = "Lesser General Public License"
_AFFERO = "Affero General Public License"
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
# Licences and their texts, one rule each. A text of one sentence is a notice.
TEXTS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("ISC", 'Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License version 3"),
    ("GPL-3.0", _GPL.format("General Public License", _LATER.format(3), "General Public License")),
    ("GPL-3.0", _GPL.format("General Public License", ", version 3 of the License.", "General Public License")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", _GPL.format("General Public License", _LATER.format(2), "General Public License")),
    ("GPL-2.0", _GPL.format("General Public License", _ONLY.format(2), "General Public License")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", _GPL.format(_LESSER, _LATER.format(3), _LESSER)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", _GPL.format(_LESSER, _LATER.format("2.1"), _LESSER)),
    ("LGPL-2.1", _GPL.format(_LESSER, _LATER.format("2.1"), _LESSER).replace("This program is free software: ", "This library is free software; ").replace("This program is distributed", "This library is distributed")),
    ("AGPL-3.0", _GPL.format(_AFFERO, _LATER.format(3), _AFFERO)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-3-Clause", _BSD + " " + _BSD_NAMES.format("the copyright holder nor the names of its contributors") + " " + _NO_WARRANTY),
    ("BSD-3-Clause", _BSD + " " + _BSD_NAMES.format("the author nor the names of its contributors") + " " + _NO_WARRANTY),
    ("BSD-3-Clause", _BSD + " " + _BSD_NAMES.format("the University nor the names of its contributors")),
    ("BSD-3-Clause", _BSD + " " + _BSD_NAMES.format("the copyright holder nor the names of its contributors")),
    ("BSD-2-Clause", _BSD),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("CC-BY-4.0", "Licensed under CC-BY-4.0"),
    ("CC-BY-4.0", _CC.format("Attribution")),
    ("CC-BY-SA-4.0", "Licensed under CC-BY-SA-4.0"),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike")),
    ("CC-BY-NC-4.0", "Licensed under CC-BY-NC-4.0"),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial")),
    ("All-Rights-Reserved", "All rights reserved"),
    ("All-Rights-Reserved", "Copyright reserved"),
]
# Identifiers of the public list of licences, as in one-line tags.
TAGS = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "ISC": "ISC", "0BSD": "0BSD", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "MPL-2.0": "MPL-2.0", "EPL-2.0": "EPL-2.0", "Unlicense": "Unlicense", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "CC0-1.0": "CC0-1.0"}
#: Only texts with one of these words are looked at; the texts of all rules have one.
MARKS = "(?i)licen[sc]e|copyright|warrant|redistribut|permission|public domain|all[^A-Za-z0-9]+rights[^A-Za-z0-9]+reserved"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A tag's colon ends no sentence.
TAG = r"spdx-license-identifier:"
_END = r"[.;:!?]+[ \t\r\n\f]+|[ \t\r\n\f]+\([0-9a-z]{1,2}\)[ \t]+"
BY_LINE, BY_BREAK = _END + r"|\n", _END + r"|\n[^\p{L}\p{N}\n]*\n"
#: Sentences of one or two words of a rule's text say nothing.
LEAST_WORDS = 3


def _sentences(text: str) -> list[str]:
    """The normalised sentences of a licence text, cut as BY_BREAK cuts."""
    parts = re.split(_END + r"|\n[^a-zA-Z0-9\n]*\n", text.lower())
    normal = [re.sub("[^a-z0-9]+", " ", p).strip() for p in parts]
    return [s for s in normal if len(s.split()) >= LEAST_WORDS] or [s for s in normal if s]


def build(texts: list[tuple[str, str]], tags: dict[str, str]) -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Known sentences with identifiers (licence.number of the first text that has
    one), and rules (licence, identifiers in order), in order of the licences."""
    known: dict[str, str] = {}
    rules: list[tuple[str, list[str]]] = []
    for name, text in texts:
        ids = []
        for s in _sentences(text):
            number = 1 + sum(v.rpartition(".")[0] == name.lower() for v in known.values())
            ids.append(known.setdefault(s, f"{name.lower()}.{number}"))
        rules.append((name, ids))
    for tag, name in tags.items():
        sentence = re.sub("[^a-z0-9]+", " ", f"spdx-license-identifier {tag}".lower()).strip()
        known[sentence] = f"tag.{tag}".lower()
        rules.append((name, [known[sentence]]))
    return known, rules


SENTENCES, RULES = build(TEXTS, TAGS)


def _known(boundary: str, sentences: dict[str, str]) -> Column:
    """The identifiers of a text's known sentences, in order, each in commas.

    A hashed set finds the known sentences, and only those are looked up.
    """
    lookup = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    normal = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    text = F.replace(F.translate("text", UPPER, LOWER), F.lit(TAG), F.lit(TAG[:-1] + " "))
    known = F.filter(F.transform(F.split(text, boundary), normal), lambda s: s.isin(*sentences))
    return F.concat(F.lit(","), F.concat_ws(",", F.transform(known, lambda s: F.try_element_at(lookup, s))), F.lit(","))


def _matches(sequence: str, ids: list[str]) -> Column:
    """Whether a rule's identifiers stand in a sequence in order, others between them or not.

    Each one is searched from the end of the one before, where it comes first; a null
    place finds nothing. The work is linear in the sequence, without recursion.
    """
    places = F.array(*[F.lit(f",{i},") for i in ids])
    at = lambda place, i: F.call_function("locate", i, F.col(sequence), place)
    return F.aggregate(places, F.lit(1), lambda place, i: F.nullif(at(place, i), F.lit(0)) + F.length(i) - 1).isNotNull()


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, marks: str = MARKS) -> DataFrame:
    """doc_id, line_ids, stop_ids (identifiers by line and by stop), licenses, n_licenses.

    Licences are comma-joined in the order of the rules, each once. `marks` is a
    pattern that a sentence of every rule matches; other texts are spared the work.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    marked = F.coalesce(F.col("text").rlike(marks), F.lit(False))
    found = docs.select("doc_id", *[F.when(marked, _known(cut, sentences)).otherwise(F.lit(",,")).alias(name) for name, cut in (("by_line", BY_LINE), ("by_stop", BY_BREAK))])
    names = list(dict.fromkeys(name for name, _ in rules))
    hit = {name: reduce(lambda a, b: a | b, [_matches(c, ids) for n, ids in rules if n == name for c in ("by_line", "by_stop")]) for name in names}
    some = (F.col("by_line") != ",,") | (F.col("by_stop") != ",,")
    licenses = F.when(some, F.filter(F.array(*[F.when(hit[n], F.lit(n)) for n in names]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    trim = lambda c: F.expr(f"trim(BOTH ',' FROM {c})")
    return found.select("doc_id", trim("by_line").alias("line_ids"), trim("by_stop").alias("stop_ids"), F.concat_ws(",", licenses).alias("licenses"), F.size(licenses).cast("long").alias("n_licenses"))


def op9_licenses(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The whole tables of sentences and rules, as relations; a rule is a pattern there."""
    pattern = lambda ids: "," + ",(?:[^,]+,)*".join(i.replace(".", "[.]") for i in ids) + ","
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    names = list(dict.fromkeys(name for name, _ in RULES))
    rules = ", ".join(f"({names.index(n)}, '{n}', '{pattern(ids)}')" for n, ids in RULES)
    cut = lambda boundary: f"string_split_regex(replace(translate(text, '{UPPER}', '{LOWER}'), '{TAG}', '{TAG[:-1]} '), '{boundary}')"
    return f"""WITH known(sentence, id) AS (VALUES {known}), rules(place, name, pattern) AS (VALUES {rules}),
m AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '{MARKS}')),
c AS (SELECT doc_id, 'l' AS kind, {cut(BY_LINE)} AS parts FROM m UNION ALL SELECT doc_id, 's', {cut(BY_BREAK)} FROM m),
p AS (SELECT doc_id, kind, unnest(parts) AS part, unnest(generate_series(1, len(parts))) AS i FROM c),
k AS (SELECT doc_id, kind, string_agg(id, ',' ORDER BY i) AS ids FROM p JOIN known ON trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY ALL),
h AS (SELECT DISTINCT doc_id, place, name FROM k JOIN rules ON regexp_matches(',' || ids || ',', pattern)),
f AS (SELECT doc_id, string_agg(name, ',' ORDER BY place) AS licenses, COUNT(*) AS n FROM h GROUP BY doc_id)
SELECT d.doc_id, COALESCE(l.ids, '') AS line_ids, COALESCE(s.ids, '') AS stop_ids, COALESCE(f.licenses, '') AS licenses, COALESCE(f.n, 0) AS n_licenses
FROM documents d LEFT JOIN k l ON l.doc_id = d.doc_id AND l.kind = 'l' LEFT JOIN k s ON s.doc_id = d.doc_id AND s.kind = 's' LEFT JOIN f ON f.doc_id = d.doc_id"""


ORACLE = {"op9_licenses": _sql()}
QUERIES = {"op9_licenses": op9_licenses}
