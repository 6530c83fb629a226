"""Licence recognition with SQL functions only.

Method: sentence rules. A text is normalised as a whole (lower case, everything but letters and digits as space), so that
line ends, comment marks, stops and URLs don't matter, and known licence sentences are looked up in it wherever they begin, the longest first;
a holder's name in a sentence is a gap of up to ``GAP_WORDS`` words. The sequence of identifiers found is then matched against ordered
rules, longest first: a licence is recognised where its sentences follow each other in the rule's order, with no
other known sentence between.

Plan: one scan without a shuffle and without Python. A text without any of the anchor words, one of which every known
sentence holds, is not normalised at all. Sentences and rules are literals of fixed size.

Defined results: null text counts as empty; a text without known sentences has empty lists; a sentence that belongs to a
longer recognised rule isn't reported again by a shorter one; repeated licences are listed each time in
``matches`` and once in ``licenses``; repeated rows are scanned alike; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import text_or_empty

# Sentences of well-known licences and notices by identifier, as published.
SENTENCES = {
    "apache-2-header": "Licensed under the Apache License, Version 2.0",
    "apache-2-compliance": "you may not use this file except in compliance with the License.",
    "apache-2-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-2-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-release": "Released under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-permit": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0.",
    "cc0": "This work is dedicated to the public domain under CC0 1.0.",
    "reserved": "All rights reserved.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl-3-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
    "gpl-2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "agpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "lgpl-3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "epl-2": "made available under the terms of the Eclipse Public License 2.0",
    "spdx-mit-0": "SPDX-License-Identifier: MIT-0",
    "spdx-gpl-2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl-2-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-agpl-3": "SPDX-License-Identifier: AGPL-3.0-only",
    "spdx-agpl-3-later": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "spdx-lgpl-2-later": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx-lgpl-3-later": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "spdx-bsd-2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-mpl-2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-zlib": "SPDX-License-Identifier: Zlib",
    "spdx-boost": "SPDX-License-Identifier: BSL-1.0",
    "spdx-epl-2": "SPDX-License-Identifier: EPL-2.0",
    "spdx-unlicense": "SPDX-License-Identifier: Unlicense",
    "spdx-cc0": "SPDX-License-Identifier: CC0-1.0",
}
# Longer forms of known sentences, as their licences' published notices have them.
ALSO = {
    'Licensed under the Apache License, Version 2.0 (the "License");': "apache-2-header",
    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0": "apache-2-obtain",
    "Neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-endorse",
}
#: Words between two phrases that stand for the holder's name: (before, after, what the known sentence has there).
GAPS = [("Neither the name of", "nor the names of", "the copyright holder"), ("Neither the name of", "nor the name of", "the copyright holder")]
GAP_WORDS = 12
# Licences by the ordered identifiers of their sentences.
RULES = {
    "Apache-2.0 notice": ["apache-2-header", "apache-2-compliance", "apache-2-obtain", "apache-2-as-is", "apache-2-limits"],
    "MIT text": ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"],
    "BSD-3-Clause text": ["bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse"],
    "BSD-2-Clause text": ["bsd-permit", "bsd-source", "bsd-binary"],
    "GPL-3.0-or-later notice": ["gpl-redistribute", "gpl-warranty", "gpl-details"],
    "GPL-2.0-or-later notice": ["gpl-2-redistribute", "gpl-warranty", "gpl-details"],
    "AGPL-3.0-or-later notice": ["agpl-redistribute", "gpl-warranty", "agpl-details"],
    "LGPL-3.0-or-later notice": ["lgpl-3-redistribute", "gpl-warranty", "lgpl-details"],
    "Zlib text": ["zlib-as-is", "zlib-grant"],
    "LGPL-2.1-or-later notice": ["lgpl-redistribute"],
    "Apache-2.0": ["apache-2-header"],
    "Apache-2.0 tag": ["spdx-apache"],
    "MIT": ["mit-release"],
    "MIT title": ["mit-title"],
    "MIT tag": ["spdx-mit"],
    "GPL-3.0": ["gpl-3-short"],
    "GPL-2.0": ["gpl-2-short"],
    "GPL-3.0 tag": ["spdx-gpl-3"],
    "GPL-3.0-or-later tag": ["spdx-gpl-3-later"],
    "BSD-3-Clause tag": ["spdx-bsd-3"],
    "MPL-2.0": ["mpl-2-header"],
    "ISC": ["isc-grant"],
    "Unlicense": ["unlicense"],
    "CC-BY-4.0": ["cc-by-4"],
    "CC-BY-SA-4.0": ["cc-by-sa-4"],
    "CC-BY-NC-4.0": ["cc-by-nc-4"],
    "CC-BY-ND-4.0": ["cc-by-nd-4"],
    "CC0-1.0": ["cc0"],
    "All rights reserved": ["reserved"],
    "BSL-1.0": ["boost"],
    "EPL-2.0": ["epl-2"],
    "MIT-0 tag": ["spdx-mit-0"],
    "GPL-2.0 tag": ["spdx-gpl-2"],
    "GPL-2.0-or-later tag": ["spdx-gpl-2-later"],
    "AGPL-3.0 tag": ["spdx-agpl-3"],
    "AGPL-3.0-or-later tag": ["spdx-agpl-3-later"],
    "LGPL-2.1-or-later tag": ["spdx-lgpl-2-later"],
    "LGPL-3.0-or-later tag": ["spdx-lgpl-3-later"],
    "BSD-2-Clause tag": ["spdx-bsd-2"],
    "MPL-2.0 tag": ["spdx-mpl-2"],
    "ISC tag": ["spdx-isc"],
    "Zlib tag": ["spdx-zlib"],
    "BSL-1.0 tag": ["spdx-boost"],
    "EPL-2.0 tag": ["spdx-epl-2"],
    "Unlicense tag": ["spdx-unlicense"],
    "CC0-1.0 tag": ["spdx-cc0"],
}
#: Every known sentence holds one of these.
ANCHOR = r"(?i)licen[sc]|copyright|permission|rights|warrant|redistribut|public[^\p{L}\p{N}]+domain|liable"
#: What isn't part of a word.
OTHER = r"[^\p{L}\p{N}]+"

_OTHER = re.compile(r"[^\w]+|_+")


def normalised(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def _spaced(words: str) -> str:
    """Words with a space on either side each, so that a match takes its own spaces with it."""
    return "  ".join(words.split())


def _gaps() -> list[tuple[str, str]]:
    """(pattern, replacement) that put the known sentence's words in place of a holder's name."""
    out = []
    for before, after, known in GAPS:
        a, b, k = (_spaced(normalised(x)) for x in (before, after, known))
        out.append((f" {a}  (?:[^ ]+  ){{1,{GAP_WORDS}}}?{b} ", f" {a}  {k}  {b} "))
    return out


def _known() -> dict[str, str]:
    """Sentence identifiers by the words of a sentence, the longest first."""
    spelt = {_spaced(normalised(v)): k for k, v in SENTENCES.items()} | {_spaced(normalised(v)): k for v, k in ALSO.items()}
    return dict(sorted(spelt.items(), key=lambda x: (-len(x[0]), x[0])))


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs`` (``doc_id``, ``text``).

    ``sentence_ids`` are the known sentences in text order, ``matches`` the rules recognised in that order, and
    ``licenses`` the distinct ones, sorted.
    """
    ids, known = list(SENTENCES), _known()
    assert all(re.search("(?i)licen[sc]|copyright|permission|rights|warrant|redistribut|public domain|liable", v) for v in SENTENCES.values())
    lookup = F.create_map([F.lit(x) for words, k in known.items() for x in (words, ids.index(k))])
    text = text_or_empty()
    line = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(F.lower(text), OTHER, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for pattern, words in _gaps():
        line = F.regexp_replace(line, pattern, words)
    told = F.regexp_extract_all(line, F.lit(f" ({'|'.join(known)}) "), 1)
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(ANCHOR), told).otherwise(F.array().cast("array<string>")).alias("__s"))
    found = split.select("doc_id", F.transform("__s", lambda s: F.try_element_at(lookup, s)).alias("__ids"))
    # Rules are matched on the sequence written as a string, longest first; each match leaves its number in its place.
    line = F.concat(F.lit(" "), F.array_join(F.transform("__ids", lambda x: F.concat(F.lit("s"), x.cast("string"))), "  "), F.lit(" "))
    names = list(RULES)
    for n, rule in sorted(enumerate(names), key=lambda x: -len(RULES[x[1]])):
        line = F.replace(line, F.lit(" " + "  ".join(f"s{ids.index(i)}" for i in RULES[rule]) + " "), F.lit(f" r{n} "))
    matched = F.transform(F.regexp_extract_all(line, F.lit(r"r(\d+)"), 1), lambda x: F.array(*map(F.lit, names))[x.cast("int")])
    sentence_ids = F.transform("__ids", lambda x: F.array(*map(F.lit, ids))[x])
    return found.select("doc_id", sentence_ids.alias("sentence_ids"), F.when(F.size("__ids") > 0, matched).otherwise(F.array().cast("array<string>")).alias("matches")).select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), "sentence_ids", "matches", F.array_sort(F.array_distinct("matches")).alias("licenses")
    )


def duckdb_sql() -> str:
    """The same scan of ``documents`` as one DuckDB statement, lists comma-joined."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]"
    ids, names, known = list(SENTENCES), list(RULES), _known()
    normal = f"concat(' ', replace(trim(regexp_replace(lower(t), {quoted(OTHER)}, ' ', 'g')), ' ', '  '), ' ')"
    for pattern, words in _gaps():
        normal = f"regexp_replace({normal}, {quoted(pattern)}, {quoted(words)}, 'g')"
    places = listed(ids), listed(known), listed(known.values())
    pattern = quoted(f" ({'|'.join(known)}) ")
    line = "concat(' ', array_to_string(list_transform(k, lambda x: concat('s', x)), '  '), ' ')"
    for n, rule in sorted(enumerate(names), key=lambda x: -len(RULES[x[1]])):
        line = f"replace({line}, {quoted(' ' + '  '.join(f's{ids.index(i) + 1}' for i in RULES[rule]) + ' ')}, ' r{n} ')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, CASE WHEN regexp_matches(t, {quoted(ANCHOR)}) THEN regexp_extract_all({normal}, {pattern}, 1) ELSE [] END AS s FROM d),
b AS (SELECT doc_id, list_transform(s, lambda x: list_position({places[0]}, ({places[2]})[list_position({places[1]}, x)])) AS k FROM a),
c AS (SELECT doc_id, k, CASE WHEN len(k) > 0 THEN list_transform(regexp_extract_all({line}, 'r(\\d+)', 1), lambda x: ({listed(names)})[CAST(x AS INTEGER) + 1]) ELSE [] END AS m FROM b)
SELECT doc_id, CAST(len(k) AS BIGINT) AS n_sentences, array_to_string(list_transform(k, lambda x: ({listed(ids)})[x]), ',') AS sentence_ids, array_to_string(m, ',') AS matches, array_to_string(list_sort(list_distinct(m)), ',') AS licenses FROM c"""
