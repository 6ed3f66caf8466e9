"""Licence recognition by sentence rules, with DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences as they are written, each with its identifier.
SENTENCES = {
    1: "Released under the MIT License",
    2: "Licensed under the MIT License",
    3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    4: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    5: "Licensed under the Apache License, Version 2.0",
    6: "You may obtain a copy of the License at",
    7: "You may not use this file except in compliance with the License",
    8: "This work is licensed under the GNU General Public License, version 3",
    9: "This program is free software",
    10: "You can redistribute it and/or modify it under the terms of the GNU General Public License",
    11: "You should have received a copy of the GNU General Public License along with this program",
    12: "Licensed under CC BY-NC 4.0",
    13: "Licensed under CC BY 4.0",
    14: "Licensed under CC BY-SA 4.0",
    15: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    16: "Redistribution and use in source and binary forms, with or without modification, are permitted",
    17: "Redistributions of source code must retain the above copyright notice",
    18: "Redistributions in binary form must reproduce the above copyright notice",
    19: "Neither the name of the copyright holder nor the names of its contributors may be used",
    20: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    21: "All rights reserved",
    22: "This is free and unencumbered software released into the public domain",
}
# Fixed values: (licence, sentence identifiers in order); the first rule that matches at a place wins.
RULES = [
    ("MIT", (3, 4)), ("MIT", (1,)), ("MIT", (2,)), ("MIT", (3,)),
    ("Apache-2.0", (5, 7, 6)), ("Apache-2.0", (5,)),
    ("GPL-3.0", (9, 10, 11)), ("GPL-3.0", (8,)), ("GPL", (10,)),
    ("BSD-3-Clause", (16, 17, 18, 19)), ("BSD-2-Clause", (16, 17, 18)),
    ("CC-BY-NC-4.0", (12,)), ("CC-BY-SA-4.0", (14,)), ("CC-BY-4.0", (13,)), ("CC-BY-4.0", (15,)),
    ("MPL-2.0", (20,)), ("Unlicense", (22,)), ("Proprietary", (21,)),
]
# Further forms of those sentences, whole as the licences have them, each with the same identifier.
FORMS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": 3,
    "Licensed under the Apache License, Version 2.0 (the License)": 5,
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": 16,
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": 17,
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": 18,
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 19,
}
# Sentences that tell the versions of a licence apart, and their rules, which come before the others.
MORE_SENTENCES = {
    23: "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    24: "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    25: "either version 2 of the License, or (at your option) any later version",
    26: "either version 3 of the License, or (at your option) any later version",
    27: "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
}
# GNU licences of other kinds, ISC and SPDX tags; a semicolon or a comma may stand before the version.
_GNU = "You can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation"
_LATER = "either version {} of the License, or (at your option) any later version"
MORE_SENTENCES |= {
    28: _GNU.format("Lesser"),
    29: _GNU.format("Lesser") + ", " + _LATER.format("3"),
    30: _GNU.format("Lesser") + ", " + _LATER.format("2.1"),
    31: _LATER.format("2.1"),
    32: _GNU.format("Affero") + ", " + _LATER.format("3"),
    33: _GNU.format("Affero"),
    34: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    35: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}
_SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0"]
MORE_SENTENCES |= {40 + i: f"SPDX-License-Identifier: {tag}" for i, tag in enumerate(_SPDX)}
# Headings of full texts and notices of further licences.
MORE_SENTENCES |= {
    60: "Apache License Version 2.0, January 2004",
    61: "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    62: "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    63: "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    64: "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    65: "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    66: "Mozilla Public License Version 2.0",
    67: "Distributed under the Boost Software License, Version 1.0",
    68: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    69: "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    70: "Licensed under CC0 1.0",
    71: "CC0 1.0 Universal",
    72: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    73: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    74: "Eclipse Public License - v 2.0",
}
MORE_RULES = [
    ("Apache-2.0", (60,)), ("GPL-3.0", (61,)), ("GPL-2.0", (62,)), ("LGPL-3.0", (63,)), ("LGPL-2.1", (64,)), ("AGPL-3.0", (65,)), ("MPL-2.0", (66,)), ("BSL-1.0", (67,)), ("Zlib", (68,)), ("WTFPL", (69,)),
    ("CC0-1.0", (70,)), ("CC0-1.0", (71,)), ("EPL-2.0", (72,)), ("EPL-2.0", (73,)), ("EPL-2.0", (74,)),
    ("GPL-3.0", (9, 23)), ("GPL-3.0", (23,)), ("GPL-3.0", (24, 26)), ("GPL-2.0", (24, 25)), ("GPL-2.0", (27,)), ("GPL", (24,)),
    ("LGPL-3.0", (29,)), ("LGPL-2.1", (30,)), ("LGPL-3.0", (28, 26)), ("LGPL-2.1", (28, 31)), ("LGPL", (28,)), ("AGPL-3.0", (32,)), ("AGPL-3.0", (33, 26)), ("AGPL", (33,)), ("ISC", (34,)), ("ISC", (35,)),
] + [(re.sub("-(only|or-later)$", "", tag), (40 + i,)) for i, tag in enumerate(_SPDX)]
#: Licences that count only where no other is found.
LAST = ["Proprietary"]
#: A sentence of the scan ends at . ! ? ; : before white space, or at a line without a letter or digit.
END = r"[.!?;:](?=[\x20\x09\n])|\n[^a-z0-9\n]*(?=\n)"
#: The holder's name in the third clause of BSD, of any number of words.
HOLDER = r"(neither[ \n]+the[ \n]+name[ \n]+of[ \n]+)[a-z0-9X \n]+?[ X\n](nor[ \n]+the[ \n]+names[ \n]+of[ \n]+its[ \n]+contributors)"


def normal_sentence(sentence: Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def known_sentences(sentences: dict[int, str]) -> dict[str, int]:
    """Identifier by normalised sentence; of sentences that are equal when normalised the smallest counts."""
    known: dict[str, int] = {}
    for i, s in sorted(sentences.items()):
        known.setdefault(re.sub("[^a-z0-9]+", " ", s.lower()).strip(), i)
    return known


def marked(text: Column) -> Column:
    """Lower case with X where a sentence ends, the ends of other lines, and one blank for all other than a-z and 0-9."""
    lines = F.translate(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    plain = F.regexp_replace(F.regexp_replace(lines, END, "X"), "[^a-z0-9X\n]+", " ")
    return F.regexp_replace(plain, HOLDER, "$1the copyright holder $2")


def tables(sentences: dict[int, str] | None = None) -> tuple[dict[str, int], dict[int, int]]:
    """Identifier by normalised sentence, all forms included, and the identifier that each given one counts as."""
    forms = FORMS if sentences is None else {}
    given = sentences or SENTENCES | MORE_SENTENCES
    known = {re.sub("[^a-z0-9]+", " ", s.lower()).strip(): i for s, i in forms.items()} | known_sentences(given)
    return known, {i: known[next(iter(known_sentences({i: s})))] for i, s in given.items()}


def heads(known: dict[str, int]) -> list[str]:
    """The first two words of the sentences (all of one that is a single word)."""
    return sorted({" ".join(s.split(" ")[:2]) for s in known})


def scan_licenses(documents: DataFrame, sentences: dict[int, str] | None = None, rules: list[tuple[str, tuple[int, ...]]] | None = None) -> DataFrame:
    """doc_id, sentence_ids, licenses (arrays) of every document.

    A text is split in sentences, and these in lines; each is normalised. From every place whose first two words begin
    a known sentence, one line or sentence after another is joined, and what results is looked up among the normalised
    sentences: the longest that is known counts, and what it covers begins no other. So a sentence begins and ends
    where a sentence or a line does, and a wrapped notice, also behind comment marks, is found as if it were on one
    line. A lookup is one hash, however many sentences there are. The identifiers found, in text order, are a sequence.
    Each rule is looked for as a run of the sequence; in the order of the rules, a match takes its sentences away from
    later rules. ``licenses`` is the sorted set of licences found; those of LAST count only where there is no other.
    All of it is one projection of the scan: nothing is shuffled, so neither a frequent line nor a long text matters.
    The tables of sentences and rules are parameters and part of the plan, meant for hundreds of entries.

    Null and empty texts have no sentence and no licence: their arrays are empty, as without a hit. Rows that repeat
    a doc_id (null included) are scanned one by one. An empty table gives no rows; columns other than doc_id and text
    are ignored.
    """
    (known, ids), rules = tables(sentences), rules or MORE_RULES + RULES
    longest = max(len(s.split(" ")) for s in known)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    rows = documents.select("doc_id", F.filter(F.transform(F.split(marked(F.col("text")), "[X\n]"), lambda u: F.trim(u)), lambda u: u != "").alias("_units"))
    # a line has a word at least, so no known sentence is longer than this
    at = F.sequence(F.lit(1), F.size("_units"))
    begins = lambda i: F.substring_index(F.array_join(F.slice("_units", i, F.lit(2)), " "), " ", 2).isin(heads(known))
    rows = rows.withColumn("_starts", F.when(F.size("_units") > 0, F.filter(at, begins)).otherwise(F.slice(F.array(F.lit(0)), 1, 0)))
    joined = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_units") - i + 1)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("_units", i, n), " ").alias("s")))
    # texts are told by their hashes first: only what is known reaches the map
    hashes = [_xxhash64(s) for s in known]
    looked = lambda i: F.transform(F.filter(joined(i), lambda c: F.xxhash64(c["s"]).isin(hashes)), lambda c: F.struct(c["n"].alias("n"), F.try_element_at(table, c["s"]).alias("id")))
    best = lambda i: F.array_max(F.filter(looked(i), lambda c: c["id"].isNotNull()))
    hits = F.filter(F.transform("_starts", lambda i: F.struct(i.alias("i"), best(i).alias("c"))), lambda h: h["c"].isNotNull())
    none = F.struct(F.lit(0).alias("end"), F.slice(F.array(F.lit(0)), 1, 0).alias("ids"))
    taken = lambda done, h: F.when(h["i"] > done["end"], F.struct((h["i"] + h["c"]["n"] - 1).alias("end"), F.array_append(done["ids"], h["c"]["id"]).alias("ids"))).otherwise(done)
    rows = rows.select("doc_id", F.aggregate(hits, none, taken, lambda done: done["ids"]).alias("sentence_ids"))
    line = F.concat(F.lit(","), F.array_join(F.transform("sentence_ids", lambda x: x.cast("string")), ",,"), F.lit(","))
    # one fold over the rules; what a rule has taken is no sentence any more
    wanted = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("".join(f",{ids[i]}," for i in run)).alias("run")) for licence, run in rules])
    start = F.struct(line.alias("line"), F.expr("cast(array() as array<string>)").alias("found"))
    step = lambda done, r: F.when(F.contains(done["line"], r["run"]), F.struct(F.replace(done["line"], r["run"], F.lit(",x,")).alias("line"), F.array_append(done["found"], r["licence"]).alias("found"))).otherwise(done)
    rows = rows.withColumn("_found", F.when(F.size("sentence_ids") > 0, F.aggregate(wanted, start, step, lambda done: done["found"])).otherwise(F.expr("cast(array() as array<string>)")))
    every = F.array_sort(F.array_distinct("_found"))
    first = F.array_except(every, F.array(*[F.lit(x) for x in LAST]))
    return rows.select("doc_id", "sentence_ids", F.when(F.size(first) > 0, first).otherwise(every).alias("licenses"))


def _xxhash64(text: str) -> int:
    """Spark's hash of a text, as a signed number."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def _oracle() -> str:
    """The same tables and rules as DuckDB SQL over ``documents``; arrays as text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = MORE_RULES + RULES
    known, ids = tables()
    longest = max(len(s.split(" ")) for s in known)
    steps, hits, last = [], [], "l"
    for n, (licence, run) in enumerate(rules):
        wanted = quoted("".join(f",{ids[i]}," for i in run))
        steps.append(f"r{n} AS (SELECT *, CASE WHEN contains(line_{n}, {wanted}) THEN {quoted(licence)} END AS hit_{n}, replace(line_{n}, {wanted}, ',x,') AS line_{n + 1} FROM {last})")
        hits.append(f"hit_{n}")
        last = f"r{n}"
    return f"""
WITH k(s, id) AS (VALUES {", ".join(f"({quoted(s)}, {i})" for s, i in known.items())}
), t AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_replace(regexp_replace(translate(replace(lower(coalesce(text, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[.!?;:]([\\x20\\x09\\n])', 'X\\1', 'g'), '\\n([^a-z0-9\\n]*\\n)+', 'X' || chr(10), 'g') AS t FROM documents
), p AS (
  SELECT rid, doc_id, regexp_replace(regexp_replace(t, '[^a-z0-9X\\n]+', ' ', 'g'), {quoted(HOLDER)}, '\\1the copyright holder \\2', 'g') AS t FROM t
), u AS (
  SELECT rid, doc_id, list_filter(list_transform(string_split_regex(t, '[X\\n]'), lambda x: trim(x)), lambda x: x <> '') AS units FROM p
), s AS (
  SELECT rid, units, unnest(list_filter(range(1, len(units) + 1), lambda i: array_to_string(string_split(array_to_string(units[i:i + 1], ' '), ' ')[1:2], ' ') IN ({", ".join(map(quoted, heads(known)))}))) AS i FROM u
), c AS (
  SELECT rid, i, unnest(list_transform(range(1, least({longest}, len(units) - i + 1) + 1), lambda n: {{'n': n, 's': array_to_string(units[i:i + n - 1], ' ')}})) AS c FROM s
), b AS (
  SELECT rid, i, max(c.n) AS n, arg_max(id, c.n) AS id FROM c JOIN k ON k.s = c.s GROUP BY rid, i
), h AS (
  SELECT rid, list({{'i': i, 'n': n, 'id': id}} ORDER BY i) AS hits FROM b GROUP BY rid
), f AS (
  SELECT rid, list_reduce(list_prepend({{'e': CAST(0 AS BIGINT), 'ids': CAST([] AS BIGINT[]), 'i': CAST(0 AS BIGINT)}}, list_transform(hits, lambda x: {{'e': x.i + x.n - 1, 'ids': [CAST(x.id AS BIGINT)], 'i': x.i}})),
    lambda d, x: CASE WHEN x.i > d.e THEN {{'e': x.e, 'ids': list_concat(d.ids, x.ids), 'i': x.i}} ELSE d END).ids AS ids FROM h
), l AS (
  SELECT doc_id, array_to_string(coalesce(ids, []), ',') AS sentence_ids, ',' || array_to_string(coalesce(ids, []), ',,') || ',' AS line_0 FROM u LEFT JOIN f USING (rid)
), {", ".join(steps)}, e AS (
  SELECT doc_id, sentence_ids, list_sort(list_distinct(list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL))) AS found FROM {last}
), g AS (
  SELECT *, list_filter(found, lambda x: x NOT IN ({", ".join(map(quoted, LAST))})) AS first FROM e
)
SELECT doc_id, sentence_ids, array_to_string(CASE WHEN len(first) > 0 THEN first ELSE found END, ',') AS licenses FROM g
"""


OP5_SQL = _oracle()
