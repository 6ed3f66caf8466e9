"""Top-k search and licence scans."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import same_as_sql

from quillmart.llm import licenses, queries, topk


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert same_as_sql(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)


def brute_top(rows, every, k):
    """query_id, query_no, rank, vec_id, score; a query's own row is left out, other rows of its id are not."""
    usable = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], {}
    for q, v in sorted(set(usable)):
        if q % every:
            continue
        seen[q] = no = seen.get(q, 0) + 1
        others = list(usable)
        others.remove((q, v))
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in others if len(w) == len(v))
        out += [(q, no, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, score string, width string")


@pytest.mark.parametrize("pilot", [1, 40, 4096])
def test_topk_equals_brute_force_with_odd_vectors(spark, monkeypatch, pilot):
    for name, value in (("CANDIDATE_BLOCK", 16), ("QUERY_BLOCK", 3), ("TILE_QUERIES", 2), ("TILE_CANDIDATES", 7), ("GATHERED", 5), ("PILOT_ROWS", pilot)):
        monkeypatch.setattr(topk, name, value)
    import random

    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(24)]) for i in range(90)]
    rows += [(i, [0.5] * 24) for i in range(90, 120)]  # ties
    rows += [(200, None), (201, [None] + [0.1] * 23), (202, [float("nan")] * 24), (203, [float("inf")] + [0.0] * 23), (None, [0.2] * 24), (30, rows[30][1]), (50, [0.25] * 24)]
    rows += [(60, [1.0, 0.5]), (61, [0.5, 0.5]), (70, []), (71, [])]  # other lengths
    rows += [(80, [0.7] * 24)] * 20  # one row many times
    df = vectors(spark, [(i, v, None, "x", "x", "x") for i, v in rows])
    got = sorted(map(tuple, topk.search_queries(df, every=10, k=5).collect()))
    floats = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    assert got == brute_top(floats, 10, 5)


def test_topk_fewer_than_k_and_empty(spark):
    few = vectors(spark, [(0, [1.0, 0.0], 0, "", "", ""), (1, [0.5, 0.5], 0, "", "", "")])
    assert [tuple(r) for r in topk.search_queries(few).collect()] == [(0, 1, 1, 1, 512 * 1024)]
    assert topk.search_queries(vectors(spark, [])).collect() == []


def test_bounds_never_lie_below_the_product():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 70)) * np.geomspace(1, 9, 70), rng.normal(size=(50, 70))
    for basis in (topk.basis_of(a, 70), topk.basis_of(a[:0], 70)):
        assert len(basis.cuts) == len(topk.RESOLUTIONS)
        turned = [x if basis.rotation is None else x @ basis.rotation for x in (a, b)]
        for cuts in basis.cuts:
            assert (topk.summary(turned[0], cuts) @ topk.summary(turned[1], cuts).T + 1e-9 >= a @ b.T).all()


def clustered(rows, width=64):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(100, width))
    v = middle[rng.integers(0, 100, rows)] + 0.15 * rng.normal(size=(rows, width))
    return np.floor(1024 * v / np.linalg.norm(v, axis=1)[:, None])


def test_bounds_discard_nearly_all_of_clustered_vectors():
    v = clustered(20_000)
    ids, once = np.arange(len(v)), np.ones(len(v), np.int64)
    basis = topk.basis_of(v[:4096], 64)
    pilot = topk.Search(ids[::100], v[::100], np.full(200, -np.inf), 10, basis)
    pilot.see(ids[:4096], v[:4096], once[:4096])
    search = topk.Search(ids[::100], v[::100], pilot.floors, 10, basis)
    search.see(ids, v, once)
    assert search.alive[-1] < 0.02 * search.pairs
    scores = v[::100] @ v.T
    scores[np.arange(200), ids[::100]] = -1
    assert all((s == -np.sort(-row)[:10]).all() for (s, _), row in zip(search.best, scores, strict=True))


def test_a_full_block_stays_small():
    import subprocess
    import sys

    code = """
import numpy as np, resource
from quillmart.llm import topk
v = np.floor(1024 * np.random.default_rng(1).normal(size=(topk.CANDIDATE_BLOCK, 64)))
ids = np.arange(len(v))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
search = topk.Search(ids[: topk.QUERY_BLOCK], v[: topk.QUERY_BLOCK], np.full(topk.QUERY_BLOCK, -np.inf), 10, topk.basis_of(v[:512], 64))
search.see(ids, v, np.ones(len(v), np.int64))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(said.stdout) < 300


def test_license_rules_in_order_and_their_edges(spark, edge, no_documents):
    from llm_rows import documents, with_clashes

    texts = [
        "Intro.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. THE ABOVE copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "Licensed under the Apache License, Version 2.0; You may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp",
        "Licensed under CC BY 4.0\nLicensed under CC BY 4.0. Licensed under CC BY-SA 4.0",
        "You may obtain a copy of the License at home",
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert (got[0]["sentence_ids"], got[0]["licenses"]) == ([3, 4], ["MIT"])
    assert (got[1]["sentence_ids"], got[1]["licenses"]) == ([5, 7, 6], ["Apache-2.0"])
    assert got[2]["licenses"] == ["CC-BY-4.0", "CC-BY-SA-4.0"]
    assert (got[3]["sentence_ids"], got[3]["licenses"]) == ([], [])
    found = licenses.scan_licenses(with_clashes(edge))
    assert found.columns == ["doc_id", "sentence_ids", "licenses"]
    assert found.count() == edge.count()
    assert all(r["licenses"] == [] for r in found.collect())
    assert licenses.scan_licenses(no_documents).collect() == []


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
APACHE = """# Copyright 2020 Some One
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
"""
BSD_2 = """Copyright (c) 2020, Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD_3 = f"""{BSD_2}3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""


@pytest.mark.parametrize(
    ("text", "licence"),
    [
        (MIT, "MIT"),
        (MIT.replace("\n", "\r\n"), "MIT"),
        (APACHE, "Apache-2.0"),
        (BSD_2, "BSD-2-Clause"),
        (BSD_3, "BSD-3-Clause"),
        (BSD_3.replace("the copyright holder", "Some Inc."), "BSD-3-Clause"),
        (BSD_3.replace("the copyright holder", "The Regents of the University, " + "its many partners and " * 40 + "others"), "BSD-3-Clause"),
        (GPL_3, "GPL-3.0"),
        (GPL_3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"), "GPL-2.0"),
        (MPL, "MPL-2.0"),
        ("Some text. All rights\nreserved.", "Proprietary"),
    ],
)
def test_real_notices_as_they_are_wrapped(spark, text, licence):
    from llm_rows import documents

    for whole in (text, f"Some prose.\n\n{text}\nMore prose."):
        assert [r["licenses"] for r in licenses.scan_licenses(documents(spark, [(1, whole, None, None)])).collect()] == [[licence]]


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL = GPL_3.replace("GNU General Public License as", "GNU Affero General Public License as")
NOTICES = [MIT, APACHE, BSD_2, BSD_3, GPL_3, MPL, ISC, LGPL, AGPL, "// SPDX-License-Identifier: GPL-2.0-only\nint x;", "# SPDX-License-Identifier: Apache-2.0"]
EXPECTED = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "MPL-2.0", "ISC", "LGPL-2.1", "AGPL-3.0", "GPL-2.0", "Apache-2.0"]


def test_notices_wrapped_commented_and_on_one_line_in_both_engines(spark, tmp_path):
    from llm_rows import documents

    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "\n".join(f" * {x}" for x in t.split("\n")), lambda t: f"Prose first.\n\n{t}\n\nProse after it, and more"]
    joined = lambda t: "\n\n".join(" ".join(x.split("\n")) for x in t.split("\n\n"))
    texts = [form(t) for t in NOTICES for form in forms] + [joined(t) for t in NOTICES if not t.startswith(("#", "/"))]
    wanted = [x for x in EXPECTED for _ in forms] + [x for t, x in zip(NOTICES, EXPECTED, strict=True) if not t.startswith(("#", "/"))]
    texts += ["All rights reserved", "no licence here", "You may obtain a copy of the License at\n\n\n \nhttp", None, ""]
    wanted += ["Proprietary", "", "", "", ""]
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op5_licenses(spark, str(tmp_path))
    assert [r["licenses"] for r in found.orderBy("doc_id").collect()] == wanted
    same_as_sql(found, licenses.OP5_SQL, str(tmp_path))


def test_every_sentence_of_the_table_is_found_alone(spark):
    from llm_rows import documents

    table = licenses.SENTENCES | licenses.MORE_SENTENCES
    rows = [(i, s, None, None) for i, s in table.items()] + [(1000 + n, s + ".", None, None) for n, s in enumerate(licenses.FORMS)]
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert all(got[i] == [i] for i in table) and all(got[1000 + n] == [i] for n, i in enumerate(licenses.FORMS.values()))
    assert {i for _, run in licenses.RULES + licenses.MORE_RULES for i in run} <= set(table)
