"""The manifest against a plain tree built level by level, over blocks of several sizes."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from llm_rows import EDGE, documents, with_clashes

from quillmart.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def grow(nodes):
    """Levels of a tree from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + 16]) for k in range(0, len(last), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return out


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[3]].append((row[0], leaf(*row), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        sources[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {name: grow([x[1] for x in sources[name]]) for name in names}
    top = grow([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, (i, own, row) in enumerate(sources[name]):
            path = siblings(trees[name], at) + siblings(top, k)
            given = own
            if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and row[1] is not None:
                given = leaf(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]), *row[2:])
            for left, right in path:
                given = h(left, given, right)
            out.append((i, own, trees[name][-1][0], top[-1][0], h(*[x for pair in path for x in pair]), given, given == top[-1][0]))
    return sorted(out, key=repr)


def check(df, **also):
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = merkle.tampered_manifest(df, **also)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == brute(rows)
    return found


def test_small_table(small_docs):
    found = check(small_docs)
    assert 0 < sum(not r[-1] for r in found) < len(found) / 4


def test_edges(edge, no_documents):
    check(with_clashes(edge))
    assert merkle.tampered_manifest(no_documents).collect() == []


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_one_source(spark, n):
    check(documents(spark, [(i * 7 - 40, f"Text {i}", "en", "only") for i in range(n)]))


def test_a_hot_source_over_many_blocks(spark):
    """Blocks of 16 leaves, so a source of 4,500 is traversed in four rounds."""
    rows = [(i, f"Text {i % 90}", None, "hot") for i in range(4500)] + [(i, "Other", "de", f"s{i % 40}") for i in range(5000, 5300)] + [(None, "Null", "de", "hot")] * 20
    check(documents(spark, rows).repartition(7), levels=1)


def test_proofs_fold_to_the_root_and_need_every_sibling(small_docs):
    for r in merkle.merkle_manifest(small_docs).limit(20).collect():
        path = merkle.unpacked(r["proof"])
        assert merkle.fold(r["leaf"], path) == r["root"] and r["verified"]
        assert all(merkle.fold(r["leaf"], path[:k] + path[k + 1 :]) != r["root"] for k in range(len(path)))
