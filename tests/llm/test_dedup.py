"""Exact and near dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from llm_rows import LONG, documents, with_clashes

from quillmart.llm import exact_dedup, near_dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        keep = members[0][0]
        out += [(i, keep, len(members), n == 0, hashlib.sha256(norm.encode()).hexdigest()) for n, (i, _) in enumerate(members)]
    return sorted(out, key=repr)


def check_exact(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = exact_dedup.exact_dedup(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_exact(rows)


def test_exact_dedup_on_the_small_table(small_docs):
    check_exact(small_docs)


def test_exact_dedup_edges(edge, no_documents):
    check_exact(with_clashes(edge))
    assert exact_dedup.exact_dedup(no_documents).collect() == []


def test_exact_dedup_deals_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_COPIES", 8)
    monkeypatch.setattr(exact_dedup, "MOST_HOT", 50)
    rnd = random.Random(1)
    rows = [(i, "same" + " " * rnd.randrange(4) + "text", None, None) for i in range(300)] + [(i, "", None, None) for i in range(300, 400)] + [(i, f"own {i}", None, None) for i in range(400, 700)]
    rnd.shuffle(rows)
    check_exact(documents(spark, rows))


def test_drop_copies_keeps_columns_and_one_row_of_a_group(edge):
    wide = with_clashes(edge)
    kept = exact_dedup.drop_copies(wide)
    assert kept.columns == wide.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # ids 2 and 2 are one repeated row; 3, 4 and the null row hold the same empty text as the longer 5
    assert sorted(i for i in ids if i is not None) == [2, 5, 6, 7, 8, 9, 10, 11] and ids.count(None) == 1


@pytest.mark.parametrize("owner", [5, None])
def test_many_equal_rows_of_one_id_leave_one(spark, owner):
    rows = [(owner, "same text", None, None)] * 10_000 + [(i, f"own {i}", None, None) for i in range(100, 200)]
    df = documents(spark, rows).repartition(6)
    found = exact_dedup.exact_dedup(df).where("group_size > 1").collect()
    assert len(found) == 10_000 and sum(r["kept"] for r in found) == 1 and {r["keep_id"] for r in found} == {owner}
    assert exact_dedup.drop_copies(df).count() == 101


def test_a_text_dropped_in_one_row_goes_though_its_id_stays(spark):
    df = documents(spark, [(1, "own text", None, None), (1, "shared", None, None), (0, "shared", None, None)])
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(df).collect()) == [(0, "shared"), (1, "own text")]


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows):
    """One row per document; documents of one id are alike."""
    sets = [brute_shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and rows[x][0] is not None and rows[y][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((top(rows[x][0]), top(rows[y][0])))
                root[q] = p
    return sorted(((i, len(s), None if i is None else top(i), True if i is None else top(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def check_near(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = near_dedup.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_near(rows)


def test_near_dedup_on_the_small_table(small_docs):
    check_near(small_docs)


def test_near_dedup_edges(edge, no_documents):
    check_near(with_clashes(edge))
    assert near_dedup.near_duplicates(no_documents).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_groups_chains_and_shared_passages(spark, seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    rows, i = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(6):  # chains: each link is one edit from the last
        text = [word() for _ in range(80)]
        for _ in range(12):
            rows.append((i := i + 1, " ".join(text), None, None))
            text[rnd.randrange(80)] = word()
    for _ in range(40):  # a passage that many hold, in documents of their own
        rows.append((i := i + 1, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(10)]), None, None))
    base = [word() for _ in range(100)]
    for _ in range(60):  # one large group
        own = list(base)
        own[rnd.randrange(100)] = word()
        rows.append((i := i + 1, " ".join(own), None, None))
    rows += [(i + k, "copy of one and the same text here", None, None) for k in range(1, 31)]
    rnd.shuffle(rows)
    check_near(documents(spark, rows))


def test_near_dedup_links_every_text_of_a_repeated_id(spark):
    rnd = random.Random(8)
    text = lambda: [f"w{rnd.randrange(4000)}" for _ in range(60)]
    a, b, c = text(), text(), text()
    near_b = [*b[:30], "changed", *b[31:]]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, " ".join(near_b)), (7, " ".join([*a, "more"])), (9, " ".join(c)), (8, " ".join(c)), (8, " ".join(near_b)), (12, "alone in the world of texts")]
    rows += [(1, " ".join(a))] * 5 + [(1, " ".join(text())) for _ in range(200)] + [(20 + i, " ".join(near_b)) for i in range(90)]
    rnd.shuffle(rows)
    df = documents(spark, [(i, t, None, None) for i, t in rows])
    check_near(df)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got[5] == got[7] == got[8] == got[9] == 1 and got[12] == 12
    kept = [r["doc_id"] for r in near_dedup.drop_near_copies(df).collect()]
    assert sorted(kept) == [1, 12]


def test_near_dedup_deals_large_lists(spark, monkeypatch):
    """A passage that makes up most of many documents which are no near copies of each other, and one large group."""
    from quillmart.operators import hot

    monkeypatch.setattr(hot, "LEAST_ROWS", 8)
    monkeypatch.setattr(near_dedup, "CELL_ROWS", 16)
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(90000)}"
    passage, base = [word() for _ in range(200)], [word() for _ in range(80)]
    rows = [" ".join(passage + [word() for _ in range(38)]) for _ in range(60)]
    rows += [" ".join(passage + rows[k].split()[200:220] + [word() for _ in range(12)]) for k in range(30)]
    rows += [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(80)] + ["one and the same text of seven words"] * 100
    rnd.shuffle(rows)
    check_near(documents(spark, [(i, t, None, None) for i, t in enumerate(rows)]))


def test_words_are_hashed_as_white_space_parts_them(monkeypatch):
    rnd = random.Random(4)
    texts = ["", " \t\n", "a", "A b\x0bB  a\x1cb", LONG, "x" * 3000 + " y " + "x" * 3000, *("".join(rnd.choice("abAB \n\u00fc\u2003\x00") for _ in range(90)) for _ in range(80))]
    of, seen = {}, []
    for size in (near_dedup.HASHED_BYTES, 40):
        monkeypatch.setattr(near_dedup, "HASHED_BYTES", size)
        for t in texts:
            words, hashes = t.encode().lower().split(), near_dedup._word_hashes(t.encode()).tolist()
            assert len(words) == len(hashes)
            seen += zip(words, hashes, strict=True)
    of = dict(seen)
    assert all(of[w] == h for w, h in seen) and len({*of.values()}) == len(of) > 500


def test_near_dedup_judges_the_pairs_of_a_list_in_its_cell(spark, monkeypatch):
    """Lists of many that are no near copies: pairs and tables are compared in the task, not by a join."""
    monkeypatch.setattr(near_dedup, "COMPARED", 7)
    rnd = random.Random(6)
    sets = [np.array(sorted(rnd.sample(range(35), 30)), np.uint64) for _ in range(50)]
    rows, want = [], set()
    for token, members in ((1, range(25)), (2, range(20, 50)), (3, [4])):
        for i in members:
            row = (token, 0, 0, i, i // 3, len(sets[i]), len(sets[i]) - i % 2 * 4, near_dedup.parities(sets[i]).tolist(), 2)
            rows += [(*row, False)] + [(*row, True)] * (i // 3 != 2)
        for i in members:
            for j in members:
                n, s = len(sets[i]) + len(sets[j]), min(30 - i % 2 * 4, 30 - j % 2 * 4)
                if i < j and i // 3 != j // 3 and 100 * s >= 75 * (n - s) and 7 * len({*sets[i].tolist()} ^ {*sets[j].tolist()}) <= n:
                    want.add((i, j, n))
    df = spark.createDataFrame(rows, "token long, row int, column int, cls long, label long, n long, s long, bits array<long>, most long, left boolean")
    cells = df.repartition(3, "token", "row", "column").sortWithinPartitions("token", "row", "column")
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = [tuple(r) for r in cells.mapInArrow(near_dedup._met, "a long, b long, n long").collect()]
        assert {*got} == want and 0 < len(want) < 400
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plans = []
    monkeypatch.setattr(near_dedup, "_confirm", lambda pairs, *rest, f=near_dedup._confirm: (plans.append(pairs._jdf.queryExecution().toString()), f(pairs, *rest))[1])
    near_dedup.near_duplicates(spark.createDataFrame([(i, f"t {i} " + "a b c d e f g " * 3) for i in range(9)], "doc_id long, text string"))
    assert len(plans) == 2 and not any("bit_count" in x for x in plans)


def test_drop_near_copies_keeps_columns(edge):
    wide = with_clashes(edge)
    kept = near_dedup.drop_near_copies(wide)
    assert kept.columns == wide.columns
    # 1, 2 and 2 are near copies; rows without a word (3, 4, 5, one without an id) and without an id all stay
    assert sorted(i for (i,) in kept.select("doc_id").collect() if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 11]
    assert kept.where("doc_id IS NULL").count() == 2
