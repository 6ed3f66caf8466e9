"""Component lists matched in order, and marks of months and verbs, against plain Python."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillmart.operators import parts as P
from quillmart.plans import subjects as S


def match(a, b):
    x, y = a.replace(" ", ""), b.replace(" ", "")
    s, t = set(a.split()), set(b.split())
    if x in y or y in x or len(s & t) / min(len(s), len(t)) >= 0.5:
        return True
    return max(len(x), len(y)) <= 60 and SequenceMatcher(None, x, y).ratio() >= 0.74


def matched(left, right):
    used, n = set(), 0
    for a in left:
        for b in right:
            if b not in used and match(a, b):
                used.add(b)
                n += 1
                break
    return n


def test_overlaps_equal_a_greedy_fold(spark):
    rnd = random.Random(3)
    words = ["minor cancer", "cancer", "major surgery", "surgery cost", "surgery costs", "care", "daily care cost", "night", "nights off", "x" * 70, "x" * 69 + "y", "abcdefgh", "abcdexgh"]
    events = [(i, sorted(set(rnd.sample(words, rnd.randrange(0, 6))))) for i in range(60)]
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60) if rnd.random() < 0.4]
    df = spark.createDataFrame(events, "id long, components array<string>")
    got = P.component_overlaps(spark.createDataFrame(pairs, "left_id long, right_id long"), df).collect()
    lists = dict(events)
    wanted = {}
    for i, j in pairs:
        n = matched(lists[i], lists[j])
        wanted[i, j] = (n, 100 * n // max(1, min(len(lists[i]), len(lists[j]))))
    assert {(r["left_id"], r["right_id"]): (r["matched"], r["overlap"]) for r in got} == wanted
    assert any(n for n, _ in wanted.values()) and match("abcdefgh", "abcdexgh") and not match("x" * 70, "x" * 69 + "y")


def test_no_pairs(spark):
    none = spark.createDataFrame([], "left_id long, right_id long")
    assert P.component_overlaps(none, spark.createDataFrame([(1, ["a"])], "id long, components array<string>")).collect() == []


def test_telling_overlaps_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(P, "durable", lambda df: pytest.fail("pairs or components are stored"))
    rnd = random.Random(5)
    words = ["minor cancer", "cancer", "major surgery", "surgery cost", "surgery costs", "care", "daily care cost", "night", "nights off", "abcdefgh", "abcdexgh", "x" * 70]
    events = [(i, rnd.choice(["a", "b", None]), sorted(set(rnd.sample(words, rnd.randrange(0, 6))))) for i in range(90)]
    tell = lambda e: {w for c in e[2] for w in c.split(" ") if len(w) >= 7}
    wanted = {}
    for x in events:
        for y in events:
            if x[0] < y[0] and x[1] == y[1] and x[1] and tell(x) & tell(y):
                n = matched(x[2], y[2])
                wanted[x[0], y[0]] = (n, 100 * n // max(1, min(len(x[2]), len(y[2]))))
    df = spark.createDataFrame(events, "id long, source string, components array<string>")
    told = F.flatten(F.transform("components", lambda c: F.filter(F.split(c, " "), lambda w: F.char_length(w) >= 7)))
    for rows in (P.CELL_ROWS, 8):
        monkeypatch.setattr(P, "CELL_ROWS", rows)
        got = P.telling_overlaps(df, "source", told).collect()
        assert len(got) == len(wanted) and {(r["left_id"], r["right_id"]): (r["matched"], r["overlap"]) for r in got} == wanted


def nearest(text, verbs, reach):
    best = None
    months = [(m.start(), m.end(), m[0]) for m in re.finditer(S.MONTH, text)]
    for s, e, w in months:
        for v in re.finditer(rf"\b(?:{'|'.join(verbs)})\b", text):
            gap, rank = (v.start() - e, 0) if v.start() >= e else (s - v.end(), 1)
            if 0 <= gap <= reach:
                best = min(best or (999,), (gap, rank, s, v[0], w))
    if best is None:
        return None
    digits = re.sub("[^0-9]", "", best[4])
    return f"{digits[:4]}-{digits[4:6]}", best[3], best[0]


def test_months_stand_by_their_nearest_verb(spark):
    texts = [
        (1, "sold from 2023-05 and out since 2021.03 then out"), (2, "out 2020-01 out"), (3, "2020-01" + "x" * 41 + " out"), (4, "out, " + "y" * 35 + " 202004"), (5, "no month out"), (6, "2020-01 alone"),
        (7, ""), (8, None), (9, "2019-02 2019-03 out 2019-04"), (10, "2020-13 out 2020-1 out"),
    ]
    df = spark.createDataFrame(texts, "id long, t string")
    got = {r["id"]: (r["month"], r["verb"], r["distance"]) for r in S.months_by_verbs(S.marks(df, "id", "t", S.MONTH, ["out", "sold"]), "id").collect()}
    wanted = {i: nearest(t or "", ["out", "sold"], 40) for i, t in texts}
    assert got == {i: w for i, w in wanted.items() if w} and got[2] == ("2020-01", "out", 1) and 3 not in got
