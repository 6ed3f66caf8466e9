"""Rules from a table against plain Python; filters, limits."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmart.operators import ruletable as T
from quillmart.plans.listing import bounded, filter_set

RULES = [("legal", "licence", "strong", 30, 2), ("legal", "permit", "medium", 30, 2), ("sport", "run", "medium", 25, 1), ("sport", "runner", "strong", 25, 1), ("spam", "cheap", "strong", -50, 0), ("news", "today", "medium", 60, 5)]
SCHEMA = "label string, keyword string, strength string, weight int, priority int"


def hits_of(text):
    return [(*r, [m.start() for m in re.finditer(f"(?={re.escape(r[1])})", text)]) for r in RULES if r[1] in text]


def test_scores_and_classes_equal_plain_rules(spark):
    rnd = random.Random(5)
    texts = [(i, " ".join(rnd.choice(["licence", "permit", "runner", "run", "cheap", "today", "word"]) for _ in range(rnd.randrange(0, 6)))) for i in range(80)] + [(900, ""), (901, None)]
    hits = T.rule_hits(spark.createDataFrame(texts, "id long, t string"), ["id"], "t", spark.createDataFrame(RULES, SCHEMA)).cache()
    scores, classes = {}, {}
    for i, t in texts:
        found = hits_of(t or "")
        if not found:
            continue
        score = max(0, min(100, sum({h[0]: h[3] for h in found}.values())))
        scores[i] = (score, "high" if score >= 70 else "medium" if score >= 40 else "low" if score >= 20 else "skip", len({h[0] for h in found}), len(found))
        best = min((h[2] != "strong", h[4], h[0], min(h[5]), h[1]) for h in found)
        classes[i] = (best[2], T.MEDIUM if best[0] else T.STRONG, best[4])
    assert {r["id"]: tuple(r)[1:] for r in T.additive_scores(hits, ["id"]).collect()} == scores
    assert {r["id"]: tuple(r)[1:] for r in T.classified(hits, ["id"]).collect()} == classes
    assert {r["times"] for r in hits.collect()} >= {1, 2}


def test_snippets_keep_order_neighbours_and_budget(spark):
    sentences = spark.createDataFrame([(1, i, s) for i, s in enumerate(["aa", "hit one", "bb", "cc", "dd", "hit two", "x" * 20, "ee"])], "id long, i int, sentence string")
    hits = spark.createDataFrame([(1, 1, "k"), (1, 5, "k"), (1, 0, "other")], "id long, i int, label string")
    got = {r["label"]: (r["sentences"], r["snippet"]) for r in T.class_snippets(sentences, "id", hits, 1, 22).collect()}
    assert got["k"] == (5, "aa hit one bb dd hit two") and got["other"] == (2, "aa hit one")


def test_candidates_once_and_best_first(spark):
    df = spark.createDataFrame([(1, 'Fine Care is "Fine care" and "  " here. Fine Care again. Other Name too'), (2, None)], "id long, t string")
    got = sorted(tuple(r) for r in T.candidate_names(df, "id", "t", '"([^"]*)"', "(?:^|[.] )([A-Z][a-z]+ [A-Z][a-z]+)").collect())
    assert got == [(1, "Fine care", 96), (1, "Other Name", 90)]


def test_filters_without_value_do_not_filter(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5.0), (3, None, 7.0)], "k long, s string, x double").withColumn("d", F.expr("timestamp_ntz'2024-01-31 23:00:00' + make_interval(0, 0, 0, int(k))"))
    keys = lambda *f: sorted(r["k"] for r in filter_set(df, list(f)).collect())
    assert keys() == keys(("s", "in", []), ("s", "in", None), ("s", "in", ["a", "all"]), ("x", "at least", None)) == [1, 2, 3]
    assert keys(("s", "not in", ["b"])) == [1, 3] and keys(("s", "in", ["b"])) == [2] and keys(("x", "at most", 5.0)) == [2]
    assert keys(("d", "before day after", "2024-02-01")) == [1] and keys(("d", "from", "2024-02-02")) == [2, 3] and keys(("k", "like", "%3%")) == [3]


@pytest.mark.parametrize(("limit", "held"), [(None, 20), (0, 1), (-3, 1), (7, 7), (50, 50), (500, 50)])
def test_limits_are_held(limit, held):
    assert bounded(limit, 50, 20) == held


def test_templates_longest_first_and_without_overlap(spark):
    phrases = [("new", "N"), ("new york", "NY"), ("york city", "YC"), ("aa", "2"), ("é", "e")]
    texts = [(1, "new york city is new"), (2, "aaaaa"), (3, "nothing"), (4, ""), (5, None), (6, "café é")]

    def plain(t):
        out, at = "", 0
        while at < len(t):
            best = max((p for p in phrases if t.startswith(p[0], at)), key=lambda p: len(p[0]), default=None)
            out, at = (out + best[1], at + len(best[0])) if best else (out + t[at], at + 1)
        return out

    got = T.templated(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame(phrases, "keyword string, template string"))
    assert {r["id"]: r["text"] for r in got.collect()} == {i: None if t is None else plain(t) for i, t in texts}
    assert {r["id"]: r["replaced"] for r in got.collect()} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 2}
