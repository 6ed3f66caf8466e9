"""Mentions of a dictionary table: overlaps, parts, edges, anchors, attribution by hand."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmart.operators import mentions as M
from quillmart.plans import attribution as A
from quillmart.plans import upserting as U


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def brute(texts, words):
    return [(i, w, k) for i, t in texts for w in set(words) if w for k in range(len(t or "")) if (t or "").startswith(w, k)]


@pytest.mark.parametrize("part_bytes", [2 << 20, 40])
def test_all_places_of_all_aliases(spark, monkeypatch, part_bytes):
    """One automaton or many give every place, also of aliases that overlap, hold each other or repeat."""
    monkeypatch.setattr(M, "PART_BYTES", part_bytes)
    rnd = random.Random(1)
    words = ["aa", "a", "aba", "abab", "ba", "über", "", "aa", "\U0001f600b"] + ["".join(rnd.choice("abü") for _ in range(rnd.randrange(2, 7))) for _ in range(40)]
    texts = [(1, "aaaa"), (2, "ababab über aba"), (3, ""), (4, None), (None, "\U0001f600baba"), *[(i, "".join(rnd.choice("abü ") for _ in range(80))) for i in range(10, 40)]]
    found = M.mentions(table(spark, texts, "id long, t string"), ["id"], "t", table(spark, [(w,) for w in words] + [(None,)], "alias string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(brute(texts, words), key=repr)


def test_no_alias_and_no_text(spark):
    empty = table(spark, [], "alias string")
    assert M.mentions(table(spark, [(1, "abc")], "id long, t string"), ["id"], "t", empty).collect() == []
    assert M.mentions(table(spark, [], "id long, t string"), ["id"], "t", table(spark, [("a",)], "alias string")).collect() == []


def test_edges_of_mentions(spark):
    texts = table(spark, [(1, "mit, mit_ xmit mit2 (mit) emit"), (2, "mit")], "id long, t string")
    found = M.mentions(texts, ["id"], "t", table(spark, [("mit",)], "alias string"), edges=True).where(M.stands_alone())
    assert sorted((r["id"], r["start"]) for r in found.collect()) == [(1, 0), (1, 21), (2, 0)]


def test_distance_to_the_nearest_of_all_anchors(spark):
    texts = table(spark, [(1, "x" * 50 + "cat" + "x" * 100 + "cat" + "dog" + "x" * 30 + "dog", "cat"), (2, "dog", "cat"), (3, "dogcatcatdog", "cat")], "id long, t string, a string")
    found = M.mentions(texts, ["id"], "t", table(spark, [("dog",)], "alias string"))
    anchors = M.occurrences(texts, ["id"], "t", "a")
    assert sorted(tuple(r) for r in anchors.collect()) == [(1, 50), (1, 153), (3, 3), (3, 6)]
    near = M.nearest_anchor(found, anchors, ["id"]).select("id", "start", "distance")
    assert sorted(tuple(r) for r in near.collect()) == [(1, 156, 3), (1, 189, 36), (2, 0, None), (3, 0, 3), (3, 9, 3)]


WORDS = [(1, "alphabet", "long", "normalized"), (1, "alpha", "long", "full_alias"), (2, "betaworks", "short", "normalized"), (1, "group", "long", "short_alias"), (2, "group", "short", "short_alias")]


def attributed(spark, known, texts):
    words = table(spark, WORDS, "entity long, alias string, kind string, match_type string")
    known = table(spark, known, "doc_id long, expected string, anchor string, raw string")
    texts = table(spark, texts, "doc_id long, source string, k string")
    rows = A.attributed(known, A.scored_evidence(known, texts, words)).collect()
    return {r["doc_id"]: tuple(r)[1:] for r in rows}


def test_attribution_by_hand(spark):
    filler = "z" * 50
    got = attributed(
        spark,
        [(1, None, "thing", ""), (2, None, "thing", ""), (3, "short", "thing", ""), (4, "short", "thing", "group"), (5, None, "thing", ""), (6, "short", "x", ""), (7, None, "alpha", "")],
        [
            (1, "local_text", "alphabet" + filler + "thing"), (1, "full_text", "betaworks"),
            (3, "local_text", "alphabet"), (3, "full_text", "betaworks"),
            (4, "raw_candidate", "group"),
            (5, "full_text", "thegroup"),
            (6, "local_text", "alpha"),
            (7, "product_name_brand", "alphabets"), (7, "article_title", "betaworksthealpha"),
        ],
    )
    # 990 + 340 + 140 + 50 letters + 160 near against 990 + 40 + 140 + 60; alpha inside alphabet is the same entity
    assert got[1] == (1, "local_full_name", 990, 1680 - 1230, False, "")
    assert got[2] == (None, "ambiguous_review", 0, None, True, "no evidence")
    # the expected kind goes before the better score
    assert got[3] == (2, "full_text", 990, 1230 - 1520, False, "")
    # the owner of the expected kind of an ambiguous name; a short alias that nothing backs is reviewed
    assert got[4] == (2, "ambiguous_review", 780, None, True, "short alias")
    assert got[5][1] == "ambiguous_review" and got[5][-1] == "short alias"
    assert got[6] == (1, "local_alias", 990, None, True, "kind conflict")
    # a brand in the subject's name: 960 + 500 against 990 + 140 + 140 + 60 + 240
    assert got[7] == (2, "title", 990, 1570 - 1460, False, "")


def test_occurrences_take_any_character_as_it_is(spark):
    texts = table(spark, [(1, "a.b\\Ea.b", "a.b"), (4, "x\\Ey\\E", "\\E"), (2, "aaaa", "aa"), (3, "abc", "")], "id long, t string, a string")
    assert sorted(tuple(r) for r in M.occurrences(texts, ["id"], "t", "a").collect()) == [(1, 0), (1, 5), (2, 0), (2, 2), (4, 1), (4, 4)]
    assert M.best_of_entities(table(spark, [(1, 5, 3), (1, 5, 2)], "id long, entity long, start int"), ["id"], [F.col("start")], ["start"]).collect()[0]["start"] == 2


@pytest.mark.parametrize("part_bytes", [2 << 20, 6])
def test_placed_mentions_are_the_best_of_all_places(spark, monkeypatch, part_bytes):
    """One row an alias, as out of all places and anchors; the longest and whole ones of texts that are names."""
    monkeypatch.setattr(M, "PART_BYTES", part_bytes)
    rnd = random.Random(3)
    words = ["ab", "b", "aab", "üa", "abab"]
    texts = [(i, "".join(rnd.choice("abü") for _ in range(rnd.randrange(30))), rnd.choice(["a", "ba", "ü", "", None]), how) for i, how in enumerate(["near", "longest", "whole"] * 30)]
    texts += [(100, "abab", None, "whole"), (101, None, "a", "near"), (102, "", "a", "longest"), (103, "bab", "b", "longest")]
    df, tiers = table(spark, texts, "id long, t string, a string, how string"), [1, 4]
    got = M.placed_mentions(df, ["id"], "t", "a", "how", table(spark, [(w,) for w in words], "alias string"), tiers).collect()
    expected = set()
    for i, t, a, how in texts:
        spots = [m.start() for m in re.finditer(re.escape(a), t or "")] if a and how == "near" else []
        best = {}
        for _, w, k in brute([(i, t)], words):
            far = min((abs(k - s) for s in spots), default=None)
            best[w] = min(best.get(w, (9, 0, None)), (len(tiers) if far is None else sum(far > x for x in tiers), k, far), key=lambda x: x[:2])
        if how == "longest" and best:
            best = dict([min(best.items(), key=lambda x: (-len(x[0]), x[1][1], x[0]))])
        expected |= {(i, how, w, k, far) for w, (_, k, far) in best.items() if how != "whole" or w == t}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_attribution_reads_its_documents_once(spark, sf_dir):
    """Evidence is matched in one pass over the documents and moved once, beside their ids and kinds."""
    plan = A.attribution(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 2


def random_evidence(spark, seed=5):
    """A dictionary whose words are in each other and have several owners, and documents with all kinds of evidence."""
    rnd = random.Random(seed)
    made = sorted({"".join(rnd.choice("abü") for _ in range(rnd.randrange(2, 7))) for _ in range(40)})
    kinds = {e: rnd.choice(["long", "short"]) for e in range(12)}
    words = []
    for w in made:
        owners = rnd.sample(range(12), rnd.choice([1, 1, 2, 3]))
        words += [(e, w, kinds[e], "short_alias" if len(owners) > 1 else rnd.choice(["normalized", "full_alias"])) for e in owners]
    text = lambda most: "".join(rnd.choice("abüx") for _ in range(rnd.randrange(most)))
    known, texts = [], []
    for i in range(150):
        known.append((i, rnd.choice([None, "long", "short"]), rnd.choice(["", "ab", "ü", "xx"]), ""))
        for source in [*A.WEIGHTS]:
            if source != "industry_reresolve" and rnd.random() < 0.6:
                texts.append((i, source, " ".join(rnd.choice([*made, "zz"]) for _ in range(4)) if source == "company_candidates" else rnd.choice([text(500), text(12), rnd.choice(made), "x" * 9])))
    return table(spark, words, "entity long, alias string, kind string, match_type string"), table(spark, known, "doc_id long, expected string, anchor string, raw string"), table(spark, texts, "doc_id long, source string, k string")


def test_few_marks_tell_what_all_marks_tell(spark, monkeypatch):
    """Documents are judged in their rows: three marks at most leave one, and the result is that of all marks."""
    words, known, texts = random_evidence(spark)
    few = A.scored_evidence(known, texts, words)
    assert few.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    got = sorted((tuple(r) for r in A.attributed(known, few).collect()), key=repr)
    monkeypatch.setattr(M, "PART_BYTES", 40)
    every = A.scored_evidence(known, texts, words)
    assert every.count() > 5 * few.count()
    expected = sorted((tuple(r) for r in A.attributed(known, every).collect()), key=repr)
    assert got == expected and len({r[-1] for r in got}) > 3 and len({r[2] for r in got}) > 4


@pytest.mark.parametrize("part_bytes", [2 << 20, 40])
def test_documents_without_a_mark_keep_their_facts(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(M, "PART_BYTES", part_bytes)
    words, known, texts = random_evidence(spark)
    rows = texts.groupBy("doc_id").agg(F.collect_list(F.struct("source", "k")).alias("evidence")).join(known, "doc_id").withColumn("fact", F.col("doc_id") * 3)
    marks = A.scored_evidence(None, rows, words, ("fact",))
    got = {r["doc_id"]: tuple(r) for r in A.attributed(None, marks, ("fact",)).collect()}
    plain = {r["doc_id"]: tuple(r) for r in A.attributed(known, A.scored_evidence(known, texts, words)).collect()}
    assert got == {i: (i, 3 * i, *r[1:]) for i, r in plain.items() if i in got} and len(got) == rows.count()
    # no dictionary at all
    none = A.scored_evidence(None, rows, words.where("false"), ("fact",))
    assert {r["reason"] for r in A.attributed(None, none, ("fact",)).collect()} == {"no evidence"} and none.count() == rows.count()


def test_adjudication_reads_its_documents_once(spark, sf_dir):
    """Checks and owners come out of one reading and move once."""
    plan = U.adjudication(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1
