"""Name normalisation, candidates and gates on stated names."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillmart.functions import names as N

RULES = N.NameRules(aliases=("Acme Works", "Acme"), stem_suffixes=("Works",), lead_words=("new", "the"), strip_before=("my", "super"), strip_after=("plan", "plus"), fragments=("andthen",), weak=("plan",))


def test_owner_pattern_takes_names_with_and_without_blanks_and_suffix():
    found = lambda text, **also: re.findall(f"(?i){N.owner_pattern(RULES, **also)}", text)
    assert found("Acme Works, ACMEWORKS and acme wo") == ["Acme Works", "ACMEWORKS", "acme "] and found("acmeworks1acme", blanks=False) == ["acmeworks", "acme"]
    assert re.findall(N.owner_pattern(N.NameRules()), "any text") == []
    # a suffix is part of the name where fewer than two characters would stay
    short = N.NameRules(aliases=("X.Co", "Co"), stem_suffixes=("Co",))
    assert re.findall(N.owner_pattern(short), "X.Co X. Co C") == ["X.Co", "X.", "Co"]


def test_normal_names_and_cores(spark):
    names = ["New Acme Works 'Care' (Plus)", "the new the Fire 2.5 - ", "ACMEWORKS", None, "  a · b  "]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(N.normal_name(F.col("n"), RULES).alias("a"), N.core_name(F.col("n"), RULES).alias("b"))
    assert [tuple(r) for r in df.collect()] == [("Care Plus", "careplus"), ("Fire 2.5", "fire2.5"), ("", ""), ("", ""), ("a b", "ab")]


def test_core_candidates_breadth_first(spark):
    df = spark.createDataFrame([("mysupercareplusplan",), ("care",), ("my",), ("",)], "c string").select(N.core_candidates(F.col("c"), RULES))
    got = [r[0] for r in df.collect()]
    assert got[0][:3] == ["mysupercareplusplan", "supercareplusplan", "mysupercareplus"] and "care" in got[0] and len(got[0]) == len(set(got[0])) == 9
    assert got[1:] == [["care"], ["my"], [""]]


def test_gate_reasons(spark):
    rows = [("Fine Name", "t", "about fine name"), ("and then some", "t", ""), ("Plan", "t", ""), ("ab1", "t", ""), ("Only Title", "Only title here", "elsewhere"), (None, None, None)]
    df = spark.createDataFrame(rows, "n string, t string, s string").select(N.name_gate(F.col("n"), F.col("t"), F.col("s"), RULES).alias("g"))
    assert [r.g.reason for r in df.collect()] == ["", "sentence_fragment", "weak_name", "too_short", "title_only", "sentence_fragment"]


def test_base_titles_of_cut_entities_and_odd_characters_equal_their_sql(spark, tmp_path):
    from quillmart import plans

    from conftest import same_as_sql

    titles = ["a &amp", "a &amp;amp; b", "&amp;lt;", "&lt &lt;b&gt;", "&copy; &#x27; &#39;", "e\u0301 \ufb01 \uff21", "\u00a0x\u2003y\u00a0", " \t\x0ba\x0b \n", "\u201ca\u201d \u00abb\u00bb \u2018c\u2019", ""]
    pages = [(i, f"<title>{t}</title>") for i, t in enumerate(titles)] + [(98, None), (99, "no title")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert same_as_sql(plans.QUERIES["base_titles"](spark, str(tmp_path)), plans.ORACLE_SQL["base_titles"], str(tmp_path)) == 12
