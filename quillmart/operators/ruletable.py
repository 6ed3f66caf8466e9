"""Keyword rules as a table: what hits where, additive scores, classifiers by strength and priority, snippets by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.operators.mentions import mentions

# Fixed values, in hundredths: what a strong, a weak and no keyword are worth to a classifier; characters of snippets.
STRONG, MEDIUM, NONE, BUDGET = 92, 74, 30, 3000


def rule_hits(texts: DataFrame, keys: list[str], text: Column | str, rules: DataFrame) -> DataFrame:
    """(keys, label, keyword, strength, weight, priority, times, first) of every rule whose keyword stands in a text.

    ``rules`` has a row for each keyword of a label. Keywords of all rules are found in one pass by an automaton; hits
    of a text are counted before they meet their rules.
    """
    found = mentions(texts, keys, text, rules.select(F.col("keyword").alias("alias")))
    counted = found.groupBy(*keys, F.col("alias").alias("keyword")).agg(F.count(F.lit(1)).alias("times"), F.min("start").alias("first"))
    return counted.join(rules, "keyword").select(*keys, "label", "keyword", "strength", "weight", "priority", "times", "first")


def additive_scores(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, tier, labels, keywords): weights of the labels that hit, each once, held between 0 and 100."""
    once = hits.groupBy(*keys, "label").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    total = F.least(F.lit(100), F.greatest(F.lit(0), F.sum("weight"))).cast("int")
    scored = once.groupBy(*keys).agg(total.alias("score"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("keywords"))
    tier = F.when(F.col("score") >= 70, "high").when(F.col("score") >= 40, "medium").when(F.col("score") >= 20, "low").otherwise("skip")
    return scored.select(*keys, "score", tier.alias("tier"), "labels", "keywords")


def classified(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, confidence, keyword): strong keywords go first, then the lowest priority, the label, the first place."""
    order = F.struct(F.when(F.col("strength") == "strong", 0).otherwise(1).alias("s"), "priority", "label", "first", "keyword")
    best = hits.groupBy(*keys).agg(F.min(order).alias("b"))
    return best.select(*keys, "b.label", F.when(F.col("b.s") == 0, STRONG).otherwise(MEDIUM).alias("confidence"), "b.keyword")


def class_snippets(sentences: DataFrame, key: str, hits: DataFrame, around: int = 1, budget: int = BUDGET) -> DataFrame:
    """(key, label, sentences, snippet): for each label the sentences that it hits with their neighbours, once, in order.

    ``sentences`` is (key, i, sentence), ``hits`` (key, i, label). One that would take the snippet beyond the budget is
    passed over, later ones may fit.
    """
    near = hits.select(key, "label", F.explode(F.sequence(F.col("i") - around, F.col("i") + around)).alias("i")).distinct()
    rows = near.join(sentences, [key, "i"]).groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("i", "sentence"))).alias("l"))
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<string>)").alias("kept"))
    fits = lambda a, x: a["used"] + F.char_length(x["sentence"]) <= budget
    step = lambda a, x: F.when(fits(a, x), F.struct((a["used"] + F.char_length(x["sentence"])).alias("used"), F.array_append(a["kept"], x["sentence"]).alias("kept"))).otherwise(a)
    kept = F.aggregate("l", start, step, lambda a: a["kept"])
    return rows.select(key, "label", F.size(kept).alias("sentences"), F.array_join(kept, " ").alias("snippet"))


def candidate_names(texts: DataFrame, key: str, text: str, quoted: str, unquoted: str) -> DataFrame:
    """(key, name, confidence, start): names in quotation marks at .96 and others at .90, each squeezed name once, best first."""
    of = lambda pattern, sure: F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda n, i: F.struct(F.trim(n).alias("name"), F.lit(sure).alias("confidence"), i.alias("place")))
    rows = texts.select(key, F.explode(F.concat(of(quoted, 96), of(unquoted, 90))).alias("c")).select(key, "c.*").where("name <> ''")
    squeezed = F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", "")
    best = Window.partitionBy(key, "_k").orderBy(F.desc("confidence"), "place")
    ranked = rows.withColumn("_k", squeezed).where("_k <> ''").withColumn("_n", F.row_number().over(best))
    return ranked.where("_n = 1").select(key, "name", "confidence")


def templated(texts: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """(key, replaced, text): phrases replaced by their templates; of those that begin at one place the longest, and what
    it covers begins no other.

    ``phrases`` is (keyword, template), one template a keyword. Texts without a phrase stay as they are.
    """
    found = mentions(texts, [key], text, phrases.select(F.col("keyword").alias("alias"))).join(phrases.withColumnRenamed("keyword", "alias"), "alias")
    hit = F.struct(F.col("start"), (-F.char_length("alias")).alias("l"), F.col("template"))
    hits = found.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
    rows = texts.select(key, F.col(text).alias("_text")).join(hits, F.col(key) == F.col("_key"), "left")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"), F.lit(0).alias("n"))

    def step(done: Column, x: Column) -> Column:
        between = F.substring(F.col("_text"), done["at"] + 1, x["start"] - done["at"])
        put = F.struct((x["start"] - x["l"]).alias("at"), F.concat(done["parts"], F.array(between, x["template"])).alias("parts"), (done["n"] + 1).alias("n"))
        return F.when(x["start"] >= done["at"], put).otherwise(done)

    rest = lambda done: F.struct(done["n"].alias("n"), F.concat(F.array_join(done["parts"], ""), F.substring(F.col("_text"), done["at"] + 1, F.char_length("_text"))).alias("text"))
    filled = rows.withColumn("_f", F.when(F.col("_hits").isNotNull(), F.aggregate("_hits", start, step, rest)))
    return filled.select(key, F.coalesce("_f.n", F.lit(0)).alias("replaced"), F.coalesce("_f.text", "_text").alias("text"))
