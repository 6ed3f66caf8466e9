"""Rule scores, cascades, keyword classifiers and dictionary matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.operators.mentions import mentions, stands_alone


def any_word(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words; one pass of one regular expression."""
    return text.rlike("|".join(words))


def additive_score(text: Column, weights: list[tuple[int, list[str]]]) -> Column:
    """Sum of the hundredths whose keywords occur, held between 0 and 100."""
    total = sum((F.when(any_word(text, words), F.lit(w)).otherwise(0) for w, words in weights), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def tier(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("skip")


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds, in order."""
    chain = None
    for name, test in rules:
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(otherwise)


def matched(text: Column, words: list[str]) -> Column:
    """The words that occur, in the order of the list."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def dictionary_hits(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, word, place) of every occurrence of dictionary words as whole words, by one alternation, longest first."""
    ordered = sorted(words, key=lambda w: (-len(w), w))
    pattern = F.lit(rf"(?i)\b({'|'.join(ordered)})\b")
    # letters beyond ASCII are word characters too, whatever the regular expression's dialect says of \\b
    plain = F.regexp_replace(F.col(text), r"[^\x00-\x7F]", "_")
    return docs.select(key, F.posexplode(F.regexp_extract_all(plain, pattern, 1)).alias("place", "word")).select(key, F.lower("word").alias("word"), "place")


def dictionary_mentions(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, word, start) of every place where a dictionary word stands as a whole word, those inside others included.

    ``start`` counts characters from 0. Only A-Z are folded, so that places are those of the text itself.
    """
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    known = docs.sparkSession.createDataFrame([(w.translate({ord(a): b for a, b in zip(upper, lower, strict=True)}),) for w in words], "alias string")
    found = mentions(docs, [key], F.translate(text, upper, lower), known, edges=True)
    return found.where(stands_alone()).select(key, F.col("alias").alias("word"), "start")


def best_mentions(mentions: DataFrame, key: str, owners: dict[str, str]) -> DataFrame:
    """The best mention of every owner of words: the longest word, then the earliest place."""
    owner = F.create_map(*[F.lit(x) for pair in owners.items() for x in pair])
    best = F.min_by(F.struct("word", "start"), F.struct((-F.char_length("word")).alias("l"), "start", "word"))
    found = mentions.withColumn("entity", F.try_element_at(owner, F.col("word"))).where("entity IS NOT NULL")
    return found.groupBy(key, "entity").agg(best.alias("b")).select(key, "entity", "b.word", "b.start")


def unique_owner(df: DataFrame, token: str, owner: str) -> DataFrame:
    """Tokens that belong to exactly one owner."""
    return df.groupBy(token).agg(F.count_distinct(owner).alias("_n"), F.min(owner).alias(owner)).where("_n = 1").drop("_n")


def over_fetched(df: DataFrame, order: list[Column], test: Column, wanted: int, times: int = 5, most: int = 1000) -> DataFrame:
    """The first rows that pass a test applied after the limit: ``times`` as many are fetched, ``most`` at most."""
    return df.orderBy(*order).limit(min(most, times * wanted)).where(test).orderBy(*order).limit(wanted)


def owner_of(key: Column, aliases: list[tuple[str, str]], least: int = 3) -> Column:
    """struct(owner, basis) of a squeezed name by (alias, owner), given longest alias first.

    A name shorter than ``least`` is not resolved. Then come an equal alias, an alias inside the name, and an alias
    around the name; within a tier the longest alias wins.
    """
    row = lambda owner, basis: F.struct(F.lit(owner).alias("owner"), F.lit(basis).alias("basis"))
    chain = F.when(F.char_length(key) < least, row("", "too short"))
    tiers = [("exact", lambda a: key == a), ("alias in name", lambda a: F.contains(key, F.lit(a))), ("name in alias", lambda a: F.contains(F.lit(a), key))]
    for basis, test in tiers:
        for alias, owner in aliases:
            chain = chain.when(test(alias), row(owner, basis))
    return chain.otherwise(row("", "none"))
