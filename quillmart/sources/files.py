"""Readers and writers: tables, dictionaries, JSON lines, nested payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.functions.durable import durable


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dictionary(spark: SparkSession, path: str, schema: str, null_word: str = "null") -> DataFrame:
    """A CSV dictionary with a header; blank cells and the null word, in any case, are null."""
    raw = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
    text = {c for c, kind in raw.dtypes if kind == "string"}
    clean = lambda c: F.nullif(F.nullif(F.trim(F.regexp_replace(c, "^﻿", "")), F.lit("")), F.lit(null_word))
    return raw.select(*[F.when(F.lower(clean(c)) != null_word, clean(c)).alias(c) if c in text else F.col(c) for c in raw.columns])


def aligned(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of the schema in order; those that are missing are null (additive schema evolution)."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in schema.items()])


def requests_out(df: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Batch requests as one JSON object a line."""
    df.select(F.to_json(F.struct(F.col(key).cast("string").alias("key"), *columns)).alias("value")).write.mode("overwrite").text(path)


def results_in(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """Batch results (key, error, payload struct, raw); malformed lines keep their raw text and a null key."""
    raw = spark.read.text(path).withColumnRenamed("value", "raw")
    parsed = F.from_json("raw", f"key string, error string, response struct<{payload}>")
    return raw.select(parsed["key"].alias("key"), parsed["error"].alias("error"), parsed["response"].alias("payload"), "raw")


def rfc_timestamp(text: F.Column) -> F.Column:
    """Wall-clock time of an RFC 2822 date; weekday and offset are dropped, other text is null."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""), r"\s*([+-]\d{4}|[A-Z]{2,4})\s*$", "")
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz")


PAYLOAD = (
    "products array<struct<name string, company string, release_ym string, type_code string, coverages array<struct<name string, max_amount bigint>>, metrics array<struct<name string, value double, unit string>>, "
    "features array<struct<channel string, notification string>>, insights array<struct<summary string>>, partners array<struct<name string, role string>>>>"
)


#: The child lists of a product: table, and what of a row is its name and its number.
CHILDREN = {"coverage": ("name", "max_amount"), "metric": ("name", "value"), "feature": ("channel", None), "insight": ("summary", None), "partner": ("name", None)}


def payload_items(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, kind, product_no, item_no, name, number) of the rows of all six tables of nested JSON payloads.

    A payload is read once and its rows come out of one array, so nothing is scanned or moved for each table; a
    product is item 0 of its place. Payloads are read as by ``payload_tables``.
    """
    none = F.lit(None).cast("bigint")
    product = F.array(F.struct(F.lit("product").alias("kind"), F.lit(0).alias("item_no"), F.col("product.name").alias("name"), none.alias("number")))
    lists = [product]
    for kind, (name, number) in CHILDREN.items():
        row = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("item_no"), x[name].alias("name"), (x[number].cast("bigint") if number else none).alias("number"))  # noqa: B023, E731
        lists.append(F.coalesce(F.transform(f"product.{kind}s", row), F.array().cast("array<struct<kind:string,item_no:int,name:string,number:bigint>>")))
    products = df.select(key, F.from_json(column, PAYLOAD).alias("p")).select(key, F.posexplode("p.products").alias("product_no", "product"))
    return products.select(key, "product_no", F.explode(F.concat(*lists)).alias("x")).select("x.kind", key, "product_no", "x.item_no", "x.name", "x.number")


def payload_tables(df: DataFrame, key: str, column: str) -> dict[str, DataFrame]:
    """Nested JSON payloads as six tables: product, coverage, metric, feature, insight, partner, each row with its place.

    Malformed payloads give no rows, neither do missing arrays; a value of a wrong type is null.
    """
    parsed = df.select(key, F.from_json(column, PAYLOAD).alias("p"))
    products = parsed.select(key, F.posexplode("p.products").alias("product_no", "product"))
    child = lambda name: products.select(key, "product_no", F.posexplode(f"product.{name}").alias("item_no", "item")).select(key, "product_no", "item_no", "item.*")
    own = products.select(key, "product_no", "product.name", "product.company", "product.release_ym", "product.type_code")
    return {"product": own} | {name: child(f"{name}s") for name in ("coverage", "metric", "feature", "insight", "partner")}


def office_csv_out(df: DataFrame, path: str) -> None:
    """CSV with a header and the byte order mark that office programs want, in every file of the folder."""
    df.withColumnRenamed(df.columns[0], f"\ufeff{df.columns[0]}").write.mode("overwrite").option("header", True).csv(path)


def sheets_out(sheets: dict[str, DataFrame], folder: str) -> None:
    """The sheets of a workbook as one folder of CSV each."""
    for name, df in sheets.items():
        office_csv_out(df, f"{folder}/{name}")


def plans_out(plans: list[DataFrame], path: str) -> None:
    """Plans with different columns as one CSV whose header is the union of their columns."""
    office_csv_out(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), plans), path)


def preferred_first(df: DataFrame, preferred: list[str]) -> DataFrame:
    """The preferred columns that there are, in their order, then the others in theirs."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def json_or_raw(text: F.Column, schema: str, fields: dict[str, str]) -> list[F.Column]:
    """parsed, the fields of a JSON object, and kept: the text itself where it is no such object."""
    whole = F.from_json(text, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = F.coalesce(F.startswith(text, F.lit("{")) & whole.isNotNull() & whole["_bad"].isNull(), F.lit(False))
    return [good.alias("parsed"), *[F.when(good, whole[path]).alias(name) for name, path in fields.items()], F.when(~good, text).alias("kept")]


def whole_number(c: F.Column) -> F.Column:
    """A number in text, thousands commas left out, cut to a whole one; null for other text."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double").try_cast("bigint")


def first_number(c: F.Column) -> F.Column:
    """The first decimal anywhere in the text; null without one."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"[-+]?[0-9]+(\.[0-9]+)?", 0), F.lit("")).try_cast("double")


def tree_values(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """(key, path, value) of every field called ``name`` in a JSON tree of any depth, objects and arrays alike.

    Each level explodes the one before it as variants, and is written, so that no level is read twice; the search ends
    with the first level that has no rows.
    """
    level = df.select(key, F.lit("$").alias("path"), F.try_parse_json(column).alias("node")).where("node IS NOT NULL")
    found = []
    while True:
        child = "SELECT k, path, e.key AS name, e.pos AS pos, e.value AS node FROM level, LATERAL variant_explode(node) AS e"
        rows = level.sparkSession.sql(child.replace("k,", f"{key},").replace("level", "{level}"), level=level)
        path = F.concat("path", F.when(F.col("name").isNotNull(), F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit("["), "pos", F.lit("]"))))
        rows = durable(rows.select(key, path.alias("path"), "name", "node"))
        found.append(rows.where(F.col("name") == name).select(key, "path", F.expr("try_variant_get(node, '$', 'string')").alias("value")))
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found).where("value IS NOT NULL")
        level = rows.select(key, "path", "node")
