"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.llm.common import read
from quillmart.llm.conversations import OP11_SQL, damaged_and_repaired
from quillmart.llm.exact_dedup import OP4_SQL, exact_dedup
from quillmart.llm.langid import identify_languages
from quillmart.llm.licenses import OP5_SQL, scan_licenses
from quillmart.llm.merkle import OP12_SQL, tampered_manifest
from quillmart.llm.mixing import mix_sources
from quillmart.llm.near_dedup import OP6_SQL, near_duplicates
from quillmart.llm.packing import pack_documents
from quillmart.llm.quality import score_quality
from quillmart.llm.sharding import stratified_shards
from quillmart.llm.topk import OP1_SQL, search_queries
from quillmart.llm.toxicity import score_toxicity
from quillmart.llm.warc import OP13_SQL, archived_pages


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries(read(spark, sf_dir, "embeddings"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    as_text = F.array_join(F.transform("sentence_ids", lambda x: x.cast("string")), ",")
    return found.select("doc_id", as_text.alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    placed = mix_sources(docs)
    source = F.when(F.col("_k") != "-", F.expr("substring(_k, 2)"))
    return placed.select("doc_id", source.alias("source"), F.col("_weight").alias("weight_parts"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_release").alias("release"), F.col("_deadline").alias("deadline"), F.col("_within").alias("place_in_block"), F.col("_bounded").alias("bounded"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(read(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_and_repaired(read(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(read(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(read(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_topk, op2_langid, op3_packing, op4_exact_dedup, op5_licenses, op6_near_dedup, op7_toxicity, op8_quality, op9_mixing, op10_sharding, op11_conversations, op12_merkle, op13_warc, pipeline)}
ORACLE_SQL: dict[str, str] = {"op1_topk": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op5_licenses": OP5_SQL, "op6_near_dedup": OP6_SQL, "op11_conversations": OP11_SQL, "op12_merkle": OP12_SQL, "op13_warc": OP13_SQL}
