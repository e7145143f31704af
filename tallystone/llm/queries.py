"""Registered queries of the training-data operators: thin forms with digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hard_negatives, langid, licenses, packing, phrases, templates, token_store, topk, toxicity
from . import quality as quality_model
from .common import drop_path, held_out, read_table, shared_dir, staged
from .fingerprints import edit_report
from .ngram_join import ngram_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@register
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents"), k=4, percent=85, count_links=True)


@register
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(read_table(spark, sf_dir, "documents"))


@register
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


SQL["op4_license_scan"] = licenses.scan_sql()


@register
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_model.quality(docs, labels).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@register
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(read_table(spark, sf_dir, "pages"))


@register
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write_store(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    out, _ = staged(token_store.read_back(spark, path), "read-back")
    drop_path(spark, path)
    return out


@register
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


SQL["op8_topk"] = topk.top_k_sql()


@register
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(read_table(spark, sf_dir, "documents")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@register
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=2048, end_id=0)


@register
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


SQL["op11_phrases"] = phrases.collocations_sql()


@register
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.labelled_vectors(read_table(spark, sf_dir, "embeddings"), label)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


SQL["op12_hard_negatives"] = hard_negatives.hard_negatives_sql()


@register
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")
