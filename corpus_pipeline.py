"""A corpus pipeline: quality filter, language filter, near duplicates out, sequences packed.

Each stage reads all that its predecessor kept. All but the last return the columns of
``documents``; the last returns packed pieces. A stage's rows are made when they are read, so each
leaves the session with small Arrow batches (``small_batches``); ``run`` sets them back.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import langid, packing, quality
from tallystone.llm.common import batches_as_before, maybe_among, read_table, small_batches, staged
from tallystone.llm.ngram_join import ngram_components, row_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its language's probability is below this, or it has no letter.
LEAST_LANGUAGE = 0.4
#: Units of text in a generation of the tokenizer's cache: few, as the workers still hold what earlier stages took.
UNITS = 50_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the quality model does not predict to be bad.

    A null or empty text has no features and stays or goes by the model's bias. Repeated rows are
    scored alike and all stay; a null id is a row like others. An empty table stays empty.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return quality.quality(docs, read_table(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose language the network can tell.

    Null and empty texts, and those without a letter, go. Repeated rows and null ids are treated like
    others; a table without a known ``lang`` keeps nothing. An empty table stays empty.
    """
    small_batches(spark)
    return langid.language(docs.select(*COLUMNS), keep=COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts linked by 0.8 of their 5-word shingles: one with the smallest doc_id.

    Rows with a null id are in groups like others and stay where no row of their group has an id. Null
    and wordless texts are groups of their own, but of equal rows one stays. Rows that share a
    doc_id are judged each by its own text. An empty table stays empty.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    groups = ngram_components(docs, k=5, percent=80, keep_one=True)
    rows = groups.groupBy("row_key").agg(F.count("*").alias("rows"), F.max("stays").alias("stays"))
    # only rows that go or that are there several times are looked up; all others stay where they are
    marks, _ = staged(rows.where("rows > 1 or not stays"), "marks")
    looked = maybe_among(docs.withColumn("row_key", row_key("doc_id", "text")), "row_key", marks.select("row_key"))
    asked = looked.where("maybe").join(marks, "row_key", "left").where("stays is null or stays").dropDuplicates(["row_key"])
    return looked.where("not maybe").select(*COLUMNS).unionByName(asked.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept text in sequences of at most 2048 ids.

    A null or empty text is one piece with the end id; longer texts are cut. Each repeated row is packed,
    null ids included. An empty table gives no rows.
    """
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=2048, end_id=0, units=UNITS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("language ID", language_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", pack_sequences),
]

#: The models and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    with batches_as_before(spark):
        for i, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs, _ = staged(docs, f"stage{i}")
    return docs
