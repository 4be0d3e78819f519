"""The document pipeline: quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, packing, pii, quality
from tidemark.llm.storage import bounded_batches, keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels that aren't held out, scores 0.3 or more.

    Every row is judged by its text alone, repeated rows and rows with a null id too; a null or empty
    text has no n-grams and the score of a margin of 0. Other columns than ``COLUMNS`` go.
    """
    bounded_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).where(F.col("score") >= quality.KEEP_FROM).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The smallest id stays. Null, empty and blank texts and rows with a null id all stay; of rows that
    share id and text, one. Other columns than ``COLUMNS`` go.
    """
    bounded_batches(spark)
    return minhash.drop_near_duplicates(docs.select(*COLUMNS))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span replaced by its kind in brackets; ``n_chars`` follows.

    Rows are kept one to one; a null text stays null and keeps its ``n_chars``. Other columns than
    ``COLUMNS`` go.
    """
    bounded_batches(spark)
    masked = pii.redact_pii(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, their sequence and their place in it.

    A null or empty text is the end id alone; repeated rows are documents of their own; other columns
    pass through.
    """
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("personal_data", mask_personal), ("packing", pack)]

#: A classifier's fit and sequence packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
