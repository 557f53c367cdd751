"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import mixing, packing, quality_classifier, secrets, simhash
from helixframe.plans.checkpoints import removed, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to these documents' weak labels, keeps. A null text is judged as an empty
    one; equal texts get the same verdict, whatever their ids; every row is judged by itself."""
    return quality_classifier.good_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that of the smallest id. Rows of
    one id with different texts are different documents; null ids come last; of equal rows one stays; texts without a word are
    copies of each other."""
    return simhash.without_near_copies(docs, similarity=0.8, shingle=5)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text's credentials masked and its characters counted anew. Null texts stay null, with n_chars null; empty
    ones stay empty; repeated rows are masked alike; null ids don't matter."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix holds it. Null texts have no words; a null source is one of its own. Rows that agree in
    id, source and size share their copies as evenly as can be, in the order of a hash of all columns."""
    return mixing.copied(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences. Every row is a document of its own, repeated ones too; a null text is empty, a null id stays null;
    equal lengths go by the order of rows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_each_group),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed_sources),
    ("packing", packed),
]

#: Fitted models, graph search and random rounding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote to the shared folder goes when the next has read it."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            removed(spark, before)
        before = f"{at}/{name}"
    return docs
