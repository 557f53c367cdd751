"""Sequences that keep arriving. Record-by-record operators (translations, motif_hits, ...) take the stream as they take a
table; counts keep a small state and are written in complete mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.readers import _record


def stream_fasta(spark: SparkSession, path: str, case: str | None = None, strip_digits: bool = False) -> DataFrame:
    """(path, header, seq_raw, seq) of files as they appear in a folder. Records of a stream have no ordinal."""
    rows = spark.readStream.option("lineSep", "\n>").text(path).withColumn("path", F.col("_metadata.file_path"))
    return rows.where(F.col("value") != "").select("path", *_record(F.regexp_replace("value", "^>", ""), case, strip_digits))


def running_words(stream: DataFrame, k: int = 3) -> DataFrame:
    """(ngram, n) so far."""
    return stream.select(F.explode(F.regexp_extract_all(F.upper("seq"), F.lit(f"(?=(.{{{k}}}))"), F.lit(1))).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


def running_lengths(stream: DataFrame) -> DataFrame:
    """(path, n_seqs, length) so far."""
    return stream.groupBy("path").agg(F.count(F.lit(1)).alias("n_seqs"), F.sum(F.length("seq").cast("long")).alias("length"))
