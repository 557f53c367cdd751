"""Text sinks. Records are written by the tasks that hold them."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.operators.selection import chunks, split_names


def write_fasta(seqs: DataFrame, path: str, width: int | None = 60, mode: str = "errorifexists") -> None:
    """width None: each sequence on one line."""
    seqs.select(S.fasta(F.col("header"), F.col("seq"), width).alias("value")).write.mode(mode).text(path)


def write_fastq(reads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    reads.select(S.fastq(*(F.col(c) for c in ("header", "seq", "qheader", "qual"))).alias("value")).write.mode(mode).text(path)


def write_pretty(seqs: DataFrame, path: str, mode: str = "errorifexists", **options: int) -> None:
    seqs.select(S.pretty(F.col("header"), F.col("seq"), **options).alias("value")).write.mode(mode).text(path)


def _named(rows: DataFrame, column: str, path: str, mode: str, begin: str = "", end: str = "") -> None:
    """A file for each value of a column, called begin + value + end. A value's rows are sorted by seq_idx in one task, as they
    make one file; the driver then renames, which moves no data."""
    spark = rows.sparkSession
    rows.repartition(column).sortWithinPartitions(column, "seq_idx").select(column, "value").write.mode(mode).partitionBy(column).text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        if folder.isDirectory():
            name = unquote(folder.getPath().getName().split("=", 1)[1])
            for part in fs.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), hadoop.Path(root, begin + name + end))
            fs.delete(folder.getPath(), True)


def write_chunks(seqs: DataFrame, path: str, n: int, prefix: str = "chunk_", extension: str = ".fasta", width: int | None = 60, mode: str = "errorifexists") -> None:
    """Files prefix0extension, prefix1extension, ... of contiguous records, for each chunk that has records."""
    rows = chunks(seqs, n).select("seq_idx", "chunk", S.fasta(F.col("header"), F.col("seq"), width).alias("value"))
    _named(rows, "chunk", path, mode, prefix, extension)


def write_split(seqs: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> DataFrame:
    """A file for each name that split_names() gives; returns the names. A name must be set."""
    named = split_names(seqs, **options)
    _named(named.select("seq_idx", "fname", S.fasta(F.col("header"), F.col("seq"), None).alias("value")), "fname", path, mode)
    return named.select("fname")


# The layouts of the tools' reports, which other programs read.
KMER, CODON, LENGTH, COUNT, SHARE, PLACE = "%s/%s %10d %10d %10d %10.6f %10.6f %10.6f", "%s %s  %10d  %8.3f  %8.3f", "%10d %s", "%10d ", "%6.2f ", "%10d %10d %s %s"
NGRAM, NGRAM_SHARE, TOTAL, RUN, HIT, NEAR = "%s %10d", "%s %10.6f", "%10d %s", " %4d", "%s %s %2d %s %10d", "%10d  %s  %s %s %s %2d"


def kmer_report() -> Column:
    """A row of kmers() as fixed-width text."""
    return F.format_string(KMER, "kmer", "rc", "fwd", "rev", "both", "fwd_pct", "rev_pct", "avg_pct")


def codon_report() -> Column:
    return F.format_string(CODON, "aa", "codon", "n", "pct", "aa_pct")


def length_report() -> Column:
    return F.format_string(LENGTH, "length", F.when(S.is_set(F.col("header")), F.col("header")).otherwise(" "))


def composition_report(names: bool = True, counts: bool = True, percents: bool = True) -> Column:
    """A row of composition()."""
    parts = [F.concat("base", F.lit(": "))] * names + [F.format_string(COUNT, "n")] * counts + [F.format_string(SHARE, "pct")] * percents
    return F.concat(*parts)


def ngram_report(percent: bool = False) -> Column:
    return F.format_string(NGRAM_SHARE, "ngram", "pct") if percent else F.format_string(NGRAM, "ngram", "n")


def match_report() -> Column:
    """A row of regex_matches()."""
    return F.format_string(PLACE, "offset", "length", "match", "header")


def count_report() -> Column:
    """A row of regex_counts()."""
    return F.format_string(TOTAL, "n", "header")


def run_report(left: bool = False, right: bool = False, terse: bool = False) -> Column:
    """A row of longest_runs()."""
    sides = [F.format_string(RUN, c) for c in ["length"] + ["left"] * left + ["remaining"] * right]
    return F.concat(*([] if terse else [F.concat("header", F.lit(": "))]), *sides)


def hit_report(neighbours: bool = False) -> Column:
    """A row of motif_hits(): what lies at the place, or the hit and its neighbours."""
    if neighbours:
        return F.format_string(NEAR, "pos", "dir", "left", "match", "right", "n_mis")
    return F.format_string(HIT, "window", "dir", "n_mis", "expansion", "pos")
