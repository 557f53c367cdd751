"""Files as DataFrames. Texts are split by Spark's own reader, so that large files are read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.plans.checkpoints import cut


#: Splits up to which their table (some hundred bytes a row) is broadcast.
SPLITS = 200_000


def _numbered(rows: DataFrame, name: str, opening: str | None = None) -> DataFrame:
    """Add a dense number from 1, in order of path and place in the file, without moving rows: each split's rows are
    contiguous in a partition, so the splits' counts (one row a split) give each its first number. With `opening`, a
    file's first row is a record only if it begins so, and column _head marks it."""
    marked = rows.withColumns({"_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    opens = F.startswith("value", F.lit(opening or ""))
    splits = cut(marked.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"), F.min_by(opens, "_id").alias("opens")))
    skip = ((F.col("_start") == 0) & ~F.col("opens")).cast("long")
    before = F.sum(F.col("n") - skip).over(W.orderBy("_path", "_start").rowsBetween(W.unboundedPreceding, -1))  # over splits, not rows
    table = splits.select("_path", "_start", (F.coalesce(before, F.lit(0)) + 1 - F.col("first") - skip).alias("_shift"), F.when(F.col("_start") == 0, F.col("first")).otherwise(-1).alias("_first"))
    table = F.broadcast(table) if splits.count() <= SPLITS else table
    out = marked.join(table, ["_path", "_start"]).withColumns({name: F.col("_id") + F.col("_shift"), "_head": F.col("_id") == F.col("_first")})
    return out.where(~F.col("_head") | opens).drop("_start", "_id", "_shift", "_first")


def read_fasta(spark: SparkSession, paths: str | list[str], case: str | None = None, strip_digits: bool = False) -> DataFrame:
    """(path, seq_idx, header, seq_raw, seq). Records begin with > at the start of a line; what precedes the first is
    dropped. seq_raw keeps lines as they are; seq is cleaned as clean() does."""
    # The separator takes the > of every record but a file's first.
    rows = _numbered(spark.read.option("lineSep", "\n>").text(paths), "seq_idx", ">")
    value = F.when(F.col("_head"), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    return rows.select(F.col("_path").alias("path"), "seq_idx", *_record(value, case, strip_digits))


def read_genome(spark: SparkSession, paths: str | list[str], by_file: bool = True, case: str | None = None) -> DataFrame:
    """(chrom, seq_idx, header, seq): chromosomes named by their files (less folder and extension), the last record of a file
    counting, or else by the first word of their headers. header begins with the name."""
    rows = read_fasta(spark, paths, case)
    if not by_file:
        return rows.select(S.record_id(F.col("header")).alias("chrom"), "seq_idx", "header", "seq")
    named = rows.withColumn("chrom", F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", ""))
    last = named.select("chrom", "seq_idx").groupBy("chrom").agg(F.max("seq_idx").alias("seq_idx"))
    kept = named.join(last, ["chrom", "seq_idx"])
    return kept.select("chrom", "seq_idx", F.concat_ws(" ", "chrom", "header").alias("header"), "seq")


def _record(value: Column, case: str | None, strip_digits: bool) -> list[Column]:
    header = F.regexp_replace(F.substring_index(value, "\n", 1), "\r$", "")
    body = F.when(F.contains(value, F.lit("\n")), F.regexp_replace(value, "^[^\n]*\n", "")).otherwise("")
    return [header.alias("header"), body.alias("seq_raw"), S.clean(body, case, strip_digits).alias("seq")]


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(seq_idx, header, seq, qheader, qual) of four-line records; a header without @ or a missing line raises an error."""
    lines = _numbered(spark.read.text(paths), "_n").withColumns({"rec": F.floor((F.col("_n") - 1) / 4), "k": (F.col("_n") - 1) % 4})
    part = lambda k: F.max(F.when(F.col("k") == k, F.regexp_replace("value", "\r$", "")))
    rows = lines.groupBy("rec").agg(*[part(k).alias(n) for k, n in enumerate(("header", "seq", "qheader", "qual"))])
    good = F.when(F.startswith("header", F.lit("@")) & F.col("qual").isNotNull(), F.col("header"))
    checked = F.coalesce(good, F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("header", F.lit("null")))).cast("string"))
    return rows.select((F.col("rec") + 1).alias("seq_idx"), checked.alias("header"), "seq", "qheader", "qual")


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _numbered(spark.read.text(paths), "row_idx").select("row_idx", F.regexp_replace("value", "\r$", "").alias("line"))


def read_interval_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(row_idx, chr, start, stop, line): closed intervals, columns by white space; blank lines are dropped."""
    f = F.split(F.trim("line"), "\\s+")
    rows = _lines(spark, paths).where(F.trim("line") != "")
    return rows.select("row_idx", F.get(f, F.lit(0)).alias("chr"), F.get(f, F.lit(1)).cast("long").alias("start"), F.get(f, F.lit(2)).cast("long").alias("stop"), "line")


def _cut_list(line: Column) -> list[Column]:
    """a b [desc] or a-b [desc]: the first - after a digit is a space."""
    plain = F.regexp_replace(line, "^(\\s*-?\\d+)\\s*-", "$1 ")
    pick = lambda g: F.regexp_extract(plain, "^\\s*(-?\\d+)\\s+(-?\\d+)\\s*(.*)$", g)
    return [pick(1).cast("long").alias("a"), pick(2).cast("long").alias("b"), F.trim(pick(3)).alias("desc")]


def read_cut_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(a, b, desc): half-open intervals; negative ends are 0, ends are put in order; lines that do not begin with a number
    are skipped, one number alone or a blank line raises an error."""
    rows = _lines(spark, paths)
    bad = F.trim("line").rlike("^(-?\\d+)?$")
    checked = rows.withColumn("line", F.when(bad, F.raise_error(F.lit("an interval needs two numbers")).cast("string")).otherwise(F.col("line")))
    kept = checked.where(F.col("line").rlike("^\\s*-?\\d+\\s*[-\\s]\\s*-?\\d+")).select(*_cut_list(F.col("line")))
    from helixframe.operators.intervals import normalised

    return normalised(kept)


def interval_list(spark: SparkSession, text: str) -> DataFrame:
    """(a, b, desc) from a list like 2-5,10-20."""
    found = []
    for part in text.replace(" ", "").split(","):
        a, dash, b = part.partition("-")
        if not (dash and a.isdigit() and b.isdigit() and len(a) <= 10 and len(b) <= 10):
            raise ValueError(f"no interval: {part!r}")
        found.append((min(int(a), int(b)), max(int(a), int(b)), ""))
    return spark.createDataFrame(found, "a long, b long, desc string")


def read_regions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(chrom, a, b, desc), columns by white space."""
    f = F.split(F.trim("line"), "\\s+")
    rows = _lines(spark, paths).where(F.trim("line") != "")
    rest = F.array_join(F.slice(f, F.lit(4), F.greatest(F.size(f) - 3, F.lit(0))), " ")
    return rows.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("a"), F.get(f, F.lit(2)).cast("long").alias("b"), rest.alias("desc"))


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(row_idx, rname, pos, cigar, line) of alignments; header lines are left out."""
    f = F.split("line", "\t")
    rows = _lines(spark, paths).where(~F.startswith("line", F.lit("@")) & (F.col("line") != ""))
    return rows.select("row_idx", F.get(f, F.lit(2)).alias("rname"), F.get(f, F.lit(3)).cast("long").alias("pos"), F.get(f, F.lit(5)).alias("cigar"), "line")


def read_edges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(a, b, desc): two nodes and a comment, whose first word is dropped if it begins with #; blank lines are dropped and a
    missing second node is ""."""
    f = F.split(F.trim("value"), "\\s+")
    skip = F.when(F.startswith(F.coalesce(F.get(f, F.lit(2)), F.lit("")), F.lit("#")), 4).otherwise(3)
    rows = spark.read.text(paths).where(F.trim(F.regexp_replace("value", "\\s", " ")) != "")
    return rows.select(F.get(f, F.lit(0)).alias("a"), F.coalesce(F.get(f, F.lit(1)), F.lit("")).alias("b"), F.array_join(F.slice(f, skip, F.greatest(F.size(f) - skip + 1, F.lit(0))), " ").alias("desc"))


def read_ids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(id): one a line, trimmed, each once; a blank line is the id ""."""
    return spark.read.text(paths).select(F.trim(F.regexp_replace("value", "\\s+$", "")).alias("id")).distinct()
