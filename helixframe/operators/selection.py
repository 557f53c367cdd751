"""Filters, samples and chunks of records; order is the column seq_idx, which starts at 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions import sequences as S


def select_sequences(
    seqs: DataFrame, min_length: int | None = None, max_length: int | None = None, header: str | None = None, sequence: str | None = None,
    begin: int | None = None, limit: int | None = None, trim_stop: bool = False, highlight: bool = False, fixed: bool = False, fastq: bool = False,
) -> DataFrame:
    """Records by place, length and patterns (case ignored). A zero option is no option. With a header pattern the
    sequence pattern is ignored, unless fixed. limit takes the first records that pass. highlight lowers the case of
    the text that was searched but for its first match. Headers are searched with their > and line end; those of reads
    (fastq) have their @ already."""
    out = seqs.where(F.col("seq_idx") >= begin) if begin else seqs
    if trim_stop:
        out = out.withColumn("seq", S.without_stop(F.col("seq")))
    n = F.length("seq")
    if min_length:
        out = out.where(n >= min_length)
    if max_length:
        out = out.where(n <= max_length)
    line = F.concat(F.lit("" if fastq else ">"), F.col("header"), F.lit("\n"))
    if header:
        out = out.where(line.rlike(f"(?i){header}"))
        if highlight:
            out = out.withColumn("header", F.regexp_replace(S.highlighted(line, header), "\n$" if fastq else "^>|\n$", ""))
    if sequence and (fixed or not header):
        out = out.where(F.col("seq").rlike(f"(?i){sequence}"))
        if highlight:
            out = out.withColumn("seq", S.highlighted(F.col("seq"), sequence))
    return out.orderBy("seq_idx").limit(limit) if limit else out


def sequence_range(seqs: DataFrame, first: int, n: int) -> DataFrame:
    return seqs.where((F.col("seq_idx") >= first) & (F.col("seq_idx") < first + n))


def by_ids(seqs: DataFrame, ids: DataFrame, invert: bool = False, unique: bool = False, fastq: bool = False) -> DataFrame:
    """Records whose id is (invert: is not) in the one column of ids; unique keeps the first record of each id."""
    name = (S.read_id if fastq else S.record_id)(F.regexp_replace("header", "^@", "") if fastq else F.col("header"))
    wanted = ids.select(F.trim(F.col(ids.columns[0]).cast("string")).alias("_id")).distinct()
    out = seqs.withColumn("_id", name).join(wanted, "_id", "left_anti" if invert else "left_semi")
    if unique:
        out = out.withColumn("_n", F.row_number().over(W.partitionBy("_id").orderBy("seq_idx"))).where("_n = 1")
    return out.select(seqs.columns)


def chunks(seqs: DataFrame, n: int) -> DataFrame:
    """Column chunk, 0 to n - 1: contiguous chunks of which the first ones are larger by one. seq_idx must be dense, so
    that arithmetic serves where a global window would move all rows to one task."""
    if n < 1:
        raise ValueError("there must be a chunk")
    total = seqs.agg(F.count(F.lit(1))).first()[0]
    size, more = divmod(total, n)
    at = F.col("seq_idx") - 1
    long = more * (size + 1)
    return seqs.withColumn("chunk", F.when(at < long, F.floor(at / (size + 1))).otherwise(more + F.floor((at - long) / max(1, size))).cast("int"))


def split_names(seqs: DataFrame, separator: str = "|", field: int | None = None, extension: str = "") -> DataFrame:
    """Column fname: a field of the header (the 4th by default). Of records of one name the last stays."""
    part = F.get(F.split("header", "[" + separator.replace("\\", "\\\\").replace("]", "\\]").replace("^", "\\^") + "]"), F.lit(3 if field is None else field))
    named = seqs.withColumn("fname", F.concat(F.coalesce(part, F.lit("")), F.lit(f".{extension}" if extension else "")))
    columns = F.struct("seq_idx", *[c for c in seqs.columns if c != "seq_idx"])
    return named.groupBy("fname").agg(F.max_by(columns, "seq_idx").alias("r")).select("fname", "r.*")
