"""A record in, a record (or one for each frame) out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S


def reverse_complements(seqs: DataFrame, suffix: str = "", literal: str | None = None, rna: bool = False) -> DataFrame:
    """literal: a sequence to reverse and complement instead of the records'."""
    if literal is not None:
        return seqs.sparkSession.range(1).select(S.reverse_complement(F.lit(literal), rna).alias("seq"))
    return seqs.withColumns({"header": F.concat("header", F.lit(suffix)), "seq": S.reverse_complement(F.col("seq"), rna)})


def translations(seqs: DataFrame, frames: str | list[str] = "F1") -> DataFrame:
    """A protein for each frame asked for, in that order (column frame_no); "all" is six frames."""
    names = list(S.FRAMES) if str(frames).lower() == "all" else [f.strip().upper() for f in (frames.split(",") if isinstance(frames, str) else frames)]
    each = F.array(*[F.struct(F.lit(k).alias("frame_no"), F.lit(f).alias("frame"), S.translated(F.col("seq"), f).alias("protein")) for k, f in enumerate(names)])
    rest = [c for c in seqs.columns if c not in ("header", "seq")]
    out = seqs.withColumn("r", F.explode(each))
    return out.select(*rest, "r.frame_no", "r.frame", F.concat_ws("-", "header", "r.frame").alias("header"), F.col("r.protein").alias("seq"))


def truncated(seqs: DataFrame, begin: int | None = None, length: int | None = None, comment: bool = False) -> DataFrame:
    """Parts of sequences, as cut_out() takes them; zero is no option. comment adds the two numbers to the header."""
    begin, length = begin or 0, length or None
    out = seqs.withColumn("seq", S.cut_out(F.col("seq"), F.lit(begin), None if length is None else F.lit(length)))
    return out.withColumn("header", F.concat("header", F.lit(f" Trunc:{begin}:{S.UNBOUNDED if length is None else length}"))) if comment else out


def digests(seqs: DataFrame, base64: bool = False) -> DataFrame:
    """(seq_idx, md5, header) of records with a header and residues."""
    kept = seqs.where(S.is_set(F.col("header")) & (F.length("seq") > 0))
    return kept.select("seq_idx", S.digest(F.col("seq"), base64).alias("md5"), "header", "seq")


def digest_records(seqs: DataFrame, keep_header: bool = True, base64: bool = False) -> DataFrame:
    """Records whose header begins with (or is) the digest."""
    out = digests(seqs, base64)
    return out.withColumn("header", F.concat_ws(" ", "md5", "header") if keep_header else F.col("md5")).withColumn("seq", F.upper("seq")).drop("md5")


def bisulfite_converted(seqs: DataFrame, keep_cpg: bool = False) -> DataFrame:
    return seqs.withColumn("seq", S.bisulfite(F.col("seq"), keep_cpg))
