"""Counts over sequences: lengths, composition, words and codons. Counts are combined before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.functions.alphabet import CODE

#: Ambiguity codes that composition reports.
AMBIGUOUS = "NMRWSYKVHDBX"


def count_sequences(seqs: DataFrame) -> DataFrame:
    return seqs.agg(F.count(F.lit(1)).alias("n_seqs"))


def lengths(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_idx", "header", F.length("seq").cast("long").alias("length"))


def total_length(seqs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Residues in all, or by columns such as path."""
    return seqs.groupBy(*(by or [])).agg(F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)).alias("length"))


def _occurs(c: str, cased: bool) -> Column:
    seq = F.col("seq") if cased else F.upper("seq")
    return (F.length(seq) - F.length(F.replace(seq, F.lit(c), F.lit("")))).cast("long")


def composition(seqs: DataFrame, ambiguous: str | None = None, cased: bool = False, pairs: bool = False, by_sequence: bool = False, zeros: bool = True) -> DataFrame:
    """(base, n, total, pct), per sequence if asked. ambiguous: None, "sum" (all as N) or "each"; cased keeps cases apart. pairs: G/C and A/T.
    pct is of the bases reported and -1 if there are none. zeros=False leaves out bases that do not occur."""
    bases = list("ACGTacgt" if cased and not pairs else "ACGT")
    both = cased and not pairs
    codes = list(AMBIGUOUS) + [c.lower() for c in AMBIGUOUS] * both
    names = bases + ([] if ambiguous is None else codes)
    keys = ["seq_idx", "header"] if by_sequence else []
    sums = seqs.groupBy(*keys).agg(*[F.coalesce(F.sum(_occurs(c, cased and not pairs)), F.lit(0)).alias(f"n{k}") for k, c in enumerate(names)])
    n = {c: F.col(f"n{k}") for k, c in enumerate(names)}
    add = lambda cs: sum((n[c] for c in cs[1:]), n[cs[0]])
    rows = [("G/C", add("GC")), ("A/T", add("AT"))] if pairs else [(c, n[c]) for c in bases]
    if ambiguous == "sum":
        rows += [(c, add(cs)) for c, cs in (("N", AMBIGUOUS), ("n", AMBIGUOUS.lower() * both)) if cs]
    elif ambiguous == "each":
        rows += [(c, n[c]) for c in codes]
    total = sum((x for _, x in rows[1:]), rows[0][1])
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("base"), x.alias("n")) for c, x in rows]))
    out = sums.withColumn("total", total).withColumn("r", listed)
    pct = F.when(F.col("total") > 0, 100.0 * F.col("r.n") / F.nullif(F.col("total"), F.lit(0))).otherwise(-1.0)
    out = out.select(*keys, F.col("r.base").alias("base"), F.col("r.n").alias("n"), "total", pct.alias("pct"))
    return out if zeros else out.where("n > 0")


def _words(seqs: DataFrame, keys: list[str], k: int, letters: str) -> DataFrame:
    """(keys, pos, word): words of k letters and their places from 0 on, also overlapping ones; found block by block."""
    # Outer generators: for others Spark adds a filter that makes every list once more.
    cut = seqs.select(*keys, F.posexplode_outer(S.blocks(F.upper("seq"), k - 1, length=F.length("seq"))).alias("_b", "_block"))
    found = F.regexp_extract_all("_block", F.lit(f"(?s)(?=({letters}{{{k}}}))"), F.lit(1))
    return cut.select(*keys, (F.col("_b").cast("long") * S.BLOCK).alias("_at"), F.posexplode_outer(found).alias("_i", "word")).where("word IS NOT NULL").select(*keys, (F.col("_at") + F.col("_i")).alias("pos"), "word")


def kmers(seqs: DataFrame, k: int = 2, by_sequence: bool = False, dense: bool = True) -> DataFrame:
    """(kmer, rc, fwd, rev, both, fwd_pct, rev_pct, avg_pct): words of A, C, G and T, and those of the other strand, which
    are the counts of the reverse complement. dense has a row for every word, also those that do not occur."""
    if not 1 <= k <= 10:
        raise ValueError("k must be from 1 to 10")
    keys = ["seq_idx", "header"] if by_sequence else []
    counts = _words(seqs, keys, k, "[ACGT]").groupBy(*keys, F.col("word").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
    # A word and its reverse complement meet under the smaller of the two: one aggregation instead of a self-join.
    rc = S.reverse_complement(F.col("kmer"))
    either = counts.withColumn("canon", F.least("kmer", rc)).groupBy(*keys, "canon").agg(
        F.sum(F.when(F.col("kmer") == F.col("canon"), F.col("n")).otherwise(0)).alias("up"), F.sum(F.when(rc == F.col("canon"), F.col("n")).otherwise(0)).alias("down")
    )
    other = S.reverse_complement(F.col("canon"))
    one = F.struct(F.col("canon").alias("kmer"), F.col("up").alias("fwd"), F.col("down").alias("rev"))
    two = F.struct(other.alias("kmer"), F.col("down").alias("fwd"), F.col("up").alias("rev"))
    rows = either.withColumn("r", F.explode(F.when(other == F.col("canon"), F.array(one)).otherwise(F.array(one, two)))).select(*keys, "r.*")
    if dense:
        every = seqs.sparkSession.range(4**k).select(S.decoded(F.col("id"), k).alias("kmer"))  # 4^10 rows at most
        if by_sequence:  # a row of each word for each sequence is what is asked for; words come from a list, not from a join
            words = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(4**k - 1).cast("long")), lambda i: S.decoded(i, k))
            every = seqs.select(*keys).distinct().withColumn("kmer", F.explode(words))
        rows = every.join(rows, [*keys, "kmer"], "left").fillna(0, ["fwd", "rev"])
    # Over 4^k rows at most, or those of a sequence: the sequences are read once.
    rows = rows.withColumn("total", F.sum("fwd").over(W.partitionBy(*keys)))
    pct = lambda x: F.try_divide(x, F.col("total").cast("double"))
    return rows.select(
        *keys, "kmer", S.reverse_complement(F.col("kmer")).alias("rc"), "fwd", "rev", (F.col("fwd") + F.col("rev")).alias("both"),
        pct(100.0 * F.col("fwd")).alias("fwd_pct"), pct(100.0 * F.col("rev")).alias("rev_pct"), pct(50.0 * (F.col("fwd") + F.col("rev"))).alias("avg_pct"), "total",
    )


def ngrams(seqs: DataFrame, k: int = 3, order: str | None = None) -> DataFrame:
    """(ngram, n, pct) of any characters, of records whose header is set. order: None, "count" (ties by word) or "ngram"."""
    counts = _words(seqs.where(S.is_set(F.col("header"))), [], k, ".").groupBy(F.col("word").alias("ngram")).agg(F.count(F.lit(1)).alias("n"))
    total = seqs.where(S.is_set(F.col("header"))).agg(F.sum(F.greatest(F.length("seq") - (k - 1), F.lit(0)).cast("long")).alias("total"))
    out = counts.crossJoin(total).select("ngram", "n", F.try_divide(100.0 * F.col("n"), F.col("total")).alias("pct"))  # one row of totals
    return out.orderBy(F.desc("n"), "ngram") if order == "count" else out.orderBy("ngram") if order else out


def kmers_by_frame(seqs: DataFrame, k: int = 3, frames: int = 3, percent: bool = False) -> DataFrame:
    """(kmer, f0, f1, ...): counts by position modulo frames, or their shares of the row in percent."""
    words = _words(seqs.where(S.is_set(F.col("header"))), [], k, ".").withColumnRenamed("word", "kmer")
    count = lambda f: F.count_if(F.col("pos") % frames == f).alias(f"f{f}")
    out = words.groupBy("kmer").agg(*[count(f) for f in range(frames)])
    if not percent:
        return out
    total = sum((F.col(f"f{f}") for f in range(1, frames)), F.col("f0"))
    return out.select("kmer", *[(100.0 * F.col(f"f{f}") / total).alias(f"f{f}") for f in range(frames)])


def codon_frequencies(seqs: DataFrame) -> DataFrame:
    """(aa, codon, n, pct, aa_pct) for all 64 codons of frame 1; a share of nothing is null."""
    cut = seqs.select(F.explode_outer(S.blocks(F.col("seq"))).alias("block"))
    found = cut.select(F.explode_outer(S.codons(F.col("block"))).alias("codon")).where("codon IS NOT NULL").groupBy("codon").agg(F.count(F.lit(1)).alias("n"))
    table = seqs.sparkSession.createDataFrame(sorted((a, c) for c, a in CODE.items()), "aa string, codon string")
    out = table.join(found, "codon", "left").fillna(0, ["n"])
    share = lambda w: F.try_divide(100.0 * F.col("n"), F.sum("n").over(w))  # noqa: E731  over 64 rows
    return out.select("aa", "codon", "n", share(W.partitionBy()).alias("pct"), share(W.partitionBy("aa")).alias("aa_pct"))
