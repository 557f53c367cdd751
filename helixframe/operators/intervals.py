"""Intervals against sequences, and against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.plans.binned import reach, running, touching


def normalised(intervals: DataFrame) -> DataFrame:
    """Ends in order, negative ones as 0."""
    a, b = F.greatest(F.col("a"), F.lit(0)), F.greatest(F.col("b"), F.lit(0))
    return intervals.withColumns({"a": F.least(a, b), "b": F.greatest(a, b)})


def _extracted(joined: DataFrame, fixed: bool) -> DataFrame:
    n = F.length("seq")
    stop = F.least("b", n)
    # An interval that reaches the end is, as the tool has it, one residue short of its label.
    last = stop if fixed else F.when(F.col("b") >= n, F.greatest(n - 1, F.col("a"))).otherwise(F.col("b"))
    return joined.where(F.col("a") < n).withColumns({"stop": stop.cast("long"), "piece": F.substr("seq", (F.col("a") + 1).cast("int"), (last - F.col("a")).cast("int"))})


#: Intervals of a block, each of which meets every sequence as one row; bytes up to which a single block is broadcast.
BLOCK, BROADCAST = 65_536, 8 << 20


def extract(seqs: DataFrame, intervals: DataFrame, fixed: bool = False, ordered: bool = False) -> DataFrame:
    """(header, desc, a, stop, label, piece): residues a to b (exclusive, from 0) of every sequence, for every interval.

    Every pair is what is asked for. Intervals are gathered into blocks, so no list grows with its table. A single block of
    a checked size is broadcast; else each sequence goes to one of as many salts as there are partitions, under which the
    blocks lie too, so that no task gets all sequences. Intervals that begin after the end have no row. ordered sorts by header,
    stop, then the later start first, which takes another pass and shuffle.
    """
    every = normalised(intervals)
    count, size = every.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.coalesce("desc", F.lit(""))) + 32)).first()
    n = max(1, -(-count // BLOCK))
    one = n == 1 and (size or 0) <= BROADCAST
    blocks = every.groupBy(F.pmod(F.xxhash64("a", "b", "desc"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("a", "b", "desc")).alias("list"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")
    if one:
        pairs = seqs.select("header", "seq", every_block).join(F.broadcast(blocks), "block")
    else:
        salts = max(1, int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        spread = seqs.select("header", "seq", F.pmod(F.xxhash64("header"), F.lit(salts)).cast("int").alias("salt"), every_block)
        pairs = spread.join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["block", "salt"])
    pairs = pairs.select("header", "seq", F.explode("list").alias("i"))
    out = _extracted(pairs.select("header", "seq", "i.*"), fixed)
    label = F.concat(F.coalesce("desc", F.lit("")), F.lit(" "), F.col("a").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit(" "), F.col("header"))
    out = out.select("header", "desc", "a", "stop", F.ltrim(label).alias("label"), "piece")
    return out.orderBy("header", "stop", F.desc("a")) if ordered else out


def neighbourhoods(seqs: DataFrame, regions: DataFrame, fixed: bool = False) -> DataFrame:
    """(chrom, a, stop, desc, piece): the part of the sequence named chrom for each region (chrom, a, b, desc)."""
    named = seqs.select(S.record_id(F.col("header")).alias("chrom"), "seq")
    return _extracted(normalised(regions).join(named, "chrom"), fixed).select("chrom", "a", "stop", "desc", "piece")


def overlap_summary(a: DataFrame, b: DataFrame, width: int = 65_536, by_chr: bool = False) -> DataFrame:
    """Rows of a (row_idx, chr, start, stop) with n, m: rows of b that overlap and the places they share; u, v: rows of b
    that lie within and their places. Intervals are closed; those that end before they start overlap nothing. Chromosomes are
    compared only if by_chr.

    No pair is made for n and m: with running counts and sums over the starts and the ends of b, they follow from four
    look-ups, and so do u and v unless an interval of b can hold a row of a within it on both sides. These few kinds of
    pairs (b around a) are joined and taken off; rows of b that repeat are counted before.
    """
    keys = ["chr"] if by_chr else []
    left = a.where("start <= stop").select("row_idx", *keys, F.col("start").alias("a1"), F.col("stop").alias("a2"))
    right = b.where("start <= stop").groupBy(*keys, F.col("start").alias("b1"), F.col("stop").alias("b2")).agg(F.count(F.lit(1)).alias("times"))
    # What lies at or before x: rows, and the sums of their starts, ends and lengths, by their starts (s) and by their ends (e).
    size = F.col("b2") - F.col("b1") + 1
    events = right.select(*keys, F.explode(F.array(*[
        F.struct(F.col(x).alias("x"), F.lit(k).alias("kind"), F.col("times").alias("n"), (F.col(x) * F.col("times")).alias("at"), (size * F.col("times")).alias("size")) for x, k in (("b1", "s"), ("b2", "e"))
    ])).alias("e")).select(*keys, "e.*")
    marks = {"a2": F.col("a2"), "a1": F.col("a1") - 1}
    asked = left.select("row_idx", *keys, F.explode(F.array(*[F.struct(x.alias("x"), F.lit(k).alias("kind")) for k, x in marks.items()])).alias("q")).select("row_idx", *keys, "q.*")
    known = running(events, asked, {f"{c}{k}": F.when(F.col("kind") == k, F.col(c)) for c in ("n", "at", "size") for k in ("s", "e")}, width, keys)
    at = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = known.groupBy("row_idx").agg(*[at(c, k).alias(f"{k}_{c}") for c in ("ns", "ne", "ats", "ate", "sizes", "sizee") for k in marks])
    sums = left.join(wide, "row_idx")
    # Places of b up to x: (x + 1) times the starts, less their sum, less the same of those that have ended, an end being one further.
    places = lambda k, x: (x + 1) * F.col(f"{k}_ns") - F.col(f"{k}_ats") - (x * F.col(f"{k}_ne") - F.col(f"{k}_ate"))
    around = overlapping_around(left, right, keys)
    sums = sums.join(around, "row_idx", "left").fillna(0, ["over", "over_size"])
    sums = sums.select(
        "row_idx", (F.col("a2_ns") - F.col("a1_ne")).alias("n"), (places("a2", F.col("a2")) - places("a1", F.col("a1") - 1)).alias("m"),
        (F.col("a2_ne") - F.col("a1_ns") + F.col("over")).alias("u"), (F.col("a2_sizee") - F.col("a1_sizes") + F.col("over_size")).alias("v"),
    )
    return a.join(sums, "row_idx", "left").fillna(0, ["n", "m", "u", "v"])


def overlapping_around(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(row_idx, over, over_size): rows of right that begin before and end after a row of left, and their lengths.

    Such a row holds the place a1 - 1 and the next. Lengths are doubled up from class to class: an interval lies in the bins
    of its class that it touches, two at most, and a row of left asks each class that is there for the bin of its first place.
    """
    level = F.ceil(F.log2((F.col("b2") - F.col("b1") + 1).cast("double"))).cast("int")
    wide = right.withColumn("level", level)
    right_of = lambda x: F.call_function("shiftright", F.col(x), F.col("level"))
    bins = F.sequence(right_of("b1"), right_of("b2"))
    held = wide.withColumn("bin", F.explode(bins))
    levels = [r[0] for r in wide.select("level").distinct().orderBy("level").collect()]  # 63 at most
    if not levels:
        return left.select("row_idx", F.lit(0).cast("long").alias("over"), F.lit(0).cast("long").alias("over_size")).limit(0)
    asks = left.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where(F.col("a2") - F.col("a1") + 1 <= F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")))
    pairs = asks.withColumn("bin", right_of("a1")).join(held, [*keys, "level", "bin"]).where("b1 < a1 AND b2 > a2")
    return pairs.groupBy("row_idx").agg(F.sum("times").alias("over"), F.sum(F.col("times") * (F.col("b2") - F.col("b1") + 1)).alias("over_size"))


def alignment_end(pos: Column, cigar: Column, fixed: bool = False) -> Column:
    """The place after the last base (fixed: the last base)."""
    end = pos + S.cigar_length(cigar, fixed)
    return end - 1 if fixed else end


def alignments(sam: DataFrame, transcripts: DataFrame, invert: bool = False, width: int = 1024, fixed: bool = False) -> DataFrame:
    """Rows of sam (row_idx, rname, pos, cigar, ...) that overlap a transcript (chr, start, stop) of their chromosome, or
    (invert) that overlap none. The end of an alignment is taken as alignment_end() has it, inclusively.

    However many transcripts lie over a read, it meets one row, that of the bin it begins in, which holds what can reach a
    read of up to `width` places from there: one join, and rows of sam are not looked up again. Longer reads, such as spliced ones,
    are found by all their bins.
    """
    spans = transcripts.select(F.col("chr").alias("_chr"), F.col("start").alias("b1"), F.col("stop").alias("b2")).where("b1 <= b2")
    first, last = F.col("pos"), alignment_end(F.col("pos"), F.col("cigar"), fixed)
    reads = sam.withColumns({"_a1": first, "_a2": last})
    longest = reads.agg(F.max(F.col("_a2") - F.col("_a1"))).first()[0] or 0  # a pass over two columns
    short = reads if longest < width else reads.where(F.coalesce(F.col("_a2") - F.col("_a1") < width, F.lit(True)))
    short = short.withColumn("_bin", F.floor(F.col("_a1") / width))
    near = reach(spans, width, ["_chr"]).withColumnRenamed("bin", "_bin")
    low = F.col("_bin") * width
    met = F.coalesce(F.exists("held", lambda x: (x["from"] <= F.col("_a2") - low) & (x["to"] >= F.col("_a1") - low)) & (F.col("_a1") <= F.col("_a2")), F.lit(False))
    near = near.withColumnRenamed("_bin", "_b")
    one = short.join(near, (F.col("rname") == F.col("_chr")) & (F.col("_bin") == F.col("_b")), "left").where(~met if invert else met).select(sam.columns)
    if longest < width:
        return one
    long = reads.where(F.col("_a2") - F.col("_a1") >= width)
    asked = long.select("row_idx", F.col("rname").alias("_chr"), F.col("_a1").alias("a1"), F.col("_a2").alias("a2"))
    found = touching(asked, spans, width, ["_chr"]).select("row_idx").distinct()
    return one.unionByName(long.select(sam.columns).join(found, "row_idx", "left_anti" if invert else "left_semi"))
