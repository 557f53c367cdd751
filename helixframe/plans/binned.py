"""Interval joins as equi-joins.

Both sides are spread over bins of fixed width and meet by bin, so that Spark can shuffle, sort and split skewed bins as
for any equi-join. Counts and sums need no pairs: they are differences of running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def binned(df: DataFrame, start: str, stop: str, width: int) -> DataFrame:
    """A row for each bin that [start, stop] touches; rows that end before they start touch none."""
    first, last = F.floor(F.col(start) / width), F.floor(F.col(stop) / width)
    return df.where(F.col(start) <= F.col(stop)).withColumn("bin", F.explode(F.sequence(first, last)))


def running(events: DataFrame, asked: DataFrame, sums: dict[str, Column], width: int, keys: list[str]) -> DataFrame:
    """The rows of asked (row_idx, keys, x, kind) with sums over the events (keys, x, kind, ...) at x or before.

    Events and questions meet by bin, where a window adds up; what lies in the bins before is a window over bins.
    """
    totals = list(sums)
    both = events.select(*keys, "x", "kind", F.lit(None).cast("long").alias("row_idx"), *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in sums.items()]).unionByName(
        asked.select(*keys, "x", "kind", "row_idx", *[F.lit(0).cast("long").alias(n) for n in totals])
    )
    both = both.withColumn("bin", F.floor(F.col("x") / width))
    within = W.partitionBy(*keys, "bin").orderBy("x").rangeBetween(W.unboundedPreceding, 0)
    local = both.select(*keys, "bin", "kind", "row_idx", *[F.sum(n).over(within).alias(n) for n in totals]).where("row_idx IS NOT NULL")
    bins = both.groupBy(*keys, "bin").agg(*[F.sum(n).alias(n) for n in totals])
    before = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # over bins of one chromosome
    bins = bins.select(*keys, "bin", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    return local.join(bins, [*keys, "bin"]).select("row_idx", "kind", *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in totals])


def reach(b: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """(keys, bin, held): for each bin what intervals [b1, b2] can meet an interval that begins in the bin and goes on for
    `width` places at most. Of those that begin at the same place the longest stands for all, so a list has 2 * `width` pairs at most."""
    low = F.col("bin") * width
    spread = b.withColumn("_b0", F.col("b1") - width)
    clipped = binned(spread, "_b0", "b2", width).groupBy(*keys, "bin", F.greatest(F.col("b1") - low, F.lit(0)).alias("from")).agg(F.max(F.least(F.col("b2") - low, F.lit(width - 1))).alias("to"))
    return clipped.groupBy(*keys, "bin").agg(F.collect_list(F.struct("from", "to")).alias("held"))


def touching(a: DataFrame, b: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """Rows of a, once for each bin in which they share a place with an interval of b.

    Intervals of b are clipped to their bins, and of those that begin at the same place in a bin the longest stands for
    all, so a bin is one row with a list of `width` pairs at most, and no row of a is paired with more than its own bins.
    """
    keys = keys or []
    low = F.col("bin") * width
    clipped = binned(b, "b1", "b2", width).groupBy(*keys, "bin", F.greatest(F.col("b1") - low, F.lit(0)).alias("from")).agg(F.max(F.least(F.col("b2") - low, F.lit(width - 1))).alias("to"))
    bins = clipped.groupBy(*keys, "bin").agg(F.collect_list(F.struct("from", "to")).alias("held"))
    met = F.exists("held", lambda x: (x["from"] <= F.col("a2") - low) & (x["to"] >= F.col("a1") - low))
    return binned(a, "a1", "a2", width).join(bins, ["bin", *keys]).where(met).drop("held", "bin")
