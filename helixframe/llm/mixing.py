"""Mixing sources to target weights, by pivotal dependent rounding.

Every document of a source should be copied target / source_size times. The whole part is copied; the fractional part
is a probability. Two documents' probabilities are paired and mass (probability times size) moves from one to the other
at random until one of them is 0 or 1, which keeps the source's expected size to the word. A group of documents ends
with one fractional document; those are paired in turn, in groups of groups, up a reduction tree with one document of
each source at the top. Rows that agree in id, source and size are one entry of the tree: of m such rows of probability p
pivoting leaves floor(m p) with 1 and one with the fraction, and only the fraction meets others. So leaves hold different
documents, evenly dealt by hash, whatever is repeated.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import cut

#: Documents of a leaf of the reduction tree, and children of its inner nodes.
LEAF, FAN = 1000, 256
ROUNDED = "row_key string, doc_id long, source string, leaf long, size long, n_rows long, copies long, p double"
#: Equal rows that a task writes out at a time.
CHUNK = 10_000


def size_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): words of each text; null: 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target), a row for each source of sized (source, size, n_rows); n_docs counts its rows.

    Targets are in proportion to the weights but for those at their cap, most * source_size; what the caps cut off goes
    to the others. With sources in ascending order of cap / weight, the first k are capped for the least k at which
    the next one's share is under its cap.
    """
    words, entries = (F.col("size") * F.col("n_rows"), F.count(F.lit(1)))
    by_source = sized.groupBy("source").agg(F.sum(words).alias("source_size"), entries.alias("n_docs"))
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))  # over sources, not over documents
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = by_source.select("*", F.element_at(cycle, (F.pmod(number - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    unit = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("unit", unit)
    first = F.first(F.when(F.col("unit") * F.col("weight") <= F.col("cap"), F.col("unit")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.select("source", "source_size", "n_docs", F.when(first.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), first * F.col("weight"))).alias("target"))


def chance(*of: object) -> float:
    """A number from 0 to 1 that depends on nothing but its arguments."""
    return (xxhash.xxh64_intdigest(repr(of), 7) >> 11) / (1 << 53)


def pivot(rows: list[list], seed: int, last: bool) -> None:
    """rows: [key, size, copies, p]. Sets copies and, but for one row at most, p to None; with last for that row too."""
    held = None
    for row in rows:
        key, size, _, p = row
        if p is None:
            continue
        if size == 0 or p <= 1e-12 or p >= 1 - 1e-12:  # without words, nothing to keep in balance
            row[2], row[3] = row[2] + int(p >= 1 - 1e-12 or (size == 0 and chance(seed, key) < p)), None
            continue
        if held is None:
            held = row
            continue
        up = min((1 - held[3]) * held[1], p * size)  # mass that can move to the held one, and from it
        down = min(held[3] * held[1], (1 - p) * size)
        move = up if chance(seed, held[0], key) * (up + down) < down else -down
        held[3] += move / held[1]
        row[3] -= move / size
        for x in (held, row):
            if x[3] <= 1e-12 or x[3] >= 1 - 1e-12:
                x[2], x[3] = x[2] + int(x[3] >= 0.5), None
        held = held if held[3] is not None else row if row[3] is not None else None
    if held is not None and last:
        held[2], held[3] = held[2] + int(held[3] >= 0.5), None  # the nearer way: half a document off at most


def _rounded(seed: int, last: bool):  # noqa: ANN202
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row_key", "doc_id", "size"], kind="stable")
        p = group["p"].tolist()
        rows = [[k, s, c, None if x != x else x] for k, s, c, x in zip(group["row_key"].tolist(), group["size"].tolist(), group["copies"].tolist(), p, strict=True)]
        pivot(rows, seed, last)
        return group.assign(copies=[r[2] for r in rows], p=pd.array([r[3] for r in rows], "Float64"))

    return run


def shares(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, n_rows, copies): a row for the n_rows rows of docs that agree in id, source
    and size, and how often the mix holds them all together; edge cases as in mix()."""
    sized = cut(sizes(docs, id_col, text_col, source_col).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")))
    by_source = cut(targets(sized, weights, share, most))
    deepest = by_source.agg(F.max(F.ceil(F.col("n_docs") / LEAF))).first()[0] or 1
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    key = F.hex(F.xxhash64("doc_id", "size", F.lit(seed)))
    due = (rate - F.floor(rate)) * F.col("n_rows")
    # Leaves of a source hold about LEAF entries, whatever the size of the source; AQE broadcasts or splits this join.
    placed = sized.join(by_source, sized["source"].eqNullSafe(by_source["source"])).select(
        key.alias("row_key"), "doc_id", sized["source"], F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1)), F.ceil(F.col("n_docs") / LEAF)).alias("leaf"), "size", "n_rows",
        (F.floor(rate) * F.col("n_rows") + F.floor(due)).alias("copies"), (due - F.floor(due)).alias("p"),
    )
    done, open_ = None, placed
    while True:
        last = deepest <= 1
        now = cut(open_.groupBy("source", "leaf").applyInPandas(_rounded(seed, last), ROUNDED))
        ended = now.where("p IS NULL")
        done = ended if done is None else done.unionByName(ended)
        if last:
            break
        open_, deepest = now.where("p IS NOT NULL").withColumn("leaf", F.floor(F.col("leaf") / FAN)), -(-deepest // FAN)
    out = done.join(by_source, done["source"].eqNullSafe(by_source["source"]))
    return out.select("doc_id", done["source"], "size", "source_size", "target", "n_rows", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix holds each document.

    A row for each row of docs. A null text has size 0; a null source is a source of its own, last in order; sources
    without words have target 0. Rows that agree in id, source and size share their copies as evenly as can be. Reruns
    agree on any cluster: leaves go by a hash of id and size, and random numbers hash the documents they decide on.
    Other columns are ignored. An empty table gives an empty result.
    """
    found = shares(docs, weights, share, most, seed, id_col, text_col, source_col)
    base, more = F.floor(F.col("copies") / F.col("n_rows")), F.pmod("copies", "n_rows")
    # Of each entry, `more` rows with one copy above the rest; in chunks, so that many equal rows are not one list.
    rows = found.withColumn("r", F.explode(F.array(F.struct(more.alias("n"), (base + 1).alias("each")), F.struct((F.col("n_rows") - more).alias("n"), base.alias("each")))))
    chunks = rows.where("r.n > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r.n") - 1, F.lit(CHUNK).cast("long"))))
    each = chunks.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK), F.col("r.n") - F.col("at")))))
    return each.select("doc_id", "source", "size", "source_size", "target", F.col("r.each").alias("copies"), (F.col("r.each") * F.col("size")).alias("taken"))


def copied(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: float) -> DataFrame:
    """The rows of docs, each as often as the mix holds it; edge cases as in mix(). Of rows that agree in id, source and size
    those with the least hash of all columns get the odd copies. Any column names will do."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no name clashes
    plain = docs.toDF(*names).select(*names, *[F.col(names[docs.columns.index(c)]).cast(t).alias(n) for c, t, n in ((id_col, "long", "i"), (source_col, "string", "s"))], size_of(F.col(names[docs.columns.index(text_col)])).alias("z"))
    found = shares(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0").select("doc_id", "source", "size", "n_rows", "copies")
    same = F.col("i").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size"))
    held = plain.join(found, same).drop("doc_id", "source", "size")
    alone = held.where("n_rows = 1").withColumn("times", F.col("copies")).select(*names, "times")
    rank = F.row_number().over(W.partitionBy("i", "s", "z").orderBy(F.xxhash64(*names)))
    ranked = held.where("n_rows > 1").withColumn("k", rank)
    again = ranked.withColumn("times", F.floor(F.col("copies") / F.col("n_rows")) + F.when(F.col("k") <= F.pmod("copies", "n_rows"), 1).otherwise(0)).select(*names, "times")
    rows = alone.unionByName(again).where("times > 0").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))))
    return rows.select(*names).toDF(*docs.columns)
