"""Quality rules with risk-controlled cutoffs; DataFrame functions only.

Besides fixed base rules, each of some measures has a ladder of cutoffs, from lenient to strict. The labelled holdout
of a stratum (documents labelled good) tells how many good documents each cutoff would reject. A cutoff is allowed if,
were its true false-rejection rate above the limit, so few rejections would be seen with probability `error` at most
(the exact binomial tail). The limit of a stratum is shared out among its measures, and `error` among all pairs of stratum
and measure (Bonferroni); along a ladder the tails only grow, so testing in order from lenient to strict needs no
further correction. With probability 1 - error no stratum loses more than its limit of good documents to these cutoffs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import cut

_WHITE = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
WINDOW = 8
#: Measures, and cutoffs from lenient to strict; a document is rejected above the cutoff.
LADDERS = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "repeat_share": (0.9, 0.7, 0.5, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02),
    "mean_word_chars": (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0),
}


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) for each row of docs.

    Null texts are empty; n_lines counts lines with a word. Windows are compared by a 64-bit hash of their words' hashes,
    within one text. One projection after another over each row: nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
    first = base.select(
        "doc_id", "stratum",
        F.filter(F.split("text", _WHITE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "").alias("lines"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    second = first.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    window = lambda _, i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])
    third = second.withColumn("windows", F.transform(F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))), window)).drop("hashes")
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Rows without a repeated window, nearly all, skip the sort.
    fourth = third.withColumn("placed", F.when(repeated, placed)).drop("windows")
    at = lambda j: F.get("placed", j)["h"]
    again = F.filter("placed", lambda s, j: F.coalesce(at(j - 1) == s["h"], F.lit(False)) | F.coalesce(at(j + 1) == s["h"], F.lit(False)))
    starts = F.sort_array(F.transform(again, lambda s: s["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    return fourth.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _shares(measured: DataFrame) -> DataFrame:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    return measured.select(
        "*", share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("word_chars", "n_words").alias("mean_word_chars"),
    )


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of n trials, exactly, in logarithms; 1 where k is at or above the mean."""
    odds = math.log(rate / (1 - rate))
    first = n * F.lit(math.log1p(-rate))

    def grown(a: Column, j: Column) -> Column:
        term = a["term"] + F.ln((n - j + 1) / j) + F.lit(odds)
        more = F.greatest(a["total"], term) + F.log1p(F.exp(-F.abs(a["total"] - term)))
        return F.struct(term.alias("term"), more.alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), grown, lambda a: F.exp(a["total"]))
    return F.when(k >= n * F.lit(rate), F.lit(1.0)).otherwise(tail)


def cutoffs(measured: DataFrame, labels: DataFrame, limit: float = 0.05, error: float = 0.05, ladders: dict[str, tuple[float, ...]] = LADDERS) -> DataFrame:
    """(stratum, a column for each measure): the strictest allowed cutoff, or null if none is."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held_out = _shares(measured).join(good, "doc_id", "left_semi")
    lost = {f"{m}_{k}": F.count_if(F.col(m) > c) for m, ladder in ladders.items() for k, c in enumerate(ladder)}
    counts = held_out.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in lost.items()])
    # Over strata, not documents.
    share = F.lit(error) / (F.count(F.lit(1)).over(W.partitionBy()) * F.lit(len(ladders)))
    rows = counts.withColumn("level", share)
    rate = limit / len(ladders)

    def strictest(m: str) -> Column:
        allowed = [F.when(binomial_tail(F.col(f"{m}_{k}"), F.col("n"), rate) <= F.col("level"), F.lit(c)) for k, c in enumerate(ladders[m])]
        return F.least(*allowed)  # nulls are passed over

    return rows.select("stratum", *[strictest(m).alias(f"max_{m}") for m in ladders])


def judge(docs: DataFrame, labels: DataFrame, limit: float = 0.05, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The measures of each row of docs, base_failed and kept.

    base_failed: under 20 words, or over 30 % of them in repeated windows of 8. kept is false if base_failed, or if a
    measure is above its stratum's cutoff. A null stratum is a stratum of its own. Strata without enough labelled good
    documents have no cutoffs, so that only the base rules hold there. Labels of unknown documents, labels without
    quality and repeated labels change nothing; neither do other columns. Rows that repeat an id are judged each. An
    empty table gives an empty result.
    """
    measured = cut(measures(docs, id_col, text_col, stratum_col))
    bounds = cut(cutoffs(measured, labels, limit, error)).withColumnRenamed("stratum", "of")
    rows = _shares(measured).join(bounds, F.col("stratum").eqNullSafe(F.col("of")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    above = [F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False)) for m in LADDERS]
    verdict = ~failed
    for a in above:
        verdict = verdict & ~a
    return rows.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), verdict.alias("kept"))
