"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import ann, lm_scoring, mixing, packing, quality_classifier, quality_rules, secrets, simhash, substring_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(_table(spark, sf_dir, "documents"), token_counts.masked_addresses).drop("edited_text")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32("ids").alias("ids_crc32")
    return packing.pack(_table(spark, sf_dir, "documents")).select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_token_counts, op3_nearest_neighbours, op4_quality_classifier, op5_secret_scan, op6_lm_scoring, op7_mixing, op8_packing,
        op9_simhash, op10_quality_rules,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM w),
k AS (SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS seq FROM s),
r AS (SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY doc_id, start) AS n FROM k) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, start + j AS pos FROM r, range(20) AS t(j)),
one AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM one ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP6 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
q AS (SELECT doc_id, unnest(words) AS c, unnest([NULL] || words[:-2]) AS b, unnest([NULL, NULL] || words[:-3]) AS a FROM w WHERE len(words) > 0),
p AS (SELECT * FROM q WHERE c IS NOT NULL),
d1 AS (SELECT doc_id, x, sum(k) OVER (PARTITION BY x) - k AS n FROM (SELECT doc_id, c AS x, count(*) AS k FROM p GROUP BY ALL)),
d2 AS (SELECT doc_id, x, y, sum(k) OVER (PARTITION BY x, y) - k AS n FROM (SELECT doc_id, b AS x, c AS y, count(*) AS k FROM p WHERE b IS NOT NULL GROUP BY ALL)),
d3 AS (SELECT doc_id, x, y, z, sum(k) OVER (PARTITION BY x, y, z) - k AS n FROM (SELECT doc_id, a AS x, b AS y, c AS z, count(*) AS k FROM p WHERE a IS NOT NULL GROUP BY ALL)),
total AS (SELECT doc_id, greatest(sum(len(words)) OVER () - len(words), 1)::DOUBLE AS n FROM w),
s AS (
  SELECT p.doc_id, CASE
    WHEN d3.n >= 1 THEN ln(d3.n::DOUBLE / ctx.n)
    ELSE (CASE WHEN a IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END) + CASE
      WHEN d2.n >= 1 THEN ln(d2.n::DOUBLE / one.n)
      ELSE (CASE WHEN b IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END) + ln((CASE WHEN d1.n > 0 THEN d1.n ELSE 0.4 END)::DOUBLE / total.n) END END AS l
  FROM p JOIN total ON total.doc_id = p.doc_id JOIN d1 ON d1.doc_id = p.doc_id AND d1.x = c LEFT JOIN d1 AS one ON one.doc_id = p.doc_id AND one.x = b
  LEFT JOIN d2 ON d2.doc_id = p.doc_id AND d2.x = b AND d2.y = c LEFT JOIN d2 AS ctx ON ctx.doc_id = p.doc_id AND ctx.x = a AND ctx.y = b
  LEFT JOIN d3 ON d3.doc_id = p.doc_id AND d3.x = a AND d3.y = b AND d3.z = c)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, round(coalesce(l, 0), 4) AS log_score, round(l / len(w.words), 4) AS mean_log_score
FROM w LEFT JOIN (SELECT doc_id, sum(l) AS l FROM s GROUP BY doc_id) USING (doc_id)
"""


def _op10() -> str:
    ladders, limit, error = quality_rules.LADDERS, 0.05, 0.05
    share = {
        "symbol_share": "n_symbols / greatest(word_chars, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_share": "n_repeat_words / greatest(n_words, 1)", "mean_word_chars": "word_chars / greatest(n_words, 1)",
    }
    rate = limit / len(ladders)
    steps = " UNION ALL ".join(f"SELECT '{m}' AS m, {c} AS c" for m, ladder in ladders.items() for c in ladder)
    value = "CASE m " + " ".join(f"WHEN '{m}' THEN {m}" for m in ladders) + " END"
    bounds = ", ".join(f"max(CASE WHEN m = '{m}' THEN cut END) AS max_{m}" for m in ladders)
    above = " OR ".join(f"coalesce({m} > max_{m}, false)" for m in ladders)
    return rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
k AS (SELECT doc_id, start, array_to_string(words[start:start + 7], ' ') AS seq FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS start FROM w)),
r AS (SELECT doc_id, start FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, seq) AS n FROM k) WHERE n > 1),
g AS (SELECT doc_id, count(DISTINCT start + j) AS n FROM r, range(8) AS t(j) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(g.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN g USING (doc_id)),
v AS (SELECT *, {", ".join(f"{e} AS {m}" for m, e in share.items())} FROM f),
steps AS ({steps}),
held AS (SELECT * FROM v WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
lost AS (SELECT lang, m, c, count(*) AS n, count_if({value} > c)::BIGINT AS k FROM held, steps GROUP BY ALL),
level AS (SELECT {error} / (count(DISTINCT coalesce(lang, '')) * {len(ladders)}) AS e FROM held),
cuts AS (SELECT lang, m, min(c) AS cut FROM lost, level WHERE k < n * {rate} AND
  list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate}::DOUBLE) + (n - j) * ln(1 - {rate}::DOUBLE)))) <= e GROUP BY ALL),
b AS (SELECT lang AS of, {bounds} FROM cuts GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT ({above}) AS kept
FROM v LEFT JOIN b ON v.lang IS NOT DISTINCT FROM b.of
"""


ORACLES: dict[str, str] = {"op1_substring_dedup": _OP1, "op6_lm_scoring": _OP6, "op10_quality_rules": _op10()}
