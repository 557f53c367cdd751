"""Registered queries of the library, and DuckDB SQL for the same results.

The tables hold no sequences, so documents stand for them: the letters A, C, G, T and N of a text, in upper case, are a
sequence; other tables give intervals, reads and links.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.functions.alphabet import CODE, COMPLEMENT_FROM, COMPLEMENT_TO
from helixframe.operators import graph, intervals, search, selection, statistics, transforms
from helixframe.plans.checkpoints import cut, removed, shared_folder
from helixframe.sources import readers, writers

FLAGSHIP = "orfs"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_DNA = """WITH dna AS (SELECT doc_id + 1 AS seq_idx, 'doc' || doc_id || ' ' || lang || ' ' || source AS header,
  upper(regexp_replace(coalesce(text, ''), '[^ACGTNacgtn]', '', 'g')) AS seq, source AS path FROM documents)"""


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    header = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"), F.lit(" "), F.col("source"))
    seq = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTNacgtn]", ""))
    return docs.select((F.col("doc_id") + 1).alias("seq_idx"), header.alias("header"), seq.alias("seq"), F.col("source").alias("path"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, view: bool = True) -> Callable:
    """Register a query; sql follows the view of sequences unless view is False."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"{_DNA}{sql}" if view else sql
        return f

    return add


def on_dna(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, sf_dir: f(dna(spark, sf_dir)))


_RC = f"translate(reverse({{}}), '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}')"
_IDX = " seq_idx::BIGINT AS seq_idx"
_PCT = "round({0}, 6) AS {1}"

# Lengths and composition
on_dna("numseqs", " SELECT count(*)::BIGINT AS n_seqs FROM dna", statistics.count_sequences)
on_dna("seq_len", f" SELECT {_IDX}, header, length(seq)::BIGINT AS length FROM dna", statistics.lengths)
on_dna("seq_len_total", " SELECT sum(length(seq))::BIGINT AS length FROM dna", statistics.total_length)
on_dna("seq_len_by_file", " SELECT path, sum(length(seq))::BIGINT AS length FROM dna GROUP BY path", lambda d: statistics.total_length(d, ["path"]))
_base = " UNION ALL ".join(f"SELECT seq_idx, header, '{c}' AS base, length(seq) - length(replace(seq, '{c}', '')) AS n FROM dna" for c in "ACGTN")
_sums = f", b AS ({_base}), s AS (SELECT base, sum(n)::BIGINT AS n FROM b GROUP BY base)"
on_dna(
    "nt_counts", f"{_sums}, t AS (SELECT sum(n)::BIGINT AS total FROM s) SELECT base, n, total, round(100.0::DOUBLE * n / total, 6) AS pct FROM s, t",
    lambda d: statistics.composition(d, "sum").withColumn("pct", F.round("pct", 6)),
)
on_dna(
    "nt_each",
    f"{_sums}, e AS (SELECT unnest(['M','R','W','S','Y','K','V','H','D','B','X']) AS base, 0::BIGINT AS n), x AS (SELECT * FROM s UNION ALL SELECT * FROM e) SELECT base, n FROM x",
    lambda d: statistics.composition(d, "each").select("base", "n"),
)
on_dna(
    "nt_by_seq",
    f", b AS ({_base}), t AS (SELECT seq_idx, sum(n) AS total FROM b WHERE base <> 'N' GROUP BY seq_idx) SELECT {_IDX}, header, base, n::BIGINT AS n, total::BIGINT AS total, "
    "round(CASE WHEN total > 0 THEN 100.0::DOUBLE * n / total ELSE -1 END, 6) AS pct FROM b JOIN t USING (seq_idx) WHERE base <> 'N'",
    lambda d: statistics.composition(d, by_sequence=True).withColumn("pct", F.round("pct", 6)),
)
on_dna(
    "gc_content",
    f"{_sums}, p AS (SELECT CASE WHEN base IN ('G', 'C') THEN 'G/C' ELSE 'A/T' END AS base, sum(n)::BIGINT AS n FROM s WHERE base <> 'N' GROUP BY 1), "
    "t AS (SELECT sum(n) AS total FROM p) SELECT base, n, round(100.0::DOUBLE * n / total, 6) AS pct FROM p, t",
    lambda d: statistics.composition(d, pairs=True).select("base", "n", F.round("pct", 6).alias("pct")),
)

# Words
_words = lambda k: f"SELECT seq_idx, header, i - 1 AS pos, substr(seq, i, {k}) AS w FROM (SELECT *, unnest(range(1, length(seq) - {k - 2})) AS i FROM dna)"
_letters = lambda k: f"SELECT * FROM ({_words(k)}) WHERE regexp_full_match(w, '[ACGT]+')"
_every = lambda k: " || ".join(f"substr('ACGT', ((i // {4**j}) % 4)::BIGINT + 1, 1)" for j in reversed(range(k)))
on_dna(
    "kmers_k3",
    f", c AS (SELECT w, count(*) AS n FROM ({_letters(3)}) GROUP BY w), t AS (SELECT sum(n) AS total FROM c), "
    f"e AS (SELECT {_every(3)} AS kmer FROM range(64) AS r(i)), x AS (SELECT kmer, {_RC.format('kmer')} AS rc FROM e) "
    "SELECT kmer, rc, coalesce(f.n, 0)::BIGINT AS fwd, coalesce(r.n, 0)::BIGINT AS rev, (coalesce(f.n, 0) + coalesce(r.n, 0))::BIGINT AS \"both\", "
    "round(100.0::DOUBLE * coalesce(f.n, 0) / total, 6) AS fwd_pct, round(50.0::DOUBLE * (coalesce(f.n, 0) + coalesce(r.n, 0)) / total, 6) AS avg_pct "
    "FROM x CROSS JOIN t LEFT JOIN c AS f ON f.w = kmer LEFT JOIN c AS r ON r.w = rc",
    lambda d: statistics.kmers(d, 3).select("kmer", "rc", "fwd", "rev", "both", F.round("fwd_pct", 6).alias("fwd_pct"), F.round("avg_pct", 6).alias("avg_pct")),
)
on_dna(
    "kmers_by_seq",
    f", c AS (SELECT seq_idx, w, count(*) AS n FROM ({_letters(2)}) GROUP BY ALL), x AS (SELECT seq_idx, w FROM c UNION SELECT seq_idx, {_RC.format('w')} FROM c) "
    f"SELECT x.seq_idx, x.w AS kmer, coalesce(f.n, 0)::BIGINT AS fwd, coalesce(r.n, 0)::BIGINT AS rev FROM x LEFT JOIN c AS f USING (seq_idx, w) "
    f"LEFT JOIN c AS r ON r.seq_idx = x.seq_idx AND r.w = {_RC.format('x.w')}",
    lambda d: statistics.kmers(d, 2, by_sequence=True, dense=False).select("seq_idx", "kmer", "fwd", "rev"),
)
on_dna(
    "ngrams_k3", f", c AS (SELECT w AS ngram, count(*) AS n FROM ({_words(3)}) GROUP BY w), t AS (SELECT sum(n) AS total FROM c) SELECT ngram, n::BIGINT AS n, round(100.0::DOUBLE * n / total, 6) AS pct FROM c, t",
    lambda d: statistics.ngrams(d, 3).withColumn("pct", F.round("pct", 6)),
)
_frames = ", ".join(f"count_if(pos % 3 = {f})::BIGINT AS f{f}" for f in range(3))
on_dna("kmers_by_frame", f" SELECT w AS kmer, {_frames} FROM ({_words(3)}) GROUP BY w", statistics.kmers_by_frame)
_shares = ", ".join(f"round(100.0::DOUBLE * count_if(pos % 3 = {f}) / count(*), 6) AS f{f}" for f in range(3))
on_dna("kmers_by_frame_pct", f" SELECT w AS kmer, {_shares} FROM ({_words(3)}) GROUP BY w", lambda d: statistics.kmers_by_frame(d, percent=True).select("kmer", *[F.round(f"f{f}", 6).alias(f"f{f}") for f in range(3)]))
_code = "code(codon, aa) AS (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in CODE.items()) + ")"
on_dna(
    "codon_freqs",
    f", {_code}, c AS (SELECT w, count(*) AS n FROM ({_words(3)}) WHERE pos % 3 = 0 GROUP BY w), j AS (SELECT aa, codon, coalesce(n, 0)::BIGINT AS n FROM code LEFT JOIN c ON w = codon) "
    "SELECT aa, codon, n, round(100.0::DOUBLE * n / nullif(sum(n) OVER (), 0), 6) AS pct, round(100.0::DOUBLE * n / nullif(sum(n) OVER (PARTITION BY aa), 0), 6) AS aa_pct FROM j",
    lambda d: statistics.codon_frequencies(d).select("aa", "codon", "n", F.round("pct", 6).alias("pct"), F.round("aa_pct", 6).alias("aa_pct")),
)
query("kmer_codes", f"SELECT i::BIGINT AS id, {_every(4)} AS kmer, i::BIGINT AS code FROM range(256) AS r(i)", view=False)(
    lambda spark, _: spark.range(256).select("id", S.decoded(F.col("id"), 4).alias("kmer")).withColumn("code", S.encoded(F.col("kmer"), 4))
)

# One record in, one out
on_dna("rc", f" SELECT {_IDX}, header || ' rc' AS header, {_RC.format('seq')} AS seq FROM dna", lambda d: transforms.reverse_complements(d, " rc").select("seq_idx", "header", "seq"))
on_dna("complement_strict", f" SELECT {_IDX}, translate(seq, 'ACGT', 'TGCA') AS seq FROM dna", lambda d: d.select("seq_idx", S.strict_complement(F.col("seq")).alias("seq")))
_strands = f", st AS (SELECT seq_idx, header, seq AS t, 'F' AS d FROM dna UNION ALL SELECT seq_idx, header, {_RC.format('seq')}, 'R' FROM dna), fr AS (SELECT *, d || (o + 1) AS frame FROM st, range(3) AS r(o))"
_codons = f"{_strands}, {_code}, cd AS (SELECT seq_idx, header, frame, t, o, k, substr(t, (o + 1 + 3 * k)::BIGINT, 3) AS c FROM (SELECT *, unnest(range(greatest(0, (length(t) - o) // 3))) AS k FROM fr))"
on_dna(
    "translate_all",
    f"{_codons}, p AS (SELECT seq_idx, frame, string_agg(coalesce(aa, 'X'), '' ORDER BY k) AS seq FROM cd LEFT JOIN code ON c = codon GROUP BY ALL) "
    "SELECT fr.seq_idx::BIGINT AS seq_idx, fr.header || '-' || fr.frame AS header, coalesce(p.seq, '') AS seq FROM fr LEFT JOIN p USING (seq_idx, frame)",
    lambda d: transforms.translations(d, "all").select("seq_idx", "header", "seq"),
)
on_dna("truncseq", f" SELECT {_IDX}, header || ' Trunc:10:25' AS header, substr(seq, 11, 25) AS seq FROM dna", lambda d: transforms.truncated(d, 10, 25, comment=True).select("seq_idx", "header", "seq"))
on_dna(
    "truncseq_neg", f" SELECT {_IDX}, CASE WHEN length(seq) > 4 THEN substr(seq, greatest(length(seq) - 30, 0) + 1, length(seq) - 4 - greatest(length(seq) - 30, 0)) ELSE '' END AS seq FROM dna",
    lambda d: transforms.truncated(d, -30, -4).select("seq_idx", "seq"),
)
on_dna("fasta2md5", f" SELECT {_IDX}, md5(seq) AS md5, header FROM dna WHERE seq <> ''", lambda d: transforms.digests(d).drop("seq"))
on_dna("fasta2md5_b64", f" SELECT {_IDX}, rtrim(base64(unhex(md5(seq))), '=') AS md5 FROM dna WHERE seq <> ''", lambda d: transforms.digests(d, base64=True).select("seq_idx", "md5"))
on_dna("bisulfite", f" SELECT {_IDX}, replace(seq, 'C', 'T') AS seq FROM dna", lambda d: transforms.bisulfite_converted(d).select("seq_idx", "seq"))
_wrap = lambda w: f"rtrim(regexp_replace(seq, '(.{{{w}}})', '\\1' || chr(10), 'g'), chr(10))"
on_dna("fasta_wrap", f" SELECT {_IDX}, '>' || header || CASE WHEN seq <> '' THEN chr(10) || {_wrap(60)} ELSE '' END AS record FROM dna", lambda d: d.select("seq_idx", S.fasta(F.col("header"), F.col("seq")).alias("record")))
on_dna("one_line_fasta", f" SELECT {_IDX}, '>' || header || CASE WHEN seq <> '' THEN chr(10) || seq ELSE '' END AS record FROM dna", lambda d: d.select("seq_idx", S.fasta(F.col("header"), F.col("seq"), None).alias("record")))
on_dna(
    "pp",
    f", l AS (SELECT seq_idx, j, substr(seq, (50 * j + 1)::BIGINT, 50) AS part FROM (SELECT *, unnest(range((length(seq) + 49) // 50)) AS j FROM dna)), "
    "t AS (SELECT seq_idx, string_agg(printf('%10d ', (50 * j + 1)::BIGINT) || CASE WHEN length(part) = 50 THEN rtrim(regexp_replace(part, '(.{10})', '\\1 ', 'g')) ELSE regexp_replace(part, '(.{10})', '\\1 ', 'g') END, chr(10) ORDER BY j) AS body FROM l GROUP BY seq_idx) "
    "SELECT dna.seq_idx::BIGINT AS seq_idx, '>' || header || chr(10) || coalesce(body, '         1') AS record FROM dna LEFT JOIN t USING (seq_idx)",
    lambda d: d.select("seq_idx", S.pretty(F.col("header"), F.col("seq")).alias("record")),
)

# Filters
_all = lambda d: d.select("seq_idx", "header", "seq")
_cols = f"{_IDX}, header, seq"
on_dna("sel_len", f" SELECT {_cols} FROM dna WHERE length(seq) BETWEEN 100 AND 400", lambda d: _all(selection.select_sequences(d, 100, 400)))
on_dna("sel_header", f" SELECT {_cols} FROM dna WHERE regexp_matches(header, '(?i)DE SRC1\\d*$')", lambda d: _all(selection.select_sequences(d, header="DE SRC1\\d*$")))
on_dna("sel_seq_regex", f" SELECT {_cols} FROM dna WHERE regexp_matches(seq, '(?i)gat+aca')", lambda d: _all(selection.select_sequences(d, sequence="gat+aca")))
on_dna("sel_limit", f" SELECT {_cols} FROM dna WHERE seq_idx >= 20 AND length(seq) >= 50 ORDER BY seq_idx LIMIT 25", lambda d: _all(selection.select_sequences(d, 50, begin=20, limit=25)))
on_dna(
    "sel_highlight", f" SELECT {_IDX}, lower(substr(seq, 1, strpos(seq, 'ATTA') - 1)) || 'ATTA' || lower(substr(seq, strpos(seq, 'ATTA') + 4)) AS seq FROM dna WHERE seq LIKE '%ATTA%'",
    lambda d: selection.select_sequences(d, sequence="atta", highlight=True).select("seq_idx", "seq"),
)
on_dna("seq_range", f" SELECT {_cols} FROM dna WHERE seq_idx BETWEEN 11 AND 40", lambda d: _all(selection.sequence_range(d, 11, 30)))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"))


_listed = "IN (SELECT doc_id + 1 FROM labels WHERE quality = 1)"
query("extract_ids", f" SELECT {_cols} FROM dna WHERE seq_idx {_listed}")(lambda s, d: _all(selection.by_ids(dna(s, d), _ids(s, d))))
query("extract_ids_inverse", f" SELECT {_cols} FROM dna WHERE seq_idx NOT {_listed}")(lambda s, d: _all(selection.by_ids(dna(s, d), _ids(s, d), invert=True)))
query("extract_ids_unique", f" SELECT {_cols} FROM dna WHERE seq_idx {_listed}")(
    lambda s, d: _all(selection.by_ids(dna(s, d).unionByName(dna(s, d).withColumn("seq_idx", F.col("seq_idx") + 10**9)), _ids(s, d), unique=True))
)
on_dna("fasta_chunker", f" SELECT {_IDX}, (ntile(7) OVER (ORDER BY seq_idx) - 1)::INTEGER AS chunk FROM dna", lambda d: selection.chunks(d, 7).select("seq_idx", "chunk"))
on_dna(
    "splt_names", " SELECT split_part(header, ' ', 3) || '.fa' AS fname, max(seq_idx)::BIGINT AS seq_idx FROM dna GROUP BY 1",
    lambda d: selection.split_names(d, " ", 2, "fa").select("fname", "seq_idx"),
)

# Searches
_marks = f"{_codons}, mk AS (SELECT *, c IN ('TAA', 'TAG', 'TGA') AS stop, c IN ('ATG', 'GTG', 'TTG') AS start FROM cd), sg AS (SELECT *, sum(stop::INT) OVER (PARTITION BY seq_idx, frame ORDER BY k) - stop::INT AS s FROM mk), "
_orf = (
    _marks + "og AS (SELECT seq_idx, header, frame, any_value(t) AS t, any_value(o) AS o, min(CASE WHEN start THEN k END) AS a, max(CASE WHEN stop THEN k END) AS b FROM sg GROUP BY seq_idx, header, frame, s), "
    "ox AS (SELECT *, o + 3 * a AS p, 3 * (b - a) AS n FROM og WHERE a IS NOT NULL AND b IS NOT NULL) "
    "SELECT seq_idx::BIGINT AS seq_idx, header, frame, p::INTEGER AS start, (CASE WHEN frame[1] = 'F' THEN p + 1 ELSE length(t) - (p + n) + 1 END)::INTEGER AS position, n::INTEGER AS length, "
    "substr(t, (p + 1)::BIGINT, 3) AS start_codon, substr(t, (p + n + 1)::BIGINT, 3) AS stop_codon, substr(t, (p + 1)::BIGINT, n::BIGINT) AS orf FROM ox WHERE n >= 30"
)
on_dna("orfs", _orf, lambda d: search.open_reading_frames(d, 30))
_open = (
    _marks + "og AS (SELECT seq_idx, header, frame, any_value(t) AS t, any_value(o) AS o, CASE WHEN min(k) = 0 THEN 0 ELSE min(CASE WHEN start THEN k END) END AS a, coalesce(max(CASE WHEN stop THEN k END), max(k) + 1) AS b "
    "FROM sg GROUP BY seq_idx, header, frame, s), ox AS (SELECT *, o + 3 * a AS p, 3 * (b - a) AS n FROM og WHERE a IS NOT NULL) "
    "SELECT seq_idx::BIGINT AS seq_idx, header, frame, p::INTEGER AS start, (CASE WHEN frame[1] = 'F' THEN p + 1 ELSE length(t) - (p + n) + 1 END)::INTEGER AS position, n::INTEGER AS length, "
    "CASE WHEN p < 3 THEN '???' ELSE substr(t, (p + 1)::BIGINT, 3) END AS start_codon, CASE WHEN p + n >= length(t) - 3 THEN '???' ELSE substr(t, (p + n + 1)::BIGINT, 3) END AS stop_codon, "
    "substr(t, (p + 1)::BIGINT, n::BIGINT) AS orf FROM ox WHERE n >= 30"
)
on_dna("orfs_whole", _open, lambda d: search.open_reading_frames(d, 30, whole=True))
_run = (
    ", r AS (SELECT seq_idx, header, seq, i, length(regexp_extract(substr(seq, i::BIGINT), '^A+')) AS n FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM dna) WHERE substr(seq, i::BIGINT, 1) = 'A' AND (i = 1 OR substr(seq, (i - 1)::BIGINT, 1) <> 'A')), "
    "q AS (SELECT * FROM r WHERE n >= 4 AND i + n - 1 < length(seq)), "
)
_runs = (
    f"{_run} c AS (SELECT *, row_number() OVER (PARTITION BY seq_idx ORDER BY n DESC, i) AS k FROM q) "
    "SELECT seq_idx::BIGINT AS seq_idx, header, n::INTEGER AS length, (i - 1)::INTEGER AS \"left\", (length(seq) - (i + n - 1))::INTEGER AS remaining FROM c WHERE k = 1"
)
_records = (
    f"{_run} g AS (SELECT *, i - 1 - coalesce(lag(i - 1 + n) OVER (PARTITION BY seq_idx ORDER BY i), 0) AS gap, n > coalesce(max(n) OVER (PARTITION BY seq_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS longer FROM q) "
    "SELECT seq_idx::BIGINT AS seq_idx, any_value(header) AS header, max(n)::INTEGER AS length, (sum(gap + n) - max(n))::INTEGER AS \"left\", min(length(seq) - (i + n - 1))::INTEGER AS remaining FROM g WHERE longer GROUP BY seq_idx"
)
on_dna("poly_a", _runs, lambda d: search.longest_runs(d, fixed=True))
on_dna("poly_a_as_is", _records, search.longest_runs)
_hit = lambda p, n: f"SELECT seq_idx, header, i - 1 AS o, substr(seq, i::BIGINT, {n}) AS m FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM dna) WHERE regexp_full_match(substr(seq, i::BIGINT, {n}), '{p}')"
on_dna("re_count", f", h AS ({_hit('A[CT]A', 3)}) SELECT dna.seq_idx::BIGINT AS seq_idx, dna.header, count(o)::BIGINT AS n FROM dna LEFT JOIN h USING (seq_idx) GROUP BY ALL", lambda d: search.regex_counts(d, "a[ct]a"))
on_dna("re_all", f", h AS ({_hit('A[CT]A', 3)}) SELECT {_IDX}, header, o::INTEGER AS \"offset\", 3::INTEGER AS length, m AS match FROM h", lambda d: search.regex_matches(d, "a[ct]a", every=True))
on_dna("re_first", f", h AS ({_hit('A[CT]A', 3)}) SELECT {_IDX}, any_value(header) AS header, min(o)::INTEGER AS \"offset\", 3::INTEGER AS length, arg_min(m, o) AS match FROM h GROUP BY seq_idx", lambda d: search.regex_matches(d, "a[ct]a"))


def _motif(strands: dict[str, str], fixed: str, soft: list[tuple[int, str]], n: int, most: int) -> str:
    each = " UNION ALL ".join(f"SELECT *, '{d}' AS dir, {e} AS t FROM w" for d, e in strands.items())
    miss = " + ".join(f"(substr(t, {j}, 1) NOT IN ({', '.join(repr(c) for c in s)}))::INT" for j, s in soft) or "0"
    return (
        f", w AS ({_words(n)}), s AS ({each}), m AS (SELECT *, {miss} AS n_mis FROM s WHERE regexp_full_match(t, '{fixed}')) "
        f'SELECT {_IDX}, header, (pos + 1)::INTEGER AS pos, dir, t AS "match", n_mis::INTEGER AS n_mis, t AS expansion, w AS "window" FROM m WHERE n_mis <= {most}'
    )


_found = lambda d: d.select("seq_idx", "header", "pos", "dir", "match", "n_mis", "expansion", "window")
_bs = lambda e: f"replace({e}, 'C', 'T')"
_both = {"f": "w", "r": _RC.format("w")}
on_dna("prosearch_exact", _motif(_both, "TT[AG][CT]A", [], 5, 0), lambda d: _found(search.motif_hits(d, "TTRYA")))
on_dna("prosearch_m1", _motif(_both, "TT[ACGT]{3}", [(3, "C"), (4, "AG"), (5, "T")], 5, 1), lambda d: _found(search.motif_hits(d, "TTcrt", 1)))
on_dna(
    "prosearch_bisulfite",
    _motif({"f": _bs("w"), "r": _bs(_RC.format("w")), "u": _RC.format(_bs("w")), "v": _RC.format(_bs(_RC.format("w")))}, "TGT[ACGT]{2}", [(4, "AT"), (5, "G")], 5, 1),
    lambda d: _found(search.motif_hits(d, "TGTwg", 1, bisulfite=1)),
)
_first = lambda j, c: f"CASE WHEN substr(t, {j}, 1) = 'N' THEN '{c}' ELSE substr(t, {j}, 1) END"
on_dna(
    "prosearch_ambiguous",
    f", w AS ({_words(4)}), s AS (SELECT *, 'f' AS dir, w AS t FROM w UNION ALL SELECT *, 'r', {_RC.format('w')} FROM w) "
    f'SELECT {_IDX}, header, (pos + 1)::INTEGER AS pos, dir, \'\' AS "left", t AS "match", \'\' AS "right", 0::INTEGER AS n_mis, {" || ".join(_first(j, c) for j, c in enumerate("ATTA", 1))} AS expansion, w AS "window" '
    "FROM s WHERE regexp_full_match(t, '[AN][TN][TN][AGN]') AND length(replace(t, 'N', '')) >= 3",
    lambda d: search.motif_hits(d, "ATTR", ambiguous=1),
)
on_dna(
    "prosearch_neighbours",
    f", w AS (SELECT seq_idx, header, i, seq, substr(seq, i::BIGINT, 9) AS t, CASE WHEN i > 4 THEN substr(seq, (i - 4)::BIGINT, 4) ELSE repeat('X', (5 - i)::BIGINT) || substr(seq, 1, (i - 1)::BIGINT) END AS l "
    "FROM (SELECT *, unnest(range(1, length(seq) - 7)) AS i FROM dna)), "
    f"s AS (SELECT *, 'f' AS dir, l AS lt, substr(t, 1, 5) AS m, substr(t, 6, 4) AS rt FROM w UNION ALL SELECT *, 'r', {_RC.format('substr(t, 6, 4)')}, {_RC.format('substr(t, 1, 5)')}, {_RC.format('l')} FROM w) "
    f'SELECT {_IDX}, i::INTEGER AS pos, dir, lt AS "left", m AS "match", rt AS "right" FROM s WHERE regexp_full_match(m, \'TT[AG][CT]A\')',
    lambda d: search.motif_hits(d, "TTRYA", neighbours=4).select("seq_idx", "pos", "dir", "left", "match", "right"),
)

# Intervals
_CUTS = ((2, 15, "head"), (40, 90, "body"), (80, 120, "over"), (300, 100_000, "tail"))
_cuts = "c(a, b, d) AS (VALUES " + ", ".join(f"({a}, {b}, '{d}')" for a, b, d in _CUTS) + ")"
_piece = "substr(seq, (a + 1)::BIGINT, (CASE WHEN b >= length(seq) THEN greatest(length(seq) - 1, a) ELSE b END - a)::BIGINT) AS piece"
query(
    "intervals",
    f', {_cuts} SELECT header, d AS "desc", a::BIGINT AS a, least(b, length(seq))::BIGINT AS stop, d || \' \' || a || \'-\' || least(b, length(seq)) || \' \' || header AS label, {_piece} FROM dna, c WHERE a < length(seq)',
)(lambda s, d: intervals.extract(dna(s, d), s.createDataFrame(list(_CUTS), "a long, b long, desc string")))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("doc_id") % 97 * 3
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"), a.alias("a"), (a + 60).alias("b"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("desc")
    )


query(
    "neighborhoods",
    f', r AS (SELECT doc_id + 1 AS seq_idx, doc_id, doc_id % 97 * 3 AS a, doc_id % 97 * 3 + 60 AS b, \'q\' || quality AS "desc" FROM labels) '
    f'SELECT \'doc\' || doc_id AS chrom, a::BIGINT AS a, least(b, length(seq))::BIGINT AS stop, "desc", {_piece} FROM dna JOIN r USING (seq_idx) WHERE a < length(seq)',
)(lambda s, d: intervals.neighbourhoods(dna(s, d), _regions(s, d)))


def _places(spark: SparkSession, sf_dir: str, name: str, key: str, step: int, span: int) -> DataFrame:
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("row_idx"), F.lit("chr1").alias("chr"), (k * step).alias("start"), (k * step + span).alias("stop"))


query(
    "overlap_summary",
    "WITH a AS (SELECT o_orderkey AS row_idx, o_orderkey * 10 AS a1, o_orderkey * 10 + 6 AS a2 FROM orders), b AS (SELECT c_custkey * 97 AS b1, c_custkey * 97 + 20 AS b2 FROM customer) "
    "SELECT row_idx, a1::BIGINT AS start, a2::BIGINT AS stop, count(b1)::BIGINT AS n, coalesce(sum(CASE WHEN b1 IS NOT NULL THEN least(a2, b2) - greatest(a1, b1) + 1 END), 0)::BIGINT AS m, "
    "coalesce(count_if(b1 >= a1 AND b2 <= a2), 0)::BIGINT AS u, coalesce(sum(CASE WHEN b1 >= a1 AND b2 <= a2 THEN b2 - b1 + 1 END), 0)::BIGINT AS v FROM a LEFT JOIN b ON a1 <= b2 AND b1 <= a2 GROUP BY ALL",
    view=False,
)(lambda s, d: intervals.overlap_summary(_places(s, d, "orders", "o_orderkey", 10, 6), _places(s, d, "customer", "c_custkey", 97, 20), 4096).drop("chr"))

_CIGARS = ("10M", "5M2I5M", "8M3D4M", "6M20N6M")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    cigar = F.element_at(F.array(*[F.lit(c) for c in _CIGARS]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return rows.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10**10 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("row_idx"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("rname"),
        (F.col("l_partkey") * 37 + F.col("l_linenumber")).alias("pos"), cigar.alias("cigar"),
    )


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), (k % 5).cast("string")).alias("chr"), (k * 41).alias("start"), (k * 41 + F.col("p_size")).alias("stop"))


_sam = (
    "WITH r AS (SELECT (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 100000 + l_suppkey AS row_idx, 'chr' || (l_suppkey % 5) AS rname, l_partkey * 37 + l_linenumber AS pos, "
    "['10M', '5M2I5M', '8M3D4M', '6M20N6M'][l_linenumber % 4 + 1] AS cigar, [10, 12, 9, 32][l_linenumber % 4 + 1] AS n FROM lineitem), "
    "t AS (SELECT 'chr' || (p_partkey % 5) AS chr, p_partkey * 41 AS a, p_partkey * 41 + p_size AS b FROM part) "
    "SELECT row_idx::BIGINT AS row_idx, rname, pos::BIGINT AS pos, cigar FROM r WHERE {0} EXISTS (SELECT 1 FROM t WHERE chr = rname AND a <= pos + n AND b >= pos)"
)
query("sam_overlaps", _sam.format(""), view=False)(lambda s, d: intervals.alignments(_reads(s, d), _transcripts(s, d), width=128))
query("sam_overlaps_inverse", _sam.format("NOT"), view=False)(lambda s, d: intervals.alignments(_reads(s, d), _transcripts(s, d), invert=True, width=128))
query(
    "cigar_lengths", "SELECT DISTINCT ['10M', '5M2I5M', '8M3D4M', '6M20N6M'][l_linenumber % 4 + 1] AS cigar, [10, 12, 9, 32][l_linenumber % 4 + 1]::BIGINT AS n, [10, 10, 15, 32][l_linenumber % 4 + 1]::BIGINT AS fixed FROM lineitem", view=False
)(lambda s, d: _reads(s, d).select("cigar").distinct().select("cigar", S.cigar_length(F.col("cigar")).alias("n"), S.cigar_length(F.col("cigar"), True).alias("fixed")))


# Graphs
def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b"))


_nodes = (
    "WITH e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer), m AS (SELECT b, min(a) AS component FROM e GROUP BY b), "
    "n AS (SELECT a AS node, component FROM e JOIN m USING (b) UNION SELECT b, component FROM m) "
)
query("connected_components", _nodes + "SELECT node, component FROM n", view=False)(lambda s, d: graph.components(_links(s, d)))
query("components_min3", _nodes + "SELECT component, count(*)::BIGINT AS n_nodes FROM n GROUP BY component HAVING count(*) >= 3", view=False)(lambda s, d: graph.component_sizes(_links(s, d), 3))
_rest = "FILTER (a <> component)"
query(
    "subgraph_text",
    "WITH e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer), m AS (SELECT *, min(a) OVER (PARTITION BY b) AS component FROM e) "
    f"SELECT component, count(*)::BIGINT + 1 AS n_nodes, component || ' ' || b || ' ' || string_agg(a, ' ' ORDER BY a) {_rest} || chr(10) || '   ' || component || ' ' || b || chr(10) || "
    f"string_agg('   ' || b || ' ' || a, chr(10) ORDER BY a) {_rest} AS text FROM m GROUP BY component, b HAVING count(*) >= 2",
    view=False,
)(lambda s, d: graph.subgraphs(_links(s, d), 3, edges=True))


# Chains and cycles: part k is linked to the next one of its hundred, every second hundred is closed to a ring.
def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    last = (k % 100 == 99) & (F.floor(k / 100) % 2 == 0)
    rows = table(spark, sf_dir, "part").select(k.alias("a"), F.when(k % 100 < 99, k + 1).when(last, k - 99).alias("b"))
    name = lambda c: F.concat(F.lit("p"), F.lpad(F.col(c).cast("string"), 9, "0"))
    return rows.where("b IS NOT NULL").select(name("a").alias("a"), name("b").alias("b"), F.concat(F.lit("of "), (F.col("a") % 7).cast("string")).alias("desc"))


_ring = (
    "WITH k AS (SELECT p_partkey AS a, CASE WHEN p_partkey % 100 < 99 THEN p_partkey + 1 WHEN (p_partkey // 100) % 2 = 0 THEN p_partkey - 99 END AS b FROM part), "
    "e AS (SELECT 'p' || lpad(a::VARCHAR, 9, '0') AS a, 'p' || lpad(b::VARCHAR, 9, '0') AS b, 'of ' || (a % 7) AS d, a // 100 AS g FROM k WHERE b IS NOT NULL), "
    "n AS (SELECT a AS node, g FROM e UNION SELECT b, g FROM e), c AS (SELECT node, min(node) OVER (PARTITION BY g) AS component FROM n) "
)
query("components_of_chains", _ring + "SELECT node, component FROM c", view=False)(lambda s, d: graph.components(_rings(s, d).select("a", "b")))
query(
    "subgraph_dot",
    # A chain or a ring of which the smallest node comes first: depth first is the order of the nodes.
    _ring + ", t AS (SELECT component, string_agg('\"' || node || '\"', ' ; ' ORDER BY node) AS line, count(*)::BIGINT AS n_nodes FROM c GROUP BY component), "
    "l AS (SELECT component, string_agg('   \"' || a || '\" -- \"' || b || '\";  # ' || d, chr(10) ORDER BY least(a, b), greatest(a, b)) AS links FROM e JOIN c ON node = a GROUP BY component) "
    "SELECT component, n_nodes, 'graph {' || chr(10) || line || ';' || chr(10) || links || chr(10) || '}' AS text FROM t JOIN l USING (component)",
    view=False,
)(lambda s, d: graph.subgraphs(_rings(s, d), dot=True))


# Letters of both cases, with U and the codes of ambiguity
_IUPAC_VIEW = """WITH dna AS (SELECT doc_id + 1 AS seq_idx, 'doc' || doc_id AS header, regexp_replace(coalesce(text, ''), '[^ACGTUNMRWSYKVHDBXacgtunmrwsykvhdbx]', '', 'g') AS seq FROM documents)"""


def iupac(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seq = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTUNMRWSYKVHDBXacgtunmrwsykvhdbx]", "")
    return docs.select((F.col("doc_id") + 1).alias("seq_idx"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("header"), seq.alias("seq"))


def on_iupac(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, _IUPAC_VIEW + sql, view=False)(lambda spark, sf_dir: f(iupac(spark, sf_dir)))


_letters_of = lambda cs: " UNION ALL ".join(f"SELECT '{c}' AS base, sum(length(seq) - length(replace(seq, '{c}', '')))::BIGINT AS n FROM dna" for c in cs)
on_iupac("nt_cased", f", b AS ({_letters_of('ACGTacgt')}) SELECT * FROM b", lambda d: statistics.composition(d, cased=True).select("base", "n"))
on_iupac(
    "nt_cased_ambiguous", f", b AS ({_letters_of('ACGTacgt' + statistics.AMBIGUOUS + statistics.AMBIGUOUS.lower())}), s AS (SELECT CASE WHEN base IN ('A','C','G','T','a','c','g','t') THEN base WHEN base = upper(base) THEN 'N' ELSE 'n' END AS base, n FROM b) "
    "SELECT base, sum(n)::BIGINT AS n FROM s GROUP BY base", lambda d: statistics.composition(d, "sum", cased=True).select("base", "n"),
)
on_iupac("nt_each_ambiguous", f", b AS ({_letters_of('ACGTacgt' + statistics.AMBIGUOUS + statistics.AMBIGUOUS.lower())}) SELECT upper(base) AS base, sum(n)::BIGINT AS n FROM b GROUP BY 1", lambda d: statistics.composition(d, "each").select("base", "n"))
on_iupac("rc_ambiguous", f" SELECT {_IDX}, {_RC.format('seq')} AS seq FROM dna", lambda d: transforms.reverse_complements(d).select("seq_idx", "seq"))
on_iupac("rc_rna", f" SELECT {_IDX}, {_RC.format(chr(114) + 'eplace(replace(seq, ' + repr('U') + ', ' + repr('T') + '), ' + repr('u') + ', ' + repr('t') + ')')} AS seq FROM dna", lambda d: transforms.reverse_complements(d, rna=True).select("seq_idx", "seq"))
_known = f"regexp_replace(seq, '[^{COMPLEMENT_FROM}]', 'X', 'g')"
on_iupac("complement_strict_ambiguous", f" SELECT {_IDX}, translate({_known}, '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}') AS seq FROM dna", lambda d: d.select("seq_idx", S.strict_complement(F.col("seq")).alias("seq")))
on_iupac("bisulfite_ambiguous", f" SELECT {_IDX}, translate({_known}, 'Cc', 'Tt') AS seq FROM dna", lambda d: transforms.bisulfite_converted(d).select("seq_idx", "seq"))
on_iupac("sel_trim_stop", f" SELECT {_IDX}, seq FROM dna", lambda d: selection.select_sequences(d.withColumn("seq", F.concat("seq", F.lit("*"))), trim_stop=True).select("seq_idx", "seq"))

# Words, reports and searches that others leave out
_every_k = lambda k: f"e AS (SELECT {_every(k)} AS kmer FROM range({4**k}) AS r(i))"
on_dna(
    "kmers_by_seq_dense", f", c AS (SELECT seq_idx, w, count(*) AS n FROM ({_letters(2)}) GROUP BY ALL), {_every_k(2)}, x AS (SELECT seq_idx, kmer, {_RC.format('kmer')} AS rc FROM dna, e) "
    "SELECT x.seq_idx::BIGINT AS seq_idx, kmer, coalesce(f.n, 0)::BIGINT AS fwd, coalesce(r.n, 0)::BIGINT AS rev FROM x LEFT JOIN c AS f ON f.seq_idx = x.seq_idx AND f.w = kmer LEFT JOIN c AS r ON r.seq_idx = x.seq_idx AND r.w = rc",
    lambda d: statistics.kmers(d, 2, by_sequence=True).select("seq_idx", "kmer", "fwd", "rev"),
)
on_dna("ngrams_by_count", f", c AS (SELECT w AS ngram, count(*) AS n FROM ({_words(3)}) GROUP BY w) SELECT ngram, n::BIGINT AS n, row_number() OVER (ORDER BY n DESC, ngram)::BIGINT AS place FROM c", lambda d: _placed(statistics.ngrams(d, 3, order="count")))


def _placed(rows: DataFrame) -> DataFrame:
    """Place in the order given; over the different n-grams alone."""
    return rows.select("ngram", "n").coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


on_dna(
    "ngram_report", f", c AS (SELECT w AS ngram, count(*) AS n FROM ({_words(2)}) GROUP BY w) SELECT printf('%s %10d', ngram, n) AS line FROM c", lambda d: statistics.ngrams(d, 2).select(writers.ngram_report().alias("line")),
)
on_dna(
    "nt_report", f"{_sums}, t AS (SELECT sum(n) AS total FROM s WHERE base <> 'N') SELECT base || ': ' || printf('%10d ', n) AS line FROM s WHERE base <> 'N'",
    lambda d: statistics.composition(d).select(writers.composition_report(percents=False).alias("line")),
)
on_dna(
    "re_report", f", h AS ({_hit('A[CT]A', 3)}) SELECT printf('%10d %10d %s %s', o, 3, m, header) AS line FROM h", lambda d: search.regex_matches(d, "a[ct]a", every=True).select(writers.match_report().alias("line")),
)
on_dna("re_count_report", f", h AS ({_hit('A[CT]A', 3)}) SELECT printf('%10d %s', count(o), dna.header) AS line FROM dna LEFT JOIN h USING (seq_idx) GROUP BY dna.seq_idx, dna.header", lambda d: search.regex_counts(d, "a[ct]a").select(writers.count_report().alias("line")))
on_dna(
    "poly_a_report", f"{_run} c AS (SELECT *, row_number() OVER (PARTITION BY seq_idx ORDER BY n DESC, i) AS k FROM q) SELECT header || ': ' || printf(' %4d %4d %4d', n, i - 1, length(seq) - (i + n - 1)) AS line FROM c WHERE k = 1",
    lambda d: search.longest_runs(d, fixed=True).select(writers.run_report(True, True).alias("line")),
)
_exact = f", w AS ({_words(5)}), s AS (SELECT *, 'f' AS dir, w AS t FROM w UNION ALL SELECT *, 'r', {_RC.format('w')} FROM w) "
on_dna("prosearch_report", _exact + "SELECT w || ' ' || dir || printf(' %2d ', 0) || t || printf(' %10d', pos + 1) AS line FROM s WHERE regexp_full_match(t, 'TT[AG][CT]A')", lambda d: search.motif_hits(d, "TTRYA").select(writers.hit_report().alias("line")))
on_dna("length_report", " SELECT printf('%10d %s', length(seq), header) AS line FROM dna", lambda d: statistics.lengths(d).select(writers.length_report().alias("line")))
on_dna(
    "re_anchored", ", h AS (SELECT seq_idx, header, length(regexp_extract(seq, '^A*')) AS n FROM dna) SELECT seq_idx::BIGINT AS seq_idx, header, unnest(range(n))::INTEGER AS \"offset\", 1::INTEGER AS length, 'A' AS match FROM h",
    lambda d: search.regex_matches(d, "^a", every=True),
)
on_dna(
    "re_backreference", f", h AS (SELECT seq_idx, header, pos AS o, w AS m FROM ({_words(3)}) WHERE substr(w, 1, 1) = substr(w, 3, 1)) SELECT {_IDX}, header, o::INTEGER AS \"offset\", 3::INTEGER AS length, m AS match FROM h",
    lambda d: search.regex_matches(d, "(.).\\1", every=True),
)

# Overlaps of deep and nested intervals
_NESTED = (
    "WITH a AS (SELECT o_orderkey AS row_idx, 'c' || (o_orderkey % 3) AS chr, o_orderkey * 7 % 5000 AS a1, o_orderkey * 7 % 5000 + o_orderkey % 90 AS a2 FROM orders), "
    "b AS (SELECT 'c' || (c_custkey % 3) AS chr, c_custkey * 11 % 5000 AS b1, c_custkey * 11 % 5000 + c_custkey % 40 * (c_custkey % 5) AS b2 FROM customer) "
    "SELECT row_idx, a.chr, a1::BIGINT AS start, a2::BIGINT AS stop, count(b1)::BIGINT AS n, coalesce(sum(CASE WHEN b1 IS NOT NULL THEN least(a2, b2) - greatest(a1, b1) + 1 END), 0)::BIGINT AS m, "
    "coalesce(count_if(b1 >= a1 AND b2 <= a2), 0)::BIGINT AS u, coalesce(sum(CASE WHEN b1 >= a1 AND b2 <= a2 THEN b2 - b1 + 1 END), 0)::BIGINT AS v FROM a LEFT JOIN b ON a1 <= b2 AND b1 <= a2{0} GROUP BY ALL"
)


def _nested(spark: SparkSession, sf_dir: str, by_chr: bool) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    chrom = lambda k: F.concat(F.lit("c"), (k % 3).cast("string")).alias("chr")
    at = lambda k, step, more: [(k * step % 5000).alias("start"), (k * step % 5000 + more).alias("stop")]
    a = table(spark, sf_dir, "orders").select(o.alias("row_idx"), chrom(o), *at(o, 7, o % 90))
    b = table(spark, sf_dir, "customer").select(chrom(c), *at(c, 11, c % 40 * (c % 5)))
    return intervals.overlap_summary(a, b, 512, by_chr)


query("overlap_nested", _NESTED.format(""), view=False)(lambda s, d: _nested(s, d, False))
query("overlap_nested_by_chr", _NESTED.format(" AND a.chr = b.chr"), view=False)(lambda s, d: _nested(s, d, True))


# Files: written to the shared folder, read again, and removed when the result is settled
def on_files(name: str, sql: str, f: Callable[[SparkSession, str, str], DataFrame], view: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
        try:
            return cut(f(spark, sf_dir, path))
        finally:
            removed(spark, path)

    query(name, sql, view)(run)


def _fasta_file(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    writers.write_fasta(dna(spark, sf_dir).orderBy("seq_idx"), path)
    return readers.read_fasta(spark, path).select("seq_idx", "header", "seq")


def _chunk_files(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    writers.write_chunks(dna(spark, sf_dir), path, 7, "part_", ".fa")
    found = readers.read_fasta(spark, path).withColumn("fname", F.element_at(F.split("path", "/"), -1))
    return found.groupBy("fname").agg(F.count(F.lit(1)).alias("n_seqs"), F.sum(F.length("seq")).alias("length"))


def _genome_files(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    writers.write_split(dna(spark, sf_dir), path, separator=" ", field=2, extension="fa")
    regions = table(spark, sf_dir, "documents").select(F.col("source").alias("chrom")).distinct().select("chrom", F.lit(3).cast("long").alias("a"), F.lit(30).cast("long").alias("b"), F.lit("near").alias("desc"))
    return intervals.neighbourhoods(readers.read_genome(spark, path), regions)


def _fastq_file(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    reads = dna(spark, sf_dir).select("seq_idx", F.concat(F.lit("@"), "header").alias("header"), "seq", F.lit("+").alias("qheader"), F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    writers.write_fastq(reads.orderBy("seq_idx").drop("seq_idx"), path)
    return selection.select_sequences(readers.read_fastq(spark, path), 50, header="^@doc[0-9]*5 ", fastq=True).select("seq_idx", "header", "seq", "qual")


def _sam_file(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    reads = _reads(spark, sf_dir)
    line = F.concat_ws("\t", F.concat(F.lit("r"), F.col("row_idx").cast("string")), F.lit("0"), "rname", F.col("pos").cast("string"), F.lit("9"), "cigar", F.lit("*"))
    reads.select(line.alias("value")).unionByName(spark.range(1).select(F.lit("@HD\tVN:1.6").alias("value"))).write.text(path)
    return readers.read_sam(spark, path).groupBy("rname", "cigar").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"))


def _edge_file(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    _rings(spark, sf_dir).select(F.concat_ws(" ", "a", "b", F.lit("#"), "desc").alias("value")).write.text(path)
    return readers.read_edges(spark, path)


def _table_file(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    _transcripts(spark, sf_dir).select(F.concat_ws("\t", "chr", F.col("start").cast("string"), F.col("stop").cast("string")).alias("value")).write.text(path)
    return readers.read_interval_table(spark, path).select("chr", "start", "stop")


def _cut_file(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    k = F.col("p_partkey")
    table(spark, sf_dir, "part").select(F.concat((k % 50 + 9).cast("string"), F.when(k % 2 == 0, "-").otherwise(" "), (k % 31).cast("string"), F.lit(" cut "), k.cast("string")).alias("value")).write.text(path)
    return readers.read_cut_list(spark, path)


def _region_file(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    _regions(spark, sf_dir).select(F.concat_ws(" ", "chrom", F.col("a").cast("string"), F.col("b").cast("string"), "desc", F.lit("x")).alias("value")).write.text(path)
    return readers.read_regions(spark, path)


def _id_file(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    ids = _ids(spark, sf_dir)
    ids.unionByName(ids).select(F.concat("id", F.lit("  ")).alias("value")).write.text(path)
    return _all(selection.by_ids(dna(spark, sf_dir), readers.read_ids(spark, path)))


on_files("fasta_file", f" SELECT {_cols} FROM dna", _fasta_file)
on_files("fasta_chunk_files", ", c AS (SELECT seq, ntile(7) OVER (ORDER BY seq_idx) - 1 AS k FROM dna) SELECT 'part_' || k || '.fa' AS fname, count(*)::BIGINT AS n_seqs, sum(length(seq))::BIGINT AS length FROM c GROUP BY k", _chunk_files)
on_files(
    "genome_folder", ", r AS (SELECT path AS chrom, arg_max(seq, seq_idx) AS seq, 3 AS a, 30 AS b FROM dna GROUP BY path) "
    f"SELECT chrom, a::BIGINT AS a, least(b, length(seq))::BIGINT AS stop, 'near' AS \"desc\", {_piece} FROM r WHERE a < length(seq)", _genome_files,
)
on_files("fastq_file", f" SELECT {_IDX}, '@' || header AS header, seq, repeat('I', length(seq)) AS qual FROM dna WHERE length(seq) >= 50 AND regexp_matches(header, '^doc[0-9]*5 ')", _fastq_file)
on_files("sam_file", _sam.format("NOT").split("t AS (")[0].rstrip(", ") + " SELECT rname, cigar, count(*)::BIGINT AS n, sum(pos)::BIGINT AS pos FROM r GROUP BY ALL", _sam_file, view=False)
on_files("edge_file", _ring + "SELECT a, b, d AS \"desc\" FROM e", _edge_file, view=False)
on_files("interval_file", "SELECT 'chr' || (p_partkey % 5) AS chr, (p_partkey * 41)::BIGINT AS start, (p_partkey * 41 + p_size)::BIGINT AS stop FROM part", _table_file, view=False)
on_files("cut_file", "SELECT least(p_partkey % 50 + 9, p_partkey % 31)::BIGINT AS a, greatest(p_partkey % 50 + 9, p_partkey % 31)::BIGINT AS b, 'cut ' || p_partkey AS \"desc\" FROM part", _cut_file, view=False)
on_files("region_file", "SELECT 'doc' || doc_id AS chrom, (doc_id % 97 * 3)::BIGINT AS a, (doc_id % 97 * 3 + 60)::BIGINT AS b, 'q' || quality || ' x' AS \"desc\" FROM labels", _region_file, view=False)
on_files("id_file", f" SELECT {_cols} FROM dna WHERE seq_idx {_listed}", _id_file)
query("interval_list", "SELECT a::BIGINT AS a, b::BIGINT AS b, '' AS \"desc\" FROM (VALUES (2, 5), (10, 20), (3, 7)) AS t(a, b)", view=False)(lambda s, _: readers.interval_list(s, "2-5, 20-10,3-7"))
