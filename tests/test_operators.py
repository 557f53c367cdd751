from __future__ import annotations

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.functions.alphabet import COMPLEMENT, IUPAC
from helixframe.operators import graph, intervals, search, selection, statistics, transforms

RECORD = ("s", "ACGTNACG")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_kmers(seqs):
    out = {r.kmer: r for r in statistics.kmers(seqs(RECORD), 2).collect()}
    assert len(out) == 16 and sum(r.fwd == 0 for r in out.values()) == 13
    ac, cg = out["AC"], out["CG"]
    assert (ac.rc, ac.fwd, ac.rev, ac.both, ac.fwd_pct, ac.rev_pct, ac.avg_pct) == ("GT", 2, 1, 3, 40, 20, 30)
    assert (cg.rc, cg.fwd, cg.rev, cg.both, cg.fwd_pct, cg.avg_pct) == ("CG", 2, 2, 4, 40, 40)
    per = statistics.kmers(seqs(RECORD, ("t", "AA")), 1, by_sequence=True)
    assert per.count() == 8 and per.where("seq_idx = 2 AND kmer = 'T'").first().rev == 2
    assert statistics.kmers(seqs(("e", "")), 1).first().fwd_pct is None
    with pytest.raises(ValueError):
        statistics.kmers(seqs(RECORD), 11)


def test_ngrams(seqs):
    assert rows(statistics.ngrams(seqs(RECORD, ("0", "AAAA")), 2), "ngram", "n") == [("AC", 2), ("CG", 2), ("GT", 1), ("NA", 1), ("TN", 1)]
    assert [r.ngram for r in statistics.ngrams(seqs(RECORD), 2, "count").collect()][:2] == ["AC", "CG"]


def test_kmers_by_frame(seqs):
    assert rows(statistics.kmers_by_frame(seqs(RECORD)), "kmer", "f0", "f1", "f2") == [("ACG", 1, 0, 1), ("CGT", 0, 1, 0), ("GTN", 0, 0, 1), ("NAC", 0, 1, 0), ("TNA", 1, 0, 0)]


def test_composition(seqs):
    assert rows(statistics.composition(seqs(RECORD)), "base", "n", "total") == [("A", 2, 7), ("C", 2, 7), ("G", 2, 7), ("T", 1, 7)]
    assert rows(statistics.composition(seqs(RECORD), "sum"), "base", "n", "total")[3] == ("N", 1, 8)
    assert rows(statistics.composition(seqs(RECORD), pairs=True), "base", "n") == [("A/T", 3), ("G/C", 4)]
    assert rows(statistics.composition(seqs(("l", "aCg")), cased=True, zeros=False), "base", "n") == [("C", 1), ("a", 1), ("g", 1)]
    assert {r.pct for r in statistics.composition(seqs(("e", ""))).collect()} == {-1.0}


def test_codons(seqs):
    out = {r.codon: r for r in statistics.codon_frequencies(seqs(("s", "ATGTTTTTCNNNTA"))).collect()}
    assert len(out) == 64 and (out["TTT"].n, out["TTT"].aa_pct) == (1, 50) and out["TAA"].aa_pct is None and round(out["ATG"].pct, 3) == 33.333


def test_orfs(seqs):
    out = search.open_reading_frames(seqs(("s", "ATGAAATAG")), 3).collect()
    assert [(r.frame, r.position, r.length, r.start_codon, r.stop_codon, r.orf) for r in out] == [("F1", 1, 6, "ATG", "TAG", "ATGAAA")]
    named = search.open_reading_frames(seqs(("s x", "ATGAAATAG")), 3).select(search.orf_header()).first()[0]
    assert named == "F1-1-6-ATG-TAG s x"
    whole = search.open_reading_frames(seqs(("s", "CCCTAGATGCCC")), 3, whole=True, frames=("F1",)).collect()
    assert [(r.start, r.length, r.start_codon, r.stop_codon) for r in whole] == [(0, 3, "???", "TAG"), (6, 6, "ATG", "???")]
    assert search.open_reading_frames(seqs(("s", "TTGAAATAG")), 3, starts="ATG").count() == 0


def brute_orfs(seq, least, whole):
    found = []
    for d, text in (("F", seq), ("R", seq[::-1].translate(str.maketrans("ACGT", "TGCA")))):
        for off in range(3):
            at, after = None, off
            for p in range(off, len(text) - 2, 3):
                codon = text[p : p + 3]
                if at is None and (codon in ("ATG", "GTG", "TTG") or (whole and p == off)):
                    at = p
                after = p + 3
                if codon in ("TAA", "TAG", "TGA"):
                    found.append((d, off, at, p))
                    at = None
            if whole:
                found.append((d, off, at, after))
    return sorted((f"{d}{off + 1}", a, b - a) for d, off, a, b in found if a is not None and b - a >= least)


def test_orfs_of_a_long_sequence(seqs):
    rnd = random.Random(11)
    seq = "".join(rnd.choices("ACGT", k=1_000_000))
    for whole in (False, True):
        out = search.open_reading_frames(seqs(("s", seq)), 150, whole=whole).collect()
        assert sorted((r.frame, r.start, r.length) for r in out) == brute_orfs(seq, 150, whole)
        assert all(seq[r.start : r.start + r.length] == r.orf for r in out if r.frame[0] == "F")


def test_orf_bodies_have_no_stops(seqs):
    for r in search.open_reading_frames(seqs(("s", "ATGCCCATGTGATTGAACTAACATTTACAT" * 4)), 3).collect():
        codons = [r.orf[k : k + 3] for k in range(0, len(r.orf), 3)]
        assert r.length % 3 == 0 and not {"TAA", "TAG", "TGA"} & set(codons)


def test_longest_runs(seqs):
    s = seqs(("a", "gggaaaaaaccaaaat"), ("b", "gaaaaaccaaaatgaaaaaag"), ("c", "cccaaaaaa"))
    assert rows(search.longest_runs(s), "header", "length", "left", "remaining") == [("a", 6, 3, 7), ("b", 6, 8, 1)]
    assert rows(search.longest_runs(s, fixed=True), "header", "left") == [("a", 3), ("b", 14)]


def test_regex(seqs):
    s = seqs(("a", "caaac"), ("b", "gg"))
    assert rows(search.regex_matches(s, "AA"), "header", "offset", "match") == [("a", 1, "AA")]
    assert rows(search.regex_matches(s, "aa", every=True), "offset", "length") == [(1, 2), (2, 2)]
    assert rows(search.regex_counts(s, "aa"), "header", "n") == [("a", 2), ("b", 0)]
    assert rows(search.regex_counts(seqs(("a", "CAAAC")), "x*"), "n") == [(0,)]


def test_motif(seqs):
    found = rows(search.motif_hits(seqs(("s", "TTACATT")), "ACg", 1), "window", "dir", "n_mis", "expansion", "pos")
    assert found == [("ACA", "f", 1, "ACA", 3)]
    accepted = search.motif_hits(seqs(("s", "GCACCTTACGGGCACCATACGG")), "GCAcct.ac", 1)
    assert [r.n_mis for r in accepted.where("dir = 'f'").orderBy("pos").collect()] == [0, 1]
    near = search.motif_hits(seqs(("s", "GTACAT")), "ACa", 0, neighbours=2).collect()
    assert [(r.pos, r.dir, r.left, r.match, r.right) for r in near] == []
    near = search.motif_hits(seqs(("s", "GTACATC")), "ACA", 0, neighbours=2).where("dir = 'f'").collect()
    assert [(r.pos, r.left, r.match, r.right) for r in near] == [(3, "GT", "ACA", "TC")]
    assert rows(search.motif_hits(seqs(("s", "ARG")), "AGG", 0, ambiguous=1).where("dir = 'f'"), "expansion") == [("AGG",)]
    assert search.motif_hits(seqs(("s", "ARG")), "AGG").count() == 0
    with pytest.raises(ValueError):
        search.Motif("AXQ")


def test_long_sequences_in_blocks(seqs, monkeypatch):
    """With small blocks every border is met; results are those of whole sequences."""
    rnd = random.Random(6)
    df = seqs(*[(f"s{k}", "".join(rnd.choices("ACGTN", (9, 9, 9, 9, 1), k=n))) for k, n in enumerate((0, 1, 5, 24, 25, 240, 700))])
    uses = [
        lambda: statistics.kmers(df, 3), lambda: statistics.kmers(df, 2, by_sequence=True), lambda: statistics.ngrams(df, 4), lambda: statistics.kmers_by_frame(df, 3), lambda: statistics.codon_frequencies(df),
        lambda: transforms.translations(df, "all"), lambda: search.open_reading_frames(df, 9), lambda: search.open_reading_frames(df, 9, whole=True), lambda: search.motif_hits(df, "TTcr", 1, neighbours=3),
        lambda: search.motif_hits(df, "TCr", bisulfite=1), lambda: search.motif_hits(df, "ATTR", ambiguous=1, neighbours=2), lambda: search.regex_matches(df, "a[ct]{1,3}g?", every=True), lambda: search.regex_counts(df, "a[ct]{1,3}g?"),
    ]
    whole = [sorted(map(str, f().collect())) for f in uses]
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "CHUNK", 3)
    monkeypatch.setattr(S, "BLOCK", 24)
    monkeypatch.setattr(S.blocks, "__defaults__", (0, 24, None))
    for want, f in zip(whole, uses, strict=True):
        assert sorted(map(str, f().collect())) == want


def perl_search(pattern, seq, every):
    out, at, rest = [], 0, seq.upper()
    while m := re.search(pattern, rest, re.IGNORECASE):
        out.append((at + m.start(), m[0]))
        if not every or not m[0]:
            break
        at, rest = at + m.start() + 1, rest[m.start() + 1 :]
    return [x for x in out if x[1] or not every]


@pytest.mark.parametrize("pattern", ["^a", "^a|c", "(?<=a)c", "(?<!a)c", r"\bac", r"(a)(c)\1", r"(.)\1", "ac*", "a.*t", "a{2}", "t$", "g(?=t)", "(a|c)g"])
def test_regex_restarts(seqs, pattern):
    rnd = random.Random(len(pattern))
    texts = ["AAAC", "", "acca", *("".join(rnd.choices("ACGT", k=40)) for _ in range(4))]
    df = seqs(*[(f"s{k}", t) for k, t in enumerate(texts)])
    every, first, counts = (sorted(map(tuple, x.collect())) for x in (search.regex_matches(df, pattern, every=True).select("seq_idx", "offset", "match"), search.regex_matches(df, pattern).select("seq_idx", "offset", "match"), search.regex_counts(df, pattern).select("seq_idx", "n")))
    assert every == [(k, *m) for k, t in enumerate(texts, 1) for m in perl_search(pattern, t, True)]
    assert first == [(k, *m) for k, t in enumerate(texts, 1) for m in perl_search(pattern, t, False)]
    assert counts == [(k, len(perl_search(pattern, t, True))) for k, t in enumerate(texts, 1)]


def test_ambiguous_takes_the_first_expansion(seqs):
    assert rows(search.motif_hits(seqs(("s", "CB")), "cc", 1, ambiguous=1).where("dir = 'f'"), "expansion", "n_mis") == [("CG", 1)]


def first_expansion(pattern, window, most, ambiguous):
    """All expansions in the codes' order, tried one by one."""
    if any(c not in IUPAC for c in window) or sum(len(IUPAC[c]) > 1 for c in window) > ambiguous:
        return None
    for bases in product(*[IUPAC[c] for c in window]):
        off = [p for p, b in zip(pattern, bases, strict=True) if b not in IUPAC[p.upper()]]
        if len(off) <= most and not any(p.isupper() for p in off):
            return "".join(bases), len(off)
    return None


@pytest.mark.parametrize("pattern, most, ambiguous", [("ATTR", 0, 1), ("cRt", 0, 3), ("yccg", 1, 2), ("aCsbn", 2, 3), ("cccc", 3, 4), ("A", 0, 1), ("acgt", 9, 2)])
def test_ambiguity_codes_in_place(seqs, pattern, most, ambiguous):
    """Every expansion as tried one by one, and no window, with the block that it is cut from, goes to Python (a queue on disk)."""
    rnd = random.Random(7)
    texts = ["".join(rnd.choices("ACGTacgt" * 3 + "".join(IUPAC) + "nUX", k=n)) for n in (0, 2, 5, 60, 3000)]
    hits = search.motif_hits(seqs(*[(f"s{k}", t) for k, t in enumerate(texts)]), pattern, most, ambiguous=ambiguous)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Scan") == 1
    want = []
    for idx, t in enumerate(texts, 1):
        for at in range(len(t) - len(pattern) + 1):
            window = t[at : at + len(pattern)]
            for d, w in (("f", window), ("r", "".join(COMPLEMENT.get(c, "X") for c in reversed(window)))):
                if found := first_expansion(pattern, w.upper(), most, ambiguous):
                    want.append((idx, at + 1, d, w, window, *found))
    assert len(want) > 20
    assert rows(hits, "seq_idx", "pos", "dir", "match", "window", "expansion", "n_mis") == sorted(want)


def test_ambiguity_codes_under_a_long_pattern(seqs):
    """A pattern of 256 places, each unlike the one before."""
    text = "".join(random.Random(8).choices("ACGT", k=256))
    pattern = "".join(c.lower() if k % 2 else c for k, c in enumerate(text))
    window = text[:99] + "N" + text[100:150] + "R" + text[151:]
    hits = search.motif_hits(seqs(("s", "GG" + window + "T")), pattern, 1, ambiguous=2).where("dir = 'f'")
    assert rows(hits, "pos", "match", "expansion", "n_mis") == [(3, window, *first_expansion(pattern, window, 1, 2))]


def test_selection(seqs):
    s = seqs(("s1 de", "AAAA"), ("s2 en", "CCCAC*"), ("s2 fr", "GG"))
    assert rows(selection.select_sequences(s, 3, trim_stop=True), "seq") == [("AAAA",), ("CCCAC",)]
    assert rows(selection.select_sequences(s, header="^>S2", sequence="G"), "seq_idx") == [(2,), (3,)]
    assert rows(selection.select_sequences(s, header="^>S2", sequence="G", fixed=True), "seq_idx") == [(3,)]
    assert rows(selection.select_sequences(s, sequence="ca", highlight=True), "seq") == [("ccCAc*",)]
    assert rows(selection.select_sequences(s, header="s2 E", highlight=True), "header") == [("S2 En",)]
    assert rows(selection.select_sequences(s, begin=2, limit=1), "seq_idx") == [(2,)]
    assert rows(selection.select_sequences(seqs(("@r1", "A"), ("@r2", "CC")), 2, header="^@r", fastq=True), "header") == [("@r2",)]
    assert rows(selection.sequence_range(s, 2, 3), "seq_idx") == [(2,), (3,)]
    assert rows(selection.split_names(s, " ", 0, "fa"), "fname", "seq_idx") == [("s1.fa", 1), ("s2.fa", 3)]


def test_by_ids(spark, seqs):
    s, ids = seqs(("s1", "A"), ("s2 x", "C"), ("s2 y", "G")), spark.createDataFrame([(" s2 ",), ("s2",), ("s9",)], "id string")
    assert rows(selection.by_ids(s, ids), "seq_idx") == [(2,), (3,)]
    assert rows(selection.by_ids(s, ids, unique=True), "seq_idx") == [(2,)]
    assert rows(selection.by_ids(s, ids, invert=True), "seq_idx") == [(1,)]
    reads = seqs(("@r1/1", "A"), ("@r2/2", "C"))
    assert rows(selection.by_ids(reads, spark.createDataFrame([("r2",)], "id string"), fastq=True), "seq_idx") == [(2,)]


def test_chunks(seqs):
    s = seqs(*[(f"h{k}", "A") for k in range(7)])
    assert rows(selection.chunks(s, 3).groupBy("chunk").count(), "chunk", "count") == [(0, 3), (1, 2), (2, 2)]
    assert rows(selection.chunks(s, 9).groupBy("chunk").count(), "count") == [(1,)] * 7
    with pytest.raises(ValueError):
        selection.chunks(s, 0)


def test_extract(spark, seqs):
    cuts = spark.createDataFrame([(2, 5, ""), (0, 3, ""), (4, 20, ""), (12, 14, "")], "a long, b long, desc string")
    out = intervals.extract(seqs(("h", "ACGTACGTAC")), cuts, ordered=True).collect()
    assert [(r.label, r.piece) for r in out] == [("0-3 h", "ACG"), ("2-5 h", "GTA"), ("4-10 h", "ACGTA")]
    assert [r.piece for r in intervals.extract(seqs(("h", "ACGTACGTAC")), cuts, fixed=True, ordered=True).collect()][-1] == "ACGTAC"


def test_extract_in_blocks(spark, seqs, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK", 3)
    cuts = [(k, k + 4, f"d{k % 5}") for k in range(20)]
    df = seqs(*[(f"h{j}", "ACGTTGCA" * (j + 1)) for j in range(4)])
    out = intervals.extract(df, spark.createDataFrame(cuts, "a long, b long, desc string"), fixed=True)
    assert rows(out, "header", "a", "piece") == sorted((f"h{j}", a, ("ACGTTGCA" * (j + 1))[a:b]) for j in range(4) for a, b, _ in cuts if a < 8 * (j + 1))


def test_neighbourhoods(spark, seqs):
    regions = spark.createDataFrame([("c1", 5, 2, "d"), ("c9", 0, 4, "")], "chrom string, a long, b long, desc string")
    assert rows(intervals.neighbourhoods(seqs(("c1 chromosome", "ACGTACGTAC")), regions), "chrom", "a", "stop", "piece") == [("c1", 2, 5, "GTA")]


def _table(spark, places):
    return spark.createDataFrame([(k, "chr1", a, b) for k, (a, b) in enumerate(places)], "row_idx long, chr string, start long, stop long")


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlap_summary(spark, width):
    a, b = _table(spark, [(10, 20), (30, 40), (50, 60)]), _table(spark, [(5, 12), (14, 16), (18, 25), (35, 36), (70, 80)])
    assert rows(intervals.overlap_summary(a, b, width), "start", "n", "m", "u", "v") == [(10, 3, 9, 1, 3), (30, 1, 2, 1, 2), (50, 0, 0, 0, 0)]
    assert rows(intervals.overlap_summary(a, b.withColumn("chr", F.lit("x")), width, by_chr=True), "n") == [(0,)] * 3


@pytest.mark.parametrize("by_chr", [False, True])
def test_overlaps_of_nested_intervals(spark, by_chr):
    rnd = random.Random(4)
    some = lambda n, most: [(f"c{rnd.randrange(3)}", s := rnd.randrange(-40, 300), s + rnd.choice([0, 1, 5, rnd.randrange(most)])) for _ in range(n)]
    one, two = some(80, 30), some(120, 400) + [("c0", -1000, 1000)] * 3
    a, b = (spark.createDataFrame([(k, *x) for k, x in enumerate(t)], "row_idx long, chr string, start long, stop long") for t in (one, two))
    want = []
    for c, s, e in one:
        m = [(max(s, x), min(e, y), s <= x and y <= e) for d, x, y in two if (c == d or not by_chr) and s <= y and x <= e]
        want.append((c, s, e, len(m), sum(y - x + 1 for x, y, _ in m), sum(i for *_, i in m), sum(y - x + 1 for x, y, i in m if i)))
    assert rows(intervals.overlap_summary(a, b, 64, by_chr), "chr", "start", "stop", "n", "m", "u", "v") == sorted(want)


def test_alignments(spark):
    sam = spark.createDataFrame([(1, "chr1", 90, "10M"), (2, "chr1", 89, "10M"), (3, "chr1", 200, "5M"), (4, "chr1", 201, "5M"), (5, "chr2", 150, "5M")], "row_idx long, rname string, pos long, cigar string")
    transcripts = spark.createDataFrame([("chr1", 100, 200), ("chr1", 120, 130)], "chr string, start long, stop long")
    assert rows(intervals.alignments(sam, transcripts), "row_idx") == [(1,), (3,)]
    assert rows(intervals.alignments(sam, transcripts, invert=True), "row_idx") == [(2,), (4,), (5,)]
    assert rows(intervals.alignments(sam, transcripts, fixed=True), "row_idx") == [(3,)]


@pytest.mark.parametrize("width", [7, 64, 1024])
def test_intervals_against_all_pairs(spark, width):
    rnd = random.Random(width)
    some = lambda n: [(s := rnd.randrange(-50, 400), s + rnd.randrange(-1, 60)) for _ in range(n)]
    reads, other = [(s, max(e, s)) for s, e in some(60)], some(25) * 2
    a, b = _table(spark, reads), _table(spark, other)
    meet = [[(max(s, x), min(e, y), s <= x and y <= e) for x, y in other if x <= y and s <= y and x <= e] for s, e in reads]
    want = sorted((s, e, len(m), sum(y - x + 1 for x, y, _ in m), sum(i for *_, i in m), sum(y - x + 1 for x, y, i in m if i)) for (s, e), m in zip(reads, meet, strict=True))
    assert rows(intervals.overlap_summary(a, b, width), "start", "stop", "n", "m", "u", "v") == want
    sam = a.select("row_idx", F.lit("chr1").alias("rname"), F.col("start").alias("pos"), F.concat((F.col("stop") - F.col("start")).cast("string"), F.lit("M")).alias("cigar"))
    hit = [k for k, m in enumerate(meet) if m]
    found = intervals.alignments(sam, b.withColumn("chr", F.lit("chr1")), width=width)
    first = a.agg(F.min("row_idx")).first()[0]
    assert rows(found, "row_idx") == [(k + first,) for k in hit]


def test_alignments_of_a_deep_place(spark):
    at = F.col("id") % 300
    reads = spark.range(20_000).select(F.col("id").alias("row_idx"), F.lit("c").alias("rname"), (at + 1).alias("pos"), F.lit("40M").alias("cigar"))
    over = spark.range(20_000).select(F.lit("c").alias("chr"), at.alias("start"), (at + 1000 + F.col("id")).alias("stop"))
    assert intervals.alignments(reads, over).count() == 20_000 and intervals.alignments(reads, over, invert=True).count() == 0


LINKS = "A B,B C,A C,D C,E F,E G,F G,G H,H I,I J,L M"


def test_graph(spark):
    links = spark.createDataFrame([(*x.split(), "") for x in LINKS.split(",")], "a string, b string, desc string")
    assert [r.text for r in graph.subgraphs(links).orderBy("component").collect()] == ["A B C D", "E F G H I J", "L M"]
    assert graph.subgraphs(links, 3).count() == 2
    assert graph.subgraphs(links, edges=True).orderBy("component").first().text.splitlines()[1:] == ["   A B", "   A C", "   B C", "   C D"]
    noted = spark.createDataFrame([("b", "a", "why")], "a string, b string, desc string")
    assert graph.subgraphs(noted, dot=True).first().text == 'graph {\n"a" ; "b";\n   "b" -- "a";  # why\n}'


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(900, 900), (None, 5)], "a long, b long")
    out = graph.components(chain.unionByName(more))
    assert rows(out.groupBy("component").count(), "component", "count") == [(0, 301), (900, 1)]
