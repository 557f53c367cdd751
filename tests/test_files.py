from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helixframe.operators import search, statistics, transforms
from helixframe.sources import readers, writers
from helixframe.streaming import sequences as streams


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("; words before\nACGT\n>s1 one\nac gt\n12 GG\n>\nTT\n>s3\n")
    (tmp_path / "b.fa").write_text(">t1\r\nAC\r\nGT\r\n>>odd\nA")
    rows = readers.read_fasta(spark, str(tmp_path), "upper", True).orderBy("seq_idx").collect()
    assert [(r.seq_idx, r.header, r.seq) for r in rows] == [(1, "s1 one", "ACGTGG"), (2, "", "TT"), (3, "s3", ""), (4, "t1", "ACGT"), (5, ">odd", "A")]
    assert rows[0].seq_raw == "ac gt\n12 GG" and rows[0].path.endswith("a.fa")


def test_fasta_in_small_splits(spark, tmp_path):
    want = [(f"s{k} x", "ACGTN" * (k % 7)) for k in range(60)]
    (tmp_path / "a.fa").write_text("".join(f">{h}\n{s}\n" for h, s in want))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.header, r.seq) for r in sorted(rows, key=lambda r: r.seq_idx)] == want
    assert sorted(r.seq_idx for r in rows) == list(range(1, 61))


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1/1\nACGT\n+\nIIII\n@r2/1 x\nGG\n+r2\n##\n")
    rows = readers.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("seq_idx").collect()
    assert [tuple(r) for r in rows] == [(1, "@r1/1", "ACGT", "+", "IIII"), (2, "@r2/1 x", "GG", "+r2", "##")]
    (tmp_path / "bad.fq").write_text("r1\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        readers.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_tables(spark, tmp_path):
    (tmp_path / "i").write_text("chr1 5 9 + x\n\n chr2\t1 2\n")
    assert [tuple(r) for r in readers.read_interval_table(spark, str(tmp_path / "i")).orderBy("row_idx").drop("row_idx", "line").collect()] == [("chr1", 5, 9), ("chr2", 1, 2)]
    (tmp_path / "c").write_text("2-5 one two\n9 4\n-3 6 neg\nwords\n")
    assert sorted(tuple(r) for r in readers.read_cut_list(spark, str(tmp_path / "c")).collect()) == [(0, 6, "neg"), (2, 5, "one two"), (4, 9, "")]
    (tmp_path / "d").write_text("7\n")
    with pytest.raises(Exception, match="two numbers"):
        readers.read_cut_list(spark, str(tmp_path / "d")).collect()
    (tmp_path / "s").write_text("@HD\tVN:1\nr1\t0\tchr1\t100\t60\t10M\t*\n")
    assert readers.read_sam(spark, str(tmp_path / "s")).select("rname", "pos", "cigar").first() == ("chr1", 100, "10M")
    (tmp_path / "e").write_text("A B # why not\n\n  C D\nE\n")
    assert sorted(tuple(r) for r in readers.read_edges(spark, str(tmp_path / "e")).collect()) == [("A", "B", "why not"), ("C", "D", ""), ("E", "", "")]
    (tmp_path / "l").write_text("s1 \ns2\ns1\n")
    assert sorted(r.id for r in readers.read_ids(spark, str(tmp_path / "l")).collect()) == ["s1", "s2"]
    (tmp_path / "r").write_text("chr1 5 9 a b\n")
    assert tuple(readers.read_regions(spark, str(tmp_path / "r")).first()) == ("chr1", 5, 9, "a b")
    assert [tuple(r) for r in readers.interval_list(spark, "2-5, 9-4").collect()] == [(2, 5, ""), (4, 9, "")]
    with pytest.raises(ValueError):
        readers.interval_list(spark, "5")


def test_round_trip(spark, seqs, tmp_path):
    s = seqs(("a x", "ACGT" * 40), ("b", "GG"))
    writers.write_fasta(s, str(tmp_path / "out"))
    back = readers.read_fasta(spark, str(tmp_path / "out"))
    assert sorted((r.header, r.seq) for r in back.collect()) == [("a x", "ACGT" * 40), ("b", "GG")]
    writers.write_chunks(s, str(tmp_path / "chunks"), 2)
    named = lambda folder: sorted(p.name for p in (tmp_path / folder).iterdir() if not p.name.startswith((".", "_")))
    assert named("chunks") == ["chunk_0.fasta", "chunk_1.fasta"] and (tmp_path / "chunks" / "chunk_1.fasta").read_text() == ">b\nGG\n"
    assert sorted(r.fname for r in writers.write_split(s, str(tmp_path / "split"), separator=" ", field=0, extension="fa").collect()) == ["a.fa", "b.fa"]
    assert named("split") == ["a.fa", "b.fa"] and (tmp_path / "split" / "b.fa").read_text() == ">b\nGG\n"
    genome = readers.read_genome(spark, str(tmp_path / "split"))
    assert sorted((r.chrom, r.header, r.seq[:2]) for r in genome.collect()) == [("a", "a a x", "AC"), ("b", "b b", "GG")]
    assert sorted(r.chrom for r in readers.read_genome(spark, str(tmp_path / "out"), by_file=False).collect()) == ["a", "b"]


def test_reports(seqs):
    s = seqs(("r1 x", "TTGTAAAAACAG"))
    line = lambda df, column, n=1: sorted(r[0] for r in df.select(column).collect())[:n]
    assert line(statistics.kmers(s, 2).where("kmer = 'AC'"), writers.kmer_report()) == ["AC/GT          1          1          2   9.090909   9.090909   9.090909"]
    assert line(statistics.codon_frequencies(s).where("codon = 'TTG'"), writers.codon_report()) == ["L TTG           1    25.000   100.000"]
    assert line(statistics.lengths(s), writers.length_report()) == ["        12 r1 x"]
    assert line(statistics.composition(s).where("base = 'A'"), writers.composition_report()) == ["A:          6  50.00 "]
    assert line(statistics.ngrams(s, 3).where("ngram = 'AAA'"), writers.ngram_report(True)) == ["AAA  30.000000"]
    assert line(search.longest_runs(s), writers.run_report(terse=True)) == ["    5"] and line(search.longest_runs(s), writers.run_report(True)) == ["r1 x:     5    4"]
    hits = search.motif_hits(s, "GTaac", 1, neighbours=2).where("dir = 'f'")
    assert line(hits, writers.hit_report(True)) == ["         3  f  TT GTAAA AA  1"]
    assert line(search.motif_hits(s, "GTaac", 1).where("dir = 'f'"), writers.hit_report()) == ["GTAAA f  1 GTAAA          3"]


def test_stream(spark, seqs, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">s1\nACGT\nAC\n>s2\nGG\n")
    stream = streams.stream_fasta(spark, str(tmp_path / "in"))
    for name, df, mode in (("words", streams.running_words(stream, 2), "complete"), ("proteins", transforms.translations(stream.drop("path", "seq_raw"), "F1"), "append")):
        run = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        run.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("words").collect()) == [("AC", 2), ("CG", 1), ("GG", 1), ("GT", 1), ("TA", 1)]
    assert sorted((r.header, r.seq) for r in spark.table("proteins").select("header", F.col("seq")).collect()) == [("s1-F1", "TY"), ("s2-F1", "")]
