from __future__ import annotations

import base64
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import sequences as S
from helixframe.functions.alphabet import CODE, COMPLEMENT_FROM, IUPAC, STOPS
from helixframe.operators import transforms


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_reverse_complement(spark):
    assert one(spark, S.reverse_complement(F.lit("ACGTNmrU"))) == "UykNACGT"
    assert one(spark, S.reverse_complement(F.lit("ACGU"), rna=True)) == "ACGT"
    assert one(spark, S.strict_complement(F.lit("ACUx-"))) == "TGXXX"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(COMPLEMENT_FROM))
def test_reverse_complement_twice(spark, seq):
    assert one(spark, S.reverse_complement(S.reverse_complement(F.lit(seq)))) == seq


def test_genetic_code():
    assert len(CODE) == 64 and [c for c, a in sorted(CODE.items()) if a == "*"] == sorted(STOPS) and CODE["ATG"] == "M" and CODE["TGG"] == "W"
    assert sorted(IUPAC["B"]) == ["C", "G", "T"]


def test_translations(seqs):
    out = transforms.translations(seqs(("s", "ATGAAATAGC")), "all").orderBy("frame_no").collect()
    assert [(r.header, r.seq) for r in out] == [("s-F1", "MK*"), ("s-F2", "*NS"), ("s-F3", "EI"), ("s-R1", "AIS"), ("s-R2", "LFH"), ("s-R3", "YF")]
    assert [r.seq for r in transforms.translations(seqs(("s", "atgnnn"), ("t", "AT")), "f1").orderBy("seq_idx").collect()] == ["MX", ""]


@pytest.mark.parametrize(("begin", "length", "want"), [(2, 3, "cde"), (-3, None, "hij"), (2, -2, "cdefgh"), (20, None, ""), (0, 0, "abcdefghij"), (-30, 22, "ab"), (None, 100, "abcdefghij")])
def test_truncated(seqs, begin, length, want):
    assert transforms.truncated(seqs(("s", "abcdefghij")), begin, length).first().seq == want


def test_truncation_comment(seqs):
    assert transforms.truncated(seqs(("s", "abc")), 1, comment=True).first().header == "s Trunc:1:1000000000"


def test_digests(seqs):
    rows = transforms.digests(seqs(("a", "acgt"), ("b", "ACGT*"), ("", "AC"), ("0", "AC"), ("e", ""))).orderBy("seq_idx").collect()
    assert [(r.header, r.md5) for r in rows] == [("a", "f1f8f4bf413b16ad135722aa4591043e"), ("b", "f1f8f4bf413b16ad135722aa4591043e")]
    short = transforms.digests(seqs(("a", "acgt")), base64=True).first().md5
    assert short == base64.b64encode(hashlib.md5(b"ACGT").digest()).decode().rstrip("=") == "8fj0v0E7Fq0TVyKqRZEEPg"
    assert transforms.digest_records(seqs(("a b", "acgt"))).first().header == "f1f8f4bf413b16ad135722aa4591043e a b"


def test_cigar(spark):
    assert one(spark, S.cigar_length(F.lit("10M2I3D5N"))) == 14
    assert one(spark, S.cigar_length(F.lit("10M2I3D5N"), fixed=True)) == 18
    assert one(spark, S.cigar_length(F.lit("*"), fixed=True)) is None
    for bad in ("5S10M", "*"):
        with pytest.raises(Exception, match="cigar not understood"):
            one(spark, S.cigar_length(F.lit(bad)))


def test_bisulfite(spark):
    assert one(spark, S.bisulfite(F.lit("ACcGTNU"))) == "ATtGTNX"
    assert one(spark, S.bisulfite(F.lit("CACG"), keep_cpg=True)) == "TACG"


def test_clean(spark):
    raw = "  1 acg t\n 11 GT7a\n"
    assert one(spark, S.clean(F.lit(raw), "upper", True)) == "ACGTGT7A"
    assert one(spark, S.clean(F.lit(raw))) == "1acgt11GT7a"


def test_pretty(spark):
    assert one(spark, S.pretty(F.lit("h"), F.lit("ACGTACGTACGT"), 10, 5, 3)) == ">h\n  1 ACGTA CGTAC\n 11 GT"
    assert one(spark, S.pretty(F.lit("h"), F.lit("ACGTACGTAC"), 4, 3, 3)) == ">h\n  1 ACG T\n  5 AC GT\n  9 A C"
    assert one(spark, S.pretty(F.lit("h"), F.lit(""), 10, 5, 3)) == ">h\n  1"
    assert one(spark, S.pretty(F.lit("h"), F.lit("ACG"), numbers=False)) == ">h\nACG"


def test_records(spark):
    assert one(spark, S.fasta(F.lit("h"), F.lit("ACGTA"), 2)) == ">h\nAC\nGT\nA"
    assert one(spark, S.fasta(F.lit("h"), F.lit("ACGT"), 2)) == ">h\nAC\nGT"
    assert one(spark, S.fasta(F.lit("h"), F.lit(""), None)) == ">h"


def test_codes(spark):
    rows = spark.range(64).select("id", S.decoded(F.col("id"), 3).alias("w")).collect()
    assert [r.w for r in rows] == sorted(r.w for r in rows) and rows[27].w == "CGT"
    assert one(spark, S.encoded(F.lit("CGT"), 3)) == 27
