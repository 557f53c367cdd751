from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from helixframe.llm import mixing, quality_classifier, queries, secrets

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, str(DATA)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == columns
        rows = {r.doc_id: r for r in before.collect()}
        if k == 0:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in quality_classifier.classify(before).collect() if r.kept}
        elif k == 1:
            kept = {r.doc_id: shingles(r.text) for r in after.collect()}
            alike = lambda a, b: len(a & b) / len(a | b)
            held = {i: shingles(r.text) for i, r in rows.items()}
            gone = held.keys() - kept.keys()
            for i in gone:  # each is a copy of a document, of a smaller id and similar, or of one that is
                assert any(alike(held[i], s) > 0.6 for j, s in held.items() if j != i), i
            for i, s in kept.items():
                assert not any(j < i and alike(s, t) > 0.97 for j, t in kept.items()), i
            assert gone
        elif k == 2:
            spans = {r.doc_id: r.spans for r in secrets.scan(before).collect()}
            for r in after.collect():
                assert (r.text == rows[r.doc_id].text) == (spans[r.doc_id] == "") and r.n_chars == len(r.text) and r.source == rows[r.doc_id].source
        elif k == 3:
            want = Counter()
            for r in mixing.mix(before).collect():
                want[r.doc_id] += r.copies
            want = +want
            assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == want
        else:
            assert after.groupBy().sum("length").first()[0] > 0
        before = after


def test_odd_documents(spark, odd, none):
    """Each stage, on nulls, empty and very long texts, repeated rows and columns of names that stages use."""
    odd = odd.withColumnRenamed("copies", "__copies").withColumnRenamed("of", "__of").withColumnRenamed("size", "__copy")
    some = {}
    for name, stage in corpus_pipeline.STAGES:
        some[name] = stage(spark, odd, "")
        assert name == "packing" or some[name].columns == odd.columns
        some[name] = some[name].collect()
        assert stage(spark, none, "").count() == 0, name
    given = Counter((r.doc_id, r.text) for r in odd.collect())
    kept = Counter((r.doc_id, r.text) for r in some["quality_classifier"])
    assert all(kept[k] in (0, n) for k, n in given.items()), "equal rows share their verdict"
    assert sorted(str(r.doc_id) for r in some["simhash_near_dedup"]) == sorted(map(str, {1, None, 4, 5, 6, 7}))
    assert Counter((r.doc_id, r.text) for r in some["secret_scan"]) == given, "no credential, so nothing changes"
    mixed = Counter((r.doc_id, r.text) for r in some["source_mixing"])
    assert mixed.keys() <= given.keys() and all(n <= 2 * given[k] for k, n in mixed.items()) and {r["__copy"] for r in some["source_mixing"]} == {-1}
    assert {r.doc_id for r in some["packing"]} == {k for k, _ in given}


def test_rows_of_one_id(spark, docs):
    rows = docs((1, "a b c d e f"), (1, "entirely other words than those"), (1, "entirely other words than those"), (2, "u v w x y z"))
    one = corpus_pipeline.one_of_each_group(spark, rows, "").collect()
    assert sorted((r.doc_id, r.text[0]) for r in one) == [(1, "a"), (1, "e"), (2, "u")]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = __spark_entry__.queries()[name](spark, str(DATA))
    want = con.sql(__spark_entry__.oracle_sql()[name])
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted([*queries.QUERIES, "pipeline"]))
def test_registered(spark, name):
    assert __spark_entry__.queries()[name](spark, str(DATA)).collect()
