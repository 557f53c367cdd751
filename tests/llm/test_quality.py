from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import quality_classifier as qc
from helixframe.llm import quality_rules as qr

DATA = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    out = qc.classify(docs).join(labels.where("toxic = 0"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in out.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.05


def test_estimation_finds_the_classes():
    rnd = np.random.default_rng(0)
    y = rnd.choice(4, 20_000, p=[0.8, 0.1, 0.05, 0.05])
    bad = np.array([[0.02] * 8, *([0.9 if j in kind else 0.1 for j in range(8)] for kind in qc.SEES)])
    v = np.where(rnd.random((len(y), 8)) < 0.2, 1, np.where(rnd.random((len(y), 8)) < bad[y], 0, 2))
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = qc.estimated(patterns, counts.astype(float))
    assert abs(model.share[0] - 0.8) < 0.02 and np.abs(model.p[0, :, 0] - 0.02).max() < 0.02
    true = qc.Labellers(np.stack([bad, np.ones_like(bad), 1 - bad], 2), np.array([0.8, 0.1, 0.05, 0.05]))
    right = [((m.posterior(v) > 0.5) == (y == 0)).mean() for m in (model, true)]
    assert right[0] > right[1] - 0.005, "as good as with the true accuracies"


def test_scores_equal_the_laid_out_product():
    texts = [b"", b"a", "Ein kurzer Satz über Öl.".encode(), b"x | y\n" * 50, b" \n "]
    x, _ = qc.vectors(texts)
    w = np.random.default_rng(1).standard_normal(qc.SIZE).astype(np.float32)
    assert np.allclose(qc.scores(texts, w), 1 / (1 + np.exp(-(x @ w))), atol=1e-5)


def test_classifier_edges(odd, none):
    rows = qc.classify(odd).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and len({r.score for r in rows if r.doc_id == 4}) == 1
    assert qc.classify(none).count() == 0
    assert qc.good_documents(odd).columns == odd.columns


def measured_brute(raw):
    words, symbols = raw.split(), set(b"#*$%&|<>{}[]\\^~_=+@!")
    visible = [c for c in raw if c not in b" \t\n\x0b\f\r"]
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    letters, n = sum(map(letter, raw)), max(1, len(words))
    stop = {w.encode() for w in qc.STOP_WORDS.split()}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    fours = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    cuts = [*range(0, max(1, len(words) // qc.BLOCK) * qc.BLOCK, qc.BLOCK), len(words)]
    return [
        sum(c in symbols for c in raw) / max(1, len(visible)), sum(65 <= c <= 90 for c in raw) / max(1, letters), sum(len(set(words[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)) / n,
        sum(w.lower() in stop for w in words) / n, len(words), letters / max(1, len(visible)), 1 - len(set(lines)) / len(lines) if lines else 0,
        1 - len(set(fours)) / len(fours) if fours else 0, sum(any(c in symbols for c in w) for w in words) / n,
    ]


def classified_brute(texts):
    """Every document's votes and expectation-maximisation over documents, then descent on the laid-out features, all plain."""
    raws = [(t or "").encode() for t in texts]
    measures = [measured_brute(r) for r in raws]
    votes = qc.votes(np.array(measures))
    kinds = [set(), *map(set, qc.SEES)]
    miss = [[0.03 if c == 0 else 0.7 if j in kinds[c] else 0.1 for j in range(8)] for c in range(4)]
    share, first = [0.85, 0.05, 0.05, 0.05], [list(r) for r in miss]

    def likely(v):
        odds = [share[c] * math.prod(miss[c][j] if x == 0 else 1 - miss[c][j] if x == 2 else 1 for j, x in enumerate(v)) for c in range(4)]
        return [o / sum(odds) for o in odds]

    for _ in range(200):
        q = [likely(v) for v in votes]
        for c in range(4):
            for j in range(8):
                bad = 20 * first[c][j] + sum(p[c] for p, v in zip(q, votes, strict=True) if v[j] == 0)
                good = 20 * (1 - first[c][j]) + sum(p[c] for p, v in zip(q, votes, strict=True) if v[j] == 2)
                miss[c][j] = bad / (bad + good)
        mass = [sum(p[c] for p in q) + 10 * s for c, s in enumerate((0.85, 0.05, 0.05, 0.05))]
        share = [m / sum(mass) for m in mass]
    y = np.array([likely(v)[0] for v in votes])
    x, _ = qc.vectors(raws)
    x = x.astype(np.float16).astype(float)
    w, m1, m2 = np.zeros(qc.SIZE), 0.0, 0.0
    for k in range(1, 151):
        grad = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y) + 1e-4 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w -= 0.05 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
    return 1 / (1 + np.exp(-(qc.vectors(raws)[0].astype(float) @ w)))


def test_classify_brute_force(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if DATA.exists() else docs(*[(i, f"some words and the rest of it {i} " * 20) for i in range(150)])
    rows = [(r.doc_id, r.text) for r in table.collect()]
    out = {r.doc_id: r for r in qc.classify(docs(*rows)).collect()}
    for (i, t), want in zip(rows, classified_brute([t for _, t in rows]), strict=True):
        assert out[i].score == pytest.approx(want, abs=2e-3), t
        assert out[i].kept == (want >= 0.5) or abs(want - 0.5) < 2e-3


def test_measures_do_not_depend_on_length():
    raws = [b"one two three four " * 7, b"", b"w", " ".join(f"w{i * 7919 % 4001}" for i in range(20_000)).encode(), b"a b\na b\n" * 300]
    assert np.allclose(qc.measured(raws)[0], [measured_brute(r) for r in raws])
    assert qc.measured(raws[3:4])[0][0, 2] > 0.95, "a long text of many words stays one"


def test_sample_does_not_depend_on_partitions(docs):
    rows = [(None if i % 3 else 5, f"the same and another text {i % 90} with words " * 9) for i in range(600)]
    one, two = (qc.learn(docs(*rows, parts=p), sample=40).weights for p in (2, 5))
    assert np.array_equal(one, two)


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if at[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(docs, odd, none):
    texts = {1: "a b c d e f g h " * 3 + "x\n\n \nq & r\nq & r\nq & r ", 2: "n " * 9, 3: "<a> #b *c $d %e |f", 4: "\n".join(["same line here"] * 4)}
    for df in (docs(*texts.items()), odd):
        text = {(r.doc_id, r.text): r.text for r in df.collect()}
        want = sorted((i or -1, *brute(t)) for (i, _), t in text.items())
        rows = qr.measures(df).collect()
        assert sorted({(r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}) == want
    assert qr.measures(none).count() == 0


def test_no_python_in_the_plan(spark, docs):
    plan = qr.measures(docs((1, "x")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize(("k", "n", "rate"), [(0, 10, 0.1), (3, 200, 0.05), (40, 5000, 0.0125), (0, 10**6, 0.01), (0, 0, 0.1)])
def test_binomial_tail(spark, k, n, rate):
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(rate) + (n - j) * math.log(1 - rate)) for j in range(k + 1))
    got = spark.sql(f"SELECT {k}L AS k, {n}L AS n").select(qr.binomial_tail(F.col("k"), F.col("n"), rate)).first()[0]
    assert got == pytest.approx(1.0 if k >= n * rate else want, rel=1e-9)


def test_cutoffs_hold_their_limit(spark, docs):
    words = "and it was said that there is more in the house than on the street and no one of us did know of it all "
    rows = [(i, words + f"w{i} " + "# " * (i % 40 == 0) * 9, "en" if i % 2 else None, "s") for i in range(1, 6001)]
    rows += [(10_000 + i, words + f"v{i} " + "# " * 20, "en", "s") for i in range(200)] + [(20_000, "too short", "xx", "s")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 6001)] + [(1, 1, 0), (None, 1, 0), (10_001, 0, 0), (10_002, None, 0), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in qr.judge(docs(*rows), labels).collect()}
    assert len(out) == 6201
    assert not any(out[10_000 + i].kept for i in range(200)), "clear junk goes"
    for odd in (0, 1):  # of each stratum 5 % at most
        good = [out[i].kept for i in range(1, 6001) if i % 2 == odd]
        assert good.count(False) <= 0.05 * len(good)
    assert out[20_000].base_failed and not out[20_000].kept
    few = {r.doc_id: r for r in qr.judge(docs(*rows), labels.where("doc_id < 20")).collect()}
    assert all(r.kept == (not r.base_failed) for r in few.values()), "few labels allow no cutoff"
