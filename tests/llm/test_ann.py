from __future__ import annotations

import numpy as np
import pytest

from helixframe.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, h long, id long, vector string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=5, every=50):
    known = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            known.setdefault((i, tuple(np.array(v, np.float32).tolist())), None)
    out = set()
    for q, v in known:
        if q % every == 0:
            near = {}
            for i, w in known:
                if i != q and len(w) == len(v):
                    a, b = np.array(v), np.array(w)
                    near[i] = max(near.get(i, -9), a @ b / np.sqrt(a @ a * (b @ b)))
            out |= {(q, r, i, round(s, 9)) for r, (i, s) in enumerate(sorted(near.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k], 1)}
    return out


def found(df, **options):
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(df, **options).collect()}


def test_small_tables_are_exact(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.standard_normal(16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # a vector that many rows repeat, queries among them
    assert found(table(spark, rows)) == brute(rows)


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (100, None), (150, []), (200, [0.0, 0.0]), (250, [1.0, None]),
        (300, [float("nan"), 1.0]), (350, [float("inf"), 1.0]), (None, [1.0, 2.0]), (400, [1.0, 2.0, 3.0]),
    ]
    out = found(table(spark, rows))
    assert out == brute(rows) and {r[0] for r in out} == {0, 50}
    assert found(table(spark, rows).where("vec_id < 0")) == set()


def test_buckets_and_shares(spark, monkeypatch):
    monkeypatch.setattr(ann, "AIM", 64)
    monkeypatch.setattr(ann, "SHARE", 100)
    rnd = np.random.default_rng(1)
    rows = [(i, (rnd.standard_normal(16) + (i % 3 == 0) * 2).astype(np.float32).tolist()) for i in range(2000)]
    want = brute(rows)
    got = found(table(spark, rows), candidates=300, share=0.5)
    assert len(got) == len(want)
    right = {(q, i) for q, _, i, _ in want} & {(q, i) for q, _, i, _ in got}
    assert len(right) >= 0.9 * len(want)


def test_share_is_met_whatever_the_size(spark, monkeypatch):
    monkeypatch.setattr(ann, "AIM", 4)
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.standard_normal(32).astype(np.float32).tolist()) for i in range(3000)]
    want, got = brute(rows), found(table(spark, rows), candidates=10, share=0.5)
    assert len({(q, i) for q, _, i, _ in want} & {(q, i) for q, _, i, _ in got}) >= 0.9 * len(want)
    rows += [(i, rnd.standard_normal(8).astype(np.float32).tolist()) for i in range(3000, 3200)]  # fewer than the share
    assert {x for x in found(table(spark, rows), candidates=10, share=0.5) if x[0] >= 3000} == {x for x in brute(rows) if x[0] >= 3000}


def test_near_copies_are_told_apart(spark):
    rnd = np.random.default_rng(3)
    centre = rnd.standard_normal(64)
    rows = [(i, (centre + 0.003 * rnd.standard_normal(64)).astype(np.float32).tolist()) for i in range(500)]
    rows += [(1000 + i, (np.array(rows[i][1], np.float32) * 2).tolist()) for i in range(30)]  # equal but for the length
    got, want = found(table(spark, rows), candidates=4000), brute(rows)
    assert len({(q, i) for q, _, i, _ in want} & {(q, i) for q, _, i, _ in got}) >= 0.99 * len(want)


def test_ties_go_to_the_smaller_ids(spark):
    rnd = np.random.default_rng(4)
    v = rnd.standard_normal(16).astype(np.float32)
    rows = [(i, (v * np.float32(2.0 ** (i % 7))).tolist()) for i in range(60)] + [(100 + i, rnd.standard_normal(16).astype(np.float32).tolist()) for i in range(40)]
    out = sorted(x for x in found(table(spark, rows)) if x[0] in (0, 50))
    assert [(r, i) for q, r, i, _ in out if q == 50] == [(k + 1, k) for k in range(5)] and [(r, i) for q, r, i, _ in out if q == 0] == [(k, k) for k in range(1, 6)]


@pytest.mark.parametrize("length", [1, 17, 62])
def test_prefix_ranges(length):
    keys = np.sort(np.random.default_rng(length).integers(0, 1 << 62, 500, dtype=np.uint64))
    s = keys[::7]
    a, b = ann._range(keys, s, length)
    for q, x, y in zip(s, a, b, strict=True):
        assert (y - x) == ((keys >> np.uint64(62 - length)) == (q >> np.uint64(62 - length))).sum()
