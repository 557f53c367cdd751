"""LM scores, mixing and SimHash."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from helixframe.llm import lm_scoring, mixing, packs, simhash


def lm_brute(texts, order, least=1):
    grams = []
    for t in texts:
        w = (t or "").encode().split()
        grams.append(Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)))
    whole = Counter()
    for g in grams:
        whole.update(g)
    out = []
    for t, own in zip(texts, grams, strict=True):
        w = (t or "").encode().split()
        count = lambda k: whole[k] - own[k]  # noqa: B023, E731
        total = max(1, sum(c for k, c in whole.items() if len(k) == 1) - len(w))

        def s(context, x):
            if not context:
                return (count((x,)) or 0.4) / total  # noqa: B023
            n = count((*context, x))  # noqa: B023
            return n / count(context) if n >= least else 0.4 * s(context[1:], x)  # noqa: B023

        out.append(sum(math.log(s(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(len(w))))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores(docs, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "PACK_BYTES", 500)  # many packs
    rnd = random.Random(order)
    texts = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 40))) for _ in range(60)] + [None, "", "q"]
    out = {r.doc_id: r for r in lm_scoring.score(docs(*enumerate(texts)), order).collect()}
    for i, want in enumerate(lm_brute(texts, order)):
        assert out[i].log_score == pytest.approx(want, abs=1e-8)
        assert out[i].mean_log_score == (pytest.approx(want / out[i].n_words) if out[i].n_words else None)
    pruned = {r.doc_id: r.log_score for r in lm_scoring.score(docs(*enumerate(texts)), order, min_count=3).collect()}
    for i, want in enumerate(lm_brute(texts, order, 3)):
        assert pruned[i] == pytest.approx(want, abs=1e-8)


def test_lm_edges(odd, none):
    rows = odd.collect()
    want = sorted(zip([r.doc_id or -1 for r in rows], lm_brute([r.text for r in rows], 3), strict=True))
    got = sorted((r.doc_id or -1, r.log_score) for r in lm_scoring.score(odd).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    assert lm_scoring.score(none).count() == 0
    with pytest.raises(ValueError):
        lm_scoring.score(none, 1)


def test_lm_shuffled_rows(docs):
    """Input that follows a shuffle is settled before packs are numbered."""
    texts = [f"a b c{i % 7} d e{i % 5}" for i in range(40)]
    out = {r.doc_id: r.log_score for r in lm_scoring.score(docs(*enumerate(texts)).repartition(5, "text")).collect()}
    assert np.allclose([out[i] for i in range(40)], lm_brute(texts, 3))


def test_codes():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 999, dtype=np.uint64) * np.uint64(2))
    for k in (keys, keys[:1], np.arange(5, dtype=np.uint64)):
        assert np.array_equal(lm_scoring.keys_in(lm_scoring.keys_out(k)), k)
    n = np.array([1, 300, 70_000, (1 << 32) - 1, 1 << 40])
    assert np.array_equal(lm_scoring.numbers_in(lm_scoring.numbers_out(n)), n)
    pack = packs.Pack(packs.freeze([5, None, 2], [b"b c", None, "é".encode()]))
    assert pack.id_list() == [2, 5, None] and pack.raw == ["é".encode(), b"b c", b""]


def filled(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    free, total = set(names), 1.5 * sum(sizes.values())
    while True:
        unit = (total - sum(2 * sizes[s] for s in sizes if s not in free)) / max(1e-9, sum(w[s] for s in free))
        over = {s for s in free if unit * w[s] > 2 * sizes[s]}
        if not over:
            return {s: unit * w[s] if s in free else 2 * sizes[s] for s in names}
        free -= over


def test_mix(docs, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 50)
    monkeypatch.setattr(mixing, "FAN", 3)
    rnd = random.Random(3)
    sources = ["b", "a", "Z", "é", None, "hot", "none"]
    rows = [(i, "w " * (rnd.randint(1, 30) if s != "none" else 0), "en", s) for i in range(3000) for s in [rnd.choice([*sources, *["hot"] * 6])]]
    df = docs(*rows)
    out = mixing.mix(df).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size <= 2 * r.size
    want = filled(sizes)
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 15.01, "half of one document of 30 words"
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def test_rounding_is_fair():
    copies = np.zeros(40)
    for seed in range(400):
        rows = [[f"k{i}", 1 + i % 7, 0, 0.3] for i in range(40)]
        mixing.pivot(rows, seed, True)
        assert all(r[3] is None for r in rows) and abs(sum(r[1] * (r[2] - 0.3) for r in rows)) <= 7
        copies += [r[2] for r in rows]
    assert np.abs(copies / 400 - 0.3).max() < 0.12


def test_mix_edges(odd, none):
    assert len(mixing.mix(odd).collect()) == 9 and mixing.mix(none).count() == 0


def print_brute(text, k=4):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, distance):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("distance", [0, 3, 4, 6])
def test_links(spark, distance):
    rnd = random.Random(distance)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    prints = {i: rnd.choice(centres) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for i in range(250)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    reps = spark.createDataFrame([(signed(f), i) for i, f in prints.items()], "fp long, rep long").groupBy("fp").agg({"rep": "min"}).toDF("fp", "rep")
    want = groups({r.rep: r.fp % (1 << 64) for r in reps.collect()}, distance)
    roots = {i: i for i in want} | {r.node: r.component for r in simhash.components(simhash.simhash_links(reps, distance)).collect()}
    assert roots == want


def test_near_duplicates(docs):
    rnd = random.Random(8)
    base = [" ".join(rnd.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta"]) + str(rnd.randint(0, 99)) for _ in range(200)) for _ in range(8)]
    rows = []
    for i in range(120):
        words = base[i % 8].split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(200)] = "changed"
        rows.append((i * 7 % 121, rnd.choice([str.upper, str.lower])(rnd.choice([" ", "\n"]).join(words))))
    rows += [(500, None), (501, ""), (502, "two words"), (503, "TWO  words"), (504, "a b c d"), (None, base[0])]
    out = simhash.near_duplicates(docs(*rows)).collect()
    assert len(out) == len(rows)
    prints = {i: print_brute(t) for i, t in rows if i is not None}
    assert {r.doc_id: r.fp % (1 << 64) for r in out if r.doc_id is not None} == prints
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == groups(prints, 4)
    assert [r.component_id for r in out if r.doc_id is None] == [None]


def test_simhash_edges(odd, none):
    out = defaultdict(set)
    for r in simhash.near_duplicates(odd).collect():
        out[r.doc_id].add(r.component_id)
    assert out[1] == out[2] == out[3] == {1} and out[4] == {4} and out[None] == {None}
    assert simhash.near_duplicates(none).count() == 0


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) > k else {tuple(w)}


def test_near_copies_go(docs, odd, none):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta"]) + str(rnd.randint(0, 99))
    rows = []
    for i in range(40):
        words = [word() for _ in range(300)]
        rows.append((i, " ".join(words)))
        for j in range(1, 5):
            near = list(words)
            for at in rnd.sample(range(300), j):
                near[at] = word()
            rows.append((1000 * j + i, " ".join(near)))
    rows += [(7, "another text of the same id " * 3), (7, "another text of the same id " * 3), (None, "no id at all, but a text"), (None, "no id at all, but a text"), (9000, rows[0][1])]
    kept = simhash.without_near_copies(docs(*rows)).collect()
    clusters = {r.doc_id for r in kept} - {None}
    assert set(range(40)) <= clusters and len(kept) == len(set(map(tuple, kept)))
    assert sum(r.doc_id == 7 for r in kept) == 2 and sum(r.doc_id is None for r in kept) == 1 and 9000 not in clusters
    caught = total = 0
    for i in range(40):
        for j in range(1, 5):
            a, b = shingles(rows[5 * i][1]), shingles(rows[5 * i + j][1])
            if len(a & b) / len(a | b) >= 0.9:
                total += 1
                caught += 1000 * j + i not in clusters
    assert total > 50 and caught >= 0.9 * total
    assert {r.doc_id for r in simhash.without_near_copies(odd).collect()} == {1, None, 4, 5, 6, 7}
    assert simhash.without_near_copies(none).count() == 0


def test_near_copies_are_those_of_all_pairs(docs, monkeypatch):
    """Pairs on both sides of 0.8, texts of one fingerprint that share little, frequent passages; against brute force."""
    monkeypatch.setattr(simhash, "PACK", 1 << 10, raising=False)
    rnd = random.Random(10)
    word = lambda: f"w{rnd.randint(0, 9999)}"
    common, rows = " ".join(word() for _ in range(60)), []
    for i in range(60):
        words = [word() for _ in range(240)]
        near = list(words)
        for at in range(15, 15 + 35 * (6 - i % 2), 35):
            near[at] = "other"
        rows += [(i, f"{common} {' '.join(words)}"), (1000 + i, f"{common} {' '.join(near[:240])}")]
    rows += [(2000 + i, "over and over again it says " * 200 + " ".join(word() for _ in range(100))) for i in range(3)]
    rows += [(3000 + i, " ".join(word() for _ in range(1 + i))) for i in range(8)]
    sets = {i: shingles(t) for i, t in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    root = {i: i for i in sets}
    for (a, b), x in sorted(alike.items()):
        if x >= 0.8:
            x, y = root[a], root[b]
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert sum(0.8 <= x < 0.86 for x in alike.values()) > 20 and sum(0.74 < x < 0.8 for x in alike.values()) + sum(x < 0.2 for x in alike.values()) > 20
    assert {r.doc_id for r in simhash.without_near_copies(docs(*rows)).collect()} == set(root.values())


def test_large_groups_make_no_square_of_rows():
    """Texts under the same shingles: each row makes a few at most, whatever the number of texts."""
    m, shared = 1000, 30
    s, rep = np.repeat(np.arange(shared), m), np.tile(np.arange(m), shared)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (s, np.full(len(s), 150), rep, rep)], ["s", "n", "rep", "root"])
    assert sum(b.num_rows for b in simhash._sharing(0.8)(iter([batch]))) <= 32 * len(s)


def test_large_groups_of_near_copies(docs, monkeypatch):
    """Versions of two texts, on both sides of 0.8 to each other, more than are paired row by row, in several blocks, none of them
    linked by fingerprints; against brute force."""
    for name, value in (("FEW", 8), ("BLOCK", 5000), ("WORD_DISTANCE", -1)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    rnd, rows = random.Random(11), []
    for base in range(2):
        words = [f"w{base}x{k}" for k in range(120)]
        for i in range(150):
            version = list(words)
            for at in rnd.sample(range(8, 112, 14), 3 + i % 3):
                version[at] = f"other{rnd.randint(0, 2 + i % 4)}"
            rows.append((1000 * base + i, " ".join(version)))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    groups = Counter(root.values())
    assert 20 < len(groups) < 250 and max(groups.values()) > 5
    assert {r.doc_id for r in simhash.without_near_copies(docs(*rows)).collect()} == set(groups)


def test_long_fingerprints():
    assert int(simhash.long_fingerprint(b"A b c d e f g", 4)[0]) == simhash.fingerprint(b"a b c d e f g", 4) and not simhash.long_fingerprint(None).any()
    assert simhash.bits_apart(0.8) == 44 and simhash.bits_apart(1.0) == 0


def test_repeated_rows_share_their_copies(docs, none):
    rows = [(None, "three words here", "en", "a")] * 5000 + [(i, "w " * (1 + i % 9), "en", "b") for i in range(2000)]
    out = mixing.mix(docs(*rows)).collect()
    assert len(out) == 7000 and all(r.copies <= 2 for r in out)
    for s in "ab":
        some = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in some) - some[0].target) <= 9
    odd_names = docs(*rows[:1], *rows[:1], (1, "x y", "fr", "b"), (1, "p q", "fr", "b")).withColumnsRenamed({"copies": "c0", "of": "times", "size": "n_rows"})
    held = mixing.copied(odd_names)
    want = sorted((r.doc_id or -1, r.copies) for r in mixing.mix(odd_names).collect())
    assert held.columns == odd_names.columns and held.count() == sum(c for _, c in want)
    texts = Counter(r.text for r in held.collect())
    assert texts["x y"] + texts["p q"] == sum(c for i, c in want if i == 1) and texts["three words here"] == sum(c for i, c in want if i == -1)
    assert mixing.copied(none).count() == 0
