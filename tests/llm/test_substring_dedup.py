from __future__ import annotations

import hashlib
import random

import pytest

from helixframe.llm.substring_dedup import COVERS, cover_of, dedup_substrings


def brute(rows, window):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def found(df, window=20):
    return sorted((tuple(r) for r in dedup_substrings(df, window).collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("period", COVERS)
def test_covers(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


def test_cover_of():
    assert cover_of(20) == (13, (0, 1, 3, 9), 8) and cover_of(2)[0] == 1


@pytest.mark.parametrize("window", [2, 5, 20])
def test_brute_force(docs, window):
    rnd = random.Random(window)
    passage = [rnd.choice("abcdefgh") * 3 for _ in range(60)]
    rows = []
    for i in range(80):
        words = [rnd.choice("abcdefghijk") + rnd.choice("xyz") for _ in range(rnd.randint(0, 50))]
        if i % 3 == 0:
            a = rnd.randint(0, 30)
            words += passage[a : a + rnd.randint(5, 30)] + words
        rows.append((rnd.randint(0, 10**6) * 100 + i, rnd.choice([" ", "\n", " \t "]).join(words)))
    assert found(docs(*rows, parts=4), window) == brute(rows, window)


def test_edges(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd) == brute(rows, 20)
    assert found(none) == []


def test_repeated_rows(docs):
    text = " ".join(f"w{k}" for k in range(30))
    out = found(docs((1, text), (1, text), (2, text)))
    assert sorted((r[0], r[2]) for r in out) == [(1, 0), (1, 30), (2, 30)]


def test_window():
    with pytest.raises(ValueError):
        dedup_substrings(None, 1)
