from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from helixframe.llm import packing, token_counts
from helixframe.llm.encoders import encoder, public_path

JSON = public_path("byte_bpe_50k.json")
PIECES = ["a", " ", "\n", "the ", " '", "s", "é", "1", "　", ".", "\u0085", "<|endoftext|>", "\x1c", "'re", "👍", "\r\n"]


def test_both_readers_agree():
    rnd, one, two = random.Random(0), encoder(JSON), encoder(public_path("byte_bpe_50k.tiktoken"))
    for _ in range(500):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40)))
        assert one(text).tolist() == two(text).tolist(), text


def test_packed_ids_are_those_of_the_named_reader(docs):
    model, rnd = Tokenizer.from_file(JSON), random.Random(1)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", *("".join(rnd.choice(PIECES) for _ in range(40)) for _ in range(100))]
    rows = sorted(packing.pack(docs(*enumerate(texts))).collect(), key=lambda r: (r.doc_id, r.start))
    for i, text in enumerate(texts):
        ids = np.frombuffer(b"".join(r.ids for r in rows if r.doc_id == i), "<u4").tolist()
        assert ids == [*model.encode(text, add_special_tokens=False).ids, 1], text


def counts():
    encode = encoder(public_path("byte_bpe_50k.tiktoken"), special=False)
    return token_counts.Counts(lambda t: len(encode(t)))


def test_edits():
    rnd, encode = random.Random(5), encoder(public_path("byte_bpe_50k.tiktoken"), special=False)
    for _ in range(1500):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 60)))
        tree = token_counts.TokenTree(text, counts())
        assert tree.n_tokens == len(encode(text))
        for _ in range(6):
            a = rnd.randint(0, len(text))
            b = rnd.randint(a, min(len(text), a + 9))
            new = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 4)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.n_tokens == len(encode(text))


@pytest.mark.parametrize("text", ["some words here " * 5000, "some words " * 36, "line\n" * 80, "two  spaces  each " * 25, "tab\tand\n\nnewline\r\n" * 20, "a,b;c!" * 60])
def test_an_edit_encodes_its_neighbourhood_alone(text):
    tree = token_counts.TokenTree(text, counts())
    at = len(text) // 2
    tree.edit(at, at + 3, "new")
    assert 0 < tree.encoded < 40
    with pytest.raises(ValueError):
        tree.edit(5, 10**6, "")


def test_counts(docs, odd, none):
    encode = encoder(public_path("byte_bpe_50k.tiktoken"))
    texts = {1: "Write to a.b@c.example.org or +1 (372) 555-7739 now", 2: "call 0301 234 5678.", 3: None}
    out = {r.doc_id: r for r in token_counts.edited_counts(docs(*texts.items()), token_counts.masked_addresses).collect()}
    assert out[1].edited_text.startswith("Write to <mail> or") and out[2].edited_text == "call <phone>." and out[3].n_tokens == 0
    for r in out.values():
        assert (r.n_tokens, r.n_tokens_edited) == (len(encode(texts[r.doc_id] or "")), len(encode(r.edited_text)))
    assert token_counts.edited_counts(odd, token_counts.masked_addresses).count() == 9
    assert token_counts.edited_counts(none, token_counts.masked_addresses).count() == 0


def held(df, **options):
    rows = packing.pack(df, **options).collect()
    room = options.get("room", 2048)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= room
        padding += room - at if at & (at - 1) else 0
    return docs, padding


@pytest.mark.parametrize("window", [64, 5000, 1 << 22])
def test_round_trip(docs, window):
    rnd, encode = random.Random(window), encoder(JSON)
    texts = {i: "".join(rnd.choice(PIECES) for _ in range(rnd.choice([0, 3, 30, 900, 4000]))) for i in range(60)}
    out, padding = held(docs(*texts.items()), room=256, window=window)
    assert padding == 0 and set(out) == set(texts)
    for i, pieces in out.items():
        pieces.sort(key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()
        assert ids == [*encode(texts[i]).tolist(), 1]
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]] and {r.doc_tokens for r in pieces} == {len(ids)}


def test_windows_bound_documents(docs, monkeypatch):
    monkeypatch.setattr(packing, "DOCUMENTS", 10)
    out, padding = held(docs(*[(i, None) for i in range(95)]))
    assert padding == 0 and len(out) == 95 and not packing.layout(np.zeros(0, np.int64))


def test_pack_edges(odd, none):
    out, padding = held(odd)
    assert padding == 0 and {r.doc_tokens for r in out[1] + out[2]} == {1} and None in out and len([r for r in out[4] if r.start == 0]) == 2
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, room=1000)


def test_costs_are_balanced():
    rnd = np.random.default_rng(1)
    lengths = rnd.integers(20, 600, 3000)
    cost = defaultdict(float)
    for _, _, n, s in packing.layout(lengths):
        cost[s] += n + n * n / 2048
    full = [c for s, c in cost.items() if s < lengths.sum() // 2048]
    assert max(full) < 1.25 * np.mean(full)
