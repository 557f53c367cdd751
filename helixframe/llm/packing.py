"""Cost-balanced packing of token sequences.

A piece of n tokens costs linear * n + quadratic * n^2 (attention within its document). Windows of a few million
tokens and a hundred thousand documents are packed one after another within each input partition, so nothing is shuffled and memory is bounded. In a
window there are as many sequences as its tokens fill; documents go, in descending order of length, to the sequence of
the lowest cost that has room for them. Those that fit nowhere are cut to fill the remaining room. What is left over
512 is laid out as sequences of a power of two, which need no padding, so the layout pads nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.encoders import encoder, public_path

#: Tokens and documents of a window at most (a document of any length is whole).
WINDOW, DOCUMENTS = 1 << 22, 1 << 17
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def layout(lengths: np.ndarray, room: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of each piece; pieces of a sequence are listed in order of offset. Equal lengths
    go by document number; a length of 0 has no piece, and no lengths give none."""
    total = int(lengths.sum())
    free = [room] * (total // room) + [1 << b for b in range(room.bit_length() - 1, -1, -1) if total % room >> b & 1]
    left, cost = np.array(free, np.int64), np.zeros(len(free))
    price = lambda n: linear * n + quadratic * n * n
    pieces: list[tuple[int, int, int, int]] = []
    at = 0
    rest = []
    for d, n in enumerate(lengths.tolist()):
        for k in range(n // room):  # full sequences
            pieces.append((d, k * room, room, at))
            left[at], cost[at] = 0, price(room)
            at += 1
        if n % room:
            rest.append((n % room, d, n - n % room))
    over = []
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        fits = np.flatnonzero(left[at:] >= n)
        if not len(fits):
            over.append((n, d, start))
            continue
        to = at + int(fits[np.argmin(cost[at:][fits])])
        pieces.append((d, start, n, to))
        left[to] -= n
        cost[to] += price(n)
    holes = sorted(np.flatnonzero(left > 0).tolist(), key=lambda s: cost[s])
    for n, d, start in over:
        while n:
            to = holes[-1]
            k = min(n, int(left[to]))
            pieces.append((d, start, k, to))
            left[to] -= k
            n, start = n - k, start + k
            if not left[to]:
                holes.pop()
    return pieces


def pack(docs: DataFrame, room: int = 2048, path: str | None = None, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of sequences of at most `room` tokens.

    ids: the piece's ids, unsigned 32 bits each, little-endian. Every row of docs is a document of its own, also those
    that repeat an id or a text; it ends with end_id. A null text is empty (end_id alone); a null id stays null. An
    empty table gives no pieces. A document of any length is cut at will; one alone may exceed the window's size.
    Sequence ids are unique, not dense; they follow the table's partitions.
    """
    if room < 1 or room & (room - 1):
        raise ValueError("room must be a power of two")
    path = path or public_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode = TaskContext.get(), encoder(path)
        first = (context.partitionId() if context else 0) << 40
        ids, tokens, held = [], [], 0
        end = np.array([end_id], np.uint32)

        def packed() -> pa.RecordBatch:
            nonlocal first
            lengths = np.array([len(t) for t in tokens], np.int64)
            out = {n: [] for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            offsets: dict[int, int] = {}
            for d, start, n, to in layout(lengths, room):
                row = (ids[d], start, n, tokens[d][start : start + n].astype("<u4").tobytes(), len(tokens[d]), first + to, offsets.get(to, 0))
                offsets[to] = row[-1] + n
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)
            first += len(offsets)
            return pa.RecordBatch.from_pydict({n: pa.array(x, pa.binary() if n == "ids" else pa.int64()) for n, x in out.items()})

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                tokens.append(np.append(encode(text.as_py() or ""), end))
                held += len(tokens[-1])
                if held >= window or len(ids) >= DOCUMENTS:
                    yield packed()
                    ids, tokens, held = [], [], 0
        if ids:
            yield packed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
