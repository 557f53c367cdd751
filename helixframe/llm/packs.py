"""Documents packed into compressed rows of some hundred kilobytes or a few megabytes.

Operators that look up hashes of words corpus-wide read each text in several passes. A pack is the unit of those
passes: it travels once (its exchange is reused), has an id that answers can be sent to, and lets a task handle
thousands of words with a few array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import n_partitions, texts_of
from helixframe.llm.spans import Texts

PACK_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max


def freeze(ids: list[int | None], texts: list[bytes | None]) -> bytes:
    order = sorted(range(len(ids)), key=lambda i: NO_ID if ids[i] is None else ids[i])
    head = np.array([[NO_ID if ids[i] is None else ids[i], len(texts[i] or b"")] for i in order], "<i8")
    body = b"".join([np.int64(len(order)).tobytes(), head.tobytes(), *(texts[i] or b"" for i in order)])
    return zstandard.ZstdCompressor(level=3).compress(body)


class Pack:
    """Its documents in ascending order of id; a null id comes last, a null text is empty."""

    def __init__(self, body: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(body)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
        self.ids = head[:, 0].copy()
        ends = 8 + 16 * n + np.cumsum(head[:, 1])
        self.raw = [raw[e - k : e] for e, k in zip(ends.tolist(), head[:, 1].tolist(), strict=True)]
        self.texts = Texts(self.raw)

    def id_list(self) -> list[int | None]:
        return [None if i == NO_ID else i for i in self.ids.tolist()]


def _pack(size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t or b"") + 16
                if held >= size:
                    yield pa.RecordBatch.from_pydict({"pack_id": [number], "body": [freeze(ids, texts)]})
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_pydict({"pack_id": [number], "body": [freeze(ids, texts)]})

    return run


def packs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PACK_BYTES) -> DataFrame:
    """(pack_id, body), hash-partitioned by pack_id. docs should be a table scan or a checkpoint: pack ids follow the
    order of its rows, which a lost executor's tasks must find again."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(_pack(size), "pack_id long, body binary").repartition(n_partitions(docs.sparkSession), "pack_id")
