"""Substring dedup by difference-cover anchors.

Positions of a document are taken modulo a period v; D is a difference cover of v, so that for any two positions some
shift below v brings both into D. Two equal windows of w words therefore share an aligned anchor of w - v + 1 words
that starts, in both documents, at a cover position. Only |D| of every v positions are hashed and sent:

1. anchors at cover positions meet by hash; each pack learns which of its anchors occur elsewhere;
2. windows over such an anchor (a small part of all windows) are extended to their full w words, and meet by a
   96-bit hash of all of these; every one but the first in (document, start) order is a repeat;
3. words under repeats are removed.

A row travels for each different anchor or window of a pack, so a passage that a third of all documents hold is one row
a pack, and Spark's sorts and windows, which spill, find what is shared: no task holds a range of hashes in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import n_partitions, rows_of, steady
from helixframe.llm.packs import Pack, packs
from helixframe.llm.spans import Texts, mixed, window_hashes

#: Perfect difference covers, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: In larger packs more copies meet before anything is sent.
PACK_BYTES = 1 << 22
#: Anchors; windows (h2 holds 32 more bits of hash above the window's place in its pack). A row whose run is not 0 stands
#: for that many windows from its place on, of which the pack itself knows that they are repeats.
ANCHOR, WINDOW = "h long, pack_id long", "h long, h2 long, doc_id long, pack_id long, run int"


def cover_of(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length: the longest period that leaves two fifths of the window to the anchor."""
    period = max(v for v in COVERS if v == 1 or window - v + 1 >= max(2, 0.4 * window))
    return period, COVERS[period], window - period + 1


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (the first leads, ties keep their order) and, in that order, where groups begin."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


def _anchors_of(texts: Texts, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each anchor of a pack."""
    period, cover, length = cover_of(window)
    at = np.isin(np.arange(period), cover)
    rel, count = texts.place()
    pos = np.flatnonzero(at[rel % period] & (count >= window) & (count - rel >= length))
    return window_hashes(words, length)[pos] if len(pos) else np.zeros(0, np.uint64), pos


def _anchors(window: int) -> Callable:
    """Each different anchor of a pack once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, body in rows_of(batches):
            texts = Pack(body).texts
            keys = np.unique(_anchors_of(texts, texts.hashes(), window)[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), number))], ["h", "pack_id"])

    return run


def _windows(window: int) -> Callable:
    """Windows over an anchor that occurs elsewhere too, each different one of a pack once."""
    period, _, _ = cover_of(window)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number, pack = left.column("pack_id")[0].as_py(), Pack(left.column("body")[0].as_py())
        pos, keys, keys2 = _open_windows(pack.texts, window, right.column("h").to_numpy().view(np.uint64), period)
        order, new = _groups(keys, keys2)
        one, rest = pos[order[new]], np.sort(pos[order[~new]])
        first = rest[np.diff(rest, prepend=-2) != 1]
        last = rest[np.diff(rest, append=np.iinfo(np.int64).max) != 1]
        h = np.concatenate((keys[order[new]], mixed(first.astype(np.uint64) ^ np.uint64(number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))))
        h2 = np.concatenate((keys2[order[new]].astype(np.int64), np.zeros(len(first), np.int64))) << 32 | np.concatenate((one, first))
        docs = pack.ids[np.searchsorted(pack.texts.first, np.concatenate((one, first)), "right") - 1]
        runs = np.concatenate((np.zeros(len(one), np.int32), (last - first + 1).astype(np.int32)))
        return pa.table({"h": h.view(np.int64), "h2": h2, "doc_id": docs, "pack_id": np.full(len(h), number), "run": runs})

    return lambda left, right: run(left, right) if left.num_rows else pa.table({n: pa.array([], pa.int32() if n == "run" else pa.int64()) for n in ("h", "h2", "doc_id", "pack_id", "run")})


def _open_windows(texts: Texts, window: int, shared: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and two hashes of each window over an anchor that occurs more than once, here or (shared) elsewhere."""
    words = texts.hashes()
    keys, at = _anchors_of(texts, words, window)
    kinds, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    at = at[((times > 1) | np.isin(kinds, shared))[which]]
    rel, count = texts.place()
    step = np.zeros(len(rel) + 1, np.int64)
    np.add.at(step, np.maximum(at - period + 1, 0), 1)
    np.add.at(step, at + 1, -1)
    pos = np.flatnonzero((np.cumsum(step)[:-1] > 0) & (count - rel >= window))
    if not len(pos):
        return pos, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    return pos, window_hashes(words, window)[pos], (window_hashes(words, window, 0x9FB21C651E98DF25)[pos] >> np.uint64(32)).astype(np.uint32)


def _removed(window: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for body in left.column("body").to_pylist():
            pack = Pack(body)
            step = np.zeros(len(pack.texts.starts) + 1, np.int64)
            at = right.column("pos").to_numpy()
            np.add.at(step, at, 1)
            np.add.at(step, at + right.column("n").to_numpy() - 1 + window, -1)
            gone = np.cumsum(step)[:-1] > 0
            lost = np.concatenate(([0], np.cumsum(gone)))[pack.texts.first]
            first = pack.texts.first.tolist()
            for k, (i, text, n) in enumerate(zip(pack.id_list(), pack.raw, np.diff(lost).tolist(), strict=True)):
                words = text.split()
                if n:
                    off = gone[first[k] : first[k + 1]].tolist()
                    words = [w for w, x in zip(words, off, strict=True) if not x]
                kept = b" ".join(words)
                for name, x in zip(out, (i, first[k + 1] - first[k], n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    out[name].append(x)
        kept = pa.array(out.pop("kept_text"), pa.binary()).cast(pa.string())
        return pa.table({n: pa.array(x, pa.string() if n == "kept_sha256" else pa.int64()) for n, x in out.items()} | {"kept_text": kept})

    return run


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that lies in a window of words which also starts earlier in the corpus.

    Earlier: a smaller id, or the same document and an earlier start; windows are judged on the input. Returns doc_id,
    n_words, n_removed, kept_sha256 and kept_text, a row for each row of docs. A null text and an empty one have no
    words (kept text: empty). A null id comes after all others and stays null. Of rows that repeat an id, one is held to
    be earlier. Documents of fewer than `window` words lose none. No tables, no rows; other columns are ignored.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    parts = n_partitions(docs)
    held = packs(steady(docs), id_col, text_col, PACK_BYTES)
    by_pack = held.groupBy("pack_id")
    anchors = held.mapInArrow(_anchors(window), ANCHOR)
    shared = anchors.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("h"))).where("n > 1").select("pack_id", "h")
    sent = by_pack.cogroup(shared.groupBy("pack_id")).applyInArrow(_windows(window), WINDOW)
    # Rows are dealt by h alone, so that h2 need not be split before they travel.
    kind = W.partitionBy("h", F.shiftright("h2", 32), F.col("run") > 0).orderBy("doc_id", "pack_id", "h2")
    later = sent.repartition(parts, "h").withColumn("n", F.row_number().over(kind)).where("run > 0 OR n > 1")
    repeats = later.select("pack_id", F.col("h2").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"), F.greatest("run", F.lit(1)).alias("n"))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return by_pack.cogroup(repeats.groupBy("pack_id")).applyInArrow(_removed(window), out)
