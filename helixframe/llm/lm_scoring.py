"""Stupid-backoff scores of documents under n-gram counts of all other documents.

    S(w | context) = count(context w) / count(context)     if another document holds the n-gram
                   = 0.4 S(w | context less its first word) otherwise
    S(w)           = count(w) / words of the other documents, or 0.4 of one word if none of them holds w

Counts are those of the whole corpus, of every n-gram, less those of the document that is scored: else every n-gram of
a document would be in the tables and nothing would ever back off. Documents travel in packs. Each pack sends the
different n-grams it holds, as sorted hashes with counts, to the partition of their hash range; there they are counted,
and the counts go back to the packs, where each document's n-grams are joined to them and summed. A row for each
n-gram and pack would be the plain relational form; it is packed into a row for each range and pack, as some 30 bytes a word
would travel otherwise (README). An n-gram of order 3 or more is sent only if other documents hold both its parts of the order
below, as no other document can hold it otherwise, and other packs too, as its count is known otherwise.

There are several ranges for each partition, so that a task holds a small part of its partition at a time; Spark sorts by
range and spills. A row is made for a range that a pack has n-grams in, so there are never more rows than n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cut, n_partitions, rows_of, spread, steady
from helixframe.llm.packs import Pack, packs
from helixframe.llm.spans import mixed, window_hashes

#: Larger packs repeat themselves more, so that fewer n-grams are sent.
PACK_BYTES = 1 << 22
#: Ranges of hashes for each partition, of which a task holds one at a time.
PARTS = 8
SENT = "bucket long, pack_id long, part long, n long, keys binary, counts binary"
ANSWER = "pack_id long, part long, counts binary"
_KINDS = {"long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    fields = [(n, _KINDS[k]) for n, k in (x.split() for x in names.split(", "))]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def keys_out(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences of as many bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps[1:].max()).bit_length() + 7) // 8) if len(keys) > 1 else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def keys_in(raw: bytes) -> np.ndarray:
    width, first = raw[0], np.frombuffer(raw, "<u8", 1, 1)
    rest = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(rest), 8), np.uint8)
    steps[:, :width] = rest
    return np.cumsum(np.concatenate((first, steps.view("<u8").ravel())), dtype=np.uint64)


def numbers_out(n: np.ndarray) -> bytes:
    """As planes of bytes, as many as the largest needs; the upper ones are nearly empty."""
    width = max(1, (int(n.max(initial=0)).bit_length() + 7) // 8)
    planes = n.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def numbers_in(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8").ravel()


class Asked:
    """Different keys of some places, ascending; what each occurs here, and in the document of each place; which keys other
    packs may hold."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray, remote: np.ndarray | None = None) -> None:
        self.keys, self.which = np.unique(keys, return_inverse=True)
        self.times = np.bincount(self.which, minlength=len(self.keys))
        many = np.flatnonzero(self.times[self.which] > 1)
        _, of, n = np.unique(self.which[many] * (int(docs.max(initial=0)) + 1) + docs[many], return_inverse=True, return_counts=True)
        self.own = np.ones(len(keys), np.int32)
        self.own[many] = n[of]
        self.remote = np.ones(len(self.keys), bool)
        if remote is not None:
            self.remote[self.which] = remote

    def at_places(self, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in other documents, and whether some are in other packs."""
        total = self.times.copy()
        total[self.remote] = answer
        return total[self.which] - self.own, (total > self.times)[self.which]


class Grams:
    """The n-grams of a pack: keys at each word, by order (0 where a document ends too soon); how often other documents hold
    them, and whether documents of other packs do."""

    def __init__(self, pack: Pack, order: int) -> None:
        self.words = pack.texts.hashes()
        self.rel, self.count = pack.texts.place()
        self.doc = np.repeat(np.arange(len(pack.texts.count)), pack.texts.count)
        self.keys, self.others, self.away = {}, {}, {}
        for n in range(1, order + 1):
            keys = np.zeros(len(self.words), np.uint64)
            if len(keys) >= n:
                keys[: len(keys) - n + 1] = mixed(window_hashes(self.words, n) + np.uint64(n)) | np.uint64(1)
            self.keys[n] = np.where(self.count - self.rel >= n, keys, np.uint64(0))

    def ask(self, step: int) -> tuple[Asked, np.ndarray]:
        """What step asks for, and at which words; step 2 is for words and pairs, others need the counts of the last."""
        if step == 2:
            pairs = np.flatnonzero(self.keys[2])
            return Asked(np.concatenate((self.keys[1], self.keys[2][pairs])), np.concatenate((self.doc, self.doc[pairs]))), pairs
        after = lambda x: np.append(x[1:], np.zeros(min(1, len(x)), bool))
        lower, away = self.others[step - 1] > 0, self.away[step - 1]
        places = np.flatnonzero((self.keys[step] > 0) & lower & after(lower))
        return Asked(self.keys[step][places], self.doc[places], (away & after(away))[places]), places

    def learn(self, step: int, answer: np.ndarray) -> None:
        asked, places = self.ask(step)
        others, away = asked.at_places(answer)
        n = len(self.words)
        if step == 2:
            self.others[1], self.away[1] = others[:n], away[:n]
            others, away = others[n:], away[n:]
        self.others[step], self.away[step] = np.zeros(n, np.int64), np.zeros(n, bool)
        self.others[step][places], self.away[step][places] = others, away


def _known(grams: Grams, answers: list[list[tuple[int, bytes]]]) -> None:
    for step, found in enumerate(answers, 2):
        grams.learn(step, np.concatenate([np.zeros(0, np.int64), *(numbers_in(c) for _, c in sorted(found or []))]))


def _cut_up(keys: np.ndarray, times: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """Parts of ascending keys by range of their upper half."""
    home = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True]))) if len(home) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(home[a]), slice(a, b)


def _sends(step: int, buckets: int) -> Callable:
    """Rows for each bucket; the batch holds pack_id, body and the answers to each step before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, body, *answers in _packs_of(batches):
            grams = Grams(Pack(body), step)
            _known(grams, answers)
            asked, _ = grams.ask(step)
            keys, times = asked.keys[asked.remote], asked.times[asked.remote]
            yield _batch([(b, number, b, part.stop - part.start, keys_out(keys[part]), numbers_out(times[part])) for b, part in _cut_up(keys, times, buckets)], SENT)

    return run


def _packs_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Packs one by one, with lists of (part, counts)."""
    for batch in batches:
        for k in range(batch.num_rows):
            number, body, *answers = (c[k].as_py() for c in batch.columns)
            yield number, body, *([(x["part"], x["counts"]) for x in a or []] for a in answers)


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Total counts of each bucket's keys, for each pack that sent them."""

    def totals(held: list[tuple]) -> list[tuple]:
        if not held:
            return []
        keys = np.concatenate([keys_in(k) for *_, k, _ in held])
        times = np.concatenate([numbers_in(c) for *_, c in held])
        order = np.argsort(keys, kind="stable")
        new = np.append(True, keys[order][1:] != keys[order][:-1])
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(new) - 1
        total = np.add.reduceat(times[order], np.flatnonzero(new))[which]
        ends = np.cumsum([n for *_, n, _, _ in held])
        return [(number, part, numbers_out(t)) for (_, number, part, *_), t in zip(held, np.split(total, ends[:-1]), strict=True)]

    held, now = [], None
    for row in rows_of(batches):
        if row[0] != now:
            yield _batch(totals(held), ANSWER)
            held, now = [], row[0]
        held.append(row)
    yield _batch(totals(held), ANSWER)


def _scored(order: int, least: int, alpha: float) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, body, *answers in _packs_of(batches):
            pack = Pack(body)
            grams = Grams(pack, order)
            _known(grams, answers)
            n_words, counts = len(grams.words), grams.others
            # Less the logarithm of the corpus size, where no n-gram is found.
            log = np.where(counts[1] > 0, np.log(np.maximum(counts[1], 1)), np.log(alpha))
            bare = np.ones(n_words, bool)
            for n in range(2, order + 1):
                able = grams.rel >= n - 1
                times = np.zeros(n_words, np.int64)
                under = np.ones(n_words, np.int64)
                if n_words >= n:
                    times[n - 1 :] = counts[n][: n_words - n + 1]
                    under[n - 1 :] = counts[n - 1][: n_words - n + 1]
                hit = able & (times >= least)
                log = np.where(hit, np.log(np.maximum(times, 1) / np.maximum(under, 1)), np.where(able, log + np.log(alpha), log))
                bare &= ~hit
            first = pack.texts.first.tolist()
            plain = np.diff(np.concatenate(([0], np.cumsum(bare)))[pack.texts.first])
            sums = [float(log[a:b].sum()) for a, b in zip(first[:-1], first[1:], strict=True)]
            columns = [pa.array(pack.id_list(), pa.int64()), pa.array(pack.texts.count, pa.int64()), pa.array(plain, pa.int64()), pa.array(sums, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_bare", "part"])

    return run


def score(docs: DataFrame, order: int = 3, min_count: int = 1, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for each row of docs: the sum of ln S over its words, and the mean.

    Words are runs of characters other than white space, unchanged; n-grams don't cross documents. Counts are over all
    rows of docs but the scored one; of rows that are repeated, each counts for the others. min_count above 1 prunes: n-grams
    of order 2 and more that other documents hold less often back off. Texts that are null, empty or without a word
    score 0, with a null mean. A null id stays null. A lone document is scored as if there were one other word. An empty table gives
    an empty result.
    """
    if order < 2 or min_count < 1:
        raise ValueError("order must be 2 or more, min_count 1 or more")
    parts = n_partitions(docs)
    held = packs(steady(docs), id_col, text_col, PACK_BYTES)
    for step in range(2, order + 1):
        sent = spread(held.mapInArrow(_sends(step, parts * PARTS), SENT), parts, "bucket")
        answers = sent.sortWithinPartitions("bucket").mapInArrow(_met, ANSWER)
        by_pack = answers.groupBy("pack_id").agg(F.collect_list(F.struct("part", "counts")).alias(f"answers{step}"))
        held = held.join(by_pack.hint("merge"), "pack_id", "left")  # never broadcast; all sides are partitioned by pack_id
    found = cut(held.mapInArrow(_scored(order, min_count, alpha), "doc_id long, n_words long, n_bare long, part double"))
    words = found.agg(F.sum("n_words")).first()[0] or 0
    total = F.col("part") - F.col("n_bare") * F.log(F.greatest(F.lit(words) - F.col("n_words"), F.lit(1)).cast("double"))
    return found.select("doc_id", "n_words", total.alias("log_score"), F.try_divide(total, F.col("n_words")).alias("mean_log_score"))
