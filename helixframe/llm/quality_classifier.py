"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Votes are counted by pattern over the whole corpus (a
table of 3^labellers rows at most), and expectation-maximisation on these counts estimates each labeller's accuracies
and the share of good documents, without any label. The posterior of a document's votes is its soft label; a linear
scorer over hashed features (pairs of bytes, words, and binned measures) is fitted to the soft labels of a bounded sample
and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import texts_of
from helixframe.llm.spans import Texts, mixed, window_hashes

#: Width of each hashed feature block: pairs of bytes, words, binned measures.
WIDTH = 2048
#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "auf das der des die ein eine für im in ist mit nicht und von zu zum "
    "avec dans de des du en est et la le les par pas pour que qui sur un une "
    "con de del el en es la las los no para por que se su un una y"
)
_STOP = None
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]\\^~_=+@!")] = True
_UPPER, _LETTER, _DIGIT, _MULTI = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = _DIGIT[48:58] = _MULTI[128:] = True
#: Words of a block, in each of which different words are counted; a rest goes with the last whole one.
BLOCK = 100
MEASURES = ("symbols", "upper", "different", "stop", "words", "letters", "lines", "again", "marked")


def measured(texts: list[bytes]) -> tuple[np.ndarray, Texts, np.ndarray]:
    """A row of measures for each text; its words; the words' hashes."""
    global _STOP
    if _STOP is None:
        known = Texts([w.encode() for w in sorted(set(STOP_WORDS.split()))])
        _STOP = np.sort(known.hashes())
    t = Texts(texts)
    hashes = t.hashes()
    at = np.cumsum([0, *(len(x) + 1 for x in texts)])
    per = lambda mark: np.diff(np.concatenate(([0], np.cumsum(mark)))[np.minimum(at, len(t.buf))]).astype(float)
    n = np.maximum(t.count, 1).astype(float)
    visible = np.maximum(per(~np.isin(t.buf, (9, 10, 11, 12, 13, 32))), 1)
    letters = per(_LETTER[t.buf])
    low = Texts([x.lower() for x in texts]).hashes()
    stop = np.isin(low, _STOP)
    out = np.zeros((len(texts), len(MEASURES)))
    out[:, 0] = per(_SYMBOL[t.buf]) / visible
    out[:, 1] = per(_UPPER[t.buf]) / np.maximum(letters, 1)
    out[:, 3] = np.diff(np.concatenate(([0], np.cumsum(stop)))[t.first]) / n
    out[:, 4] = t.count
    out[:, 5] = letters / visible
    edge = np.concatenate(([0], np.cumsum(_SYMBOL[t.buf])))
    marked = edge[t.ends] > edge[t.starts]  # words with a symbol
    out[:, 8] = np.diff(np.concatenate(([0], np.cumsum(marked)))[t.first]) / n
    # Different words of each hundred, as the whole text's share falls with its length.
    rel, count = t.place()
    block = t.first[:-1].repeat(t.count) + np.minimum(rel // BLOCK, np.maximum(count // BLOCK - 1, 0))
    order = np.lexsort((hashes, block))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (block[order][1:] != block[order][:-1])
    fresh = np.zeros(len(order), bool)
    fresh[order] = new
    out[:, 2] = np.diff(np.concatenate(([0], np.cumsum(fresh)))[t.first]) / n
    pairs = window_hashes(hashes, 4)
    for k, (text, a, b) in enumerate(zip(texts, t.first[:-1].tolist(), t.first[1:].tolist(), strict=True)):
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[k, 6] = 1 - len(set(lines)) / len(lines) if lines else 0
        four = pairs[a : max(a, b - 3)]
        out[k, 7] = 1 - len(np.unique(four)) / len(four) if len(four) else 0
    return out, t, hashes


def votes(m: np.ndarray) -> np.ndarray:
    """Of each labeller on each text: 2 good, 0 bad, 1 neither."""
    symbols, upper, different, stop, words, letters, lines, again, marked = m.T
    vote = lambda bad, good: np.where(bad, 0, np.where(good, 2, 1))
    return np.stack(
        [
            vote(symbols > 0.08, symbols < 0.03),
            vote((words >= 8) & (marked > 0.25), marked < 0.06),
            vote((words >= 4) & (upper > 0.5), upper < 0.15),
            vote((words >= 40) & (different < 0.25), (words >= 40) & (different > 0.4)),
            vote((words >= 40) & (stop < 0.02), (words >= 40) & (stop > 0.1)),
            vote((words >= 8) & (letters < 0.7), letters > 0.9),
            vote((words >= 40) & (lines > 0.4), (words >= 40) & (lines < 0.1)),
            vote((words >= 40) & (again > 0.3), (words >= 40) & (again < 0.05)),
        ],
        1,
    )


N_VOTES = 8
_PLACES = 3 ** np.arange(N_VOTES)


@dataclass
class Labellers:
    """P(vote | class, a vote is cast) of each labeller, and each class's share. Class 0 is good; the others are kinds of
    bad documents, as a labeller sees some kinds and is blind to others. No vote says nothing."""

    p: np.ndarray
    share: np.ndarray

    def classes(self, v: np.ndarray) -> np.ndarray:
        """P(class) for rows of votes."""
        logs = np.stack([np.log(s) + sum(np.log(self.p[c, j, v[:, j]]) for j in range(v.shape[1])) for c, s in enumerate(self.share)], 1)
        odds = np.exp(logs - logs.max(1, initial=-np.inf, keepdims=True))
        return odds / odds.sum(1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes."""
        return self.classes(v)[:, 0]


#: Kinds of bad documents that the estimation starts from, by the labellers that see them.
SEES = ((0, 1, 5), (2,), (3, 4, 6, 7))


def estimated(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Labellers:
    """Expectation-maximisation over counted vote patterns, begun at labellers that call most documents of their kind
    bad, few others and hardly any good one."""
    n = patterns.shape[1]
    bad = np.array([[0.03] * n, *([0.7 if j in kind else 0.1 for j in range(n)] for kind in SEES)])
    p = np.stack([bad, np.ones_like(bad), 1 - bad], 2)
    prior, model = 20 * np.stack([bad, np.zeros_like(bad), 1 - bad], 2), Labellers(p, np.array([0.85, 0.05, 0.05, 0.05]))
    one_hot = np.stack([patterns == v for v in range(3)], 2).astype(float)
    for _ in range(rounds):
        q = model.classes(patterns) * counts[:, None]
        sums = np.einsum("ic,ijv->cjv", q, one_hot) + prior
        p = sums / (sums[:, :, :1] + sums[:, :, 2:])
        p[:, :, 1] = 1
        share = q.sum(0) + 10 * np.array([0.85, 0.05, 0.05, 0.05])
        after = Labellers(p, share / share.sum())
        ended = np.abs(after.p - model.p).max() < 1e-9
        model = after
        if ended:
            break
    return model


def _slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Texts, np.ndarray, np.ndarray, np.ndarray]:
    """Measures; bounds and slots of byte pairs; words; slots of words and of measures."""
    m, t, hashes = measured(texts)
    at = np.cumsum([0, *(len(x) + 1 for x in texts)])
    b = t.buf.astype(np.uint64)
    pair = (mixed(b[:-1] * np.uint64(257) + b[1:]) % np.uint64(WIDTH)).astype(np.int64) if len(b) > 1 else np.zeros(0, np.int64)
    binned = np.minimum(np.floor(np.where(np.arange(len(MEASURES)) == 4, np.log2(np.maximum(m, 1)), m * 20)), 31).astype(np.int64)
    return m, at, t, pair, (hashes % np.uint64(WIDTH)).astype(np.int64), binned + 32 * np.arange(len(MEASURES))


SIZE = 2 * WIDTH + 32 * len(MEASURES) + 1


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors (float32) and votes of some texts."""
    m, at, t, pair, word, binned = _slots(texts)
    out = np.zeros((len(texts), SIZE), np.float32)
    for k in range(len(texts)):
        a, b = at[k], max(at[k], at[k + 1] - 2)
        if b > a:
            out[k, :WIDTH] = np.bincount(pair[a:b], minlength=WIDTH) / (b - a) * 4
        a, b = t.first[k], t.first[k + 1]
        if b > a:
            out[k, WIDTH : 2 * WIDTH] = np.bincount(word[a:b], minlength=WIDTH) / (b - a) * 4
        out[k, 2 * WIDTH + binned[k]] = 1
        out[k, -1] = 1
    return out, votes(m)


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """P(good) by the scorer, without laying out the vectors."""
    m, at, t, pair, word, binned = _slots(texts)

    def mean(w: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each range; a range's sum does not depend on where it lies, so equal texts get equal scores."""
        edges = np.stack([first, last], 1).ravel()
        sums = np.add.reduceat(np.append(w.astype(float), 0.0), edges)[::2] if len(edges) else np.zeros(0)
        return np.where(last > first, sums / np.maximum(last - first, 1), 0)

    ends = np.maximum(at[:-1], at[1:] - 2)
    z = mean(weights[:WIDTH][pair] * 4, np.minimum(at[:-1], len(pair)), np.minimum(ends, len(pair)))
    z = z + mean(weights[WIDTH : 2 * WIDTH][word] * 4, t.first[:-1], t.first[1:])
    z = z + weights[2 * WIDTH + binned].sum(1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, by Adam over the whole sample."""
    w, first, second = np.zeros(x.shape[1], np.float32), 0.0, 0.0
    for k in range(1, steps + 1):
        grad = x.T @ ((1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / max(1, len(y))).astype(np.float32) + decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w = (w - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return w


def _few(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a megabyte."""
    a, held = 0, 0
    for b, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield a, b + 1
            a, held = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in texts_of(batch.column(0))]
        found = [votes(measured(texts[a:b])[0]) @ _PLACES for a, b in _few(texts)]
        got = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
        value, count = np.unique(got, return_counts=True)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(value), "n": pa.array(count.astype(np.int64))})


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in texts_of(batch.column(0))]
        for a, b in _few(texts):
            x, v = vectors(texts[a:b])
            yield pa.RecordBatch.from_pydict({"h": batch.column(1).slice(a, b - a), "x": pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), "pattern": pa.array(v @ _PLACES)})


@dataclass
class Classifier:
    labellers: Labellers
    weights: np.ndarray
    n_docs: int


def learn(docs: DataFrame, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Labellers' accuracies from all rows of docs, and a scorer from about `sample` of them, those of the least hashes of id
    and text (twice as many at most, also where rows are repeated; each takes 9 KB of the driver's memory)."""
    text = F.col(text_col).cast("string").alias("text")
    counted = docs.select(text).mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counted = sorted((r.pattern, r.n) for r in counted)  # at most 3^8 rows
    patterns = np.array([[p // 3**j % 3 for j in range(N_VOTES)] for p, _ in counted], np.int64).reshape(-1, N_VOTES)
    counts = np.array([n for _, n in counted], float)
    labellers, total = estimated(patterns, counts), int(counts.sum())
    # 44 bits: equal ones are equal rows, or as good as.
    chosen = docs.select(text, F.pmod(F.xxhash64(F.col(id_col).cast("long"), text), F.lit(1 << 44)).alias("h"))
    if total > sample:
        chosen = chosen.where(F.col("h") < int((1 << 44) * sample / total))
    rows = chosen.mapInArrow(_vectors, "h long, x binary, pattern long").orderBy("h", "x").limit(2 * sample).collect() if total else []
    if not rows:
        return Classifier(labellers, np.zeros(SIZE, np.float32), total)
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32)
    found = np.array([[r.pattern // 3**j % 3 for j in range(N_VOTES)] for r in rows])
    return Classifier(labellers, fitted(x, labellers.posterior(found)), total)


def classify(docs: DataFrame, model: Classifier | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as (doc_id, score, kept): the scorer's probability that a text is good, and whether it is `least` or more.

    A null text counts as empty; an empty one is judged like any short text. A null id stays null; repeated rows get the
    same score. Texts of any length are read whole. An empty table gives an empty result.
    """
    weights = (model or learn(docs, id_col=id_col, text_col=text_col)).weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in texts_of(batch.column(1))]
            found = np.concatenate([np.zeros(0), *(scores(texts[a:b], weights) for a, b in _few(texts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(found >= least)], ["doc_id", "score", "kept"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, score double, kept boolean")


def good_documents(docs: DataFrame, model: Classifier | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows that are kept, with all their columns, in one pass."""
    weights = (model or learn(docs, id_col=id_col, text_col=text_col)).weights
    where = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in texts_of(batch.column(where))]
            found = np.concatenate([np.zeros(0), *(scores(texts[a:b], weights) for a, b in _few(texts))])
            yield batch.filter(pa.array(found >= least))

    return docs.mapInArrow(run, docs.schema)

