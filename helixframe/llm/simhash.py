"""SimHash near-dedup by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in at most r bits, one segment
differs in at most r // 2, so the Hamming balls of radius ceil(r // 2 / 2) around both values of that segment share a
value. Each distinct fingerprint is therefore entered in a table under every value of the ball around each of its
segments, fingerprints that meet under a value are fetched, and complete distances are verified. For r = 4 that is 66
entries a fingerprint, and a table of 2^32 values a segment, so unrelated fingerprints hardly meet.

Documents of one fingerprint are joined before; within a table entry a breadth-first search yields a spanning forest
of the links instead of all pairs.

Shingle sets of a similarity of 0.8 differ in some 10 of 64 bits, beyond what balls can reach, and among many documents
unrelated fingerprints come as near. without_near_copies() therefore makes WORDS times 64 bits of each shingle hash: there are
as many more segments, of which one is likely to differ in 2 bits at most, and complete distances tell similar from
dissimilar texts. What they link is held against the shingle sets themselves. Similar texts that no segment brings together,
or that are further apart than most, are found by prefixes: under one order of all shingles, frequent ones last, sets of a
given similarity share some of their first shingles. Only texts that the fingerprints have not joined yet are compared so;
links are therefore those of all pairs. A first shingle of more than FEW texts makes no pairs. Texts with few of these meet
often enough under others; those with many, chained by such shingles, come together with their sets, which are compared there,
and only links that join something leave.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cut, n_partitions, steady, texts_of
from helixframe.llm.spans import Texts, mixed, window_hashes
from helixframe.operators.graph import components

SEED = 42
#: 64-bit words of a long fingerprint, and bits in which a word differs at most where a segment of it has met.
WORDS, WORD_DISTANCE = 4, 9
#: A prefix is one shingle longer than it must be for each SPARE shingles of a set, so that pairs have to share more of it.
SPARE = 32
#: Shingles counted together, how often one is met among them to be a frequent one, and how many of those are ordered by
#: their counts. The order decides how many pairs are compared, not which are found.
PACK, FREQUENT, MOST_FREQUENT = 1 << 22, 8, 1 << 20
#: Texts under one shingle at most that are paired row by row, and shingles of a block of sets that are compared in one task.
FEW, BLOCK = 64, 1 << 20
#: Rows of a table that is sent to all tasks at most.
SENT = 1 << 19


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[shingle - 1 :] - 1).tolist()
    starts = [0, *ends[: len(stops) - 1].tolist()]
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), "<u8", len(stops))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of hashes (n, words): words whose bits are set if they are set in over half the hashes; none: zero."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """64 bits, each set if it is set in over half the shingles' XXH64; no words: zero."""
    return int(majority(shingle_hashes(text, shingle)[:, None])[0])


def long_fingerprint(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """WORDS words; the first is fingerprint(), the others come from hashes of the shingles' hashes."""
    h = shingle_hashes(text, shingle)
    return majority(np.stack([h, *(mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(1, WORDS))], 1))


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): a row for each row of docs, without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _balls(distance: int) -> np.ndarray:
    """What to flip in a segment of 32 bits to reach each value of its ball."""
    radius = -(-(distance // 2) // 2)
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(32), k)], np.uint64)


def _entries(distance: int) -> Callable:
    """From words of a fingerprint and its number: (entry, fp, rep), fp being the word that the entry is a segment of."""
    flips = _balls(distance)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                rep = np.repeat(part.column(part.num_columns - 1).to_numpy(), len(flips))
                for j in range(part.num_columns - 1):
                    fp = part.column(j).to_numpy()
                    bits = fp.view(np.uint64)
                    for half, values in enumerate((bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32))):
                        entry = (values[:, None] ^ flips | np.uint64((2 * j + half) << 32)).ravel().view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(np.repeat(fp, len(flips))), pa.array(rep)], ["entry", "fp", "rep"])

    return run


def linked(fp: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: (index, index). Each step compares one fingerprint
    with those that no link has reached yet."""
    rest = np.arange(len(fp))
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= distance
            for x in rest[near].tolist():
                yield at, x
                reached.append(x)
            rest = rest[~near]


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first one, so that no value of it is parted."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if not len(now[0]):
            continue
        if kept and kept[-1][0][-1] == now[0][0]:
            same = int(np.searchsorted(now[0], now[0][0], "right"))
            kept.append([c[:same] for c in now])
            now = [c[same:] for c in now]
        if len(now[0]):
            last = int(np.searchsorted(now[0], now[0][-1]))
            kept.append([c[:last] for c in now])
            found = [np.concatenate(c) for c in zip(*kept, strict=True)]
            if len(found[0]):
                yield found
            kept = [[c[last:] for c in now]]
    if kept:
        yield [np.concatenate(c) for c in zip(*kept, strict=True)]


def _verified(distance: int) -> Callable:
    """Links among the fingerprints of each entry; rows come sorted by entry, and an entry may span batches."""

    def links(entry: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1], [True])))
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a, b = [rep[two]], [rep[two + 1]]
        for s, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found = np.array(list(linked(fp[s : s + n], distance)), np.int64).reshape(-1, 2) + s
            a.append(rep[found[:, 0]])
            b.append(rep[found[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e, f, r in _whole(batches):
            yield links(e, f.view(np.uint64), r)

    return run


def _met(reps: DataFrame, within: int, distance: int) -> DataFrame:
    """(a, b) of fingerprints that differ in `distance` bits at most in a word of which a segment meets; reps: words, number."""
    entries = reps.mapInArrow(_entries(within), "entry long, fp long, rep long")
    sorted_ = entries.repartition(n_partitions(reps), "entry").sortWithinPartitions("entry", "fp")
    return sorted_.mapInArrow(_verified(distance), "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def simhash_links(reps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links that join the same components as all pairs within `distance` bits; reps: (fp, rep)."""
    if not 0 <= distance <= 9:
        raise ValueError("distance must be from 0 to 9; the balls grow with its half")
    return _met(reps, distance, distance)


def bits_apart(similarity: float) -> int:
    """Bits in which long fingerprints of sets of that similarity (and like size) differ, and one standard deviation."""
    n, p = 64 * WORDS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(n * p + math.sqrt(n * p * (1 - p)))


def long_links(reps: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links; reps: (w0, w1, ..., rep)."""
    words = [f"w{k}" for k in range(WORDS)]
    met = _met(reps.select(*words, "rep"), 4, WORD_DISTANCE)
    side = lambda x: reps.select(F.col("rep").alias(x), *[F.col(w).alias(f"{x}{w}") for w in words])
    apart = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in words[1:]), F.bit_count(F.col("aw0").bitwiseXOR(F.col("bw0"))))
    return met.join(side("a"), "a").join(side("b"), "b").where(apart <= bits_apart(similarity)).select("a", "b")


def shingle_sets(texts: list[bytes | None], shingle: int) -> Iterator[np.ndarray]:
    """Each text's different shingles, as sorted 64-bit hashes; fewer words: the whole sequence; none: empty."""
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and held < 1 << 20:  # about a megabyte at a time
            held += len(texts[b] or b"")
            b += 1
        t = Texts([(x or b"").lower() for x in texts[a:b]])
        words = t.hashes()
        windows = window_hashes(words, shingle)
        for first, n in zip(t.first.tolist(), t.count.tolist(), strict=False):
            yield np.unique(windows[first : first + n - shingle + 1] if n > shingle else window_hashes(words[first : first + n], n) if n else words[:0])
        a = b


def _some(sets: Iterable[np.ndarray], most: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Lists of sets, of about `most` shingles together."""
    found, held = [], 0
    for s in sets:
        found.append(s)
        held += len(s) + 1
        if held >= most:
            yield found
            found, held = [], 0
    if found:
        yield found


def in_common(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that sets of these sizes together share at least, if they have that similarity."""
    return np.ceil(similarity * sizes / (1 + similarity) - 1e-6).astype(np.int64)


def left_out(n: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles of a set of n that are not in its prefix."""
    return np.maximum(np.ceil(similarity * n - 1e-6).astype(np.int64) - 1 - n // SPARE, 0)


def prefix(shingles: np.ndarray, similarity: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, frequent ones (sorted, with their ranks) after all others. What two sets have in common is
    in both prefixes, or follows the prefix that ends first; so in_common() less the greater left_out() are in both."""
    n = len(shingles)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        shingles = shingles[np.lexsort((shingles, np.where(frequent[at] == shingles, rank[at], -1)))]
    return shingles[: n - int(left_out(np.int64(n), similarity))]


def _frequent(source: DataFrame, marks: Marks, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many marked texts share, sorted, and their ranks, rarest first. All texts are counted, pack by pack."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(pack: list[np.ndarray]) -> pa.RecordBatch:
            value, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *pack]), return_counts=True)
            many = count >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(value[many].view(np.int64)), pa.array(count[many].astype(np.int64))], ["s", "n"])

        pack, held = [], 0
        for batch in batches:
            for found in shingle_sets(texts_of(marks.of(batch).column(1)), shingle):
                pack.append(found)
                held += len(found)
                if held >= PACK:
                    yield counted(pack)
                    pack, held = [], 0
        yield counted(pack)

    rows = source.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).toArrow()
    value = rows.column("s").to_numpy().view(np.uint64)
    order = np.argsort(value)
    return value[order], len(value) - 1 - order


class Marks:
    """Marked rows, as bits by partition: an eighth of a byte for each row, sent to all tasks."""

    def __init__(self, rows: DataFrame, column: str = "row") -> None:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for places in batch.column(1):
                    at = places.values.to_numpy()
                    bits = np.zeros(int(at.max()) + 1, bool)
                    bits[at] = True
                    found.append(np.packbits(bits).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["part", "bits"])

        row = F.col(column)
        parted = rows.select(F.shiftright(row, 33).cast("int").alias("part"), row.bitwiseAND((1 << 33) - 1).alias("at"))
        found = parted.groupBy("part").agg(F.collect_list("at").alias("at")).mapInArrow(run, "part int, bits binary").collect()
        self.bits = rows.sparkSession.sparkContext.broadcast({r.part: bytes(r.bits) for r in found})

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The marked rows of a batch, whose first column is the row's number."""
        row = batch.column(0).to_numpy()
        if not len(row):
            return batch
        bits = np.unpackbits(np.frombuffer(self.bits.value.get(int(row[0]) >> 33, b""), np.uint8))
        at = row & ((1 << 33) - 1)
        return batch.filter(pa.array((at < len(bits)) & bits[np.minimum(at, len(bits) - 1)].astype(bool) if len(bits) else np.zeros(len(at), bool)))


def _sets(reps: DataFrame, needed: DataFrame, source: DataFrame, shingle: int) -> DataFrame:
    """(rep, set) of the texts in question alone; needed: (rep)."""
    marks = Marks(reps.join(needed, "rep", "left_semi").select("row"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _some(shingle_sets(texts_of(marks.of(batch).column(1)), shingle)):
                names, values = pa.array([_name(s) for s in found]), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([names, values], ["rep", "set"])

    return source.mapInArrow(run, "rep long, set array<long>")


def _similar(pairs: DataFrame, reps: DataFrame, source: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets have the similarity."""
    pairs = cut(pairs)
    sets = _sets(reps, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), source, shingle)
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("set").alias(f"{x}s"))
    both = F.size(F.array_intersect("as", "bs"))
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").where(both / (F.size("as") + F.size("bs") - both) >= similarity).select("a", "b"))


def forest(sets: list[np.ndarray], group: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Links (index, index) between sets of that similarity, one of `left` and one of `right`, that join all groups which such
    pairs join, and each two groups once. A set is held against all others at once, by the lists of who holds its values."""
    size = np.array([len(s) for s in sets])
    _, value, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(value, kind="stable")
    holder, stop = np.repeat(np.arange(len(sets)), size)[order], np.cumsum(held)
    start, first = stop - held, np.cumsum(size) - size
    group = np.unique(group, return_inverse=True)[1]
    for a in left.tolist():
        other = right[group[right] != group[a]]
        if not len(other):
            continue
        mine = value[first[a] : first[a] + size[a]]
        n = held[mine]
        both = np.bincount(holder[np.arange(n.sum()) + np.repeat(start[mine] - np.cumsum(n) + n, n)], minlength=len(sets))[other]
        near = other[both / (size[a] + size[other] - both) >= similarity]
        joined, at = np.unique(group[near], return_index=True)
        for x in near[at].tolist():
            yield a, x
        group[np.isin(group, joined)] = group[a]


def _crowded(chains: DataFrame, reps: DataFrame, source: DataFrame, roots: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): verified links that join what all similar pairs under crowded shingles join; chains: (rep, s, size), the texts of
    each such shingle. Texts that chains join come together; where they hold more than BLOCK shingles, they are dealt to blocks,
    and each two blocks meet."""
    size = chains.groupBy("rep").agg(F.max("size").alias("n"))
    crowd = components(chains.select("rep", "s"), "rep", "s").select(F.col("node").alias("rep"), F.col("component").alias("crowd")).join(size, "rep")
    blocks = crowd.groupBy("crowd").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = crowd.join(blocks, "crowd").join(roots, "rep", "left").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    met = dealt.select("rep", "crowd", F.coalesce("root", "rep").alias("root"), "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    cells = cut(met.select("rep", "crowd", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    if cells.isEmpty():
        return chains.select(F.col("rep").alias("a"), F.col("rep").alias("b"))

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        rep, root, block = (cell.column(c).to_numpy() for c in ("rep", "root", "block"))
        lists = cell.column("set").combine_chunks()
        sets = np.split(lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])
        lo, hi = (np.flatnonzero(block == cell.column(c)[0].as_py()) for c in ("lo", "hi"))
        found = np.array(list(forest(sets, root, lo, hi, similarity)), np.int64).reshape(-1, 2)
        return pa.table({"a": rep[found].max(1), "b": rep[found].min(1)})

    named = cells.join(_sets(reps, cells.select("rep").distinct(), source, shingle), "rep")
    return cut(named.groupBy("crowd", "lo", "hi").applyInArrow(run, "a long, b long"))


def _name(shingles: np.ndarray) -> int:
    """64 bits that stand for a set, signed."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def _sharing(similarity: float) -> Callable:
    """(a, b, need): pairs of different groups under each shingle, of sizes that allow the similarity, and how often they need to
    meet; rows (s, n, rep, root) come sorted by shingle and size. A shingle of more than FEW texts, of several groups, makes a row
    a text: it, the shingle, and its size below zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda a, b, need: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need)], ["a", "b", "need"])
        for s, n, rep, root in _whole(batches):
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            held = np.diff(np.append(first, len(s)))
            crowded = np.repeat((held > FEW) & (np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)), held)
            if crowded.any():
                yield made(rep[crowded], s[crowded], -n[crowded])
            i, step = np.flatnonzero(~crowded), 1
            while len(i):
                i = i[i + step < len(s)]
                i = i[(s[i + step] == s[i]) & (similarity * n[i + step] <= n[i] + 1e-6)]
                a = i[root[i] != root[i + step]]
                if len(a):
                    b = a + step
                    need = in_common(n[a] + n[b], similarity) - np.maximum(left_out(n[a], similarity), left_out(n[b], similarity))
                    yield made(np.maximum(rep[a], rep[b]), np.minimum(rep[a], rep[b]), need)
                step += 1

    return run


def _rest(reps: DataFrame, source: DataFrame, roots: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): links that join the same groups as all similar pairs of different groups; roots: (rep, root) of those in groups."""
    marks = Marks(reps.select("row"))
    frequent = source.sparkSession.sparkContext.broadcast(_frequent(source, marks, shingle))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _some(shingle_sets(texts_of(marks.of(batch).column(1)), shingle)):
                first = [prefix(s, similarity, *frequent.value).view(np.int64) for s in found]
                names, sizes = pa.array([_name(s) for s in found]), pa.array([len(s) for s in found])
                yield pa.RecordBatch.from_arrays([names, sizes, pa.array(first, pa.list_(pa.int64()))], ["rep", "n", "first"])

    made = source.mapInArrow(run, "rep long, n long, first array<long>")
    named = made.join(F.broadcast(roots) if roots.count() <= SENT else roots, "rep", "left")
    entries = named.select(F.explode("first").alias("s"), "n", "rep", F.coalesce("root", "rep").alias("root"))
    met = entries.repartition(n_partitions(source), "s").sortWithinPartitions("s", "n").mapInArrow(_sharing(similarity), "a long, b long, need long")
    met = cut(met.groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("n")))
    chains = met.where("need < 0").select(F.col("a").alias("rep"), F.col("b").alias("s"), (-F.col("need")).alias("size"))
    # A pair meets more than size / SPARE times. With that many crowded shingles at most, a text meets all similar ones under others
    # too, as often as they need to meet less the crowded ones; two texts with more are compared in their crowd, or share none.
    lost = cut(chains.groupBy("rep").agg(F.count(F.lit(1)).alias("lost"), (F.count(F.lit(1)) > F.floor(F.max("size") / SPARE)).alias("heavy")))
    side = lambda x: lost.toDF(x, f"{x}lost", f"{x}heavy")
    least = F.col("need") - F.when(F.col("aheavy") & F.col("bheavy"), 0).otherwise(F.least(F.coalesce("alost", F.lit(0)), F.coalesce("blost", F.lit(0))))
    pairs = met.where("need > 0").join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.col("n") >= least).select("a", "b")
    heavy = chains.join(lost.where("heavy"), "rep", "left_semi")
    return _similar(pairs, reps, source, similarity, shingle).unionByName(_crowded(heavy, reps, source, roots, similarity, shingle))


def without_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of texts whose shingle sets have that similarity or more: that of the smallest id.

    Links join groups; they are those of all pairs of texts, by their sets of shingles. Null ids come last, rows of one id go
    by a hash of all their columns; of rows that agree in every column one stays. Rows that share an id but not a text are
    different documents. Texts without a word, null ones among them, are copies of each other. An empty table gives an empty
    result; column names don't matter.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no name clashes
    plain = steady(docs).toDF(*names).select(F.monotonically_increasing_id().alias("row"), *names)
    id_, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    words = [f"w{k}" for k in range(WORDS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            prints = np.array([long_fingerprint(t, shingle) for t in texts], np.uint64).reshape(-1, WORDS)
            rep = pa.array([_name(s) for s in shingle_sets(texts, shingle)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], rep, *(pa.array(np.ascontiguousarray(w).view(np.int64)) for w in prints.T)], ["row", "id", "h", "g", "rep", *words])

    source = plain.select("row", F.col(text).cast("string").alias("text"))
    given = plain.select("row", F.col(text).cast("string").alias("text"), F.col(id_).cast("long").alias("id"), F.xxhash64(*names).alias("h"), F.xxhash64(F.lit(1), *names).alias("g"))
    found = given.mapInArrow(run, "row long, id long, h long, g long, rep long, " + ", ".join(f"{w} long" for w in words))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h", "g", "row", *words)).alias("first")
    reps = cut(found.groupBy("rep").agg(first).select("rep", "first", "first.row", *[f"first.{w}" for w in words]))

    def grouped(links: DataFrame) -> DataFrame:
        return cut(components(links).select(F.col("node").alias("rep"), F.col("component").alias("root")))

    near = grouped(_similar(long_links(reps.select(*words, "rep"), similarity), reps, source, similarity, shingle))
    rest = _rest(reps, source, near, similarity, shingle)
    roots = grouped(rest.unionByName(near.toDF("a", "b")))
    kept = reps.select("rep", "first").join(roots, "rep", "left").groupBy(F.coalesce("root", "rep").alias("root")).agg(F.min("first").alias("first"))
    marks = Marks(kept.select("first.row"))
    return plain.mapInArrow(lambda batches: map(marks.of, batches), plain.schema).select(*names).toDF(*docs.columns)


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reached by links of at most `distance` bits.

    A row for each row of docs. Texts that are null, empty or without a word have fingerprint zero and link like any
    other. A row whose id is null keeps its fingerprint, links nothing and has a null component. Rows that share an id
    are one document. Other columns are ignored; an empty table gives an empty result.
    """
    found = cut(fingerprints(docs, shingle, id_col, text_col))
    reps = cut(found.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(simhash_links(reps, distance)).withColumnsRenamed({"node": "rep", "component": "root"})
    classes = reps.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("root"))
    named = found.where("doc_id IS NOT NULL").join(classes, "fp").select("doc_id", "fp", F.col("root").alias("component_id"))
    return named.unionByName(found.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")))
