"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a long string of bits, the sides of random hyperplanes, and keeps the strings in a sorted
array. A query descends to the longest prefix that it shares with any string of each tree; then all trees ascend
together, bit by bit, until enough candidates share the prefix, so that the prefix is as long as the data near the query
allow. Candidates are ranked by exact cosine, in their buckets: none is left out for a rounded score.

Arrays are cut at their first few bits into buckets (as many as give some thousand vectors each, but so few that all
trees' buckets of a query hold twice the candidates asked for; depth zero on small tables), and a bucket that holds more
is dealt out in shares, each asked by the bucket's queries. A query whose buckets hold too few goes on to the root, where
one tree has every vector. The ascent takes two
passes: one counts, for each query and length of prefix, what all trees hold; the other, knowing the length at which
to stop, scores the candidates where they are and returns the best of each bucket.

Equal vectors are one entry of the index with its smallest ids, so a vector that a third of the rows repeat is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from helixframe.llm.common import cut, n_partitions

#: Bits of a string; of a bucket's depth at most; levels of the ascent that are told apart below the bucket.
BITS, DEEPEST, LEVELS = 62, 12, 30
#: Vectors aimed at in a bucket, and those from which on it is dealt out.
AIM, SHARE = 4096, 8192


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((trees * BITS, dim)).astype(np.float32)


def strings(vectors: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Bits of each vector in each tree, as a number."""
    side = (vectors.astype(np.float32) @ planes(vectors.shape[1], trees, seed).T > 0).reshape(len(vectors), trees, BITS)
    out = np.zeros((len(vectors), trees), np.uint64)
    for b in range(BITS):
        out = out << np.uint64(1) | side[:, :, b].astype(np.uint64)
    return out


def _by_dim(vectors: list[np.ndarray]) -> Iterator[np.ndarray]:
    dims = np.array([len(v) for v in vectors])
    for d in np.unique(dims):
        yield np.flatnonzero(dims == d)


def _placed(trees: int, seed: int, depth: int, shares: dict[int, int] | None, query: bool, kind: str) -> Callable:
    """(bucket, kind, id, string[, stop], vector): entries in one share of each tree's bucket, queries in all of them. A
    query that stops at the root is in all buckets of the first tree instead. Without stops, queries are to be counted. Vectors
    are sent as numbers of `kind`, which holds the table's exactly."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            stops = batch.column("stop").to_numpy() if query else np.full(len(ids), -1, np.int32)
            vectors = [np.frombuffer(v, "<f8") for v in batch.column("vector").to_pylist()]
            raw = [v.astype(kind).tobytes() for v in vectors]
            for some in _by_dim(vectors) if vectors else ():
                x = np.stack([vectors[i] for i in some])
                s = strings(x, trees, seed)
                home = (s >> np.uint64(BITS - depth)).astype(np.int64) + (np.arange(trees) << depth)
                root = stops[some] == 0
                row = np.concatenate((np.repeat(np.flatnonzero(~root), trees), np.repeat(np.flatnonzero(root), 1 << depth)))
                home = np.concatenate((home[~root].ravel(), np.tile(np.arange(1 << depth), root.sum())))
                s = np.concatenate((s[~root].ravel(), np.repeat(s[root, 0], 1 << depth)))
                home = home * 65536 + min(x.shape[1], 65535)
                if shares is not None:
                    n = np.array([shares.get(h, 1) for h in home.tolist()])
                    if query:
                        of = np.repeat(np.arange(len(home)), n)
                        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                        home, s, row = home[of] * 65536 + k, s[of], row[of]
                    else:
                        home = home * 65536 + (ids[some][row] * 0x9E3779B1 >> 8) % n
                step = int(np.clip((1 << 21) // x.shape[1], 1, 4096))
                for a in range(0, len(home), step):
                    r = some[row[a : a + step]]
                    arrays = [pa.array(home[a : a + step]), pa.array(np.full(len(r), int(query), np.int32)), pa.array(ids[r]), pa.array(s[a : a + step].view(np.int64)), pa.array(stops[r].astype(np.int32)), pa.array([raw[i] for i in r], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["bucket", "kind", "id", "string", "stop", "vector"])

    return run


PLACED = "bucket long, kind int, id long, string long, stop int, vector binary"


def _range(keys: np.ndarray, s: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The part of the sorted array that shares a prefix of `length` bits with each string."""
    rest = (BITS - np.asarray(length)).astype(np.uint64)
    low = s >> rest << rest
    return np.searchsorted(keys, low), np.searchsorted(keys, low + (np.uint64(1) << rest))


def _stream(batches: Iterable[pa.RecordBatch], answer: Callable, kind: str = "<f8") -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, entries before queries: answer(keys, ids, vectors, queries' batch) for each part."""
    now, entries, index = None, [], None
    for batch in batches:
        buckets, kinds = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], (buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1]), [True]))) if len(buckets) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            if buckets[a] != now:
                now, entries, index = buckets[a], [], None
            if kinds[a] == 0:
                entries.append(part)
                continue
            if index is None:
                rows = pa.Table.from_batches(entries) if entries else part.slice(0, 0)
                keys = rows.column("string").to_numpy().astype(np.int64).view(np.uint64)
                order = np.argsort(keys, kind="stable")
                held = rows.column("vector").to_pylist() if "vector" in rows.schema.names else []
                vectors = _matrix([held[i] for i in order], kind) if held else np.zeros((0, 0))
                index = keys[order], rows.column("id").to_numpy()[order], vectors
            yield answer(*index, part)


def _counts(depth: int) -> Callable:
    def answer(keys: np.ndarray, _ids: np.ndarray, _vectors: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        s = part.column("string").to_numpy().view(np.uint64)
        out = []
        for level in range(LEVELS):
            a, b = _range(keys, s, min(BITS, depth + level))
            out.append(pa.array(b - a))
        return pa.RecordBatch.from_arrays([part.column("id"), *out], ["id", *(f"n{k}" for k in range(LEVELS))])

    return lambda batches: _stream(batches, answer)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; each row's sum has a fixed order."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def top(q: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cosines of the `keep` rows nearest to q, ties by the smaller id.

    A product in any order of summing picks rows; it is off by less than (dimensions + 8) roundings, so all within twice
    that of the last place are compared by the cosine itself.
    """
    some = np.arange(len(vectors))
    if len(some) > keep:
        rough = vectors @ (q / np.sqrt(q @ q)) / lengths
        least = np.partition(rough, len(rough) - keep)[len(rough) - keep]
        some = np.flatnonzero(rough >= least - 2 * (len(q) + 8) * np.finfo(np.float64).eps)
    score = cosines(vectors[some], q[None])
    best = np.lexsort((ids[some], -score))[:keep]
    return some[best], score[best]


def _best(keep: int, kind: str) -> Callable:
    held: list = [None, None]  # an index and its vectors' lengths

    def answer(keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        if held[0] is not vectors:
            held[:] = vectors, np.sqrt((vectors * vectors).sum(1))
        first, last = _range(keys, part.column("string").to_numpy().view(np.uint64), part.column("stop").to_numpy())
        near, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        for q, a, b in zip(_matrix(part.column("vector").to_pylist(), kind), first.tolist(), last.tolist(), strict=True):
            if b > a:
                rows, score = top(q, vectors[a:b], held[1][a:b], ids[a:b], keep)
                near.append(ids[a + rows])
                scores.append(score)
        asked = np.repeat(part.column("id").to_numpy(), np.minimum(np.maximum(last - first, 0), keep))
        return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(np.concatenate(near)), pa.array(np.concatenate(scores))], ["id", "near", "score"])

    return lambda batches: _stream(batches, answer, kind)


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; those that take no part are left out."""
    for batch in batches:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or not v or None in v:
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                out.append((x + 0.0).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vector"])


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, trees: int = 64, candidates: int = 4000, share: float = 0.5, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by `every`.

    Nearness is the cosine of the original vectors in double precision; ties go to the smaller id. Candidates are all rows
    but the query's own; a vector of another length is none. A row whose id is null, or whose vector is null, empty,
    zero, or holds a null, a NaN or an infinity takes no part. Rows that repeat an id and a vector count once; one id
    with two vectors is two rows of which the nearer counts. Ascents end at `candidates` over all trees, or
    `share` times the number of vectors if that is more, or at the root, where all are candidates. Vectors without clusters, whose nearest
    neighbours are hardly nearer than others, need such a share for a recall of 0.9; clustered ones can do with 0. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    parts = n_partitions(spark)
    kind = "<f4" if vectors.schema[vector_col].dataType == ArrayType(FloatType(), vectors.schema[vector_col].dataType.containsNull) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(_packed, "vec_id long, vector binary")
    # Two hashes name a vector; of its ids the k + 1 smallest can appear in a result.
    named = cut(rows.select("vec_id", "vector", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g")))
    order = W.partitionBy("h", "g").orderBy("vec_id")
    first = named.groupBy("h", "g", "vec_id").agg(F.first("vector").alias("vector")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    entries = cut(first.groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = named.where(F.col("vec_id") % every == 0)
    # A class of equal vectors asks once; its id is that of its entry.
    questions = cut(asked.select("h", "g").distinct().join(entries.select("h", "g", "id", "vector"), ["h", "g"]))
    size = entries.count()
    wanted = max(candidates, int(share * size))
    depth = int(np.clip(np.floor(np.log2(max(1, size) / max(AIM, 2 * wanted / trees))), 0, DEEPEST))
    index = entries.select("id", "vector")
    counted = index.mapInArrow(_placed(trees, seed, depth, None, False, kind), PLACED).groupBy("bucket").count().where(F.col("count") > SHARE)
    shares = {r["bucket"]: -(-r["count"] // SHARE) for r in counted.collect()}  # at most trees * 2^DEEPEST
    index_rows = index.mapInArrow(_placed(trees, seed, depth, shares, False, kind), PLACED)

    def sorted_(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")

    blank = questions.select("id", F.lit(-1).alias("stop"), "vector")
    both = index_rows.drop("vector").unionByName(blank.mapInArrow(_placed(trees, seed, depth, shares, True, kind), PLACED).drop("vector"))
    levels = [f"n{j}" for j in range(LEVELS)]
    totals = sorted_(both).mapInArrow(_counts(depth), "id long, " + ", ".join(f"{n} long" for n in levels)).groupBy("id").agg(*[F.sum(n).alias(n) for n in levels])
    stop = F.coalesce(*[F.when(F.col(levels[j]) >= wanted, F.lit(min(BITS, depth + j))) for j in reversed(range(LEVELS))], F.lit(0))
    stopped = questions.join(totals.select("id", stop.alias("stop")), "id").select("id", "stop", "vector")
    again = index_rows.unionByName(stopped.mapInArrow(_placed(trees, seed, depth, shares, True, kind), PLACED))
    # The nearest of all candidates are among the nearest of each bucket, whose cosines are exact.
    found = sorted_(again).mapInArrow(_best(k + 1, kind), "id long, near long, score double")
    best = found.groupBy("id", "near").agg(F.max("score").alias("score"))
    nearest_ = best.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "near"))).where(F.col("r") <= k + 1)
    lists = nearest_.join(entries.select(F.col("id").alias("near"), "ids"), "near").groupBy("id").agg(F.collect_list(F.struct(F.negative("score").alias("less"), "ids")).alias("found"))
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["less"].alias("less"), i.alias("vec_id")))))
    ranked = lists.select("id", F.slice(F.sort_array(flat), 1, (k + 1) * (k + 1)).alias("found"))
    member = asked.join(entries.select("h", "g", "id"), ["h", "g"]).select(F.col("vec_id").alias("query_id"), "id").distinct()
    own = member.join(ranked, "id").select("query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.negative("col.less").alias("score"))
