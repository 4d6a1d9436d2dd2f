"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into integers, floor(scale * x). Each batch of candidates is sorted by length and cut into buckets.
For a query and a bucket, the score to beat over |query| * longest length in the bucket is the local cosine threshold:
above 1 the bucket is skipped; where it is high, only vectors whose normalised coordinate on the query's strongest axis
lies in the feasible interval are multiplied (coordinate pruning); otherwise those long enough (length pruning). All
surviving products are exact integers: through float64 where every sum stays below 2**53, through an 80-bit float below
2**63, and beyond through Python's integers, for pairs that an interval around the product does not rule out.

Queries are read in blocks of `block` rows, each broadcast once against all rows, its answers written and the broadcast
released before the next; a task returns at most k rows for a query, and the last sort of a query sees k rows a task.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no part, as do rows without
vec_id; a score that no long holds ranks by its exact value and is shown as the nearest long (the SQL fails there); rows of a query's own vec_id are never its candidates; repeated
equal query rows are one query; only vectors of a query's dimension are its candidates; ties go to the smaller vec_id.
"""

from __future__ import annotations

import math
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 5
SCALE = 256
BUCKET = 512
BLOCK = 8192
STEEP = 0.5
#: Integers below are exact in float64, and in a long or an 80-bit float. Larger components are squared in 80-bit floats.
EXACT, LONG, HUGE = 2.0**53, 1 << 63, 2.0**500


def matrices(ids: pa.Array, vectors: pa.Array, scale: float = SCALE):
    """(ids, integer matrix as float64, or as 80-bit floats where scaling overflows) for each dimension of a batch."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    off = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(values)  # nulls are nan here
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(values * scale)
        over = ~bad & ~np.isfinite(whole)
        if over.any():
            whole = np.where(over, np.floor(values.astype(np.longdouble) * scale), whole)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    size = np.diff(off)
    ok = (wrong[off[1:]] == wrong[off[:-1]]) & (size > 0) & np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    for d in np.unique(size[ok]):
        at = np.flatnonzero(ok & (size == d))
        yield ids.take(pa.array(at)).to_numpy(), whole[off[at][:, None] + np.arange(d)]


class Best:
    """The k best of each query so far; of rows in `big` by integers, as the 80-bit floats of their scores are rounded."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf, np.longdouble)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.k, self.big, self.hard = k, {}, np.zeros(n, bool)

    def offer(self, rows: np.ndarray, q: np.ndarray, p: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """rows: query numbers; q: their vectors; p, ids: candidates; own: pairs of one vec_id."""
        score, wide = products(q, p)
        if wide is None:
            return self.add(rows, np.where(own, -np.inf, score), ids)
        self.add(rows, np.where(own | wide, -np.inf, score), ids)
        self.add_wide(rows, q, p, ids, wide & ~own)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: a row of scores for each of rows, -inf where there is none; ids: of the columns."""
        if self.big and (hard := self.hard[rows]).any():
            reach = (score >= self.score[rows, -1:]) & (score > -np.inf)
            for i in np.flatnonzero(hard & reach.any(axis=1)):
                self.merge(rows[i], [(-int(score[i, j]), int(ids[j])) for j in np.flatnonzero(reach[i])])
            rows, score = rows[~hard], score[~hard]
            if not len(rows):
                return
        if score.shape[1] > 4 * self.k:  # only those that reach the k-th best of the row can matter; ties stay
            edge = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            use = ((score >= edge[:, None]) & (score >= self.score[rows, -1:])).any(axis=0)
            score, ids = score[:, use], ids[use]
        all_s = np.concatenate([self.score[rows], score], axis=1)
        all_i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        top = np.lexsort((all_i, -all_s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(all_s, top, 1)
        self.id[rows] = np.take_along_axis(all_i, top, 1)

    def add_wide(self, rows: np.ndarray, q: np.ndarray, p: np.ndarray, ids: np.ndarray, wide: np.ndarray) -> None:
        """The same for wide pairs, whose products are made as integers where they can matter."""
        low, high = bounds(q, p)
        beat = self.score[rows, -1]
        if wide.shape[1] > self.k:
            beat = np.maximum(beat, np.partition(np.where(wide, low, -np.inf), -self.k, axis=1)[:, -self.k])
        use, seen = wide & (high >= beat[:, None]), {}
        for i in np.flatnonzero(use.any(axis=1)):
            mine, new = [int(x) for x in q[i]], []
            for j in np.flatnonzero(use[i]):
                if j not in seen:
                    seen[j] = [int(x) for x in p[j]]
                new.append((-sum(map(mul, mine, seen[j])), int(ids[j])))
            self.merge(rows[i], new)

    def merge(self, row: int, new: list) -> None:
        old = self.big.pop(row, None)
        if old is None:
            old = [(-int(s), int(i)) for s, i in zip(self.score[row], self.id[row]) if s > -np.inf]
        both = sorted(old + new)[: self.k]
        for n, (s, i) in enumerate(both):
            self.score[row, n], self.id[row, n] = np.longdouble(-s), i
        self.hard[row] = any(abs(s) >= LONG for s, _ in both)
        if self.hard[row]:
            self.big[row] = both

    def columns(self, have: np.ndarray) -> tuple[np.ndarray, list]:
        """Scores as longs, and keys that order those at the ends of the range."""
        score = np.clip(self.score[have], np.longdouble(-LONG), np.longdouble(LONG - 1)).astype(np.int64)
        keys = np.full(self.score.shape, None, object)
        for row, both in self.big.items():
            for n, (s, _) in enumerate(both):
                if not -LONG < -s < LONG - 1:
                    keys[row, n] = ordered(-s)
        for row, n in zip(*np.nonzero((np.abs(self.score) >= LONG - 1) & have & ~self.hard[:, None])):
            keys[row, n] = ordered(int(self.score[row, n]))
        return score, keys[have].tolist()


def ordered(n: int) -> bytes:
    """Bytes that compare as the integers do."""
    b = abs(n).to_bytes((n.bit_length() + 7) // 8)
    b = len(b).to_bytes(4) + b
    return b"\1" + b if n >= 0 else b"\0" + bytes(255 - x for x in b)


def products(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Inner products, and which of them may be inexact as their sums may reach 2**63; None if none."""
    q_top, p_top = (np.abs(x).max(axis=1, initial=0) for x in (q, p))
    if q.dtype == p.dtype == np.float64 and q_top.max(initial=0) * p_top.max(initial=0) * q.shape[1] < EXACT:
        return q @ p.T, None
    bound = np.multiply.outer(q_top, p_top) * q.shape[1]
    long_q, long_p = q.astype(np.longdouble), p.astype(np.longdouble)  # 64-bit mantissa: exact below 2**63
    if q.dtype == p.dtype == np.float64:  # the large rows and columns only
        score, large = (q @ p.T).astype(np.longdouble), bound >= EXACT
        rows = large.mean(axis=1) > 0.5
        columns = large[~rows].any(axis=0)
        score[rows] = long_q[rows] @ long_p.T
        score[np.ix_(~rows, columns)] = long_q[~rows] @ long_p[columns].T
    else:
        score = long_q @ long_p.T
    wide = bound >= LONG
    return score, wide if wide.any() else None


def bounds(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An interval around each inner product, as 80-bit floats; any size of components."""

    def unit(x):
        e = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
        return np.ldexp(x, -e[:, None]).astype(np.float64), e

    (q, q_e), (p, p_e) = unit(q), unit(p)
    near = (q @ p.T).astype(np.longdouble)
    off = (q.shape[1] + 8) * 2.0**-52 * np.multiply.outer(np.sqrt((q * q).sum(axis=1)), np.sqrt((p * p).sum(axis=1))) + 1e-290
    e = np.add.outer(q_e, p_e)
    return np.ldexp(near - off, e), np.ldexp(near + off, e)


def scan(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, p: np.ndarray, best: Best, bucket: int = BUCKET) -> None:
    if max(np.abs(q).max(initial=0), np.abs(p).max(initial=0)) > HUGE:
        q, p = q.astype(np.longdouble), p.astype(np.longdouble)
    q_len = np.sqrt((q * q).sum(axis=1))
    length = np.sqrt((p * p).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    ids, p, length = ids[order], p[order], length[order]
    axis = np.abs(q).argmax(axis=1)
    q_axis = q[np.arange(len(q)), axis] / np.maximum(q_len, 1e-300)
    for a in range(0, len(p), bucket):
        b = slice(a, a + bucket)
        beat = best.score[:, -1].astype(q.dtype)
        top = length[a]
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = np.where(q_len * top > 0, beat / (q_len * top), np.where(beat > 0, np.inf, -np.inf))
        cos = cos * (1 - 1e-9 * np.sign(cos))
        steep = (cos > STEEP) & (cos <= 1)
        for i in np.flatnonzero(steep):
            t, f = cos[i], q_axis[i]
            wide = math.sqrt(max(0.0, (1 - t * t) * (1 - f * f))) + 1e-9
            x = p[b, axis[i]]
            # a vector shorter than the longest needs a higher cosine, so the bucket's interval holds for all
            near = (x >= (min(f * t, f) - wide) * length[b] - 1e-6) & (x <= (max(f * t, f) + wide) * length[b] + 1e-6) & (ids[b] != q_ids[i])
            if near.any():
                cand = np.flatnonzero(near) + a
                best.offer(np.array([i]), q[i : i + 1], p[cand], ids[cand], np.zeros((1, len(cand)), bool))
        flat = np.flatnonzero(cos <= STEEP)
        if len(flat):
            need = np.where(beat[flat] > 0, beat[flat] / np.maximum(q_len[flat], 1e-300), 0).min() * (1 - 1e-9)
            end = a + int(np.searchsorted(-length[b], -need, side="right"))
            if end > a:
                best.offer(flat, q[flat], p[a:end], ids[a:end], ids[None, a:end] == q_ids[flat][:, None])


def _search(block, k, scale, bucket):
    schema = pa.schema([("q", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])

    def run(batches):
        found = {}
        for batch in batches:
            for ids, p in matrices(batch.column(0), batch.column(1), scale):
                if p.shape[1] in block.value:
                    numbers, q_ids, q = block.value[p.shape[1]]
                    best = found.setdefault(p.shape[1], Best(len(q), k))
                    scan(q_ids, q, ids, p, best, bucket)
        for d, best in found.items():
            have = best.id != np.iinfo(np.int64).max
            have &= best.score > -np.inf
            n = block.value[d][0]
            score, beyond = best.columns(have)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(n, have.sum(axis=1)).astype(np.int32)), pa.array(best.id[have]), pa.array(score), pa.array(beyond, pa.binary())], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query row, over all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = vectors.where(is_query).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null").distinct()
    blocks = max(1, math.ceil(queries.count() / block))
    out = None
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b).toArrow()
        by_dim, names, at = {}, [], 0
        for ids, q in matrices(mine.column(0).combine_chunks(), mine.column(1).combine_chunks(), scale) if len(mine) else ():
            by_dim[q.shape[1]] = (np.arange(at, at + len(ids)), ids, q)
            names += ids.tolist()
            at += len(ids)
        sent = spark.sparkContext.broadcast(by_dim)
        found = rows.mapInArrow(_search(sent, k, scale, bucket), "q int, vec_id long, score long, beyond binary")
        ids = spark.createDataFrame(list(enumerate(names)), "q int, query_id long")
        one = found.join(F.broadcast(ids), "q").withColumn("b", F.lit(b))
        if blocks > 1:  # only one block of queries is held at a time
            one = written(one, "found")
            sent.destroy()
        out = one if out is None else out.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("b", "q").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH x AS (SELECT vec_id, [floor(256 * CAST(c AS DOUBLE)) for c in embedding] v FROM embeddings
           WHERE len(embedding) > 0 AND vec_id IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) score FROM x q, x c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
