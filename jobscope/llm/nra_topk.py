"""Exact top-k by inner product with sorted-list aggregation, no random access (NRA).

In a block of vectors each dimension is a list sorted by value, read from its top for a query's positive weights and from
its bottom for negative ones. A query reads the lists that can add most (weight times range) to their ends and of the others
the first entries; what a vector hasn't shown yet is at most the list's last value read (upper bound) and at least its lowest value
(lower bound). A query is done with a block when no vectors but a few reach the k-th best score, or lower bound, that the query has from
anywhere; otherwise it reads on, as ``SCHEDULE`` says. The few that can still qualify get their final scores then.

All queries of a block are worked on at once: putting the bounds for unread entries gives matrices whose products with the queries'
weights are the bounds of all vectors for all queries, made of nothing but entries read and the lists' last values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import stored, stored_parts

#: Vectors in a block, queries that a task works on at a time, and queries sent to the tasks at a time.
BLOCK_ROWS, STEP_ROWS, QUERY_ROWS = 4096, 1024, 16_384

#: For each round, the share of lists read to their ends, and of the entries of the others.
SCHEDULE = ((5 / 8, 1 / 4), (3 / 4, 1 / 2), (7 / 8, 3 / 4), (1, 1))


def quantized(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64) -> DataFrame:
    """id, v: floor(scale * x) of each component as double; without vectors that are null or hold null or non-finite ones."""
    x = F.col(vector_column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return whole.select(F.col(id_column).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(ends), dim), np.int64)
    out[np.arange(dim) < ends[:, None]] = flat
    return out


class Block:
    """The sorted lists of a block of vectors."""

    def __init__(self, v: np.ndarray):
        self.v, self.sorted = v, np.sort(v, axis=0)
        self.range = self.sorted[-1] - self.sorted[0]

    def heaviest(self, q: np.ndarray, lists: int) -> np.ndarray:
        """The queries' (rows) weights of the ``lists`` lists that can add most to each, zero for the others."""
        if lists >= q.shape[1]:
            return q
        out, at = np.zeros_like(q), np.argpartition(-np.abs(q) * self.range, lists - 1, axis=1)[:, :lists]
        np.put_along_axis(out, at, np.take_along_axis(q, at, axis=1), axis=1)
        return out

    def bounds(self, depth: int, heavy: np.ndarray, light: np.ndarray, upper: bool) -> np.ndarray:
        """Bounds for all queries (rows) of all vectors (columns): heavy lists are read to their ends, of light ones ``depth`` entries."""
        n, known = len(self.v), heavy @ self.v.T
        if not light.any():
            return known
        top, bottom, low, high = self.sorted[n - depth], self.sorted[depth - 1], self.sorted[0], self.sorted[-1]
        rising, falling = np.maximum(light, 0), np.minimum(light, 0)
        if upper:
            return known + rising @ np.maximum(self.v, top).T + falling @ np.minimum(self.v, bottom).T
        return known + rising @ np.where(self.v >= top, self.v, low).T + falling @ np.where(self.v <= bottom, self.v, high).T


class TopK:
    """The best (score, id) of each query so far, ties to smaller ids; and what reading took."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.best_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.best = np.full((len(ids), k), -np.inf)  # scores are whole numbers below 2 ** 53
        self.held = np.zeros(len(ids), np.int64)
        self.largest = float(np.abs(q).max(initial=0))
        #: blocks searched by queries, blocks that they left before the lists' ends, entries read, entries there were
        self.searched = self.stopped = self.read = self.entries = 0

    def add(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.ids[j]
        have = self.best_ids[j][: self.held[j]]
        ids, scores = np.concatenate([have, ids[other]]), np.concatenate([self.best[j][: self.held[j]], scores[other]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.held[j] = len(order)
        self.best_ids[j, : len(order)], self.best[j, : len(order)] = ids[order], scores[order]

    def search(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Adds what qualifies in a block of vectors, reading its lists no deeper than needed."""
        exact = np.float64 if np.abs(v).max(initial=0) * self.largest * v.shape[1] >= 2**24 else np.float32
        block = Block(v.astype(exact))
        for at in range(0, len(self.ids), STEP_ROWS):
            self._step(np.arange(at, min(at + STEP_ROWS, len(self.ids))), ids, block)

    def _step(self, open_: np.ndarray, ids: np.ndarray, block: Block) -> None:
        n, dim = block.v.shape
        self.searched, self.entries = self.searched + len(open_), self.entries + len(open_) * n * dim
        for share, part in SCHEDULE:
            q = self.q[open_].astype(block.v.dtype)
            lists, depth = math.ceil(share * dim), max(1, math.ceil(part * n))
            heavy = block.heaviest(q, lists)
            upper, floor = block.bounds(depth, heavy, q - heavy, True), self.best[open_, -1]
            if lists < dim and n > self.k + 1 and (fresh := np.flatnonzero(np.isneginf(floor))).size:
                # nothing to beat yet: the block's own lower bounds, of which the query itself may be one
                lower = block.bounds(depth, heavy[fresh], (q - heavy)[fresh], False)
                floor[fresh] = np.partition(lower, n - self.k - 1, axis=1)[:, n - self.k - 1]
            may = upper >= floor[:, None]
            ready = (may.sum(axis=1) <= max(4 * self.k, n // 16)) | (lists >= dim)
            self.read += int(ready.sum()) * n * lists + int(ready.sum()) * depth * (dim - lists)
            self.stopped += int(ready.sum()) if lists < dim else 0
            self._resolve(open_[ready], q[ready], may[ready], floor[ready], ids, block)
            open_ = open_[~ready]
            if not len(open_):
                return

    def _resolve(self, open_: np.ndarray, q: np.ndarray, may: np.ndarray, floor: np.ndarray, ids: np.ndarray, block: Block) -> None:
        """Final scores of the vectors that may qualify."""
        j, rows = np.nonzero(may)
        scores = np.concatenate([np.einsum("ij,ij->i", q[j[at : at + 50_000]], block.v[rows[at : at + 50_000]]) for at in range(0, len(j), 50_000)] or [np.zeros(0)])
        good = scores >= floor[j]
        j, rows, scores = j[good], rows[good], scores[good].astype(np.float64)
        ends = np.searchsorted(j, np.arange(len(open_) + 1))
        for i in np.unique(j):
            mine = slice(ends[i], ends[i + 1])
            self.add(open_[i], ids[rows[mine]], scores[mine])

    def rows(self) -> pa.RecordBatch:
        at = np.arange(self.k) < self.held[:, None]
        query = np.repeat(self.ids, self.held)
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(self.best_ids[at]), pa.array(self.best[at].astype(np.int64))], ["query_id", "id", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), id, score: the k candidates of largest inner product for each query, ties to smaller ids.

    Both are (id long, v array<long>), as from :func:`quantized`. A candidate with a query's id isn't its candidate; rows that
    repeat an id and its vector are one; an id with several vectors has the best of all its pairs.
    Vectors of different lengths are filled up with zeros. Fewer candidates than k: all of them. An empty table gives no rows. Products
    must stay under 2 ** 53. Queries go out in blocks of about ``QUERY_ROWS``, one after the other, of which the driver holds one at
    a time; each task keeps k candidates for each of them, and a block's best are written before the next goes out.
    """
    queries, candidates = stored(queries.distinct()), stored(candidates.distinct())
    dim = max(queries.agg(F.max(F.size("v"))).first()[0] or 0, candidates.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))

    def found(b: int) -> DataFrame:
        mine = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        part = _search(candidates, np.array(mine.column("id").to_pylist(), np.int64), _matrix(mine.column("v").combine_chunks(), dim), k, dim)
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    return found(0) if blocks == 1 else stored_parts(found(b) for b in range(blocks))


def _search(candidates: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, dim: int) -> DataFrame:
    sent = candidates.sparkSession.sparkContext.broadcast((ids, q))  # bounded: about QUERY_ROWS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TopK(*sent.value, k)
        for batch in batches:
            step = math.ceil(batch.num_rows / max(1, math.ceil(batch.num_rows / BLOCK_ROWS))) or 1
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                v = part.column(1)
                best.search(part.column(0).to_numpy(), _matrix(pa.concat_arrays([v]) if v.offset == 0 else v.take(pa.array(range(len(v)))), dim))
        yield best.rows()

    return candidates.select("id", "v").mapInArrow(run, "query_id long, id long, score long")


def search_embeddings(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the vectors whose vec_id is divisible by ``every``.

    Vectors null or with null or non-finite components take no part; columns other than vec_id and embedding aren't read.
    """
    q = quantized(embeddings)
    return top_k(q.filter(F.col("id") % every == 0), q, k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
