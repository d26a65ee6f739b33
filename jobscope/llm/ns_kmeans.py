"""Centroid clustering on whole numbers with ns-bounds.

Every vector keeps its own centroid's distance and a lower bound of every other centroid's, each with the round in which it
was measured. All centroids of all rounds are kept, so a bound is loosened by the norm of the centroid's total displacement since
that round and not by the sum of its drifts, which is never smaller. A vector whose loosened bounds still rule all other
centroids out stays where it is; for the rest the centroids that aren't ruled out are measured exactly.

A round is one pass over the stored vectors. The centroids (``clusters`` of them) are all that tasks and driver exchange: tasks
give back sums of the vectors that changed their cluster, one row for each cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import stored

#: Largest magnitude of a component; beyond it a squared distance may not fit a long.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, dim: int = 64, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, v: floor(scale * x) of each component as double, of the vectors with exactly ``dim`` components, none of them null,
    non-finite or beyond ``LARGEST`` after scaling."""
    x = F.transform(F.col(vector_column), lambda c: F.floor(c.cast("double") * scale))
    bad = F.exists(vector_column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * scale > LARGEST))
    whole = vectors.filter((F.size(vector_column) == dim) & ~F.coalesce(bad, F.lit(True)))
    return whole.select(F.col(id_column).alias("id"), F.transform(x, lambda c: c.cast("int")).alias("v"))


def first_centroids(kept: DataFrame, clusters: int = 16, seed: str = "1:") -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed`` and id, in the order of the hashes; of equal ones the smaller vector first."""
    h = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    return [r["v"] for r in kept.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()]


class NsBounds:
    """What is known of a batch of vectors: nearest centroid, its distance, lower bounds of the others, and when each was measured."""

    def __init__(self, v: np.ndarray, clusters: int):
        self.v = v
        self.cluster = np.full(len(v), -1, np.int64)
        self.upper, self.upper_at = np.full(len(v), np.inf), np.zeros(len(v), np.int64)
        self.lower, self.lower_at = np.zeros((len(v), clusters)), np.zeros((len(v), clusters), np.int64)
        #: exact distances measured
        self.measured = 0

    def _squares(self, rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        self.measured += len(rows)
        off = self.v[rows] - centroid
        return np.einsum("ij,ij->i", off, off)

    def assign(self, history: np.ndarray) -> np.ndarray:
        """Moves every vector to the nearest centroid of the last round of ``history`` (rounds, clusters, dim); returns the clusters before."""
        now, before = len(history) - 1, self.cluster.copy()
        centroids, k = history[now], history.shape[1]
        moved = np.sqrt(((history[now] - history) ** 2).sum(axis=2).astype(np.float64))
        rows, own = np.arange(len(self.v)), np.maximum(self.cluster, 0)
        known = self.cluster >= 0
        # the slack covers rounding; who is ruled out is farther than the nearest, never as far
        upper = np.where(known, self.upper + moved[self.upper_at, own], np.inf) * (1 + 1e-9) + 1e-9
        lower = (self.lower - moved[self.lower_at, np.arange(k)]) * (1 - 1e-9) - 1e-9
        lower[rows[known], own[known]] = np.inf
        todo = rows[(lower <= upper[:, None]).any(axis=1)]
        best = np.full(len(todo), np.iinfo(np.int64).max)
        for j in np.unique(own[todo][known[todo]]):
            at = np.flatnonzero((own[todo] == j) & known[todo])
            best[at] = self._squares(todo[at], centroids[j])
            self._note(todo[at], j, best[at], now)
        upper[todo] = np.where(known[todo], np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + 1e-9, np.inf)
        nearest = np.where(known[todo], own[todo], k)
        for j in range(k):
            at = np.flatnonzero(lower[todo, j] <= upper[todo])
            d = self._squares(todo[at], centroids[j])
            self._note(todo[at], j, d, now)
            better = (d < best[at]) | ((d == best[at]) & (j < nearest[at]))
            best[at[better]], nearest[at[better]] = d[better], j
        self.cluster[todo], self.upper[todo], self.upper_at[todo] = nearest, np.sqrt(best.astype(np.float64)), now
        return before

    def _note(self, rows: np.ndarray, j: int, squares: np.ndarray, now: int) -> None:
        # kept as 32-bit numbers, so rounded down
        self.lower[rows, j] = np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf))
        self.lower_at[rows, j] = now

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        off = self.v - centroids[self.cluster]
        return np.einsum("ij,ij->i", off, off)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _rows_of(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.reshape(-1), kind))


_STATE = "id {id}, v array<int>, was int, cluster int, upper double, upper_at tinyint, lower array<float>, lower_at array<tinyint>, distance bigint"


def _round(state: DataFrame, history: np.ndarray, fresh: bool) -> DataFrame:
    """One assignment; ``state`` is (id, v) if ``fresh``, else what this returned for the round before."""
    clusters, dim = history.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = NsBounds(_matrix(batch.column("v"), dim, np.int64), clusters)
            if not fresh:
                b.cluster = batch.column("cluster").to_numpy().astype(np.int64)
                b.upper, b.upper_at = batch.column("upper").to_numpy().copy(), batch.column("upper_at").to_numpy().astype(np.int64)
                b.lower, b.lower_at = _matrix(batch.column("lower"), clusters, np.float64), _matrix(batch.column("lower_at"), clusters, np.int64)
            was = b.assign(history)
            made = [pa.array(was, pa.int32()), pa.array(b.cluster, pa.int32()), pa.array(b.upper), pa.array(b.upper_at, pa.int8()), _rows_of(b.lower.astype(np.float32), pa.float32()), _rows_of(b.lower_at, pa.int8()), pa.array(b.distances(history[-1]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), *made], ["id", "v", "was", "cluster", "upper", "upper_at", "lower", "lower_at", "distance"])

    return state.mapInArrow(run, _STATE.format(id=state.schema["id"].dataType.simpleString()))


def _changes(state: DataFrame, clusters: int, dim: int) -> np.ndarray:
    """(clusters, dim + 1) of what the vectors that moved add to each cluster's sums and, last, to its count."""
    width = dim + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((clusters, width), np.int64)
        for batch in batches:
            v = np.column_stack([_matrix(batch.column("v"), dim, np.int64), np.ones(batch.num_rows, np.int64)])
            for column, sign in (("cluster", 1), ("was", -1)):
                of = batch.column(column).to_numpy()
                for j in np.unique(of[of >= 0]):
                    sums[j] += sign * v[of == j].sum(axis=0)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums.reshape(-1)[at])], ["slot", "amount"])

    moved = state.filter("cluster <> was").select("v", "was", "cluster").mapInArrow(run, "slot int, amount bigint")
    out = np.zeros(clusters * width, np.int64)
    for r in moved.groupBy("slot").agg(F.sum("amount").alias("amount")).collect():  # a row for each cluster and component
        out[r["slot"]] = r["amount"]
    return out.reshape(clusters, width)


def cluster_vectors(kept: DataFrame, clusters: int = 16, rounds: int = 3, start: list[list[int]] | None = None) -> tuple[DataFrame | None, np.ndarray]:
    """(id, v, cluster, distance, ... of every row of ``kept`` (id, v; stored), the centroids' history), None without rows.

    ``rounds`` times every vector goes to its nearest centroid (ties to the smaller number) and each centroid that has vectors becomes the floor of
    their mean; then vectors are assigned once more. Rows that repeat count each. With fewer vectors than ``clusters`` there are as many centroids.
    """
    start = first_centroids(kept, clusters) if start is None else start
    if not start:
        return None, np.zeros((0, 0, 0), np.int64)
    history = np.array([start], np.int64)
    sums = np.zeros((len(start), history.shape[2] + 1), np.int64)
    state = kept
    for r in range(rounds + 1):
        state = stored(_round(state, history, r == 0))
        if r < rounds:
            sums += _changes(state, *history.shape[1:])
            count = sums[:, -1:]
            history = np.concatenate([history, np.where(count > 0, sums[:, :-1] // np.maximum(count, 1), history[-1])[None]])
    return state, history


def cluster_embeddings(embeddings: DataFrame, clusters: int = 16, rounds: int = 3, dim: int = 64) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are vectors of exactly ``dim`` components, none null, non-finite or beyond 2 ** 21 (2 ** 27 after scaling by 64, as squared distances must fit a
    long). Vectors with a null vec_id are clustered, but are the last to be a first centroid. Repeated rows count each and give a row each;
    equal distances go to the smaller number. An empty table, or one without such vectors, gives no rows. Columns other than vec_id and embedding
    aren't read, so their names may be any.
    """
    kept = stored(whole_vectors(embeddings, dim))
    state, history = cluster_vectors(kept, clusters, rounds)
    columns = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    spark = embeddings.sparkSession
    if state is None:
        return kept.select(F.col("id").alias("vec_id")).join(spark.createDataFrame([], columns + ", distance long"), F.lit(False)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    inertia = {r["cluster"]: r["n"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row a cluster
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    facts = spark.createDataFrame([(j, n, sum(inertia.values()), names[j]) for j, n in sorted(inertia.items())], columns)
    return state.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
