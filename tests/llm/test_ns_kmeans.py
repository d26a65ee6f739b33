"""Clustering with ns-bounds against plain rounds, and what the bounds save."""

import hashlib
import math
import random

import numpy as np
import pytest

from jobscope.llm.ns_kmeans import NsBounds, cluster_embeddings

SCHEMA = "vec_id long, embedding array<float>, cluster string, id string, v int, distance string"


def plain(rows, k=16, rounds=3):
    """vec_id -> set of results, by loops over whole numbers."""
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    for r in range(rounds + 1):
        found = [min((sum((x - y) ** 2 for x, y in zip(v, u)), j) for j, u in enumerate(c)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                if own := [v for (_, v), (_, f) in zip(kept, found) if f == j]:
                    c[j] = [sum(x) // len(own) for x in zip(*own)]
    each = {}
    for d, j in found:
        each[j] = each.get(j, 0) + d
    return sorted((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found))


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "c", "i", 1, "d") for i, e in rows], SCHEMA)


def result(df):
    return sorted(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(7)
    centers = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(20)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.2))) for x in rng.choice(centers)]) for i in range(150)]
    rows += [rows[3], rows[3], rows[9], (900, rows[5][1]), (901, [0.0] * 64), (902, [0.0] * 64)]
    return rows


def test_clusters_against_plain_rounds(spark, vectors):
    odd = [(950, None), (951, []), (952, [1.0] * 63), (953, [1.0] * 65), (954, [None] + [1.0] * 63), (955, [float("nan")] + [1.0] * 63), (956, [float("-inf")] + [1.0] * 63), (957, [3e30] * 64)]
    assert result(cluster_embeddings(frame(spark, vectors + odd).repartition(5))) == plain(vectors)


def test_few_vectors_null_ids_and_none(spark, vectors):
    assert result(cluster_embeddings(frame(spark, vectors[:3]))) == plain(vectors[:3])
    got = cluster_embeddings(frame(spark, [*vectors[:20], (None, vectors[30][1])])).collect()
    assert len(got) == 21 and sum(r["vec_id"] is None for r in got) == 1
    assert cluster_embeddings(frame(spark, [])).count() == 0 and cluster_embeddings(frame(spark, [(1, None)])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold_and_spare_work(monkeypatch):
    """After each round the bounds hold, loosened by total displacement; that spares more than summed drifts would."""
    rng = np.random.default_rng(5)
    centers = rng.integers(-60, 60, (16, 64))
    v = centers[rng.integers(0, 16, 3000)] + rng.integers(-25, 25, (3000, 64))
    history, b = v[:16][None].copy(), NsBounds(v, 16)
    spared, summed = [], 0
    for r in range(6):
        before = b.measured
        b.assign(history)
        squares = ((v[:, None, :] - history[-1][None]) ** 2).sum(axis=2)
        assert (b.cluster == squares.argmin(axis=1)).all() and (b.distances(history[-1]) == squares.min(axis=1)).all()
        exact, at = np.sqrt(squares), np.arange(16)
        total = np.sqrt(((history[-1] - history) ** 2).sum(axis=2))
        steps = np.sqrt((np.diff(history, axis=0) ** 2).sum(axis=2))
        drift = np.vstack([steps[i:].sum(axis=0) for i in range(len(history))])
        loosened = b.lower - total[b.lower_at, at]
        others = b.cluster[:, None] != at
        assert (loosened[others] <= exact[others] + 1e-6).all() and (b.upper + total[b.upper_at, b.cluster] >= exact[np.arange(len(v)), b.cluster] - 1e-6).all()
        assert (drift >= total - 1e-9).all()
        summed += int((loosened > b.lower - drift[b.lower_at, at] + 1e-9).sum())
        spared.append(1 - (b.measured - before) / (len(v) * 16))
        history = np.concatenate([history, np.array([v[b.cluster == j].sum(axis=0) // max(1, (b.cluster == j).sum()) if (b.cluster == j).any() else history[-1][j] for j in range(16)])[None]])
    assert spared[0] == 0 and spared[-1] > 0.5 and summed > 0
