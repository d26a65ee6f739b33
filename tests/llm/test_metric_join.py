"""The metric-space join against all pairs, in regions of every kind."""

import random

import numpy as np
import pytest

from jobscope.llm import metric_join
from jobscope.llm.words import shingles

SCHEMA = "doc_id long, text string, same string, nid int, row string, part string, n int, keys string, region int"


def plain(rows, percent=90, n=3):
    """(doc_id, n_shingles, component_id) of each row, by comparing all with all."""
    sets = []
    for _, text in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return sorted(((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def result(spark, rows, percent=90):
    df = spark.createDataFrame([(i, t, "s", 1, "r", "p", 2, "k", 3) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in metric_join.jaccard_components(df.repartition(5), percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def text_of(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words) + 1)
        words[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
    return words


@pytest.mark.parametrize("leaf,pivots,slot,percent", [(512, 16, 4096, 90), (4, 3, 5, 90), (4, 2, 3, 70)])
def test_components_against_all_pairs(spark, monkeypatch, leaf, pivots, slot, percent):
    for name, value in (("LEAF_SETS", leaf), ("PIVOTS", pivots), ("SLOT_SETS", slot)):
        monkeypatch.setattr(metric_join, name, value)
    rng = random.Random(leaf + percent)
    rows = []
    for n in (1, 2, 3, 9, 11, 12, 20, 40, 130, 400):
        base = text_of(rng, n)
        family = [base]
        for _ in range(14):  # chains and stars, at and around the threshold
            family.append(edited(rng, rng.choice(family), rng.randrange(1, max(2, n // 25) + 1)))
        rows += [" ".join(w) for w in family]
    rows += [rows[30].upper(), rows[40].replace(" ", " \t\n"), "", None, " \r\n", "É é", "é É", "a a a a a a", "a a a"]
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    rows += [(3, rows[9][1]), rows[5], rows[5], (None, rows[7][1]), (None, "nobody else says this"), (None, None), (4, rows[20][1])]
    assert result(spark, rows, percent) == plain(rows, percent)


def test_crowds_of_unlinked_texts(spark, monkeypatch):
    """Texts of slots with two phrases each: many share a part with many, and few are linked; cells don't help, blocks do."""
    monkeypatch.setattr(metric_join, "LEAF_SETS", 4)
    monkeypatch.setattr(metric_join, "PIVOTS", 2)
    rng = random.Random(4)
    phrases = [[" ".join(text_of(rng, 12)) for _ in range(2)] for _ in range(8)]
    rows = [(i, " ".join(rng.choice(p) for p in phrases)) for i in range(150)]
    rows += [(1000 + i, t + " and one") for i, t in rows[::10]]
    met = {"cells": 0, "blocks": 0}
    cells, blocks = metric_join._cells, metric_join._blocks
    monkeypatch.setattr(metric_join, "_cells", lambda *a: met.update(cells=met["cells"] + 1) or cells(*a))
    monkeypatch.setattr(metric_join, "_blocks", lambda *a: (df := blocks(*a)) and met.update(blocks=met["blocks"] + df.count()) or df)
    assert result(spark, rows) == plain(rows)
    assert met["cells"] > 0 and met["blocks"] > 0


def test_linked_sets_share_a_region():
    """Whatever the sizes, and also where parts are empty."""
    rng = np.random.default_rng(8)
    empty = 0
    for percent in (90, 80):
        for n in [1, 5, 9, 10, 11, 18, 19, 20, 27, 60, 333, 2000] * 12:
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.unique(a)
            for _ in range(int(rng.integers(0, n // 8 + 2))):
                b = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.append(b, np.uint64(rng.integers(0, 1 << 63)))
            a, b = np.unique(a), np.unique(b)
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= percent * (len(a) + len(b) - shared) and not np.array_equal(a, b):
                x, y = metric_join.region_keys([a, b], percent)
                assert set(x) & set(y), (percent, len(a), len(b))
                empty += len(np.unique(x)) < len(x)
    alone = metric_join.region_keys([np.arange(40, dtype=np.uint64)], 90)[0]
    assert (alone == metric_join.region_keys([shingles(["x"]), np.arange(40, dtype=np.uint64), np.arange(9000, dtype=np.uint64)], 90)[1]).all()  # not by what else is in the batch


def test_empty_table(spark):
    assert result(spark, []) == [] and result(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
