"""Near-duplicate classes by DartMinHash signatures and a banded join.

A document is the set of its five-word shingles, each of weight 1 however often it occurs. Each element throws
darts: the points of a Poisson process of its own, made by hashing, over the plane of weight and rank. Darts at a weight
over the element's weight miss; each other dart falls on one of the coordinates of the signature, and each coordinate
keeps its earliest dart (that of least rank). Only ranks below a limit in inverse proportion to the document's total
weight are thrown, so about k ln k darts make the signature, however long the document is. Two documents agree in a
coordinate with the chance of their (weighted) Jaccard similarity.

Signatures are cut into bands; texts that share a band are candidates, and candidates are links if their sets of
shingles have a Jaccard similarity of ``threshold`` at least, the same measure that the signatures estimate. In small groups all
are compared with all; a large one's members are compared with its first, and if that leaves it in several parts, its texts are joined
anew, exactly, by their rarest shingles, and where too many texts share one of those by :mod:`metric_join`. Classes are the connected components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import component_roots
from .metric_join import join_regions, region_members
from .words import in_steps, lists, map_texts, mix, shingles, words
from .workspace import stored

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Members of a band's group up to which all are compared with all.
CROWD = 8
#: Characters of texts that are signed at a time (a longer text is alone).
STEP_CHARS = 1 << 19
#: Size of the table of guessed shingle counts, a power of two.
BUCKETS = 1 << 20
#: Pairs that a rare shingle may give; the texts of one that would give more are joined by regions.
KEY_PAIRS = 1 << 18


def _darts(cells: np.ndarray, part: np.ndarray, limit: np.ndarray, owner: np.ndarray, k: int):
    """(owner * k + coordinate, rank, dart) of all darts of unit-wide cells below the rank limits; of a cell of which
    only ``part`` is within the element's weight, darts at a larger weight are left out."""
    rank, slots, ranks, darts = np.zeros(len(cells)), [], [], []
    while len(cells):
        cells = cells + _STEP
        h = mix(cells)
        rank = rank - np.log(((h >> _U(20)).astype(np.float64) + 0.5) * 2.0**-44)
        alive = rank <= limit
        cells, part, limit, owner, rank, h = (x[alive] for x in (cells, part, limit, owner, rank, h))
        hit = part >= 1
        if not hit.all():
            hit |= (mix(h ^ _STEP) >> _U(11)).astype(np.float64) * 2.0**-53 < part
        slots.append((owner * k + (h & _U(0xFFFFF)).astype(np.int64) % k)[hit])
        ranks.append(rank[hit])
        darts.append(h[hit])
    return np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """An array (len(sets), k) of uint64: the earliest dart of each coordinate. ``sets``: (elements, weights > 0), not empty."""
    out = np.zeros((len(sets), k), _U)
    todo, reach = np.arange(len(sets)), k * (math.log(k) + 4)
    while len(todo):
        count = [len(sets[i][0]) for i in todo]
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo])
        total = np.array([sets[i][1].sum() for i in todo])
        owner = np.repeat(np.arange(len(todo)), count)
        n = np.ceil(weights).astype(np.int64)
        at = np.repeat(np.arange(len(n)), n)
        c = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        cells = mix(elements[at] + c.astype(_U) * _U(0xD1342543DE82EF95))
        slot, rank, dart = _darts(cells, weights[at] - c, (reach / total)[owner[at]], owner[at], k)
        best = np.full(len(todo) * k, np.inf)
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        got = np.zeros(len(todo) * k, _U)
        got[slot[first]] = dart[first]
        full = np.isfinite(best).reshape(len(todo), k).all(axis=1)
        out[todo[full]] = got.reshape(len(todo), k)[full]
        todo, reach = todo[~full], reach * 2  # a coordinate got no dart: throw farther
    return out


def weighted_set(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text's words, each of weight 1, as links are judged by plain sets."""
    elements = np.unique(shingles(found))
    return elements, np.ones(len(elements))


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) of int64: a hash of each run of ``rows`` coordinates and of its place."""
    bands = signatures.reshape(len(signatures), -1, rows)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=_U), bands.shape[:2]).copy()
    for i in range(rows):
        keys = mix(keys * _STEP + bands[:, :, i])
    return keys.view(np.int64)


def _signed(bands: int, rows: int) -> Callable:
    def signed(texts: list[str | None]) -> list[tuple]:
        """(what names its words, set, bands) of each text."""
        found = [words(t) for t in texts]
        some = [i for i, f in enumerate(found) if f]
        weighted = {i: weighted_set(found[i]) for i in some}
        keys = band_keys(dart_signatures([weighted[i] for i in some], bands * rows), rows) if some else []
        by, none = dict(zip(some, keys)), np.empty(0, np.int64)
        sets = [np.unique(weighted[i][0].astype(np.uint32).view(np.int32)) if i in weighted else none for i in range(len(texts))]
        ids = [xxhash.xxh3_128_digest(("w" + " ".join(f)) if f else "t" + t) if t is not None else None for f, t in zip(found, texts)]
        return [(ids[i], sets[i], by.get(i, none)) for i in range(len(texts))]

    def run(texts, raw):
        told = [x for part in in_steps(texts, STEP_CHARS) for x in signed(part)]
        return range(len(texts)), {"raw": raw, "same": [x[0] for x in told], "set": lists([x[1] for x in told], pa.int32()), "bands": lists([x[2] for x in told], pa.int64())}

    return run


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (center, node; repeats allowed) whose shingle sets are similar enough, as u > v; stored."""
    own, other = sets.select("node", F.col("set").alias("a")), sets.select(F.col("node").alias("center"), F.col("set").alias("b"))
    met = pairs.distinct().join(own, "node").join(other, "center").withColumn("shared", F.size(F.array_intersect("a", "b")))
    alike = met.filter(F.col("shared") >= threshold * (F.size("a") + F.size("b") - F.col("shared")))
    return stored(alike.select(F.col("node").alias("u"), F.col("center").alias("v")))


def _parted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (node, ...) with the part, as linked so far, that each is of."""
    return members.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")


def _rare_keys(dense: DataFrame, threshold: float) -> DataFrame:
    """node, part, key, place, size: the rarest shingles of each set of ``dense`` (node, part, set; stored), as many as make
    sure that two sets of the similarity ``threshold`` share one (prefix filter). ``place``: of the key in the set's order.

    Any order of the shingles gives all pairs; rarity is guessed from counts in a table of fixed size.
    """
    counted = dense.select(F.explode("set").alias("s")).groupBy(F.expr(f"s & {BUCKETS - 1}").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    often = np.zeros(BUCKETS, np.uint8)
    often[counted["bucket"].to_numpy()] = 8 * np.log2(counted["n"].to_numpy())
    out = T.StructType([*dense.drop("set").schema.fields, *T.StructType.fromDDL("key int, place int, size int").fields])

    def run(batches):
        for batch in batches:
            index, keys, places, sizes = [], [], [], []
            for i, x in enumerate(batch.column("set")):
                x = x.values.to_numpy()
                n = len(x) - math.ceil(threshold * len(x) - 1e-9) + 1
                keys.append(x[np.lexsort((x, often[x & (BUCKETS - 1)]))[:n]])
                index.append(np.full(len(keys[-1]), i))
                places.append(np.arange(len(keys[-1])))
                sizes.append(np.full(len(keys[-1]), len(x)))
            at = pa.array(np.concatenate(index)) if index else pa.array([], pa.int64())
            made = [pa.array(np.concatenate(c) if c else [], pa.int32()) for c in (keys, places, sizes)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("node", "part")), *made], ["node", "part", "key", "place", "size"])

    return dense.select("node", "part", "set").mapInArrow(run, out)


def _rare_pairs(dense: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs (center, node) of texts of different parts that can be similar enough, by their rarest shingles; texts (node) that share
    one with too many to be paired by it, stored).

    A key's texts that aren't of its largest part are compared with all others, so a part that most texts are in already
    isn't compared with itself. Two similar texts share a key that gives pairs, or one that doesn't, and are then both among the texts told.
    """
    rare = stored(_rare_keys(dense, threshold))
    parts = rare.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    most = parts.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max("n").alias("largest"))
    most = stored(most.filter("parts > 1").withColumn("crowded", (F.col("n") - F.col("largest")) * F.col("n") > KEY_PAIRS).select("key", "most", "crowded"))
    mixed = stored(rare.join(most, "key"))
    crowded = stored(mixed.filter("crowded").select("node").distinct())
    mixed = mixed.filter("not crowded").drop("crowded")
    # what is still to come after the key's places in both sets must be enough for the overlap that the threshold asks for
    close = (
        f"a.size >= {threshold} * b.size - 1e-6 and b.size >= {threshold} * a.size - 1e-6 and "
        f"least(a.size - a.place, b.size - b.place) >= {threshold / (1 + threshold)} * (a.size + b.size) - 1e-6"
    )
    few = mixed.filter("part != most").alias("a")
    met = few.join(mixed.alias("b"), F.expr(f"a.key = b.key and a.part != b.part and (b.part = b.most or a.node > b.node) and {close}"))
    return met.select(F.least("a.node", "b.node").alias("center"), F.greatest("a.node", "b.node").alias("node")), crowded


def _crowd_edges(dense: DataFrame, threshold: float) -> DataFrame:
    """u, v: ``dense`` texts (node, part, set) that are no first of their class, and the first, after an exact join; stored.

    Texts that could be linked share a part of the shingles' universe with the same contents; only such groups with several classes are
    looked at, and those in bounded pieces, see :func:`metric_join.join_regions`.
    """
    percent = round(100 * threshold, 9)
    sets = stored(dense.select("node", "part", F.transform("set", lambda x: x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))).alias("set"), F.monotonically_increasing_id().alias("nid")))
    first = sets.groupBy("part").agg(F.min("nid").alias("v"))
    known = stored(sets.select("nid", "part").join(first, "part").filter("nid > v").select(F.col("nid").alias("u"), "v"))
    found = join_regions(region_members(sets, math.floor(percent)), sets, known, percent)
    node = sets.select("nid", "node")
    named = found.join(node.toDF("u", "a"), "u").join(node.toDF("v", "b"), "v")
    return stored(named.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def _component_edges(texts: DataFrame, signed: DataFrame, threshold: float) -> DataFrame | None:
    """u, v: texts (nodes) and the first of their class, for all that aren't it; None if there are no links."""
    keyed = texts.select(F.explode("bands").alias("key"), "node")
    groups = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center")).filter("n > 1"))
    members = stored(keyed.join(groups, "key"))
    nodes = stored(members.select("node").distinct())
    # a text's set is that of any row which has its id and its words; always shuffled, as the nodes grow with the documents
    sets = stored(signed.select("node", "set").join(nodes.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")))
    large = members.filter(F.col("n") > CROWD)
    small = members.filter(F.col("n") <= CROWD).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("g"))  # bounded: CROWD nodes
    pair = F.expr(f"flatten(transform(g, (x, i) -> transform(slice(g, i + 2, {CROWD}), y -> struct(x as center, y as node))))")
    pairs = small.select(F.explode(pair).alias("p")).select("p.*").unionByName(large.filter("node != center").select("center", "node"))
    links = _links(pairs, sets, threshold)
    roots = component_roots(links)
    mixed = _parted(large, roots).groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high")
    crowd = stored(large.join(mixed, "key", "left_semi").select("node").distinct())
    if not crowd.isEmpty():
        dense = stored(_parted(sets.join(crowd, "node"), roots))
        pairs, crowded = _rare_pairs(dense, threshold)
        more = _links(pairs, sets, threshold)
        if not crowded.isEmpty():
            more = more.unionByName(_crowd_edges(dense.join(crowded, "node", "left_semi"), threshold))
        if not more.isEmpty():
            roots = component_roots(stored(roots.unionByName(more).distinct()))
    return None if roots.isEmpty() else roots


def _classified(docs: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """doc_id, raw (a hash of the text), node and root of every row; both null for a null text.

    What is linked are texts, not ids: a node names the rows with one text by the smallest doc_id among them (null ids come
    last) and a hash of their words, so unlike texts under one id are two nodes. A class's root is its smallest node.
    """
    found = map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("raw")), _signed(bands, rows), "raw bigint, same binary, set array<int>, bands array<bigint>", more=("raw",))
    own = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.xxhash64("same").alias("h"))
    signed = stored(found.withColumn("node", F.when(F.col("same").isNotNull(), own)))
    texts = stored(signed.filter("same is not null").groupBy("same").agg(F.min("node").alias("node"), F.first("bands").alias("bands")))
    roots = _component_edges(texts.filter("size(bands) > 0"), signed, threshold)
    named = texts.select("same", F.col("node").alias("root"))
    if roots is not None:
        edges = roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
        named = stored(texts.select("same", "node").join(edges, "node", "left").select("same", F.coalesce("root", "node").alias("root")))
    return signed.select("doc_id", "raw", "same", "node").join(named, "same", "left").select("doc_id", "raw", "node", "root")


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, bands: int = 20, rows: int = 4) -> DataFrame:
    """doc_id and class_id of every row of ``docs``: the smallest doc_id of those that are linked, directly or by others.

    Texts with the same words are one text, whatever their case and punctuation. A text without a word is alone
    but for exact copies; a null text is alone. Rows that repeat an id and its text share a class; unlike texts under one id
    have the classes of their texts. A null doc_id has its copies' class, or null. Every text is read whole, whatever its length. Empty table: no
    rows. Columns other than doc_id and text aren't read, so their names may be any.

    At a similarity of 0.8 a pair shares no band with a chance of 3e-5. Of what shares a band nothing is left out: groups of
    ``CROWD`` texts at most are compared all with all; in larger ones what isn't linked by way of the first member is
    joined anew, exactly.
    """
    return _classified(docs, threshold, bands, rows).select("doc_id", F.coalesce("root.id", "doc_id").alias("class_id"))


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that are first of their near-duplicate class: that with the smallest doc_id (null
    comes last); of rows with one id and one text, any one. Unlike texts under one id, and rows with null texts, all stay.
    """
    rows = stored(_classified(docs, threshold, 20, 4))
    first = rows.filter("root is not null and node = root").groupBy("root", "raw").agg(F.count(F.lit(1)).alias("n"))
    first = first.groupBy("root").agg(F.min(F.struct("raw", "n")).alias("w")).select(F.col("root.id").alias("id"), "w.raw", "w.n")
    # the row goes as one struct, so that no column of it can clash with those of the join
    whole = docs.filter("text is not null").select(F.col("doc_id").alias("own"), F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    kept = whole.join(first.hint("shuffle_hash"), F.expr("own <=> id and hash = raw"))
    once = kept.filter("n = 1").select("row.*")
    again = kept.filter("n > 1").dropDuplicates(["own", "hash"]).select("row.*")
    return once.unionByName(again).unionByName(docs.filter("text is null"))
