"""Exact Jaccard join of shingle sets as a metric-space join: pivots, Voronoi regions, windows, recursion.

The Jaccard distance is a metric, so for a pivot p two sets within a distance e of each other have distances to p that differ by e at
most. In a region every set goes to its nearest pivot's cell and, as a copy, to each cell whose pivot is farther by at most 2e (the
window): of two linked sets one's own cell then holds both. Cells are regions of the next level. A region small enough for a task is
joined exactly there.

Unrelated texts share nothing, so they are at distance 1 of each other and of every pivot, and windows around any pivots would copy all
of them everywhere. The first level's regions are therefore made without looking at other texts: the universe of shingles is cut by a hash into more
parts than two linked sets have shingles apart and may have empty parts, so at least one part of both is the same and not empty, and each
part with its contents is a region. The least set of a region is its pivot. What is linked to a pivot is one class at once, and only regions that
hold several classes go on. Where cells don't get smaller (all sets about as far from each other) a region is joined in blocks,
the sets of its largest class only with those of others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import component_roots
from .words import lists, map_texts, mix, shingles
from .workspace import stored, stored_parts

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Sets that a region may hold to be joined in a task; pivots of a region over that, and its sets that are measured in a task.
LEAF_SETS, PIVOTS, SLOT_SETS = 512, 16, 4096
#: Ratio of the sizes in a size class, and how often parts are cut anew for sets that have more empty parts than their class allows for.
CLASS_RATIO, CUTS = 1.5, 6
#: A region goes on as cells if the squares of their sizes add up to less than this share of its own.
SHRINK = 0.5


def plain_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A to Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def size_classes(largest: int) -> np.ndarray:
    """The first sizes of the size classes, to beyond ``largest``."""
    starts = [1]
    while starts[-1] <= 2 * largest:
        starts.append(max(starts[-1] + 1, int(starts[-1] * CLASS_RATIO)))
    return np.array(starts)


def class_parts(starts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts, empty parts allowed for) of each size class but the last: linked sets of which the larger one is in the class have at least
    one more part in common than either may have empty. One part: only equal sets are linked."""
    apart = 2 * (starts[1:] - 1) * (100 - percent) // (100 + percent)
    least = starts[:-1] * percent / 100
    spare = 1 + np.ceil(3 * (apart + 1) * np.exp(-least / (apart + 2))).astype(np.int64)
    return np.where(apart > 0, apart + 1 + spare, 1), spare


def _cut(flat: np.ndarray, owner: np.ndarray, parts: np.ndarray, spare: np.ndarray, salt: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their owners, owners with more than ``spare`` empty parts): a hash of each part that isn't empty of each set, of its place and of ``salt``."""
    offset = np.cumsum(parts) - parts
    slot = offset[owner] + ((mix(flat + _U(_STEP * (seed + 1) & _MASK)) >> _U(32)) % parts[owner].astype(_U)).astype(np.int64)
    n = int(parts.sum())
    count = np.bincount(slot, minlength=n)
    low, high = (np.bincount(slot, weights=half.astype(np.float64), minlength=n).astype(_U) for half in (flat & _U(0xFFFFFFFF), flat >> _U(32)))
    of = np.repeat(np.arange(len(parts)), parts)
    place = (np.arange(n) - offset[of]).astype(_U)
    key = mix(low + mix(high + mix(place * _U(_STEP) + salt[of].astype(_U) * _U(CUTS + 1) + _U(seed))))
    some = count > 0
    return key[some], of[some], np.flatnonzero(np.bincount(of[~some], minlength=len(parts)) > spare)


def region_keys(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Keys of each set's regions of the first level: sets that are linked, but not equal, share one.

    The parts are as many as the size class of the larger set asks for, so a set has keys for its own class and for the next ones
    where a larger partner can be. Empty parts have no key, as they would say nothing; a set with more of them than its class allows for is cut anew as
    well, by another hash, and after ``CUTS`` of them it has one key with all its like.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = size_classes(int(sizes.max(initial=1)) * 100 // percent)
    first, last = np.searchsorted(starts, sizes, "right") - 1, np.searchsorted(starts, sizes * 100 // percent, "right") - 1
    doc = np.repeat(np.arange(len(sets)), np.where(sizes > 0, last - first + 1, 0))
    level = np.concatenate([np.arange(a, b + 1) for a, b, n in zip(first, last, sizes) if n] or [np.zeros(0, np.int64)])
    parts, spare = class_parts(starts, percent)
    doc, level = doc[parts[level] > 1], level[parts[level] > 1]
    keys, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for seed in range(CUTS):
        if not len(doc):
            break
        flat, owner = np.concatenate([sets[d] for d in doc]), np.repeat(np.arange(len(doc)), sizes[doc])
        key, of, again = _cut(flat, owner, parts[level], spare[level], level, seed)
        keys.append(key)
        owners.append(doc[of])
        doc, level = doc[again], level[again]
    keys.append(mix(_U(_STEP) + level.astype(_U)))
    owners.append(doc)
    key, owner = np.concatenate(keys).view(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.split(key[order], np.searchsorted(owner[order], np.arange(1, len(sets)))) if len(sets) else []


def _described(percent: int, n: int):
    def run(texts, row):
        sets = [np.unique(shingles(plain_words(t), n)) for t in texts]
        same = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return range(len(texts)), {"row": row, "same": same, "n": [len(s) for s in sets], "keys": lists(region_keys(sets, percent), pa.int64())}

    return run


def _sets_of(rows: DataFrame, n: int) -> DataFrame:
    """nid, pivot, set of ``rows`` (nid, pivot, same, text); a text that hasn't the set it was taken for gives none."""

    def run(texts, pivot, same):
        sets = [np.unique(shingles(plain_words(t), n)) for t in texts]
        good = [i for i, s in enumerate(sets) if xxhash.xxh3_128_digest(s.tobytes()) == same[i]]
        return good, {"pivot": [pivot[i] for i in good], "set": lists([sets[i].view(np.int64) for i in good], pa.int64())}

    return map_texts(rows, run, "pivot bigint, set array<bigint>", id_column="nid", more=("pivot", "same"))


def region_members(sets: DataFrame, percent: int) -> DataFrame:
    """region, nid of ``sets`` (nid, set) for all regions of the first level that hold several; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _grouped(batch.column("set"))
            keys = region_keys(np.split(flat, np.cumsum(sizes)[:-1]), percent) if batch.num_rows else []
            nid = np.repeat(batch.column("nid").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(nid, pa.int64())], ["region", "nid"])

    keyed = stored(sets.select("nid", "set").mapInArrow(run, "region bigint, nid bigint"))
    shared = keyed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("region")
    return stored(keyed.join(shared, "region"))


def _parted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (nid, ...) with the class, as linked so far, that each is of."""
    return rows.join(roots.select(F.col("u").alias("nid"), F.col("v").alias("root")), "nid", "left").withColumn("part", F.coalesce("root", "nid")).drop("root")


def _mixed(rows: DataFrame) -> DataFrame:
    """region, n, most (the largest class) of the regions of ``rows`` (region, nid, part) that hold several classes; stored."""
    parts = rows.groupBy("region", "part").agg(F.count(F.lit(1)).alias("n"))
    found = parts.groupBy("region").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("n", "part")).alias("most"))
    return stored(found.filter("parts > 1").drop("parts"))


def _grouped(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all elements as hashes, how many of each row)."""
    return column.flatten().to_numpy().view(_U), column.value_lengths().to_numpy().astype(np.int64)


def leaf_links(nids: np.ndarray, parts: np.ndarray, flat: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different classes, enough of them to join all classes that links join.

    ``flat`` holds the sets one after the other. What all pairs share is a matrix product over the elements that several sets have.
    """
    n, owner = len(nids), np.repeat(np.arange(len(nids)), sizes)
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1
    column = (np.cumsum(often) - 1)[place]
    kept = often[place]
    owner, column = owner[kept], column[kept]
    shared, width = np.zeros((n, n)), max(1, (1 << 22) // n)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, (at, at + width))
        table = np.zeros((n, width), np.float32)
        table[owner[a:b], column[a:b] - at] = 1
        shared += table @ table.T
    total = sizes[:, None] + sizes
    i, j = np.nonzero(np.triu((100 * shared >= percent * (total - shared)) & (parts[:, None] != parts), 1))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(int(parts[a])), find(int(parts[b]))
        if x != y:
            root[x] = y
            out.append((max(int(nids[a]), int(nids[b])), min(int(nids[a]), int(nids[b]))))
    return out


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The rows of each value of ``keys``, by which they come sorted, as one batch each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.column_stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and tuple(values[a]) != last:
                yield pa.concat_batches(held)
                held = []
            last = tuple(values[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _clustered(leaves: DataFrame) -> DataFrame:
    """region, nid, part: ``leaves`` with the regions that hang together as one, where that is small enough; a region with one class is left out; stored.

    Alike sets meet in dozens of regions that overlap; so each goes to a task once and not dozens of times.
    """
    rows = stored(leaves.join(_mixed(leaves).select("region"), "region", "left_semi"))
    least = rows.groupBy("region").agg(F.min("nid").alias("v"))
    joined = component_roots(stored(rows.join(least, "region").filter("nid > v").select(F.col("nid").alias("u"), "v").distinct()))
    named = rows.join(joined.withColumnsRenamed({"u": "nid", "v": "root"}), "nid", "left").withColumn("cluster", F.coalesce("root", "nid")).drop("root")
    sizes = joined.groupBy(F.col("v").alias("cluster")).agg((F.count(F.lit(1)) < LEAF_SETS).alias("fits"))  # the root has no row
    region = F.when(F.col("fits"), F.xxhash64(F.lit("cluster"), "cluster")).otherwise(F.col("region"))
    return stored(named.join(sizes, "cluster").select(region.alias("region"), "nid", "part").distinct())


def _joined_leaves(leaves: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: links of ``leaves`` (region, nid, part; bounded regions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, "region"):
            flat, sizes = _grouped(group.column("set"))
            found = leaf_links(group.column("nid").to_numpy(), group.column("part").to_numpy(), flat, sizes, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    rows = _clustered(leaves).join(sets.select("nid", "set"), "nid")
    return rows.repartition("region").sortWithinPartitions("region").select("region", "nid", "part", "set").mapInArrow(run, "u bigint, v bigint")


def _cells(rows: DataFrame, regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """region, cell, nid, pivot, linked: each set of large ``rows`` (region, nid) in its nearest pivot's cell and in those within the window.

    A region's sets are dealt out to slots of about ``SLOT_SETS``; each slot gets the region's pivots and streams its sets past them.
    ``regions``: region, n.
    """
    own = rows.join(regions.select("region", F.ceil(F.col("n") / SLOT_SETS).alias("slots")), "region")
    w = W.partitionBy("region").orderBy(F.xxhash64("region", "nid"), "nid")
    pivots = own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= PIVOTS)
    dealt = own.select("region", F.pmod(F.xxhash64("nid"), F.col("slots")).alias("slot"), F.lit(PIVOTS + 1).alias("rank"), "nid")
    dealt = dealt.unionByName(pivots.select("region", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)).alias("slot"), "rank", "nid"))
    window = 2 * (100 - percent) / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, []
        for batch in batches:
            for part in _runs(iter([batch]), "region", "slot"):
                here = (part.column("region")[0].as_py(), part.column("slot")[0].as_py())
                if here != at:
                    at, known = here, []
                rank, nids = part.column("rank").to_numpy(), part.column("nid").to_numpy()
                flat, sizes = _grouped(part.column("set"))
                ends = np.cumsum(sizes)
                for k in np.flatnonzero(rank <= PIVOTS):
                    known.append((nids[k], flat[ends[k] - sizes[k] : ends[k]]))
                rest = np.flatnonzero(rank > PIVOTS)
                if not len(rest):
                    continue
                start = ends[rest[0]] - sizes[rest[0]]
                flat, sizes, nids, owner = flat[start:], sizes[rest], nids[rest], np.repeat(np.arange(len(rest)), sizes[rest])
                shared = np.column_stack([np.bincount(owner, weights=p[np.minimum(np.searchsorted(p, flat), len(p) - 1)] == flat, minlength=len(rest)) for _, p in known])
                union = sizes[:, None] + np.array([len(p) for _, p in known]) - shared
                far = 1 - shared / union
                i, j = np.nonzero(far <= far.min(axis=1, keepdims=True) + window + 1e-9)
                linked = 100 * shared[i, j] >= percent * union[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), here[0])), pa.array(j, pa.int32()), pa.array(nids[i]), pa.array(np.array([p for p, _ in known])[j]), pa.array(linked)], ["region", "cell", "nid", "pivot", "linked"])

    sized = dealt.join(sets.select("nid", "set"), "nid").select("region", "slot", "rank", "nid", "set")
    return sized.repartition("region", "slot").sortWithinPartitions("region", "slot", "rank").mapInArrow(run, "region bigint, cell int, nid bigint, pivot bigint, linked boolean")


def _blocks(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """region, nid, part: ``rows`` (region, nid, part) in pairs of blocks, each small enough for a task; sets of a region's largest class (``most``
    in ``regions``) only meet others."""
    half = LEAF_SETS // 2
    own = rows.join(regions.select("region", "most"), "region").withColumn("in_most", F.col("part") == F.col("most"))
    counts = own.groupBy("region").agg(F.sum(F.col("in_most").cast("long")).alias("m"), F.sum((~F.col("in_most")).cast("long")).alias("o"))
    own = own.join(counts.select("region", F.ceil(F.col("m") / half).alias("ms"), F.ceil(F.col("o") / half).alias("os")), "region")
    block: Column = F.when(F.col("in_most"), F.col("os") + F.pmod(F.xxhash64("nid"), F.col("ms"))).otherwise(F.pmod(F.xxhash64("nid"), F.col("os")))
    # block x of the others meets every block from x on
    meets = F.expr("if(in_most, transform(sequence(0L, os - 1), o -> struct(o as x, block as y)), concat(transform(sequence(block, os + ms - 1), y -> struct(block as x, y as y)), filter(transform(sequence(0L, block), x -> struct(x as x, block as y)), p -> p.x < block)))")
    return own.withColumn("block", block).select("region", "nid", "part", F.explode(meets).alias("p")).select(F.xxhash64("region", "p.x", "p.y").alias("region"), "nid", "part")


def _star(sets: DataFrame, percent: int) -> DataFrame:
    """u, v: ``sets`` (nid, pivot, set) that are linked to their pivot; stored."""
    pivots = sets.select(F.col("pivot").alias("nid")).filter("nid is not null").distinct()
    heads = sets.join(pivots, "nid", "left_semi").select(F.col("nid").alias("pivot"), F.col("set").alias("b"))
    met = sets.filter("pivot is not null").join(heads, "pivot").withColumn("shared", F.size(F.array_intersect("set", "b")))
    alike = met.filter(100 * F.col("shared") >= percent * (F.size("set") + F.size("b") - F.col("shared")))
    return stored(alike.select(F.col("nid").alias("u"), F.col("pivot").alias("v")))


def join_regions(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``roots`` (u, v: each set but the first of its class, and that one) after the regions of ``members`` (region, nid; stored) that hold
    several classes are joined. ``sets``: nid, set (hashes as bigint, ascending if read as unsigned; stored)."""
    leaves: list[DataFrame] = []
    while True:
        rows = stored(_parted(members, roots))
        regions = _mixed(rows)
        small, large = regions.filter(F.col("n") <= LEAF_SETS), stored(regions.filter(F.col("n") > LEAF_SETS))
        leaves.append(stored(rows.join(small, "region", "left_semi")))
        if large.isEmpty():
            break
        crowded = stored(rows.join(large, "region", "left_semi"))
        cells = stored(_cells(crowded.select("region", "nid"), large, sets, percent))
        squares = cells.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("c")).groupBy("region").agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
        shrunk = stored(large.join(squares, "region").filter(F.col("squares") <= SHRINK * F.col("n") * F.col("n")).select("region"))
        leaves.append(stored(_blocks(crowded.join(shrunk, "region", "left_anti"), large)))
        found = cells.filter("linked and nid <> pivot").select(F.greatest("nid", "pivot").alias("u"), F.least("nid", "pivot").alias("v"))
        roots = component_roots(stored(roots.unionByName(found).distinct()))
        members = cells.join(shrunk, "region", "left_semi").select(F.xxhash64("region", "cell").alias("region"), "nid")
    rest = stored_parts(_parted(x.drop("part"), roots) for x in leaves)
    found = stored(_joined_leaves(rest, sets, percent))
    return roots if found.isEmpty() else component_roots(stored(roots.unionByName(found).distinct()))


def jaccard_components(docs: DataFrame, percent: int = 90, shingle_words: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    A text's set: the distinct ``shingle_words``-word shingles of its :func:`plain_words`; with fewer words, the whole sequence as one; null texts and
    texts without words have none and are linked with nothing. Texts link when 100 * shared >= ``percent`` * union. component_id: the smallest
    doc_id that links reach; a null doc_id comes last, so it is null only where all ids are. Equal sets are one node, so copies and
    repeated rows cost nothing; unlike texts under one id are nodes of their own. Every text is read whole. An empty table gives
    no rows. Columns other than doc_id and text aren't read.
    """
    row = F.xxhash64("doc_id", "text")
    described = stored(map_texts(docs.select("doc_id", "text", row.alias("row")), _described(percent, shingle_words), "row bigint, same binary, n bigint, keys array<bigint>", more=("row",)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), "row"))
    nodes = described.filter("same is not null").groupBy("same").agg(first.alias("first"), F.first("keys").alias("keys"))
    nodes = stored(nodes.select("same", "first.id", "first.row", "keys", F.monotonically_increasing_id().alias("nid")))
    keyed = nodes.select(F.explode("keys").alias("region"), "nid")
    shared = keyed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("nid").alias("pivot")).filter("n > 1").drop("n")
    members = stored(keyed.join(shared, "region"))
    wanted = members.groupBy("nid").agg(F.min(F.when(F.col("pivot") < F.col("nid"), F.col("pivot"))).alias("pivot")).join(nodes.select("nid", "same", "row"), "nid")
    # a repeated row would give its set again
    texts = docs.filter("text is not null").select(row.alias("row"), "text").join(wanted, "row").dropDuplicates(["row", "nid"])
    sets = stored(_sets_of(texts.select("nid", "text", "pivot", "same"), shingle_words))
    roots = join_regions(members.select("region", "nid"), sets, component_roots(_star(sets, percent)), percent)
    least = _parted(nodes.select("nid", "same", "id"), roots)
    named = least.join(least.groupBy("part").agg(F.min("id").alias("component_id")), "part").select("same", "component_id")
    out = described.select("doc_id", "same", F.col("n").alias("n_shingles")).join(named, "same", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
