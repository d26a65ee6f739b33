"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

Documents are partitioned by size, and so are the items. In the partition with at most ``u`` shingles a document's
signature has ``m`` bins, a power of two in proportion to ``u``, and keeps the smallest shingle hash of each bin; so a
signature is as selective for a book as for a note, and a plain MinHash's low collision chance for short in long
doesn't arise. An item has a signature for each document partition; one shared bin value makes a candidate, and a
candidate counts if at least ``threshold`` of the item's distinct shingles are in the document.

A contained shingle is the smallest of its bin with chance (1 - exp(-load)) / load. The load u/m is set from the fewest
contained shingles of the item partition such that an item that qualifies is missed with chance ``miss`` at most.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import map_texts, shingles, words
from .workspace import stored_parts

#: Items are searched in blocks of about so many bytes of text; a block is what is sent to every task.
BLOCK_BYTES = 16 << 20


@dataclass
class _Partition:
    """The items with ``least`` to 2 * ``least`` - 1 needed shingles."""

    least: int
    bins_per_shingle: int
    items: list[int]


class ItemIndex:
    """Signatures of a block of items, for all partitions of document sizes, built as they are met."""

    def __init__(self, texts: list[str], threshold: float, miss: float = 1e-6):
        self.shingles = [np.unique(shingles(words(t))) for t in texts]
        self.threshold = threshold
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(self.shingles):
            if len(s):
                by_class.setdefault(self.needed(len(s)).bit_length() - 1, []).append(i)
        self.partitions = []
        for c, items in sorted(by_class.items()):
            least = 1 << c
            load = 2 * miss ** (1 / least)  # a bin's smallest is another one with a chance under load / 2
            self.partitions.append(_Partition(least, 1 << max(0, math.ceil(-math.log2(load))), items))
        self._tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def needed(self, size: int) -> int:
        return max(1, math.ceil(self.threshold * size - 1e-9))

    @staticmethod
    def signature(sorted_hashes: np.ndarray, bins: int) -> np.ndarray:
        """The smallest hash of each of ``bins`` bins (a power of two) that has one."""
        _, first = np.unique(sorted_hashes & np.uint64(bins - 1), return_index=True)
        return sorted_hashes[first]

    def _table(self, p: int, size_class: int):
        """Sorted bin values of partition p's items for documents of that size, their items, and a filter on 16 bits."""
        if (p, size_class) not in self._tables:
            part = self.partitions[p]
            bins = part.bins_per_shingle << size_class
            signatures = [self.signature(self.shingles[i], bins) for i in part.items]
            values = np.concatenate(signatures)
            items = np.repeat(part.items, [len(s) for s in signatures])
            order = np.argsort(values, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[(values >> np.uint64(48)).astype(np.int64)] = True
            self._tables[p, size_class] = values[order], items[order], seen
        return self._tables[p, size_class]

    def search(self, text: str | None) -> list[tuple[int, int]]:
        """(item, number of its shingles that the text has) of each item with enough of them."""
        own = np.unique(shingles(words(text)))
        if not len(own):
            return []
        size_class, found = len(own).bit_length(), set()
        for p, part in enumerate(self.partitions):
            if len(own) < part.least:
                continue
            values, items, seen = self._table(p, size_class)
            probe = self.signature(own, part.bins_per_shingle << size_class)
            probe = probe[seen[(probe >> np.uint64(48)).astype(np.int64)]]
            lo, hi = np.searchsorted(values, probe), np.searchsorted(values, probe, "right")
            for a, b in zip(lo[hi > lo], hi[hi > lo]):
                found.update(items[a:b].tolist())
        hits = []
        for i in sorted(found):
            s = self.shingles[i]
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            shared = int((own[at] == s).sum())
            if shared >= self.needed(len(s)):
                hits.append((i, shared))
        return hits


def find_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, shared, size, containment: the items of which a document contains at least ``threshold``.

    Shingles are of five words (all words of an item that has fewer), size is the number of an item's distinct ones
    and shared how many of them the document has. Null, empty and wordless texts of either table match nothing.
    Texts of any length are read whole. Repeated item rows count once; repeated document rows each give their rows. Either table
    empty: no rows. Columns other than the ids and texts aren't read, so their names may be any.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    blocks = (_search(docs, ids, texts, threshold, kind) for ids, texts in _blocks(benchmark.select("item_id", "text")))
    first = next(blocks)
    second = next(blocks, None)
    return first if second is None else stored_parts(itertools.chain([first, second], blocks))


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of the distinct items in blocks of about ``BLOCK_BYTES``, of which the driver holds one or two at a time; at least one block."""
    items = items.filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64(*items.columns), F.lit(blocks)) == b).collect()
        yield [r[0] for r in rows], [r["text"] for r in rows]


def _search(docs: DataFrame, ids: list, texts: list[str], threshold: float, item_kind: str) -> DataFrame:
    index: list[ItemIndex] = []

    def run(batch):
        if not index:  # built once in each Python worker
            index.append(ItemIndex(texts, threshold))
        rows = [(k, i, n) for k, text in enumerate(batch) for i, n in index[0].search(text)]
        sizes = [len(index[0].shingles[i]) for _, i, _ in rows]
        return [k for k, _, _ in rows], {
            "item_id": [ids[i] for _, i, _ in rows], "shared": [n for _, _, n in rows], "size": sizes, "containment": [n / s for (_, _, n), s in zip(rows, sizes)],
        }

    return map_texts(docs, run, f"item_id {item_kind}, shared int, size int, containment double")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no item; see :func:`find_contaminated`.

    Rows go by their own text, so two rows with one doc_id can fare differently. Null texts stay. Without items all rows stay.
    """
    blocks = _blocks(benchmark.select("text"))
    (_, texts), second = next(blocks), next(blocks, None)
    if second is None:
        return _without(docs, texts, threshold)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("raw"))
    hits = stored_parts(_with_hit(hashed, t, threshold) for _, t in itertools.chain([(None, texts), second], blocks))
    # the row goes as one struct, so that no column of it can clash with those of the join
    rows = docs.select(F.col("doc_id").alias("own"), F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    return rows.join(hits.distinct(), F.expr("own <=> doc_id and hash = raw"), "left_anti").select("row.*")


def _with_hit(hashed: DataFrame, texts: list[str], threshold: float) -> DataFrame:
    """doc_id and raw of the rows of ``hashed`` (doc_id, text, raw) that contain one of ``texts``."""
    index: list[ItemIndex] = []

    def run(batch, raw):
        if not index:
            index.append(ItemIndex(texts, threshold))
        hit = [k for k, text in enumerate(batch) if index[0].search(text)]
        return hit, {"raw": [raw[k] for k in hit]}

    return map_texts(hashed, run, "raw bigint", more=("raw",))


def _without(docs: DataFrame, texts: list[str], threshold: float) -> DataFrame:
    at = docs.columns.index("text")
    index: list[ItemIndex] = []

    def run(batches):
        if not index:
            index.append(ItemIndex(texts, threshold))
        for batch in batches:
            yield batch.filter(pa.array([not index[0].search(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
