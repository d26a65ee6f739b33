"""Alignment of two tokenizers over the same texts, by merge-path partitioning.

A text's tokens end at byte offsets, one ascending list for tokenizer A and one for B. Merging both lists walks from overlap to
overlap: between two ends that follow each other one A token and one B token cover the same bytes. Diagonals of the merge
matrix cut the walk into pieces of equal work; a binary search on each diagonal says where it crosses the walk, so
pieces need nothing from each other, however long a text is or however many short ones lie in a batch. Pieces emit their
overlaps, and stitching them in order gives the groups: an overlap that ends where both tokens end closes one, wherever the pieces' borders are.

Links are the pairs of A and B tokens within a group. How many documents hold an id pair linked is counted over the corpus from each
document's distinct pairs; counts over one come back to the documents in blocks of a bounded size.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .packing import _PLAIN
from .words import in_steps, lists, map_texts
from .workspace import stored, stored_parts

#: Steps of the merge in a piece.
PIECE_STEPS = 16_384
#: Characters of texts that are worked on at a time (a longer text is alone), and links that are spread out at a time.
STEP_CHARS, STEP_LINKS = 1 << 20, 1 << 20
#: Links of a group over which its distinct ids are paired and not its tokens.
GROUP_LINKS = 4096
#: Counted pairs that are sent to the tasks at a time.
PAIR_ROWS = 2_000_000


class ByteTable:
    """Byte strings by number, laid out so that the strings of many numbers are gathered at once."""

    def __init__(self, values: list[bytes]):
        self.length = np.array([len(v) for v in values], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(values) or b"\0", np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str, ranks_path: str | None):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True  # their strings in a text are plain text
        self.fast = None
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = _byte_characters()
        a, size = self.slow.get_vocab(with_added_tokens=True), self.slow.get_vocab_size(with_added_tokens=True)
        token = {i: t for t, i in a.items()}
        self.a_bytes = ByteTable([bytes(of[c] for c in token.get(i, "")) for i in range(max(size, max(token) + 1))])
        b = self.pieces
        self.b_bytes = ByteTable([bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())])
        self.a_size, self.b_size = len(self.a_bytes.length), len(self.b_bytes.length)
        #: decimal digits of an id and room for what follows it
        self.digits = ByteTable([b"%d," % i for i in range(max(self.a_size, self.b_size))])

    def a_ids(self, text: str) -> np.ndarray:
        text = " " + text
        if self.fast is not None and _PLAIN.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), np.int64)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def b_ids(self, text: str) -> np.ndarray:
        return np.array(self.pieces.encode(text, num_threads=1), np.int64)


@functools.cache
def tokenizers(a_path: str | None = None, b_path: str | None = None) -> Tokenizers:
    """The public ones unless paths are given; A's faster twin is used only where it is known to share the vocabulary."""
    import public_tokenizers as P

    return Tokenizers(a_path or P.path("byte_bpe_50k.json"), b_path or P.path("piece_bpe_32k.model"), None if a_path else P.path("byte_bpe_50k.tiktoken"))


def path_crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal d how many of the first d merged elements are from ``a`` (which goes first where both are equal)."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (low < high).any():
        open_ = low < high
        mid = (low + high) // 2
        goes = np.zeros(len(low), bool)
        goes[open_] = a[mid[open_]] <= b[diagonals[open_] - mid[open_] - 1]
        low, high = np.where(open_ & goes, mid + 1, low), np.where(open_ & ~goes, mid, high)
    return low


def piece_overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, whether both end there) of the overlaps that end in the piece a[i0:i1], b[j0:j1], in order.

    Reads one element of either list beyond the piece, so that an end that both have is seen where a border parts the two.
    """
    own_a, own_b = a[i0:i1], b[j0:j1]
    j = j0 + np.searchsorted(own_b, own_a)
    i = i0 + np.searchsorted(own_a, own_b)
    closed = np.zeros(len(own_a), bool)
    inside = j < len(b)
    closed[inside] = b[j[inside]] == own_a[inside]
    again = np.zeros(len(own_b), bool)  # the A token that ends there has told this overlap
    inside = i < i1
    again[inside] = a[i[inside]] == own_b[inside]
    at_a, at_b = np.arange(len(own_a)) + j - j0, np.arange(len(own_b)) + i - i0 + again  # a B end comes after the A end that it equals
    if len(own_b) and i0 and a[i0 - 1] == own_b[0]:
        again[0] = True
    first, second, last = (np.zeros(len(own_a) + len(own_b), t) for t in (np.int64, np.int64, bool))
    keep = np.ones(len(first), bool)
    first[at_a], second[at_a], last[at_a] = np.arange(i0, i1), j, closed
    first[at_b], second[at_b], keep[at_b] = i, np.arange(j0, j1), ~again
    return first[keep], second[keep], last[keep]


def aligned_groups(a: np.ndarray, b: np.ndarray, piece_steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the groups' A tokens, of their B tokens) for token ends ``a`` and ``b``, both strictly ascending with one last end."""
    steps = len(a) + len(b)
    diagonals = np.append(np.arange(0, steps, piece_steps), steps)
    i = path_crossings(a, b, diagonals)
    j = diagonals - i
    pieces = [piece_overlaps(a, b, i[p], i[p + 1], j[p], j[p + 1]) for p in range(len(diagonals) - 1)]
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, second, last = (np.concatenate(x) for x in zip(*pieces))
    return first[last] + 1, second[last] + 1


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def linked_pairs(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, owner: np.ndarray, b_size: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct owner * ``pairs`` + A id * ``b_size`` + B id of all links, in order, and how many links each has.

    ``owner``: of each group. Groups of many links give the pairs of their distinct ids with the products of how often they occur.
    """
    a0, b0 = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    n_a, n_b = a_ends - a0, b_ends - b0
    links = n_a * n_b
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    small = np.flatnonzero(links <= GROUP_LINKS)
    cut = np.searchsorted(np.cumsum(links[small]), np.arange(STEP_LINKS, links[small].sum() + STEP_LINKS, STEP_LINKS), "right") if len(small) else []
    for g in np.split(small, np.unique(cut)) if len(small) else []:
        n = links[g]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(n_b[g], n)
        key = np.repeat(owner[g] * pairs, n) + a_ids[np.repeat(a0[g], n) + k // np.maximum(width, 1)] * b_size + b_ids[np.repeat(b0[g], n) + k % np.maximum(width, 1)]
        found, times = np.unique(key, return_counts=True)
        keys.append(found)
        counts.append(times)
    for g in np.flatnonzero(links > GROUP_LINKS):
        (x, nx), (y, ny) = np.unique(a_ids[a0[g] : a_ends[g]], return_counts=True), np.unique(b_ids[b0[g] : b_ends[g]], return_counts=True)
        step = max(1, STEP_LINKS // len(y))
        for at in range(0, len(x), step):
            keys.append((owner[g] * pairs + x[at : at + step, None] * b_size + y).reshape(-1))
            counts.append((nx[at : at + step, None] * ny).reshape(-1))
    return _summed(keys, counts)


def _digests(t: Tokenizers, a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, groups_end: np.ndarray) -> list[str]:
    """sha256 of each text's ``a1,a2|b1;a3|b2,b3``; ``groups_end``: the last group (exclusive) of each text, in order."""
    a0, b0 = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    g_a, g_b = np.repeat(np.arange(len(a_ends)), a_ends - a0), np.repeat(np.arange(len(b_ends)), b_ends - b0)
    ids = np.zeros(len(a_ids) + len(b_ids), np.int64)
    ids[np.arange(len(a_ids)) + b0[g_a]], ids[np.arange(len(b_ids)) + a_ends[g_b]] = a_ids, b_ids
    text, after = t.digits.join(ids).copy(), np.cumsum(t.digits.length[ids])
    text[after[a_ends + b0 - 1] - 1] = ord("|")
    text[after[a_ends + b_ends - 1] - 1] = ord(";")
    ends = after[a_ends[groups_end - 1] + b_ends[groups_end - 1] - 1]
    return [hashlib.sha256(text[s : e - 1].tobytes()).hexdigest() for s, e in zip(np.append(0, ends[:-1]), ends)]


def align(texts: list[str | None], t: Tokenizers, piece_steps: int = PIECE_STEPS) -> dict[str, list | np.ndarray]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct, as A id * B's size + B id) and times of each text."""
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    none = np.zeros(0, np.int64)
    digests, pairs, times = [""] * n, [none] * n, [none] * n
    kept, a_ids, b_ids, raw = [], [], [], []
    for k, text in enumerate(texts):
        if text:
            x, y = t.a_ids(text), t.b_ids(text)
            want = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass"), np.uint8)
            if all(table.length[ids].sum() == len(want) and (table.join(ids) == want).all() for table, ids in ((t.a_bytes, x), (t.b_bytes, y))):
                kept.append(k)
                a_ids.append(x)
                b_ids.append(y)
                raw.append(len(want))
    if kept:
        n_a, n_b = np.array([len(x) for x in a_ids]), np.array([len(y) for y in b_ids])
        a, b, whole = np.concatenate(a_ids), np.concatenate(b_ids), t.a_size * t.b_size
        # texts lie one after the other, and each one's end is an end in both lists
        a_ends, b_ends = aligned_groups(np.cumsum(t.a_bytes.length[a]), np.cumsum(t.b_bytes.length[b]), piece_steps)
        groups_end = np.searchsorted(a_ends, np.cumsum(n_a), "right")
        owner = np.searchsorted(groups_end, np.arange(len(a_ends)), "right")
        links = np.diff(a_ends, prepend=0) * np.diff(b_ends, prepend=0)
        keys, counts = linked_pairs(a, b, a_ends, b_ends, owner, t.b_size, whole)
        cuts = np.searchsorted(keys, np.arange(1, len(kept)) * whole)
        for column, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", np.diff(groups_end, prepend=0)), ("n_links", np.bincount(owner, weights=links, minlength=len(kept)).astype(np.int64))):
            out[column][kept] = values
        for k, digest, p, c in zip(kept, _digests(t, a, b, a_ends, b_ends, groups_end), np.split(keys % whole, cuts), np.split(counts, cuts)):
            digests[k], pairs[k], times[k] = digest, p, c
    return {**out, "groups_sha256": digests, "pairs": pairs, "times": times}


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of every row: what each text says by itself."""
    t = tokenizers(a_path, b_path)
    kind, width = (pa.int32(), "int") if t.a_size * t.b_size < 1 << 31 else (pa.int64(), "bigint")

    def run(texts):
        t = tokenizers(a_path, b_path)
        found = [align(part, t) for part in in_steps(texts, STEP_CHARS)]
        made = {c: np.concatenate([f[c] for f in found]) for c in ("n_a", "n_b", "n_groups", "n_links")}
        flat = {c: [x for f in found for x in f[c]] for c in ("groups_sha256", "pairs", "times")}
        return range(len(texts)), {**made, "groups_sha256": flat["groups_sha256"], "pairs": lists(flat["pairs"], kind), "times": lists(flat["times"], pa.int32())}

    return map_texts(docs, run, f"n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<{width}>, times array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n: how many rows of ``found`` (pairs: distinct ones of a row) hold each pair."""
    return found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _add_counts(found: DataFrame, often: pa.Table, best: np.ndarray, b_size: int, block: int, blocks: int) -> DataFrame:
    """``found`` without pairs and times, with n_best and count_sum over the pairs of one block; a pair that ``often`` doesn't have counts one."""
    order = np.argsort(pairs := often.column("pair").to_numpy().astype(np.int64))
    sent = found.sparkSession.sparkContext.broadcast((pairs[order], often.column("n").to_numpy()[order], best))  # bounded: about PAIR_ROWS and a row an A id
    names = [c for c in found.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = sent.value
        for batch in batches:
            column, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            pair, row = column.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())
            if blocks > 1:
                mine = pair % blocks == block
                pair, row, times = pair[mine], row[mine], times[mine]
            n = np.ones(len(pair), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                n = np.where(known[at] == pair, counts[at], 1)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row, np.where(n == best[pair // b_size], times, 0))
            np.add.at(sums[1], row, n * times)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, sums)], [*names, "n_best", "count_sum"])

    kept = found.select(*names).schema
    return found.mapInArrow(run, StructType([*kept.fields, *StructType.fromDDL("n_best bigint, count_sum bigint").fields]))


def align_tokenizers(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    n_best counts the links whose id pair is held by as many rows as any pair of its A id is; count_sum adds up how many rows hold each link's
    pair. Null and empty texts, and those that either tokenizer doesn't give back byte for byte, have zeros and ''. Texts are read whole;
    a repeated row counts as one more document. An empty table gives no rows. Columns other than doc_id and text aren't read.
    """
    t = tokenizers(a_path, b_path)
    found = stored(aligned(docs, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(found))
    best = np.zeros(t.a_size, np.int64)
    top = counts.groupBy((F.col("pair") / t.b_size).cast("int").alias("a")).agg(F.max("n").alias("n")).toArrow()  # at most a row an A id
    best[top.column("a").to_numpy()] = top.column("n").to_numpy()
    often = counts.filter("n > 1")
    blocks = max(1, -(-often.count() // PAIR_ROWS))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def part(b: int) -> DataFrame:
        mine = often if blocks == 1 else often.filter(F.col("pair") % blocks == b)
        return _add_counts(found, mine.toArrow(), best, t.b_size, b, blocks)

    if blocks == 1:
        return part(0).select(*columns)
    sums = stored_parts(part(b).select("_row", "n_best", "count_sum") for b in range(blocks))
    return found.drop("pairs", "times").join(sums.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "_row").select(*columns)
