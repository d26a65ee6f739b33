"""Best-fit packing of tokenized documents, after Martello and Toth's dominance reduction.

Executors tokenize; only the histogram of piece lengths (one row a length, at most ``capacity`` rows whatever the
corpus) comes to the driver. There the reduction fixes sets of lengths that provably dominate every alternative,
best fit packs the rest, and both work on counts, so the plan is a short list of (pattern of lengths, how often).
A piece finds its sequence and offset from its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import add_rank
from .workspace import stored

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), longest first

#: Characters whose classes all regex engines agree on. Texts of these that hold no added token's name are encoded by the
#: faster of two libraries that share the vocabulary; all others by the slower one, whose ids are the ones asked for.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏΑ-ΡА-я一-龥–—‘’“”…]*")


@functools.cache
def _encoders(json_path: str | None, ranks_path: str | None):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    added = re.compile("|".join(re.escape(t.content) for t in slow.get_added_tokens_decoder().values()) or r"(?!)")
    if json_path and not ranks_path:
        return slow, None, added
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return slow, tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def encode(text: str | None, json_path: str | None = None, ranks_path: str | None = None) -> list[int]:
    """The ids of a text in the byte-level vocabulary, no special tokens added; a null text has none.

    Where the text itself holds the name of an added token, such as an end mark, that is one id, as the library has it.
    """
    slow, fast, added = _encoders(json_path, ranks_path)
    if not text:
        return []
    if fast is not None and not added.search(text) and _PLAIN.fullmatch(text):
        return fast.encode_ordinary(text)
    return slow.encode(text, add_special_tokens=False).ids


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one with the remainder."""
    first = total % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def tokenized_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.array([*encode(text, json_path, ranks_path), end_id], dtype="<u4")
                for k, (start, n) in enumerate(cut_points(len(ids), capacity)):
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": pdf["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _fitting(counts: dict[int, int], s: int, room: int) -> int:
    """How many of the smallest other lengths fit in ``room`` together; 3 stands for 3 or more."""
    k = 0
    for z in sorted(counts):
        n = counts[z] - (z == s)
        take = min(n, room // z, 3 - k)
        k, room = k + take, room - take * z
        if take < n or k == 3:
            break
    return k


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Martello and Toth's reduction on length counts: the sets fixed, with how often, and the counts that stay.

    A set with length s can be fixed if it dominates every feasible set with s: {s} if nothing else fits; {s, t}, t the
    longest that fits, if no two others fit together, t fills up exactly, or t is at least any two that fit; {s, t, b},
    the fullest pair, if no three others fit and no two lengths over b fit together. What a condition needs stays
    true until a length of the set runs out, so each set is fixed as often as its counts allow.
    """
    counts, fixed = {s: n for s, n in counts.items() if n > 0}, []

    def fix(*lengths: int) -> None:
        need = Counter(lengths)
        times = min(counts[z] // m for z, m in need.items())
        fixed.append((tuple(sorted(need.items(), reverse=True)), times))
        for z, m in need.items():
            counts[z] -= m * times
            if not counts[z]:
                del counts[z]

    changed = True
    while changed:
        changed = False
        for s in sorted(counts, reverse=True):
            while s in counts:
                room = capacity - s
                k = _fitting(counts, s, room)
                if k == 0:
                    fix(*[s])
                else:
                    rest = sorted(z for z in counts if z <= room and counts[z] > (z == s))
                    t = rest[-1]
                    if k == 1 or t == room:
                        fix(s, t)
                    elif k == 2:
                        left = lambda z: counts[z] - (z == s)
                        pairs = [(a + b, a, b) for a in rest for b in [max((b for b in rest if b <= room - a and b <= a and (b < a or left(a) > 1)), default=0)] if b]
                        full, a, b = max(pairs)
                        over = [z for z in rest for _ in range(min(2, left(z))) if z > b][:2]
                        if t >= full:
                            fix(s, t)
                        elif a == t and (len(over) < 2 or sum(over) > room):
                            fix(s, a, b)
                        else:
                            break
                    else:
                        break
                changed = True
    return fixed, counts


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, on counts: each length goes where the least room is left over."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            room = min((r for r in open_ if r >= s), default=None)
            if room is None:
                room, group, bins = capacity, (), -(-n // (capacity // s))
            else:
                group, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            each = room // s
            for m, x in ((each, min(bins, n // each)), (n % each, 1)):
                if m and x and bins and (m == each or n < each):
                    open_.setdefault(room - m * s, []).append(((*group, (s, m)), x))
                    n, bins = n - m * x, bins - x
            if bins and room < capacity:
                open_.setdefault(room, []).append((group, bins))
    return [x for groups in open_.values() for x in groups]


def packing_plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length its segments in order of rank: rows of (first rank, first sequence, how many in a sequence, offset)."""
    fixed, rest = dominance_reduction(counts, capacity)
    segments: dict[int, list[tuple[int, int, int, int]]] = {s: [] for s in counts}
    used, sequence = Counter(), 0
    for pattern, times in fixed + best_fit_decreasing(rest, capacity):
        offset = 0
        for s, m in pattern:
            segments[s].append((used[s], sequence, m, offset))
            used[s] += m * times
            offset += m * s
        sequence += times
    return {s: np.array(x, dtype=np.int64) for s, x in segments.items()}


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...; stored) with sequence_id and offset."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = packing_plan(counts, capacity)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf.pop("length").to_numpy(), pdf.pop("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                first, base, each, start = plan[int(s)][np.searchsorted(plan[int(s)][:, 0], rank[at], "right") - 1].T
                sequence[at] = base + (rank[at] - first) // each
                offset[at] = start + (rank[at] - first) % each * s
            pdf["length"], pdf["sequence_id"], pdf["offset"] = length, sequence, offset
            yield pdf

    rest = [c for c in pieces.columns if c not in ("length", "sequence_id", "offset", "rank")]
    ranked = add_rank(pieces, "length", ["doc_id", "piece"], sum(counts.values())).select(*rest, "length", "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*rest).schema)
    return ranked.mapInPandas(place, f"{schema}, length long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is one piece, the end id alone. Repeated rows are packed once each. A text of any length is
    tokenized whole. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    packed = pack_pieces(stored(tokenized_pieces(docs, capacity, end_id, json_path, ranks_path)), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
