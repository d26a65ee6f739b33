"""Words, 64-bit hashes and word shingles, for use inside tasks; and the map over texts that all operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

WORD = re.compile(r"\w+")
SHINGLE_WORDS = 5

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_CHUNK = 512


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer on an array of uint64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when it holds ``limit`` words, so its memory is bounded."""

    def __init__(self, limit: int = 1 << 18):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), dtype=_U, count=len(found))


def shingles(found: list[str], n: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order and with repeats; of all words if there are fewer; none of none."""
    if not found:
        return np.empty(0, _U)
    h, n = word_hashes(found), min(n, len(found))
    out = np.full(len(h) - n + 1, n, _U)
    for k in range(n):
        out = out * _U(_STEP) + h[k : len(h) - n + 1 + k]
    return mix(out)


def map_texts(df: DataFrame, fn: Callable[[list[str | None]], tuple[list[int] | np.ndarray, dict[str, Any]]], schema: str, id_column: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """Rows made from texts: ``fn`` gets a list of texts (and of the columns in ``more``) and returns, for each row
    that it makes, the index of its text, and the columns of those rows.

    The id passes through in its own type, nulls included; columns other than these aren't read.
    """
    kind = df.schema[id_column].dataType
    out = StructType.fromDDL(schema)
    names, kinds = out.names, [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                index, columns = fn(*[part.column(i).to_pylist() for i in range(1, part.num_columns)])
                ids = part.column(0).take(pa.array(index, pa.int64()))
                made = [x if isinstance(x := columns[n], pa.Array) else pa.array(x, k) for n, k in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays([ids, *made], [id_column, *names])

    return df.select(id_column, "text", *more).mapInArrow(run, StructType([*StructType().add(id_column, kind).fields, *out.fields]))


def in_steps(texts: list[str | None], chars: int) -> Iterator[list[str | None]]:
    """``texts`` in runs of about ``chars`` characters at most; a longer text is alone."""
    part, n = [], 0
    for text in texts:
        if part and n + len(text or "") > chars:
            yield part
            part, n = [], 0
        part.append(text)
        n += len(text or "")
    yield part


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from arrays."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
