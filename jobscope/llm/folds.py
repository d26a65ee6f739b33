"""Which rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import stored


def fold(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; of the empty text for a null id."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5


def held_out(id_column: str = "doc_id") -> Column:
    return fold(id_column) == 0


def share_picked(value: Column, share: float) -> Column:
    """True for about ``share`` of all values, picked by a hash."""
    return F.pmod(F.xxhash64(F.lit("fit"), value), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)


def bounded(id_column: str, rows: int, bound: int) -> Column:
    """True for about ``bound`` of ``rows`` rows (all, if there are no more), picked by a hash of the id."""
    return share_picked(F.col(id_column), bound / max(1, rows))


def labelled_sample(docs: DataFrame, marks: DataFrame, mark: str, max_rows: int, max_chars: int, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, ``mark`` and ``more`` of distinct documents that ``marks`` (doc_id, ``mark``; one row an id) knows: of
    those with a positive mark, and of the others, about ``max_rows`` and ``max_chars`` characters at most.

    Rows with one doc_id and one text count as one, so an id or a text that many rows repeat doesn't swell the sample.
    Texts aren't shuffled to find it (but for those of repeated rows): only their hashes and lengths are, and the sample is
    broadcast, which is bounded.
    """
    named = F.xxhash64("doc_id", "text")
    slim = docs.select("doc_id", named.alias("_h"), F.length("text").alias("_chars")).join(marks, "doc_id")
    found = stored(slim.groupBy("doc_id", "_h", mark).agg(F.max("_chars").alias("_chars"), F.count(F.lit(1)).alias("_n")))
    positive, keep = F.col(mark) > 0, F.lit(False)
    for r in found.groupBy(positive.alias("positive")).agg(F.count(F.lit(1)).alias("n"), F.sum("_chars").alias("chars")).collect():  # two rows
        share = min(max_rows / r["n"], max_chars / max(1, r["chars"] or 0))
        keep = keep | ((positive == r["positive"]) & share_picked(F.col("_h"), share))
    sample = found.filter(keep).select("doc_id", "_h", mark, "_n")
    texts = docs.select("doc_id", "text", *more, named.alias("_h"))
    once = texts.join(F.broadcast(sample.filter("_n = 1")), ["doc_id", "_h"]).select("doc_id", "text", mark, *more)
    again = sample.filter("_n > 1")
    if again.isEmpty():
        return once
    repeated = texts.join(F.broadcast(again), ["doc_id", "_h"]).groupBy("doc_id", "text", mark).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in more]).drop("_n")
    return once.unionByName(repeated)
