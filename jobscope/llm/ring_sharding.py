"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns ``virtual_nodes`` points of a ring of ``RING`` positions; a key hashes to a position and
belongs to the next point clockwise. Shards have a capacity, and the keys that overflow a full shard go on
clockwise to the next shard with room. At ``bound`` 1, the default, the capacity is the tightest there is: the row count over
the shard count, one more for the first shards where it doesn't divide, so shard counts differ by one at most. A larger
bound is a multiple of the mean. A point's place depends on its shard and its number there and on nothing else, so a shard that comes
only takes keys and one that goes only gives its own away; what moves besides is what overflows otherwise than before, which a larger bound makes rare.

Keys of an arc are exchangeable, so the clockwise walk needs only the key counts of the arcs (at most
``shards * virtual_nodes``, whatever the corpus): a fold over those counts gives for each arc a short list of
segments ``(first rank, shard, first slot)``, and every row finds its shard and slot from its rank in its arc.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import stored

#: Positions of the ring.
RING = 1 << 16

#: Cells of a position in which rows are counted and numbered, by their contents, and the most rows of one that isn't split.
CELLS, CELL_ROWS = 64, 500_000

#: Walks the arcs clockwise, twice at most: ``carry`` overflowing keys look for room, first come first placed.
_WALK = """
aggregate(
  arcs,
  named_struct('carry', 0L, 'done', 0L, 'room', room, 'takes', cast(array() as array<struct<pos: bigint, shard: int, slot: bigint>>)),
  (s, a) -> named_struct(
    'carry', s.carry + a.overflow - least(s.carry + a.overflow, s.room[a.shard]),
    'done', s.done + least(s.carry + a.overflow, s.room[a.shard]),
    'room', if(least(s.carry + a.overflow, s.room[a.shard]) = 0, s.room,
               transform(s.room, (r, i) -> if(i = a.shard, r - least(s.carry + a.overflow, r), r))),
    'takes', if(least(s.carry + a.overflow, s.room[a.shard]) = 0, s.takes,
                concat(s.takes, array(named_struct('pos', s.done, 'shard', a.shard, 'slot', caps[a.shard] - s.room[a.shard]))))
  ),
  s -> s.takes)
"""


def ring_cells(spark, shards: int, virtual_nodes: int) -> DataFrame:
    """One row for each position of the ring: pos, arc (number of its arc, clockwise), shard (its owner)."""
    shard, replica = (F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards)
    points = (
        spark.range(shards * virtual_nodes)
        .select(F.pmod(F.xxhash64(F.lit("point"), shard, replica), F.lit(RING)).alias("pos"), shard.alias("shard"))
        .groupBy("pos").agg(F.min("shard").alias("shard"))
    )
    w = W.orderBy("pos")
    arcs = points.select(
        "pos", "shard",
        F.row_number().over(w).alias("arc"),
        F.lag("pos", 1, -1).over(w).alias("after"),
        F.lead("pos").over(w).isNull().alias("is_last"),
    )
    own = arcs.select("arc", "shard", F.explode(F.sequence(F.col("after") + 1, F.col("pos"))).alias("pos"))
    # what lies beyond the last point belongs to the first one
    first = arcs.filter("arc = 1").select("arc", "shard", F.lit(1).alias("one"))
    beyond = arcs.filter(F.col("is_last") & (F.col("pos") < RING - 1)).select(F.lit(1).alias("one"), F.explode(F.sequence(F.col("pos") + 1, F.lit(RING - 1).cast("long"))).alias("pos"))
    return own.unionByName(beyond.join(F.broadcast(first), "one").select("arc", "shard", "pos"))


def _capacity(shard: Column, rows: int, shards: int, bound: float) -> Column:
    """Rows that a shard takes."""
    if bound > 1:
        return F.lit(math.ceil(bound * rows / shards)).cast("long")
    return (F.lit(rows // shards) + F.when(shard < rows % shards, 1).otherwise(0)).cast("long")


def _segments(cells: DataFrame, rows: int, shards: int, bound: float) -> DataFrame:
    """For each arc its segments, array<struct<first_rank, shard, slot>> in order of rank. ``cells``: pos, arc, shard, n."""
    cap = _capacity(F.col("shard"), rows, shards, bound)
    arcs = (
        cells.groupBy("arc").agg(F.min("shard").alias("shard"), F.sum("n").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("arc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("accepted", F.least("n", F.greatest(F.lit(0), cap - F.col("before"))))
        .withColumn("overflow", F.col("n") - F.col("accepted"))
        .withColumn("queued", F.coalesce(F.sum("overflow").over(W.orderBy("arc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )
    caps = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: _capacity(i, rows, shards, bound))
    held = F.map_from_entries(F.collect_list(F.struct("shard", "held")))
    walk = (
        arcs.groupBy("shard").agg(F.sum("accepted").alias("held"), F.collect_list(F.struct("arc", "shard", "overflow")).alias("arcs"))
        .agg(F.sort_array(F.flatten(F.collect_list("arcs"))).alias("once"), held.alias("held"))
        .withColumn("caps", caps)
        .withColumn("room", F.expr("transform(caps, (c, i) -> c - coalesce(held[cast(i as int)], 0L))"))
        .withColumn("arcs", F.expr("concat(once, transform(once, a -> named_struct('arc', a.arc, 'shard', a.shard, 'overflow', 0L)))"))
        .select(F.explode(F.expr(_WALK)).alias("t")).select("t.*")
    )
    # both the arcs' overflows and the takes cut the queue of overflowing keys; their cuts together are the segments
    cuts = (
        arcs.filter("overflow > 0").select(F.col("queued").alias("pos"), F.struct("queued", "arc", "accepted").alias("a"), F.lit(None).cast("struct<pos: bigint, shard: int, slot: bigint>").alias("t"))
        .unionByName(walk.select("pos", F.lit(None).cast("struct<queued: bigint, arc: int, accepted: bigint>").alias("a"), F.struct("pos", "shard", "slot").alias("t")))
        .groupBy("pos").agg(F.max("a").alias("a"), F.max("t").alias("t"))
    )
    so_far = W.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    spilled = cuts.select("pos", F.last("a", ignorenulls=True).over(so_far).alias("a"), F.last("t", ignorenulls=True).over(so_far).alias("t")).select(
        F.col("a.arc").alias("arc"),
        (F.col("a.accepted") + F.col("pos") - F.col("a.queued")).alias("first_rank"),
        F.col("t.shard").alias("shard"),
        (F.col("t.slot") + F.col("pos") - F.col("t.pos")).alias("slot"),
    )
    home = arcs.filter("accepted > 0").select("arc", F.lit(0).cast("long").alias("first_rank"), "shard", F.col("before").alias("slot"))
    return home.unionByName(spilled).groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("first_rank", "shard", "slot"))).alias("segments"))


def _counted(placed: DataFrame) -> DataFrame:
    return stored(placed.groupBy("_pos", "_cell").agg(F.count(F.lit(1)).alias("n")))


def assign_shards(df: DataFrame, key: str, shards: int = 40, virtual_nodes: int = 64, bound: float = 1.0) -> DataFrame:
    """``df`` with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard).

    Shard counts differ by one at most, or, with a ``bound`` over 1, are at most that multiple of their mean (rounded up). A null key hashes like any other value. Repeated rows each get a slot
    of their own; rows with the same key and content are interchangeable. An empty table gives no rows.
    Columns other than ``key`` pass through, except that an input's own ``shard``, ``slot`` or ``_``-prefixed
    working columns are replaced. The table is stored once, so pass only the columns you need.

    A position's rows are numbered in cells of their contents, so many rows with one key (or none) are many tasks' work, and
    a cell of more than ``CELL_ROWS`` rows, which equal rows make, is split further.
    """
    rest = [c for c in df.columns if c not in ("shard", "slot", "_pos", "_cell", "_row")]
    content = [F.col(c) for c, kind in df.dtypes if c in rest and not kind.startswith(("map", "struct", "array", "variant"))]
    placed = stored(df.select(*rest, F.pmod(F.xxhash64(F.col(key)), F.lit(RING)).alias("_pos"), F.pmod(F.xxhash64(*content), F.lit(CELLS)).alias("_cell"), F.monotonically_increasing_id().alias("_row")))
    counts = _counted(placed)
    crowded = counts.filter(F.col("n") > CELL_ROWS)
    if not crowded.isEmpty():
        parts = F.broadcast(crowded.select("_pos", "_cell", F.ceil(F.col("n") / CELL_ROWS).alias("_parts")))  # bounded: rows / CELL_ROWS
        split = F.coalesce(F.col("_cell") + CELLS * F.pmod(F.xxhash64("_row"), F.col("_parts")), F.col("_cell"))
        placed = stored(placed.join(parts, ["_pos", "_cell"], "left").withColumn("_cell", split).drop("_parts"))
        counts = _counted(placed)
    ring = ring_cells(df.sparkSession, shards, virtual_nodes)
    cells = stored(ring.join(counts.groupBy(F.col("_pos").alias("pos")).agg(F.sum("n").alias("n")), "pos", "left").fillna(0, ["n"]))
    rows = cells.agg(F.sum("n")).first()[0]
    before = F.coalesce(F.sum("n").over(W.partitionBy("arc").orderBy("_pos", "_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.join(cells.select(F.col("pos").alias("_pos"), "arc"), "_pos").withColumn("_before", before)
    plan = stored(offsets.join(_segments(cells, rows, shards, bound), "arc").select("_pos", "_cell", "_before", F.col("segments").alias("_segments")))
    return (
        placed.withColumn("_rn", F.row_number().over(W.partitionBy("_pos", "_cell").orderBy(F.xxhash64(F.col(key)), *content, "_row")))
        .join(plan, ["_pos", "_cell"])
        .withColumn("_rank", F.col("_before") + F.col("_rn") - 1)
        .withColumn("_seg", F.expr("element_at(filter(_segments, s -> s.first_rank <= _rank), -1)"))
        .select(*rest, F.col("_seg.shard").alias("shard"), (F.col("_seg.slot") + F.col("_rank") - F.col("_seg.first_rank")).alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 40, virtual_nodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; law is ``rows``.

    size: UTF-8 bytes of the text (null: none) plus 16; text_crc32: unsigned, of the UTF-8 bytes (null: of none). A null text is
    sharded like an empty one, a null doc_id like any other key; repeated rows each get a slot; texts of any length are read whole, but only their
    sizes and checksums go on. An empty table gives no rows. Columns other than doc_id and text aren't read, so their names may be any.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(slim, "doc_id", shards, virtual_nodes).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
