"""Gapless ranks within keys of any size, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one cell of a key holds on average at most, and the least number of cells of a key.
CELL_ROWS, LEAST_CELLS = 500_000, 64


def cells_for(rows: int) -> int:
    return max(LEAST_CELLS, -(-rows // CELL_ROWS))


def add_rank(df: DataFrame, key: str, order: list[str], rows: int, rank: str = "rank") -> DataFrame:
    """``df`` (which should be stored) with a column ``rank``, 0, 1, 2, ... within each value of ``key``.

    Each key is split by a hash of the ``order`` columns into cells; a window numbers the rows of a cell,
    and the counts of the cells before it (one row a cell) give its offset. A key with a third of all
    rows is therefore numbered by many tasks. Rows equal in all ``order`` columns share a cell and get
    different ranks in any order.
    """
    cell: Column = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(cells_for(rows))).cast("int")
    celled = df.withColumn("_cell", cell)
    offsets = (
        celled.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select(key, "_cell", "_before")
    )
    numbered = celled.withColumn("_rn", F.row_number().over(W.partitionBy(key, "_cell").orderBy(*order)))
    return (
        numbered.join(offsets, [key, "_cell"])
        .withColumn(rank, F.col("_before") + F.col("_rn").cast("long") - 1)
        .drop("_cell", "_before", "_rn")
    )
