"""Running aggregates and frames over a key's history of any length.

A key with more than ``CELL_ROWS`` rows is cut into cells: ranges of its order, of about equal size, made by Spark's range partitioning. Windows
run within cells, and what the cells before hand on (one row, or a few, for each cell) makes up the rest, so no task sorts a whole
history. Keys below that bound are one cell each and cost one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobscope.storage import stored

#: Rows of a key over which it is cut.
CELL_ROWS = 1_000_000

_ALL = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.coalesce(F.least(a, b), a, b)),
    "max": (F.max, lambda a, b: F.coalesce(F.greatest(a, b), a, b)),
}


def same(left: str, right: str, names: list[str]) -> Column:
    """Null-safe equality of columns of two aliased sides."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def cut(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, bool]:
    """(``df`` with ``_cell``, ascending in ``order`` within each key; whether any key was cut). Cell 0: a key that wasn't."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CELL_ROWS)
    if many.isEmpty():
        return df.withColumn("_cell", F.lit(0)), False
    many = stored(many)
    hot, total = many.select(*keys).alias("h"), many.agg(F.sum("_n")).first()[0]
    rows = df.alias("r")
    parts = rows.join(hot, same("r", "h", keys), "left_semi").repartitionByRange(-(-total // CELL_ROWS) + 1, *keys, *order)
    parts = stored(parts.withColumn("_cell", F.spark_partition_id() + 1))
    return rows.join(hot, same("r", "h", keys), "left_anti").withColumn("_cell", F.lit(0)).unionByName(parts), True


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, how: str, name: str, own: bool = True) -> DataFrame:
    """``df`` with ``name``: the ``how`` (sum, min or max) of ``value`` over the rows of the same keys up to each row (or before
    it, without ``own``) in ``order``. Null values don't count; null keys are a key."""
    fold: Callable[[Column], Column]
    fold, join = _ALL[how]
    celled, hot = cut(df.withColumn("_value", value), keys, order)
    within = W.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    rows = celled.withColumn("_within", fold(F.col("_value")).over(within))
    if not hot:
        return rows.withColumn(name, F.coalesce("_within", F.lit(0)) if how == "sum" else F.col("_within")).drop("_cell", "_value", "_within")
    before = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)  # over a row a cell
    cells = celled.filter("_cell > 0").groupBy(*keys, "_cell").agg(fold(F.col("_value")).alias("_all")).withColumn("_carry", fold(F.col("_all")).over(before)).drop("_all")
    met = rows.alias("r").join(cells.alias("c"), same("r", "c", [*keys, "_cell"]), "left").select("r.*", "_carry")
    return met.withColumn(name, join(F.col("_carry"), F.col("_within"))).drop("_cell", "_value", "_within", "_carry")


def with_past(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, name: str, own: bool = False) -> DataFrame:
    """``df`` with ``name``: the values, nulls left out, of the last ``n`` rows of the same keys before each row (with ``own``, up to it), in order.

    A cell gets the last ``n`` rows of the cells before it as a halo, which is dropped again.
    """
    celled, hot = cut(df, keys, order)
    celled = celled.withColumn("_halo", F.lit(False))
    if hot:
        tail = W.partitionBy(*keys, "_cell").orderBy(*[F.desc(c) for c in order])
        tails = celled.filter("_cell > 0").withColumn("_rn", F.row_number().over(tail)).filter(F.col("_rn") <= n)
        needs = list(dict.fromkeys([*order, value]))
        # n rows for each cell of a key, and a cell for each partition
        each = tails.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_cell", *needs))).alias("_t"), F.collect_set("_cell").alias("_cells"))
        halo = each.select(*keys, "_t", F.explode("_cells").alias("_cell")).withColumn("_t", F.expr("filter(_t, x -> x._cell < _cell)"))
        halo = halo.select(*keys, "_cell", F.explode(F.slice("_t", F.greatest(F.lit(1), F.size("_t") - n + 1), F.lit(n))).alias("_x"))
        halo = halo.select(*keys, "_cell", *[F.col(f"_x.{c}").alias(c) for c in needs if c not in keys], F.lit(True).alias("_halo"))
        celled = celled.unionByName(halo, allowMissingColumns=True)
    w = W.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(-n + int(own), int(own) - 1)
    return celled.withColumn(name, F.collect_list(value).over(w)).filter("not _halo").drop("_cell", "_halo")
