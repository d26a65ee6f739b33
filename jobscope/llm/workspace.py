"""Reading inputs; and the folder that all executors share, through which lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobscope.shipping import ship
from jobscope.storage import shared_folder, stored, stored_parts

__all__ = ["shared_folder", "stored", "stored_parts", "table"]

#: Bytes of a batch that goes to a Python worker at a time: batches are bounded by their texts and not by a number of rows alone.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    spark.conf.set(*BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
