"""Cutting lineage through the folder that all executors share, and other work on tables of known size."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode where the session names no folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"

#: Rows of a side that is sent to all tasks at a time.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share. A cluster must have it set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or LOCAL_FOLDER


def new_folder(spark: SparkSession) -> str:
    """The path of a folder, not made yet, in the shared one; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/jobscope-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    What comes back has no lineage, so a lost executor costs a re-read and not the work before it,
    and every later reader sees the same rows. The files go when the driver ends.
    """
    return stored_parts([df])


def stored_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """Like :func:`stored` of the union of ``parts`` (at least one), each of which is written before the next is made."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or new_folder(spark)
        df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def broadcast_blocks(df: DataFrame, *key: str) -> Iterator[DataFrame]:
    """``df`` in blocks of about ``BROADCAST_ROWS`` by a hash of ``key``, each marked for broadcast; nearly always one."""
    blocks = max(1, -(-df.count() // BROADCAST_ROWS))
    for b in range(blocks):
        yield F.broadcast(df if blocks == 1 else df.filter(F.pmod(F.xxhash64(*key), F.lit(blocks)) == b))
