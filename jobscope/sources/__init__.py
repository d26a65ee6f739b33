"""Sources and sinks of telemetry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from jobscope.storage import stored

#: Fields of a job record that become columns; ``id`` and ``task_id`` are other names of job_id. Further fields go to ``extra``.
JOB_SCHEMA = """job_id string, status string, project string, signature string, description string, cmd string, cwd string,
extra_env map<string,string>, env_spec string, image string, priority string, node string, gpu_idx int, preferred_node string, require_node string,
submitted_at double, started_at double, finished_at double, est_vram_mb bigint, ram_mb bigint, cpu_cores bigint, current_vram_mb bigint,
current_ram_mb bigint, peak_vram_mb bigint, peak_ram_mb bigint, eta_seconds bigint, eta_source string, ckpt_dir string, ckpt_glob string,
resume_flag string, resume_locations array<struct<node:string,path:string,mtime:double,size:bigint>>, wait_for_files array<string>, result_dir string,
remote_pids array<bigint>, alive_pids array<bigint>, log_path string, parent_id string, retry_count int, scheduler_id string, origin string, submitted_by string, auto_adopted boolean,
slurm_job_id string, slurm_state string, last_block_reason string, probe_unknown_since double, probe_unknown_count int"""
EVENT_SCHEMA = "event_id string, ts timestamp, type string, job_id string, node string, payload string, _corrupt_record string"
_TIMES = ("submitted_at", "started_at", "finished_at", "probe_unknown_since")

#: What ends a line for a terminal program beside the line feed: carriage returns of progress bars, and Unicode's others.
LINE_END = "[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def read_jobs(spark: SparkSession, path: str, layout: str = "jsonl") -> DataFrame:
    """Job records: ``document`` (one JSON object with tasks[]; doesn't split, so for imports), ``jsonl`` or ``parquet``.

    Times of JSON are epoch seconds and become timestamps; unknown ones stay null. Ids are texts, whatever they were. Lists of files to
    wait for may be one text. Fields that JOB_SCHEMA doesn't know are in ``extra``, a map of names to JSON. A line that isn't a record
    gives no row.
    """
    if layout == "parquet":
        return spark.read.parquet(path)
    text = spark.read.text(path, wholetext=layout == "document")
    record = F.try_parse_json("value")
    if layout == "document":
        record = F.explode(F.try_variant_get(record, "$.tasks", "array<variant>"))
    jobs = text.select(record.alias("v")).filter(F.try_variant_get("v", "$", "map<string,variant>").isNotNull())
    schema = StructType.fromDDL(JOB_SCHEMA)
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    columns = []
    for f in schema:
        value = get(f.name, f.dataType.simpleString())
        if f.name == "job_id":
            value = F.coalesce(value, get("id", "string"), get("task_id", "string"))
        elif f.name == "wait_for_files":
            one = get(f.name, "string")
            value = F.coalesce(value, F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{f.name}", "variant")) == "STRING", F.array(one)))
        elif f.name in _TIMES:
            value = F.timestamp_seconds(value)
        columns.append(value.alias(f.name))
    known = [*schema.names, "id", "task_id"]
    extra = F.transform_values(F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, v: ~k.isin(*known)), lambda k, v: F.to_json(v))
    return jobs.select(*columns, extra.alias("extra"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSONL events of all rotated files that ``path`` (a glob) names; unreadable lines are kept in _corrupt_record."""
    return spark.read.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """signature, vram_mb, ram_mb, dur_s_ewma, last_seen, vram_samples, ram_samples from a JSON map whose values are numbers (old) or objects.

    An old number, or an object without samples, is its own first sample.
    """
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = text.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("signature", "v"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    vram, ram = F.coalesce(get("$.vram_mb", "bigint"), get("$", "bigint")), get("$.ram_mb", "bigint")
    samples = lambda name, value: F.coalesce(F.when(F.size(get(f"$.{name}", "array<bigint>")) > 0, get(f"$.{name}", "array<bigint>")), F.when(value.isNotNull(), F.array(value)))
    return rows.select(
        "signature", vram.alias("vram_mb"), ram.alias("ram_mb"), get("$.dur_s_ewma", "double").alias("dur_s_ewma"), F.timestamp_seconds(get("$.last_seen", "double")).alias("last_seen"),
        samples("vram_samples", vram).alias("vram_samples"), samples("ram_samples", ram).alias("ram_samples"),
    )


def read_log_lines(spark: SparkSession, path: str, job_id: str = r"([^/.]*)[^/]*$") -> DataFrame:
    """job_id, seq, line of log files: ``seq`` numbers a file's lines from 0; what ends a line is what ends one for a terminal program; a last empty line
    doesn't count. ``job_id``: a pattern whose first group finds the job's id in the file's path (by default its name without endings).

    Files are read in blocks, so one log of any size is many tasks' work (but for compressed ones, which don't split). Spark's reader cuts
    at line feeds, and a line that crosses into the next block is read where it starts; other line ends are cut inside. The pieces are written to
    the shared folder with numbers that ascend within a block, so that counts and numbers are of the same rows even if tasks run again; a
    block's lines are counted, and the counts of the blocks before it in its file (a row a block) give the offset.
    """
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", "\n").text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("bytes"))
    # a carriage return before the line feed is part of one line end
    pieces = text.withColumn("raw", F.octet_length("value") + 1).withColumn("bare", F.regexp_replace("value", r"\r\z", ""))
    cut = pieces.select("file", "block", "bytes", "raw", (F.octet_length("value") > F.octet_length("bare")).alias("cr"), F.posexplode(F.split("bare", LINE_END)).alias("at", "line"))
    rows = stored(cut.select("file", "block", "bytes", F.when(F.col("at") == 0, F.col("raw")).alias("raw"), ((F.col("at") > 0) & ~F.col("cr") & (F.col("line") == "")).alias("open"), "line", F.monotonically_increasing_id().alias("id")))
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("raw").alias("raw"), F.max("bytes").alias("bytes"))
    of_file = W.partitionBy("file")  # a row a block
    before = F.coalesce(F.sum("n").over(of_file.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # without a line feed at its end a file is a byte shorter than its lines; a byte order mark is no part of a line
    unended = F.pmod(F.col("bytes") - F.sum("raw").over(of_file), F.lit(3)) == 2
    ends = F.when(unended & F.lead("n").over(of_file.orderBy("block")).isNull(), F.col("last"))
    placed = rows.drop("bytes", "raw").join(blocks.select("file", "block", "first", before.alias("before"), ends.alias("end")), ["file", "block"])
    return placed.filter(~(F.col("open") & F.col("id").eqNullSafe(F.col("end")))).select(F.regexp_extract("file", job_id, 1).alias("job_id"), (F.col("before") + F.col("id") - F.col("first")).alias("seq"), "line")


def write_table(df: DataFrame, path: str, by_finish_date: bool = False, mode: str = "errorifexists") -> None:
    """Parquet; an archive goes in folders by date of finish."""
    if by_finish_date:
        df.withColumn("finish_date", F.to_date("finished_at")).write.mode(mode).partitionBy("finish_date").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines. What is written twice is there twice; see :func:`write_event_batch`."""
    events.write.mode("append").json(path)


def write_event_batch(events: DataFrame, path: str, batch: int | str) -> None:
    """Events as JSON lines in ``path``/batch=``batch``, put in place by one rename; a batch that is written again replaces what it wrote before.

    Everything is written to a hidden folder first, so readers see a batch whole or not at all, and a job that fails on its way leaves only what
    readers don't look at. An old version is set aside before the rename and removed after it.
    """
    spark = events.sparkSession
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    place, name = f"{path}/batch={batch}", uuid.uuid4().hex
    hidden, old = (jvm.Path(f"{path}/_{kind}-{batch}-{name}") for kind in ("new", "old"))
    final = jvm.Path(place)
    files = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    events.write.json(hidden.toString())
    replaced = files.exists(final) and files.rename(final, old)
    if not files.rename(hidden, final):
        raise OSError(f"{hidden.toString()} can't be renamed to {place}")
    if replaced:
        files.delete(old, True)


def stream_into_events(events: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a stream into an event log of batches (:func:`write_event_batch`): a batch that fails after writing and runs again is there once."""
    writer = events.writeStream.foreachBatch(lambda batch, n: write_event_batch(batch, path, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_event_batches(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """What :func:`write_event_batch` wrote, without the batches' numbers."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{path}/batch=*")


def write_stream(df: DataFrame, path: str, checkpoint: str, form: str = "parquet", once: bool = False) -> StreamingQuery:
    """Starts a stream into files, each row exactly once by the checkpoint; ``once`` takes what is there and ends."""
    writer = df.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
