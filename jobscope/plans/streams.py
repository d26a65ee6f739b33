"""Registered queries of the streaming operators: tables are replayed as files in several micro-batches, and what the stream told is the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope import streaming
from jobscope.plans.queries import _LINE_INLINE, _LINE_PAIR, _LINE_REMAINING, HIST, ORACLE_SQL, RUNS, Tables, _duck_latest, query
from jobscope.storage import new_folder, stored

#: Micro-batches of a replay, files of each, and partitions of its state: a state store each.
BATCHES, BATCH_FILES, STATE_PARTITIONS = 3, 4, 4
_STATE = {"spark.sql.shuffle.partitions": str(STATE_PARTITIONS), "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _replayed(t: Tables, df: DataFrame, order: str, *ends: DataFrame) -> DataFrame:
    """``df`` as a stream of ``BATCHES`` micro-batches in order of ``order``, and then one of each of ``ends``: a stream reads files in the order
    in which they were written."""
    folder = new_folder(t.spark)
    cut = stored(df.repartitionByRange(BATCHES, order).withColumn("_part", F.spark_partition_id()))
    for k in range(BATCHES):
        cut.filter(F.col("_part") == k).drop("_part").repartition(BATCH_FILES).write.mode("append").parquet(folder)
    for end in ends:
        end.select(df.columns).repartition(BATCH_FILES).write.mode("append").parquet(folder)
    return streaming.stream_events(t.spark, folder, df.schema, files_per_batch=BATCH_FILES)


def _told(t: Tables, build: Callable[[], DataFrame], mode: str = "append") -> DataFrame:
    """What the stream that ``build`` makes tells until its files are read, with ``_batch``, the micro-batch that told it."""
    old = {k: t.spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        t.spark.conf.set(k, v)
    try:
        df, out = build(), new_folder(t.spark)
        write = lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")
        stream = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", new_folder(t.spark)).trigger(availableNow=True).start()
        stream.awaitTermination()
        return t.spark.read.schema(df.schema.add("_batch", "long")).parquet(f"{out}/batch=*")
    finally:
        for k, v in old.items():
            t.spark.conf.unset(k) if v is None else t.spark.conf.set(k, v)


def _last_told(told: DataFrame, key: str) -> DataFrame:
    rest = [c for c in told.columns if c not in (key, "_batch")]
    return told.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(key, "r.*")


query("str3_live_peaks", "SELECT job_id, max(vram_mb) AS peak_vram_mb, max(ram_mb) AS peak_ram_mb FROM samples_v GROUP BY job_id")(lambda t: _last_told(_told(t, lambda: streaming.live_peaks(_replayed(t, t.samples, "ts")), "update"), "job_id"))
query("str4_live_progress", f"""SELECT job_id, r.v AS remaining_s, i.v AS inline_s, p.v.c AS current, p.v.t AS total FROM (SELECT DISTINCT job_id FROM log_v) LEFT JOIN ({_duck_latest(_LINE_REMAINING)}) r USING (job_id)
  LEFT JOIN ({_duck_latest(_LINE_INLINE)}) i USING (job_id) LEFT JOIN ({_duck_latest(_LINE_PAIR)}) p USING (job_id)""")(lambda t: _last_told(_told(t, lambda: streaming.live_progress(_replayed(t, t.log, "seq")), "update"), "job_id"))
query("str5_transition_monitor")(lambda t: _told(t, lambda: streaming.transition_monitor(_replayed(t, t.job_events, "event_id"), None)).drop("_batch").select("event_id", "job_id", "before", "after"))
query("str5_unknown_monitor")(lambda t: _told(t, lambda: streaming.unknown_monitor(_replayed(t, _probes(t), "event_id"))).drop("_batch"))
query("str7_debounce")(lambda t: _told(t, lambda: streaming.debounce(_replayed(t, t.job_events.select("event_id", "job_id", "ts"), "event_id"), 1800)).select("event_id", "job_id", "ts"))
query("str8_dedupe_events", "SELECT event_id, job_id, status FROM job_events_v")(lambda t: _told(t, lambda: streaming.dedupe_events(_replayed(t, _twice(t.job_events), "event_id"))).select("event_id", "job_id", "status"))
query("str9_enrich_as_known", f"""WITH v AS (SELECT signature, finished_at AS ts, max(vram_mb) AS vram_mb, max(ram_mb) AS ram_mb FROM ({RUNS}) GROUP BY ALL)
  SELECT j.job_id AS job_id, j.signature AS signature, v.vram_mb AS vram_mb, v.ram_mb AS ram_mb FROM jobs_v j ASOF LEFT JOIN v ON j.signature = v.signature AND j.submitted_at >= v.ts""")(lambda t: _told(t, lambda: _as_known(t)).select("job_id", "signature", "vram_mb", "ram_mb"))
query("str10_live_history", HIST)(lambda t: _last_told(_told(t, lambda: streaming.live_history(_replayed(t, t.runs().select("signature", "job_id", "finished_at", "status", "vram_mb", "ram_mb"), "job_id"))), "signature"))
query("str11_batch_done_alerts", "SELECT job_id % 5000 AS batch, count(*) AS jobs FROM jobs_v GROUP BY 1 HAVING bool_and(status IN ('done', 'failed'))")(lambda t: _told(t, lambda: streaming.batch_done_alerts(_replayed(t, _batches(t), "event_id"))).select("batch", "jobs"))

# the streams' batch twins have the same SQL
ORACLE_SQL["str5_transition_monitor"] = ORACLE_SQL["chk6_illegal_transitions"]
ORACLE_SQL["str5_unknown_monitor"] = f"SELECT * FROM ({ORACLE_SQL['chk7_unknown_spells']}) WHERE resolved IS NOT NULL"
ORACLE_SQL["str7_debounce"] = ORACLE_SQL["chk8_cooldown_filter"]


def _probes(t: Tables) -> DataFrame:
    return t.job_events.select("event_id", "job_id", "ts", F.when(F.col("status").isin("queued", "launching"), "unknown").otherwise("alive").alias("state"))


def _twice(events: DataFrame) -> DataFrame:
    """Every event and a copy of it, as a retry in another file or a log's rotation gives."""
    return events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")


def _as_known(t: Tables) -> DataFrame:
    """All jobs and all runs' peaks as versions; jobs far ahead move the watermark past all others at the end."""
    far = [t.spark.range(-4 * BATCH_FILES, 0).select(F.col("id").alias("event_id"), F.col("id").alias("job_id"), F.lit("end").alias("signature"), F.lit(day).cast("timestamp").alias("ts")) for day in ("2100-01-01", "2100-01-02")]
    jobs = t.jobs.select(F.col("job_id").alias("event_id"), "job_id", "signature", F.col("submitted_at").alias("ts"))
    versions = t.runs().groupBy("signature", F.col("finished_at").alias("ts")).agg(F.max("vram_mb").alias("vram_mb"), F.max("ram_mb").alias("ram_mb"))
    return streaming.enrich_as_known(_replayed(t, jobs, "ts", *far), _replayed(t, versions, "ts"), "20000 days").filter("job_id >= 0")


def _batches(t: Tables) -> DataFrame:
    """The jobs' statuses as events of batches of about three."""
    jobs = t.jobs.select(F.col("job_id").alias("event_id"), "job_id", F.col("submitted_at").alias("ts"), "status", (F.col("job_id") % 5000).alias("batch"))
    return jobs.join(jobs.groupBy("batch").agg(F.count(F.lit(1)).alias("batch_size")), "batch")
