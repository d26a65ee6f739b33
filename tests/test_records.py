"""Records as the library's own readers give them, with ids that are texts, through every operator and stream."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from jobscope import sources, streaming
from jobscope.operators import capacity, failures, history, integrity, logs, views

T0 = 1_700_000_000
STATUSES = ["done", "failed", "running", "queued", "launching", "evicted"]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("records")
    tasks = []
    for i in range(36):
        status = STATUSES[i % 6]
        tasks.append({
            "id": f"t{i:02d}", "status": status, "project": f"P{i % 2}", "signature": f"P{i % 2}/net/{i % 3}", "description": f"net {i % 3} seed={i}", "cmd": f"python train.py --seed {i} --max_iters {100 + i % 3}", "cwd": "/w",
            "extra_env": {"A": str(i % 2)}, "priority": ["high", "normal", "low"][i % 3], "node": f"n{i % 3}", "gpu_idx": i % 2, "submitted_at": T0 + 100 * i, "started_at": T0 + 100 * i + 10, "finished_at": T0 + 100 * i + (500 if i % 12 < 6 else 5000) if status in ("done", "failed") else None,
            "est_vram_mb": 1000 * (i % 4), "ram_mb": 500, "cpu_cores": 1 + i % 4, "peak_vram_mb": 100 * i, "peak_ram_mb": 10 * i, "eta_seconds": 1000 * i, "ckpt_dir": f"/ckpt/{i % 4}", "wait_for_files": [f"/ckpt/{i % 4}/a.pt"] if i % 2 else "/ckpt/0/a.pt", "remote_pids": [i, i + 100], "parent_id": f"t{i - 6:02d}" if i >= 6 else None, "retry_count": i % 4, "scheduler_id": "me" if i % 2 else "you",
        })
    (folder / "queue.json").write_text(json.dumps({"tasks": tasks, "next_id": 99}))
    events = [{"event_id": f"e{i:03d}", "ts": datetime.datetime.fromtimestamp(T0 + 7 * i, datetime.UTC).isoformat(), "type": ["task_migrated", "queued", "launching", "running", "done"][i % 5], "job_id": f"t{i % 6:02d}", "node": f"n{i % 3}", "payload": "{}"} for i in range(120)]
    (folder / "ev").mkdir()
    for k in range(3):
        (folder / "ev" / f"watcher.log.{k}").write_text("\n".join(map(json.dumps, events[40 * k : 40 * k + 40])) + "\n")
    (folder / "logs").mkdir()
    for i in range(6):
        (folder / "logs" / f"t{i:02d}.log").write_text("12/97 [00:42<03:21, 12.34it/s]\rIter 40 | x\nRuntimeError: CUDA out of memory\n")
    return folder


@pytest.fixture(scope="module")
def jobs(spark, records):
    jobs = sources.read_jobs(spark, str(records / "queue.json"), "document")
    return jobs.withColumn("dur_s", F.unix_timestamp("finished_at") - F.unix_timestamp("started_at"))


def some(df, key="job_id", kind="string"):
    rows = df.collect()
    assert rows and dict(df.dtypes).get(key, kind) == kind
    return rows


def test_batch_operators(spark, records, jobs):
    events = sources.read_events(spark, str(records / "ev" / "*"))
    log = sources.read_log_lines(spark, str(records / "logs" / "*.log"))
    now = F.timestamp_seconds(F.lit(T0 + 9000))
    runs = jobs.filter("finished_at is not null").withColumn("vram_mb", F.col("peak_vram_mb")).withColumn("ram_mb", F.col("peak_ram_mb"))
    hist = history.duration_ewma(runs)
    files = spark.createDataFrame([("/ckpt/0", "/ckpt/0/a.pt", 1, False, 5), ("/ckpt/1", "/ckpt/1/a.bin", 2, False, 5)], "dir string, path string, mtime long, is_dir boolean, size long")
    keyed = jobs.withColumn("runtime_key", integrity.runtime_key(jobs))
    audited = jobs.withColumn("forces_cpu", F.lit(True)).withColumn("justification", F.lit("short"))
    for df in (
        views.status_view(jobs, "running"), views.search(jobs, "net"), views.match_signature(jobs, "P0/*"), views.pick_jobs(jobs, ["t00", "t01"]), views.by_lifetime(jobs, 100, None, "failed"), views.queue_head(jobs, 2), views.eta_sort_seconds(jobs, hist, now),
        views.eta_display(jobs, hist, now), views.split_retention(jobs, now + F.expr("interval 9 days"))[0], views.tail_lines(log, 1), *(views.sort_jobs(jobs.withColumn("eta_sort", F.col("eta_seconds")), key, now, limit=5) for key in ("id", "status", "priority", "runtime", "vram", "eta")),
        logs.bar_remaining(log), logs.progress_pairs(log), logs.progress(log, jobs), logs.estimate_eta(log, jobs, hist, now), logs.project_runtime(log, jobs, now), logs.total_from_command(jobs), logs.extract_flags(jobs), logs.seed_pending_eta(jobs.drop("eta_seconds", "eta_source").withColumns({"eta_seconds": F.lit(None).cast("bigint"), "eta_source": F.lit(None).cast("string"), "runtime_key": F.lit("k")}), spark.createDataFrame([("k", 5)], "runtime_key string, total_s long"), hist),
        history.walltime(keyed.withColumn("total_s", F.col("dur_s")).filter("dur_s is not null"), hist, keyed), history.estimate_resources(jobs, runs), history.estimate_as_of(jobs, runs), history.legacy_seed(runs.select("signature", "job_id", "finished_at", "vram_mb", "ram_mb", "dur_s"), spark.createDataFrame([("old", 5)], "signature string, vram_mb long")),
        integrity.ckpt_conflicts(jobs), integrity.ckpt_overlap_history(jobs), integrity.ckpt_overlaps(jobs), integrity.retry_lineage(jobs), integrity.lineage(jobs), integrity.artifact_gate(jobs, files), integrity.producers_of_blocked(jobs, files), integrity.nearest_runtime(jobs, runs),
        failures.classify_failure(jobs, log), failures.diagnose_terminal(jobs.filter("status in ('done', 'failed')"), log), failures.submission_audit(audited), failures.queue_audit(jobs, files, now), failures.retry_decision(jobs.filter("status = 'failed'").withColumn("category", F.lit("OOM")), history.latest_checkpoint(files)),
        failures.illegal_transitions(events.withColumn("status", F.col("type")).filter("type <> 'task_migrated'")), failures.unknown_spells(events.withColumn("seq", F.col("event_id")).withColumn("state", F.when(F.col("type") == "queued", "unknown").otherwise("alive"))), failures.cooldown_filter(events, "job_id", 30), failures.cooldown_filter(events, ["job_id", "node"], 30),
    ):
        some(df)
    some(integrity.lineage_cost(jobs), "root_id")
    some(integrity.duplicate_active(jobs.withColumn("cmd", F.lit("same")).withColumn("extra_env", F.create_map(F.lit("A"), F.lit("1"))).withColumn("ckpt_dir", F.lit("/c"))), "keep_id")
    lag = [r for r in integrity.nearest_runtime(jobs, runs).collect()]
    assert all(r["run_id"].startswith("t") for r in lag)
    gpus = spark.createDataFrame([(f"n{i}", g, 16, 8, 10**6, 24000, 0, 10, True) for i in range(3) for g in range(2)], "node string, gpu_idx int, total_cpu int, free_cpu int, free_ram_mb long, total_mb long, used_mb long, util_pct int, alive boolean")
    some(capacity.fit_matrix(jobs, gpus))
    some(capacity.best_slot(jobs, gpus))
    some(capacity.eviction_candidates(gpus.withColumn("used_mb", F.lit(20000)), jobs.withColumn("status", F.lit("running"))))
    some(capacity.rebalance_candidates(jobs.withColumn("node", F.lit("n1")), spark.createDataFrame([("n1", 9000), ("n2", 0)], "node string, eta_load long")))
    some(capacity.older_blockers(jobs.select("job_id", "node", F.col("submitted_at").alias("ts"), F.col("cpu_cores").alias("cpu"), F.lit(2).alias("free_cpu")), now))
    some(capacity.assign_shards(jobs, "job_id", spark.createDataFrame([("a", 1), ("b", 2)], "node string, weight int")))
    some(capacity.concurrency_timeline(jobs))
    assert history.p80_history(runs).count() > 0 and history.node_load(jobs, gpus).count() == 3 and history.estimate_backtest(runs).count() == 3


def test_streams(spark, records, tmp_path):
    streaming.use_rocksdb(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        events = lambda: streaming.stream_events(spark, str(records / "ev"), sources.EVENT_SCHEMA, "json").withColumn("status", F.col("type"))
        state = F.when(F.col("type") == "queued", "unknown").otherwise("alive")
        sized = lambda df: df.withColumns({"vram_mb": F.lit(5).cast("bigint"), "ram_mb": F.lit(6).cast("bigint")})
        streams = {
            "transitions": streaming.transition_monitor(events(), None), "spells": streaming.unknown_monitor(events().withColumn("state", state)), "debounced": streaming.debounce(events(), 30), "once": streaming.dedupe_events(events()),
            "stale": streaming.stale_timers(events(), {"launching": 5}), "done": streaming.batch_done_alerts(events().withColumn("status", F.lit("done")).withColumn("batch", F.lit("b")).withColumn("batch_size", F.lit(6))),
            "history": streaming.live_history(sized(events()).withColumn("signature", F.col("node")).withColumn("finished_at", F.col("ts")).withColumn("status", F.lit("done"))),
        }
        for name, df in streams.items():
            q = df.writeStream.format("memory").queryName(f"r_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            q.awaitTermination(120)
            told = spark.table(f"r_{name}")
            assert told.count() > 0 or name == "stale", name
            assert all(kind == "string" for c, kind in told.dtypes if c in ("job_id", "event_id", "batch"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
