"""Streams against their batch twins, over files in several micro-batches."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from jobscope import sources, streaming
from jobscope.operators import capacity, failures, history

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, job_id long, ts timestamp, status string"


@pytest.fixture(scope="module", autouse=True)
def one_partition(spark):
    """A state store a partition; one is quickest."""
    streaming.use_rocksdb(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng = random.Random(5)
    data = [(i, rng.randrange(5), T0 + datetime.timedelta(seconds=20 * i), rng.choice(["queued", "launching", "running", "done"])) for i in range(120)]
    folder = str(tmp_path_factory.mktemp("events"))
    for k in range(3):
        spark.createDataFrame(data[k * 40 : k * 40 + 40], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def live(df, tmp_path, name, expected):
    """Runs a stream whose state has a time to live, and so a batch to run at any time, until it has read ``expected`` rows."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    try:
        end = time.time() + 90
        while sum(p["numInputRows"] for p in q.recentProgress) < expected:
            assert q.exception() is None and time.time() < end
            time.sleep(0.2)
    finally:
        q.stop()
    return df.sparkSession.table(name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_transitions(spark, events, tmp_path):
    told = live(streaming.transition_monitor(streaming.stream_events(spark, events, SCHEMA)), tmp_path, "transitions", 120)
    batch = failures.illegal_transitions(spark.read.parquet(events))
    assert rows(told.select("event_id", "job_id", "before", "after")) == rows(batch.select("event_id", "job_id", "before", "after"))


def test_debounce(spark, events, tmp_path):
    found = run(streaming.debounce(streaming.stream_events(spark, events, SCHEMA), 300), tmp_path, "debounced")
    assert rows(found.select("event_id")) == rows(failures.cooldown_filter(spark.read.parquet(events), "job_id", 300).select("event_id"))


def test_rollup_equals_its_twin_and_drops_late_rows(spark, tmp_path):
    folder, at = str(tmp_path / "m"), lambda s: T0 + datetime.timedelta(seconds=s)
    schema = "job_id long, node string, ts timestamp, vram_mb long, ram_mb long"
    parts = [[(1, "n", at(5), 10, 1), (1, "n", at(20), 30, 1), (2, "n", at(30), 20, 1)], [(3, "n", at(400), 5, 1)], [(4, "n", at(410), 6, 1)], [(9, "n", at(10), 99, 9)], [(5, "n", at(9000), 1, 1)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    found = run(streaming.minute_rollup(streaming.stream_events(spark, folder, schema, files_per_batch=1)), tmp_path, "rolled")
    in_time = spark.createDataFrame([r for part in parts for r in part if r[0] != 9 and r[2] < at(9000)], schema)
    assert rows(found) == rows(capacity.minute_rollup(in_time)) and rows(found)[0][2:] == (30, 3, 2)


def test_dedupe_drops_copies(spark, events, tmp_path):
    folder = str(tmp_path / "twice")
    for _ in range(2):
        spark.read.parquet(events).coalesce(1).write.mode("append").parquet(folder)
    assert run(streaming.dedupe_events(streaming.stream_events(spark, folder, SCHEMA, files_per_batch=1)), tmp_path, "once").count() == 120


def test_peaks_and_progress(spark, tmp_path):
    folder, at = str(tmp_path / "p"), lambda s: T0 + datetime.timedelta(seconds=s)
    schema = "event_id long, job_id long, ts timestamp, vram_mb long, ram_mb long, status string"
    parts = [[(1, 1, at(1), 10, 5, "running"), (2, 2, at(1), 7, 7, "running")], [(3, 1, at(2), 8, 9, "running"), (4, 2, at(2), 1, 1, "running")], [(5, 1, at(3), 12, 1, "done")]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: streaming.stream_events(spark, folder, schema, files_per_batch=1)
    told = live(streaming.job_peaks(stream()), tmp_path, "peaks_ttl", 5)
    assert sorted(tuple(r) for r in told.collect()) == [(1, 10, 5), (1, 10, 9), (1, 12, 9), (2, 7, 7)]
    every = run(streaming.live_peaks(stream()), tmp_path, "peaks", "update")
    assert sorted(tuple(r) for r in every.groupBy("job_id").agg(F.max("peak_vram_mb"), F.max("peak_ram_mb")).collect()) == [(1, 12, 9), (2, 7, 7)]

    folder, schema = str(tmp_path / "l"), "job_id long, seq long, ts timestamp, line string, status string"
    lines = [(1, 1, at(1), "3/97 [02:00<?, ?it/s]", "running"), (1, 2, at(2), "12/97 [00:42<03:21, 12.34it/s]", "running"), (2, 1, at(1), "eta: 2m", "running"), (1, 3, at(3), "nothing", "done")]
    for line in lines:
        spark.createDataFrame([line], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: streaming.stream_events(spark, folder, schema, files_per_batch=1)
    told = live(streaming.job_progress(stream()), tmp_path, "progress_ttl", 4)
    assert sorted((tuple(r) for r in told.collect()), key=str) == [(1, 201, None, 12, 97), (2, None, 120, None, None)]
    every = run(streaming.live_progress(stream()), tmp_path, "progress", "update")
    assert every.filter("job_id = 1").agg(F.max("remaining_s"), F.max("current"), F.max("total")).first()[:] == (201, 12, 97)


def test_enrich(spark, events, tmp_path):
    hist = spark.createDataFrame([("s0", 5)], "signature string, p80 long")
    stream = streaming.stream_events(spark, events, SCHEMA).withColumn("signature", F.concat(F.lit("s"), F.col("job_id")))
    out = run(streaming.enrich(stream, hist), tmp_path, "enriched")
    assert out.count() == 120 and out.filter("p80 = 5").count() == spark.read.parquet(events).filter("job_id = 0").count() > 0


def test_spells(spark, tmp_path):
    folder, at = str(tmp_path / "u"), lambda s: T0 + datetime.timedelta(seconds=s)
    schema = "event_id long, job_id long, ts timestamp, state string"
    data = [(0, 1, at(0), "alive"), (1, 1, at(10), "unknown"), (2, 1, at(60), "unknown"), (3, 1, at(110), "dead"), (4, 2, at(0), "unknown")]
    for row in data:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    found = run(streaming.unknown_monitor(streaming.stream_events(spark, folder, schema, files_per_batch=1)), tmp_path, "spells")
    batch = failures.unknown_spells(spark.read.parquet(folder).withColumnRenamed("event_id", "seq")).filter("resolved is not null")
    assert rows(found) == rows(batch) and found.count() == 1


def test_a_retry_keeps_a_batch_open(spark, tmp_path):
    folder, at = str(tmp_path / "b"), lambda s: T0 + datetime.timedelta(seconds=s)
    steps = [[(0, 1, at(0), "failed"), (1, 1, at(10), "queued")], [(2, 2, at(20), "done"), (3, 1, at(5), "failed")], [(4, 1, at(30), "done")], [(5, 2, at(40), "done")]]
    for step in steps:
        spark.createDataFrame(step, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = streaming.stream_events(spark, folder, SCHEMA, files_per_batch=1)
    told = run(streaming.batch_done_alerts(stream.withColumn("batch", F.lit(7).cast("long")).withColumn("batch_size", F.lit(2))), tmp_path, "closed")
    assert rows(told) == [(7, 2)]
    early = stream.filter("event_id < 4").withColumn("batch", F.lit(7).cast("long")).withColumn("batch_size", F.lit(2))
    assert run(streaming.batch_done_alerts(early), tmp_path, "open").count() == 0


def state_rows(df, tmp_path, name):
    """What a stream tells, and the most rows that its state store had."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name), max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)


@pytest.mark.parametrize("parts", [1, 256])
def test_batches_of_any_size_in_few_rows_of_state(spark, tmp_path, monkeypatch, parts):
    """A batch of 2,500 jobs and a thousand of three, with retries, against a loop; the store has chunks of jobs and not a row for each."""
    monkeypatch.setattr(streaming, "PARTS", parts, raising=False)
    rng, size_of = random.Random(3), lambda b: 2500 if b == 0 else 3
    jobs = [(0, f"j{i}") for i in range(2500)] + [(1 + i // 3, f"k{i % 7}-{i}") for i in range(3000)]
    events = [(i, job, T0 + datetime.timedelta(seconds=rng.randrange(3000)), "failed" if b % 5 else "done", b, size_of(b)) for i, (b, job) in enumerate(jobs)]
    events += [(10_000 + i, job, T0 + datetime.timedelta(seconds=rng.randrange(6000)), rng.choice(["queued", "done"]), b, size_of(b)) for i, (b, job) in enumerate(rng.sample(jobs[2500:], 1500))]
    rng.shuffle(events)
    want, known, folder = set(), {}, str(tmp_path / "many")
    for k in range(3):
        part = sorted(events[k * 2400 : k * 2400 + 2400], key=lambda r: (r[2], r[0]))
        for _, job, ts, status, b, _ in part:
            if b not in want and ts >= known.get((b, job), (ts,))[0]:
                known[b, job] = ts, status != "queued"
        finished = {}
        for (b, _), (_, done) in known.items():
            finished[b] = finished.get(b, 0) + done
        want |= {r[4] for r in part if finished[r[4]] >= r[5]}
        spark.createDataFrame(part, "event_id long, job_id string, ts timestamp, status string, batch long, batch_size int").coalesce(1).write.mode("append").parquet(folder)
    assert 0 in want and 300 < len(want) < 1001
    stream = streaming.stream_events(spark, folder, "event_id long, job_id string, ts timestamp, status string, batch long, batch_size int", files_per_batch=1)
    told, most = state_rows(streaming.batch_done_alerts(stream), tmp_path, f"many_{parts}")
    assert rows(told) == sorted((b, size_of(b)) for b in want) and most <= 4 * parts + 12


def test_stale_timer_in_any_zone_with_a_late_row(spark, tmp_path):
    zone, old = "America/New_York", spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        folder, sec = str(tmp_path / "z"), lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
        for k, (job, s, status) in enumerate([(1, 100, "launching"), (1, 0, "running"), (2, 150, "launching"), (2, 170, "running"), (9, 900, "running"), (9, 1900, "running")]):
            spark.range(1).select(F.lit(k).cast("long").alias("event_id"), F.lit(job).cast("long").alias("job_id"), sec(s).alias("ts"), F.lit(status).alias("status")).coalesce(1).write.mode("append").parquet(folder)
        found = run(streaming.stale_timers(streaming.stream_events(spark, folder, SCHEMA, files_per_batch=1), {"launching": 60}, "2 minutes"), tmp_path, "stale_" + zone.replace("/", "_"))
        assert rows(found) == [(1, "launching", 1_700_000_100.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_batch_done(spark, events, tmp_path):
    stream = streaming.stream_events(spark, events, SCHEMA).withColumn("batch", F.lit(1).cast("long")).withColumn("batch_size", F.lit(5)).withColumn("status", F.lit("done"))
    assert rows(run(streaming.batch_done_alerts(stream), tmp_path, "finished").select("batch", "jobs")) == [(1, 5)]


def test_sources(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"a": 700, "b": {"vram_mb": 5, "ram_mb": 6, "dur_s_ewma": 1.5}}))
    assert rows(sources.read_history(spark, str(tmp_path / "h.json")).select("signature", "vram_mb")) == [("a", 700), ("b", 5)]
    (tmp_path / "j7.log").write_bytes(b"one\rtwo\r\nthree\n")
    assert rows(sources.read_log_lines(spark, str(tmp_path / "j7.log"))) == [("j7", 0, "one"), ("j7", 1, "two"), ("j7", 2, "three")]
    (tmp_path / "q.json").write_text(json.dumps({"tasks": [{"job_id": 1, "status": "done", "started_at": 10.0}], "next_id": 2}))
    assert sources.read_jobs(spark, str(tmp_path / "q.json"), "document").first()["job_id"] == "1"
    (tmp_path / "e.jsonl").write_text('{"event_id": "x", "type": "t"}\n\nbroken\n')
    assert sources.read_events(spark, str(tmp_path / "e.jsonl")).count() == 2
    df = spark.createDataFrame([(1, T0)], "job_id long, finished_at timestamp")
    sources.write_table(df, str(tmp_path / "arch"), by_finish_date=True)
    assert spark.read.parquet(str(tmp_path / "arch")).count() == 1
    sources.write_events(df, str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev")).count() == 1


def test_live_history(spark, tmp_path):
    """State of ten runs a signature: equal to the batch operator over all runs ever, from stored history on, after a restart, with runs that come twice."""
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    schema = "signature string, job_id string, finished_at timestamp, status string, vram_mb long, ram_mb long"
    rng = random.Random(8)
    row = lambda i: (rng.choice(["s", "s", "t", "u"]), f"j{i:03d}", at(rng.randrange(5000)), rng.choice(["done", "failed", "running"]), rng.choice([None, *range(50)]), rng.randrange(50))
    parts = [[row(100 * b + i) for i in range(25)] for b in range(4)]
    old = spark.createDataFrame([("s", f"o{i:02d}", at(-100 + i), "done", 99, i) for i in range(12)] + [("old", "z", at(-5), "done", 7, 7)], schema)
    folder, out = str(tmp_path / "runs"), str(tmp_path / "told")
    add = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)

    def fold():
        stream = streaming.stream_events(spark, folder, schema, files_per_batch=1)
        q = streaming.live_history(stream, old.drop("status")).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.parquet(out)

    add(parts[0])
    fold()
    add(parts[1] + parts[0][:9])  # some again
    fold()
    told = fold().count()
    add(parts[1])  # a file of nothing new
    assert fold().count() == told
    add(parts[2])
    every = old.unionByName(spark.createDataFrame(parts[0] + parts[1] + parts[2], schema)).filter("status in ('done', 'failed') and signature <> 'old'")
    newest = fold().groupBy("signature").agg(F.max_by(F.struct("p80_vram_mb", "p80_ram_mb", "samples", "last_seen"), F.struct("samples", "last_seen")).alias("r")).select("signature", "r.*")
    want = {r["signature"]: tuple(r) for r in history.p80_history(every).collect()}
    last = {r["signature"]: r["last_seen"] for r in newest.collect()}
    assert set(last) == set(want) and all(last[k] == want[k][4] for k in want)
    final = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert all(want[k] in final for k in want) and max(len([r for r in final if r[0] == k]) for k in want) <= 3  # a row a batch that changed it


@pytest.mark.parametrize("parts", [1, 256])
def test_history_of_many_signatures_in_few_rows_of_state(spark, tmp_path, monkeypatch, parts):
    """2,000 signatures, one of them null, with large ids, peaks that are null, and runs that come twice: equal to the operator over all runs ever, whose state isn't a row for
    each signature. What changes nothing tells nothing."""
    monkeypatch.setattr(streaming, "PARTS", parts, raising=False)
    schema = "signature string, job_id long, finished_at timestamp, status string, vram_mb long, ram_mb long"
    rng, folder = random.Random(4), str(tmp_path / "runs")
    row = lambda i: (rng.choice([None, *(f"s{k}" for k in range(9))]) if i % 3 else f"t{i % 1990}", 2**60 + i, T0 + datetime.timedelta(seconds=rng.randrange(900)), rng.choice(["done", "failed"]), rng.choice([None, 2**50 + i, i]), rng.randrange(50))
    data = [row(i) for i in range(9000)]
    for part in (data[:3000], data[3000:6000] + data[:500], data[6000:], data[3000:4000]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    told, most = state_rows(streaming.live_history(streaming.stream_events(spark, folder, schema, files_per_batch=1)), tmp_path, f"history_{parts}")
    found, want = told.collect(), history.p80_history(spark.createDataFrame(data, schema)).collect()
    assert len(want) == 2000 and set(want) <= set(found) and len(found) <= 3 * 2000
    assert most <= 2 * parts + 32


def test_estimates_as_they_were(spark, tmp_path):
    """A job gets the estimate of its time, also after a newer one has come; late jobs as defined; restart included."""
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    jobs, known = str(tmp_path / "jobs"), str(tmp_path / "known")
    job_schema, known_schema = "event_id string, job_id string, signature string, ts timestamp", "signature string, ts timestamp, vram_mb long, ram_mb long"
    add_job = lambda *rows_: spark.createDataFrame([(f"e{j}", f"j{j}", s, at(t)) for j, s, t in rows_], job_schema).coalesce(1).write.mode("append").parquet(jobs)
    add_known = lambda *rows_: spark.createDataFrame([(s, at(t), v, 2 * v) for s, t, v in rows_], known_schema).coalesce(1).write.mode("append").parquet(known)
    out = str(tmp_path / "out")

    def go():
        told = streaming.enrich_as_known(streaming.stream_events(spark, jobs, job_schema), streaming.stream_events(spark, known, known_schema), "10 seconds")
        q = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {r["job_id"]: (r["vram_mb"], r["ram_mb"]) for r in spark.read.parquet(out).collect()}

    add_known(("a", 100, 1), ("a", 200, 2), ("b", 150, 5))
    add_job((1, "a", 50), (2, "a", 120), (3, "a", 205), (4, "b", 150), (5, "c", 160))
    go()
    add_known(("a", 203, 3), ("a", 400, 4), ("x", 1000, 0))  # the first of these is out of order, not late
    add_job((6, "a", 390), (7, "x", 1100))
    got = go()
    assert got == {"j1": (None, None), "j2": (1, 2), "j3": (3, 6), "j4": (5, 10), "j5": (None, None), "j6": (3, 6)}
    add_job((8, "a", 500), (9, "a", 1200))  # the first is too late
    add_known(("x", 2000, 0))
    assert set(go()) == {"j1", "j2", "j3", "j4", "j5", "j6", "j7", "j9"} and go()["j9"] == (4, 8)


@pytest.mark.parametrize("parts", [1, 16])
def test_estimates_of_many_signatures_in_few_rows_of_state(spark, tmp_path, monkeypatch, parts):
    """4,000 jobs and as many versions of 700 signatures, one of them null, with large ids and peaks that are null, answered over several
    batches as the watermark moves: against a loop. A part has one timer and its state is not a row for each signature."""
    monkeypatch.setattr(streaming, "PARTS", parts, raising=False)
    rng, jobs, known = random.Random(6), str(tmp_path / "jobs"), str(tmp_path / "known")
    job_schema, known_schema = "event_id long, job_id long, signature string, ts timestamp", "signature string, ts timestamp, vram_mb long, ram_mb long"
    signature = lambda: rng.choice([None, "s0", "s1", *(f"t{i}" for i in range(697))])
    asked, versions = [], []
    for k in range(4):
        at = [T0 + datetime.timedelta(seconds=1000 * k, microseconds=x) for x in rng.sample(range(10**9), 2000)]
        asks = [(k * 1000 + i, 2**60 + k * 1000 + i, signature(), t) for i, t in enumerate(at[:1000])]
        facts = [(signature(), t, rng.choice([None, 2**60 + i, i]), i) for i, t in enumerate(at[1000:])]
        spark.createDataFrame(asks, job_schema).coalesce(1).write.mode("append").parquet(jobs)
        spark.createDataFrame(facts, known_schema).coalesce(1).write.mode("append").parquet(known)
        asked, versions = asked + asks, versions + facts
    spark.createDataFrame([(-1, -1, "end", T0 + datetime.timedelta(days=9))], job_schema).coalesce(1).write.mode("append").parquet(jobs)
    of, want = {}, set()
    for s, t, v, r in sorted(versions, key=lambda x: x[1]):
        of.setdefault(s, []).append((t, v, r))
    for e, j, s, t in asked:
        before = [x for x in of.get(s, ()) if x[0] <= t]
        want.add((e, j, s, t, *(before[-1][1:] if before else (None, None))))
    told = streaming.enrich_as_known(streaming.stream_events(spark, jobs, job_schema, files_per_batch=1), streaming.stream_events(spark, known, known_schema, files_per_batch=1), "1000 seconds")
    found, most = state_rows(told, tmp_path, f"known_{parts}")
    assert found.count() == 4000 and {tuple(r) for r in found.collect()} == want
    assert most <= 12 * parts + 40


def test_rotated_log(spark, tmp_path, monkeypatch):
    """Rotation between and within batches, lines not written to their ends, restarts: each event once. A generation lost unread is an error."""
    from jobscope.sources import rotated

    log = tmp_path / "logs" / "watcher.log"
    log.parent.mkdir()
    (log.parent / "watcher.log.bak").write_text('{"event_id": "no"}\n')
    say = lambda n: json.dumps({"event_id": f"e{n}", "ts": f"2024-01-01T00:00:{n % 60:02d}Z", "type": "t", "job_id": "1"}) + "\n"

    def rotate():
        for k in (2, 1):
            if (old := log.parent / f"watcher.log.{k}").exists():
                old.rename(log.parent / f"watcher.log.{k + 1}")
        log.rename(log.parent / "watcher.log.1")

    def read():
        q = streaming.stream_rotated_events(spark, str(log)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r[0] or r[1] for r in spark.read.parquet(str(tmp_path / "out")).select("event_id", "_corrupt_record").collect())

    log.write_text(say(0) + "\n" + say(1) + say(2)[:20])
    assert read() == ["e0", "e1"]
    with log.open("a") as f:
        f.write(say(2)[20:] + say(3))
    rotate()
    log.write_text(say(4))
    assert read() == ["e0", "e1", "e2", "e3", "e4"]
    rotate()
    assert read() == ["e0", "e1", "e2", "e3", "e4"]
    log.write_text(say(5) + "broken\n" + "".join(say(n) for n in range(10, 40)))
    (log.parent / "watcher.log.1").write_text((log.parent / "watcher.log.1").read_text() + say(6))
    assert read() == sorted(["broken", *(f"e{n}" for n in (*range(7), *range(10, 40)))])

    monkeypatch.setattr(rotated, "RANGE_BYTES", 50)
    reader = rotated.RotatedReader(str(log))
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    lines = [x for p in parts for x in reader.read(p)]
    assert len(parts) > 10 and sorted(v for v, _, _ in lines) == sorted(x for f in log.parent.glob("watcher.log*") if f.suffix != ".bak" for x in f.read_text().splitlines() if x)
    (log.parent / "watcher.log.2").unlink()
    with pytest.raises(FileNotFoundError):
        [x for p in parts for x in reader.read(p)]


def test_a_batch_written_again_is_there_once(spark, tmp_path):
    path = str(tmp_path / "events")
    folder = str(tmp_path / "in")
    first, second = ([(f"e{k}{i}", k) for i in range(20)] for k in range(2))
    fail = {"next": True}

    def batch(df, n):
        sources.write_event_batch(df, path, n)
        if fail["next"]:
            fail["next"] = False
            raise RuntimeError("after writing")

    def go(writer):
        q = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(60)
        except Exception as e:
            assert "after writing" in str(e)

    for part in (first, second):
        spark.createDataFrame(part, "event_id string, k int").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("event_id string, k int").option("maxFilesPerTrigger", 1).parquet(folder)
    go(stream.writeStream.foreachBatch(batch))
    assert sources.read_event_batches(spark, path).count() == 20
    go(stream.writeStream.foreachBatch(batch))
    assert sorted(r["event_id"] for r in sources.read_event_batches(spark, path, "event_id string, k int").collect()) == sorted(e for e, _ in first + second)
    sources.write_event_batch(spark.createDataFrame([("new", 9)], "event_id string, k int"), path, 1)
    assert {r["event_id"] for r in spark.read.json(path).filter("batch = 1").collect()} == {"new"} and not [x for x in (tmp_path / "events").iterdir() if x.name[0] == "_"]
    q = sources.stream_into_events(stream, str(tmp_path / "e2"), str(tmp_path / "c2"), once=True)
    q.awaitTermination(60)
    assert sources.read_event_batches(spark, str(tmp_path / "e2")).count() == 40


def test_log_lines_over_blocks(spark, tmp_path):
    """Files of all line ends, some without one at their end, read whole and in blocks of a few bytes: as Python cuts lines, in many tasks."""
    import random

    rng = random.Random(5)
    ends, want = ["\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\r\r\n", "\n\r"], {}
    for i in range(40):
        text = "".join(rng.choice(["", "é", "some words", "x" * 90]) + rng.choice(ends) for _ in range(rng.randrange(25))) + rng.choice(["", "", "end"])
        text = ("\ufeff" if i == 7 else "") + text
        (tmp_path / f"j{i}.log").write_text(text, newline="", encoding="utf-8")
        want[f"j{i}"] = text.removeprefix("\ufeff").splitlines()
    for name, text in (("only", "\r"), ("two", "\r\r"), ("vt", "a\x0b"), ("vtn", "a\x0b\n"), ("none", ""), ("crvt", "a\r\x0b")):
        (tmp_path / f"{name}.log").write_text(text, newline="", encoding="utf-8")
        want[name] = text.splitlines()
    for size in ("128m", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = {}
            for r in sources.read_log_lines(spark, str(tmp_path / "*.log")).collect():
                got.setdefault(r["job_id"], []).append((r["seq"], r["line"]))
            assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}
            assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in got.values())
            if size == "64":
                (tmp_path / "big").mkdir()
                (tmp_path / "big" / "b.log").write_text("".join(f"line {i}\n" for i in range(200)))
                assert spark.read.text(str(tmp_path / "big")).rdd.getNumPartitions() > 10
                assert [(r["seq"], r["line"]) for r in sources.read_log_lines(spark, str(tmp_path / "big")).orderBy("seq").collect()] == [(i, f"line {i}") for i in range(200)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fold_history(spark, tmp_path):
    """Against the operator over all runs ever; a batch that is tried again changes nothing; old folders go."""
    fold, every = streaming.fold_history(spark, str(tmp_path / "p"), str(tmp_path / "h")), []
    schema = "signature string, job_id long, finished_at timestamp, status string, vram_mb long, ram_mb long"
    for b in range(4):
        data = [("s" if b != 2 else "t", 10 * b + i, T0 + datetime.timedelta(seconds=10 * b + i), "done" if i else "running", 7 * i % 5 + b, i) for i in range(7)]
        every += data
        for _ in range(2):
            fold(spark.createDataFrame(data, schema), b)
        want = history.p80_history(spark.createDataFrame(every, schema).filter("status = 'done'")).filter(F.col("signature") == data[0][0])
        assert rows(spark.read.parquet(str(tmp_path / "h" / f"batch={b}"))) == rows(want)
    assert len(list((tmp_path / "p").glob("batch=*"))) == 2


def test_records_as_they_are(spark, tmp_path):
    """Text ids, one file or several to wait for, unknown fields, old and new histories."""
    tasks = [
        {"id": "toff", "status": "running", "node": "local", "gpu_idx": 0, "cmd": "python train.py", "extra_env": {"A": "1"}, "remote_pids": [12345], "log_path": "/l", "started_at": 10.5, "finished_at": None, "peak_vram_mb": 900, "notified_done": False, "ckpt_dir": None},
        {"id": "t2", "status": "queued", "wait_for_files": "/a", "local_result_dir": "/r"}, {"id": 7, "wait_for_files": ["/a", "/b"]}, {"job_id": 8, "parent_id": "t2"},
    ]
    (tmp_path / "q.json").write_text(json.dumps({"tasks": tasks, "next_id": 2}))
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps(t) for t in tasks) + "\n\nnot json\n")
    for layout, name in (("document", "q.json"), ("jsonl", "q.jsonl")):
        got = {r["job_id"]: r for r in sources.read_jobs(spark, str(tmp_path / name), layout).collect()}
        assert set(got) == {"toff", "t2", "7", "8"}
        assert got["t2"]["wait_for_files"] == ["/a"] and got["7"]["wait_for_files"] == ["/a", "/b"] and got["toff"]["wait_for_files"] is None
        assert got["toff"]["extra"] == {"notified_done": "false"} and got["t2"]["extra"] == {"local_result_dir": '"/r"'} and got["8"]["parent_id"] == "t2"
        assert got["toff"]["extra_env"] == {"A": "1"} and got["toff"]["remote_pids"] == [12345] and got["toff"]["started_at"].timestamp() % 1 == 0.5
    (tmp_path / "h.json").write_text(json.dumps({"a": 700, "b": {"vram_mb": 5, "ram_mb": 6, "last_seen": 9.0}, "c": {"vram_mb": 8, "vram_samples": [4, 8], "ram_samples": []}}))
    got = {r["signature"]: r for r in sources.read_history(spark, str(tmp_path / "h.json")).collect()}
    assert got["a"]["vram_samples"] == [700] and got["b"]["ram_samples"] == [6] and got["b"]["last_seen"].timestamp() == 9 + got["b"]["last_seen"].timestamp() // 1 - 9
    assert got["c"]["vram_samples"] == [4, 8] and got["c"]["ram_samples"] is None and got["c"]["dur_s_ewma"] is None


def test_write_stream(spark, events, tmp_path):
    for _ in range(2):  # a second start finds nothing new
        sources.write_stream(streaming.stream_events(spark, events, SCHEMA), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120
