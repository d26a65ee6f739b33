"""Small frames with values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from jobscope.functions import clock_seconds
from jobscope.operators import capacity, failures, history, integrity, logs, views

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def log(spark, lines):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "job_id long, seq long, line string")


@pytest.mark.parametrize("text,seconds", [("03:21", 201), ("5:23:11", 19391), ("00:00", 0), ("?", None), ("1:0:0:1", 86401), ("1:2:3:4:5", None), ("", None), ("7", 7)])
def test_clocks(spark, text, seconds):
    assert spark.range(1).select(clock_seconds(F.lit(text))).first()[0] == seconds


def test_latest_bar_skips_unknown_remaining(spark):
    lines = ["12/97 [00:42<03:21, 12.34it/s]", "13/97 [00:43<?, ?it/s]"]
    assert rows(logs.bar_remaining(log(spark, lines))) == [(1, 201)]
    assert rows(logs.bar_elapsed_remaining(log(spark, lines))) == [(1, 42, 201)]
    assert rows(logs.progress_pairs(log(spark, lines))) == [(1, 12, 97)]


def test_inline_eta_and_pairs(spark):
    assert rows(logs.inline_eta(log(spark, ["[16/103] OK (874.7m, ETA 4756.0m)", "eta: 1.5h"]))) == [(1, 5400)]
    assert rows(logs.progress_pairs(log(spark, ["[Epoch 250/200]", "[Epoch 3/200] x", "no"]))) == [(1, 3, 200)]


def test_progress_falls_back_to_command(spark):
    jobs = spark.createDataFrame([(1, "s", "python t.py --max_iters 100", at(0)), (2, "s", "x", at(0))], "job_id long, signature string, cmd string, started_at timestamp")
    assert rows(logs.progress(log(spark, ["Iter 40 | Reward 1"]), jobs)) == [(1, 40, 100)]
    assert rows(logs.progress(log(spark, ["Iter 140 | Reward 1"]), jobs)) == []
    hist = spark.createDataFrame([("s", 500)], "signature string, dur_s_ewma long")
    now = F.lit(at(80)).cast("timestamp")
    assert rows(logs.estimate_eta(log(spark, ["Iter 40 | Reward 1"]), jobs, hist, now)) == [(1, 120, "rate"), (2, 420, "history")]
    assert rows(logs.estimate_eta(log(spark, ["9/9 [01:00<00:00, 1.5it/s]"]), jobs, hist, now))[0] == (1, 0, "bar")


@pytest.mark.parametrize("used,est,fits", [(5000, 500, False), (0, 5000, True), (3990, 200, True), (4550, 200, False), (11000, 700, False)])
def test_gpu_fit(spark, used, est, fits):
    jobs = spark.createDataFrame([(1, "queued", 1, 0, est, None)], "job_id long, status string, cpu_cores int, ram_mb long, est_vram_mb long, require_node string")
    gpus = spark.createDataFrame([("n", 0, 8, 8, 1000, 12000, used, 0, True)], "node string, gpu_idx int, total_cpu int, free_cpu int, free_ram_mb long, total_mb long, used_mb long, util_pct int, alive boolean")
    fit = capacity.fit_matrix(jobs, gpus)
    assert fit.first()["fits"] is fits
    assert capacity.best_slot(jobs, gpus).count() == int(fits)
    assert (capacity.blocked_summary(jobs, gpus).count() == 0) is fits


def test_all_reasons_and_demands(spark):
    """Each rule alone, and the summaries by demand against the product."""
    jobs = spark.createDataFrame(
        [(1, "queued", 1, 100, 1500, None), (2, "queued", 1, 100, 1500, None), (3, "queued", 8, 9000, 0, "m"), (4, "queued", 1, 0, None, None), (5, "running", 1, 0, 0, None)],
        "job_id long, status string, cpu_cores int, ram_mb long, est_vram_mb long, require_node string",
    )
    schema = "node string, gpu_idx int, total_cpu int, free_cpu int, free_ram_mb long, budget_mb long, total_mb long, used_mb long, util_pct int, alive boolean, load1 double, running int, max_concurrent_running int, max_vram_per_task int, cpu_node boolean"
    base = dict(node="n", gpu_idx=0, total_cpu=16, free_cpu=16, free_ram_mb=10**6, budget_mb=10**6, total_mb=12000, used_mb=0, util_pct=0, alive=True, load1=0.0, running=0, max_concurrent_running=None, max_vram_per_task=None, cpu_node=False)
    one = lambda **kw: spark.createDataFrame([tuple({**base, **kw}.values())], schema)
    why = lambda job, **kw: capacity.fit_matrix(jobs.filter(F.col("job_id") == job), one(**kw), max_util=85).first()["reasons"]
    assert why(1) == [] and why(3, node="m") == [] and why(4) == []
    assert why(1, max_vram_per_task=1000) == ["vram cap"] and why(4, max_vram_per_task=0) == ["vram cap"] and why(3, node="m", max_vram_per_task=0) == []
    assert why(1, load1=16.0) == ["load"] and why(1, running=3, max_concurrent_running=3) == ["running cap"] and why(3, node="m", budget_mb=8000) == ["ram"]
    assert why(3) == ["pinned elsewhere"] and why(1, alive=False) == ["down"] and why(1, util_pct=85) == ["gpu busy"] and why(3, node="m", free_cpu=7) == ["cpu"]
    claims = spark.createDataFrame([("n", 0, 16, 0, 0, at(0), None), ("n", 0, 16, 0, 0, at(-9999), None)], "node string, gpu_idx int, cpu int, ram_mb long, vram_mb long, claimed_at timestamp, pid long")
    assert capacity.fit_matrix(jobs.filter("job_id = 1"), capacity.with_claims(one(), claims, F.lit(at(10)))).first()["reasons"] == ["cpu"]
    fleet = one().unionByName(one(node="m", max_vram_per_task=1000)).unionByName(one(node="m", gpu_idx=1, used_mb=3000, cpu_node=True))
    fit = capacity.fit_matrix(jobs, fleet)
    want = fit.select("job_id", "node", F.explode("reasons").alias("reason")).groupBy("reason", "node").agg(F.countDistinct("job_id").alias("jobs"))
    assert rows(capacity.blocked_summary(jobs, fleet).select("reason", "node", "jobs")) == rows(want.select("reason", "node", "jobs"))
    best = {r["job_id"]: (r["node"], r["gpu_idx"]) for r in capacity.best_slot(jobs, fleet).collect()}
    assert best == {1: ("m", 1), 2: ("m", 1), 3: ("m", 1), 4: ("m", 1)}


@pytest.mark.parametrize("cell_rows", [1_000_000, 30])
def test_running_against_a_loop(spark, monkeypatch, cell_rows):
    """Cells give what one window over a key's whole history gives."""
    import random

    from jobscope.operators import running as r
    from jobscope.operators.running import running, with_past

    monkeypatch.setattr(r, "CELL_ROWS", cell_rows)
    rng = random.Random(2)
    data = [(i, rng.choice(["a", "b", None]), at(rng.randrange(20) * 40_000), rng.choice([None, 1, 2, 7])) for i in range(200)]
    df = spark.createDataFrame(data, "job_id long, node string, ts timestamp, v long")
    for how, fold in (("sum", sum), ("min", min), ("max", max)):
        for own in (True, False):
            got = {r["job_id"]: r["x"] for r in running(df, ["node"], ["ts", "job_id"], F.col("v"), how, "x", own).collect()}
            for i, node, ts, _ in data:
                seen = [v for j, n, t, v in data if n == node and v is not None and ((t, j) < (ts, i) or own and j == i)]
                assert got[i] == (fold(seen) if seen else 0 if how == "sum" else None)
    celled, hot = r.cut(df, ["node"], ["ts", "job_id"])
    assert hot is (cell_rows == 30) and celled.select("_cell").distinct().count() >= (4 if hot else 1)
    for own in (True, False):
        got = {x["job_id"]: x["past"] for x in with_past(df, ["node"], ["ts", "job_id"], "v", 10, "past", own).collect()}
        for i, node, ts, _ in data:
            past = sorted((t, j, v) for j, n, t, v in data if n == node and ((t, j) < (ts, i) or own and j == i))[-10:]
            assert got[i] == [v for _, _, v in past if v is not None]
    assert running(df.filter("false"), ["node"], ["ts"], F.col("v"), "sum", "x").count() == 0


def test_blockers_compete(spark):
    rows_ = [(1, "n", at(0), 9, 4, "gpu0"), (2, "n", at(10), 9, 4, "gpu1"), (3, "n", at(20), 9, 4, "gpu1"), (4, "n", at(30), 1, 4, "gpu0"), (5, "n", at(40), 9, 4, "gpu2")]
    intents = spark.createDataFrame(rows_, "job_id long, node string, ts timestamp, cpu int, free_cpu int, resource string")
    assert rows(capacity.older_blockers(intents, F.lit(at(1805)))) == [(4, 1), (5, 4)]
    assert rows(capacity.older_blockers(intents, F.lit(at(9000)))) == [(3, 2), (4, 1), (5, 4)]
    assert rows(capacity.older_blockers(intents.drop("resource"), F.lit(at(9000)))) == [(2, 1), (3, 1), (4, 1), (5, 1)]


def test_rebalance_rules(spark):
    jobs = spark.createDataFrame(
        [(1, "n", "running", 900, None, False, 10, None), (2, "n", "running", 5000, None, False, 9000, None), (3, "n", "running", 4000, None, False, 10, at(-60)), (4, "n", "running", 3000, "n", False, 10, None), (5, "n", "running", 2000, None, True, 10, None)],
        "job_id long, node string, status string, eta_seconds long, require_node string, auto_adopted boolean, ckpt_mb long, moved_at timestamp",
    )
    load = spark.createDataFrame([("n", 14900), ("idle", 0)], "node string, eta_load long")
    assert rows(capacity.rebalance_candidates(jobs, load, F.lit(at(0)))) == [("n", "idle", 1)]
    assert rows(capacity.rebalance_candidates(jobs, load, F.lit(at(3600)))) == [("n", "idle", 3)]
    sized = jobs.withColumn("cwd_mb", F.when(F.col("job_id") == 3, 1025).when(F.col("job_id") == 1, 1024))
    assert rows(capacity.rebalance_candidates(sized, load, F.lit(at(3600)))) == [("n", "idle", 1)]


def test_peak_against_a_limit(spark):
    jobs = spark.createDataFrame([(1, "n", at(0), at(100)), (2, "n", at(50), at(200)), (3, "n", at(100), None)], "job_id long, node string, started_at timestamp, finished_at timestamp")
    nodes = spark.createDataFrame([("n", 1)], "node string, max_concurrent_running int")
    assert rows(capacity.peak_concurrency(jobs, nodes)) == [("n", 2, 1, 1)]


def test_shard_plan(spark):
    w = spark.createDataFrame([("a", 64), ("b", 128), ("c", 0)], "node string, weight int")
    assert rows(capacity.shard_quotas(w, 901)) == [("a", 0, 300, 5, 60), ("b", 300, 901, 5, 121)]
    assert rows(capacity.shard_quotas(w.filter("node = 'b'"), 901)) == [("b", 0, 901, 8, 113)]
    got = rows(capacity.assign_shards(spark.range(901), "id", w))
    assert got == sorted([(i, "a" if i < 300 else "b") for i in range(901)], key=str)


def test_ownership(spark):
    jobs = spark.createDataFrame([(1, "n", "running", "me", 4), (2, "n", "running", "x", 3), (3, "n", "queued", "me", 8)], "job_id long, node string, status string, scheduler_id string, cpu_cores int")
    probes = spark.createDataFrame([("n", 16, 6)], "node string, total_cpu int, free_cpu int")
    assert rows(capacity.cpu_ownership(jobs, probes, "me")) == [("n", 10, 4, 3, 3)]


def test_identity_and_runtime_key(spark):
    df = spark.createDataFrame([(1, "t --seed 1", {"A": "1", "B": "2"}, "high"), (2, "t --seed 1", {"B": "2", "A": "1"}, "low"), (3, "t --seed 99", {"A": "1", "B": "2"}, "low"), (4, "t --seed 1", {"A": "2"}, "low")], "job_id long, cmd string, extra_env map<string,string>, priority string")
    a, b, c, d = [r[0] for r in df.orderBy("job_id").select(integrity.run_identity(df)).collect()]
    assert a == b != c and d != a
    a, b, c, d = [r[0] for r in df.orderBy("job_id").select(integrity.runtime_key(df)).collect()]
    assert a == b == c != d


def test_nearest_run_is_earlier_and_related(spark):
    schema = "job_id long, project string, cwd string, cmd string, submitted_at timestamp, finished_at timestamp"
    runs = [(1, "P", "/a", "python train.py --n 100", at(0), at(50)), (2, "P", "/a", "python train.py --n 200 --x", at(0), at(10)), (3, "Q", "/b", "python eval.py --episodes 5", at(0), at(5)), (4, "R", "/c", "python train.py --n 100 --seed 3", at(0), at(500))]
    jobs = [(10, "P", "/x", "python train.py --n 100", at(60), None), (11, "P", "/x", "python train.py --n 100", at(20), None), (12, "S", "/s", "python other.py", at(900), None), (13, "S", "/c", "python train.py --n 100 --seed 9", at(900), None), (14, "P", "/a", "python train.py --n 100", at(1), None)]
    got = rows(integrity.nearest_runtime(spark.createDataFrame(jobs, schema), spark.createDataFrame(runs, schema)))
    assert [(j, r) for j, r, _ in got] == [(10, 1), (11, 2), (13, 4)] and got[0][2] == 1.0
    unrelated = spark.createDataFrame([(9, "P", "/tmp", "python train.py --n_steps 100", at(900), None)], schema)
    assert integrity.nearest_runtime(unrelated, spark.createDataFrame([runs[2]], schema)).count() == 0


def test_overlapping_pairs_against_all_pairs(spark):
    """Runs of minutes, of days and of a year on two folders, of which one is hot; each pair once, ids that are texts, ties and touching ends."""
    import random

    rng = random.Random(9)
    data = []
    for i in range(220):
        start = rng.randrange(40_000)
        length = rng.choice([0, 1, 60, 64, 600, 5000]) if i % 40 else 31_000_000
        data.append((f"j{i:03d}", rng.choice(["/hot", "/hot", "/cold", None]), at(start - (length // 2 if length > 10**6 else 0)), at(start + length)))
    data += [("a", "/hot", at(5), at(9)), ("b", "/hot", at(5), at(9)), ("c", "/hot", at(9), at(10)), ("d", "/hot", None, at(7)), ("e", "/hot", at(6), None), ("f", "/x", at(1), at(2))]
    df = spark.createDataFrame(data, "job_id string, ckpt_dir string, started_at timestamp, finished_at timestamp")
    want = []
    runs = sorted((a, j, d, b) for j, d, a, b in data if d and a and b and a < b)
    for i, (a, j, d, b) in enumerate(runs):
        want += [(j, k, d, int((min(b, e) - c).total_seconds())) for c, k, f, e in runs[i + 1 :] if f == d and c < b]
    got = integrity.ckpt_overlaps(df)
    assert rows(got) == sorted(want, key=str) and len(want) > 500
    flagged = {r[0] for r in integrity.ckpt_overlap_history(df).collect()}
    assert flagged == {k for _, k, _, _ in want}
    assert "CartesianProduct" not in plan(got) and "BroadcastNestedLoopJoin" not in plan(got)


def test_lineage_of_any_length(spark):
    """A chain of 1,000, a job that is its own parent, a circle of three with a tail, parents that aren't there, repeated rows."""
    data = [(f"c{i:04d}", f"c{i - 1:04d}" if i else None) for i in range(1000)]
    data += [("self", "self"), ("below", "self"), ("x", "y"), ("y", "z"), ("z", "x"), ("tail", "x"), ("tail2", "tail"), ("lost", "nobody"), ("lost2", "lost"), ("c0005", "c0004"), (None, "x")]
    jobs = spark.createDataFrame([(j, p, 1, "done") for j, p in data], "job_id string, parent_id string, dur_s long, status string")
    got = {r["job_id"]: (r["root_id"], r["depth"], r["cyclic"]) for r in integrity.lineage(jobs).collect()}
    want = {f"c{i:04d}": ("c0000", i, False) for i in range(1000)} | dict.fromkeys(["self", "below", "x", "y", "z", "tail", "tail2"], (None, None, True)) | {"lost": ("lost", 0, False), "lost2": ("lost", 1, False)}
    assert got == want
    assert integrity.lineage(jobs.filter("false")).count() == 0
    few = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "job_id long, parent_id long")
    assert rows(integrity.retry_lineage(few)) == [(1, 1, 0), (2, 1, 1), (3, 1, 2)]
    costs = {r["root_id"]: r["attempts"] for r in integrity.lineage_cost(jobs).collect()}
    assert costs == {"c0000": 1001, "lost": 2}


def test_duplicates_keep_the_first(spark):
    data = [("b", "queued", at(1), "x"), ("a", "queued", at(1), "x"), ("c", "running", at(9), "x"), ("d", "queued", at(0), "y"), ("e", "done", at(0), "x"), ("f", "launching", None, "y")]
    jobs = spark.createDataFrame(data, "job_id string, status string, submitted_at timestamp, cmd string")
    assert rows(integrity.duplicate_active(jobs)) == [("a", "c"), ("b", "c"), ("d", "f")]
    assert "Window" not in plan(integrity.duplicate_active(jobs))


def test_fits_without_the_product(spark, monkeypatch):
    """Random fleets and demands, nulls included: equal to what the product says, in blocks too, and no product in the plans."""
    import random

    rng = random.Random(11)
    one = lambda *xs: rng.choice(xs)
    demands = [(i, one("queued", "queued", "running"), one(1, 2, 8, None), one(0, 100, 5000, None), one(0, 1, 700, 3000, 9000, None), one(None, None, "n1", "n3", "gone")) for i in range(150)]
    jobs = spark.createDataFrame(demands, "job_id long, status string, cpu_cores int, ram_mb long, est_vram_mb long, require_node string")
    nodes = [(f"n{i}", g, 16, one(0, 1, 4, 16), 10**6, one(50, 3000, 10**6), 12000, one(0, 0, 3000, 4600, 11500, 11499), one(0, 90), one(True, True, True, False), one(0.0, 16.0), one(0, 3), one(None, 3), one(None, 0, 1, 2000), one(True, False)) for i in range(9) for g in range(2)]
    gpus = spark.createDataFrame(nodes, "node string, gpu_idx int, total_cpu int, free_cpu int, free_ram_mb long, budget_mb long, total_mb long, used_mb long, util_pct int, alive boolean, load1 double, running int, max_concurrent_running int, max_vram_per_task int, cpu_node boolean")
    for util in (None, 85):
        fit = capacity.fit_matrix(jobs, gpus, util)
        want = fit.select("job_id", "node", F.explode("reasons").alias("reason")).groupBy("reason", "node").agg(F.countDistinct("job_id").alias("jobs"))
        summary = capacity.blocked_summary(jobs, gpus, util)
        assert rows(summary.select("reason", "node", "jobs")) == rows(want.select("reason", "node", "jobs"))
        cpu_only = F.coalesce("est_vram_mb", F.lit(1)) == 0
        order = F.struct(F.when(cpu_only, (~F.col("cpu_node")).cast("int")).otherwise((F.col("used_mb") == 0).cast("int")).alias("a"), F.when(cpu_only, -F.col("free_cpu")).otherwise(F.col("total_mb") - F.col("used_mb")).alias("b"), "node", "gpu_idx")
        best = fit.filter("fits").join(jobs, "job_id").join(gpus, ["node", "gpu_idx"]).groupBy("job_id").agg(F.min(order).alias("s")).select("job_id", "s.node", "s.gpu_idx")
        monkeypatch.setattr(capacity.FirstFit, "RUN", 1024 if util else 4)
        monkeypatch.setattr(capacity, "BROADCAST_ROWS", 200_000 if util else 7)
        slots = capacity.best_slot(jobs, gpus, util)
        assert rows(slots) == rows(best) and slots.count() >= 5
        for df in (summary, slots):
            assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_marks_and_endings(spark):
    """Every documented mark of a run with nothing to do, after GPU use; every documented ending of a checkpoint."""
    marks = ["Running 0 checkpoints", "Nothing to evaluate", "no checkpoints to run", "Training complete", "nothing at all"]
    jobs = spark.createDataFrame([(i, 5000) for i in range(len(marks))], "job_id long, peak_vram_mb long")
    lines = spark.createDataFrame([(i, 0, f"INFO {m}") for i, m in enumerate(marks)], "job_id long, seq long, line string")
    assert [r[1] for r in rows(failures.diagnose_terminal(jobs, lines).select("job_id", "is_crash"))] == [False, False, False, False, True]
    for ending, found in [(e, True) for e in "pt pth pkl ckpt bin safetensors npy npz h5 hdf5 tar".split()] + [("csv", False), ("log", False), ("binx", False)]:
        files = spark.createDataFrame([("/d", f"/d/a.b.{ending}", 1, False), ("/d", "/d/new.csv", 9, False)], "dir string, path string, mtime long, is_dir boolean")
        assert [r["path"] for r in history.latest_checkpoint(files).collect()] == ([f"/d/a.b.{ending}"] if found else [])


def test_strict_conflicts_and_costs(spark):
    jobs = spark.createDataFrame([(1, "running", "s", "/c", None, 10), (2, "queued", "s", "/c", 1, 20), (3, "done", "t", "/c", 2, 30), (4, "queued", "u", "/d", None, 5)], "job_id long, status string, signature string, ckpt_dir string, parent_id long, dur_s long")
    assert integrity.ckpt_conflicts(jobs).count() == 0
    assert [r[0] for r in rows(integrity.ckpt_conflicts(jobs, strict=True))] == [1, 2]
    assert rows(integrity.lineage_cost(jobs)) == [(1, 3, 60, "done"), (4, 1, 5, "queued")]


def test_flags_and_environments(spark):
    df = spark.createDataFrame([(1, "t --lr=-0.1 --b -2 --out=a --c --out foo.txt --d"), (2, "t --out"), (3, None)], "job_id long, cmd string")
    assert rows(logs.extract_flags(df)) == sorted([(1, "lr", "-0.1"), (1, "b", "-2"), (1, "out", "a"), (1, "out", "foo.txt")], key=str)
    got = {r["job_id"]: r["flags"] for r in logs.flag_values(df, ["out", "b"]).collect()}
    assert got == {1: {"out": ["a", "foo.txt"], "b": ["-2"]}, 2: {}, 3: None}
    env = spark.createDataFrame([(["A=x=y=z", "1BAD=x", "CUDA_VISIBLE_DEVICES=0", "B", "C=1", "C=2"],), ([],), (None,)], "env array<string>")
    a, b, c = logs.parse_env(env).collect()
    assert a["env_map"] == {"A": "x=y=z", "C": "2"} and a["env_rejected"] == ["1BAD=x", "CUDA_VISIBLE_DEVICES=0", "B"]
    assert b["env_map"] == {} and c["env_map"] is None


def test_estimates_cascade(spark):
    peaks = spark.createDataFrame([("p/a/1", 1, at(1), 100, 10, "net 3"), ("p/a/2", 2, at(1), 200, 20, "other"), ("q/b/1", 3, at(1), 900, 90, "Net seed=4 7")], "signature string, job_id long, finished_at timestamp, vram_mb long, ram_mb long, description string")
    jobs = spark.createDataFrame(
        [(1, "p/a/1", "p", "x", 0, 4), (2, "p/a/1", "p", "x", None, None), (3, "z/z/z", "z", "Net 99", None, None), (4, "p/a/9", "p", "x", None, None), (5, "p/c/9", "p", "x", None, None), (6, "n/n/n", "n", "x", None, None)],
        "job_id long, signature string, project string, description string, est_vram_mb long, est_cores long",
    )
    got = {r["job_id"]: tuple(r)[1:] for r in history.estimate_resources(jobs, peaks).collect()}
    assert got == {
        1: (0, "explicit", 10, "own", 4), 2: (100, "own", 10, "own", 1), 3: (900, "description", 90, "description", 1),
        4: (100, "prefix", 10, "prefix", 1), 5: (100, "project", 10, "project", 1), 6: (512, "default", 4096, "default", 1),
    }
    events = spark.createDataFrame([(at(1), "no_fit"), (at(2), "no_fit"), (at(70), "launch")], "ts timestamp, type string")
    assert rows(history.event_counts(events)) == [(at(0), "no_fit", 2), (at(60), "launch", 1)]


def test_gate(spark):
    jobs = spark.createDataFrame([(1, "queued", ["/a"]), (2, "queued", ["/a", "/d"]), (3, "queued", ["/e"]), (4, "queued", None)], "job_id long, status string, wait_for_files array<string>")
    files = spark.createDataFrame([("/a", 5, False), ("/d", 5, True), ("/e", 0, False)], "path string, size long, is_dir boolean")
    assert rows(integrity.artifact_gate(jobs, files)) == [(1, False, 0), (2, True, 1), (3, True, 1), (4, False, 0)]


def test_killed_is_not_oom(spark):
    jobs = spark.createDataFrame([(1, "failed", 100), (2, "failed", 100), (3, "failed", 100)], "job_id long, status string, dur_s long")
    lines = spark.createDataFrame([(1, 0, "task killed mid-training"), (2, 0, "RuntimeError: CUDA out of memory"), (3, 0, "Traceback (most recent call last)")], "job_id long, seq long, line string")
    assert rows(failures.classify_failure(jobs, lines)) == [(1, "UNKNOWN"), (2, "OOM"), (3, "APP_BUG")]


@pytest.mark.parametrize(
    "line,category",
    [("OSError: [Errno 28] memory", "DISK_FULL"), ("ENOSPC", "DISK_FULL"), ("disk full", "DISK_FULL"), ("Killed process 123 (python) total-vm:1kB", "OOM"), ("oom-kill:constraint", "OOM"), ("oom_reaper: reaped", "OOM"), ("MemoryError", "OOM"), ("out of memory", "OOM"),
     ("bash: 没有那个文件或目录", "ENV_MISSING"), ("No such file or directory", "ENV_MISSING"), ("ImportError: x", "PYTHON_IMPORT"), ("Traceback", "APP_BUG"), ("Killed", "UNKNOWN"), ("task killed mid-training", "UNKNOWN")],
)
def test_failures_by_line(spark, line, category):
    jobs = spark.createDataFrame([(1, "failed", 100)], "job_id long, status string, dur_s long")
    assert failures.classify_failure(jobs, log(spark, [line])).first()["category"] == category


def test_p80_stays_typical_and_empty(spark):
    peaks = spark.createDataFrame([("s", i, at(i), v, v) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 100])], "signature string, job_id long, finished_at timestamp, vram_mb long, ram_mb long")
    assert history.p80_history(peaks).first()["p80_vram_mb"] == 8
    assert history.p80_history(peaks.filter("false")).count() == 0


@pytest.mark.parametrize("walked,kind", [(4096, "long"), (20, "long"), (1, "string")])
def test_cooldown_against_a_loop(spark, monkeypatch, walked, kind):
    """Also where a key never pauses, which is walked by doubled jumps; ids of any type, several key columns, nulls and ties."""
    import random

    monkeypatch.setattr(failures, "WALKED", walked)
    rng = random.Random(3)
    data = [(i, rng.choice([0, 1, 2, None]), at(rng.randrange(20_000))) for i in range(400)]
    data += [(1000 + i, 7, at(3 * i + rng.randrange(2))) for i in range(700)] + [(2000 + i, 7, at(300)) for i in range(5)] + [(3000, 1, None)]
    make = (lambda i: f"e{i:05d}") if kind == "string" else int
    df = spark.createDataFrame([(make(i), None if k is None else make(k), ts, "x") for i, k, ts in data], f"event_id {kind}, job_id {kind}, ts timestamp, target string")
    want, last = [], {}
    for e, j, ts in sorted((r for r in data if r[2]), key=lambda r: (r[2], r[0])):
        if j not in last or (ts - last[j]).total_seconds() >= 100:
            last[j] = ts
            want.append(make(e))
    for key in ("job_id", ["job_id", "target"]):
        assert sorted(r[0] for r in failures.cooldown_filter(df, key, 100).select("event_id").collect()) == sorted(want)
    assert failures.cooldown_filter(df, "job_id", 0).count() == len(data) - 1 and failures.cooldown_filter(df.filter("false"), "job_id", 9).count() == 0


def test_no_window_by_a_hot_key_alone(spark, monkeypatch):
    """Estimates of a signature with a third of all runs: in cells, equal to one window over its history, with ids that are texts."""
    import random

    from jobscope.operators import running as r

    rng = random.Random(6)
    runs = [(rng.choice(["hot", "hot", f"s{rng.randrange(9)}"]), f"j{i:04d}", at(rng.randrange(3000)), rng.choice([None, *range(100)]), 1) for i in range(600)]
    peaks = spark.createDataFrame(runs, "signature string, job_id string, finished_at timestamp, vram_mb long, ram_mb long")
    jobs = spark.createDataFrame([(f"k{i:04d}", rng.choice(["hot", "s1", "none"]), at(rng.randrange(3300))) for i in range(300)], "job_id string, signature string, submitted_at timestamp")
    whole = rows(history.estimate_backtest(peaks)), rows(history.estimate_as_of(jobs, peaks))
    monkeypatch.setattr(r, "CELL_ROWS", 50)
    assert (rows(history.estimate_backtest(peaks)), rows(history.estimate_as_of(jobs, peaks))) == whole
    for j, sig, ts in [tuple(x) for x in jobs.collect()]:
        seen = [v for _, _, v in sorted((f, i, v) for s, i, f, v, _ in runs if s == sig and f <= ts)[-10:] if v is not None]
        assert dict(whole[1])[j] == (sorted(seen)[-(-len(seen) * 8 // 10) - 1] if seen else None)
    text = plan(history.estimate_backtest(peaks))
    assert "_cell" in text and all("_cell" in x for x in text.splitlines() if "collect_list" in x and "Window" in x)


def test_spells(spark):
    p = spark.createDataFrame([(1, at(0), 0, "alive"), (1, at(10), 1, "unknown"), (1, at(60), 2, "unknown"), (1, at(110), 3, "dead")], "job_id long, ts timestamp, seq long, state string")
    assert rows(failures.unknown_spells(p)) == [(1, at(10), 2, at(110), 100)]


def test_retention_and_order(spark):
    jobs = spark.createDataFrame([(1, "done", at(0)), (2, "done", at(9 * 86400)), (3, "running", None)], "job_id long, status string, finished_at timestamp")
    old, rest = views.split_retention(jobs, F.lit(at(10 * 86400)))
    assert [r[0] for r in old.select("job_id").collect()] == [1] and sorted(r[0] for r in rest.select("job_id").collect()) == [2, 3]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("job_id"), F.concat(F.lit("a/"), F.col("id")).alias("signature"), F.lit("done").alias("status"), F.col("id").alias("vram_mb"), F.col("id").alias("ram_mb"), F.timestamp_seconds("id").alias("finished_at")).write.parquet(str(tmp_path / "j"))
    jobs = spark.read.parquet(str(tmp_path / "j"))
    assert "StringStartsWith" in plan(views.match_signature(jobs, "a/*"))
    assert "WindowGroupLimit" in plan(history.p80_history(jobs))
    for df in (history.p80_history(jobs), views.status_view(jobs), integrity.ckpt_conflicts(jobs.withColumn("ckpt_dir", F.lit("x")))):
        assert "Python" not in plan(df) and "CartesianProduct" not in plan(df)
