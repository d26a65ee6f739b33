"""Failure triage, audits and checks of event order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobscope.functions import seconds_between
from jobscope.operators.integrity import artifact_gate, producers_of_blocked
from jobscope.operators.logs import trained
from jobscope.operators.running import running, same
from jobscope.storage import stored

# What tells a failure, in order of precedence. std::bad_alloc and RESOURCE_EXHAUSTED are additions of this library.
FAILURES = [
    ("DISK_FULL", ["No space left on device", "[Errno 28]", "ENOSPC", "disk full", "Disk quota exceeded"]),
    ("OOM", ["CUDA out of memory", "out of memory", "MemoryError", "Killed process", "oom-kill", "oom_reaper", "std::bad_alloc", "RESOURCE_EXHAUSTED"]),
    ("ENV_MISSING", ["没有那个文件或目录", "no such file or directory", "command not found"]),
    ("PYTHON_IMPORT", ["ModuleNotFoundError", "ImportError"]),
]
# What tells that a run had nothing to do, which is a clean end and no crash.
NOTHING_TO_DO = ("Running 0 checkpoints", "Nothing to ", "no checkpoints to")
# Marks of success; "All done", "Finished" and "already complete" are additions of this library.
SUCCESS = ("Training complete", "training complete", "All done", "Finished", "already complete")
ESCALATED = tuple(name for name, _ in FAILURES)

# The legal changes of a job's status.
TRANSITIONS = [
    ("queued", "launching"), ("queued", "cancelled"), ("launching", "running"), ("launching", "queued"), ("launching", "failed"), ("launching", "cancelled"),
    ("running", "done"), ("running", "failed"), ("running", "evicted"), ("running", "cancelled"), ("evicted", "queued"), ("failed", "queued"),
]


def _says(line: Column, patterns: list[str] | tuple[str, ...], any_case: bool = False) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (F.lower(line).contains(p.lower()) if any_case else line.contains(p))
    return hit


def classify_failure(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """job_id, category of failed jobs: the first of FAILURES that any line tells, APP_BUG for a traceback after more than
    60 s of life, else UNKNOWN. A bare "Killed" isn't OOM. Needs dur_s."""
    line = F.col("line")
    flags = log.groupBy("job_id").agg(
        *[F.bool_or(_says(line, p, name == "ENV_MISSING")).alias(name) for name, p in FAILURES], F.bool_or(line.contains("Traceback")).alias("trace")
    )
    failed = jobs.filter("status = 'failed'").join(flags, "job_id", "left")
    category = F.when(F.col("trace") & (F.col("dur_s") > 60), "APP_BUG").otherwise("UNKNOWN")
    for name, _ in reversed(FAILURES):
        category = F.when(F.col(name), name).otherwise(category)
    return failed.select("job_id", category.alias("category"))


def retry_decision(failures: DataFrame, checkpoints: DataFrame, max_retries: int = 3) -> DataFrame:
    """job_id, decision, resumable for failures (job_id, category, retry_count, ckpt_dir): escalate, retry or give_up."""
    decision = F.when(F.col("category").isin(*ESCALATED), "escalate").when(F.col("retry_count") < max_retries, "retry").otherwise("give_up")
    joined = failures.join(checkpoints.select(F.col("dir").alias("ckpt_dir"), F.lit(True).alias("_has")), "ckpt_dir", "left")
    return joined.select("job_id", decision.alias("decision"), F.coalesce("_has", F.lit(False)).alias("resumable"))


def diagnose_terminal(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """job_id, is_crash, reason of jobs that stopped: done on a success or nothing-to-do mark; a crash if it trained or used
    the GPU without one; an empty log is a crash if it used the GPU, else no start."""
    line = F.col("line")
    flags = log.groupBy("job_id").agg(F.bool_or(_says(line, SUCCESS)).alias("ok"), F.bool_or(_says(line, NOTHING_TO_DO)).alias("noop"), F.max(F.length("line")).alias("size"))
    rows = jobs.join(flags, "job_id", "left").join(trained(log), "job_id", "left").withColumn("gpu", F.coalesce(F.col("peak_vram_mb"), F.lit(0)) > 0)
    empty = F.coalesce("size", F.lit(0)) == 0
    reason = F.when(F.col("ok"), "success mark").when(F.col("noop"), "nothing to do").when(empty & F.col("gpu"), "empty log after GPU use").when(empty, "empty log").when(F.col("trained"), "trained without success mark").when(F.col("gpu"), "GPU use without success mark").otherwise("no training seen")
    crash = ~F.coalesce(F.col("ok") | F.col("noop"), F.lit(False)) & (F.col("gpu") | F.coalesce("trained", F.lit(False)))
    return rows.select("job_id", crash.alias("is_crash"), reason.alias("reason"))


def submission_audit(jobs: DataFrame) -> DataFrame:
    """job_id, finding: a row for each rule that a job breaks. ``justification``, ``resume_flag`` and ``forces_cpu`` may be null."""
    training = F.col("cmd").contains("train")
    rules = [
        ("cpu training unjustified", training & F.coalesce("forces_cpu", F.lit(False)) & (F.length(F.coalesce("justification", F.lit(""))) < 30)),
        ("training without checkpoint", training & F.col("ckpt_dir").isNull()),
        ("checkpoint without resume flag", F.col("ckpt_dir").isNotNull() & F.col("resume_flag").isNull()),
    ]
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
    return jobs.select("job_id", F.explode(found).alias("finding"))


def queue_audit(jobs: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """job_id, finding: evaluation without a gate, producer of a blocked job below high priority, stale retry, stuck launch."""
    queued = jobs.filter("status = 'queued'")
    ungated = queued.filter(F.lower("cmd").contains("eval") & (F.coalesce(F.size("wait_for_files"), F.lit(0)) < 1)).select("job_id", F.lit("evaluation without gate").alias("finding"))
    producers = producers_of_blocked(jobs, files).select("job_id").distinct()
    low = jobs.filter("priority <> 'high'").join(producers, "job_id", "left_semi").select("job_id", F.lit("producer not high").alias("finding"))
    stale = queued.filter("parent_id is not null and eta_seconds > 0").select("job_id", F.lit("retry with old eta").alias("finding"))
    stuck = jobs.filter((F.col("status") == "launching") & (seconds_between(F.col("started_at"), now) > 60)).select("job_id", F.lit("launching over 60 s").alias("finding"))
    return ungated.unionByName(low).unionByName(stale).unionByName(stuck)


def illegal_transitions(events: DataFrame) -> DataFrame:
    """event_id, job_id, before, after: changes of status that the lifecycle doesn't have. Same status again is no change."""
    w = W.partitionBy("job_id").orderBy("ts", "event_id")
    steps = events.select("event_id", "job_id", F.lag("status").over(w).alias("before"), F.col("status").alias("after")).filter("before is not null and before <> after")
    legal = F.concat_ws(">", "before", "after").isin(*[f"{a}>{b}" for a, b in TRANSITIONS])
    return steps.filter(~legal)


def unknown_spells(probes: DataFrame) -> DataFrame:
    """job_id, started, count, resolved, lasted_s: spans of ``unknown`` probes, until the first probe that isn't."""
    w = W.partitionBy("job_id").orderBy("ts", "seq")
    marked = probes.withColumn("_unknown", F.col("state") == "unknown").withColumn("_new", F.col("_unknown") & ~F.coalesce(F.lag("_unknown").over(w), F.lit(False))).withColumn("_next", F.lead("ts").over(w))
    spans = marked.withColumn("_k", F.sum(F.col("_new").cast("int")).over(w)).filter("_unknown").groupBy("job_id", "_k")
    out = spans.agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("count"), F.max_by("_next", F.struct("ts", "seq")).alias("resolved"))
    return out.select("job_id", "started", "count", "resolved", seconds_between(F.col("started"), F.col("resolved")).alias("lasted_s"))


#: Times of a stretch without a pause up to which one task walks it; longer ones are walked by doubled jumps.
WALKED = 4096


def cooldown_filter(events: DataFrame, key: str | list[str], seconds: int) -> DataFrame:
    """Events (event_id, ts, key columns) that are at least ``seconds`` after the last kept one of their key.

    Times count in whole seconds. Of events in one second the first (by ts, then event_id) can be kept, so what is worked on are the distinct seconds of a
    key. A pause of ``seconds`` always starts anew: stretches between pauses are walked each by itself, those of over ``WALKED`` seconds
    by doubling: each second points at the first one that is late enough, pointers are joined with themselves until none is left, and
    what a stretch's first second reaches is kept. So a key that never pauses is many tasks' work. Null keys are a key; an event
    without a time is never kept; with ``seconds`` of 0 or less all others are.
    """
    keys = [key] if isinstance(key, str) else list(key)
    timed = events.filter("ts is not null")
    if seconds <= 0:
        return timed
    first = timed.groupBy(*keys, F.unix_timestamp("ts").alias("_at")).agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    nodes = first.select(*keys, "_at", F.col("_first.event_id").alias("_event"))
    nodes = running(nodes, keys, ["_at"], F.col("_at"), "max", "_before", own=False)
    cuts = F.when(F.coalesce(F.col("_at") - F.col("_before") >= seconds, F.lit(True)), F.col("_at"))
    nodes = stored(running(nodes, keys, ["_at"], cuts, "max", "_start").drop("_before"))
    sizes = nodes.groupBy(*keys, "_start").agg(F.count(F.lit(1)).alias("_n"))
    long = stored(sizes.filter(F.col("_n") > WALKED).drop("_n"))
    if long.isEmpty():
        kept = _walked(nodes, keys, seconds)
    else:
        at = same("n", "l", [*keys, "_start"])
        sides = {how: nodes.alias("n").join(long.alias("l"), at, how) for how in ("left_anti", "left_semi")}
        kept = _walked(sides["left_anti"], keys, seconds).unionByName(_jumped(stored(sides["left_semi"]), keys, seconds))
    found = kept.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_event")
    owns = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    return timed.join(found, owns & (F.col("event_id") == F.col("_event")), "left_semi")


def _walked(nodes: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """keys, _event of the kept seconds of short stretches."""
    kind = nodes.schema["_event"].dataType.simpleString()
    ordered = nodes.groupBy(*keys, "_start").agg(F.sort_array(F.collect_list(F.struct("_at", "_event"))).alias("e"))  # bounded: WALKED
    start = F.struct(F.lit(-(1 << 60)).cast("bigint").alias("last"), F.array().cast(f"array<{kind}>").alias("kept"))
    step = lambda s, e: F.when(e["_at"] - s["last"] >= seconds, F.struct(e["_at"].alias("last"), F.concat(s["kept"], F.array(e["_event"])).alias("kept"))).otherwise(s)
    return ordered.select(*keys, F.explode(F.aggregate("e", start, step, lambda s: s["kept"])).alias("_event"))


def _jumped(nodes: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """keys, _event of the kept seconds of long ``nodes`` (keys, _at, _event, _start; stored)."""
    # the first second at or after a probe is the least seen when all are read backwards in time
    probes = nodes.select(*keys, (-F.col("_at") - seconds).alias("_back"), F.lit(1).alias("_kind"), "_at")
    seen = nodes.select(*keys, (-F.col("_at")).alias("_back"), F.lit(0).alias("_kind"), "_at")
    ahead = running(probes.unionByName(seen), keys, ["_back", "_kind"], F.when(F.col("_kind") == 0, F.col("_at")), "min", "_next")
    jumps = stored(ahead.filter("_kind = 1 and _next is not null").select(*keys, "_at", "_next"))
    kept = stored(nodes.filter("_at = _start").select(*keys, "_at"))
    here = same("k", "j", keys) & (F.col("k._at") == F.col("j._at"))
    while not jumps.isEmpty():
        more = kept.alias("k").join(jumps.alias("j"), here).select(*[F.col(f"k.{c}") for c in keys], F.col("j._next").alias("_at"))
        kept = stored(kept.unionByName(more).distinct())
        twice = jumps.alias("k").join(jumps.alias("j"), same("k", "j", keys) & (F.col("k._next") == F.col("j._at")))
        jumps = stored(twice.select(*[F.col(f"k.{c}") for c in keys], F.col("k._at").alias("_at"), F.col("j._next").alias("_next")))
    return nodes.alias("k").join(kept.alias("j"), here, "left_semi").select(*keys, "_event")
