"""Projections, filters, sorts and limits over job records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobscope.functions import ACTIVE, TERMINAL, duration_text, priority_rank, seconds_between

SEARCHED = ("job_id", "project", "node", "signature", "description", "origin", "submitted_by", "slurm_job_id", "slurm_state")


def status_view(jobs: DataFrame, which: str = "all") -> DataFrame:
    """Jobs of one status, or of all active ones; the filter reaches the scan."""
    return jobs.filter(F.col("status").isin(*(ACTIVE if which == "all" else [which])))


def search(jobs: DataFrame, text: str) -> DataFrame:
    """Jobs that have ``text``, whatever its case, in one of the SEARCHED columns that there are; null reads as empty."""
    wanted = text.lower().strip()
    if not wanted:
        return jobs
    hit = F.lit(False)
    for c in SEARCHED:
        if c in jobs.columns:
            hit = hit | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(wanted)
    return jobs.filter(hit)


def match_signature(jobs: DataFrame, glob: str) -> DataFrame:
    """Signatures that fit a glob with ``*``; a mere prefix becomes a pushed-down StartsWith."""
    if glob.endswith("*") and "*" not in glob[:-1]:
        return jobs.filter(F.col("signature").startswith(glob[:-1]))
    if "*" not in glob:
        return jobs.filter(F.col("signature") == glob)
    pattern = "^" + ".*".join("\\Q" + p + "\\E" for p in glob.split("*")) + "$"
    return jobs.filter(F.col("signature").rlike(pattern))


def pick_jobs(jobs: DataFrame, ids: list | DataFrame) -> DataFrame:
    """Jobs with the given ids: a list for a few, a table with job_id for many."""
    if isinstance(ids, DataFrame):
        return jobs.join(ids.select("job_id"), "job_id", "left_semi")
    return jobs.filter(F.col("job_id").isin(*ids))


def by_lifetime(jobs: DataFrame, min_s: int = 0, since: Column | None = None, status: str | None = None) -> DataFrame:
    """Jobs that lived ``min_s`` seconds at least, and, if given, finished since a time and with a status."""
    keep = seconds_between(F.col("started_at"), F.col("finished_at")) >= min_s
    if since is not None:
        keep = keep & (F.col("finished_at") >= since)
    if status is not None:
        keep = keep & (F.col("status") == status)
    return jobs.filter(keep)


def _elapsed(now: Column) -> Column:
    return F.when((F.col("status") == "running") & F.col("started_at").isNotNull(), seconds_between(F.col("started_at"), now))


def eta_sort_seconds(jobs: DataFrame, hist: DataFrame, now: Column) -> DataFrame:
    """Jobs with eta_sort: the live ETA, else what history leaves, else null (adopted, overrun or no history)."""
    joined = jobs.join(hist.select("signature", F.col("dur_s_ewma").alias("_ewma")), "signature", "left")
    ewma = F.when(F.col("_ewma") > 0, F.col("_ewma"))
    left = F.when(~F.coalesce(F.col("auto_adopted"), F.lit(False)) & (_elapsed(now) < ewma), ewma - _elapsed(now))
    eta = F.when(F.col("eta_seconds") > 0, F.col("eta_seconds")).when(F.col("status") == "running", left).when(F.col("status") == "queued", ewma)
    return joined.withColumn("eta_sort", eta).drop("_ewma")


def eta_display(jobs: DataFrame, hist: DataFrame, now: Column) -> DataFrame:
    """Jobs with eta_text, as a status table shows it."""
    joined = jobs.join(hist.select("signature", F.col("dur_s_ewma").alias("_ewma")), "signature", "left")
    ewma, elapsed = F.when(F.col("_ewma") > 0, F.col("_ewma")), _elapsed(now)
    text = (
        F.when(F.col("eta_seconds") > 0, F.concat(F.lit("~"), duration_text(F.col("eta_seconds")), F.lit(" "), F.coalesce("eta_source", F.lit("?"))))
        .when((F.col("status") == "running") & F.col("started_at").isNull(), "-")
        .when((F.col("status") == "running") & F.coalesce(F.col("auto_adopted"), F.lit(False)), F.concat(duration_text(elapsed), F.lit("+ ?")))
        .when((F.col("status") == "running") & ewma.isNull(), F.concat(duration_text(elapsed), F.lit("+")))
        .when((F.col("status") == "running") & (elapsed >= ewma), F.concat(F.lit("+"), duration_text(elapsed - ewma), F.lit(" over")))
        .when(F.col("status") == "running", F.concat(F.lit("~"), duration_text(ewma - elapsed), F.lit(" ("), F.floor(elapsed * 100 / ewma).cast("string"), F.lit("%)")))
        .when(F.col("status") == "queued", F.when(ewma.isNull(), "?").otherwise(F.concat(F.lit("~"), duration_text(ewma))))
        .when(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull(), duration_text(seconds_between(F.col("started_at"), F.col("finished_at"))))
        .otherwise("-")
    )
    return joined.withColumn("eta_text", text).drop("_ewma")


def display_rows(jobs: DataFrame, hist: DataFrame, now: Column) -> DataFrame:
    """What a status table shows: place, runtime, memory (current, else peak, else ~estimate) and ETA."""

    def memory(current: str, peak: str, estimate: str) -> Column:
        gb = lambda c: F.format_string("%.1fG", F.floor((F.col(c) * 10 + 512) / 1024) / F.lit(10.0))
        return (
            F.when((F.col("status") == "running") & (F.col(current) > 0), gb(current))
            .when(F.col(peak) > 0, gb(peak)).when(F.col(estimate) > 0, F.concat(F.lit("~"), gb(estimate))).otherwise("-")
        )

    place = (
        F.when(F.col("node").isNull(), "-")
        .when(F.col("slurm_job_id").isNotNull(), F.concat("node", F.lit(":SLURM-"), F.when(F.col("gpu_idx").isNull(), "CPU").otherwise(F.concat(F.lit("GPU"), F.col("gpu_idx"))), F.lit("#"), "slurm_job_id", F.lit(":"), F.coalesce("slurm_state", F.lit("?"))))
        .when(F.col("gpu_idx").isNotNull(), F.concat("node", F.lit(":GPU"), F.col("gpu_idx").cast("string")))
        .otherwise(F.col("node"))
    )
    shown = eta_display(jobs, hist, now)
    runtime = F.when(F.col("status") == "running", duration_text(_elapsed(now))).otherwise("-")
    return shown.select("job_id", "status", place.alias("place"), runtime.alias("runtime"), memory("current_vram_mb", "peak_vram_mb", "est_vram_mb").alias("vram"), memory("current_ram_mb", "peak_ram_mb", "ram_mb").alias("ram"), "eta_text")


def sort_key(key: str, now: Column) -> list[Column]:
    """Sort columns by name; largest first for runtime, vram and ram, unknown ETA last."""
    first = lambda *names: F.coalesce(*[F.when(F.col(n) > 0, F.col(n)) for n in names], F.lit(0))
    running = lambda c: F.when((F.col("status") == "running") & (F.col(c) > 0), F.col(c))
    return {
        "id": [F.col("job_id")],
        "status": [F.col("status")],
        "node": [F.coalesce("node", F.lit("~")), F.col("slurm_job_id").isNull(), F.coalesce("gpu_idx", F.lit(-1))],
        "project": [F.col("project")],
        "owner": [F.coalesce("submitted_by", F.lit(""))],
        "priority": [priority_rank(F.col("priority")), F.col("submitted_at")],
        "runtime": [-F.coalesce(_elapsed(now), F.lit(0))],
        "vram": [-F.coalesce(running("current_vram_mb"), first("peak_vram_mb", "est_vram_mb"))],
        "ram": [-F.coalesce(running("current_ram_mb"), first("peak_ram_mb", "ram_mb"))],
        "eta": [F.col("eta_sort")],
    }[key]


def sort_jobs(jobs: DataFrame, key: str, now: Column | None = None, desc: bool = False, limit: int | None = None) -> DataFrame:
    """Jobs in an order, ties by id; with a limit the sort is a top-n and never a global one. ``eta`` needs eta_sort."""
    columns = sort_key(key, F.current_timestamp() if now is None else now)
    ordered = jobs.orderBy(*[c.desc_nulls_last() if desc else c.asc_nulls_last() for c in columns], "job_id")
    return ordered.limit(limit) if limit is not None else ordered


def queue_head(jobs: DataFrame, k: int, by: str = "project") -> DataFrame:
    """The first k queued jobs of each group in queue order (priority, submitted_at)."""
    w = W.partitionBy(by).orderBy(priority_rank(F.col("priority")), "submitted_at", "job_id")
    return jobs.filter("status = 'queued'").withColumn("queue_pos", F.row_number().over(w)).filter(F.col("queue_pos") <= k)


def split_retention(jobs: DataFrame, as_of: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(archive, rest): terminal jobs that finished more than ``days`` before ``as_of``, and all others."""
    old = F.col("status").isin(*TERMINAL) & (F.col("finished_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    return jobs.filter(F.coalesce(old, F.lit(False))), jobs.filter(~F.coalesce(old, F.lit(False)))


def cap_history(hist: DataFrame, n: int = 500) -> DataFrame:
    """History rows of the n signatures seen last."""
    kept = hist.groupBy("signature").agg(F.max("finished_at").alias("last_seen")).orderBy(F.desc("last_seen"), "signature").limit(n)
    return hist.join(kept.select("signature"), "signature", "left_semi")


def tail_lines(log: DataFrame, n: int = 50) -> DataFrame:
    """The last n lines of each job."""
    w = W.partitionBy("job_id").orderBy(F.desc("seq"))
    return log.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
