"""Aggregations over past runs: peaks, percentiles, moving averages, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobscope.functions import ACTIVE, TERMINAL, prefix_of
from jobscope.operators.running import running, with_past


def run_peaks(samples: DataFrame) -> DataFrame:
    """job_id, peak_vram_mb, peak_ram_mb."""
    return samples.groupBy("job_id").agg(F.max("vram_mb").alias("peak_vram_mb"), F.max("ram_mb").alias("peak_ram_mb"))


def last_runs(peaks: DataFrame, n: int, key: str = "signature") -> DataFrame:
    """The last n runs of each key; the rank limit is applied before the shuffle too, so a hot key costs n rows a task."""
    w = W.partitionBy(key).orderBy(F.desc("finished_at"), F.desc("job_id"))
    return peaks.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _disc(column: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").cast("bigint")


def p80_history(peaks: DataFrame, n: int = 10, p: float = 0.8) -> DataFrame:
    """signature, p80_vram_mb, p80_ram_mb, samples, last_seen: nearest-rank percentiles of the last n peaks."""
    return last_runs(peaks, n).groupBy("signature").agg(
        _disc("vram_mb", p).alias("p80_vram_mb"), _disc("ram_mb", p).alias("p80_ram_mb"), F.count(F.lit(1)).alias("samples"), F.max("finished_at").alias("last_seen")
    )


def legacy_seed(peaks: DataFrame, legacy: DataFrame) -> DataFrame:
    """``peaks`` and, for signatures without any, their single legacy value as the first sample (job_id -1, finished_at long ago)."""
    old = legacy.join(peaks.select("signature"), "signature", "left_anti")
    kind = peaks.schema["job_id"].dataType
    first = old.select("signature", F.lit(-1).cast(kind).alias("job_id"), F.timestamp_seconds(F.lit(0)).alias("finished_at"), "vram_mb", F.lit(None).cast("bigint").alias("ram_mb"), F.lit(None).cast("bigint").alias("dur_s"))
    return peaks.select(first.columns).unionByName(first)


def duration_ewma(runs: DataFrame, alpha: float = 0.3, n: int = 10) -> DataFrame:
    """signature, dur_s_ewma over the last n runs, oldest first, in whole seconds."""
    runs = last_runs(runs, n).groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("finished_at", "job_id", F.col("dur_s").cast("double").alias("d")))).alias("r"))
    fold = F.aggregate(F.transform("r", lambda x: x["d"]), F.lit(None).cast("double"), lambda a, x: F.coalesce(a * (1 - alpha) + x * alpha, x))
    return runs.select("signature", F.floor(fold + 1e-6).alias("dur_s_ewma"))


def walltime(runtimes: DataFrame, hist: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, walltime_s, source: p80 of the runtime key's totals x 1.2, else EWMA x 3, else a day; 10 minutes to 7 days."""
    p = runtimes.groupBy("runtime_key").agg(_disc("total_s", 0.8).alias("_p"))
    joined = jobs.join(p, "runtime_key", "left").join(hist.select("signature", "dur_s_ewma"), "signature", "left")
    bounded = lambda c: F.least(F.lit(7 * 86400).cast("bigint"), F.greatest(F.lit(600).cast("bigint"), c.cast("bigint")))
    walls = F.coalesce(bounded(F.floor(F.col("_p") * 12 / 10)), bounded(F.floor(F.when(F.col("dur_s_ewma") > 0, F.col("dur_s_ewma")) * 3)), F.lit(86400).cast("bigint"))
    source = F.when(F.col("_p").isNotNull(), "runtime").when(F.col("dur_s_ewma") > 0, "history").otherwise("default")
    return joined.select("job_id", walls.alias("walltime_s"), source.alias("source"))


def description_key(description: Column) -> Column:
    """A description without seeds and digits, null if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(description, r"(?i)seed\s*[=:]?\s*[0-9]+", ""), r"[0-9]+", "")
    return F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))


#: What a job gets that says nothing and of which nothing is known.
DEFAULT_VRAM_MB, DEFAULT_RAM_MB, DEFAULT_CORES = 512, 4096, 1


def estimate_resources(jobs: DataFrame, peaks: DataFrame) -> DataFrame:
    """job_id, vram_mb, level, ram_mb, ram_level, cpu_cores of jobs (est_vram_mb, est_ram_mb, est_cores may be missing or null).

    Memory is what the job says (``explicit``; 0 is a value), else the p80 of its signature (``own``), else the median of the p80s of the signatures
    with its description (``description``), its prefix (``prefix``) or project (``project``), else a default. Cores have no
    history. Each level is aggregated to a row a key before it is joined.
    """
    said = {c: F.col(c) if c in jobs.columns else F.lit(None).cast("bigint") for c in ("est_vram_mb", "est_ram_mb", "est_cores")}
    hist = p80_history(peaks).select("signature", "p80_vram_mb", "p80_ram_mb", prefix_of(F.col("signature")).alias("_prefix"))
    hist = hist.withColumn("_project", F.substring_index("_prefix", "/", 1))

    def medians(rows: DataFrame, key: str, level: str) -> DataFrame:
        return rows.groupBy(key).agg(_disc("p80_vram_mb", 0.5).alias(f"_{level}_v"), _disc("p80_ram_mb", 0.5).alias(f"_{level}_r"))

    out = jobs.withColumn("_prefix", prefix_of(F.col("signature"))).join(hist.select("signature", F.col("p80_vram_mb").alias("_own_v"), F.col("p80_ram_mb").alias("_own_r")), "signature", "left")
    levels = ["own"]
    if "description" in jobs.columns and "description" in peaks.columns:
        named = peaks.select("signature", description_key(F.col("description")).alias("_description")).filter("_description is not null").distinct()
        out = out.withColumn("_description", description_key(F.col("description"))).join(medians(hist.join(named, "signature"), "_description", "description"), "_description", "left")
        levels.append("description")
    out = out.join(medians(hist, "_prefix", "prefix"), "_prefix", "left").join(medians(hist, "_project", "project").withColumnRenamed("_project", "project"), "project", "left")
    levels += ["prefix", "project"]

    def chosen(explicit: Column, end: str, default: int) -> tuple[Column, Column]:
        level = F.lit("default")
        for name in reversed(levels):
            level = F.when(F.col(f"_{name}_{end}").isNotNull(), name).otherwise(level)
        return F.coalesce(explicit, *[F.col(f"_{name}_{end}") for name in levels], F.lit(default)).cast("bigint"), F.when(explicit.isNotNull(), "explicit").otherwise(level)

    (vram, level), (ram, ram_level) = chosen(said["est_vram_mb"], "v", DEFAULT_VRAM_MB), chosen(said["est_ram_mb"], "r", DEFAULT_RAM_MB)
    return out.select("job_id", vram.alias("vram_mb"), level.alias("level"), ram.alias("ram_mb"), ram_level.alias("ram_level"), F.coalesce(said["est_cores"], F.lit(DEFAULT_CORES)).cast("bigint").alias("cpu_cores"))


def estimate_outliers(hist: DataFrame, ratio: float = 2.0) -> DataFrame:
    """signature, p80_vram_mb, sibling_median: signatures at ``ratio`` times the median of those with the same prefix."""
    rows = hist.select("signature", "p80_vram_mb", prefix_of(F.col("signature")).alias("_prefix"))
    medians = rows.groupBy("_prefix").agg(_disc("p80_vram_mb", 0.5).alias("sibling_median"))
    return rows.join(medians, "_prefix").filter(F.col("p80_vram_mb") > ratio * F.col("sibling_median")).select("signature", "p80_vram_mb", "sibling_median")


def apply_corrections(hist: DataFrame, edits: DataFrame) -> DataFrame:
    """History (signature, vram_mb) after edits (signature, vram_mb): null drops an entry, a value sets it."""
    kept = hist.join(edits.select("signature"), "signature", "left_anti").select("signature", "vram_mb")
    return kept.unionByName(edits.filter("vram_mb is not null").select("signature", "vram_mb"))


def status_counts(jobs: DataFrame, by: str = "node") -> DataFrame:
    """Jobs of each node or project by status, one column a status."""
    return jobs.groupBy(by).pivot("status", [*ACTIVE, *TERMINAL]).agg(F.count(F.lit(1))).fillna(0, [*ACTIVE, *TERMINAL])


def event_counts(events: DataFrame, cycle: str = "60 seconds") -> DataFrame:
    """cycle, type, events: how many events of each type each cycle had."""
    counts = events.groupBy(F.window("ts", cycle).alias("w"), "type").agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.col("w.start").alias("cycle"), "type", "events")


def node_load(jobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, eta_load: seconds that running and launching jobs have left; 0 for idle nodes."""
    load = jobs.filter(F.col("status").isin("running", "launching")).groupBy("node").agg(F.sum("eta_seconds").alias("_load"))
    return nodes.select("node").distinct().join(load, "node", "left").select("node", F.coalesce("_load", F.lit(0)).cast("bigint").alias("eta_load"))


def batch_completion(jobs: DataFrame, groups: DataFrame) -> DataFrame:
    """batch, state, jobs, finished for groups (batch, job_id): 0 all terminal, 1 some pending, 2 no job of it is known."""
    found = groups.join(jobs.select("job_id", F.col("status").isin(*TERMINAL).cast("int").alias("_t")), "job_id", "left")
    counts = found.groupBy("batch").agg(F.count("_t").alias("jobs"), F.coalesce(F.sum("_t"), F.lit(0)).alias("finished"))
    return counts.select("batch", F.when(F.col("jobs") == 0, 2).when(F.col("jobs") == F.col("finished"), 0).otherwise(1).alias("state"), "jobs", "finished")


# File name endings of checkpoints.
CHECKPOINT_ENDINGS = ("pt", "pth", "pkl", "ckpt", "bin", "safetensors", "npy", "npz", "h5", "hdf5", "tar")


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """dir, path: the newest checkpoint file of each folder."""
    ending = F.substring_index("path", ".", -1)
    return files.filter(~F.col("is_dir") & ending.isin(*CHECKPOINT_ENDINGS)).groupBy("dir").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def _nearest_rank(values: Column, p: float) -> Column:
    return F.get(F.sort_array(values), F.ceil(F.size(values) * F.lit(p)).cast("int") - 1)


def estimate_backtest(peaks: DataFrame, n: int = 10, percents: tuple[int, ...] = (50, 80, 95)) -> DataFrame:
    """percent, runs, under, under_rate: how often a percentile of up to n earlier peaks was below the run's own."""
    seen = with_past(peaks.select("signature", "finished_at", "job_id", "vram_mb"), ["signature"], ["finished_at", "job_id"], "vram_mb", n, "_past")
    tries = F.array(*[F.struct(F.lit(q).alias("percent"), _nearest_rank(F.col("_past"), q / 100).alias("guess")) for q in percents])
    rows = seen.select("vram_mb", F.explode(tries).alias("t")).filter("t.guess is not null")
    out = rows.groupBy("t.percent").agg(F.count(F.lit(1)).alias("runs"), F.sum((F.col("vram_mb") > F.col("t.guess")).cast("bigint")).alias("under"))
    return out.select("percent", "runs", "under", F.round(F.col("under") / F.col("runs"), 6).alias("under_rate"))


def estimate_as_of(jobs: DataFrame, peaks: DataFrame, n: int = 10, p: float = 0.8) -> DataFrame:
    """job_id, vram_as_of: each job's estimate from the runs that had finished when it was submitted.

    Runs carry the estimate as it stood after them; runs and submissions, in one order of time, need no range join: the
    last estimate is the largest of (time, estimate) so far.
    """
    runs = with_past(peaks.select("signature", "finished_at", "job_id", "vram_mb"), ["signature"], ["finished_at", "job_id"], "vram_mb", n, "_past", own=True)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    after = runs.select("signature", F.col("finished_at").alias("at"), F.lit(0).alias("kind"), none(jobs, "job_id").alias("submitted"), "job_id", _nearest_rank(F.col("_past"), p).alias("guess"))
    asks = jobs.select("signature", F.col("submitted_at").alias("at"), F.lit(1).alias("kind"), F.col("job_id").alias("submitted"), F.col("job_id").cast(peaks.schema["job_id"].dataType).alias("job_id"), none(after, "guess").alias("guess"))
    known = F.when(F.col("guess").isNotNull(), F.struct("at", "kind", "job_id", "guess"))
    both = running(after.unionByName(asks), ["signature"], ["at", "kind", "job_id"], known, "max", "_last")
    return both.filter("kind = 1").select(F.col("submitted").alias("job_id"), F.col("_last.guess").alias("vram_as_of"))
