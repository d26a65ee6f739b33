"""Identity, duplicates, conflicts, lineage and other joins over job records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions import ACTIVE
from jobscope.operators.running import running
from jobscope.storage import stored

IDENTITY = ("cmd", "cwd", "extra_env", "env_spec", "image", "ckpt_dir", "result_dir")


def run_identity(jobs: DataFrame) -> Column:
    """Hash of what a run does (command, folder, sorted environment, outputs), whatever its priority or resources."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(_text_of(jobs, c), F.lit("\x00")) for c in IDENTITY]), 256)


def duplicate_active(jobs: DataFrame) -> DataFrame:
    """job_id, keep_id of active jobs that do what an earlier one does already (running before launching before queued).

    The one to keep is a minimum, so a run that is submitted over and over is not sorted anywhere.
    """
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "launching", 1).otherwise(2)
    active = jobs.filter(F.col("status").isin(*ACTIVE)).withColumn("_id", run_identity(jobs))
    first = active.groupBy("_id").agg(F.min(F.struct(rank.alias("rank"), "submitted_at", "job_id")).alias("_f"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return active.select("job_id", "_id").join(first.select("_id", F.col("_f.job_id").alias("keep_id")), "_id").filter("job_id <> keep_id").select("job_id", "keep_id")


def ckpt_conflicts(jobs: DataFrame, strict: bool = False) -> DataFrame:
    """job_id, ckpt_dir, signatures: active jobs whose checkpoint folder several signatures use; with ``strict``, several jobs."""
    active = jobs.filter(F.col("status").isin(*ACTIVE) & F.col("ckpt_dir").isNotNull()).select("job_id", "ckpt_dir", "signature")
    used = active.groupBy("ckpt_dir").agg(F.countDistinct("signature").alias("signatures"), F.count(F.lit(1)).alias("_jobs"))
    shared = used.filter(F.col("_jobs" if strict else "signatures") > 1).drop("_jobs")
    return active.join(shared, "ckpt_dir").select("job_id", "ckpt_dir", "signatures")


def ckpt_overlap_history(jobs: DataFrame) -> DataFrame:
    """job_id, ckpt_dir: runs that started while an earlier one still wrote to the same folder; one pass by running end."""
    runs = jobs.filter("ckpt_dir is not null and started_at < finished_at")
    ends = running(runs, ["ckpt_dir"], ["started_at", "job_id"], F.col("finished_at"), "max", "_end", own=False)
    return ends.filter("started_at < _end").select("job_id", "ckpt_dir")


def ckpt_overlaps(jobs: DataFrame) -> DataFrame:
    """job_id, other_id, ckpt_dir, overlap_s: each pair of runs that wrote to one folder at the same time; job_id is the one that started first
    (of those that started together the smaller id), overlap_s in whole seconds.

    An interval join without a range condition to search by: a run's level is the power of two that is no shorter than it, so at
    its own level and at each higher one it lies in two buckets at most. Pairs meet at the level of the longer run, of which only levels that a folder
    has are looked at, and are told in their first common bucket. A run of a year so meets runs of minutes in two buckets and not in all
    its minutes, and a folder's runs are spread by time.
    """
    runs = jobs.filter("ckpt_dir is not null and started_at < finished_at").select("job_id", "ckpt_dir", F.unix_micros("started_at").alias("a"), F.unix_micros("finished_at").alias("b"))
    runs = runs.withColumn("level", F.ceil(F.log2(F.col("b") - F.col("a"))).cast("int"))
    levels = runs.groupBy("ckpt_dir").agg(F.collect_set("level").alias("levels"))  # 63 at most
    bucket = F.expr("explode(sequence(shiftright(a, at), shiftright(b - 1, at)))")
    spread = runs.join(levels, "ckpt_dir").withColumn("at", F.explode(F.expr("filter(levels, l -> l >= level)"))).drop("levels").withColumn("bucket", bucket)
    x, y = spread.filter("at = level").alias("x"), spread.alias("y")
    overlap = (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b"))
    once = F.col("x.bucket") == F.greatest(F.expr("shiftright(x.a, x.at)"), F.expr("shiftright(y.a, y.at)"))
    order = (F.col("y.level") < F.col("x.level")) | (F.struct("x.a", "x.job_id") < F.struct("y.a", "y.job_id"))
    met = x.join(y, (F.col("x.ckpt_dir") == F.col("y.ckpt_dir")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.bucket") == F.col("y.bucket")) & overlap & once & order)
    first, other = (f(F.struct("x.a", "x.job_id"), F.struct("y.a", "y.job_id")) for f in (F.least, F.greatest))
    seconds = F.floor((F.least("x.b", "y.b") - F.greatest("x.a", "y.a")) / 1_000_000).cast("bigint")
    return met.select(first.getField("job_id").alias("job_id"), other.getField("job_id").alias("other_id"), F.col("x.ckpt_dir").alias("ckpt_dir"), seconds.alias("overlap_s"))


def untracked_processes(procs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Processes on a GPU or at 50 % CPU that no job tracks: node, pid, proposed (a signature)."""
    tracked = jobs.select("node", F.explode("remote_pids").alias("pid"))
    latest = procs.groupBy("node", "pid").agg(F.max_by(F.struct("pcpu", "gpu_mem_mb", "cwd"), "ts").alias("p")).select("node", "pid", "p.*")
    loose = latest.join(tracked, ["node", "pid"], "left_anti").filter("pcpu >= 50 or gpu_mem_mb > 0")
    project = F.coalesce(F.nullif(F.substring_index("cwd", "/", -1), F.lit("")), F.lit("unknown"))
    return loose.select("node", "pid", F.concat(project, F.lit("/auto-adopted/p"), F.col("pid").cast("string")).alias("proposed"))


def retry_lineage(jobs: DataFrame, max_depth: int = 3) -> DataFrame:
    """job_id, root_id, depth: parents followed at most ``max_depth`` times, as retries are limited. A job that is its own parent has none.

    See :func:`lineage` for chains of any length, and for those that end in a circle.
    """
    parent = F.when(F.col("parent_id") != F.col("job_id"), F.col("parent_id"))
    parents = jobs.select(F.col("job_id").alias("_j"), parent.alias("_p"))
    out = jobs.select("job_id", F.col("job_id").alias("root_id"), parent.alias("_next"), F.lit(0).alias("depth"))
    for _ in range(max_depth):
        step = out.join(parents, out["_next"] == parents["_j"], "left")
        out = step.select("job_id", F.coalesce("_j", "root_id").alias("root_id"), F.when(F.col("_j").isNotNull(), F.col("_p")).alias("_next"), (F.col("depth") + F.col("_j").isNotNull().cast("int")).alias("depth"))
    return out.drop("_next")


def lineage(jobs: DataFrame) -> DataFrame:
    """job_id, root_id, depth, cyclic of every job id: the first of its chain of parents and how far it is, whatever the length.

    A parent that isn't among the jobs counts as none; an id with several parents has the smallest. A job whose parents lead into a circle, its own
    included, is ``cyclic`` and has no root and no depth. Pointers are doubled: after k rounds each spans 2^k parents, so a chain
    of a million takes twenty joins; rounds are written to the shared folder. When a round settles nothing, what is left runs in circles.
    """
    own = jobs.groupBy("job_id").agg(F.min("parent_id").alias("parent_id")).filter("job_id is not null")
    known = own.select(F.col("job_id").alias("anc"))
    links = own.join(known, F.col("parent_id") == F.col("anc"), "left")
    table = stored(links.select("job_id", F.coalesce("anc", "job_id").alias("anc"), F.col("anc").isNotNull().cast("bigint").alias("dist"), F.col("anc").isNull().alias("done")))
    left, before = table.filter("not done").count(), -1
    while left and left != before:
        ahead = table.select(F.col("job_id").alias("_j"), F.col("anc").alias("_a"), F.col("dist").alias("_d"), F.col("done").alias("_done"))
        step = table.filter("not done").join(ahead, F.col("anc") == F.col("_j")).select("job_id", F.col("_a").alias("anc"), (F.col("dist") + F.col("_d")).alias("dist"), F.col("_done").alias("done"))
        table = stored(table.filter("done").unionByName(step))
        before, left = left, table.filter("not done").count()
    done = F.col("done")
    return table.select("job_id", F.when(done, F.col("anc")).alias("root_id"), F.when(done, F.col("dist")).alias("depth"), (~done).alias("cyclic"))


def lineage_cost(jobs: DataFrame) -> DataFrame:
    """root_id, attempts, total_s, final_status of each chain of retries, of any length; circles have no root and are left out."""
    chains = lineage(jobs).filter("not cyclic").join(jobs.select("job_id", "dur_s", "status"), "job_id")
    return chains.groupBy("root_id").agg(F.count(F.lit(1)).alias("attempts"), F.sum("dur_s").alias("total_s"), F.max_by("status", F.struct("depth", "job_id")).alias("final_status"))


def artifact_gate(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """job_id, blocked, missing: queued jobs and how many files they wait for aren't there, are empty or are folders."""
    waits = jobs.filter("status = 'queued'").select("job_id", F.explode_outer("wait_for_files").alias("path"))
    there = files.filter("size > 0 and not is_dir").select("path", F.lit(1).alias("_ok")).distinct()
    missing = F.sum((F.col("path").isNotNull() & F.col("_ok").isNull()).cast("bigint"))
    return waits.join(there, "path", "left").groupBy("job_id").agg(missing.alias("missing")).select("job_id", (F.col("missing") > 0).alias("blocked"), "missing")


def producers_of_blocked(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Active jobs whose checkpoint folder is one that blocked jobs wait for a file of."""
    blocked = artifact_gate(jobs, files).filter("blocked").select("job_id")
    waits = jobs.join(blocked, "job_id", "left_semi").select(F.explode("wait_for_files").alias("path"))
    dirs = waits.select(F.regexp_replace("path", r"/[^/]*$", "").alias("ckpt_dir")).distinct()
    return jobs.filter(F.col("status").isin(*ACTIVE)).join(dirs, "ckpt_dir", "left_semi").select("job_id", "ckpt_dir", "status")


def latest_by_key(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each key."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), seq).alias("_r")).select(key, "_r.*")


def snapshot_drift(expected: DataFrame, actual: DataFrame, key: list[str], value: str = "digest") -> DataFrame:
    """key, state: absent, stale or current for what is expected, extra for what is there besides."""
    both = expected.select(*key, F.col(value).alias("_e"), F.lit(1).alias("_in")).join(actual.select(*key, F.col(value).alias("_a"), F.lit(1).alias("_out")), key, "full_outer")
    state = F.when(F.col("_in").isNull(), "extra").when(F.col("_out").isNull(), "absent").when(F.col("_e").eqNullSafe(F.col("_a")), "current").otherwise("stale")
    return both.select(*key, state.alias("state"))


def normalized_command(cmd: Column) -> Column:
    return F.regexp_replace(cmd, r"--seed[= ]\d+", "--seed=N")


def runtime_key(jobs: DataFrame) -> Column:
    """Hash of command without seed, folder and environment; signature, project and description play no part."""
    parts = [normalized_command(F.col("cmd")), *(_text_of(jobs, c) for c in ("cwd", "env_spec", "extra_env"))]
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("\x01")) for p in parts]), 256)


def _text_of(jobs: DataFrame, column: str) -> Column:
    """A column as text, a map with its entries in order, null if there is none."""
    if column not in jobs.columns:
        return F.lit(None).cast("string")
    is_map = jobs.schema[column].dataType.typeName() == "map"
    return F.to_json(F.array_sort(F.map_entries(column))) if is_map else F.col(column).cast("string")


#: A command's script: its first word with a program's ending.
SCRIPT = r"(\S+\.(?:py|sh|R|jl|ipynb))(?:\s|$)"


def _classed(jobs: DataFrame) -> DataFrame:
    """``jobs`` with _words (distinct words of the command, in order) and _blocks (its project, folder and script)."""
    names = [F.concat(F.lit(f"{k}:"), v) for k, v in (("project", _text_of(jobs, "project")), ("cwd", _text_of(jobs, "cwd")), ("script", F.nullif(F.regexp_extract("cmd", SCRIPT, 1), F.lit(""))))]
    words = F.array_sort(F.array_distinct(F.split(F.trim(normalized_command(F.col("cmd"))), r"\s+")))
    return jobs.filter("cmd is not null").withColumn("_words", words).withColumn("_blocks", F.array_compact(F.array(*names)))


def nearest_runtime(jobs: DataFrame, runs: DataFrame, min_sim: float = 0.5) -> DataFrame:
    """job_id, run_id, similarity: the run, finished before the job was submitted, of the same project, folder or script whose
    command words are most alike (Jaccard, ``min_sim`` at least); ties to the smallest run_id. Jobs without one are left out.

    What is compared are distinct commands, each with the first of its runs to finish, and not runs. Commands meet by a
    block and a word that is rare among the commands (prefix filter: commands alike enough share one), never all with all.
    """
    mine = _classed(jobs).select("job_id", "submitted_at", "_words", "_blocks")
    asked = mine.select("_words", "_blocks").distinct()
    had = _classed(runs).groupBy(F.col("_words").alias("_v"), F.col("_blocks").alias("_b")).agg(F.min(F.struct("finished_at", "job_id")).alias("_first"))
    had = had.select("_v", "_b", F.col("_first.finished_at").alias("_at"), F.col("_first.job_id").alias("run_id"))
    often = had.select("_v").distinct().select(F.explode("_v").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def keyed(rows: DataFrame, words: str, blocks: str) -> DataFrame:
        """word and block of each row's rarest words, as many as make sure that two alike sets share one."""
        sets = rows.select(words).distinct()
        ranked = sets.select(words, F.explode(words).alias("word")).join(often, "word", "left").groupBy(words).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("_r"))
        rare = F.slice("_r", F.lit(1), F.size(words) - F.ceil(F.size(words) * F.lit(min_sim) - 1e-9).cast("int") + 1)
        return ranked.select(words, F.explode(F.transform(rare, lambda x: x["word"])).alias("word")).join(rows, words).withColumn("block", F.explode(blocks))

    sim = F.size(F.array_intersect("_words", "_v")) / F.size(F.array_union("_words", "_v"))
    met = keyed(asked, "_words", "_blocks").select("word", "block", "_words", "_blocks").join(keyed(had, "_v", "_b").select("word", "block", "_v", "_at", "run_id"), ["word", "block"])
    alike = met.select("_words", "_blocks", "_v", "_at", "run_id").distinct().withColumn("similarity", sim).filter(F.col("similarity") >= min_sim)
    earlier = mine.join(alike.drop("_v"), ["_words", "_blocks"]).filter("_at <= submitted_at")
    best = earlier.groupBy("job_id").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "run_id")).alias("best"))
    return best.select("job_id", "best.run_id", F.round(-F.col("best.minus"), 6).alias("similarity"))
