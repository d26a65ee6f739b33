"""What nodes and GPUs have, who uses it, and which waiting job fits where."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobscope.functions import seconds_between
from jobscope.operators.running import running
from jobscope.shipping import ship
from jobscope.storage import BROADCAST_ROWS, broadcast_blocks, stored

MARGIN_MB, FREEZE_EXTRA_MB = 500, 512

#: What of a job decides where it fits.
DEMAND = ("cpu_cores", "ram_mb", "est_vram_mb", "require_node")


def ram_budget(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """node, budget_mb: free RAM less headroom, a fixed one first, else a fraction of the smaller of declared and probed."""
    joined = nodes.join(probes.select("node", "total_ram_mb", "free_ram_mb"), "node", "left")
    size = F.least(F.nullif("ram_mb", F.lit(0)), F.col("total_ram_mb"))
    headroom = F.coalesce(F.col("headroom_mb"), F.floor(size * F.col("headroom_frac")), F.lit(0))
    return joined.select("node", F.greatest(F.lit(0), F.coalesce("free_ram_mb", F.lit(0)) - headroom).cast("bigint").alias("budget_mb"))


def cpu_ownership(jobs: DataFrame, probes: DataFrame, me: str) -> DataFrame:
    """node, used, ours, other, untracked: whose the used cores are. Queued jobs use none."""
    busy = jobs.filter(F.col("status").isin("running", "launching"))
    own = F.col("scheduler_id") == me
    cores = busy.groupBy("node").agg(F.sum(F.when(own, F.col("cpu_cores")).otherwise(0)).alias("ours"), F.sum(F.when(own, 0).otherwise(F.col("cpu_cores"))).alias("other"))
    rows = probes.select("node", (F.col("total_cpu") - F.col("free_cpu")).alias("used")).join(cores, "node", "left").fillna(0, ["ours", "other"])
    return rows.select("node", F.col("used").cast("bigint").alias("used"), F.col("ours").cast("bigint").alias("ours"), F.col("other").cast("bigint").alias("other"), F.greatest(F.lit(0), F.col("used") - F.col("ours") - F.col("other")).cast("bigint").alias("untracked"))


def _reasons(gpus: DataFrame, max_util: int | None, projected: bool) -> Callable[[Callable[[str], Column]], Column]:
    """All reasons why a job's demand doesn't fit a GPU slot, whose fields ``gpu`` gives; rules on fields that the fleet doesn't tell are left out."""
    has = set(gpus.columns)

    def reasons(gpu: Callable[[str], Column]) -> Column:
        needs_gpu, est = F.coalesce("est_vram_mb", F.lit(1)) > 0, F.coalesce("est_vram_mb", F.lit(0))
        frozen = gpu("used_mb") + (est if projected else F.lit(0)) >= F.floor(gpu("total_mb") / 3) + FREEZE_EXTRA_MB
        rules = [
            ("down", ~gpu("alive")),
            ("pinned elsewhere", F.col("require_node").isNotNull() & (F.col("require_node") != gpu("node"))),
            ("cpu", F.col("cpu_cores") > gpu("free_cpu")),
            ("load", gpu("load1") >= gpu("total_cpu") if {"load1", "total_cpu"} <= has else None),
            ("running cap", gpu("running") >= gpu("max_concurrent_running") if {"running", "max_concurrent_running"} <= has else None),
            ("ram", F.coalesce("ram_mb", F.lit(0)) > gpu("budget_mb" if "budget_mb" in has else "free_ram_mb")),
            ("vram cap", needs_gpu & (F.greatest(est, F.lit(1)) > gpu("max_vram_per_task")) if "max_vram_per_task" in has else None),
            ("vram", needs_gpu & (gpu("total_mb") - gpu("used_mb") < est + MARGIN_MB)),
            ("vram frozen", needs_gpu & (gpu("used_mb") > 0) & frozen),
            ("gpu busy", needs_gpu & (gpu("util_pct") >= max_util) if max_util is not None else None),
        ]
        return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules if broken is not None]))

    return reasons


def with_claims(gpus: DataFrame, claims: DataFrame, now: Column, ttl_s: int = 3600) -> DataFrame:
    """``gpus`` with free cores and RAM and used memory as they are once live claims (see :func:`effective_free`) are taken off."""
    left = effective_free(gpus, claims, now, ttl_s)
    return gpus.drop("free_cpu", "free_ram_mb").join(left, ["node", "gpu_idx"]).withColumn("used_mb", F.col("total_mb") - F.col("free_vram_mb")).drop("free_vram_mb")


def fit_matrix(jobs: DataFrame, gpus: DataFrame, max_util: int | None = None, projected: bool = False) -> DataFrame:
    """job_id, node, gpu_idx, fits, reasons (all of them) for each queued job (cpu_cores, ram_mb, est_vram_mb, require_node) and GPU.

    ``gpus`` may tell, beside what a probe does, budget_mb (see :func:`ram_budget`; else free_ram_mb counts), load1,
    running and max_concurrent_running, and max_vram_per_task (null: no cap, 0: no GPU jobs); take claims off by :func:`with_claims`.
    A job without an estimate is a GPU job, one of 0 takes no GPU memory. Each answer is asked for, so this is their product: the fleet's
    side is sent to the tasks in blocks of a bounded size. :func:`best_slot` and :func:`blocked_summary` don't need it.
    """
    queued, reasons = jobs.filter("status = 'queued'").select("job_id", *DEMAND), _reasons(gpus, max_util, projected)
    fits = [queued.crossJoin(part).withColumn("reasons", reasons(F.col)) for part in broadcast_blocks(gpus, "node", "gpu_idx")]
    return reduce(DataFrame.unionByName, fits).select("job_id", "node", "gpu_idx", (F.size("reasons") == 0).alias("fits"), "reasons")


def _demands(jobs: DataFrame) -> DataFrame:
    """The distinct demands of queued jobs, with how many jobs have each: a fleet answers a demand once, not each job."""
    return jobs.filter("status = 'queued'").groupBy(*DEMAND).agg(F.count(F.lit(1)).alias("jobs"))


def best_slot(jobs: DataFrame, gpus: DataFrame, max_util: int | None = None) -> DataFrame:
    """job_id, node, gpu_idx: for each queued job that fits somewhere a GPU in use already, then the least memory left; a job
    without GPU memory takes the most free cores (on a node for CPU work, if ``gpus`` tells ``cpu_node``, before others).

    What rules a slot out whatever is asked for is looked at once. The rest are four numbers of a slot (cores, RAM, GPU memory left and its cap), each of which
    must be no less than the demand's, so the slots go to the tasks sorted by preference, with bitmaps for each number (:class:`FirstFit`), and a
    distinct demand's first bit is its slot. A demand with a required node meets that node's slots only.
    """
    open_ = _open_slots(gpus, max_util)
    needs_gpu, est = F.coalesce("est_vram_mb", F.lit(1)) > 0, F.coalesce("est_vram_mb", F.lit(0)).cast("double")
    gpu_only = lambda c: F.when(needs_gpu, c).otherwise(_LEAST)
    asked = _demands(jobs).drop("jobs").withColumns({"_g": needs_gpu, "_cpu": F.coalesce(F.col("cpu_cores").cast("double"), F.lit(_LEAST)), "_ram": F.coalesce("ram_mb", F.lit(0)).cast("double"), "_vram": gpu_only(est), "_cap": gpu_only(F.greatest(est, F.lit(1.0)))})
    score = F.struct("a", "b", "node", "gpu_idx")
    there = asked.filter("require_node is not null").alias("q").join(open_.alias("s"), F.expr("q.require_node = s.node and q._g = s.gpu and q._cpu <= s.cpu and q._ram <= s.ram and q._vram <= s.vram and q._cap <= s.cap"))
    fits = [there.groupBy(*[F.col(f"q.{c}").alias(c) for c in DEMAND]).agg(F.min(F.struct("s.a", "s.b", "s.node", "s.gpu_idx")).alias("s"))]
    free = asked.filter("require_node is null")
    open_ = stored(open_)
    blocks = max(1, -(-open_.count() // BROADCAST_ROWS))
    for b in range(blocks):
        block = open_ if blocks == 1 else open_.filter(F.pmod(F.xxhash64("node", "gpu_idx"), F.lit(blocks)) == b)
        fits.append(_first_slots(free, block.orderBy("a", "b", "node", "gpu_idx")).select(*DEMAND, score.alias("s")))
    best = reduce(DataFrame.unionByName, fits).groupBy(*[F.col(c).alias(f"_{c}") for c in DEMAND]).agg(F.min("s").alias("s"))
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DEMAND])
    return jobs.filter("status = 'queued'").join(best, alike).select("job_id", "s.node", "s.gpu_idx")


#: What stands for a demand that isn't told and a limit that there isn't.
_LEAST, _MOST = -1e300, 1e300


def _open_slots(gpus: DataFrame, max_util: int | None) -> DataFrame:
    """node, gpu_idx, gpu, cpu, ram, vram, cap, a, b: slots for jobs with (``gpu``) and without GPU memory that some demand could take, what they have, and
    what they are preferred by (the least a, then b)."""
    has = set(gpus.columns)
    most = lambda c: F.coalesce(c.cast("double"), F.lit(_MOST))
    holds = lambda c: ~F.coalesce(c, F.lit(False))
    up = holds(~F.col("alive"))
    if {"load1", "total_cpu"} <= has:
        up = up & holds(F.col("load1") >= F.col("total_cpu"))
    if {"running", "max_concurrent_running"} <= has:
        up = up & holds(F.col("running") >= F.col("max_concurrent_running"))
    left = F.col("total_mb") - F.col("used_mb")
    idle = holds((F.col("used_mb") > 0) & (F.col("used_mb") >= F.floor(F.col("total_mb") / 3) + FREEZE_EXTRA_MB))
    if max_util is not None:
        idle = idle & holds(F.col("util_pct") >= max_util)
    labour = F.when(F.coalesce("cpu_node", F.lit(False)), 0).otherwise(1) if "cpu_node" in has else F.lit(0)
    room = {"cpu": most(F.col("free_cpu")), "ram": most(F.col("budget_mb" if "budget_mb" in has else "free_ram_mb")), "vram": most(left - MARGIN_MB), "cap": most(F.col("max_vram_per_task")) if "max_vram_per_task" in has else F.lit(_MOST)}
    slots = gpus.filter(up).select("node", "gpu_idx", *[c.alias(n) for n, c in room.items()], idle.alias("idle"), (F.col("used_mb") == 0).cast("int").alias("ga"), left.cast("double").alias("gb"), labour.cast("int").alias("ca"), (-F.col("free_cpu")).cast("double").alias("cb"))
    with_gpu = slots.filter("idle").select("node", "gpu_idx", F.lit(True).alias("gpu"), *room, F.col("ga").alias("a"), F.col("gb").alias("b"))
    return with_gpu.unionByName(slots.select("node", "gpu_idx", F.lit(False).alias("gpu"), *room, F.col("ca").alias("a"), F.col("cb").alias("b")))


class FirstFit:
    """The first of a list of slots all of whose numbers are no less than a demand's.

    Slots are taken in runs of ``RUN``. For each number and each count r a bitmap says which of a run's slots have the r largest; a demand
    finds its r by binary search, and the first bit that its bitmaps share is the slot.
    """

    RUN, STEP = 1024, 8192

    def __init__(self, room: np.ndarray):
        self.runs = []
        for at in range(0, len(room), self.RUN):
            part = room[at : at + self.RUN]
            tables = []
            for column in part.T:
                order = np.argsort(-column, kind="stable")
                rank = np.empty(len(part), np.int64)
                rank[order] = np.arange(len(part))
                tables.append((np.sort(column), np.packbits(rank[None, :] < np.arange(len(part) + 1)[:, None], axis=1)))
            self.runs.append((at, len(part), tables))

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The slot of each demand (rows), -1 if none fits."""
        out = np.full(len(asked), -1, np.int64)
        for start in range(0, len(asked), self.STEP):
            todo = np.arange(start, min(start + self.STEP, len(asked)))
            for at, n, tables in self.runs:
                fit = None
                for d, (values, bits) in enumerate(tables):
                    row = bits[n - np.searchsorted(values, asked[todo, d])]
                    fit = row if fit is None else fit & row
                hit = fit.any(axis=1)
                out[todo[hit]] = at + np.unpackbits(fit[hit], axis=1).argmax(axis=1)
                todo = todo[~hit]
                if not len(todo):
                    break
        return out


def _first_slots(asked: DataFrame, slots: DataFrame) -> DataFrame:
    """The columns of DEMAND with a, b, node, gpu_idx of the first of ``slots`` (in order) that each demand fits."""
    ship(asked.sparkSession)
    sent = asked.sparkSession.sparkContext.broadcast(slots.toPandas())  # bounded: about BROADCAST_ROWS
    found: dict[bool, tuple[pd.DataFrame, FirstFit]] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for gpu in (True, False) if not found else ():
            mine = sent.value[sent.value["gpu"] == gpu]
            found[gpu] = mine, FirstFit(mine[["cpu", "ram", "vram", "cap"]].to_numpy(np.float64))
        for pdf in batches:
            for gpu, (mine, index) in found.items():
                part = pdf[pdf["_g"] == gpu]
                at = index.find(part[["_cpu", "_ram", "_vram", "_cap"]].to_numpy(np.float64))
                part = part[at >= 0]
                yield pd.concat([part[list(DEMAND)].reset_index(drop=True), mine.iloc[at[at >= 0]][["a", "b", "node", "gpu_idx"]].reset_index(drop=True)], axis=1)

    schema = StructType([*asked.select(*DEMAND).schema.fields, *slots.select("a", "b", "node", "gpu_idx").schema.fields])
    return asked.select(*DEMAND, "_g", "_cpu", "_ram", "_vram", "_cap").mapInPandas(run, schema)


def blocked_summary(jobs: DataFrame, gpus: DataFrame, max_util: int | None = None) -> DataFrame:
    """reason, node, jobs: how many queued jobs a reason keeps from a GPU of a node.

    Each reason compares one number of a demand with one of a node, so no demand meets a node: the jobs' numbers and the nodes' limits are
    read in one order, and how many jobs lie above a limit is their count less the running sum up to it. A node's limit is that of
    the strictest of its GPUs. Work grows with jobs plus nodes.
    """
    has, queued = set(gpus.columns), jobs.filter("status = 'queued'")
    needs_gpu, est = F.coalesce("est_vram_mb", F.lit(1)) > 0, F.coalesce("est_vram_mb", F.lit(0))
    numbers = {"all": F.lit(0), "pin": F.when(F.col("require_node").isNotNull(), 0), "cpu": F.col("cpu_cores"), "ram": F.coalesce("ram_mb", F.lit(0)), "gpu": F.when(needs_gpu, est)}
    told = queued.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("double").alias("at")) for k, v in numbers.items()])).alias("x")).select("x.*")
    counts = stored(told.filter("at is not null").groupBy("kind", "at").agg(F.count(F.lit(1)).alias("n")))
    always = lambda broken: F.when(F.bool_or(broken), -1)  # noqa: E731  below every job's number
    left = F.min(F.col("total_mb") - F.col("used_mb"))
    limits = [
        ("down", "all", always(~F.col("alive"))),
        ("pinned elsewhere", "pin", F.lit(-1)),
        ("cpu", "cpu", F.min("free_cpu")),
        ("load", "all", always(F.col("load1") >= F.col("total_cpu")) if {"load1", "total_cpu"} <= has else None),
        ("running cap", "all", always(F.col("running") >= F.col("max_concurrent_running")) if {"running", "max_concurrent_running"} <= has else None),
        ("ram", "ram", F.min("budget_mb" if "budget_mb" in has else "free_ram_mb")),
        ("vram cap", "gpu", F.when(F.min("max_vram_per_task") < 1, -1).otherwise(F.min("max_vram_per_task")) if "max_vram_per_task" in has else None),
        ("vram", "gpu", left - MARGIN_MB),
        ("vram frozen", "gpu", always((F.col("used_mb") > 0) & (F.col("used_mb") >= F.floor(F.col("total_mb") / 3) + FREEZE_EXTRA_MB))),
        ("gpu busy", "gpu", always(F.col("util_pct") >= max_util) if max_util is not None else None),
    ]
    tries = F.array(*[F.struct(F.lit(reason).alias("reason"), F.lit(kind).alias("kind"), F.col(f"_{i}").cast("double").alias("at")) for i, (reason, kind, limit) in enumerate(limits) if limit is not None])
    nodes = gpus.groupBy("node").agg(*[limit.alias(f"_{i}") for i, (_, _, limit) in enumerate(limits) if limit is not None])
    asks = nodes.select("node", F.explode(tries).alias("x")).select("node", "x.*").filter("at is not null").withColumn("ask", F.lit(1))
    read = running(counts.withColumn("ask", F.lit(0)).unionByName(asks, allowMissingColumns=True), ["kind"], ["at", "ask"], F.col("n"), "sum", "below")
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))  # five rows
    found = read.filter("ask = 1").join(totals, "kind").withColumn("jobs", F.col("total") - F.col("below"))
    own = queued.filter("require_node is not null").groupBy(F.col("require_node").alias("node")).agg(F.count(F.lit(1)).alias("own"))
    found = found.join(own, "node", "left").withColumn("jobs", F.col("jobs") - F.when(F.col("reason") == "pinned elsewhere", F.coalesce("own", F.lit(0))).otherwise(0))
    return found.filter("jobs > 0").select("reason", "node", "jobs")


def effective_free(gpus: DataFrame, claims: DataFrame, now: Column, ttl_s: int = 3600) -> DataFrame:
    """node, gpu_idx, free_cpu, free_ram_mb, free_vram_mb less claims (node, gpu_idx, cpu, ram_mb, vram_mb, claimed_at, pid)
    that have no process yet and aren't expired."""
    live = claims.filter(F.col("pid").isNull() & (seconds_between(F.col("claimed_at"), now) <= ttl_s))
    by_node = live.groupBy("node").agg(F.sum("cpu").alias("_c"), F.sum("ram_mb").alias("_r"))
    by_gpu = live.groupBy("node", "gpu_idx").agg(F.sum("vram_mb").alias("_v"))
    less = lambda have, taken: F.greatest(F.lit(0), have - F.coalesce(taken, F.lit(0))).cast("bigint")
    joined = gpus.join(by_node, "node", "left").join(by_gpu, ["node", "gpu_idx"], "left")
    return joined.select("node", "gpu_idx", less(F.col("free_cpu"), F.col("_c")).alias("free_cpu"), less(F.col("free_ram_mb"), F.col("_r")).alias("free_ram_mb"), less(F.col("total_mb") - F.col("used_mb"), F.col("_v")).alias("free_vram_mb"))


def older_blockers(intents: DataFrame, now: Column, wait_s: int = 1800) -> DataFrame:
    """job_id, blocker_id: for each intent (job_id, node, ts, cpu, free_cpu, resource) the oldest older one of its node that could
    run now, or has waited over ``wait_s`` for the same resource. Without ``resource`` all compete.

    Only the first such one can be it, so two running minima, of the node and of the resource, answer for all.
    """
    rows = intents if "resource" in intents.columns else intents.withColumn("resource", F.lit(""))
    me = F.struct("ts", "job_id")
    fits, waits = F.col("cpu") <= F.col("free_cpu"), seconds_between(F.col("ts"), now) > wait_s
    rows = running(rows, ["node"], ["ts", "job_id"], F.when(fits, me), "min", "_fits", own=False)
    rows = running(rows, ["node", "resource"], ["ts", "job_id"], F.when(waits, me), "min", "_waits", own=False)
    first = F.coalesce(F.least("_fits", "_waits"), "_fits", "_waits")
    return rows.withColumn("_b", first).filter("_b is not null").select("job_id", F.col("_b.job_id").alias("blocker_id"))


def eviction_candidates(gpus: DataFrame, jobs: DataFrame, order: str = "longest") -> DataFrame:
    """node, gpu_idx, job_id: on GPUs past the freeze line with two jobs at least, the one with the longest ETA (or youngest)."""
    full = gpus.filter(F.col("used_mb") >= F.floor(F.col("total_mb") / 3) + FREEZE_EXTRA_MB).select("node", "gpu_idx")
    by = F.struct("eta_seconds", "job_id") if order == "longest" else F.struct("started_at", "job_id")
    on = jobs.filter("status = 'running'").join(full, ["node", "gpu_idx"])
    return on.groupBy("node", "gpu_idx").agg(F.count(F.lit(1)).alias("n"), F.max_by("job_id", by).alias("job_id")).filter("n >= 2").drop("n")


def rebalance_candidates(jobs: DataFrame, load: DataFrame, now: Column | None = None, min_eta: int = 300, max_ckpt_mb: int = 2048, cooldown_s: int = 1800, max_cwd_mb: int = 1024) -> DataFrame:
    """source, target, job_id: from nodes with over 600 s and twice a target's load (which is under 600 s), the movable job
    with the longest ETA; the least loaded target. load: node, eta_load.

    Movable: running, on the node by no more than a preference (no require_node), not adopted, with ``min_eta`` seconds left; and, where
    ``jobs`` tells, a checkpoint (ckpt_mb) of ``max_ckpt_mb`` and a working folder (cwd_mb) of ``max_cwd_mb`` at most and no move (moved_at)
    within ``cooldown_s``.
    """
    least = load.filter("eta_load < 600").agg(F.min(F.struct("eta_load", "node")).alias("t")).select("t.*").toDF("t_load", "target")
    pairs = load.join(F.broadcast(least), (F.col("eta_load") > 2 * F.col("t_load")) & (F.col("eta_load") > 600)).select(F.col("node").alias("source"), "target")  # one row
    movable = jobs.filter((F.col("status") == "running") & F.col("require_node").isNull() & ~F.coalesce("auto_adopted", F.lit(False)) & (F.col("eta_seconds") >= min_eta))
    for column, most in (("ckpt_mb", max_ckpt_mb), ("cwd_mb", max_cwd_mb)):
        if column in jobs.columns:
            movable = movable.filter(F.coalesce(column, F.lit(0)) <= most)
    if "moved_at" in jobs.columns:
        movable = movable.filter(F.coalesce(seconds_between(F.col("moved_at"), F.current_timestamp() if now is None else now) >= cooldown_s, F.lit(True)))
    best = movable.groupBy(F.col("node").alias("source")).agg(F.max_by("job_id", F.struct("eta_seconds", "job_id")).alias("job_id"))
    return pairs.join(best, "source").select("source", "target", "job_id")


def shard_quotas(weights: DataFrame, total: int) -> DataFrame:
    """node, start, end, waves, workers: contiguous shards in proportion to free cores, by largest remainder; none for 0 cores.

    Works on the small table of nodes.
    """
    w = weights.filter("weight > 0")
    everything = W.partitionBy(F.lit(1))
    share = w.withColumn("_x", F.lit(total) * F.col("weight") / F.sum("weight").over(everything)).withColumn("_n", F.floor("_x"))
    order = W.partitionBy(F.lit(1)).orderBy(F.desc(F.col("_x") - F.col("_n")), "node")
    filled = share.withColumn("_left", F.lit(total) - F.sum("_n").over(everything)).withColumn("_rn", F.row_number().over(order))
    sized = filled.withColumn("n", F.col("_n") + (F.col("_rn") <= F.col("_left")).cast("bigint"))
    placed = sized.withColumn("end", F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("node")))
    waves = F.ceil(F.col("n") / F.col("weight"))
    return placed.filter("n > 0").select("node", (F.col("end") - F.col("n")).alias("start"), "end", waves.cast("bigint").alias("waves"), F.ceil(F.col("n") / waves).cast("bigint").alias("workers"))


def assign_shards(df: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """``key`` and node: rows in order of a unique key, in contiguous shards in proportion to weights (node, weight).

    Rows are cut into ranges of the key by Spark's range partitioning and written with their range's number; counts of the ranges
    give offsets, so the order is global without one task sorting it all, and the same if tasks are run again.
    """
    ranged = stored(df.select(key).repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_from", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_from")
    quotas = shard_quotas(weights, ranged.count())
    pos = ranged.withColumn("_rn", F.row_number().over(W.partitionBy("_p").orderBy(key))).join(offsets, "_p").withColumn("_pos", F.col("_from") + F.col("_rn") - 1)
    placed = [pos.join(part, (F.col("_pos") >= F.col("start")) & (F.col("_pos") < F.col("end"))) for part in broadcast_blocks(quotas, "node")]
    return reduce(DataFrame.unionByName, placed).select(key, "node")


def concurrency_timeline(jobs: DataFrame) -> DataFrame:
    """node, ts, running after each start and finish; a finish counts before a start at the same time."""
    starts = jobs.select("node", F.col("started_at").alias("ts"), F.lit(1).alias("d"), "job_id")
    ends = jobs.select("node", F.col("finished_at").alias("ts"), F.lit(-1).alias("d"), "job_id")
    changes = starts.unionByName(ends).filter("ts is not null")
    return running(changes, ["node"], ["ts", "d", "job_id"], F.col("d"), "sum", "running")


def peak_concurrency(jobs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, peak: the most jobs that ran at once. With ``nodes`` (node, max_concurrent_running) also limit and over (by how many it
    was passed, 0 if it wasn't; null without a limit)."""
    peaks = concurrency_timeline(jobs).groupBy("node").agg(F.max("running").alias("peak"))
    if nodes is None:
        return peaks
    limit = F.col("max_concurrent_running")
    return peaks.join(nodes.select("node", "max_concurrent_running"), "node", "left").select("node", "peak", limit.alias("limit"), F.when(limit.isNotNull(), F.greatest(F.lit(0), F.col("peak") - limit)).alias("over"))


def minute_rollup(samples: DataFrame, width: str = "60 seconds") -> DataFrame:
    """node, minute, max_vram_mb, sum_ram_mb, jobs (distinct) of each minute.

    Jobs are told apart by a first aggregation to a row each, so counting them is exact on streams too, and a busy node is many tasks' work.
    """
    each = samples.groupBy("node", F.window("ts", width).alias("w"), "job_id").agg(F.max("vram_mb").alias("_v"), F.sum("ram_mb").alias("_r"))
    rows = each.groupBy("node", "w").agg(F.max("_v").alias("max_vram_mb"), F.sum("_r").alias("sum_ram_mb"), F.count("job_id").alias("jobs"))
    return rows.select("node", F.col("w.start").alias("minute"), "max_vram_mb", "sum_ram_mb", "jobs")
