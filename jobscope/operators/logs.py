"""Progress and remaining time from log lines: one pass of regular expressions a line, one small row a job shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions import clock_seconds, seconds_between

# The log formats understood, in order of precedence.
PAIR_PATTERNS = [
    r"(\d+)\s*/\s*(\d+)\s*\[[^\]]*?(\d+(?:\.\d+)?)\s*it/s",
    r"(\d+)\s*/\s*(\d+)\s*\[[^\]]*?(\d+(?:\.\d+)?)\s*s/it",
    r"\[Epoch\s+(\d+)\s*/\s*(\d+)\]",
    r"(?:^|\s)Epoch[:\s]+(\d+)\s*/\s*(\d+)\b",
    r"(?:^|\s)(?:Iter|Step|step|iter)[:\s]+(\d+)\s*(?:/|of)\s*(\d+)\b",
    r"(?:^|[\s(])(\d+)\s*/\s*(\d+)\s*(?:done|complete|completed|\))",
    r"^\s*\[\s*(\d+)\s*/\s*(\d+)\s*\]",
]
BAR_PATTERN = r"\[\s*(\S+?)\s*<\s*(\S+?)\s*,\s*[\d.?]+\s*(?:it/s|s/it)(?:\s*,[^\]]*)?\s*\]"
INLINE_PATTERN = r"(?i)(?:^|[\s,(])ETA\s*[:=]?\s*(\d+(?:\.\d+)?)\s*([smhd])\b"
TOTAL_FLAGS = [
    r"--max[_-]?iters[=\s]+(\d+)",
    r"--n[_-]?epochs[=\s]+(\d+)",
    r"--num[_-]?epochs[=\s]+(\d+)",
    r"--epochs[=\s]+(\d+)",
    r"--max[_-]?steps[=\s]+(\d+)",
    r"--total[_-]?steps[=\s]+(\d+)",
    r"--n[_-]?steps[=\s]+(\d+)",
    r"--num[_-]?steps[=\s]+(\d+)",
    r"--num[_-]?iters[=\s]+(\d+)",
    r"--iterations[=\s]+(\d+)",
]
CURRENT_PATTERNS = [
    r"(?:^|[^\w])Iter\s+(\d+)(?:\s|$|[|,])",
    r"(?:^|[^\w])Iteration\s+(\d+)(?:\s|$|[|,])",
    r"(?:^|[^\w])Epoch\s+(\d+)(?:\s|$|[|,:])",
    r"(?:^|[^\w])Step\s+(\d+)(?:\s|$|[|,])",
    r"(?:^|[^\w])step\s+(\d+)(?:\s|$|[|,])",
]


def _number(text: Column, pattern: str) -> Column:
    """The first group of the leftmost match as bigint, or null."""
    return F.regexp_extract(text, pattern, 1).try_cast("bigint")


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


#: A piece of text without which a pattern can't match; looked for before the regular expression is run.
PAIR_NEEDS = ["it/s", "s/it", "[Epoch", "Epoch", None, None, "["]
CURRENT_NEEDS = ["Iter", "Iteration", "Epoch", "Step", "step"]
TOTAL_NEEDS = ["iter", "epoch", "epoch", "epoch", "step", "step", "step", "step", "iter", "iter"]


def _guarded(line: Column, need: str | None, value: Column) -> Column:
    return value if need is None else F.when(line.contains(need), value)


def _with_bars(lines: DataFrame) -> DataFrame:
    """``lines`` with _bars: struct(elapsed, remaining) of each bar, clocks in seconds, null where they say nothing.

    Bars are looked for once; their clocks are read from the short pieces found.
    """
    found = lines.withColumn("_bars", F.when(F.col("line").contains("<"), F.regexp_extract_all("line", F.lit(BAR_PATTERN), F.lit(0))))
    clock = lambda b, g: clock_seconds(F.regexp_extract(b, BAR_PATTERN, g))
    return found.withColumn("_bars", F.transform("_bars", lambda b: F.struct(clock(b, 1).alias("elapsed"), clock(b, 2).alias("remaining"))))


def _with_inline(lines: DataFrame) -> DataFrame:
    """``lines`` with inline: seconds of the last ``ETA``, cut to whole ones."""
    found = lines.withColumn("inline", F.when(F.lower("line").contains("eta"), _last(F.regexp_extract_all("line", F.lit(INLINE_PATTERN), F.lit(0)))))
    n, unit = F.regexp_extract("inline", INLINE_PATTERN, 1), F.lower(F.regexp_extract("inline", INLINE_PATTERN, 2))
    scale = F.when(unit == "s", 1.0).when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86400.0)
    return found.withColumn("inline", F.when(F.col("inline").isNotNull(), (n.try_cast("double") * scale).cast("bigint")))


def _with_pair(lines: DataFrame) -> DataFrame:
    """``lines`` with pair_current and pair_total, by the first pattern whose match is valid.

    Each pattern is run once; its two numbers are the first two runs of digits in the piece that it finds.
    """
    line, out = F.col("line"), lines
    may = line.contains("/") | line.contains("of")
    more = {4: line.contains("ter") | line.contains("tep"), 5: line.contains(")") | line.contains("done") | line.contains("complete")}
    for k, (need, p) in enumerate(zip(PAIR_NEEDS, PAIR_PATTERNS)):
        out = out.withColumn(f"_p{k}", F.when(may & more.get(k, F.lit(True)), _guarded(line, need, F.regexp_extract(line, p, 0))))
    current, total = (F.lit(None).cast("bigint") for _ in range(2))
    for k in reversed(range(len(PAIR_PATTERNS))):
        out = out.withColumn(f"_p{k}", F.when(F.col(f"_p{k}") != "", F.regexp_extract_all(f"_p{k}", F.lit(r"\d+"), F.lit(0))))
        c, t = (F.get(f"_p{k}", F.lit(i)).try_cast("bigint") for i in (0, 1))
        valid = (t > 0) & (c >= 0) & (c <= t)
        current, total = F.when(valid, c).otherwise(current), F.when(valid, t).otherwise(total)
    return out.withColumn("pair_current", current).withColumn("pair_total", total).drop(*[f"_p{k}" for k in range(len(PAIR_PATTERNS))])


def line_current(line: Column) -> Column:
    return F.coalesce(*[_guarded(line, need, _number(line, p)) for need, p in zip(CURRENT_NEEDS, CURRENT_PATTERNS)])


def command_total(cmd: Column) -> Column:
    """A command's loop total: the first flag, in order, with a positive value."""
    tries = F.array(*[_guarded(cmd, need, _number(cmd, p)) for need, p in zip(TOTAL_NEEDS, TOTAL_FLAGS)])
    return F.get(F.filter(tries, lambda n: n > 0), F.lit(0))


def _latest(lines: DataFrame, *columns: str) -> DataFrame:
    """job_id and, of each column, the latest value that isn't null. All are numbers, so lines are hashed and not sorted."""
    return lines.groupBy("job_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns])


def _remaining(lines: DataFrame) -> DataFrame:
    return lines.withColumn("remaining", _last(F.filter(F.transform("_bars", lambda b: b["remaining"]), lambda r: r.isNotNull())))


def _both(lines: DataFrame) -> DataFrame:
    both = lines.withColumn("_both", _last(F.filter("_bars", lambda b: b["elapsed"].isNotNull() & b["remaining"].isNotNull())))
    return both.withColumn("both_elapsed", F.col("_both.elapsed")).withColumn("both_remaining", F.col("_both.remaining"))


def line_signals(lines: DataFrame) -> DataFrame:
    """``lines`` with what each tells: remaining, both_elapsed and both_remaining, inline, pair_current and pair_total, current."""
    told = _with_pair(_with_inline(_both(_remaining(_with_bars(lines))))).withColumn("current", line_current(F.col("line")))
    return told.drop("_bars", "_both")


#: Bytes of lines for each core up to which they are dealt out anew before they are parsed.
SPREAD_BYTES = 64 << 20


def _spread(lines: DataFrame) -> DataFrame:
    """``lines`` over all cores where there are few enough of them to lie in a split or two: parsing is what costs, and one row group of
    lines would be parsed in one task. Large inputs, whose scan has many splits, stay as they are read; so do streams."""
    cores = lines.sparkSession.sparkContext.defaultParallelism
    if lines.isStreaming or int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > cores * SPREAD_BYTES:
        return lines
    return lines.repartition(cores)


def signals(log: DataFrame) -> DataFrame:
    """All signals of each job in one pass, see :func:`line_signals`; of each the latest line's that has one. ``seq`` numbers a job's
    lines; of lines that share a number any counts."""
    return _latest(line_signals(_spread(log.select("job_id", "seq", "line"))), "remaining", "both_elapsed", "both_remaining", "inline", "pair_current", "pair_total", "current")


def bar_remaining(log: DataFrame) -> DataFrame:
    """job_id, remaining_s: of the latest bar that knows it."""
    return _latest(_remaining(_with_bars(log)), "remaining").filter("remaining is not null").select("job_id", F.col("remaining").alias("remaining_s"))


def bar_elapsed_remaining(log: DataFrame) -> DataFrame:
    """job_id, elapsed_s, remaining_s: of the latest bar with both clocks."""
    found = _latest(_both(_with_bars(log)), "both_elapsed", "both_remaining").filter("both_elapsed is not null")
    return found.select("job_id", F.col("both_elapsed").alias("elapsed_s"), F.col("both_remaining").alias("remaining_s"))


def inline_eta(log: DataFrame) -> DataFrame:
    """job_id, eta_s: of the latest ``ETA 12.5m``."""
    return _latest(_with_inline(log), "inline").filter("inline is not null").select("job_id", F.col("inline").alias("eta_s"))


def progress_pairs(log: DataFrame) -> DataFrame:
    """job_id, current, total: of the latest line with a valid pair."""
    return _latest(_with_pair(log), "pair_current", "pair_total").filter("pair_total is not null").select("job_id", F.col("pair_current").alias("current"), F.col("pair_total").alias("total"))


def current_only(log: DataFrame) -> DataFrame:
    """job_id, current: of the latest bare counter."""
    return _latest(log.withColumn("current", line_current(F.col("line"))), "current").filter("current is not null")


def trained(log: DataFrame) -> DataFrame:
    """job_id, trained: whether any line tells progress."""
    lines = _with_pair(log).withColumn("current", line_current(F.col("line")))
    return lines.groupBy("job_id").agg(F.bool_or(F.col("pair_total").isNotNull() | F.col("current").isNotNull()).alias("trained"))


def total_from_command(jobs: DataFrame) -> DataFrame:
    """job_id, total_units of jobs whose command tells it."""
    # exploding no or one value evaluates it once; a filter on it would do so twice
    return jobs.select("job_id", F.explode(F.array_compact(F.array(command_total(F.col("cmd"))))).alias("total_units"))


def _with_progress(log: DataFrame, jobs: DataFrame) -> DataFrame:
    """``jobs`` with their signals and ``progress``: a pair, else the command's total (read for these jobs alone) with a bare counter within it."""
    joined = jobs.join(signals(log), "job_id", "left")
    joined = joined.withColumn("_total", F.when(F.col("pair_total").isNull() & F.col("current").isNotNull(), command_total(F.col("cmd"))))
    pair = F.when(F.col("pair_total").isNotNull(), F.struct(F.col("pair_current").alias("current"), F.col("pair_total").alias("total")))
    second = F.when(F.col("current") <= F.col("_total"), F.struct(F.col("current"), F.col("_total").alias("total")))
    return joined.withColumn("progress", F.coalesce(pair, second))


def progress(log: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, current, total of the jobs that have them."""
    return _if_known(_with_progress(log, jobs), F.col("progress"), F.col("progress.current"), F.col("progress.total"))


def _if_known(rows: DataFrame, known: Column, *columns: Column) -> DataFrame:
    """job_id and ``columns`` of the rows where ``known`` isn't null. A filter on it would evaluate what it is made of twice."""
    return rows.select("job_id", F.explode(F.array_compact(F.array(F.when(known.isNotNull(), F.struct(*columns))))).alias("_r")).select("job_id", "_r.*")


def estimate_eta(log: DataFrame, jobs: DataFrame, hist: DataFrame, now: Column) -> DataFrame:
    """job_id, eta_s, tier of every job: bar, inline, rate, history (EWMA less elapsed) or none (0). Needs started_at."""
    elapsed = F.greatest(F.lit(1.0), seconds_between(F.col("started_at"), now).cast("double"))
    joined = _with_progress(log, jobs).join(hist.select("signature", F.col("dur_s_ewma").alias("_ewma")), "signature", "left")
    rate = F.when(F.col("progress.current") >= 1, F.greatest(F.lit(0.0), (F.col("progress.total") - F.col("progress.current")) / (F.col("progress.current") / elapsed)).cast("bigint"))
    past = F.when(F.col("_ewma") > 0, F.greatest(F.lit(0.0), F.col("_ewma") - elapsed).cast("bigint"))
    tiers = {"bar": F.col("remaining"), "inline": F.col("inline"), "rate": rate, "history": past, "none": F.lit(0)}
    tier = F.lit(None).cast("string")
    for name, value in reversed(tiers.items()):
        tier = F.when(value.isNotNull(), name).otherwise(tier)
    return joined.select("job_id", F.coalesce(*tiers.values()).cast("bigint").alias("eta_s"), tier.alias("tier"))


def project_runtime(log: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """job_id, source, eta_s, total_s, current, total_units, unit_s of jobs with a signal."""
    elapsed = F.greatest(F.lit(0.0), F.coalesce(seconds_between(F.col("started_at"), now), F.lit(0)).cast("double"))
    said, c, t = F.coalesce("remaining", "inline"), F.col("progress.current"), F.col("progress.total")
    unit = F.when((c > 0) & (elapsed > 0), elapsed / c)
    total = F.coalesce((elapsed + said).cast("bigint"), (unit * t).cast("bigint"))
    source = F.when(F.col("remaining").isNotNull(), "bar").when(F.col("inline").isNotNull(), "inline").when(unit.isNotNull(), "rate")
    eta = F.when(said.isNotNull(), said).otherwise(F.greatest(F.lit(0.0), total - elapsed).cast("bigint"))
    columns = [source.alias("source"), eta.alias("eta_s"), total.alias("total_s"), c.alias("current"), t.alias("total_units"), F.when(said.isNotNull(), total / t).otherwise(unit).alias("unit_s")]
    return _if_known(_with_progress(log, jobs), source, *columns)


def project_from_test_log(log: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, source, eta_s, total_s from a trial run's log: the bar's own clocks, else a pair and observed_s. No inline tier."""
    c, t, seen = F.col("progress.current"), F.col("progress.total"), F.col("observed_s").cast("double")
    unit = F.when((c > 0) & (seen > 0), seen / c)
    bar_total = F.col("both_elapsed") + F.col("both_remaining")
    total = F.coalesce(bar_total, (unit * t).cast("bigint"))
    eta = F.coalesce(F.col("both_remaining"), F.greatest(F.lit(0.0), total - seen).cast("bigint"))
    source = F.when(bar_total.isNotNull(), "bar").when(unit.isNotNull(), "pair")
    return _if_known(_with_progress(log, jobs), source, source.alias("source"), eta.alias("eta_s"), total.alias("total_s"))


def seed_pending_eta(jobs: DataFrame, runtimes: DataFrame, hist: DataFrame) -> DataFrame:
    """Queued jobs without an ETA that get one: job_id, eta_s, eta_source (runtime by runtime_key, else duration_ewma by signature)."""
    waiting = jobs.filter("status = 'queued' and coalesce(eta_seconds, 0) <= 0")
    joined = waiting.join(runtimes.select("runtime_key", F.col("total_s").alias("_t")), "runtime_key", "left").join(hist.select("signature", F.col("dur_s_ewma").alias("_e")), "signature", "left")
    source = F.when(F.col("_t") > 0, "runtime").when(F.col("_e") > 0, "duration_ewma")
    eta = F.when(F.col("_t") > 0, F.col("_t")).otherwise(F.col("_e"))
    return joined.select("job_id", eta.cast("bigint").alias("eta_s"), source.alias("eta_source")).filter("eta_source is not null")


#: ``--name=value``, or ``--name value`` where the value isn't itself a flag; a number may be negative.
FLAG = r"(?:^|\s)--([A-Za-z][\w-]*)(?:=(\S+)|\s+(?!--?[A-Za-z])(\S+))"


def extract_flags(jobs: DataFrame) -> DataFrame:
    """job_id, flag, value of every ``--k=v`` and ``--k v`` in commands; a flag without a value is left out."""
    each = [F.regexp_extract_all("cmd", F.lit(FLAG), F.lit(g)) for g in (1, 2, 3)]
    both = F.arrays_zip(*[e.alias(n) for n, e in zip(("flag", "a", "b"), each)])
    return jobs.select("job_id", F.explode(both).alias("f")).select("job_id", "f.flag", F.coalesce(F.nullif("f.a", F.lit("")), F.col("f.b")).alias("value"))


def flag_values(jobs: DataFrame, flags: list[str] | None = None) -> DataFrame:
    """job_id, flags: a map of each flag (all, or the given ones) to its values, in the order in which the command has them."""
    each = [F.regexp_extract_all("cmd", F.lit(FLAG), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(*[e.alias(n) for n, e in zip(("flag", "a", "b"), each)])
    names = F.array_distinct(each[0])
    if flags is not None:
        names = F.filter(names, lambda n: n.isin(*flags))
    values = lambda n: F.transform(F.filter(zipped, lambda f: f["flag"] == n), lambda f: F.coalesce(F.nullif(f["a"], F.lit("")), f["b"]))
    return jobs.select("job_id", F.map_from_arrays(names, F.transform(names, values)).alias("flags"))


# What an environment's names look like, and those that callers may not set.
ENV_NAME, RESERVED_ENV = "^[A-Za-z_][A-Za-z0-9_]*$", ("CUDA_VISIBLE_DEVICES",)


def parse_env(rows: DataFrame, column: str = "env") -> DataFrame:
    """``rows`` with env_map and env_rejected from an array of ``KEY=VAL``: split at the first ``=``, the last of equal keys counts;
    rejected are those without one, with a malformed name or a reserved one."""
    name, value = (lambda e: F.substring_index(e, "=", 1)), (lambda e: F.substring(e, F.instr(e, "=") + 1, 1 << 30))
    good = lambda e: e.contains("=") & name(e).rlike(ENV_NAME) & ~name(e).isin(*RESERVED_ENV)
    kept = F.reverse(F.filter(column, good))
    first = F.filter(F.transform(kept, lambda e, i: F.struct(name(e).alias("key"), value(e).alias("value"), F.array_position(F.transform(kept, name), name(e)).alias("at"), i.alias("i"))), lambda s: s["at"] == s["i"] + 1)
    entries = F.transform(first, lambda s: F.struct(s["key"].alias("key"), s["value"].alias("value")))
    return rows.withColumn("env_map", F.map_from_entries(entries)).withColumn("env_rejected", F.filter(column, lambda e: ~good(e)))
