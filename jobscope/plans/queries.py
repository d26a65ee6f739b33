"""One registered query an operator, each over whole tables, with the same in DuckDB's SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope import sources
from jobscope.operators import capacity, failures, history, integrity, logs, views
from jobscope.plans.fixtures import view, with_views
from jobscope.shipping import ship
from jobscope.storage import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def now() -> Column:
    return F.lit("1998-08-02 00:00:00").cast("timestamp")


DUCK_NOW = "TIMESTAMP '1998-08-02 00:00:00'"


class Tables:
    """The views of one data folder, and what the operators need beyond them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"{name}_v")

    def runs(self) -> DataFrame:
        """Jobs that ended, as runs with peaks."""
        ended = self.jobs.filter("status in ('done', 'failed')")
        return ended.withColumn("finished_at", _finish()).withColumnsRenamed({"peak_vram_mb": "vram_mb", "peak_ram_mb": "ram_mb"})

    def timed(self) -> DataFrame:
        """All jobs with started_at, finished_at, eta_seconds and the fields that the views have no data for."""
        late = {"est_vram_mb": "bigint", "require_node": "string", "auto_adopted": "boolean", "eta_source": "string", "slurm_job_id": "string", "slurm_state": "string", "current_vram_mb": "bigint", "current_ram_mb": "bigint", "submitted_by": "string"}
        jobs = self.jobs.withColumns({c: F.lit(None).cast(t) for c, t in late.items()})
        return jobs.withColumn("started_at", F.col("submitted_at")).withColumn("finished_at", F.when(F.col("status").isin("done", "failed"), _finish())).withColumn("eta_seconds", F.when(F.col("status") == "running", F.col("dur_s"))).withColumn("ram_mb", F.col("peak_ram_mb"))

    def ewma(self) -> DataFrame:
        return history.duration_ewma(self.runs())


def _finish() -> Column:
    return F.timestamp_seconds(F.unix_timestamp("submitted_at") + F.col("dur_s"))


#: What Tables.runs, timed and ewma are in SQL.
RUNS = "SELECT *, submitted_at + to_seconds(dur_s) AS finished_at, peak_vram_mb AS vram_mb, peak_ram_mb AS ram_mb FROM jobs_v WHERE status IN ('done', 'failed')"
TIMED = "SELECT *, submitted_at AS started_at, CASE WHEN status IN ('done', 'failed') THEN submitted_at + to_seconds(dur_s) END AS finished_at, CASE WHEN status = 'running' THEN dur_s END AS eta_seconds FROM jobs_v"
LAST10 = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY finished_at DESC, job_id DESC) AS rn FROM ({RUNS})) WHERE rn <= 10"
HIST = f"SELECT signature, quantile_disc(vram_mb, 0.8) AS p80_vram_mb, quantile_disc(ram_mb, 0.8) AS p80_ram_mb, count(*) AS samples, max(finished_at) AS last_seen FROM ({LAST10}) GROUP BY signature"
EWMA = f"SELECT signature, CAST(floor(list_reduce(list(CAST(dur_s AS DOUBLE) ORDER BY finished_at, job_id), lambda a, x: a * 0.7 + x * 0.3) + 1e-6) AS BIGINT) AS dur_s_ewma FROM ({LAST10}) GROUP BY signature"
SECONDS = "CAST(epoch({b}) - epoch({a}) AS BIGINT)"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register


# views

query("flt1_status_view", "SELECT job_id, status FROM jobs_v WHERE status IN ('running', 'launching', 'queued')")(lambda t: views.status_view(t.jobs).select("job_id", "status"))
query("flt2_search", "SELECT job_id, signature FROM jobs_v WHERE contains(CAST(job_id AS VARCHAR), 'nation_1') OR contains(lower(project), 'nation_1') OR contains(lower(node), 'nation_1') OR contains(lower(signature), 'nation_1')")(lambda t: views.search(t.jobs, " Nation_1").select("job_id", "signature"))
query("flt3_match_signature", "SELECT job_id, signature FROM jobs_v WHERE starts_with(signature, 'BUILDING/')")(lambda t: views.match_signature(t.jobs, "BUILDING/*").select("job_id", "signature"))
query("flt3_match_signature_inner", "SELECT job_id, signature FROM jobs_v WHERE contains(signature, '/NATION_1/c1')")(lambda t: views.match_signature(t.jobs, "*/NATION_1/c1*").select("job_id", "signature"))
query("flt4_pick_jobs", "SELECT job_id, status FROM jobs_v WHERE job_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")(lambda t: views.pick_jobs(t.jobs, t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("job_id"))).select("job_id", "status"))
query("flt5_by_lifetime", f"SELECT job_id, dur_s FROM ({TIMED}) WHERE dur_s >= 50000 AND status = 'failed' AND finished_at >= TIMESTAMP '1996-01-01'")(lambda t: views.by_lifetime(t.timed(), 50000, F.lit("1996-01-01").cast("timestamp"), "failed").select("job_id", "dur_s"))
query("flt9_sort_jobs", "SELECT job_id, priority, submitted_at FROM jobs_v ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, submitted_at, job_id LIMIT 100")(lambda t: views.sort_jobs(t.timed(), "priority", limit=100).select("job_id", "priority", "submitted_at"))
query("flt9_sort_by_vram", "SELECT job_id, peak_vram_mb FROM jobs_v ORDER BY peak_vram_mb DESC, job_id LIMIT 50")(lambda t: views.sort_jobs(t.timed(), "vram", limit=50).select("job_id", "peak_vram_mb"))
# what each key orders by, largest first where a table of jobs does so
_PRIORITY = "CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END"
_RUNTIME = f"-coalesce(CASE WHEN status = 'running' THEN CAST(epoch({DUCK_NOW}) - epoch(started_at) AS BIGINT) END, 0)"
_ORDERS = {"id": "job_id", "status": "status", "node": "node, gpu_idx", "project": "project", "owner": "node", "runtime": _RUNTIME, "ram": "-peak_ram_mb", "eta": "eta_seconds NULLS LAST"}
for _key, _order in _ORDERS.items():
    query(f"flt9_sort_by_{_key}", f"SELECT job_id FROM ({TIMED}) ORDER BY {_order}, job_id LIMIT 40")(lambda t, _key=_key: views.sort_jobs(t.timed().withColumn("eta_sort", F.col("eta_seconds")).withColumn("submitted_by", F.col("node")), _key, now(), limit=40).select("job_id"))
query("flt10_queue_head", "SELECT job_id, project, queue_pos FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, submitted_at, job_id) AS queue_pos FROM jobs_v WHERE status = 'queued') WHERE queue_pos <= 5")(lambda t: views.queue_head(t.jobs, 5).select("job_id", "project", "queue_pos"))
_DUCK_ELAPSED = f"CASE WHEN status = 'running' THEN CAST(epoch({DUCK_NOW}) - epoch(started_at) AS BIGINT) END"
query("flt11_eta_sort_seconds", f"SELECT job_id, CASE WHEN eta_seconds > 0 AND job_id % 3 = 0 THEN eta_seconds WHEN status = 'running' THEN CASE WHEN {_DUCK_ELAPSED} < dur_s_ewma THEN dur_s_ewma - {_DUCK_ELAPSED} END WHEN status = 'queued' THEN dur_s_ewma END AS eta_sort FROM ({TIMED}) LEFT JOIN ({EWMA}) USING (signature)")(
    lambda t: views.eta_sort_seconds(_some_eta(t.timed()), t.ewma(), now()).select("job_id", "eta_sort")
)


def _some_eta(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("eta_seconds", F.when(F.col("job_id") % 3 == 0, F.col("eta_seconds")))


def _duck_duration(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} < 0 THEN '-' WHEN {x} < 60 THEN concat(CAST({x} AS VARCHAR), 's') WHEN {x} < 3600 THEN printf('%.1fm', floor(({x} * 10 + 30) / 60) / 10.0) ELSE printf('%.1fh', floor(({x} * 10 + 1800) / 3600) / 10.0) END"


_DUCK_ETA_TEXT = f"""CASE WHEN eta > 0 THEN concat('~', {_duck_duration('eta')}, ' ?')
  WHEN status = 'running' AND dur_s_ewma IS NULL THEN concat({_duck_duration('el')}, '+')
  WHEN status = 'running' AND el >= dur_s_ewma THEN concat('+', {_duck_duration('(el - dur_s_ewma)')}, ' over')
  WHEN status = 'running' THEN concat('~', {_duck_duration('(dur_s_ewma - el)')}, ' (', CAST(CAST(floor(el * 100 / dur_s_ewma) AS BIGINT) AS VARCHAR), '%)')
  WHEN status = 'queued' THEN CASE WHEN dur_s_ewma IS NULL THEN '?' ELSE concat('~', {_duck_duration('dur_s_ewma')}) END
  ELSE {_duck_duration('dur_s')} END"""
_SHOWN = f"SELECT *, CASE WHEN job_id % 3 = 0 THEN eta_seconds END AS eta, {_DUCK_ELAPSED} AS el FROM ({TIMED}) LEFT JOIN ({EWMA}) USING (signature)"
query("flt8_eta_display", f"SELECT job_id, {_DUCK_ETA_TEXT} AS eta_text FROM ({_SHOWN})")(lambda t: views.eta_display(_some_eta(t.timed()), t.ewma(), now()).select("job_id", "eta_text"))
query("flt6_display_rows", f"""SELECT job_id, status, CASE WHEN job_id % 13 = 0 THEN concat(node, ':SLURM-GPU', CAST(gpu_idx AS VARCHAR), '#s', CAST(job_id AS VARCHAR), CASE WHEN job_id % 2 = 0 THEN ':RUNNING' ELSE ':?' END) ELSE concat(node, ':GPU', CAST(gpu_idx AS VARCHAR)) END AS place,
  CASE WHEN status = 'running' THEN {_duck_duration('el')} ELSE '-' END AS runtime,
  CASE WHEN peak_vram_mb > 0 THEN printf('%.1fG', floor((peak_vram_mb * 10 + 512) / 1024) / 10.0) ELSE '-' END AS vram, CASE WHEN peak_ram_mb > 0 THEN printf('%.1fG', floor((peak_ram_mb * 10 + 512) / 1024) / 10.0) ELSE '-' END AS ram,
  {_DUCK_ETA_TEXT} AS eta_text FROM ({_SHOWN})""")(lambda t: views.display_rows(_on_slurm(_some_eta(t.timed())), t.ewma(), now()))


def _on_slurm(jobs: DataFrame) -> DataFrame:
    there = F.col("job_id") % 13 == 0
    return jobs.withColumn("slurm_job_id", F.when(there, F.concat(F.lit("s"), F.col("job_id")))).withColumn("slurm_state", F.when(there & (F.col("job_id") % 2 == 0), "RUNNING"))



query("src4_read_log_lines", """WITH l AS (SELECT job_id, seq, CASE seq % 4 WHEN 0 THEN [line, concat('next ', line)] WHEN 2 THEN [line, ''] ELSE [line] END AS p FROM log_v), u AS (SELECT job_id, seq, unnest(p) AS line, generate_subscripts(p, 1) AS k FROM l)
  SELECT CAST(job_id AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq, k) - 1 AS seq, line FROM u""")(lambda t: sources.read_log_lines(t.spark, f"{_log_files(t)}/*/*.txt", "job_id=([^/]*)/"))


def _log_files(t: Tables) -> str:
    """A folder with a log file for each job, whose lines have all kinds of ends."""
    line = F.col("line")
    ended = F.when(F.col("seq") % 4 == 0, F.concat(line, F.lit("\rnext "), line)).when(F.col("seq") % 4 == 1, F.concat(line, F.lit("\r"))).when(F.col("seq") % 4 == 2, F.concat(line, F.lit("\x0b"))).otherwise(line)
    folder = new_folder(t.spark)
    t.log.withColumn("line", ended).repartition("job_id").sortWithinPartitions("job_id", "seq").select("line", "job_id").write.partitionBy("job_id").text(folder)
    return folder


query("src5_tail_lines", "SELECT job_id, seq, line FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM log_v) WHERE rn <= 20")(lambda t: views.tail_lines(t.log, 20))
query("src7_split_retention", f"SELECT job_id, finished_at FROM ({TIMED}) WHERE finished_at < TIMESTAMP '1998-01-01' - INTERVAL 7 DAYS")(lambda t: views.split_retention(t.timed(), F.lit("1998-01-01").cast("timestamp"))[0].select("job_id", "finished_at"))
query("src7_split_retention_rest", f"SELECT job_id, status FROM ({TIMED}) WHERE finished_at IS NULL OR finished_at >= TIMESTAMP '1998-01-01' - INTERVAL 7 DAYS")(lambda t: views.split_retention(t.timed(), F.lit("1998-01-01").cast("timestamp"))[1].select("job_id", "status"))
query("src8_cap_history", f"SELECT job_id, signature FROM ({RUNS}) WHERE signature IN (SELECT signature FROM ({RUNS}) GROUP BY signature ORDER BY max(finished_at) DESC, signature LIMIT 500)")(lambda t: views.cap_history(t.runs()).select("job_id", "signature"))

# logs

_P = "list_transform(string_split({x}, ':'), lambda y: TRY_CAST(y AS BIGINT))"


def _duck_clock(x: str) -> str:
    p = _P.format(x=x)
    return f"CASE WHEN len({p}) <= 4 AND len(list_filter({p}, lambda y: y IS NULL)) = 0 THEN list_extract({p}, -1) + 60 * coalesce(list_extract({p}, -2), 0) + 3600 * coalesce(list_extract({p}, -3), 0) + 86400 * coalesce(list_extract({p}, -4), 0) END"


def _duck_extract(line: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(regexp_extract({line}, '{pattern}', {group}) AS BIGINT)"


# The formats, written down for DuckDB apart from those of the operators.
_BAR = r"\[\s*(\S+?)\s*<\s*(\S+?)\s*,\s*[\d.?]+\s*(?:it/s|s/it)(?:\s*,[^\]]*)?\s*\]"
_INLINE = r"(?i)(?:^|[\s,(])ETA\s*[:=]?\s*(\d+(?:\.\d+)?)\s*([smhd])\b"
_PAIRS = [
    r"(\d+)\s*/\s*(\d+)\s*\[[^\]]*?(\d+(?:\.\d+)?)\s*it/s",
    r"(\d+)\s*/\s*(\d+)\s*\[[^\]]*?(\d+(?:\.\d+)?)\s*s/it",
    r"\[Epoch\s+(\d+)\s*/\s*(\d+)\]",
    r"(?:^|\s)Epoch[:\s]+(\d+)\s*/\s*(\d+)\b",
    r"(?:^|\s)(?:Iter|Step|step|iter)[:\s]+(\d+)\s*(?:/|of)\s*(\d+)\b",
    r"(?:^|[\s(])(\d+)\s*/\s*(\d+)\s*(?:done|complete|completed|\))",
    r"^\s*\[\s*(\d+)\s*/\s*(\d+)\s*\]",
]
_CURRENTS = [
    r"(?:^|[^\w])Iter\s+(\d+)(?:\s|$|[|,])", r"(?:^|[^\w])Iteration\s+(\d+)(?:\s|$|[|,])", r"(?:^|[^\w])Epoch\s+(\d+)(?:\s|$|[|,:])",
    r"(?:^|[^\w])Step\s+(\d+)(?:\s|$|[|,])", r"(?:^|[^\w])step\s+(\d+)(?:\s|$|[|,])",
]
_FLAGS = [
    r"--max[_-]?iters[=\s]+(\d+)", r"--n[_-]?epochs[=\s]+(\d+)", r"--num[_-]?epochs[=\s]+(\d+)", r"--epochs[=\s]+(\d+)", r"--max[_-]?steps[=\s]+(\d+)",
    r"--total[_-]?steps[=\s]+(\d+)", r"--n[_-]?steps[=\s]+(\d+)", r"--num[_-]?steps[=\s]+(\d+)", r"--num[_-]?iters[=\s]+(\d+)", r"--iterations[=\s]+(\d+)",
]
_LEGAL = "queued>launching queued>cancelled launching>running launching>queued launching>failed launching>cancelled running>done running>failed running>evicted running>cancelled evicted>queued failed>queued".split()
_E, _R = f"regexp_extract_all(line, '{_BAR}', 1)", f"regexp_extract_all(line, '{_BAR}', 2)"
_LINE_REMAINING = f"list_extract(list_filter(list_transform({_R}, lambda c: {_duck_clock('c')}), lambda v: v IS NOT NULL), -1)"
_N, _UNIT = f"list_extract(regexp_extract_all(line, '{_INLINE}', 1), -1)", f"lower(list_extract(regexp_extract_all(line, '{_INLINE}', 2), -1))"
_LINE_INLINE = f"CAST(trunc(TRY_CAST({_N} AS DOUBLE) * CASE {_UNIT} WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END) AS BIGINT)"
_LINE_PAIR = "coalesce(" + ", ".join(f"CASE WHEN {_duck_extract('line', p, 2)} > 0 AND {_duck_extract('line', p, 1)} <= {_duck_extract('line', p, 2)} THEN {{'c': {_duck_extract('line', p, 1)}, 't': {_duck_extract('line', p, 2)}}} END" for p in _PAIRS) + ")"
_LINE_CURRENT = "coalesce(" + ", ".join(_duck_extract("line", p) for p in _CURRENTS) + ")"
_TOTAL = "coalesce(" + ", ".join(f"CASE WHEN {_duck_extract('cmd', p)} > 0 THEN {_duck_extract('cmd', p)} END" for p in _FLAGS) + ")"


def _duck_latest(value: str) -> str:
    return f"SELECT job_id, arg_max(v, seq) AS v FROM (SELECT job_id, seq, {value} AS v FROM log_v) WHERE v IS NOT NULL GROUP BY job_id"


_SIGNALS = f"""SELECT j.*, r.v AS remaining, i.v AS inl, coalesce(p.v, CASE WHEN c.v <= {_TOTAL} THEN {{'c': c.v, 't': {_TOTAL}}} END) AS pr
  FROM ({TIMED}) j LEFT JOIN ({_duck_latest(_LINE_REMAINING)}) r USING (job_id) LEFT JOIN ({_duck_latest(_LINE_INLINE)}) i USING (job_id)
  LEFT JOIN ({_duck_latest(_LINE_PAIR)}) p USING (job_id) LEFT JOIN ({_duck_latest(_LINE_CURRENT)}) c USING (job_id)"""

query("log2_bar_remaining", f"SELECT job_id, v AS remaining_s FROM ({_duck_latest(_LINE_REMAINING)})")(lambda t: logs.bar_remaining(t.log))
query("log3_bar_elapsed_remaining", f"""SELECT job_id, v.e AS elapsed_s, v.r AS remaining_s FROM ({_duck_latest(f"list_extract(list_filter(list_transform(list_zip({_E}, {_R}), lambda z: {{'e': {_duck_clock('z[1]')}, 'r': {_duck_clock('z[2]')}}}), lambda b: b.e IS NOT NULL AND b.r IS NOT NULL), -1)")})""")(lambda t: logs.bar_elapsed_remaining(t.log))
query("log4_inline_eta", f"SELECT job_id, v AS eta_s FROM ({_duck_latest(_LINE_INLINE)})")(lambda t: logs.inline_eta(t.log))
query("log5_progress_pairs", f"SELECT job_id, v.c AS current, v.t AS total FROM ({_duck_latest(_LINE_PAIR)})")(lambda t: logs.progress_pairs(t.log))
query("log6_total_from_command", f"SELECT job_id, {_TOTAL} AS total_units FROM jobs_v WHERE {_TOTAL} IS NOT NULL")(lambda t: logs.total_from_command(t.jobs))
query("log7_current_only", f"SELECT job_id, v AS current FROM ({_duck_latest(_LINE_CURRENT)})")(lambda t: logs.current_only(t.log))
query("log8_progress", f"SELECT job_id, pr.c AS current, pr.t AS total FROM ({_SIGNALS}) WHERE pr IS NOT NULL")(lambda t: logs.progress(t.log, t.timed()))
_EL = f"greatest(1.0, CAST(epoch({DUCK_NOW}) - epoch(started_at) AS DOUBLE))"
_RATE = f"CASE WHEN pr.c >= 1 THEN CAST(trunc(greatest(0.0, (pr.t - pr.c) / (pr.c / {_EL}))) AS BIGINT) END"
_PAST = f"CASE WHEN dur_s_ewma > 0 THEN CAST(trunc(greatest(0.0, dur_s_ewma - {_EL})) AS BIGINT) END"
query("log9_estimate_eta", f"SELECT job_id, coalesce(remaining, inl, {_RATE}, {_PAST}, 0) AS eta_s, CASE WHEN remaining IS NOT NULL THEN 'bar' WHEN inl IS NOT NULL THEN 'inline' WHEN {_RATE} IS NOT NULL THEN 'rate' WHEN {_PAST} IS NOT NULL THEN 'history' ELSE 'none' END AS tier FROM ({_SIGNALS}) LEFT JOIN ({EWMA}) USING (signature)")(lambda t: logs.estimate_eta(t.log, t.timed(), t.ewma(), now()))
_EL0 = f"greatest(0.0, CAST(epoch({DUCK_NOW}) - epoch(started_at) AS DOUBLE))"
query("log10_project_runtime", f"""WITH s AS (SELECT *, coalesce(remaining, inl) AS said, {_EL0} AS el, CASE WHEN pr.c > 0 AND {_EL0} > 0 THEN {_EL0} / pr.c END AS u FROM ({_SIGNALS})),
  q AS (SELECT *, coalesce(CAST(trunc(el + said) AS BIGINT), CAST(trunc(u * pr.t) AS BIGINT)) AS tot FROM s)
  SELECT job_id, CASE WHEN remaining IS NOT NULL THEN 'bar' WHEN inl IS NOT NULL THEN 'inline' ELSE 'rate' END AS source,
  CASE WHEN said IS NOT NULL THEN said ELSE CAST(trunc(greatest(0.0, tot - el)) AS BIGINT) END AS eta_s, tot AS total_s, pr.c AS current, pr.t AS total_units,
  CASE WHEN said IS NOT NULL THEN tot / pr.t ELSE u END AS unit_s FROM q WHERE said IS NOT NULL OR u IS NOT NULL""")(lambda t: logs.project_runtime(t.log, t.timed(), now()))
query("log13_flag_values", "SELECT job_id, regexp_extract(cmd, 'seed ([0-9]+)', 1) AS seed, concat(regexp_extract(cmd, 'max_iters ([0-9]+)', 1), ',-0.5') AS iters FROM jobs_v")(
    lambda t: logs.flag_values(t.jobs.withColumn("cmd", F.concat("cmd", F.lit(" --max_iters=-0.5 --dry"))), ["seed", "max_iters"]).select("job_id", F.array_join(F.col("flags")["seed"], ",").alias("seed"), F.array_join(F.col("flags")["max_iters"], ",").alias("iters"))
)
query("log13_parse_env", "SELECT job_id, concat('a=', CAST(job_id AS VARCHAR)) AS a, CAST(2 AS INTEGER) AS rejected FROM jobs_v")(
    lambda t: logs.parse_env(t.jobs.withColumn("env", F.array(F.lit("A=x"), F.concat(F.lit("A=a="), F.col("job_id")), F.lit("1BAD=x"), F.lit("CUDA_VISIBLE_DEVICES=0")))).select("job_id", F.col("env_map")["A"].alias("a"), F.size("env_rejected").alias("rejected"))
)
query("log13_extract_flags", "SELECT job_id, f.flag AS flag, f.value AS value FROM (SELECT job_id, unnest([{'flag': 'seed', 'value': regexp_extract(cmd, 'seed ([0-9]+)', 1)}, {'flag': 'max_iters', 'value': regexp_extract(cmd, 'max_iters ([0-9]+)', 1)}]) AS f FROM jobs_v)")(lambda t: logs.extract_flags(t.jobs))

# history

query("agg1_run_peaks", "SELECT job_id, max(vram_mb) AS peak_vram_mb, max(ram_mb) AS peak_ram_mb FROM samples_v GROUP BY job_id")(lambda t: history.run_peaks(t.samples))
query("agg2_p80_history", HIST)(lambda t: history.p80_history(t.runs()))
query("agg4_duration_ewma", EWMA)(lambda t: t.ewma())
_PREFIX = "regexp_replace(signature, '/[^/]*$', '')"
_NAMED = "trim(concat(translate(node, '0123456789', 'abcdefghij'), ' trial'))"
_MED = "quantile_disc(p80_vram_mb, 0.5) AS {k}_v, quantile_disc(p80_ram_mb, 0.5) AS {k}_r"
_CASCADE = "CASE WHEN {e} IS NOT NULL THEN 'explicit' WHEN p80_{c}_mb IS NOT NULL THEN 'own' WHEN d_{x} IS NOT NULL THEN 'description' WHEN p_{x} IS NOT NULL THEN 'prefix' WHEN m_{x} IS NOT NULL THEN 'project' ELSE 'default' END"
query("agg6_estimate_resources", f"""WITH h AS (SELECT signature, {_PREFIX} AS pre, p80_vram_mb, p80_ram_mb FROM ({HIST})), p AS (SELECT pre, {_MED.format(k='p')} FROM h GROUP BY pre),
  m AS (SELECT split_part(pre, '/', 1) AS project, {_MED.format(k='m')} FROM h GROUP BY 1),
  n AS (SELECT DISTINCT signature, {_NAMED} AS named FROM ({RUNS})), d AS (SELECT named, {_MED.format(k='d')} FROM h JOIN n USING (signature) GROUP BY named)
  SELECT job_id, coalesce(e, p80_vram_mb, d_v, p_v, m_v, 512) AS vram_mb, {_CASCADE.format(e='e', c='vram', x='v')} AS level, coalesce(p80_ram_mb, d_r, p_r, m_r, 4096) AS ram_mb, {_CASCADE.format(e='NULL', c='ram', x='r')} AS ram_level, CAST(CASE WHEN job_id % 2 = 0 THEN cpu_cores ELSE 1 END AS BIGINT) AS cpu_cores
  FROM (SELECT *, {_NAMED} AS named, CASE WHEN job_id % 7 = 0 THEN (job_id % 5) * 1000 END AS e FROM (SELECT * REPLACE (CASE WHEN job_id % 11 = 0 THEN concat(project, '/x/y') WHEN job_id % 11 = 1 THEN 'new/x/y' ELSE signature END AS signature, CASE WHEN job_id % 11 = 1 THEN 'new' ELSE project END AS project, CASE WHEN job_id % 3 > 0 AND job_id % 11 < 2 THEN '' ELSE node END AS node) FROM jobs_v)) j
  LEFT JOIN h USING (signature) LEFT JOIN d USING (named) LEFT JOIN p ON p.pre = regexp_replace(j.signature, '/[^/]*$', '') LEFT JOIN m ON m.project = j.project""")(lambda t: history.estimate_resources(_asked(t), _described(t.runs())))


def _described(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("description", F.concat(F.translate("node", "0123456789", "abcdefghij"), F.lit(" trial "), F.col("job_id") % 10, F.lit(" seed="), F.col("job_id") % 5))


def _asked(t: Tables) -> DataFrame:
    """All jobs, some with new signatures, projects and descriptions, so that each level of the cascade is met."""
    new = F.when(F.col("job_id") % 11 == 0, F.concat("project", F.lit("/x/y"))).when(F.col("job_id") % 11 == 1, "new/x/y").otherwise(F.col("signature"))
    jobs = t.jobs.withColumn("signature", new).withColumn("project", F.when(F.col("job_id") % 11 == 1, "new").otherwise(F.col("project")))
    jobs = _described(jobs.withColumn("node", F.when((F.col("job_id") % 3 > 0) & (F.col("job_id") % 11 < 2), "").otherwise(F.col("node"))))
    return jobs.withColumn("est_vram_mb", F.expr("CASE WHEN job_id % 7 = 0 THEN (job_id % 5) * 1000 END").cast("bigint")).withColumn("est_cores", F.when(F.col("job_id") % 2 == 0, F.col("cpu_cores")))


query("agg7_estimate_outliers", f"WITH h AS (SELECT signature, {_PREFIX} AS pre, p80_vram_mb FROM ({HIST})), m AS (SELECT pre, quantile_disc(p80_vram_mb, 0.5) AS sibling_median FROM h GROUP BY pre) SELECT signature, p80_vram_mb, sibling_median FROM h JOIN m USING (pre) WHERE p80_vram_mb > 1.5 * sibling_median")(lambda t: history.estimate_outliers(history.p80_history(t.runs()), 1.5))
query("agg8_apply_corrections", f"SELECT signature, CASE WHEN length(signature) % 5 = 1 THEN 4096 ELSE p80_vram_mb END AS vram_mb FROM ({HIST}) WHERE length(signature) % 5 <> 0")(lambda t: _corrected(history.p80_history(t.runs())))
query("agg9_status_counts", "SELECT node, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("running", "launching", "queued", "done", "failed", "cancelled", "evicted")) + " FROM jobs_v GROUP BY node")(lambda t: history.status_counts(t.jobs))
query("agg9_event_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS cycle, status AS type, count(*) AS events FROM job_events_v GROUP BY 1, 2")(lambda t: history.event_counts(t.job_events.select("ts", F.col("status").alias("type")), "1 day"))
query("agg10_node_load", f"SELECT node, CAST(coalesce(sum(CASE WHEN status = 'running' THEN eta_seconds END), 0) AS BIGINT) AS eta_load FROM (SELECT DISTINCT node FROM gpus_v) LEFT JOIN ({TIMED}) USING (node) GROUP BY node")(lambda t: history.node_load(t.timed(), t.gpus))
query("agg11_batch_completion", "WITH g AS (SELECT CASE WHEN job_id % 500 = 7 THEN -job_id ELSE job_id END AS job_id, CASE WHEN status IN ('done', 'failed') THEN job_id % 250 ELSE job_id % 500 END AS batch FROM jobs_v), c AS (SELECT batch, count(status) AS jobs, count(*) FILTER (status IN ('done', 'failed')) AS finished FROM g LEFT JOIN jobs_v USING (job_id) GROUP BY batch) SELECT batch, CASE WHEN jobs = 0 THEN 2 WHEN jobs = finished THEN 0 ELSE 1 END AS state, jobs, finished FROM c")(
    lambda t: history.batch_completion(t.jobs, t.jobs.select(F.when(F.col("job_id") % 500 == 7, -F.col("job_id")).otherwise(F.col("job_id")).alias("job_id"), F.when(F.col("status").isin("done", "failed"), F.col("job_id") % 250).otherwise(F.col("job_id") % 500).alias("batch")))
)
#: Endings that the views' files don't have, and near misses.
_ENDINGS = ["pt", "pth", "pkl", "ckpt", "bin", "safetensors", "npy", "npz", "h5", "hdf5", "tar", "csv", "log", "ptx", "PT"]
query("agg12_latest_checkpoint", f"""SELECT dir, arg_max(path, (mtime, path)) AS path FROM (SELECT dir, mtime, is_dir, concat(regexp_replace(path, '[.][a-z]+$', '.'), ({_ENDINGS})[CAST(mtime % 15 + 1 AS BIGINT)]) AS path FROM files_v)
  WHERE NOT is_dir AND regexp_matches(path, '[.](pt|pth|pkl|ckpt|bin|safetensors|npy|npz|h5|hdf5|tar)$') GROUP BY dir""")(lambda t: history.latest_checkpoint(_ended(t.files)))


def _ended(files: DataFrame) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("mtime") % 15 + 1).cast("int"))
    return files.withColumn("path", F.concat(F.regexp_replace("path", "[.][a-z]+$", "."), ending))


_PASTS = f"SELECT *, list_sort(list(vram_mb) OVER (PARTITION BY signature ORDER BY finished_at, job_id ROWS BETWEEN {{a}} PRECEDING AND {{b}})) AS l FROM ({RUNS})"
query("agg13_estimate_backtest", f"SELECT percent, count(*) AS runs, count(*) FILTER (vram_mb > g) AS under, round(count(*) FILTER (vram_mb > g) / count(*), 6) AS under_rate FROM (SELECT vram_mb, p AS percent, l[CAST(ceil(len(l) * p / 100.0) AS BIGINT)] AS g FROM ({_PASTS.format(a=10, b='1 PRECEDING')}) CROSS JOIN (VALUES (50), (80), (95)) v(p)) WHERE g IS NOT NULL GROUP BY percent")(lambda t: history.estimate_backtest(t.runs()))


def _corrected(hist: DataFrame) -> DataFrame:
    old = hist.select("signature", F.col("p80_vram_mb").alias("vram_mb"))
    edits = old.filter(F.length("signature") % 5 <= 1).select("signature", F.when(F.length("signature") % 5 == 1, F.lit(4096)).cast("bigint").alias("vram_mb"))
    return history.apply_corrections(old, edits)


# joins

query("join2_duplicate_active", "SELECT job_id, k AS keep_id FROM (SELECT job_id, row_number() OVER w AS rn, first(job_id) OVER w AS k FROM jobs_v WHERE status IN ('running', 'queued') WINDOW w AS (PARTITION BY cmd, ckpt_dir ORDER BY CASE status WHEN 'running' THEN 0 ELSE 2 END, submitted_at, job_id)) WHERE rn > 1")(lambda t: integrity.duplicate_active(t.jobs))
query("join3_ckpt_conflicts", "SELECT job_id, ckpt_dir, signatures FROM jobs_v JOIN (SELECT ckpt_dir, count(DISTINCT signature) AS signatures FROM jobs_v WHERE status IN ('running', 'queued') GROUP BY ckpt_dir HAVING signatures > 1) USING (ckpt_dir) WHERE status IN ('running', 'queued')")(lambda t: integrity.ckpt_conflicts(t.jobs))
query("join3_ckpt_conflicts_strict", "SELECT job_id, ckpt_dir, signatures FROM jobs_v JOIN (SELECT ckpt_dir, count(DISTINCT signature) AS signatures FROM jobs_v WHERE status IN ('running', 'queued') GROUP BY ckpt_dir HAVING count(*) > 1) USING (ckpt_dir) WHERE status IN ('running', 'queued')")(lambda t: integrity.ckpt_conflicts(t.jobs, strict=True))
_PARTED = "CASE WHEN job_id % 7 < 5 THEN concat(ckpt_dir, '/', signature) ELSE ckpt_dir END"
query("join3_ckpt_conflicts_some", f"SELECT job_id, ckpt_dir, signatures FROM (SELECT * REPLACE ({_PARTED} AS ckpt_dir) FROM jobs_v) JOIN (SELECT {_PARTED} AS ckpt_dir, count(DISTINCT signature) AS signatures FROM jobs_v WHERE status IN ('running', 'queued') GROUP BY 1 HAVING signatures > 1) USING (ckpt_dir) WHERE status IN ('running', 'queued')")(lambda t: integrity.ckpt_conflicts(_own_folders(t.jobs)))
query("join3_ckpt_conflicts_strict_some", f"SELECT job_id, ckpt_dir, signatures FROM (SELECT * REPLACE ({_PARTED} AS ckpt_dir) FROM jobs_v) JOIN (SELECT {_PARTED} AS ckpt_dir, count(DISTINCT signature) AS signatures FROM jobs_v WHERE status IN ('running', 'queued') GROUP BY 1 HAVING count(*) > 1) USING (ckpt_dir) WHERE status IN ('running', 'queued')")(lambda t: integrity.ckpt_conflicts(_own_folders(t.jobs), strict=True))


def _own_folders(jobs: DataFrame) -> DataFrame:
    """Jobs of which most write to a folder that only their signature uses."""
    return jobs.withColumn("ckpt_dir", F.when(F.col("job_id") % 7 < 5, F.concat_ws("/", "ckpt_dir", "signature")).otherwise(F.col("ckpt_dir")))


query("join4_ckpt_overlaps", f"""WITH r AS (SELECT job_id, ckpt_dir, submitted_at AS a, submitted_at + to_seconds(dur_s * CASE WHEN job_id % 50 = 0 THEN 300 ELSE 5 END) AS b FROM ({RUNS}))
  SELECT x.job_id AS job_id, y.job_id AS other_id, x.ckpt_dir AS ckpt_dir, CAST(floor(epoch(least(x.b, y.b)) - epoch(y.a)) AS BIGINT) AS overlap_s FROM r x JOIN r y ON x.ckpt_dir = y.ckpt_dir AND (x.a, x.job_id) < (y.a, y.job_id) AND y.a < x.b""")(lambda t: integrity.ckpt_overlaps(_long_runs(t.runs())))


def _long_runs(runs: DataFrame) -> DataFrame:
    """Runs five times as long as they were, and of every fiftieth three hundred times, so months among hours."""
    length = F.col("dur_s") * F.when(F.col("job_id") % 50 == 0, 300).otherwise(5)
    return runs.withColumn("started_at", F.col("submitted_at")).withColumn("finished_at", F.timestamp_seconds(F.unix_timestamp("submitted_at") + length))


query("join4_ckpt_overlap_history", f"SELECT job_id, ckpt_dir FROM (SELECT *, max(finished_at) OVER (PARTITION BY ckpt_dir ORDER BY submitted_at, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM ({RUNS})) WHERE submitted_at < e")(lambda t: integrity.ckpt_overlap_history(t.runs().withColumn("started_at", F.col("submitted_at"))))
query("join5_untracked_processes", """WITH l AS (SELECT node, job_id AS pid, arg_max(pcpu, (ts, pcpu)) AS pcpu FROM samples_v GROUP BY node, job_id)
  SELECT node, pid, concat('unknown/auto-adopted/p', CAST(pid AS VARCHAR)) AS proposed FROM l WHERE pcpu >= 50 AND NOT EXISTS (SELECT 1 FROM jobs_v j WHERE j.node = l.node AND (j.job_id = l.pid OR j.job_id + 1 = l.pid))""")(
    lambda t: integrity.untracked_processes(
        t.samples.groupBy("node", "job_id").agg(F.max_by("pcpu", F.struct("ts", "pcpu")).alias("pcpu"), F.max("ts").alias("ts")).select("node", F.col("job_id").alias("pid"), "ts", "pcpu", F.lit(0).alias("gpu_mem_mb"), F.lit(None).cast("string").alias("cwd")),
        t.jobs.select("node", F.array("job_id", F.col("job_id") + 1).alias("remote_pids")),
    )
)
_UP = "LEFT JOIN (SELECT job_id AS j{k}, parent_id AS p{k} FROM jobs_v) ON {on} = j{k}"
_CHAINS = f"SELECT job_id, coalesce(j3, j2, j1, job_id) AS root_id, CAST((j1 IS NOT NULL)::INT + (j2 IS NOT NULL)::INT + (j3 IS NOT NULL)::INT AS INTEGER) AS depth FROM jobs_v {_UP.format(k=1, on='parent_id')} {_UP.format(k=2, on='p1')} {_UP.format(k=3, on='p2')}"
query("join6_retry_lineage", _CHAINS)(lambda t: integrity.retry_lineage(t.jobs))
query("join6_lineage", """WITH RECURSIVE p AS (SELECT job_id, CASE WHEN job_id % 7000 = 0 THEN job_id WHEN job_id % 3000 = 0 THEN job_id + 2 WHEN job_id % 1000 > 0 THEN job_id - 1 END AS up FROM jobs_v),
  q AS (SELECT p.job_id, u.job_id AS up FROM p LEFT JOIN (SELECT job_id FROM jobs_v) u ON p.up = u.job_id),
  r AS (SELECT job_id, job_id AS root_id, CAST(0 AS BIGINT) AS depth FROM q WHERE up IS NULL UNION ALL SELECT q.job_id, r.root_id, r.depth + 1 FROM r JOIN q ON q.up = r.job_id)
  SELECT job_id, root_id, depth, root_id IS NULL AS cyclic FROM q LEFT JOIN r USING (job_id)""")(lambda t: integrity.lineage(_long_chains(t.jobs)))


def _long_chains(jobs: DataFrame) -> DataFrame:
    """Chains of a thousand retries, some of which start in a circle of three or with a job that is its own parent."""
    j = F.col("job_id")
    return jobs.withColumn("parent_id", F.when(j % 7000 == 0, j).when(j % 3000 == 0, j + 2).when(j % 1000 > 0, j - 1))


query("join6_lineage_cost", f"SELECT root_id, count(*) AS attempts, CAST(sum(dur_s) AS BIGINT) AS total_s, arg_max(status, (depth, job_id)) AS final_status FROM ({_CHAINS}) JOIN (SELECT job_id, dur_s, status FROM jobs_v) USING (job_id) GROUP BY root_id")(lambda t: integrity.lineage_cost(t.jobs))


def _waiting(t: Tables) -> DataFrame:
    """Jobs that wait for two part files in their checkpoint folder."""
    p = F.col("job_id") % 2000 + 1
    path = lambda n: F.concat(F.lit("/ckpt/"), (n % 400).cast("string"), F.lit("/p"), n.cast("string"), F.element_at(F.array(*map(F.lit, (".csv", ".pt", ".safetensors", ".npz"))), (n % 4 + 1).cast("int")))
    return t.timed().withColumn("wait_for_files", F.when(F.col("job_id") % 3 > 0, F.array(path(p), path(p + 400))))


_PATH = "concat('/ckpt/', CAST(n % 400 AS VARCHAR), '/p', CAST(n AS VARCHAR), (['.csv', '.pt', '.safetensors', '.npz'])[n % 4 + 1])"
_WAITS = f"SELECT job_id, ckpt_dir, status, {_PATH} AS path FROM (SELECT *, unnest([job_id % 2000 + 1, job_id % 2000 + 401]) AS n FROM jobs_v WHERE job_id % 3 > 0)"
_MISSING = f"SELECT job_id, count(*) AS missing FROM ({_WAITS}) WHERE path NOT IN (SELECT path FROM files_v WHERE size > 0 AND NOT is_dir) GROUP BY job_id"
query("join7_artifact_gate", f"SELECT job_id, coalesce(missing, 0) > 0 AS blocked, coalesce(missing, 0) AS missing FROM jobs_v LEFT JOIN ({_MISSING}) USING (job_id) WHERE status = 'queued'")(lambda t: integrity.artifact_gate(_waiting(t), t.files))
query("join8_producers_of_blocked", f"SELECT job_id, ckpt_dir, status FROM jobs_v WHERE status IN ('running', 'queued') AND ckpt_dir IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM ({_WAITS}) JOIN ({_MISSING}) USING (job_id) WHERE status = 'queued')")(lambda t: integrity.producers_of_blocked(_waiting(t), t.files).select("job_id", "ckpt_dir", "status"))
query("join9_latest_by_key", "SELECT job_id, arg_max(status, event_id) AS status, max(event_id) AS event_id FROM job_events_v GROUP BY job_id")(lambda t: integrity.latest_by_key(t.job_events.select("job_id", "event_id", "status"), "job_id", "event_id"))
query("join10_snapshot_drift", "WITH e AS (SELECT DISTINCT node, signature, length(signature) AS d FROM jobs_v), a AS (SELECT DISTINCT node, CASE WHEN length(signature) % 5 = 0 THEN concat(signature, 'x') ELSE signature END AS signature, length(signature) + (length(signature) % 4 = 0)::INT AS d FROM jobs_v) SELECT node, signature, CASE WHEN e.d IS NULL THEN 'extra' WHEN a.d IS NULL THEN 'absent' WHEN e.d = a.d THEN 'current' ELSE 'stale' END AS state FROM e FULL JOIN a USING (node, signature)")(
    lambda t: integrity.snapshot_drift(
        t.jobs.select("node", "signature", F.length("signature").alias("digest")).distinct(),
        t.jobs.select("node", F.when(F.length("signature") % 5 == 0, F.concat("signature", F.lit("x"))).otherwise(F.col("signature")).alias("signature"), (F.length("signature") + (F.length("signature") % 4 == 0).cast("int")).alias("digest")).distinct(), ["node", "signature"],
    )
)
query("join1_run_identity", "SELECT sha256(concat(cmd, repeat(concat(chr(31), chr(0)), 4), chr(31), ckpt_dir, chr(31), chr(0))) AS identity, count(*) AS jobs FROM jobs_v GROUP BY 1")(lambda t: t.jobs.groupBy(integrity.run_identity(t.jobs).alias("identity")).agg(F.count(F.lit(1)).alias("jobs")))
query("join11_runtime_key", "SELECT sha256(concat(regexp_replace(cmd, '--seed[= ][0-9]+', '--seed=N'), chr(31), '/home/', project, chr(31), chr(1), chr(31), chr(1))) AS runtime_key, min(regexp_replace(cmd, '--seed[= ][0-9]+', '--seed=N')) AS command, count(*) AS jobs FROM jobs_v GROUP BY 1")(lambda t: _by_key(t.jobs.withColumn("cwd", F.concat(F.lit("/home/"), F.col("project")))))


def _by_key(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(integrity.runtime_key(jobs).alias("runtime_key")).agg(F.min(integrity.normalized_command(F.col("cmd"))).alias("command"), F.count(F.lit(1)).alias("jobs"))


def _scripted(jobs: DataFrame) -> DataFrame:
    """Jobs whose scripts and folders differ by node, so that commands meet by project, folder or script."""
    script = F.regexp_replace(F.col("cmd"), F.lit("train"), F.concat(F.lit("train_"), F.substring_index("node", "_", -1)))
    return jobs.withColumn("cmd", script).withColumn("cwd", F.concat(F.lit("/w/"), F.length("node")))


_WORDED = "SELECT *, list_sort(list_distinct(string_split(regexp_replace(replace(cmd, 'train', concat('train_', split_part(node, '_', 2))), '--seed[= ][0-9]+', '--seed=N'), ' '))) AS w, split_part(node, '_', 2) AS script, length(node) AS cwd FROM ({t})"
query("join12_nearest_runtime", f"""WITH q AS ({_WORDED.format(t="SELECT * FROM jobs_v WHERE status = 'queued'")}), r AS (SELECT w, project, cwd, script, min({{'a': finished_at, 'j': job_id}}) AS f FROM ({_WORDED.format(t=RUNS)}) GROUP BY 1, 2, 3, 4),
  c AS (SELECT DISTINCT q.w AS w, q.project AS project, q.cwd AS cwd, q.script AS script, r.f AS f, len(list_intersect(q.w, r.w)) / len(list_distinct(list_concat(q.w, r.w))) AS sim FROM (SELECT DISTINCT w, project, cwd, script FROM q) q JOIN r ON q.project = r.project OR q.cwd = r.cwd OR q.script = r.script)
  SELECT job_id, -b.m AS run_id, round(b.s, 6) AS similarity FROM (SELECT job_id, max({{'s': sim, 'm': -f.j}}) AS b FROM q JOIN c USING (w, project, cwd, script) WHERE sim >= 0.5 AND f.a <= submitted_at GROUP BY job_id)""")(lambda t: integrity.nearest_runtime(_scripted(t.jobs.filter("status = 'queued'")), _scripted(t.runs())))
query("join13_estimate_as_of", f"SELECT job_id, g AS vram_as_of FROM jobs_v j ASOF LEFT JOIN (SELECT signature, finished_at, job_id AS rid, l[CAST(ceil(len(l) * 0.8) AS BIGINT)] AS g FROM ({_PASTS.format(a=9, b='CURRENT ROW')}) QUALIFY row_number() OVER (PARTITION BY signature, finished_at ORDER BY job_id DESC) = 1) p ON j.signature = p.signature AND j.submitted_at >= p.finished_at")(lambda t: history.estimate_as_of(t.jobs, t.runs()))

# failures

#: Lines that the views' logs don't have, one for each kind of failure, and near misses.
_SAYINGS = ["OSError: [Errno 28] No space left", "write failed: disk full", "slurmstepd: oom-kill event", "Killed process 123 (python) total-vm:9kB", "numpy MemoryError", "bash: line 1: foo: command not found", "/bin/sh: No such file or directory", "ModuleNotFoundError: No module named x", "Traceback (most recent call last):", "task killed mid-training", "Killed", "all fine"]


def _troubled(log: DataFrame) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _SAYINGS)), (F.col("job_id") % len(_SAYINGS) + 1).cast("int"))
    return log.withColumn("line", F.when(F.col("seq") % 11 == 8, said).otherwise(F.col("line")))


query("chk1_classify_failure", f"""WITH l AS (SELECT job_id, CASE WHEN seq % 11 = 8 THEN ({_SAYINGS})[job_id % 12 + 1] ELSE line END AS line FROM log_v),
  f AS (SELECT job_id, bool_or(regexp_matches(line, 'No space left on device|\\[Errno 28\\]|ENOSPC|disk full|Disk quota exceeded')) AS disk, bool_or(regexp_matches(line, 'out of memory|MemoryError|Killed process|oom-kill|oom_reaper')) AS oom,
    bool_or(regexp_matches(line, '(?i)no such file or directory|command not found')) AS env, bool_or(regexp_matches(line, 'ModuleNotFoundError|ImportError')) AS imp, bool_or(contains(line, 'Traceback')) AS trace FROM l GROUP BY job_id)
  SELECT job_id, CASE WHEN disk THEN 'DISK_FULL' WHEN oom THEN 'OOM' WHEN env THEN 'ENV_MISSING' WHEN imp THEN 'PYTHON_IMPORT' WHEN trace AND job_id % 200 > 60 THEN 'APP_BUG' ELSE 'UNKNOWN' END AS category FROM (SELECT DISTINCT job_id FROM log_v) LEFT JOIN f USING (job_id)""")(
    lambda t: failures.classify_failure(t.log.select("job_id").distinct().select("job_id", F.lit("failed").alias("status"), (F.col("job_id") % 200).alias("dur_s")), _troubled(t.log))
)
#: Last lines that the views' logs don't have: each mark of a run with nothing to do, and near misses.
_ENDS = ["Training complete", "Running 0 checkpoints", "Nothing to evaluate", "no checkpoints to run", "nothing to do", "No checkpoints left", "all done?"]
query("chk3_diagnose_terminal", f"""WITH l AS (SELECT job_id, CASE WHEN line = 'Training complete' THEN ({_ENDS})[job_id % 7 + 1] ELSE line END AS line FROM log_v WHERE job_id % 10 > 0 OR seq % 11 = 10),
  f AS (SELECT job_id, bool_or(contains(line, 'Training complete')) AS ok, bool_or(contains(line, 'Running 0 checkpoints') OR contains(line, 'Nothing to ') OR contains(line, 'no checkpoints to')) AS noop, bool_or({_LINE_PAIR} IS NOT NULL OR {_LINE_CURRENT} IS NOT NULL) AS tr FROM l GROUP BY job_id),
  j AS (SELECT job_id, CASE WHEN job_id % 4 > 0 THEN peak_vram_mb ELSE 0 END AS gpu FROM jobs_v WHERE status IN ('done', 'failed') OR job_id IN (SELECT job_id FROM log_v))
  SELECT job_id, NOT coalesce(ok OR noop, FALSE) AND (gpu > 0 OR coalesce(tr, FALSE)) AS is_crash, CASE WHEN ok THEN 'success mark' WHEN noop THEN 'nothing to do' WHEN ok IS NULL AND gpu > 0 THEN 'empty log after GPU use' WHEN ok IS NULL THEN 'empty log' WHEN tr THEN 'trained without success mark' WHEN gpu > 0 THEN 'GPU use without success mark' ELSE 'no training seen' END AS reason
  FROM j LEFT JOIN f USING (job_id)""")(lambda t: failures.diagnose_terminal(_stopped(t), _ending(t.log)))


def _stopped(t: Tables) -> DataFrame:
    """Jobs that ended, and all that have logs, of which one in four used no GPU."""
    jobs = t.jobs.join(t.log.select("job_id", F.lit(True).alias("_log")).distinct(), "job_id", "left").filter("status in ('done', 'failed') or _log")
    return jobs.withColumn("peak_vram_mb", F.when(F.col("job_id") % 4 > 0, F.col("peak_vram_mb")).otherwise(0))


def _ending(log: DataFrame) -> DataFrame:
    """Logs that end in different ways; of one job in ten only the ends."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("job_id") % 7 + 1).cast("int"))
    return log.filter("job_id % 10 > 0 or seq % 11 = 10").withColumn("line", F.when(F.col("line") == "Training complete", end).otherwise(F.col("line")))


query("chk6_illegal_transitions", "SELECT event_id, job_id, before, after FROM (SELECT event_id, job_id, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before, status AS after FROM job_events_v) WHERE before <> after AND concat(before, '>', after) NOT IN (" + ", ".join(f"'{x}'" for x in _LEGAL) + ")")(lambda t: failures.illegal_transitions(t.job_events))
query("chk7_unknown_spells", """WITH m AS (SELECT job_id, ts, event_id, status IN ('queued', 'launching') AS u, lead(ts) OVER w AS nx, lag(status IN ('queued', 'launching')) OVER w AS pu FROM job_events_v WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
  k AS (SELECT *, sum(CASE WHEN u AND NOT coalesce(pu, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k FROM m)
  SELECT job_id, min(ts) AS started, count(*) AS count, arg_max_null(nx, event_id) AS resolved, CAST(floor(epoch(arg_max_null(nx, event_id))) - floor(epoch(min(ts))) AS BIGINT) AS lasted_s FROM k WHERE u GROUP BY job_id, k""")(
    lambda t: failures.unknown_spells(t.job_events.select("job_id", "ts", F.col("event_id").alias("seq"), F.when(F.col("status").isin("queued", "launching"), "unknown").otherwise("alive").alias("state")))
)
query("chk8_cooldown_filter", """WITH RECURSIVE e AS (SELECT event_id, job_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM job_events_v), g AS (SELECT job_id, s, min({'t': ts, 'e': event_id}) AS f FROM e GROUP BY job_id, s),
  n AS (SELECT job_id, f.e AS event_id, (min(f) OVER (PARTITION BY job_id ORDER BY s RANGE BETWEEN 1800 FOLLOWING AND UNBOUNDED FOLLOWING)).e AS nxt FROM g),
  k AS (SELECT job_id, min(f).e AS event_id FROM g GROUP BY job_id UNION ALL SELECT n.job_id, n.nxt FROM k JOIN n USING (job_id, event_id) WHERE n.nxt IS NOT NULL) SELECT event_id, job_id, ts FROM k JOIN e USING (event_id, job_id)""")(lambda t: failures.cooldown_filter(t.job_events, "job_id", 1800).select("event_id", "job_id", "ts"))
query("chk4_submission_audit", "SELECT job_id, unnest(list_filter([CASE WHEN job_id % 5 = 0 THEN 'cpu training unjustified' END, CASE WHEN job_id % 6 = 0 THEN 'training without checkpoint' END, CASE WHEN job_id % 6 > 0 AND job_id % 4 > 0 THEN 'checkpoint without resume flag' END], lambda x: x IS NOT NULL)) AS finding FROM jobs_v")(
    lambda t: failures.submission_audit(t.jobs.withColumn("forces_cpu", F.col("job_id") % 5 == 0).withColumn("justification", F.lit("short")).withColumn("resume_flag", F.when(F.col("job_id") % 4 == 0, "--resume")).withColumn("ckpt_dir", F.when(F.col("job_id") % 6 > 0, F.col("ckpt_dir"))))
)
query("chk2_retry_decision", """SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'escalate' WHEN job_id % 5 < 3 THEN 'retry' ELSE 'give_up' END AS decision, ckpt_dir IN (SELECT dir FROM files_v WHERE NOT is_dir AND split_part(path, '.', -1) IN ('pt', 'safetensors', 'npz')) AS resumable FROM jobs_v WHERE status = 'failed'""")(
    lambda t: failures.retry_decision(t.jobs.filter("status = 'failed'").select("job_id", "ckpt_dir", F.when(F.col("job_id") % 3 == 0, "OOM").otherwise("UNKNOWN").alias("category"), (F.col("job_id") % 5).alias("retry_count")), history.latest_checkpoint(t.files))
)

# capacity

query("cap2_cpu_ownership", """WITH c AS (SELECT node, sum(CASE WHEN job_id % 2 = 0 THEN cpu_cores ELSE 0 END) AS ours, sum(CASE WHEN job_id % 2 = 0 THEN 0 ELSE cpu_cores END) AS other FROM jobs_v WHERE status = 'running' GROUP BY node)
  SELECT node, total_cpu - free_cpu AS used, CAST(coalesce(ours, 0) AS BIGINT) AS ours, CAST(coalesce(other, 0) AS BIGINT) AS other, CAST(greatest(0, total_cpu - free_cpu - coalesce(ours, 0) - coalesce(other, 0)) AS BIGINT) AS untracked FROM (SELECT DISTINCT node, total_cpu * 100 AS total_cpu, free_cpu FROM gpus_v) LEFT JOIN c USING (node)""")(
    lambda t: capacity.cpu_ownership(t.jobs.withColumn("scheduler_id", (F.col("job_id") % 2).cast("string")), t.gpus.select("node", (F.col("total_cpu") * 100).alias("total_cpu"), "free_cpu").distinct(), "0")
)
# a node has eight times the most that a sample ever showed, and what the latest sample leaves of it
query("cap1_ram_budget", "SELECT node, CAST(greatest(0, total - last.r - CASE WHEN n % 2 = 0 THEN 2048 ELSE floor(least(CASE WHEN n % 3 > 0 THEN 50000 END, total) * 0.25) END) AS BIGINT) AS budget_mb FROM (SELECT node, CAST(split_part(node, '_', 2) AS BIGINT) AS n, max(ram_mb) * 8 AS total, max({'t': ts, 'r': ram_mb}) AS last FROM samples_v GROUP BY node)")(
    lambda t: capacity.ram_budget(t.samples.select("node", F.substring_index("node", "_", -1).cast("bigint").alias("n")).distinct().select("node", F.when(F.col("n") % 3 > 0, 50000).otherwise(0).alias("ram_mb"), F.when(F.col("n") % 2 == 0, 2048).alias("headroom_mb"), F.lit(0.25).alias("headroom_frac")), _ram_probes(t))
)


def _ram_probes(t: Tables) -> DataFrame:
    seen = t.samples.groupBy("node").agg((F.max("ram_mb") * 8).alias("total_ram_mb"), F.max(F.struct("ts", "ram_mb")).alias("last"))
    return seen.select("node", "total_ram_mb", (F.col("total_ram_mb") - F.col("last.ram_mb")).alias("free_ram_mb"))


def _asking(t: Tables) -> DataFrame:
    """All jobs with demands in steps of a gigabyte, of which one in ten needs no GPU."""
    ask = t.timed().withColumn("est_vram_mb", F.when(F.col("job_id") % 10 > 0, F.floor(F.col("peak_vram_mb") / 1024) * 1024).otherwise(0)).withColumn("require_node", F.when(F.col("job_id") % 4 == 0, F.col("node")))
    return ask.withColumn("ram_mb", F.floor(F.col("peak_ram_mb") / 1024) * 1024)


def _fleet(t: Tables) -> DataFrame:
    """GPUs with headroom, load, running jobs and caps, and live claims taken off."""
    running = t.jobs.filter("status = 'running'").groupBy("node").agg(F.count(F.lit(1)).alias("running"))
    n = F.substring_index("node", "_", -1).cast("bigint")
    gpus = t.gpus.join(running, "node", "left").fillna(0, ["running"])
    gpus = capacity.with_claims(gpus, gpus.select("node", "gpu_idx", F.lit(1).alias("cpu"), (n * 10).alias("ram_mb"), (n * 20).alias("vram_mb"), now().alias("claimed_at"), F.when(n % 2 == 0, n).alias("pid")), now())
    return gpus.withColumns({"budget_mb": F.greatest(F.lit(0), F.col("free_ram_mb") - 2048), "load1": n * 2, "max_concurrent_running": F.when(n % 6 == 5, F.col("running")), "max_vram_per_task": F.when(n % 7 == 3, 3000).when(n % 7 == 4, 0), "cpu_node": n % 5 == 2})


_FLEET = """SELECT *, greatest(0, free_ram - 2048) AS budget, CASE WHEN n % 7 = 3 THEN 3000 WHEN n % 7 = 4 THEN 0 END AS cap, CASE WHEN n % 6 = 5 THEN running END AS most, n * 2 AS load1, n % 5 = 2 AS labour FROM (SELECT node, gpu_idx, total_cpu, total_mb, alive, n, running, greatest(0, free_cpu - CASE WHEN n % 2 = 1 THEN 2 ELSE 0 END) AS free, greatest(0, free_ram_mb - CASE WHEN n % 2 = 1 THEN n * 20 ELSE 0 END) AS free_ram, total_mb - greatest(0, total_mb - used_mb - CASE WHEN n % 2 = 1 THEN n * 20 ELSE 0 END) AS used
  FROM (SELECT *, CAST(split_part(node, '_', 2) AS BIGINT) AS n FROM gpus_v) LEFT JOIN (SELECT node, count(*) AS running FROM jobs_v WHERE status = 'running' GROUP BY node) USING (node))"""
_R10 = [("down", "NOT alive"), ("pinned elsewhere", "rn IS NOT NULL AND rn <> node"), ("cpu", "cpu_cores > free"), ("load", "load1 >= total_cpu"), ("running cap", "coalesce(running, 0) >= most"), ("ram", "r > budget"), ("vram cap", "e > 0 AND greatest(e, 1) > cap"), ("vram", "e > 0 AND total_mb - used < e + 500"), ("vram frozen", "e > 0 AND used > 0 AND used >= floor(total_mb / 3) + 512")]
_FIT = "SELECT *, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _R10) + f"], lambda r: r IS NOT NULL) AS reasons FROM (SELECT job_id, cpu_cores, floor(peak_ram_mb / 1024) * 1024 AS r, CASE WHEN job_id % 10 > 0 THEN floor(peak_vram_mb / 1024) * 1024 ELSE 0 END AS e, CASE WHEN job_id % 4 = 0 THEN node END AS rn FROM jobs_v WHERE status = 'queued') CROSS JOIN ({_FLEET})"
query("cap3_fit_matrix", f"SELECT job_id, node, gpu_idx, len(reasons) = 0 AS fits, array_to_string(reasons, ',') AS reasons FROM ({_FIT})")(lambda t: capacity.fit_matrix(_asking(t), _fleet(t)).select("job_id", "node", "gpu_idx", "fits", F.array_join("reasons", ",").alias("reasons")))
query("cap4_best_slot", f"SELECT job_id, s.node AS node, s.gpu_idx AS gpu_idx FROM (SELECT job_id, arg_min({{'node': node, 'gpu_idx': gpu_idx}}, (CASE WHEN e = 0 THEN (NOT labour)::INT ELSE (used = 0)::INT END, CASE WHEN e = 0 THEN -free ELSE total_mb - used END, node, gpu_idx)) AS s FROM ({_FIT}) WHERE len(reasons) = 0 GROUP BY job_id)")(lambda t: capacity.best_slot(_asking(t), _fleet(t)))
query("cap5_blocked_summary", f"SELECT reason, node, count(DISTINCT job_id) AS jobs FROM (SELECT job_id, node, unnest(reasons) AS reason FROM ({_FIT})) GROUP BY reason, node")(lambda t: capacity.blocked_summary(_asking(t), _fleet(t)))
query("cap6_effective_free", f"""WITH c AS (SELECT *, job_id % 3 AS cpu, job_id % 50 AS ram, peak_vram_mb % 20 AS vram FROM jobs_v WHERE status = 'running' AND job_id % 3 > 0 AND epoch({DUCK_NOW}) - epoch(submitted_at) <= 200000000), n AS (SELECT node, sum(cpu) AS a, sum(ram) AS b FROM c GROUP BY node), g AS (SELECT node, gpu_idx, sum(vram) AS d FROM c GROUP BY node, gpu_idx)
  SELECT node, gpu_idx, CAST(greatest(0, free_cpu - coalesce(a, 0)) AS BIGINT) AS free_cpu, CAST(greatest(0, free_ram_mb - coalesce(b, 0)) AS BIGINT) AS free_ram_mb, CAST(greatest(0, total_mb - used_mb - coalesce(d, 0)) AS BIGINT) AS free_vram_mb FROM gpus_v LEFT JOIN n USING (node) LEFT JOIN g USING (node, gpu_idx)""")(
    lambda t: capacity.effective_free(t.gpus, t.jobs.filter("status = 'running'").select("node", "gpu_idx", (F.col("job_id") % 3).alias("cpu"), (F.col("job_id") % 50).alias("ram_mb"), (F.col("peak_vram_mb") % 20).alias("vram_mb"), F.col("submitted_at").alias("claimed_at"), F.when(F.col("job_id") % 3 == 0, F.col("job_id")).alias("pid")), now(), 200_000_000)
)
query("cap8_eviction_candidates", f"SELECT node, gpu_idx, job_id FROM (SELECT node, gpu_idx, count(*) AS n, arg_max(job_id, (eta_seconds, job_id)) AS job_id FROM ({TIMED}) JOIN (SELECT node, gpu_idx FROM gpus_v WHERE used_mb >= floor(total_mb / 3) + 512) USING (node, gpu_idx) WHERE status = 'running' GROUP BY node, gpu_idx) WHERE n >= 2")(lambda t: capacity.eviction_candidates(t.gpus, t.timed()))
_RAN = "min(CASE WHEN {c} THEN {{'t': submitted_at, 'j': job_id}} END) OVER (PARTITION BY {p} ORDER BY submitted_at, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
query("cap7_older_blockers", f"""SELECT job_id, least(a, b).j AS blocker_id FROM (SELECT job_id, {_RAN.format(c='cpu_cores <= free_cpu', p='node')} AS a, {_RAN.format(c=f'epoch({DUCK_NOW}) - epoch(submitted_at) > 150000000', p='node, gpu_idx')} AS b FROM jobs_v JOIN (SELECT DISTINCT node, free_cpu FROM gpus_v) USING (node) WHERE status = 'queued') WHERE a IS NOT NULL OR b IS NOT NULL""")(
    lambda t: capacity.older_blockers(t.jobs.filter("status = 'queued'").join(t.gpus.select("node", "free_cpu").distinct(), "node").select("job_id", "node", F.col("submitted_at").alias("ts"), F.col("cpu_cores").alias("cpu"), "free_cpu", F.col("gpu_idx").alias("resource")), now(), 150_000_000)
)
_LOAD = f"SELECT node, CAST(coalesce(sum(CASE WHEN status = 'running' AND length(node) > 8 THEN eta_seconds END), 0) AS BIGINT) AS eta_load FROM (SELECT DISTINCT node FROM gpus_v) LEFT JOIN ({TIMED}) USING (node) GROUP BY node"
query("cap9_rebalance_candidates", f"WITH l AS ({_LOAD}), t AS (SELECT eta_load AS tl, node AS target FROM l WHERE eta_load < 600 ORDER BY eta_load, node LIMIT 1) SELECT l.node AS source, target, job_id FROM l JOIN t ON l.eta_load > 2 * tl AND l.eta_load > 600 JOIN (SELECT node, arg_max(job_id, (eta_seconds, job_id)) AS job_id FROM ({TIMED}) WHERE status = 'running' AND eta_seconds >= 300 GROUP BY node) b ON b.node = l.node")(
    lambda t: capacity.rebalance_candidates(t.timed(), history.node_load(t.timed().withColumn("eta_seconds", F.when(F.length("node") > 8, F.col("eta_seconds"))), t.gpus))
)

query("cap11_assign_shards", """WITH w AS (SELECT node, max(free_cpu) AS weight FROM gpus_v GROUP BY node HAVING max(free_cpu) > 0), n AS (SELECT count(*) AS total FROM jobs_v), x AS (SELECT node, weight, total, total * weight / (sum(weight) OVER ()) AS x FROM w, n),
  y AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, node) AS rn, total - sum(floor(x)) OVER () AS lft FROM x), z AS (SELECT node, f + (rn <= lft)::INT AS n FROM y), e AS (SELECT node, n, sum(n) OVER (ORDER BY node) AS hi FROM z),
  p AS (SELECT job_id, row_number() OVER (ORDER BY job_id) - 1 AS pos FROM jobs_v) SELECT job_id, node FROM p JOIN e ON pos >= hi - n AND pos < hi""")(
    lambda t: capacity.assign_shards(t.jobs, "job_id", t.gpus.groupBy("node").agg(F.max("free_cpu").alias("weight")))
)
query("cap12_concurrency", f"WITH e AS (SELECT node, submitted_at AS ts, 1 AS d, job_id FROM ({RUNS}) UNION ALL SELECT node, finished_at, -1, job_id FROM ({RUNS})), p AS (SELECT node, CAST(max(r) AS BIGINT) AS peak FROM (SELECT node, sum(d) OVER (PARTITION BY node ORDER BY ts, d, job_id ROWS UNBOUNDED PRECEDING) AS r FROM e) GROUP BY node) SELECT node, peak, l AS limit, CASE WHEN l IS NOT NULL THEN greatest(0, peak - l) END AS over FROM p LEFT JOIN (SELECT DISTINCT node, CASE WHEN total_cpu > 8 THEN CAST(total_cpu / 8 AS BIGINT) END AS l FROM gpus_v) USING (node)")(
    lambda t: capacity.peak_concurrency(t.runs().withColumn("started_at", F.col("submitted_at")), t.gpus.select("node", F.when(F.col("total_cpu") > 8, F.floor(F.col("total_cpu") / 8)).alias("max_concurrent_running")).distinct())
)
query("cap12_timeline", f"WITH e AS (SELECT node, submitted_at AS ts, 1 AS d, job_id FROM ({RUNS}) UNION ALL SELECT node, finished_at, -1, job_id FROM ({RUNS})) SELECT node, ts, d, job_id, CAST(sum(d) OVER (PARTITION BY node ORDER BY ts, d, job_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM e")(lambda t: capacity.concurrency_timeline(t.runs().withColumn("started_at", F.col("submitted_at"))))


# the rest: seeds, walltimes, trial logs, audits, and the batch twin of the rollup

query("agg3_legacy_seed", f"SELECT signature, job_id, vram_mb FROM ({RUNS}) UNION ALL SELECT signature, -1, min(peak_vram_mb) FROM jobs_v WHERE signature NOT IN (SELECT signature FROM ({RUNS})) GROUP BY signature")(
    lambda t: history.legacy_seed(t.runs(), t.jobs.groupBy("signature").agg(F.min("peak_vram_mb").alias("vram_mb"))).select("signature", "job_id", "vram_mb")
)


def _runtimes(t: Tables) -> DataFrame:
    """runtime_key, total_s of all runs; commands with 3xx iterations are changed, so that no job has their keys."""
    runs = t.runs().withColumn("cmd", F.regexp_replace("cmd", "max_iters 3", "max_iters 13"))
    return runs.select(integrity.runtime_key(runs).alias("runtime_key"), F.col("dur_s").alias("total_s"))


def _keyed(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("runtime_key", integrity.runtime_key(jobs))


_KEY = "regexp_replace(cmd, '--seed[= ][0-9]+', '--seed=N')"
_RUNTIMES = f"SELECT replace({_KEY}, 'max_iters 3', 'max_iters 13') AS k, dur_s AS total_s FROM ({RUNS})"
query("agg5_walltime", f"""WITH p AS (SELECT k, quantile_disc(total_s, 0.8) AS p FROM ({_RUNTIMES}) GROUP BY k)
  SELECT job_id, CAST(coalesce(least(604800, greatest(600, floor(p * 12 / 10))), least(604800, greatest(600, dur_s_ewma * 3)), 86400) AS BIGINT) AS walltime_s,
  CASE WHEN p IS NOT NULL THEN 'runtime' WHEN dur_s_ewma > 0 THEN 'history' ELSE 'default' END AS source FROM jobs_v LEFT JOIN p ON k = {_KEY} LEFT JOIN ({EWMA}) USING (signature)""")(
    lambda t: history.walltime(_runtimes(t), t.ewma(), _keyed(t.jobs))
)
query("log12_seed_pending_eta", f"""WITH p AS (SELECT k, max(total_s) AS total_s FROM ({_RUNTIMES}) GROUP BY k)
  SELECT job_id, CAST(coalesce(total_s, dur_s_ewma) AS BIGINT) AS eta_s, CASE WHEN total_s IS NOT NULL THEN 'runtime' ELSE 'duration_ewma' END AS eta_source FROM jobs_v LEFT JOIN p ON k = {_KEY} LEFT JOIN ({EWMA}) USING (signature) WHERE status = 'queued' AND coalesce(total_s, dur_s_ewma) > 0""")(
    lambda t: logs.seed_pending_eta(_keyed(t.timed()), _runtimes(t).groupBy("runtime_key").agg(F.max("total_s").alias("total_s")), t.ewma())
)
_BOTH = f"list_extract(list_filter(list_transform(list_zip({_E}, {_R}), lambda z: {{'e': {_duck_clock('z[1]')}, 'r': {_duck_clock('z[2]')}}}), lambda b: b.e IS NOT NULL AND b.r IS NOT NULL), -1)"
query("log11_project_from_test_log", f"""WITH s AS (SELECT s.*, b.v AS b, CASE WHEN pr.c > 0 AND dur_s > 0 THEN CAST(dur_s AS DOUBLE) / pr.c END AS u FROM ({_SIGNALS}) s LEFT JOIN ({_duck_latest(_BOTH)}) b USING (job_id))
  SELECT job_id, CASE WHEN b IS NOT NULL THEN 'bar' ELSE 'pair' END AS source, coalesce(b.r, CAST(trunc(greatest(0.0, CAST(trunc(u * pr.t) AS BIGINT) - dur_s)) AS BIGINT)) AS eta_s, coalesce(b.e + b.r, CAST(trunc(u * pr.t) AS BIGINT)) AS total_s FROM s WHERE b IS NOT NULL OR u IS NOT NULL""")(
    lambda t: logs.project_from_test_log(t.log, t.timed().withColumn("observed_s", F.col("dur_s")))
)
query("chk5_queue_audit", f"""SELECT job_id, 'evaluation without gate' AS finding FROM jobs_v WHERE status = 'queued' AND job_id % 3 = 0 AND job_id % 2 = 0
  UNION ALL SELECT job_id, 'producer not high' FROM jobs_v WHERE priority <> 'high' AND status IN ('running', 'queued') AND ckpt_dir IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM ({_WAITS}) JOIN ({_MISSING}) USING (job_id) WHERE status = 'queued')
  UNION ALL SELECT job_id, 'retry with old eta' FROM jobs_v WHERE status = 'queued' AND parent_id IS NOT NULL AND job_id % 5 = 0
  UNION ALL SELECT job_id, 'launching over 60 s' FROM jobs_v WHERE status = 'running' AND job_id % 17 = 0 AND epoch({DUCK_NOW}) - epoch(submitted_at) > 60""")(
    lambda t: failures.queue_audit(_waiting(t).withColumn("cmd", F.when(F.col("job_id") % 2 == 0, F.lit("python eval.py")).otherwise(F.col("cmd"))).withColumn("eta_seconds", F.when(F.col("job_id") % 5 == 0, 60)).withColumn("status", F.when((F.col("status") == "running") & (F.col("job_id") % 17 == 0), "launching").otherwise(F.col("status"))), t.files, now())
)
query("str2_minute_rollup", "SELECT node, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, max(vram_mb) AS max_vram_mb, CAST(sum(ram_mb) AS BIGINT) AS sum_ram_mb, count(DISTINCT job_id) AS jobs FROM samples_v GROUP BY ALL")(lambda t: capacity.minute_rollup(t.samples))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["agg2_p80_history"](spark, sf_dir)


from jobscope.plans import streams  # noqa: E402, F401  registers the streams' queries
