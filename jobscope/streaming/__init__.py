"""Structured Streaming forms of the operators. Stateful ones need the RocksDB state store; see :func:`use_rocksdb`.

Those whose state has a time to live run a batch at any time to end it, so they are started with a running trigger and not with ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

from jobscope.functions import TERMINAL
from jobscope.operators.capacity import minute_rollup as _rollup
from jobscope.operators.failures import TRANSITIONS
from jobscope.operators.history import last_runs, p80_history
from jobscope.operators.logs import line_signals, signals
from jobscope.shipping import ship
from jobscope.sources import EVENT_SCHEMA
from jobscope.sources.rotated import RotatedLog

#: How long a job's state is kept after its last event, where it isn't removed before.
TTL_S = 7 * 86_400

#: Parts that keys are dealt to where a call works on many keys, and rows of a part's state that are read and written together, at most on average; see :class:`_Chunks`.
PARTS, CHUNK_ROWS = 256, 1_000

#: Null in columns of whole numbers, which pandas would turn into floats.
NONE = -(2**63)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_events(spark: SparkSession, folder: str, schema: StructType | str, form: str = "parquet", glob: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files in a folder; a zoneless ``ts`` becomes a timestamp, which watermarks need."""
    ship(spark)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.format(form).load(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in events.columns else events


def stream_rotated_events(spark: SparkSession, path: str, schema: StructType | str = EVENT_SCHEMA) -> DataFrame:
    """A stream of the events of a JSON-lines log and its rotated generations, each once wherever its line is moved; see :class:`RotatedLog`.

    Blank lines give nothing, unreadable ones are kept in ``_corrupt_record`` where ``schema`` has it. A generation that is removed before it was
    read ends the stream with an error.
    """
    ship(spark)
    spark.dataSource.register(RotatedLog)
    lines = spark.readStream.format("rotated_log").load(path)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e")).select("e.*")


def minute_rollup(samples: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """60-second accounts of nodes, in append mode; rows later than ``delay`` are dropped. Equal to the batch operator on what is in time."""
    return _rollup(samples.withWatermark("ts", delay))


def live_peaks(samples: DataFrame) -> DataFrame:
    """Peak so far of each job, in update mode. Its state lasts as long as the stream; see :func:`job_peaks` for one that ends."""
    return samples.groupBy("job_id").agg(F.max("vram_mb").alias("peak_vram_mb"), F.max("ram_mb").alias("peak_ram_mb"))


def live_progress(lines: DataFrame) -> DataFrame:
    """Latest signals of each job, in update mode. Its state lasts as long as the stream; see :func:`job_progress` for one that ends."""
    return signals(lines).select("job_id", F.col("remaining").alias("remaining_s"), F.col("inline").alias("inline_s"), F.col("pair_current").alias("current"), F.col("pair_total").alias("total"))


def dedupe_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once, across retries and rotated files, if its copies are within ``delay``."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def enrich(stream: DataFrame, hist: DataFrame) -> DataFrame:
    """Live jobs with their signature's estimates as ``hist`` had them when the stream started; see :func:`enrich_as_known` for estimates that change."""
    return stream.join(hist, "signature", "left")


class _Keyed(StatefulProcessor):
    """Sorts what comes for a key by time, as files of a batch come in any order. ``at_us``: the time in microseconds, whatever the session's zone.

    Ids and keys have the types that the stream has; ``{name}`` in STATE and OUT stands for that of a column.
    """

    TTL: int | None = None
    STATE: str
    OUT: str
    kinds: dict[str, str]

    def of(self, ddl: str) -> str:
        return ddl.format(**self.kinds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.of(self.STATE), self.TTL * 1000) if self.TTL else handle.getValueState("state", self.of(self.STATE))

    def ordered(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(["at_us", "event_id"], kind="stable")

    def last(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[column.split()[0] for column in self.OUT.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False).replace_schema_metadata(None), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blobs: Iterable[bytes]) -> pd.DataFrame | None:
    frames = [pa.ipc.open_stream(bytes(b)).read_pandas() for b in blobs]
    return pd.concat(frames, ignore_index=True) if frames else None


class _Chunks:
    """Many rows of a part's state, in chunks by their column ``hash``. A call to the state store takes as long as the work on hundreds of rows, so rows
    are read and written a chunk at a time, as Arrow streams, and only the chunks that a batch's rows fall in.

    The number of chunks doubles where they would have more than ``CHUNK_ROWS`` rows on average.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.chunks = handle.getMapState(name, "chunk int", "rows binary")
        self.size = handle.getValueState(f"{name}_size", "chunks int, n bigint")

    def read(self, hashes: pd.Series) -> pd.DataFrame | None:
        """The rows of the chunks that ``hashes`` fall in."""
        self.count, self.n = self.size.get() or (1, 0)
        found = {c: v[0] for c in np.unique(hashes & (self.count - 1)).tolist() if (v := self.chunks.getValue((c,))) is not None}
        self.open, rows = set(found), _unpacked(found.values())
        self.n -= 0 if rows is None else len(rows)
        return rows

    def write(self, rows: pd.DataFrame) -> None:
        """Puts ``rows``, which fall in the chunks that were read last, in place of what those had."""
        n, count = self.n + len(rows), self.count
        while n > CHUNK_ROWS * count:
            count *= 2
        if count > self.count:
            others = _unpacked(v[0] for c, v in self.chunks.iterator() if c[0] not in self.open)
            rows = rows if others is None else pd.concat([rows, others], ignore_index=True)
            self.chunks.clear()
            self.open = set()
        parts = dict(tuple(rows.groupby(rows["hash"] & (count - 1), sort=False))) if count > 1 else {0: rows} if n else {}
        for c in self.open - set(parts):
            self.chunks.removeKey((c,))
        for c, part in parts.items():
            self.chunks.updateValue((int(c),), (_packed(part),))
        self.size.update((count, n))


class Transitions(_Keyed):
    """Illegal changes of status as they come. A job that is done and runs again is one, so its status is kept after
    its end, for the time to live and no longer."""

    STATE = "status string"
    OUT = "job_id {job_id}, event_id {event_id}, before string, after string"

    def __init__(self, ttl_s: int | None):
        self.TTL = ttl_s

    def handleInputRows(self, key, rows, timerValues):
        last, out = (self.last() or (None,))[0], []
        for r in self.ordered(rows).itertuples():
            if last is not None and last != r.status and (last, r.status) not in set(TRANSITIONS):
                out.append((key[0], r.event_id, last, r.status))
            last = r.status
        self.state.update((last,))
        yield self.frame(out)


class UnknownSpells(_Keyed):
    """A span of ``unknown`` probes, told when the first probe that isn't ends it; the state goes with it."""

    STATE = "started bigint, n bigint"
    OUT = "job_id {job_id}, started bigint, n bigint, resolved bigint"

    def handleInputRows(self, key, rows, timerValues):
        open_, out = self.last(), []
        for r in self.ordered(rows).itertuples():
            if r.state == "unknown":
                open_ = (open_[0], open_[1] + 1) if open_ else (r.at_us, 1)
            elif open_:
                out.append((key[0], *open_, r.at_us))
                open_ = None
        if open_:
            self.state.update(open_)
        else:
            self.state.clear()
        yield self.frame(out)


class JobPeaks(_Keyed):
    """Peaks of a job so far, told when they rise; gone at a terminal status, or when nothing comes for the time to live."""

    STATE = "vram bigint, ram bigint"
    OUT = "job_id {job_id}, peak_vram_mb bigint, peak_ram_mb bigint"

    def __init__(self, ttl_s: int):
        self.TTL = ttl_s

    def handleInputRows(self, key, rows, timerValues):
        pdf = self.ordered(rows)
        had = self.last() or (-1, -1)
        now = tuple(int(max(h, pdf[c].max() if pdf[c].notna().any() else -1)) for h, c in zip(had, ("vram_mb", "ram_mb")))
        if pdf["status"].iloc[-1] in TERMINAL:
            self.state.clear()
        else:
            self.state.update(now)
        yield self.frame([(key[0], *now)] if now != had else [])


class JobProgress(_Keyed):
    """The latest signals of a job, told when they change; gone at a terminal status, or after the time to live."""

    FIELDS = ("remaining", "inline", "pair_current", "pair_total")
    STATE = "remaining bigint, inline bigint, pair_current bigint, pair_total bigint"
    OUT = "job_id {job_id}, remaining_s bigint, inline_s bigint, current bigint, total bigint"

    def __init__(self, ttl_s: int):
        self.TTL = ttl_s

    def handleInputRows(self, key, rows, timerValues):
        pdf, had = self.ordered(rows), self.last() or (None,) * 4
        now = []
        for field, old in zip(self.FIELDS, had):
            seen = pdf[field].dropna()
            now.append(int(seen.iloc[-1]) if len(seen) else old)
        if (pdf["status"].iloc[-1] or "") in TERMINAL:
            self.state.clear()
        else:
            self.state.update(tuple(now))
        yield self.frame([(key[0], *now)] if tuple(now) != had else [])


class Debounce(_Keyed):
    """Events at least ``seconds`` after the last kept one of their key."""

    STATE = "last bigint"
    OUT = "job_id {job_id}, event_id {event_id}, ts_us bigint"

    def __init__(self, seconds: int):
        self.seconds = seconds

    def handleInputRows(self, key, rows, timerValues):
        last, out = (self.last() or (None,))[0], []
        for r in self.ordered(rows).itertuples():
            at = r.at_us // 1_000_000
            if last is None or at - last >= self.seconds:
                last = at
                out.append((key[0], r.event_id, r.at_us))
        self.state.update((last,))
        yield self.frame(out)


class StaleTimers(_Keyed):
    """An alert when a status is held longer than its limit in event time without a newer event. An event that is older than
    the newest known says nothing."""

    STATE = "status string, since bigint"
    OUT = "job_id {job_id}, status string, since double"

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def handleInputRows(self, key, rows, timerValues):
        r, had = self.ordered(rows).iloc[-1], self.last()
        if had is None or r["at_us"] >= had[1]:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            if r["status"] in TERMINAL:
                self.state.clear()
            else:
                self.state.update((r["status"], int(r["at_us"])))
                if r["status"] in self.limits:
                    self.handle.registerTimer(int(r["at_us"]) // 1000 + self.limits[r["status"]] * 1000)
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if had := self.last():
            yield self.frame([(key[0], had[0], had[1] / 1e6)])


class BatchDone(_Keyed):
    """One alert when all jobs of a batch, whose size each event carries, are in a terminal status at the same time: one that failed
    and waits again isn't. Once it is told, what is known of the jobs goes and only that stays.

    A part's batches and their jobs are two tables of rows. A batch's jobs lie together, in ``spread`` places for a large one, so a batch of events reads
    and writes its own jobs and what happens to share their chunks.
    """

    OUT = "batch {batch}, jobs bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.batches, self.jobs = _Chunks(handle, "batches"), _Chunks(handle, "jobs")

    def handleInputRows(self, key, rows, timerValues):
        pdf = self.ordered(rows)
        sizes = pdf[["batch_hash", "batch", "batch_size"]].drop_duplicates("batch", keep="last").rename(columns={"batch_hash": "hash"})
        batches, new = self.batches.read(sizes["hash"]), sizes[["hash", "batch"]].assign(spread=np.maximum(1, sizes["batch_size"] // CHUNK_ROWS), finished=0, told=False)
        batches = pd.concat([batches, new], ignore_index=True).drop_duplicates("batch", ignore_index=True)
        place = pd.Index(batches["batch"]).get_indexer
        at = place(pdf["batch"])
        pdf["done"], pdf["hash"] = pdf["status"].isin(TERMINAL), pdf["batch_hash"] + pdf["job_hash"] % batches["spread"].to_numpy()[at]
        latest = pdf.loc[~batches["told"].to_numpy()[at], ["hash", "batch", "job", "at_us", "done"]].drop_duplicates(["batch", "job"], keep="last")
        if latest.empty:
            return
        known = self.jobs.read(latest["hash"])
        # of the same time, what came later counts
        both = pd.concat([known, latest], ignore_index=True).sort_values("at_us", kind="stable").drop_duplicates(["batch", "job"], keep="last")
        for rows_, sign in ((known, -1), (both, 1)):
            if rows_ is not None:
                of = place(rows_.loc[rows_["done"], "batch"])
                batches["finished"] += sign * np.bincount(of[of >= 0], minlength=len(batches))
        size = np.zeros(len(batches), "int64")
        size[place(sizes["batch"])] = sizes["batch_size"]
        full = (size > 0) & (batches["finished"].to_numpy() >= size) & ~batches["told"].to_numpy()
        told = batches[full]
        self.jobs.write(both[~both["batch"].isin(told["batch"])])
        if (told["spread"] > 1).any():
            rest = self.jobs.read(np.concatenate([h + np.arange(n) for h, n in zip(told["hash"], told["spread"])]))
            if rest is not None:
                self.jobs.write(rest[~rest["batch"].isin(told["batch"])])
        batches.loc[full, ["finished", "told"]] = 0, True
        self.batches.write(batches)
        if full.any():
            yield self.frame([(None if b == NONE else b, n) for b, n in zip(told["batch"].tolist(), size[full].tolist())])


class History(_Keyed):
    """The last runs of each signature, and the percentile of their peaks, told when it changes. A run that comes again changes nothing."""

    OUT = "signature {signature}, p80_vram_mb bigint, p80_ram_mb bigint, samples bigint, last_seen_us bigint"
    RUN = ["signature", "at_us", "event_id"]
    PEAKS = ["vram_mb", "ram_mb"]

    def __init__(self, keep: int, p: float):
        self.keep, self.p = keep, p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = _Chunks(handle, "runs")

    def _last(self, runs: pd.DataFrame) -> pd.DataFrame:
        """The last runs of each signature, in order; a run that comes with other peaks counts as it came last."""
        runs = runs.drop_duplicates(self.RUN, keep="last").sort_values(self.RUN[1:], kind="stable", na_position="first")
        return runs.groupby("signature", sort=False, dropna=False).tail(self.keep)

    def _fold(self, frames: Iterable[pd.DataFrame]) -> pd.DataFrame:
        """Puts the runs of ``frames`` into state, and gives back those of its chunks; ``new`` says which weren't there."""
        new = None
        for pdf in frames:
            new = self._last(pd.concat([new, pdf[["hash", *self.RUN, *self.PEAKS]]], ignore_index=True))
        known = self.runs.read(new["hash"])
        both = new.assign(new=True) if known is None else pd.concat([known.assign(new=False), new.assign(new=True)], ignore_index=True).drop_duplicates([*self.RUN, *self.PEAKS])
        last = self._last(both)
        self.runs.write(last.drop(columns="new"))
        return last

    def _rank(self, runs: pd.DataFrame, column: str, signatures: int) -> np.ndarray:
        """The percentile's value of ``column`` for signatures numbered from 0, null where all are."""
        seen = runs[runs[column] != NONE].sort_values(column, kind="stable")
        by, out = seen.groupby("number", sort=False)[column], np.full(signatures, None, object)
        at = seen[by.cumcount() == -(-by.transform("size") * round(self.p * 100) // 100) - 1]
        out[at["number"]] = at[column]
        return out

    def handleInitialState(self, key, initialState, timerValues):
        self._fold([initialState])

    def handleInputRows(self, key, rows, timerValues):
        last = self._fold(rows)
        last["number"] = last.groupby("signature", sort=False, dropna=False).ngroup()
        last = last[last.groupby("number")["new"].transform("any")]
        if len(last):
            last["number"] = pd.factorize(last["number"])[0]
            told = last.groupby("number").agg(at_us=("at_us", "last"), samples=("at_us", "size"))
            signatures = [None if s == NONE else s for s in last.drop_duplicates("number")["signature"].tolist()]
            p = [self._rank(last, column, len(told)) for column in self.PEAKS]
            yield self.frame(list(zip(signatures, *p, told["samples"].tolist(), told["at_us"].tolist())))


class AsKnown(_Keyed):
    """Each job with the estimate that its signature had at its time.

    A job waits until the watermark has passed its time, so estimates that are a little late still count. Of the estimates from before
    the watermark only the newest is kept. Jobs and estimates that come after the watermark has passed their time are too late: Spark drops them
    before they get here, and counts them in the query's progress.

    A part has a timer for the first of its jobs that wait, and answers all that the watermark has passed by then.
    """

    OUT = "event_id string, job_id string, signature {signature}, at_us bigint, vram_mb bigint, ram_mb bigint"
    VERSION = ["signature", "at_us", "vram_mb", "ram_mb"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = _Chunks(handle, "versions")
        self.waiting = handle.getListState("waiting", "jobs binary")
        self.answered = set()

    def _wait(self, jobs: pd.DataFrame) -> bytes:
        self.handle.registerTimer(int(jobs["at_us"].min()) // 1000 + 1)
        return _packed(jobs)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows))
        jobs, new = pdf.loc[~pdf["is_estimate"], ["hash", "signature", "at_us", "event_id", "job_id"]], pdf.loc[pdf["is_estimate"], ["hash", *self.VERSION]]
        if len(jobs):
            self.waiting.appendValue((self._wait(jobs),))
        if len(new):
            self.versions.write(pd.concat([self.versions.read(new["hash"]), new], ignore_index=True).drop_duplicates(self.VERSION))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if key in self.answered:  # by another of its timers: no rows come between them
            return
        self.answered.add(key)
        due = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _unpacked(blob for (blob,) in self.waiting.get())
        if waiting is None:
            return
        ready, rest = waiting[waiting["at_us"] <= due].sort_values("at_us", kind="stable"), waiting[waiting["at_us"] > due]
        if len(rest):
            self.waiting.put([(self._wait(rest),)])
        else:
            self.waiting.clear()
        if ready.empty:
            return
        versions, found = self.versions.read(ready["hash"]), np.full(len(ready), -1)
        if versions is not None:
            versions = versions.sort_values(self.VERSION[1:], kind="stable", ignore_index=True)
            number = pd.factorize(pd.concat([versions["signature"], ready["signature"]]), use_na_sentinel=False)[0]
            versions["number"], at = number[: len(versions)], ready[["at_us"]].assign(number=number[len(versions) :])
            found = pd.merge_asof(at, versions[["at_us", "number"]].assign(row=versions.index), on="at_us", by="number")["row"].fillna(-1).to_numpy("int64")
            old = versions[versions["at_us"] <= due]
            if len(gone := old.index[old["number"].duplicated(keep="last")]):
                self.versions.write(versions.drop(index=gone, columns="number"))
        given = lambda c: [None if k < 0 or v == NONE else v for k, v in zip(found.tolist(), versions[c].to_numpy()[found].tolist())] if versions is not None else [None] * len(ready)
        own = [None if s == NONE else s for s in ready["signature"].tolist()]
        yield self.frame(list(zip(ready["event_id"], ready["job_id"], own, ready["at_us"].tolist(), given("vram_mb"), given("ram_mb"))))


def _stateful(events: DataFrame, key: str, processor: _Keyed, time_mode: str = "None", initial: DataFrame | None = None) -> DataFrame:
    ship(events.sparkSession)
    processor.kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    micros = lambda df: df.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))
    start = micros(initial).groupBy(key) if initial is not None else None
    return micros(events).groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(processor.of(processor.OUT)), outputMode="Append", timeMode="ProcessingTime" if processor.TTL else time_mode, initialState=start)


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


def _hash(*key: str) -> Column:
    """What :class:`_Chunks` deals rows by: other bits than those that parts are dealt by."""
    return F.shiftright(F.xxhash64(*key), 16)


def _exact(df: DataFrame, column: str) -> Column:
    """A column that pandas leaves as it is, with or without nulls."""
    whole = isinstance(df.schema[column].dataType, IntegralType)
    return (F.coalesce(F.col(column).cast("bigint"), F.lit(NONE)) if whole else F.col(column)).alias(column)


def transition_monitor(events: DataFrame, ttl_s: int | None = TTL_S) -> DataFrame:
    """Illegal transitions of (event_id, job_id, ts, status) as they happen; a job is forgotten ``ttl_s`` after its last event (None: never)."""
    return _stateful(events, "job_id", Transitions(ttl_s))


def unknown_monitor(probes: DataFrame) -> DataFrame:
    """job_id, started, count, resolved, lasted_s of spans of unknown probes (event_id, job_id, ts, state) when they end."""
    spells = _stateful(probes, "job_id", UnknownSpells())
    seconds = lambda c: F.floor(F.col(c) / 1_000_000)
    return spells.select("job_id", F.timestamp_micros("started").alias("started"), F.col("n").alias("count"), F.timestamp_micros("resolved").alias("resolved"), (seconds("resolved") - seconds("started")).alias("lasted_s"))


def job_peaks(samples: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """Peaks of each job when they rise, from (event_id, job_id, ts, vram_mb, ram_mb, status); state ends with the job, or after ``ttl_s``."""
    return _stateful(samples, "job_id", JobPeaks(ttl_s))


def job_progress(lines: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """Latest signals of each job when they change, from (job_id, seq, ts, line, status); state ends with the job, or after ``ttl_s``."""
    parsed = line_signals(lines.select("job_id", "seq", "ts", "status", "line"))
    return _stateful(parsed.select("job_id", F.col("seq").alias("event_id"), "ts", "status", *JobProgress.FIELDS), "job_id", JobProgress(ttl_s))


def debounce(events: DataFrame, seconds: int) -> DataFrame:
    """The streaming form of the cooldown filter on (event_id, job_id, ts)."""
    return _stateful(events, "job_id", Debounce(seconds)).select("job_id", "event_id", F.timestamp_micros("ts_us").alias("ts"))


def stale_timers(events: DataFrame, limits: dict[str, int], delay: str = "1 minute") -> DataFrame:
    """Alerts for statuses held too long: (event_id, job_id, ts, status), limits in seconds by status."""
    return _stateful(events.withWatermark("ts", delay), "job_id", StaleTimers(limits), "EventTime")


def batch_done_alerts(events: DataFrame) -> DataFrame:
    """Fires once a batch: (event_id, ts, batch, batch_size, job_id, status)."""
    kind = events.schema["batch"].dataType
    shaped = events.select(_part("batch"), "event_id", "ts", _exact(events, "batch"), F.col("batch_size").cast("bigint").alias("batch_size"), "status", F.col("job_id").cast("string").alias("job"), _hash("batch").alias("batch_hash"), _hash("job_id").alias("job_hash"))
    return _stateful(shaped, "part", BatchDone()).select(F.col("batch").cast(kind).alias("batch"), "jobs")


def live_history(runs: DataFrame, initial: DataFrame | None = None, keep: int = 10, p: float = 0.8) -> DataFrame:
    """signature, p80_vram_mb, p80_ram_mb, samples, last_seen of each signature whose last ``keep`` finished runs change: a stream of (signature,
    job_id, finished_at, status, vram_mb, ram_mb).

    The runs are rows in chunks of keyed state, so a batch reads and writes the signatures that it has and those that share their chunks; ``initial``
    (the same columns but status) is what was known before the stream first started. A run that comes again, by a retry or in another file, changes
    nothing, and after a restart the state goes on from the checkpoint. :func:`jobscope.operators.integrity.latest_by_key` of what
    was told is the history.
    """
    whole = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(NONE)).alias(c)
    own = lambda df: df.select(*(F.col(c).cast(runs.schema[c].dataType).alias(c) for c in ("signature", "job_id")), "finished_at", "vram_mb", "ram_mb")
    of = lambda df: df.select(_part("signature"), _hash("signature").alias("hash"), _exact(df, "signature"), _exact(df, "job_id").alias("event_id"), F.col("finished_at").alias("ts"), whole("vram_mb"), whole("ram_mb"))
    shaped = lambda df: of(own(df))
    known = shaped(initial.filter("finished_at is not null")) if initial is not None else None
    told = _stateful(shaped(runs.filter("status in ('done', 'failed') and finished_at is not null")), "part", History(keep, p), initial=known)
    return told.select(F.col("signature").cast(runs.schema["signature"].dataType).alias("signature"), "p80_vram_mb", "p80_ram_mb", "samples", F.timestamp_micros("last_seen_us").alias("last_seen"))


def enrich_as_known(jobs: DataFrame, estimates: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """event_id, job_id, signature, ts, vram_mb, ram_mb: each job event with the estimate that its signature had at that time.

    Both are streams: jobs of (event_id, job_id, signature, ts), estimates of (signature, ts, vram_mb, ram_mb), as :func:`live_history` tells
    them. They meet in one keyed state of versions; see :class:`AsKnown` for when a job is answered and what becomes of late ones.
    """
    # ids go as texts, as pandas would make numbers with gaps floats
    none = lambda c: F.lit(None).cast("string").alias(c)
    text = lambda c: F.col(c).cast("string").alias(c)
    own = lambda c: F.col(c).cast(jobs.schema[c].dataType).alias(c)
    whole = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(NONE)).alias(c)
    asks = jobs.select(text("event_id"), text("job_id"), "signature", "ts", F.lit(NONE).alias("vram_mb"), F.lit(NONE).alias("ram_mb"), F.lit(False).alias("is_estimate"))
    known = estimates.select(none("event_id"), none("job_id"), "signature", "ts", whole("vram_mb"), whole("ram_mb"), F.lit(True).alias("is_estimate"))
    both = asks.unionByName(known)
    shaped = both.select(_part("signature"), _hash("signature").alias("hash"), _exact(both, "signature"), *(c for c in both.columns if c != "signature"))
    told = _stateful(shaped.withWatermark("ts", delay), "part", AsKnown(), "EventTime")
    return told.select(own("event_id"), own("job_id"), F.col("signature").cast(both.schema["signature"].dataType).alias("signature"), F.timestamp_micros("at_us").alias("ts"), "vram_mb", "ram_mb")


def fold_history(spark: SparkSession, recent_path: str, history_path: str, keep: int = 10):
    """A foreachBatch function: folds finished runs into the last ``keep`` runs of each signature, and writes the refreshed history of the
    touched signatures. Each batch rewrites all signatures' runs; :func:`live_history` keeps them in state instead and doesn't.

    ``recent_path`` has a folder for each batch with those runs after it, ``history_path`` one with what changed. A batch reads
    the folder before its own and no older ones, so its work is bounded by signatures and not by all runs ever; one that is
    tried again overwrites its own folders. Folders older than the one before are removed.
    """
    columns = ["signature", "job_id", "finished_at", "vram_mb", "ram_mb"]

    def fold(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        place = session.sparkContext._jvm.org.apache.hadoop.fs.Path(recent_path)
        files = place.getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
        there = sorted(int(f.getPath().getName().partition("=")[2]) for f in files.listStatus(place)) if files.exists(place) else []
        past = [b for b in there if b < batch_id]
        done = batch.filter(F.col("status").isin("done", "failed")).select(*columns)
        before = session.read.schema(done.schema).parquet(f"{recent_path}/batch={past[-1]}") if past else done.limit(0)
        last_runs(before.unionByName(done), keep).select(*columns).write.mode("overwrite").parquet(f"{recent_path}/batch={batch_id}")
        recent = session.read.schema(done.schema).parquet(f"{recent_path}/batch={batch_id}")
        touched = recent.join(done.select("signature").distinct(), "signature", "left_semi")
        p80_history(touched, keep).write.mode("overwrite").parquet(f"{history_path}/batch={batch_id}")
        for old in past[:-1]:
            files.delete(session.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{recent_path}/batch={old}"), True)

    return fold
