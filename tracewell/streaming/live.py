"""Live jobs over a growing audit log.

Every function takes and returns streaming DataFrames (most work on batch ones too).
Event-time watermarks are added by this engine; the recorded systems have none.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.plans import ordered
from tracewell.plans.lineage import settle
from tracewell.schemas import AUDIT_EVENT
from tracewell.session import ensure_checkpoint_dir
from tracewell.sources.audit_log import PART_GLOB


def follow_log(spark: SparkSession, log_dir: str, files_per_batch: int = 100, pattern: str = PART_GLOB) -> DataFrame:
    """Events of a capture folder as its part files appear; damaged lines are dropped."""
    schema = T.StructType([*AUDIT_EVENT.fields, T.StructField("_bad", T.StringType())])
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(log_dir)
        .where(F.col("_bad").isNull())
        .drop("_bad")
        .withColumn("ts", F.timestamp_millis("ts_ms"))
    )


def event_buckets(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counters of the log per time bucket.

    Sessions are counted first, each with its own counters, so their number is exact and a bucket
    is summed from one row per session.
    """
    flags = {"checkpoints": F.col("type") == "checkpoint", "inputs": F.col("type") == "deterministic_input", "attention": F.col("attention")}
    of_session = (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "session_id")
        .agg(F.count(F.lit(1)).alias("events"), *[F.count_if(flag).alias(name) for name, flag in flags.items()])
    )
    return (
        of_session.groupBy(F.window(F.window_time("w"), width).alias("w"))
        .agg(F.count("session_id").alias("sessions"), *[F.sum(name).alias(name) for name in ("events", *flags)])
        .select(F.unix_millis("w.start").alias("from_ms"), "events", "sessions", *flags)
    )


SESSION_SCHEMA = "session_id string, started_at_ms bigint, last_ts_ms bigint, events bigint, status string, version bigint"


#: Sessions are followed together by a number of their id, so a call of the stream's state serves many of them.
SESSION_GROUPS = 512
_RUNS = pa.schema([("session_id", pa.string()), ("start", pa.int64()), ("last", pa.int64()), ("events", pa.int64()), ("ended", pa.bool_())])


def _stored(batch: pa.RecordBatch) -> bytes:
    return batch.serialize().to_pybytes()


def _restored(data: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(bytes(data)), schema)


class _Sessions(StatefulProcessor):
    """The runs of the session ids of a group: stretches of events without a silence of ``stale_ms``.

    A run is kept under its first time while the watermark may still bring events to it; an event
    between two runs joins them. Each change comes out as a row with a rising version.  The runs of a
    group are one packed value, and have one timer: that of the run that is over first.
    """

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "runs binary, version bigint, due bigint")

    def _get(self) -> tuple[dict[str, np.ndarray], int, int | None]:
        data, version, due = self.held.get() if self.held.exists() else (_stored(pa.RecordBatch.from_pylist([], _RUNS)), 0, None)
        runs = _restored(data, _RUNS)
        return {c: runs.column(c).to_numpy(zero_copy_only=False) for c in _RUNS.names}, version, due

    def _put(self, runs: dict[str, np.ndarray], version: int, due: int | None) -> None:
        until = int(runs["last"].min()) + self.stale_ms if len(runs["last"]) else None
        if until != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if until is not None:
                self.handle.registerTimer(until)
        self.held.update((_stored(pa.RecordBatch.from_pydict({c: runs[c] for c in _RUNS.names}, _RUNS)), version, until))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, version, due = self._get()
        runs, merged = {**before, "was": np.arange(len(before["start"]))}, []
        for batch in rows:
            batch = batch[batch["session_id"].notna()]  # not the end mark
            ts = batch["ts_ms"].to_numpy(np.int64)
            arrived = {
                "session_id": batch["session_id"].to_numpy(object), "start": ts, "last": ts, "events": np.ones(len(ts), np.int64),
                "ended": (batch["type"] == "session_end").to_numpy(bool), "was": np.full(len(ts), -1),
            }
            runs, taken = self._joined({c: np.concatenate([runs[c], arrived[c]]) for c in runs})
            merged.append(taken)
        was, gone = runs.pop("was"), np.concatenate(merged) if merged else np.zeros(0, np.int64)
        same = was >= 0
        for c in ("last", "events", "ended"):
            same[same] &= runs[c][same] == before[c][was[same]]
        changed = [
            pd.DataFrame({c: before[c][gone] for c in _RUNS.names} | {"events": 0, "status": "merged"}),
            pd.DataFrame({c: runs[c][~same] for c in _RUNS.names} | {"status": np.where(runs["ended"][~same], "closed", "open")}),
        ]
        self._put(runs, version + sum(map(len, changed)), due)
        yield self._rows(pd.concat(changed), version)

    def _rows(self, changed: pd.DataFrame, version: int) -> pd.DataFrame:
        names = {"start": "started_at_ms", "last": "last_ts_ms"}
        changed = changed.rename(columns=names)[["session_id", *names.values(), "events", "status"]]
        return changed.assign(version=np.arange(version + 1, version + 1 + len(changed)))

    def _joined(self, runs: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The runs that these make, and which of those from before have become a part of another one."""
        if not len(runs["start"]):
            return runs, np.zeros(0, np.int64)
        session, _ = pd.factorize(runs["session_id"])
        order = np.lexsort((runs["start"], session))
        session, runs = session[order], {c: v[order] for c, v in runs.items()}
        last = pd.Series(runs["last"]).groupby(session).cummax().to_numpy()
        fresh = np.ones(len(session), bool)
        fresh[1:] = (session[1:] != session[:-1]) | (runs["start"][1:] - last[:-1] >= self.stale_ms)
        firsts, run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        inner = runs["start"] != runs["start"][firsts][run]
        return {
            "session_id": runs["session_id"][firsts], "start": runs["start"][firsts], "last": np.maximum.reduceat(runs["last"], firsts),
            "events": np.add.reduceat(runs["events"], firsts), "ended": np.logical_or.reduceat(runs["ended"], firsts),
            "was": np.maximum.reduceat(np.where(inner, -1, runs["was"]), firsts),
        }, runs["was"][inner & (runs["was"] >= 0)]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, version, _ = self._get()
        silent = runs["last"] <= timerValues.getCurrentWatermarkInMs() - self.stale_ms
        gone = pd.DataFrame({c: runs[c][silent & ~runs["ended"].astype(bool)] for c in _RUNS.names} | {"status": "interrupted"})
        self._put({c: v[~silent] for c, v in runs.items()}, version + len(gone), None)
        if len(gone):
            yield self._rows(gone, version)


def session_changes(events: DataFrame, stale_ms: int = 43_200_000, delay: str = "10 minutes") -> DataFrame:
    """Sessions as they change: open with the first event, closed by an end event, interrupted by a
    timer after a silence of ``stale_ms``; ``merged`` takes back a run that turned out to be part of
    an earlier one.  Events up to ``delay`` late find their run.  Sessions that are open when the
    input ends have come out as such."""
    group = F.pmod(F.xxhash64("session_id"), F.lit(SESSION_GROUPS)).alias("group")
    timed = events.select("session_id", "ts_ms", "type", F.timestamp_millis("ts_ms").alias("ts"), group).withWatermark("ts", delay)
    return timed.groupBy("group").transformWithStateInPandas(_Sessions(stale_ms), SESSION_SCHEMA, "Append", "EventTime")


def latest_sessions(changes: DataFrame) -> DataFrame:
    """The last state of every session from its changes."""
    last = F.max_by(F.struct("last_ts_ms", "events", "status"), "version").alias("s")
    found = changes.groupBy("session_id", "started_at_ms").agg(last)
    return found.select("session_id", "started_at_ms", "s.*").where(F.col("status") != "merged")


def host_buckets(samples: DataFrame, gauges: list[str], width: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """Mean of each gauge per host and time bucket; a gauge without value stays null."""
    return (
        samples.withWatermark("ts", delay)
        .groupBy("host", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("samples"), *[F.avg(g).alias(g) for g in gauges])
        .select("host", F.unix_millis("w.start").alias("from_ms"), "samples", *gauges)
    )


def retained(samples: DataFrame, now_ms, days: int = 7) -> DataFrame:
    """Samples inside the retention time (a filter on the partition column drops whole days)."""
    return samples.where(F.col("ts_ms") >= (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)) - days * 86_400_000)


#: Waiting rows that are stored, and looked at, together.
ROWS_TOGETHER = 50_000

LIMIT_SCHEMA = "key string, ts_ms bigint, id bigint, allowed boolean, retry_after bigint"


class _InOrder(StatefulProcessor):
    """Rows of a key in their order, however they arrive.

    Rows wait in a list, packed by batches, until the watermark has passed them; a timer then hands
    over all that are due, sorted by ``order``, to ``judge`` with what it remembers of the rows before.
    Input is taken one batch at a time; a key holds the rows of the delay.
    """

    #: Columns that wait, their order, what is remembered and from what it starts, and the result.
    columns: pa.Schema
    order: list[str]
    memory: str
    start: tuple
    result: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.remembered = handle.getValueState("remembered", self.memory)
        self.due = handle.getValueState("due", "due bigint")

    def judge(self, key: tuple, rows: pa.Table, memory: tuple) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def _wait(self, until: int) -> None:
        if self.due.exists():
            if self.due.get()[0] <= until:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(until)
        self.due.update((until,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if key[0] is None or batch.empty:  # the end mark
                continue
            self.waiting.appendValue((_stored(pa.RecordBatch.from_pandas(batch, self.columns, preserve_index=False)),))
            least = int(batch["ts_ms"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self._wait(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for (data,) in self.waiting.get():
            rows = _restored(data, self.columns)
            over = pc.less_equal(rows.column("ts_ms"), passed)
            due.append(rows.filter(over))
            rest.append(rows.filter(pc.invert(over)))
        self.due.clear()
        rest = pa.Table.from_batches(rest, self.columns).combine_chunks()
        if rest.num_rows:
            self.waiting.put([(_stored(rows),) for rows in rest.to_batches(ROWS_TOGETHER)])
            self._wait(pc.min(rest["ts_ms"]).as_py())
        else:
            self.waiting.clear()
        due = pa.Table.from_batches(due, self.columns)
        due = due.take(np.lexsort([due[c].to_numpy() for c in reversed(self.order)]))
        found, memory = self.judge(key, due, tuple(self.remembered.get()) if self.remembered.exists() else self.start)
        self.remembered.update(memory)
        if found:
            yield pd.DataFrame(found, columns=self.result)


class _Limiter(_InOrder):
    """Verdicts in time order; the window of a key starts at its first hit."""

    columns, order = pa.schema([("ts_ms", pa.int64()), ("id", pa.int64())]), ["ts_ms", "id"]
    memory, start = "start bigint, count bigint", (None, 0)
    result = ["key", "ts_ms", "id", "allowed", "retry_after"]

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def judge(self, key: tuple, rows: pa.Table, memory: tuple) -> tuple[list[tuple], tuple]:
        start, count = memory
        out = []
        for ts, no in zip(rows["ts_ms"].to_pylist(), rows["id"].to_pylist(), strict=True):
            if start is None or ts - start >= self.window_ms:
                start, count = ts, 0
            wait = 0 if count < self.limit else max(1, (self.window_ms - (ts - start)) // 1000 + 1)
            count += wait == 0
            out.append((key[0], ts, no, wait == 0, wait))
        return out, (start, count)


def rate_limit_stream(hits: DataFrame, limit: int, window_ms: int, delay: str = "1 minute") -> DataFrame:
    """Verdict per hit (key, ts_ms, id), once the watermark has passed it, in the order of time."""
    timed = hits.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)
    return timed.groupBy("key").transformWithStateInPandas(_Limiter(limit, window_ms), LIMIT_SCHEMA, "Append", "EventTime")


def _starts(times: DataFrame, window_ms: int) -> DataFrame:
    """(key, ts_ms) at which windows start: the first time of a key, then always the first one a
    window later.

    Each time knows its successor by one backward scan; starts are marked by doubling: a round marks
    what the marked ones reach and squares the reach, so n windows take log2(n) rounds.
    """
    here = times.select("key", F.col("ts_ms").alias("at"), F.lit(1).alias("hit"), "ts_ms")
    probe = times.select("key", (F.col("ts_ms") + window_ms).alias("at"), F.lit(0).alias("hit"), "ts_ms")
    known = ordered.next_known(F.when(F.col("hit") == 1, F.col("at")))
    found = ordered.scan(here.unionByName(probe), ["key"], ["at", "hit"], next=known)
    jump = settle(found.where((F.col("hit") == 0) & F.col("next").isNotNull()).select("key", "ts_ms", "next"))
    spans = times.groupBy("key").agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    most = spans.agg(F.max((F.col("last") - F.col("first")) / window_ms)).first()[0]
    marked = spans.select("key", F.col("first").alias("ts_ms"))
    for _ in range(int(most or 0).bit_length()):
        marked = settle(marked.unionByName(marked.join(jump, ["key", "ts_ms"]).select("key", F.col("next").alias("ts_ms"))))
        further = jump.select("key", F.col("ts_ms").alias("next"), F.col("next").alias("after"))
        jump = settle(jump.join(further, ["key", "next"]).select("key", "ts_ms", F.col("after").alias("next")))
    return marked


def rate_limit_batch(hits: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """The same verdicts over a table; a key of any size spreads over tasks."""
    hits = hits.select("key", "ts_ms", "id")
    starts = _starts(hits.select("key", "ts_ms").distinct(), window_ms).withColumn("start", F.col("ts_ms"))
    begun = hits.join(starts, ["key", "ts_ms"], "left")
    placed = ordered.scan(begun, ["key"], ["ts_ms", "id"], begin=ordered.last_known(F.col("start")))
    counted = ordered.scan(placed, ["key", "begin"], ["ts_ms", "id"], no=ordered.row_number())
    allowed = F.col("no") <= limit
    wait = F.greatest(F.lit(1).cast("long"), F.floor((window_ms - (F.col("ts_ms") - F.col("begin"))) / 1000) + 1)
    return counted.select("key", "ts_ms", "id", allowed.alias("allowed"), F.when(allowed, F.lit(0).cast("long")).otherwise(wait).alias("retry_after"))


ALARM_SCHEMA = "capture string, seq_global bigint, alarm string, expected string, found string"


class _Chain(_InOrder):
    """Gaps and broken links of a capture in the order of its numbers."""

    columns, order = pa.schema([("ts_ms", pa.int64()), ("seq_global", pa.int64()), ("hash", pa.large_string()), ("prev_hash", pa.large_string())]), ["seq_global"]
    memory, start = "seq bigint, hash string", (0, "")
    result = ["capture", "seq_global", "alarm", "expected", "found"]

    def judge(self, key: tuple, rows: pa.Table, memory: tuple) -> tuple[list[tuple], tuple]:
        out, (seq, last) = [], memory
        for part in rows.to_batches(ROWS_TOGETHER):
            no, digest, prev = (part.column(c) for c in ("seq_global", "hash", "prev_hash"))
            before_no = pa.concat_arrays([pa.array([seq], no.type), no[:-1]])
            before = pa.concat_arrays([pa.array([last], digest.type), digest[:-1]])
            gap = pc.not_equal(no, pc.add(before_no, 1))
            linked = pc.or_(pc.equal(prev, before).fill_null(False), pc.and_(prev.is_null(), before.is_null()))
            wrong = pc.indices_nonzero(pc.or_(gap, pc.invert(linked)))
            for at, was, on, link, want, found in zip(*(x.take(wrong).to_pylist() for x in (no, before_no, gap, linked, before, prev)), strict=True):
                if on:
                    out.append((key[0], at, "gap", str(was + 1), str(at)))
                if not link:
                    out.append((key[0], at, "link", want, found))
            seq, last = no[-1].as_py(), digest[-1].as_py()
        return out, (seq, last)


def chain_alarms(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Gap and link alarms per capture (capture, ts_ms, seq_global, hash, prev_hash), as the checks of
    the stored log give them, though events may arrive in another order within ``delay``."""
    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)
    return timed.groupBy("capture").transformWithStateInPandas(_Chain(), ALARM_SCHEMA, "Append", "EventTime")


STORES = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming job over all data present and read back what it appended."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = os.path.join(spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")
    spark.conf.set(STORES, ROCKS)  # timers and lists of a key need this store
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
