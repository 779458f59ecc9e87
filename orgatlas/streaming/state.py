"""Streams that keep state until a timer of event time fires: runs that went quiet are closed, URLs are admitted again after a while.

Both give the same rows whatever batches the events arrive in, as long as none is later than the watermark: state holds what is not decided yet, and
a timer decides it when the watermark has passed. Keys share the state and the timer of their part, since each call of the state store costs about as much as hundreds of rows. They need a state store with column families (see ``stateful_session``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INTERRUPTED = "interrupted"
RUNS = "job_id string, started long, closed long, events long, companies long, status string, note string"
ADMITTED = "url string, at long"
#: Parts that keys are dealt into; each has one state and one timer.
PARTS = 512


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` (same context, other settings) whose streams keep their state in RocksDB."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.checkpoint.dir", "spark.sql.warehouse.dir", "spark.sql.session.timeZone"):
        value = spark.conf.get(key, None)
        if value is not None and key.startswith("spark.sql.s"):
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own


def part_of(key: str):
    """The part that holds a key's state: a part is read and written once a batch, whatever number of keys it has."""
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


def read_columns(state) -> list[tuple]:
    """Rows kept as one array a column."""
    return list(zip(*state.get(), strict=True)) if state.exists() else []


def write_columns(state, rows: list[tuple]) -> None:
    if rows:
        state.update(tuple(map(list, zip(*rows, strict=True))))
    else:
        state.clear()


def wake_at(handle: StatefulProcessorHandle, at: int | None) -> None:
    """One timer, or none, in place of those that are set."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
    if at is not None:
        handle.registerTimer(at)


class RunCloser(StatefulProcessor):
    """Open spans of the runs of one part: run, start, last event, events, companies, finished. A span is closed when the watermark passes its last event by ``quiet`` microseconds."""

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "job array<string>, start array<long>, last array<long>, events array<long>, companies array<long>, finished array<boolean>")

    def merged(self, spans: list[tuple]) -> list[tuple]:
        """Spans of a run that are no further apart than ``quiet`` become one."""
        out: list[tuple] = []
        for job, start, last, events, companies, finished in sorted(spans):
            if out and job == out[-1][0] and start - out[-1][2] < self.quiet:
                a = out.pop()
                out.append((job, a[1], max(a[2], last), a[3] + events, a[4] + companies, a[5] or finished))
            else:
                out.append((job, start, last, events, companies, finished))
        return out

    def keep(self, spans: list[tuple]) -> None:
        write_columns(self.open, spans)
        wake_at(self.handle, min(last for _, _, last, *_ in spans) // 1000 + self.quiet // 1000 + 1 if spans else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = read_columns(self.open)
        for part in rows:
            events = zip(part["job_id"], part["at"].tolist(), part["kind"], strict=True)
            spans += [(job, at, at, 1, int(kind == "company"), kind == "finished") for job, at, kind in events]
        self.keep(self.merged(spans))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        over, rest = [], []
        for s in read_columns(self.open):
            (over if (s[2] + self.quiet) // 1000 < now else rest).append(s)
        self.keep(rest)
        if over:
            yield pd.DataFrame(
                [(s[0], s[1], s[2] + self.quiet, s[3], s[4], "completed" if s[5] or s[4] else "failed", None if s[5] else INTERRUPTED) for s in over],
                columns=["job_id", "started", "closed", "events", "companies", "status", "note"],
            )


def close_quiet_runs(events: DataFrame, quiet: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs as they end: a run that has been quiet for ``quiet`` is closed, as completed if it said so or has found companies, else as failed.

    ``events``: a stream of job_id, ts, kind (``company`` and ``finished`` matter). Out: job_id, started, closed, events, companies, status, note. Events without job_id or ts are left out.
    """
    rows = events.where("job_id is not null and ts is not null").select(F.col("job_id").cast("string").alias("job_id"), "ts", F.unix_micros("ts").alias("at"), F.coalesce("kind", F.lit("")).alias("kind")).withWatermark("ts", late)
    runs = rows.withColumn("part", part_of("job_id")).groupBy("part").transformWithStateInPandas(RunCloser(int(pd.Timedelta(quiet).total_seconds() * 1_000_000)), RUNS, "Append", "EventTime")
    return runs.withColumns({c: F.timestamp_micros(c) for c in ("started", "closed")})


class Admission(StatefulProcessor):
    """Of the URLs of one part: when each was last admitted, and the times at which it was asked for since, that the watermark has not passed."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "url array<string>, at array<long>")
        self.asked = handle.getValueState("asked", "url array<string>, at array<long>")
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = set(read_columns(self.asked))
        for part in rows:
            waiting.update(zip(part["url"], part["at"].tolist(), strict=True))
        write_columns(self.asked, sorted(waiting))
        first = min(at for _, at in waiting) // 1000 + 1
        self.wake(min(first, self.next.get()[0]) if self.next.exists() else first)
        return iter(())

    def wake(self, at: int | None) -> None:
        wake_at(self.handle, at)
        if at is None:
            self.next.clear()
        else:
            self.next.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for url, at in read_columns(self.asked):
            (due if at // 1000 < now else rest).append((url, at))
        last = dict(read_columns(self.last))
        out = []
        for url, at in sorted(due):
            if url not in last or at >= last[url] + self.ttl:
                last[url] = at
                out.append((url, at))
        held = [(url, at) for url, at in last.items() if (at + self.ttl) // 1000 >= now]  # anything from there on is admitted anyway
        write_columns(self.asked, rest)
        write_columns(self.last, held)
        self.wake(min([at // 1000 + 1 for _, at in rest] + [(at + self.ttl) // 1000 + 1 for _, at in held], default=None))
        if out:
            yield pd.DataFrame(out, columns=["url", "at"])


def admitted(urls: DataFrame, ttl: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """(url, ts) of the requests that are let through: a URL's first, and then the first that comes ``ttl`` or more after the last one let through.

    ``urls``: a stream of url, ts. Requests are decided in the order of their times, so each comes out when the watermark has passed it. Rows without url or ts are left out.
    """
    rows = urls.where("url is not null and ts is not null").select("url", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    found = rows.withColumn("part", part_of("url")).groupBy("part").transformWithStateInPandas(Admission(int(pd.Timedelta(ttl).total_seconds() * 1_000_000)), ADMITTED, "Append", "EventTime")
    return found.select("url", F.timestamp_micros("at").alias("ts"))
