"""Streams over several batches with late rows, and restarts, against plain Python over all rows at once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orgatlas.streaming import jobs, state

START = datetime(2024, 1, 1)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(path)


def run(frame, out, check):
    frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def spans(events, quiet):
    out = []
    for job in sorted({e[0] for e in events}):
        rows = sorted((t, k) for j, t, k in events if j == job)
        groups = [[rows[0]]]
        for row in rows[1:]:
            groups.append([row]) if row[0] - groups[-1][-1][0] >= quiet else groups[-1].append(row)
        for g in groups:
            kinds = [k for _, k in g]
            done, found = "finished" in kinds, kinds.count("company")
            out.append((job, g[0][0], g[-1][0] + quiet, len(g), found, "completed" if done or found else "failed", None if done else "interrupted"))
    return sorted(out)


def test_quiet_runs_are_closed_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    own = state.stateful_session(spark)
    events = [(f"job{rng.randrange(6)}", START + timedelta(minutes=rng.randrange(0, 3000)), rng.choice(["page", "page", "page", "company", "finished"])) for _ in range(120)]
    arrival = sorted(events, key=lambda e: e[1] + timedelta(minutes=rng.randrange(0, 9)))  # late by less than the watermark
    stream = own.readStream.schema("job_id string, ts timestamp, kind string").option("maxFilesPerTrigger", 2).parquet
    for part in range(3):
        put(spark, f"{tmp_path}/in", arrival[part * 40 : part * 40 + 40], "job_id string, ts timestamp, kind string")
        run(state.close_quiet_runs(stream(f"{tmp_path}/in"), "45 minutes", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/check")  # each a restart from the checkpoint
        before = own.read.parquet(f"{tmp_path}/out").count()
    assert 0 < before < len(spans(events, timedelta(minutes=45)))
    late = [("job0", START, "finished")]  # far behind the watermark: dropped
    put(spark, f"{tmp_path}/in", [("zz", START + timedelta(days=9), "page"), *late], "job_id string, ts timestamp, kind string")
    run(state.close_quiet_runs(stream(f"{tmp_path}/in"), "45 minutes", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted(tuple(r) for r in own.read.parquet(f"{tmp_path}/out").select("job_id", "started", "closed", "events", "companies", "status", "note").collect())
    assert got == spans(events, timedelta(minutes=45))


def test_urls_are_admitted_again_after_their_time(spark, tmp_path):
    rng = random.Random(2)
    own = state.stateful_session(spark)
    asked = [(f"u{rng.randrange(5)}", START + timedelta(minutes=rng.randrange(0, 3000))) for _ in range(150)]
    arrival = sorted(asked, key=lambda e: e[1] + timedelta(minutes=rng.randrange(0, 9)))
    stream = own.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", 2).parquet
    for part in range(4):
        put(spark, f"{tmp_path}/in", arrival[part * 50 : part * 50 + 50] or [("end", START + timedelta(days=9)), (None, START)], "url string, ts timestamp")
        run(state.admitted(stream(f"{tmp_path}/in"), "6 hours", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/check")
    want = []
    for url in sorted({u for u, _ in asked}):
        last = None
        for at in sorted({t for u, t in asked if u == url}):
            if last is None or at >= last + timedelta(hours=6):
                last = at
                want.append((url, at))
    assert sorted(tuple(r) for r in own.read.parquet(f"{tmp_path}/out").where("url <> 'end'").collect()) == sorted(want)


@pytest.mark.parametrize("batches", [1, 3])
def test_activity_table_over_batches(spark, tmp_path, batches):
    rng = random.Random(3)
    rows = sorted(((START + timedelta(minutes=rng.randrange(0, 600)), rng.choice(["", "timed out", None])) for _ in range(90)), key=lambda r: r[0])
    stream = spark.readStream.schema("ts timestamp, error string").option("maxFilesPerTrigger", 2).parquet
    for part in range(batches):
        put(spark, f"{tmp_path}/in", rows[part * 90 // batches : (part + 1) * 90 // batches], "ts timestamp, error string")
        jobs.keep_activity(stream(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {r.started: (r.pages, r.failed) for r in jobs.activity_table(spark, f"{tmp_path}/out").collect()}
    hours = {t.replace(minute=0) for t, _ in rows}
    assert got == {h: (sum(t.replace(minute=0) == h for t, _ in rows), sum(t.replace(minute=0) == h and bool(e) for t, e in rows)) for h in hours}


class Kept:
    """A state or handle that counts how often it is called."""

    calls = 0

    def __init__(self):
        self.value, self.timers = None, []

    def __getattr__(self, name):
        if name.startswith("get") and name != "get":
            return lambda *_: Kept()
        return {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None),
            "listTimers": lambda: [(t,) for t in self.timers], "deleteTimer": self.timers.remove, "registerTimer": self.timers.append,
        }[Kept.count(name)]

    @staticmethod
    def count(name):
        Kept.calls += 1
        return name


@pytest.mark.parametrize("processor,column", [(lambda: state.Admission(10_000_000), "url"), (lambda: state.RunCloser(10_000_000), "job_id")])
def test_keys_of_a_part_share_their_state(processor, column):
    """Thousands of keys and times cost a handful of calls of the state store, and one timer."""
    import pandas as pd

    own, handle = processor(), Kept()
    own.init(handle)
    rows = pd.DataFrame([(f"k{i % 1000}", 1_000_000 * (i // 1000), "page") for i in range(4000)], columns=[column, "at", "kind"])
    Kept.calls = 0
    assert not list(own.handleInputRows((0,), iter([rows]), None)) and len(handle.timers) == 1

    class Passed:
        def getCurrentWatermarkInMs(self):
            return 10**9

    out = pd.concat(own.handleExpiredTimer((0,), Passed(), None))
    assert len(out) == 1000 and not handle.timers and Kept.calls < 40
