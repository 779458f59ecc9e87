"""Structured Streaming forms: pages as they arrive, first-seen URLs, stale runs, activity counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgatlas.operators import extract as X
from orgatlas.sources.html import parse_pages


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Pages (page_id, url, html) of a folder, as files arrive."""
    return spark.readStream.schema("page_id LONG, url STRING, html STRING").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def page_headings(pages: DataFrame) -> DataFrame:
    """The same for batch and stream: titles and headings of pages."""
    parsed = parse_pages(pages)
    return parsed.select("page_id", "title", F.explode_outer(F.col("headings")).alias("heading"))


def incremental_extraction(pages: DataFrame, out: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = page_headings):
    """Append the values of newly arrived pages to a table; each batch is written once (exactly once with the checkpoint)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(urls: DataFrame, ts: str = "ts", url: str = "url", ttl: str = "6 hours") -> DataFrame:
    """Each URL once, at whichever of its times arrives first; a URL may come again when the watermark has passed it by ``ttl``. For an admission that
    does not depend on batches see ``state.admitted``."""
    return urls.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([url])


def run_sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", key: str = "job_id", late: str = "1 hour") -> DataFrame:
    """Spans of activity per run; a run is stale when its last span ended more than ``gap`` ago. Batch or stream."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    spans = source.groupBy(F.session_window(ts, gap).alias("span"), key).agg(F.count("*").alias("n"))
    return spans.select(key, F.col("span.start").alias("started"), F.col("span.end").alias("closed"), "n")


def activity_counts(events: DataFrame, width: str = "1 hour", ts: str = "ts", late: str = "2 hours", failed: Column | None = None) -> DataFrame:
    """Pages and failures per time window. Batch or stream."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    bad = failed if failed is not None else F.coalesce("error", F.lit("")) != ""
    counts = source.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("pages"), F.count_if(bad).alias("failed"))
    return counts.select(F.col("w.start").alias("started"), "pages", "failed")


COUNTS = "started timestamp, pages long, failed long, batch long"


def keep_activity(events: DataFrame, out: str, checkpoint: str, width: str = "1 hour"):
    """Write the windows whose counts changed, batch by batch; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return activity_counts(events, width).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_table(spark: SparkSession, out: str) -> DataFrame:
    """The latest counts of every window that ``keep_activity`` wrote."""
    rows = spark.read.schema(COUNTS).parquet(out)
    return rows.groupBy("started").agg(F.max_by(F.struct("pages", "failed"), "batch").alias("b")).select("started", "b.*")
