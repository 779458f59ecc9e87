"""Crawled pages as tables: one form for what crawlers leave behind, read at once or as files arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a page. ``headers`` is text, one header a line.
PAGE = {"page_id": "long", "url": "string", "status": "int", "headers": "string", "html": "string"}
FORMATS = ("parquet", "json", "csv", "orc")


def _in_form(rows: DataFrame, names: dict[str, str], columns: tuple[str, ...]) -> DataFrame:
    """The asked columns; one that the files lack is NULL."""
    there = set(rows.columns)
    pick: list[Column] = []
    for c in columns:
        own = names.get(c, c)
        pick.append((F.col(own) if own in there else F.lit(None)).cast(PAGE[c]).alias(c))
    return rows.select(*pick)


def read_pages(spark: SparkSession, path: str, kind: str = "parquet", columns: tuple[str, ...] = tuple(PAGE), names: dict[str, str] | None = None, readable: bool = False) -> DataFrame:
    """Pages of a folder. ``names``: what the files call a column. Only the asked columns are read; with ``readable`` only answers of the 200s and 300s (and those of no known status)."""
    if kind not in FORMATS:
        raise ValueError(f"pages are read from {', '.join(FORMATS)}")
    rows = spark.read.format(kind).options(header=True, escape='"', multiLine=True).load(path) if kind == "csv" else spark.read.format(kind).load(path)
    if readable:
        status = (names or {}).get("status", "status")
        rows = rows.where(F.coalesce(F.col(status).cast("int"), F.lit(200)).between(200, 399)) if status in rows.columns else rows
    return _in_form(rows, names or {}, columns)


def stream_pages(spark: SparkSession, path: str, kind: str = "parquet", columns: tuple[str, ...] = tuple(PAGE), files_per_trigger: int = 100) -> DataFrame:
    """The same for a folder into which files with these very columns arrive."""
    schema = ", ".join(f"{c} {t}" for c, t in PAGE.items())
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path).select(*columns)
