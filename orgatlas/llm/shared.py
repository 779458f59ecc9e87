"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java and as a Python character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Rows that a Python worker handles at once, at most.
BATCH_ROWS = 500
#: Parts that the rows of any one key are dealt into in salted joins.
SALTS = 8
#: Keys that are looked up in a broadcast table, at most: each holds at least one row in as many.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def hand_back() -> None:
    """Return what earlier tasks of this worker have freed to the system: workers live on from stage to stage, and beside each other."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most ``rows`` rows, so that what a worker makes of one stays small.

    Spark itself bounds the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    hand_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or the warehouse where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._own_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` wrote and that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_own_path", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def salted(left: DataFrame, right: DataFrame, keys: list[str], by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right`` (few rows per key) where one key may hold a large share of ``left``: its rows are dealt by ``by`` over ``salts`` copies of ``right``.

    ``right`` should be a written table: Spark then knows its size, and broadcasts it if that is small.
    """
    one = left.withColumn("own_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    many = right.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return one.join(many, [*keys, "own_salt"], how).drop("own_salt")


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, by: Column) -> DataFrame:
    """``rows`` left-joined with ``facts`` (a written table, one row per key), where a few keys may hold most of ``rows``.

    Column ``n`` of ``facts`` is the number of ``rows`` with that key. At most ``HOT_KEYS`` keys can hold a share of 1 / ``HOT_KEYS`` or more: their
    facts are broadcast, and the rows that found theirs (or have no key) are dealt out by ``by``. All other keys are joined by a shuffle.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    values, hot = [c for c in facts.columns if c not in keys], F.col(n) * HOT_KEYS >= total
    often = facts.where(hot).select(*keys, *[F.col(c).alias(f"own_often_{c}") for c in values], F.lit(1).alias("own_often"))
    seldom = facts.where(~hot).withColumn("own_deal", F.lit(0))
    done = F.col("own_often").isNotNull()
    for key in keys:
        done = done | F.col(key).isNull()
    dealt = rows.join(F.broadcast(often), keys, "left").withColumn("own_deal", F.when(done, 1 + F.pmod(F.xxhash64(by), F.lit(HOT_KEYS)).cast("int")).otherwise(0))
    return dealt.join(seldom, [*keys, "own_deal"], "left").select(*rows.columns, *[F.coalesce(f"own_often_{c}", c).alias(c) for c in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text (null: none) as an array, without Python."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when a small input has fewer partitions than the cluster has cores; large ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
