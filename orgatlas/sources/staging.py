"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are looked up in a broadcast table, at most: each holds at least one row in as many.
HOT_KEYS = 1000


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder (spark.checkpoint.dir, else the warehouse) and read back.

    Cuts the lineage, and lost executors lose nothing of it.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when a small input has fewer partitions than the cluster has cores; large ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """``rows`` with their place under each key in the given order, from 1, where a key may hold a large share of the rows.

    Rows are dealt out by ranges of key and order, so a key of many rows spans several parts; a place is the place in the part and the
    number of the key's rows in the parts before. ``order`` should tell rows of a key apart.
    """
    placed = staged(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    within = placed.withColumn("_within", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    both = within.join(counts.select(*keys, "_part", before.alias("_before")), [*keys, "_part"])
    return both.withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, by: Column) -> DataFrame:
    """``rows`` left-joined with ``facts`` (a staged table, one row per key), where a few keys may hold most of ``rows``.

    Column ``n`` of ``facts`` is the number of ``rows`` with that key. At most ``HOT_KEYS`` keys can hold a share of 1 / ``HOT_KEYS`` or more: their
    facts are broadcast, and the rows that found theirs (or have no key) are dealt out by ``by``. All other keys are joined by a shuffle.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    values, hot = [c for c in facts.columns if c not in keys], F.col(n) * HOT_KEYS >= total
    often = facts.where(hot).select(*keys, *[F.col(c).alias(f"_often_{c}") for c in values], F.lit(1).alias("_often"))
    done = F.col("_often").isNotNull()
    for key in keys:
        done = done | F.col(key).isNull()
    dealt = rows.join(F.broadcast(often), keys, "left").withColumn("_deal", F.when(done, 1 + F.pmod(F.xxhash64(by), F.lit(HOT_KEYS)).cast("int")).otherwise(0))
    return dealt.join(facts.where(~hot).withColumn("_deal", F.lit(0)), [*keys, "_deal"], "left").select(*rows.columns, *[F.coalesce(f"_often_{c}", c).alias(c) for c in values])
