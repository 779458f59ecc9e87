"""Saved runs: latest version per id, recent runs, removal, stale runs, list sizes; and what exports need."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgatlas.sources.staging import staged


def latest_by_key(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Insert-or-replace: the row of the highest version per key."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(version))  # pre-aggregated, so a key with very many versions is no hot group
    return rows.groupBy(F.col(key).alias("_key")).agg(newest.alias("_row")).select("_row.*")


#: Parts that a kept table is cut into by its key.
BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _kept(spark: SparkSession, path: str, columns: str) -> DataFrame | None:
    """All rows of a kept table with their bucket, markers included; None where there is no table yet."""
    try:
        return spark.read.schema(f"{columns}, _bucket int").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_kept(spark: SparkSession, path: str, columns: str, key: str = "id", only: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a kept table; with ``only`` the row of one key, of which just its bucket is read."""
    rows = _kept(spark, path, columns).where(F.col(key).isNotNull())
    if only is not None:
        rows = rows.where((F.col("_bucket") == F.pmod(F.xxhash64(F.lit(only)), F.lit(buckets)).cast("int")) & (F.col(key).cast("string") == only))
    return rows.drop("_bucket")


def _replace(rows: DataFrame, touched: list[int], path: str, key: str) -> None:
    """Put ``rows`` in the place of the touched buckets; a marker row without key keeps an emptied bucket from looking untouched."""
    spark = rows.sparkSession
    marks = spark.createDataFrame([(b,) for b in touched], "_bucket int").select(*[F.col(c) if c == "_bucket" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    ready = staged(rows.unionByName(marks))  # the files that are replaced are read until here
    ready.repartition(len(touched) or 1, "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def merge_into(changes: DataFrame, path: str, key: str = "id", version: str = "version", buckets: int = BUCKETS) -> list[int]:
    """Insert or replace rows of a table kept as Parquet: of a key the row of the highest version stays. Only the buckets of changed keys are read and written again.

    Changes without key are left out. Returns the buckets that were touched (at most ``buckets``).
    """
    spark, columns = changes.sparkSession, ", ".join(f"`{c}` {t}" for c, t in changes.dtypes)
    fresh = staged(latest_by_key(changes.where(F.col(key).isNotNull()), key, version).withColumn("_bucket", _bucket(key, buckets)))
    touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())
    old = _kept(spark, path, columns)
    if old is not None:
        fresh = latest_by_key(old.where(F.col("_bucket").isin(touched) & F.col(key).isNotNull()).unionByName(fresh), key, version)
    if touched:
        _replace(fresh, touched, path, key)
    return touched


def delete_from(spark: SparkSession, path: str, columns: str, ids: DataFrame, key: str = "id", buckets: int = BUCKETS) -> list[int]:
    """Remove the rows with these keys; only their buckets are read and written again."""
    gone = staged(ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_bucket", _bucket(key, buckets)))
    touched = sorted(r[0] for r in gone.select("_bucket").distinct().collect())
    old = _kept(spark, path, columns)
    if touched and old is not None:
        rest = old.where(F.col("_bucket").isin(touched) & F.col(key).isNotNull()).join(gone.select(key), key, "left_anti")
        _replace(rest.select(*old.columns), touched, path, key)
    return touched


def by_id(rows: DataFrame, id: str, key: str, version: str) -> DataFrame:
    """The latest row of one key, or none."""
    return latest_by_key(rows.where(F.col(key) == id), key, version)


def recent(rows: DataFrame, created: str, key: str, n: int = 30) -> DataFrame:
    return rows.orderBy(F.desc(created), key).limit(n)


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among ``ids``."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def close_stale(rows: DataFrame, as_of: Column, max_age: str = "INTERVAL 1 HOUR", has_companies: Column | None = None) -> DataFrame:
    """Runs still marked running past ``max_age`` are completed if they have companies, else failed, with a note."""
    stale = (F.col("status") == "running") & (F.col("created_at") < as_of - F.expr(max_age))
    ended = F.when(F.coalesce(has_companies, F.lit(False)) if has_companies is not None else F.lit(False), "completed").otherwise("failed")
    return rows.withColumn("note", F.when(stale, "interrupted")).withColumn("status", F.when(stale, ended).otherwise(F.col("status")))


def list_counts(lists: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Adds ``n_companies`` to saved lists; 0 where a list is empty."""
    counts = members.groupBy(key).agg(F.count("*").alias("n_companies"))
    return lists.join(counts, key, "left").withColumn("n_companies", F.coalesce("n_companies", F.lit(0)))
