"""Exact duplicates: groups of one 128-bit content hash, bytes compared inside each group, the smallest id stays.

Texts count as equal when they are identical after each run of white space became one space. Rows are grouped by the MD5 of that text and, inside
a hash, by its bytes: the aggregation compares texts only where the hashes agree, each task sends one copy of a text at most,
and a group of any size becomes one row on the way. Then only hashes remain. Where one hash stands for several texts (a collision), the rows of
that hash alone are told apart by their whole texts. Singles need no join; hashes that hold a thousandth of the grouped rows or more are looked up in a broadcast
table of at most a thousand rows, all others by a shuffle of ids and hashes.

Everything is a DataFrame expression. Defined results: null texts count as empty; rows that repeat both a text and its smallest id all stay (they are one document);
rows without doc_id go where their text has a row with one, and stay otherwise; an empty table gives an empty table; other columns are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgatlas.llm.shared import SPACE_CLASS, looked_up, materialize


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS + "+", " ")


def content_hash(body: Column) -> Column:
    """The 128 bits that texts are grouped by."""
    return F.unhex(F.md5(body))


def told(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``docs`` with own_id, own_body (the normalised text), keep_id and group_size. ``digest`` is another hash, for tests."""
    rows = docs.withColumns({"own_id": F.col("doc_id").cast("long"), "own_body": normalised(F.col("text"))}).withColumn("own_hash", digest(F.col("own_body")))
    same = [F.min("own_id").alias("own_keep"), F.count("*").alias("own_size")]
    texts = rows.groupBy("own_hash", "own_body").agg(*same)
    found = texts.groupBy("own_hash").agg(F.count("*").alias("texts"), F.min("own_keep").alias("own_keep"), F.sum("own_size").alias("own_size"))
    found = materialize(found.where("own_size > 1"))
    collided = found.where("texts > 1").select("own_hash")
    if collided.isEmpty():
        out = looked_up(rows, found.drop("texts"), ["own_hash"], "own_size", F.col("own_id"))
    else:
        collided = materialize(collided)
        apart = rows.join(collided, "own_hash", "left_semi")
        out = looked_up(rows.join(collided, "own_hash", "left_anti"), found.where("texts = 1").drop("texts"), ["own_hash"], "own_size", F.col("own_id"))
        out = out.unionByName(apart.join(apart.groupBy("own_hash", "own_body").agg(*same), ["own_hash", "own_body"]).select(*out.columns))
    single = F.col("own_size").isNull()
    return out.withColumns({"own_keep": F.when(single, F.col("own_id")).otherwise(F.col("own_keep")), "own_size": F.coalesce("own_size", F.lit(1).cast("long"))}).drop("own_hash")


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    slim = docs.select("doc_id", "text")
    return told(slim, digest).select(
        F.col("own_id").alias("doc_id"), F.col("own_keep").alias("keep_id"), F.col("own_size").alias("group_size"), F.col("own_id").eqNullSafe(F.col("own_keep")).alias("kept"), F.sha2("own_body", 256).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, as they are."""
    return told(docs).where(F.col("own_id").eqNullSafe(F.col("own_keep"))).select(*docs.columns)


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
