"""Small fixed tables and joins with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgatlas.functions.text import COUNTRY_ALIASES


def country_codes(rows: DataFrame, column: str, countries: DataFrame) -> DataFrame:
    """Adds ``code``: by alias, else two-letter code, else exact name; NULL when unknown. ``countries``: code, name."""
    typed = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    aliases = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES.items() for x in pair])
    codes = countries.select(F.lower("code").alias("_code"), F.upper("code").alias("_found")).where(F.length("_code") == 2).dropDuplicates(["_code"])
    names = countries.select(F.lower("name").alias("_name"), F.upper("code").alias("_named")).dropDuplicates(["_name"])
    both = rows.withColumn("_typed", typed).join(codes, F.col("_typed") == F.col("_code"), "left").join(names, F.col("_typed") == F.col("_name"), "left")
    return both.withColumn("code", F.coalesce(F.try_element_at(aliases, "_typed"), "_found", "_named")).drop("_typed", "_code", "_found", "_name", "_named")
