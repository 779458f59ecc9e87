"""Exports of company rows: flat CSV, JSON, and the list of sources with their licences.

CSV files carry no byte-order mark; Spark writes none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Export columns in order, and licence lines by source.
SUMMARY_COLUMNS = (
    "name", "category", "match", "city", "country_code", "website", "website_source", "email", "email_source", "phone", "phone_source", "decision_maker", "decision_maker_title",
    "decision_maker_email", "all_emails", "phones_e164", "social_linkedin", "social_facebook", "social_instagram", "social_twitter", "lead_score", "lead_grade", "tech_stack",
    "legal_name", "lei", "registry_status", "registered_address", "locations", "missing", "crawl_status", "crawl_error", "source",
)
LICENCES = {
    "overture": "Open places: CDLA Permissive 2.0",
    "gleif": "LEI data: CC0 (no restrictions)",
}


def flat(rows: DataFrame) -> DataFrame:
    """List cells become text joined by commas, maps and structs become JSON."""
    out = []
    for field in rows.schema.fields:
        kind = field.dataType.typeName()
        c = F.col(field.name)
        if kind == "array" and field.dataType.elementType.typeName() == "string":
            c = F.array_join(c, ", ")
        elif kind in ("array", "map", "struct"):
            c = F.to_json(c)
        out.append(c.alias(field.name))
    return rows.select(*out)


def with_values(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Export columns (then any others) that have a value in at least one row; one aggregate decides."""
    wanted = columns or [c for c in SUMMARY_COLUMNS if c in rows.columns] + [c for c in rows.columns if c not in SUMMARY_COLUMNS]
    filled = flat(rows)
    counts = filled.agg(*[F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in wanted]).first()
    return filled.select(*[c for c in wanted if counts[c]])


def write_csv(rows: DataFrame, path: str) -> None:
    with_values(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def sources_sheet(rows: DataFrame, licences: dict[str, str] = LICENCES) -> DataFrame:
    """Distinct sources with their licence lines, sorted."""
    lines = F.create_map(*[F.lit(x) for pair in licences.items() for x in pair])
    return rows.select("source").where("source is not null").distinct().withColumn("licence", F.try_element_at(lines, "source")).orderBy("source")
