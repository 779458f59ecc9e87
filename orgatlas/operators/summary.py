"""One flat row per company for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Summary columns by the struct and field they come from, with their type.
FROM_STRUCTS = {
    "founded_year": ("firmographics.founded_year", "int"), "employees": ("firmographics.employees", "int"), "employee_range": ("firmographics.employee_range", "string"),
    "headquarters": ("firmographics.headquarters", "string"), "domain_created": ("domain.created", "string"), "domain_age_years": ("domain.age_years", "double"), "registrar": ("domain.registrar", "string"),
    "email_provider": ("dns.email_provider", "string"), "mx_records": ("dns.mx", "string"), "dmarc_policy": ("dns.dmarc_policy", "string"), "email_pattern": ("email_pattern", "string"),
    "registry_legal_name": ("registry.name", "string"), "registry_company_number": ("registry.company_number", "string"), "registry_jurisdiction": ("registry.jurisdiction_code", "string"),
    "registry_status": ("registry.current_status", "string"), "registry_company_type": ("registry.company_type", "string"), "registry_incorporation_date": ("registry.incorporation_date", "string"),
    "registry_address": ("registry.registered_address", "string"), "registry_match_confidence": ("registry.match_confidence", "double"), "registry_source": ("registry.source", "string"),
    "registry_lei": ("registry.lei", "string"), "registry_record_url": ("registry.record_url", "string"), "opencorporates_url": ("registry.opencorporates_url", "string"),
    "match": ("match", "string"), "country_code": ("country_code", "string"), "locations": ("locations", "long"), "crawl_status": ("crawl_status", "string"), "crawl_error": ("crawl_error", "string"), "source": ("source", "string"),
}
NETWORKS = ("linkedin", "facebook", "instagram", "twitter", "x", "youtube")


def has(rows: DataFrame, path: str) -> bool:
    """Whether a column, a field of a struct or of the structs in an array exists."""
    kind = rows.schema
    for part in path.split("."):
        kind = kind.elementType if isinstance(kind, ArrayType) else kind
        if not isinstance(kind, StructType) or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True


def summary_row(companies: DataFrame) -> DataFrame:
    """Best values, first person, all addresses, enrichment and register columns beside the listing; what the input lacks is null.

    ``companies``: company_id, name, category, city, best, best_source (maps), missing, people (array of name, title, email, email_guess and
    perhaps email_guess_confidence), emails (array of email), phones (array of e164, valid), tech (array), lead_score, lead_grade, registry (struct); and, where
    known, firmographics, domain, dns (structs), email_pattern and the listing's own columns (:data:`FROM_STRUCTS`).
    """

    def own(path: str, kind: str) -> Column:
        if not has(companies, path):
            return F.lit(None).cast(kind)
        value = F.col(path)
        return F.array_join(value, ", ") if path == "dns.mx" else value.cast(kind)

    best = lambda k: F.try_element_at("best", F.lit(k))
    origin = lambda k: F.try_element_at("best_source", F.lit(k))
    first = F.get("people", F.lit(0))
    every = F.transform("emails", lambda e: e["email"])
    mails = F.when(best("email").isNotNull() & ~F.array_contains(every, best("email")), F.concat(F.array(best("email")), every)).otherwise(every)
    numbers = F.transform(F.filter("phones", lambda p: p["valid"]), lambda p: p["e164"])
    guess = first["email_guess_confidence"] if has(companies, "people.email_guess_confidence") else F.lit(None).cast("string")
    status = F.when(F.nullif(first["email"], F.lit("")).isNotNull(), "found").otherwise(guess)
    officers = F.lit(None).cast("string")
    if has(companies, "registry.officers.name"):
        named = F.transform(F.filter("registry.officers", lambda o: o["current"]), lambda o: F.concat(o["name"], F.lit(" ("), F.coalesce(o["position"], F.lit("officer")), F.lit(")")))
        officers = F.array_join(named, ", ")
    spf = F.coalesce(F.col("dns.spf") != "", F.lit(False)) if has(companies, "dns.spf") else F.lit(None).cast("boolean")
    return companies.select(
        "company_id", "name", "category", "city", best("website").alias("website"), origin("website").alias("website_source"), best("email").alias("email"), origin("email").alias("email_source"),
        best("phone").alias("phone"), origin("phone").alias("phone_source"), F.coalesce(first["name"], best("contact_person")).alias("decision_maker"), first["title"].alias("decision_maker_title"),
        F.coalesce(first["email"], first["email_guess"]).alias("decision_maker_email"), status.alias("decision_maker_email_status"), F.array_join(mails, ", ").alias("all_emails"), F.array_join(numbers, ", ").alias("phones_e164"),
        *[best(f"social_{n}").alias(f"social_{n}") for n in NETWORKS], "lead_score", "lead_grade", F.array_join("tech", ", ").alias("tech_stack"), spf.alias("spf"),
        F.col("registry.name").alias("legal_name"), F.coalesce(own("registry.lei", "string"), own("registry.company_number", "string")).alias("lei"),
        F.coalesce(own("registered_address", "string"), own("registry.registered_address", "string")).alias("registered_address"), officers.alias("registry_officers"), F.array_join("missing", ", ").alias("missing"),
        *[own(path, kind).alias(name) for name, (path, kind) in FROM_STRUCTS.items()],
    )
