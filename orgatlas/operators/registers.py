"""Company registers: records of three sources in one form, candidates by blocking, scoring, the best match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgatlas.functions import text as T
from orgatlas.functions.similarity import name_similarity
from orgatlas.operators.retrieval import search_names
from orgatlas.sources.staging import staged

#: Fixed values.
INACTIVE_STATUS = r"(?i)dissolved|struck|removed|liquidat|inactive"
PENALTY, COUNTRY_BONUS, SURE, LEAST = 0.15, 0.05, 0.85, 0.6
ATTRIBUTIONS = {"gleif": "GLEIF LEI data: CC0", "companieshouse": "Companies House: Open Government Licence", "opencorporates": "OpenCorporates: ODbL"}
SOURCE_ORDER = {"companieshouse": 0, "opencorporates": 1, "gleif": 2}
UNITED_KINGDOM = ("gb", "uk")
LEI_RECORD, UK_RECORD = "https://search.gleif.org/#/record/", "https://find-and-update.company-information.service.gov.uk/company/"

LEI = """lei STRING, ocid STRING, entity STRUCT<legalName: STRUCT<name: STRING>, otherNames: ARRAY<STRUCT<name: STRING, type: STRING>>,
legalAddress: STRUCT<addressLines: ARRAY<STRING>, city: STRING, postalCode: STRING, country: STRING>, headquartersAddress: STRUCT<addressLines: ARRAY<STRING>, city: STRING, postalCode: STRING, country: STRING>,
registeredAs: STRING, jurisdiction: STRING, legalForm: STRUCT<other: STRING>, category: STRING, status: STRING, creationDate: STRING, expiration: STRUCT<date: STRING>>, registration STRUCT<status: STRING, lastUpdateDate: STRING>"""
UK = """company_name STRING, title STRING, company_number STRING, company_status STRING, company_type STRING, type STRING, date_of_creation STRING, date_of_cessation STRING,
registered_office_address STRUCT<care_of: STRING, premises: STRING, address_line_1: STRING, address_line_2: STRING, locality: STRING, region: STRING, postal_code: STRING, country: STRING>,
address STRUCT<care_of: STRING, premises: STRING, address_line_1: STRING, address_line_2: STRING, locality: STRING, region: STRING, postal_code: STRING, country: STRING>,
address_snippet STRING, sic_codes ARRAY<STRING>, previous_company_names ARRAY<STRUCT<name: STRING>>"""
GLOBAL = """name STRING, company_number STRING, jurisdiction_code STRING, company_type STRING, current_status STRING, inactive BOOLEAN, incorporation_date STRING, dissolution_date STRING,
registered_address_in_full STRING, registered_address STRUCT<street_address: STRING, locality: STRING, region: STRING, postal_code: STRING, country: STRING>,
industry_codes ARRAY<STRUCT<code: STRING, description: STRING, industry_code: STRUCT<code: STRING, description: STRING>>>, previous_names ARRAY<STRUCT<company_name: STRING>>,
registry_url STRING, opencorporates_url STRING, source STRUCT<publisher: STRING>, retrieved_at STRING"""
OFFICERS = "officers ARRAY<STRUCT<officer: STRUCT<name: STRING, position: STRING, start_date: STRING, end_date: STRING, inactive: BOOLEAN, nationality: STRING, occupation: STRING>>>"


def blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parts(record: Column, *names: str) -> Column:
    return blank(F.concat_ws(", ", *[blank(record[n]) for n in names]))


def _lei_address(a: Column) -> Column:
    lines = F.concat(F.coalesce(a["addressLines"], F.array().cast("array<string>")), F.array(a["city"], a["postalCode"], a["country"]))
    return blank(F.array_join(F.filter(lines, lambda x: x != ""), ", "))


def normalize_lei(raw: DataFrame, column: str = "json") -> DataFrame:
    """Records of the LEI register."""
    r = raw.select(F.from_json(column, LEI).alias("a")).select("a.*")
    e = F.col("entity")
    names = lambda keep: F.transform(F.filter(F.coalesce(e["otherNames"], F.array().cast("array<struct<name: string, type: string>>")), keep), lambda n: n["name"])
    previous = F.lit("PREVIOUS_LEGAL_NAME")
    return r.select(
        e["legalName"]["name"].alias("name"), e["registeredAs"].alias("company_number"), "lei", T.jurisdiction(e["jurisdiction"]).alias("jurisdiction_code"), F.coalesce(e["legalForm"]["other"], e["category"]).alias("company_type"),
        F.initcap(e["status"]).alias("current_status"), F.coalesce(e["status"] == "INACTIVE", F.lit(False)).alias("inactive"), blank(F.left(e["creationDate"], F.lit(10))).alias("incorporation_date"), blank(F.left(e["expiration"]["date"], F.lit(10))).alias("dissolution_date"),
        _lei_address(e["legalAddress"]).alias("registered_address"), _lei_address(e["headquartersAddress"]).alias("headquarters_address"), names(lambda n: n["type"] == previous).alias("previous_names"), names(lambda n: ~n["type"].eqNullSafe(previous)).alias("other_names"),
        F.concat(F.lit(LEI_RECORD), "lei").alias("record_url"), F.lit("GLEIF").alias("source_publisher"), F.col("registration.status").alias("lei_registration_status"), F.col("registration.lastUpdateDate").alias("retrieved_at"),
    )


def normalize_uk(raw: DataFrame, column: str = "json") -> DataFrame:
    """Records of the UK register."""
    r = raw.select(F.from_json(column, UK).alias("a")).select("a.*")
    fields = ("care_of", "premises", "address_line_1", "address_line_2", "locality", "region", "postal_code", "country")
    record = F.concat(F.lit(UK_RECORD), "company_number")
    return r.select(
        F.coalesce("company_name", "title").alias("name"), "company_number", F.lit("gb").alias("jurisdiction_code"), F.coalesce("company_type", "type").alias("company_type"), F.initcap(F.replace("company_status", F.lit("-"), F.lit(" "))).alias("current_status"),
        F.coalesce((F.col("company_status") != "") & ~F.col("company_status").isin("active", "open"), F.lit(False)).alias("inactive"), F.col("date_of_creation").alias("incorporation_date"), F.col("date_of_cessation").alias("dissolution_date"),
        F.coalesce(parts(F.coalesce("registered_office_address", "address"), *fields), "address_snippet").alias("registered_address"), F.coalesce("sic_codes", F.array().cast("array<string>")).alias("industry_codes"),
        F.filter(F.transform("previous_company_names", lambda p: p["name"]), lambda n: n != "").alias("previous_names"), record.alias("registry_url"), record.alias("record_url"), F.lit("Companies House").alias("source_publisher"),
    )


def normalize_global(raw: DataFrame, column: str = "json") -> DataFrame:
    """Records of the global register."""
    r = raw.select(F.from_json(column, GLOBAL).alias("a")).select("a.*")
    code = lambda x: F.trim(F.concat_ws(" ", F.coalesce(x["industry_code"]["code"], x["code"]), F.coalesce(x["industry_code"]["description"], x["description"])))
    return r.select(
        "name", "company_number", "jurisdiction_code", "company_type", "current_status", "inactive", "incorporation_date", "dissolution_date",
        F.coalesce(blank(F.col("registered_address_in_full")), parts(F.col("registered_address"), "street_address", "locality", "region", "postal_code", "country")).alias("registered_address"),
        F.transform("industry_codes", code).alias("industry_codes"), F.filter(F.transform("previous_names", lambda p: p["company_name"]), lambda n: n != "").alias("previous_names"), "registry_url", "opencorporates_url", F.col("source.publisher").alias("source_publisher"), "retrieved_at",
    )


def normalize_officers(raw: DataFrame, column: str = "json") -> DataFrame:
    """(company_number, pos, name, ...) of the officers in register records (company_number, json)."""
    rows = raw.select("company_number", F.posexplode(F.from_json(column, OFFICERS)["officers"]).alias("pos", "o")).select("company_number", "pos", "o.officer.*")
    current = (F.coalesce("end_date", F.lit("")) == "") & ~F.coalesce("inactive", F.lit(False))
    return rows.select("company_number", "pos", T.display_name(F.col("name")).alias("name"), F.trim("name").alias("name_as_filed"), "position", "start_date", "end_date", current.alias("current"), "nationality", "occupation")


def union_registries(**sources: DataFrame) -> DataFrame:
    """Canonical rows of named sources, each with its source, attribution and a link to the record."""
    out = None
    for name, rows in sources.items():
        missing = {c: F.lit(None).cast("string") for c in ("record_url", "opencorporates_url", "registry_url") if c not in rows.columns}
        tagged = rows.withColumns({**missing, "source": F.lit(name), "attribution": F.lit(ATTRIBUTIONS.get(name, name))})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.withColumn("record_url", F.coalesce("record_url", "opencorporates_url", "registry_url"))


def candidates(companies: DataFrame, registry: DataFrame, max_token_freq: int = 1_000, top: int = 10, least: float = 0.2) -> DataFrame:
    """The register rows most like a company by the words of the name: the ``top`` best in its country and the ``top`` best anywhere.

    ``companies``: company_id, name, country; ``registry``: record_id, name, jurisdiction_code. A word in more than ``max_token_freq`` register names counts as
    frequent (see ``retrieval``). Records whose words make up less than ``least`` of the name by weight (a cosine) are no candidates. ``shared``: rare words and pairs of frequent ones in common; ``ord``: the better place of both lists.
    """
    found = search_names(companies, registry.select("record_id", "name", T.country_of(F.col("jurisdiction_code")).alias("country")), top, max_token_freq, least)
    return found.groupBy("company_id", "record_id").agg(F.max("telling").cast("long").alias("shared"), F.min("ord").alias("ord"))


def score_matches(cands: DataFrame, companies: DataFrame, registry: DataFrame, other_names: bool = False) -> DataFrame:
    """Candidates with their score: similarity (of the best name), less for inactive records, more in the company's country."""
    theirs = registry.select("record_id", F.col("name").alias("record_name"), "jurisdiction_code", "current_status", "inactive", *(["other_names", "previous_names"] if other_names else []))
    rows = cands.join(companies.select("company_id", F.col("name").alias("company_name"), "country"), "company_id").join(theirs, "record_id")
    similarity = name_similarity(F.col("company_name"), F.col("record_name"), LEAST - COUNTRY_BONUS)
    if other_names:
        keys = [c for c in rows.columns if c not in ("other_names", "previous_names", "record_name")]
        every = F.array_distinct(F.array_compact(F.concat(F.array("record_name"), F.coalesce("other_names", F.array().cast("array<string>")), F.coalesce("previous_names", F.array().cast("array<string>")))))
        long = rows.select(*keys, F.explode(every).alias("record_name")).withColumn("similarity", similarity)
        rows = long.groupBy(*keys).agg(F.max("similarity").alias("similarity"), F.max_by("record_name", "similarity").alias("record_name"))
    else:
        rows = rows.withColumn("similarity", similarity)
    quiet = F.coalesce("inactive", F.lit(False)) | F.coalesce(F.col("current_status").rlike(INACTIVE_STATUS), F.lit(False))
    near = F.coalesce(F.startswith("jurisdiction_code", F.lower("country")), F.lit(False))
    score = F.col("similarity") - F.when(quiet, PENALTY).otherwise(0.0) + F.when(near, COUNTRY_BONUS).otherwise(0.0)
    return rows.withColumn("score", F.round(score, 6))


def best_matches(scored: DataFrame) -> DataFrame:
    """The best candidate per company over search stages (column ``stage``); a stage counts only until one is sure.

    Matches below the least score are rejected.
    """
    sure = scored.where(F.col("score") >= SURE).groupBy("company_id").agg(F.min("stage").alias("last"))
    usable = scored.join(sure, "company_id", "left").where(F.col("last").isNull() | (F.col("stage") <= F.col("last")))
    best = usable.groupBy("company_id").agg(F.max_by(F.struct("record_id", "record_name", "score", "stage"), F.struct("score", -F.col("stage"), -F.col("ord"))).alias("b")).select("company_id", "b.*")
    return best.where(F.col("score") >= LEAST).withColumn("match_confidence", F.round(F.least(F.lit(1.0), "score"), 2))


def match_register(companies: DataFrame, registry: DataFrame, max_token_freq: int = 1_000, other_names: bool = False) -> DataFrame:
    """Best register record per company: by name in the country, by name anywhere, then by the domain's label. Names and labels are searched together."""
    site = F.regexp_replace(F.substring_index("domain", ".", 1), "[^A-Za-z]+", " ")
    label = companies.select("company_id", site.alias("name"), "country").where(F.length("name") >= 3)
    told = lambda rows, by_site: rows.select(F.struct("company_id", F.lit(by_site).alias("by_site")).alias("company_id"), "name", "country")
    asked = staged(told(companies, False).unionByName(told(label, True)))
    scored = staged(score_matches(candidates(asked, registry, max_token_freq), asked, registry, other_names))
    country = registry.select("record_id", T.country_of(F.col("jurisdiction_code")).alias("_c"))
    home = F.coalesce(F.col("_c") == F.lower("country"), F.lit(False))  # the same score holds in both stages
    stages = F.when(F.col("company_id.by_site"), F.array(F.lit(3))).when(home, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    rows = scored.join(country, "record_id").withColumn("stage", F.explode(stages)).drop("_c").withColumn("company_id", F.col("company_id.company_id"))
    return best_matches(staged(rows))


def match_uk(companies: DataFrame, registry: DataFrame, max_token_freq: int = 1_000) -> DataFrame:
    """Matches in the UK register, for companies of the UK or of no known country."""
    own = companies.where(F.coalesce(F.lower("country"), F.lit("")).isin(*UNITED_KINGDOM, ""))
    return match_register(own, registry.where(F.startswith("jurisdiction_code", F.lit("gb"))), max_token_freq)


def match_registries(**matches: DataFrame) -> DataFrame:
    """The match of the first source in order that has one. ``matches``: by source name, with company_id and record_id."""
    rows = None
    for source, found in matches.items():
        part = found.select("company_id", "record_id", "match_confidence").withColumns({"source": F.lit(source), "_rank": F.lit(SOURCE_ORDER.get(source, 9))})
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("company_id").agg(F.min_by(F.struct("record_id", "match_confidence", "source"), "_rank").alias("b")).select("company_id", "b.*")


def search_registry(registry: DataFrame, page: int = 1, per_page: int = 30, **filters) -> tuple[DataFrame, DataFrame]:
    """(rows of one page, totals). Filters: name, current_status, company_type, industry_codes, location, incorporated_from,
    incorporated_to, exclude_inactive, jurisdiction_code."""
    rows, per_page = registry, max(1, min(200, per_page))
    if filters.get("name"):
        rows = rows.where(F.contains(F.lower("name"), F.lit(filters["name"].strip().lower())))
    for column in ("current_status", "company_type", "jurisdiction_code"):
        if filters.get(column):
            rows = rows.where(F.lower(column) == filters[column].lower())
    if filters.get("industry_codes"):
        rows = rows.where(F.arrays_overlap("industry_codes", F.array(*map(F.lit, filters["industry_codes"]))))
    if filters.get("location"):
        rows = rows.where(F.contains(F.lower("city"), F.lit(filters["location"].lower())))
    if filters.get("incorporated_from"):
        rows = rows.where(F.col("incorporation_date") >= filters["incorporated_from"])
    if filters.get("incorporated_to"):
        rows = rows.where(F.col("incorporation_date") <= filters["incorporated_to"])
    if filters.get("exclude_inactive"):
        rows = rows.where(~F.coalesce("inactive", F.lit(False)))
    totals = rows.agg(F.count("*").alias("total_count")).withColumn("total_pages", F.ceil(F.col("total_count") / per_page))
    return rows.orderBy("name", "company_number").offset((max(1, page) - 1) * per_page).limit(per_page), totals


def with_officers(registry: DataFrame, officers: DataFrame) -> DataFrame:
    """Register rows with their officers in filing order."""
    lists = officers.groupBy("company_number").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "position", "current"))).alias("officers"))
    return registry.join(lists, "company_number", "left")


def search_officers(officers: DataFrame, name: str, position: str | None = None, current_only: bool = False, page: int = 1, per_page: int = 30) -> DataFrame:
    rows = officers.where(F.contains(F.lower("name"), F.lit(name.lower())))
    rows = rows.where(F.lower("position") == position.lower()) if position else rows
    rows = rows.where("current") if current_only else rows
    return rows.orderBy("name", "company_number", "pos").offset((max(1, page) - 1) * per_page).limit(per_page)
