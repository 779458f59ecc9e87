"""From values found on pages to one best value per field of a company, with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgatlas.functions import text as T
from orgatlas.sources.staging import staged

#: Fields of a profile, and the confidence of each kind of candidate.
FIELDS = ("company_name", "description", "founder_ceo", "business_email", "ceo_email", "phone", "website", "locations", "services", "industries", "technologies", "clients", "case_studies", "certifications", "social_links")
SECTION_FIELDS = {"services": "services", "industries": "industries", "technology": "technologies", "case_studies": "case_studies"}
ORGANISATION_TYPES = ("organization", "corporation", "localbusiness", "professionalservice")
ADDRESS_PARTS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
GENERIC_EMAIL = r"(?i)^(info|contact|hello|sales|business|inquir|enquir)"

CANDIDATE = ("company_id", "field", "value", "confidence", "source_url", "source_type", "ord")

#: Places in the order of evidence: pages are further apart than any page has values, scripts of a page than any script has objects; what has no place of its own comes after all pages.
PAGE_STEP, SCRIPT_STEP, LATE, LAST = 1 << 32, 1 << 20, 1 << 61, 1 << 62


def choose_best(candidates: DataFrame, *keys: str, with_evidence: bool = True) -> DataFrame:
    """Per key and field the value of highest confidence, the first on ties, with all candidates as evidence.

    ``candidates``: keys, field, value, confidence, source_url, source_type, ord. Blank values are dropped. The evidence of one key is gathered in one row; where a
    key may have more of it than a row holds, ``with_evidence=False`` gives its number only, all pre-aggregated: the candidates are then the long table of evidence.
    """
    keys = keys or ("company_id", "field")
    text = dict(candidates.dtypes)["value"] == "string"
    usable = candidates.where(T.clean(F.col("value")) != "") if text else candidates.withColumn("value", F.filter(F.transform("value", T.clean), lambda v: v != "")).where("size(value) > 0")
    best = F.max_by(F.struct("value", "confidence", "source_url", "source_type"), F.struct("confidence", -F.col("ord")))
    if not with_evidence:
        return usable.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("n_evidence")).select(*keys, "b.*", "n_evidence")
    evidence = F.sort_array(F.collect_list(F.struct("ord", "value", "source_url", "source_type", "confidence")))
    return usable.groupBy(*keys).agg(best.alias("b"), evidence.alias("evidence")).select(*keys, "b.*", "evidence")


def without_name(candidates: DataFrame, fallback: DataFrame) -> DataFrame:
    """Name candidates of second rank count only for companies that have none of first rank."""
    named = candidates.where("field = 'company_name'").select("company_id").distinct()
    return candidates.unionByName(fallback.join(named, "company_id", "left_anti"))


def preferred_email(emails: DataFrame, key: str = "company_id") -> DataFrame:
    """The first address that greets the public, else the first."""
    return emails.groupBy(key).agg(F.min_by("email", F.struct(~F.col("email").rlike(GENERIC_EMAIL), F.col("ord"))).alias("business_email"))


def ceo_email(emails: DataFrame, names: DataFrame, key: str = "company_id") -> DataFrame:
    """The first address whose local part contains a part (three letters at least) of the leader's name."""
    parts = F.transform(F.regexp_extract_all(F.substring_index("founder_ceo", "(", 1), F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower)
    both = emails.join(names.select(key, parts.alias("parts")), key)
    local = F.lower(F.substring_index("email", "@", 1))
    return both.where(F.exists("parts", lambda p: F.contains(local, p))).groupBy(key).agg(F.min_by("email", "ord").alias("ceo_email"))


def value_list(values: DataFrame, least: int, most: int, shorter_than: int | None = None, key: str = "company_id") -> DataFrame:
    """Distinct labels in order as one array per key, if there are at least ``least``; cut at ``most``."""
    kept = values.where(F.length("value") < shorter_than) if shorter_than else values
    enough = kept.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    label = T.clean(F.col("value"))
    labels = kept.where((label != "") & ~F.lower(label).isin(*T.GENERIC)).groupBy(key, F.lower(label).alias("_label")).agg(F.min(F.struct("ord", "value")).alias("_first"))
    placed = labels.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy("_first"))).where(F.col("_place") <= most)
    lists = placed.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("_first")), lambda x: T.clean(x["value"])).alias("values"))  # ``most`` of a key
    return enough.join(lists, key, "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def leader_confidence(title: Column, category: Column) -> Column:
    base = F.when(title.rlike(r"(?i)\bceo\b|chief executive"), 0.9).when(title.rlike("(?i)founder"), 0.8).otherwise(0.6)
    return base + F.when(category == "team", 0.05).otherwise(0.0)


def field_candidates(pages: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """All candidates of the profile fields, each with its confidence.

    ``pages``: company_id, page_id, url, category, page_ord, title, description, site_name, seed_url.
    ``found``: long tables by name (emails, phones, socials, headings, people, addresses, certifications,
    logos, links, objects), each with page_id, pos and its values.
    """
    base = pages.select("company_id", "page_id", "url", "category", "page_ord")

    def on_page(name: str) -> DataFrame:
        return base.join(found[name], "page_id").withColumn("ord", (F.col("page_ord") * PAGE_STEP + F.col("pos")).cast("long"))

    def one(rows: DataFrame, field: str, value: Column, confidence, kind: str, ord_: Column | None = None, url: Column | None = None) -> DataFrame:
        return rows.select(
            "company_id", F.lit(field).alias("field"), F.array(value.cast("string")).alias("value"), (confidence if isinstance(confidence, Column) else F.lit(float(confidence))).cast("double").alias("confidence"),
            (F.col("url") if url is None else url).alias("source_url"), F.lit(kind).alias("source_type"), (F.col("ord") if ord_ is None else ord_).cast("long").alias("ord"),
        )

    def listed(rows: DataFrame, field: str, confidence: float, kind: str, least: int = 1, most: int = 10_000, shorter_than: int | None = None) -> DataFrame:
        first = rows.groupBy("company_id").agg(F.min_by("url", "ord").alias("source_url"), F.min("ord").alias("ord"))
        values = value_list(rows.select("company_id", "ord", "value"), least, most, shorter_than)
        return values.join(first, "company_id").select("company_id", F.lit(field).alias("field"), F.col("values").alias("value"), F.lit(confidence).alias("confidence"), "source_url", F.lit(kind).alias("source_type"), "ord")

    out = []
    if "objects" in found:
        get = lambda path: F.try_variant_get("object", path, "string")
        objects = on_page("objects").withColumn("type", F.lower(F.coalesce(get("$['@type']"), F.lit(""))))
        objects = objects.where(F.col("type").isin(*ORGANISATION_TYPES) | F.col("type").contains("organization"))
        for field, path, confidence in (("company_name", "$.name", 0.99), ("website", "$.url", 0.99), ("business_email", "$.email", 0.99), ("phone", "$.telephone", 0.99), ("description", "$.description", 0.96)):
            out.append(one(objects, field, get(path), confidence, "jsonld"))
        out.append(one(objects, "founder_ceo", F.coalesce(get("$.founder.name"), F.when(~get("$.founder").startswith("{"), get("$.founder"))), 0.96, "jsonld"))
        out.append(one(objects, "locations", F.nullif(F.concat_ws(", ", *[F.nullif(get(f"$.address.{p}"), F.lit("")) for p in ADDRESS_PARTS]), F.lit("")), 0.94, "jsonld"))
    heads = on_page("headings")
    out.append(one(heads.where("category = 'about' and pos = 0"), "company_name", F.col("value"), 0.65, "heading"))
    for category, field in SECTION_FIELDS.items():
        out.append(listed(heads.where(F.col("category") == category), field, 0.55, "heading", most=25, shorter_than=80))
        if f"links:{category}" in found:
            out.append(listed(on_page(f"links:{category}").withColumnRenamed("label", "value"), field, 0.8, "section_links", least=2, most=40))
    persons = on_page("people")
    out.append(one(persons, "founder_ceo", F.concat("name", F.lit(" ("), "title", F.lit(")")), leader_confidence(F.col("title"), F.col("category")), "people"))
    out.append(listed(on_page("addresses"), "locations", 0.9, "address"))
    out.append(listed(on_page("certifications"), "certifications", 0.8, "text"))
    out.append(one(pages.where("description <> ''").withColumn("ord", F.col("page_ord") * PAGE_STEP), "description", F.col("description"), 0.92, "meta"))
    mails = on_page("emails").withColumnRenamed("value", "email")
    first_mail = mails.groupBy("company_id").agg(F.min_by(F.struct("email", "url", "ord"), F.struct(~F.col("email").rlike(GENERIC_EMAIL), F.col("ord"))).alias("m")).select("company_id", "m.*")
    out.append(one(first_mail, "business_email", F.col("email"), 0.95, "email", ord_=F.col("ord") + LATE))
    numbers = on_page("phones").groupBy("company_id").agg(F.min_by(F.struct("value", "url", "ord"), "ord").alias("m")).select("company_id", "m.*")
    out.append(one(numbers, "phone", F.col("value"), 0.90, "phone", ord_=F.col("ord") + LATE))
    seeds = pages.groupBy("company_id").agg(F.min_by("seed_url", "page_ord").alias("url"))
    out.append(one(seeds, "website", F.col("url"), 1.0, "seed_url", ord_=F.lit(LAST)))
    out.append(listed(on_page("socials"), "social_links", 0.75, "links"))
    candidates = union(out)
    titled = pages.withColumn("ord", F.col("page_ord") * 2)
    name = F.substring_index(F.substring_index("title", "|", 1), "-", 1)
    fallback = union([one(titled, "company_name", F.col("site_name"), 0.95, "og:site_name"), one(titled, "company_name", name, 0.60, "title", ord_=F.col("ord") + 1)])
    filled = lambda rows: rows.where(F.exists("value", lambda v: T.clean(v) != ""))
    candidates = staged(without_name(filled(candidates), filled(fallback)))
    return candidates.unionByName(late_candidates(candidates, mails, on_page("logos")))


def late_candidates(candidates: DataFrame, mails: DataFrame, logos: DataFrame) -> DataFrame:
    """What depends on other fields: the leader's address, and client logos that are not the company's own."""
    chosen = choose_best(candidates.where("field in ('founder_ceo', 'company_name')"))
    leaders = chosen.where("field = 'founder_ceo'").select("company_id", F.get("value", F.lit(0)).alias("founder_ceo"))
    address = ceo_email(mails, leaders).select("company_id", F.lit("ceo_email").alias("field"), F.array("ceo_email").alias("value"), F.lit(0.7).alias("confidence"), F.lit(None).cast("string").alias("source_url"), F.lit("email_match").alias("source_type"), F.lit(0).cast("long").alias("ord"))
    names = chosen.where("field = 'company_name'").select("company_id", F.lower(F.get("value", F.lit(0))).alias("own"))
    foreign = logos.join(names, "company_id", "left").where(~F.contains(F.lower("value"), F.coalesce("own", F.lit("not found"))))
    first = foreign.groupBy("company_id").agg(F.min_by("url", "ord").alias("source_url"), F.min("ord").alias("ord"))
    clients = value_list(foreign.select("company_id", "ord", "value"), 2, 40).join(first, "company_id")
    return address.unionByName(clients.select("company_id", F.lit("clients").alias("field"), F.col("values").alias("value"), F.lit(0.6).alias("confidence"), "source_url", F.lit("logo_alt").alias("source_type"), "ord"))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def site_profile(candidates: DataFrame) -> DataFrame:
    """One row per company: every field's best value (an array), and a map with its confidence."""
    best = choose_best(candidates)
    values = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS]
    return best.groupBy("company_id").agg(*values, F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "confidence")))).alias("confidence"))


def crawl_profile(pages: DataFrame, company: Column, category: Column) -> DataFrame:
    """The whole way from crawled pages (page_id, url, html) to one profile per company."""
    from orgatlas.operators import extract as X
    from orgatlas.sources.html import parse_pages

    parsed = staged(parse_pages(pages).withColumns({"company_id": company, "category": category}))  # many branches read it
    order = Window.partitionBy("company_id").orderBy("page_id")
    facts = parsed.select("company_id", "page_id", "url", "category", "title", "description", "site_name")
    rows = staged(facts.withColumn("page_ord", F.row_number().over(order)).withColumn("seed_url", F.first("url").over(order)))
    hrefs = F.transform("links", lambda a: a["href"])
    text = F.array_join("lines", " ")
    links = X.internal_links(parsed)
    none = F.lit(None).cast("string")
    parts = {
        "objects": X.jsonld_objects(parsed).select("page_id", (F.col("script") * SCRIPT_STEP + F.col("item")).alias("pos"), F.to_json("object").alias("value")), "headings": X.headings(parsed),
        "emails": X.emails(parsed, text, hrefs, "page_id"), "phones": X.phones(parsed, F.col("lines"), hrefs, "page_id"), "socials": X.social_links(parsed, hrefs, "page_id"),
        "people": X.people(X.lines_of(parsed)).select("page_id", "pos", F.col("name").alias("value"), F.col("title").alias("extra")), "addresses": X.addresses(parsed),
        "certifications": X.certifications(parsed, text, "page_id"), "logos": X.client_logos(parsed), **{f"links:{c}": X.section_children(links, parsed, c).select("page_id", "pos", F.col("label").alias("value")) for c in SECTION_FIELDS},
    }
    # one long table, written once: what follows reads it by kind
    long = staged(union([t.select("page_id", F.lit(kind).alias("kind"), F.col("pos").cast("long").alias("pos"), "value", F.col("extra") if "extra" in t.columns else none.alias("extra")) for kind, t in parts.items()]))
    found = {kind: long.where(F.col("kind") == kind).select("page_id", "pos", "value") for kind in parts}
    found["objects"] = found["objects"].select("page_id", "pos", F.parse_json("value").alias("object"))
    found["people"] = long.where("kind = 'people'").select("page_id", "pos", F.col("value").alias("name"), F.col("extra").alias("title"))
    found |= {kind: found[kind].withColumnRenamed("value", "label") for kind in parts if kind.startswith("links:")}
    return site_profile(staged(field_candidates(rows, found)))
