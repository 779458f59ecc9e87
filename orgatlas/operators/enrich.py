"""Company profiles enriched: technologies, size and age, contacts, people, mail set-up, register facts, lead score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orgatlas.functions import text as T
from orgatlas.functions import urls as U

#: Fixed values.
ROLE_LOCALS = (
    "info", "contact", "hello", "sales", "support", "admin", "office", "hr", "careers", "jobs", "marketing", "press", "media", "billing", "accounts", "enquiries", "inquiries", "team",
    "help", "service", "business", "partners", "privacy", "legal", "noreply", "no-reply", "webmaster", "acquisitions", "investors", "ir", "finance", "procurement", "recruitment",
    "talent", "events", "community", "security", "compliance", "dpo", "customercare", "orders",
)
DISPOSABLE = ("mailinator.com", "10minutemail.com", "guerrillamail.com", "tempmail.com", "yopmail.com", "trashmail.com", "sharklasers.com")
FREE_MAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com", "aol.com", "icloud.com", "proton.me", "protonmail.com", "gmx.com", "yandex.com", "zoho.com")
SPF_SENDERS = [
    ("_spf.google.com", "Google Workspace"), ("protection.outlook.com", "Microsoft 365"), ("amazonses.com", "Amazon SES"), ("sendgrid.net", "SendGrid"), ("mailgun.org", "Mailgun"), ("sendinblue.com", "Brevo"),
    ("brevo.com", "Brevo"), ("mcsv.net", "Mailchimp"), ("mandrillapp.com", "Mailchimp Transactional"), ("hubspotemail.net", "HubSpot"), ("_spf.salesforce.com", "Salesforce"), ("zendesk.com", "Zendesk"),
    ("freshdesk.com", "Freshdesk"), ("zcsend.net", "Zoho Campaigns"), ("zoho.com", "Zoho"), ("pphosted.com", "Proofpoint"), ("mimecast.com", "Mimecast"), ("postmarkapp.com", "Postmark"),
    ("sparkpostmail.com", "SparkPost"), ("intercom.io", "Intercom"), ("jobdiva.com", "JobDiva"), ("greenhouse.io", "Greenhouse"), ("atlassian.net", "Atlassian"),
]
MX_PROVIDERS = [
    ("google.com", "Google Workspace"), ("googlemail.com", "Google Workspace"), ("outlook.com", "Microsoft 365"), ("protection.outlook", "Microsoft 365"), ("zoho", "Zoho Mail"), ("pphosted.com", "Proofpoint"),
    ("mimecast", "Mimecast"), ("secureserver.net", "GoDaddy"), ("messagingengine.com", "Fastmail"), ("mailgun", "Mailgun"), ("sendgrid", "SendGrid"), ("amazonses", "Amazon SES"),
    ("barracudanetworks", "Barracuda"), ("titan.email", "Titan"), ("hostinger", "Hostinger"),
]
TLD_REGION = {
    "pk": "PK", "uk": "GB", "de": "DE", "fr": "FR", "in": "IN", "ae": "AE", "sa": "SA", "au": "AU", "ca": "CA", "nl": "NL", "es": "ES", "it": "IT", "se": "SE", "no": "NO", "dk": "DK", "fi": "FI", "pl": "PL",
    "br": "BR", "mx": "MX", "sg": "SG", "nz": "NZ", "ie": "IE", "ch": "CH", "at": "AT", "be": "BE", "qa": "QA", "tr": "TR",
}
COUNTRY_HINTS = [
    (r"pakistan|lahore|karachi|islamabad|rawalpindi|punjab|sindh", "PK"), (r"india|mumbai|delhi|bangalore|bengaluru|hyderabad|pune", "IN"), (r"united states|usa|\b(TX|CA|NY|FL|WA|IL|MA|NJ|GA|VA)\b \d{5}", "US"),
    (r"united kingdom|\bUK\b|london|manchester", "GB"), (r"germany|berlin|munich|hamburg", "DE"), (r"\bUAE\b|dubai|abu dhabi|emirates", "AE"), (r"saudi|\bKSA\b|riyadh|jeddah", "SA"), (r"qatar|doha", "QA"),
    (r"canada|ontario|toronto|vancouver", "CA"), (r"australia|sydney|melbourne", "AU"), (r"singapore", "SG"), (r"netherlands|amsterdam", "NL"), (r"france|paris", "FR"), (r"ireland|dublin", "IE"), (r"turkey|istanbul", "TR"),
]
FOUNDED = r"\b(?:founded|established|incorporated|started|launched|since|est\.?)(?:\s+[A-Z][\w&.-]*){0,3}?\s+(?:in\s+|back\s+in\s+)?((?:19[5-9]|20[0-4])\d)\b"
EMPLOYEES = (
    r"\b(?:(?:workforce|team|family|headcount|strength)\s+of\s+(?:over\s+|more\s+than\s+|about\s+|around\s+|nearly\s+)?(\d{1,3}(?:,\d{3})+|\d{1,6})|"
    r"(\d{1,3}(?:,\d{3})+|\d{1,6})\s*(\+|plus)?\s*(?:full[- ]time\s+|talented\s+|skilled\s+|dedicated\s+)?(employees|professionals|people|team members|staff|persons|workforce|engineers|experts|developers|specialists|consultants))\b"
)
STRONG_NOUNS = ("employees", "professionals", "people", "team members", "staff", "persons", "workforce")
CONTEXT_CHARS = 40
IMAGE_NAME = r"(?i)\.(png|jpe?g|gif|svg|webp)$"
SOCIAL_NETWORKS = {"linkedin.com": "linkedin", "facebook.com": "facebook", "instagram.com": "instagram", "twitter.com": "x", "x.com": "x", "youtube.com": "youtube", "github.com": "github"}
MENTION_PAGES = r"(?i)testimonial|case-stud|success-stor|/blog|/insight|/news|/press|review|/clients?\b|/work/"
TEAM_PAGES = r"(?i)team|leader|about|management|people"
MENTIONED = "mentioned (possibly a client)"
TOP_TITLES, HIGH_TITLES = r"(?i)\bceo\b|chief executive|founder|owner|president|managing director", r"(?i)\bc[a-z]o\b|chief|vp|vice president|head|director"
#: Address patterns in order; {f} and {l} are first letters.
EMAIL_PATTERNS = ("{first}.{last}", "{first}", "{f}{last}", "{first}{last}", "{first}_{last}", "{f}.{last}", "{last}", "{first}{l}")
#: What a lead score asks for, and its weight.
LEAD_CHECKS = [
    ("Company name", 5, "has_name"), ("Description", 5, "has_description"), ("Business email", 10, "has_domain_email"), ("Email domain receives mail", 5, "accepts_email"), ("Valid phone", 10, "has_valid_phone"),
    ("Office location", 10, "has_location"), ("Decision maker identified", 15, "has_person"), ("Decision maker email (found or pattern)", 10, "has_person_email"), ("Social profiles", 5, "has_social"),
    ("Tech stack", 5, "has_tech"), ("Founded year", 5, "has_founded_year"), ("Employee count", 10, "has_employees"), ("Domain registration data", 5, "has_registration"),
]
GRADES = ((80, "A"), (60, "B"), (40, "C"))


def tech_stack(tech: DataFrame) -> DataFrame:
    """(company_id, category, name, pages, evidence, source_url): one row per technology; the first page is the evidence."""
    return tech.groupBy("company_id", "category", "name").agg(F.count("*").alias("pages"), F.min_by("evidence", "ord").alias("evidence"), F.min_by("url", "ord").alias("source_url"))


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    founded, employees = re.compile(FOUNDED, re.I), re.compile(EMPLOYEES, re.I)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())
    names = ["company_id", "page_ord", "url", "kind", "start", "number", "strong", "phrase", "context"]
    for batch in batches:
        rows = []
        for company, page, url, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for m in founded.finditer(text or ""):
                strong = m[0].lower().startswith(("founded", "established", "incorporated"))
                rows.append((company, page, url, "founded", m.start(), int(m[1]), strong, m[0], text[max(0, m.start() - CONTEXT_CHARS) : m.end()].lower()))
            for m in employees.finditer(text or ""):
                rows.append((company, page, url, "employees", m.start(), int((m[1] or m[2]).replace(",", "")), bool(m[1]) or (m[4] or "").lower() in STRONG_NOUNS, m[0], None))
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def mentions(pages: DataFrame) -> DataFrame:
    """Every mention of a founding year or a head count, with its place. ``pages``: company_id, page_ord, url, text."""
    rows = pages.select(F.col("company_id").cast("long"), F.col("page_ord").cast("long"), "url", "text")
    return rows.mapInArrow(_mentions, "company_id long, page_ord long, url string, kind string, start long, number long, strong boolean, phrase string, context string")


def founded_year(found: DataFrame) -> DataFrame:
    """The year with most weight (3 for direct words, else 1), the first seen on ties; a repeated context counts once."""
    place = F.struct("page_ord", "start")
    once = found.where("kind = 'founded'").groupBy("company_id", "context").agg(F.min_by(F.struct("number", "strong"), place).alias("m"), F.min(place).alias("at"))
    years = once.groupBy("company_id", F.col("m.number").alias("year")).agg(F.sum(F.when(F.col("m.strong"), 3).otherwise(1)).alias("weight"), F.min("at").alias("at"))
    first = Window.partitionBy("company_id").orderBy(F.desc("weight"), "at")
    return years.withColumn("n", F.row_number().over(first)).where("n = 1").select("company_id", F.col("year").alias("founded_year"), "weight")


def employees(found: DataFrame) -> DataFrame:
    """The largest plausible head count, direct statements before subsets; the first seen on ties."""
    usable = found.where("kind = 'employees' and number between 5 and 500000 and not number between 1950 and 2049")
    first = Window.partitionBy("company_id").orderBy(F.desc("strong"), F.desc("number"), "page_ord", "start")
    best = usable.withColumn("n", F.row_number().over(first)).where("n = 1")
    strength = F.when(F.col("strong"), "direct").otherwise("approximate (subset noun)")
    return best.select("company_id", F.col("number").alias("employees"), T.employee_range(F.col("number")).alias("employee_range"), "phrase", "url", strength.alias("strength"))


def email_table(emails: DataFrame) -> DataFrame:
    """(company_id, email, ord): addresses in lower case, first place of each; names of images are no addresses."""
    rows = emails.withColumn("email", F.lower("email")).where(F.contains("email", F.lit("@")) & ~F.col("email").rlike(IMAGE_NAME))
    return rows.groupBy("company_id", "email").agg(F.min("ord").alias("ord"))


def classify_emails(emails: DataFrame, domains: DataFrame, mail_hosts: DataFrame) -> DataFrame:
    """Kind and place of each address. ``domains``: company_id, domain; ``mail_hosts``: domain, accepts_email."""
    local, host = T.email_parts(F.col("email"))
    rows = emails.join(domains.select("company_id", F.col("domain").alias("company_domain")), "company_id", "left").withColumns({"_local": local, "_host": host})
    rows = rows.join(mail_hosts.select(F.col("domain").alias("_host"), F.col("accepts_email").alias("domain_accepts_mail")), "_host", "left")
    on_domain = F.coalesce((F.col("_host") == F.col("company_domain")) | F.endswith("_host", F.concat(F.lit("."), "company_domain")), F.lit(False))
    role = F.substring_index(F.substring_index("_local", ".", 1), "+", 1).isin(*ROLE_LOCALS)
    rows = rows.withColumns({
        "type": F.when(role, "role").otherwise("personal"), "on_company_domain": on_domain, "free_provider": F.col("_host").isin(*FREE_MAIL), "disposable": F.col("_host").isin(*DISPOSABLE),
        "syntax_ok": F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"),
    })
    order = Window.partitionBy("company_id").orderBy(F.desc("on_company_domain"), F.desc("type"), "ord")
    return rows.withColumn("place", F.row_number().over(order)).drop("_local", "_host")


def regions(companies: DataFrame) -> DataFrame:
    """Adds ``regions``: by the domain's ending, then by countries named in the locations."""
    ending = F.create_map(*[F.lit(x) for pair in TLD_REGION.items() for x in pair])
    hints = [F.when(F.coalesce("location_text", F.lit("")).rlike("(?i)" + pattern), code) for pattern, code in COUNTRY_HINTS]
    by_ending = F.try_element_at(ending, F.substring_index("domain", ".", -1))
    return companies.withColumn("regions", F.array_distinct(F.array_compact(F.array(by_ending, *hints))))


#: Numbering plans of some regions. Region, calling code, what a national number begins with, its fewest and most digits, and its kind.
NUMBER_PLANS = [
    ("US", "1", "2", 10, 10, "fixed or mobile"), ("US", "1", "3", 10, 10, "fixed or mobile"), ("US", "1", "4", 10, 10, "fixed or mobile"), ("US", "1", "5", 10, 10, "fixed or mobile"), ("US", "1", "6", 10, 10, "fixed or mobile"),
    ("US", "1", "7", 10, 10, "fixed or mobile"), ("US", "1", "8", 10, 10, "fixed or mobile"), ("US", "1", "9", 10, 10, "fixed or mobile"), ("US", "1", "800", 10, 10, "toll free"), ("US", "1", "888", 10, 10, "toll free"),
    ("US", "1", "877", 10, 10, "toll free"), ("US", "1", "866", 10, 10, "toll free"), ("US", "1", "900", 10, 10, "premium rate"),
    ("GB", "44", "1", 9, 10, "fixed"), ("GB", "44", "2", 10, 10, "fixed"), ("GB", "44", "3", 10, 10, "shared"), ("GB", "44", "7", 10, 10, "mobile"), ("GB", "44", "70", 10, 10, "personal"), ("GB", "44", "76", 10, 10, "pager"),
    ("GB", "44", "7624", 10, 10, "mobile"), ("GB", "44", "800", 9, 10, "toll free"), ("GB", "44", "808", 10, 10, "toll free"), ("GB", "44", "84", 10, 10, "shared"), ("GB", "44", "9", 10, 10, "premium rate"),
    ("PK", "92", "3", 10, 10, "mobile"), ("PK", "92", "21", 10, 10, "fixed"), ("PK", "92", "42", 10, 10, "fixed"), ("PK", "92", "51", 9, 9, "fixed"), ("PK", "92", "4", 9, 10, "fixed"), ("PK", "92", "5", 9, 9, "fixed"), ("PK", "92", "800", 8, 8, "toll free"),
    ("IN", "91", "6", 10, 10, "mobile"), ("IN", "91", "7", 10, 10, "mobile"), ("IN", "91", "8", 10, 10, "mobile"), ("IN", "91", "9", 10, 10, "mobile"), ("IN", "91", "11", 10, 10, "fixed"), ("IN", "91", "22", 10, 10, "fixed"),
    ("IN", "91", "33", 10, 10, "fixed"), ("IN", "91", "44", 10, 10, "fixed"), ("IN", "91", "1800", 10, 13, "toll free"),
    ("DE", "49", "15", 11, 11, "mobile"), ("DE", "49", "16", 10, 11, "mobile"), ("DE", "49", "17", 10, 11, "mobile"), ("DE", "49", "30", 5, 11, "fixed"), ("DE", "49", "40", 5, 11, "fixed"), ("DE", "49", "69", 5, 11, "fixed"), ("DE", "49", "89", 5, 11, "fixed"),
    ("DE", "49", "800", 10, 12, "toll free"), ("DE", "49", "900", 10, 10, "premium rate"),
    ("FR", "33", "1", 9, 9, "fixed"), ("FR", "33", "2", 9, 9, "fixed"), ("FR", "33", "3", 9, 9, "fixed"), ("FR", "33", "4", 9, 9, "fixed"), ("FR", "33", "5", 9, 9, "fixed"), ("FR", "33", "6", 9, 9, "mobile"), ("FR", "33", "7", 9, 9, "mobile"), ("FR", "33", "80", 9, 9, "toll free"),
    ("AE", "971", "5", 9, 9, "mobile"), ("AE", "971", "2", 8, 8, "fixed"), ("AE", "971", "3", 8, 8, "fixed"), ("AE", "971", "4", 8, 8, "fixed"), ("AE", "971", "6", 8, 8, "fixed"), ("AE", "971", "7", 8, 8, "fixed"), ("AE", "971", "9", 8, 8, "fixed"), ("AE", "971", "800", 5, 12, "toll free"),
    ("SG", "65", "3", 8, 8, "voip"), ("SG", "65", "6", 8, 8, "fixed"), ("SG", "65", "8", 8, 8, "mobile"), ("SG", "65", "9", 8, 8, "mobile"), ("SG", "65", "800", 10, 10, "toll free"), ("SG", "65", "1800", 11, 11, "toll free"),
    ("AU", "61", "2", 9, 9, "fixed"), ("AU", "61", "3", 9, 9, "fixed"), ("AU", "61", "4", 9, 9, "mobile"), ("AU", "61", "7", 9, 9, "fixed"), ("AU", "61", "8", 9, 9, "fixed"), ("AU", "61", "13", 6, 10, "shared"), ("AU", "61", "1800", 10, 10, "toll free"),
    ("ES", "34", "6", 9, 9, "mobile"), ("ES", "34", "7", 9, 9, "mobile"), ("ES", "34", "8", 9, 9, "fixed"), ("ES", "34", "9", 9, 9, "fixed"), ("ES", "34", "80", 9, 9, "shared"), ("ES", "34", "800", 9, 9, "toll free"), ("ES", "34", "900", 9, 9, "toll free"),
]
PLAN_COLUMNS = "region string, code string, prefix string, low int, high int, kind string"


def number_plans(spark: SparkSession, plans: list[tuple] = NUMBER_PLANS) -> DataFrame:
    return spark.createDataFrame(plans, PLAN_COLUMNS)


def planned_numbers(numbers: DataFrame, plans: DataFrame, number: str = "whole", region: str = "region") -> DataFrame:
    """``numbers`` with ``valid`` and ``kind`` by the plan of their region: of all plan entries that a number (digits with the calling code) begins with, the longest decides, by its lengths.

    The entries are a prefix tree laid out as rows: a number meets them with each of its own beginnings, by equality. Regions without a plan, and numbers that no entry begins, are not valid.
    """
    tree = plans.select(F.col("region").alias("_region"), F.concat("code", "prefix").alias("_start"), (F.col("low") + F.length("code")).alias("_low"), (F.col("high") + F.length("code")).alias("_high"), F.col("kind").alias("_kind"))
    longest = plans.agg(F.max(F.length(F.concat("code", "prefix")))).first()[0] or 0
    starts = numbers.select(region, number).where(F.col(region).isNotNull() & (F.length(number) > 0)).distinct()
    starts = starts.withColumn("_start", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(number), F.lit(longest))), lambda n: F.left(F.col(number), n)))) if longest else starts.withColumn("_start", F.lit(""))
    met = starts.join(tree, (starts["_start"] == tree["_start"]) & (starts[region] == tree["_region"])).select(region, number, tree["_start"], "_low", "_high", "_kind")
    best = met.groupBy(region, number).agg(F.max_by(F.struct("_low", "_high", "_kind"), F.length("_start")).alias("_p"))
    fits = F.coalesce(F.length(number).between(F.col("_p._low"), F.col("_p._high")), F.lit(False))
    return numbers.join(best, [region, number], "left").withColumns({"valid": fits, "kind": F.when(fits, F.col("_p._kind"))}).drop("_p")


def phone_numbers(phones: DataFrame, company_regions: DataFrame, plans: DataFrame, most: int = 15) -> DataFrame:
    """``phone_table`` by numbering plans: (company_id, place, raw, e164, valid, region, kind). A number without a calling code is tried in the company's regions in their order,
    one with a code in the regions that the code belongs to as well; the first region whose plan has it is taken."""
    codes = plans.select("region", "code").distinct()
    number = F.regexp_replace("raw", r"\D", "")
    plus = F.col("raw").startswith("+") | F.col("raw").startswith("00")
    rows = phones.withColumns({"digits": F.regexp_replace(number, "^0+", ""), "plus": plus})
    own = rows.join(company_regions.select("company_id", F.posexplode("regions").alias("try", "region")), "company_id").join(F.broadcast(codes), "region")  # one row per region and code
    own = own.withColumn("whole", F.when(F.col("plus"), F.col("digits")).otherwise(F.concat("code", "digits")))
    abroad = rows.where("plus").withColumn("code", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.left("digits", n)))).join(F.broadcast(codes), "code").withColumns({"try": F.lit(1_000), "whole": F.col("digits")})
    columns = ["company_id", "raw", "ord", "try", "region", "whole"]
    tried = planned_numbers(own.select(*columns).unionByName(abroad.select(*columns)), plans)
    best = tried.groupBy("company_id", "raw", "ord").agg(F.min_by(F.struct("whole", "valid", "region", "kind"), F.struct(~F.col("valid"), F.col("try"), F.col("region"))).alias("b"))
    found = phones.join(best, ["company_id", "raw", "ord"], "left").withColumn("valid", F.coalesce("b.valid", F.lit(False)))
    picked = found.select("company_id", "raw", "ord", F.when(F.col("valid"), F.concat(F.lit("+"), "b.whole")).alias("e164"), "valid", F.when(F.col("valid"), F.col("b.region")).alias("region"), F.col("b.kind").alias("kind"))
    once = picked.withColumn("n", F.row_number().over(Window.partitionBy("company_id", F.coalesce("e164", "raw")).orderBy("ord"))).where("n = 1").drop("n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("valid"), "ord"))).where(F.col("place") <= most)


def phone_table(phones: DataFrame, company_regions: DataFrame, calling_codes: DataFrame, most: int = 15) -> DataFrame:
    """(company_id, place, raw, e164, valid, region): numbers in international form where a region gives one.

    ``calling_codes``: region, code, low, high (digits after the code). The first region that fits is taken.
    """
    rows = phones.join(company_regions.select("company_id", F.posexplode_outer("regions").alias("try", "region")), "company_id", "left")
    rows = rows.join(F.broadcast(calling_codes), "region", "left")  # one row per region of the world
    number = F.regexp_replace("raw", r"\D", "")
    plus = F.col("raw").startswith("+") | F.col("raw").startswith("00")
    whole = F.when(plus, F.regexp_replace(number, "^00", "")).otherwise(F.concat("code", F.regexp_replace(number, "^0+", "")))
    rest = F.length(whole) - F.length("code")
    fits = F.coalesce(whole.startswith(F.col("code")) & rest.between(F.col("low"), F.col("high")), F.lit(False))
    tried = rows.withColumns({"whole": whole, "valid": fits}).groupBy("company_id", "raw", "ord").agg(F.min_by(F.struct("whole", "valid", "region"), F.struct(~F.col("valid"), F.col("try"))).alias("b"))
    picked = tried.select("company_id", "raw", "ord", F.when(F.col("b.valid"), F.concat(F.lit("+"), "b.whole")).alias("e164"), F.col("b.valid").alias("valid"), F.col("b.region").alias("region"))
    once = picked.withColumn("n", F.row_number().over(Window.partitionBy("company_id", F.coalesce("e164", "raw")).orderBy("ord"))).where("n = 1").drop("n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("valid"), "ord"))).where(F.col("place") <= most)


def person_context(url: Column, category: Column) -> Column:
    return F.when(url.rlike(MENTION_PAGES), MENTIONED).when(category.isin("team", "about") | url.rlike(TEAM_PAGES), "team").otherwise("website")


def title_rank(title: Column) -> Column:
    return F.when(title.rlike(TOP_TITLES), 0).when(title.rlike(HIGH_TITLES), 1).otherwise(2)


def merge_people(*sources: DataFrame, most: int = 40) -> DataFrame:
    """People of several sources in order (company_id, name, title, context, ord); the first row of each name, ranked."""
    rows = None
    for rank, source in enumerate(sources):
        part = source.select("company_id", "name", "title", "context", "ord", F.lit(rank).alias("source_rank"))
        rows = part if rows is None else rows.unionByName(part)
    first = Window.partitionBy("company_id", F.lower("name")).orderBy("source_rank", "ord")
    once = rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    near = F.when(F.col("context").isin("team", "registry officer"), 0).when(F.col("context") == MENTIONED, 3).otherwise(1)
    order = Window.partitionBy("company_id").orderBy(near, title_rank(F.coalesce("title", F.lit(""))), "source_rank", "ord")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def name_parts(name: Column) -> tuple[Column, Column]:
    """(first, last) in plain letters; NULL for a single word."""
    bare = F.regexp_replace(name, r"(?i)^(dr|mr|ms|mrs)\.?\s+", "")
    parts = F.filter(F.transform(F.split(bare, r"\s+"), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")), lambda w: w != "")
    return F.when(F.size(parts) >= 2, F.element_at(parts, 1)), F.when(F.size(parts) >= 2, F.element_at(parts, -1))


def pattern_locals(first: Column, last: Column) -> Column:
    """The local part under each address pattern, in the order of the patterns."""
    letter = lambda c: F.substring(c, 1, 1)
    dot, line = F.lit("."), F.lit("_")
    made = (F.concat(first, dot, last), first, F.concat(letter(first), last), F.concat(first, last), F.concat(first, line, last), F.concat(letter(first), dot, last), last, F.concat(first, letter(last)))
    return F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(i).alias("rank"), local.alias("local")) for i, (p, local) in enumerate(zip(EMAIL_PATTERNS, made, strict=True))])


def _possible(people: DataFrame) -> DataFrame:
    """One row per person and pattern; people: company_id, name, ord."""
    first, last = name_parts(F.col("name"))
    named = people.select("company_id", "name", "ord", first.alias("first"), last.alias("last")).where("first is not null")
    return named.select("company_id", "name", "ord", F.inline(pattern_locals(F.col("first"), F.col("last"))))


def infer_pattern(people: DataFrame, emails: DataFrame) -> DataFrame:
    """(company_id, pattern, hits): the address pattern that most people's published addresses follow.

    ``emails``: company_id, local, of addresses on the company's domain.
    """
    hits = _possible(people).join(emails.select("company_id", "local").distinct(), ["company_id", "local"]).groupBy("company_id", "pattern", "rank").agg(F.count("*").alias("hits"))
    return hits.groupBy("company_id").agg(F.max_by(F.struct("pattern", "hits"), F.struct("hits", -F.col("rank"))).alias("b")).select("company_id", "b.*")


def attach_emails(people: DataFrame, emails: DataFrame) -> DataFrame:
    """Adds ``email_local``: the first published local part that fits the person. ``emails``: company_id, local, ord."""
    published = emails.select("company_id", "local", F.col("ord").alias("email_ord"))
    found = _possible(people).join(published, ["company_id", "local"]).groupBy("company_id", "name", "ord").agg(F.min_by("local", "email_ord").alias("email_local"))
    return people.join(found, ["company_id", "name", "ord"], "left")


def expand_pattern(people: DataFrame, patterns: DataFrame, domains: DataFrame, enabled: bool = False) -> DataFrame:
    """Adds guessed addresses, only if ``enabled``; they are unverified and marked so.

    ``people``: company_id, name, ord, context, email_local; ``domains``: company_id, domain, accepts_email.
    """
    none = {c: F.lit(None).cast(t) for c, t in (("email_guess", "string"), ("email_guess_confidence", "string"), ("email_guess_alternatives", "array<string>"))}
    if not enabled:
        return people.withColumns(none)
    team = people.groupBy("company_id").agg(F.max(F.coalesce(F.col("context") == "team", F.lit(False))).alias("has_team"))
    rows = people.join(team, "company_id").join(patterns.select("company_id", "pattern"), "company_id", "left").join(domains, "company_id", "left")
    first, last = name_parts(F.col("name"))
    at = lambda local: F.concat(local, F.lit("@"), "domain")
    rows = rows.withColumn("_made", pattern_locals(first, last))
    known = F.get(F.filter("_made", lambda m: m["pattern"] == F.col("pattern")), F.lit(0))["local"]
    sure = F.col("context").isin("team", "registry officer") | ((F.col("context") == "website") & ~F.col("has_team"))
    open_ = sure & F.col("email_local").isNull() & first.isNotNull() & F.coalesce("accepts_email", F.lit(False))
    trust = F.when(F.col("pattern").isNotNull(), "medium (pattern learned from published emails)").otherwise("low (most common pattern, unverified)")
    made = {
        "email_guess": F.when(open_, at(F.coalesce(known, F.get("_made", F.lit(0))["local"]))), "email_guess_confidence": F.when(open_, trust),
        "email_guess_alternatives": F.when(open_, F.transform(F.slice("_made", 1, 4), lambda m: at(m["local"]))),
    }
    return rows.withColumns(made).drop("_made", "has_team", "pattern", "domain", "accepts_email")


def social_map(links: DataFrame, key: str = "company_id") -> DataFrame:
    """(key, social): the first link of each network. ``links``: key, url, ord."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(U.host_of(F.col("url")), r"^www\.", ""), r"^pk\.", ""), r"^uk\.", "")
    network = F.try_element_at(F.create_map(*[F.lit(x) for pair in SOCIAL_NETWORKS.items() for x in pair]), host)
    first = links.withColumn("network", network).where("network is not null").groupBy(key, "network").agg(F.min_by("url", "ord").alias("url"))
    return first.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("network", "url")))).alias("social"))


def mail_setup(dns: DataFrame) -> DataFrame:
    """One row per domain from DNS answers (domain, rtype, data): provider, senders, policies, verifications."""
    quoted = F.regexp_replace("data", '^"+|"+$', "")
    host = F.lower(F.regexp_replace(F.substring_index("data", " ", -1), r"\.+$", ""))
    kind = lambda k: F.col("rtype") == k
    rows = dns.groupBy("domain").agg(
        F.sort_array(F.collect_list(F.when(kind("MX"), host))).alias("mx"),
        F.min(F.when(kind("TXT") & F.contains(F.lower("data"), F.lit("v=spf1")), quoted)).alias("spf"),
        F.min(F.when(kind("DMARC") & F.contains(F.lower("data"), F.lit("v=dmarc1")), F.replace(quoted, F.lit('" "'), F.lit("")))).alias("dmarc"),
        F.sort_array(F.collect_set(F.when(kind("TXT"), F.nullif(F.regexp_extract("data", r'(?i)^"?([a-z0-9-]+?)-(?:site-)?verification', 1), F.lit(""))))).alias("txt_verifications"),
    )
    provider, all_hosts = None, F.array_join("mx", " ")
    for key, name in MX_PROVIDERS:
        hit = F.contains(all_hosts, F.lit(key))
        provider = F.when(hit, name) if provider is None else provider.when(hit, name)
    senders = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(F.lower("spf"), F.lit(key)), name) for key, name in SPF_SENDERS])))
    return rows.select(
        "domain", "mx", (F.size("mx") > 0).alias("accepts_email"), provider.when(F.size("mx") > 0, "Self-hosted / other").alias("email_provider"), senders.alias("email_senders"), "spf", "dmarc",
        F.nullif(F.regexp_extract("dmarc", r"\bp=(\w+)", 1), F.lit("")).alias("dmarc_policy"), "txt_verifications",
    )


RDAP = "events ARRAY<STRUCT<eventAction: STRING, eventDate: STRING>>, entities ARRAY<STRUCT<roles: ARRAY<STRING>, vcardArray: STRING>>, nameservers ARRAY<STRUCT<ldhName: STRING>>, status ARRAY<STRING>"


def domain_facts(answers: DataFrame, as_of: Column) -> DataFrame:
    """Registration facts of domains from registration-data answers (domain, json)."""
    rows = answers.select("domain", F.from_json("json", RDAP).alias("r"))
    date = lambda action: F.get(F.filter("r.events", lambda e: e["eventAction"] == action), F.lit(0))["eventDate"]
    registrar = F.get(F.filter("r.entities", lambda e: F.array_contains(e["roles"], "registrar")), F.lit(0))["vcardArray"]
    fields = F.from_json(F.get(F.from_json(registrar, "ARRAY<STRING>"), F.lit(1)), "ARRAY<ARRAY<STRING>>")
    name = F.get(F.get(F.filter(fields, lambda f: F.get(f, F.lit(0)) == "fn"), F.lit(0)), F.lit(3))
    return rows.select(
        "domain", name.alias("registrar"), date("registration").alias("created"), date("expiration").alias("expires"), date("last changed").alias("updated"),
        T.age_years(F.to_date(F.left(date("registration"), F.lit(10))), as_of).alias("age_years"), F.transform("r.nameservers", lambda n: F.lower(n["ldhName"])).alias("nameservers"), F.col("r.status").alias("status"),
    )


def fill_from_register(companies: DataFrame, registry: DataFrame, as_of_year: int) -> DataFrame:
    """Year, age and head office from the register where the pages gave none. Both have company_id."""
    facts = registry.select("company_id", F.col("incorporation_date").alias("_date"), F.col("registered_address").alias("_address"))
    rows = companies.join(facts, "company_id", "left")
    year = F.coalesce("founded_year", F.left("_date", F.lit(4)).cast("int"))
    evidence = F.when(F.col("founded_year").isNull() & F.col("_date").isNotNull(), F.concat(F.lit("incorporated "), "_date"))
    return rows.withColumns({"founded_evidence": evidence, "incorporation_date": F.col("_date"), "headquarters": F.coalesce("headquarters", "_address"), "company_age_years": F.lit(as_of_year) - year}).withColumn("founded_year", year).drop("_date", "_address")


def lead_score(profiles: DataFrame) -> DataFrame:
    """Adds ``lead_score`` (0 to 100), ``lead_grade`` and ``lead_checks`` from the Boolean columns the checks name."""
    checks = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight"), F.coalesce(F.col(c), F.lit(False)).alias("ok")) for label, weight, c in LEAD_CHECKS])
    score = F.aggregate(F.filter("lead_checks", lambda x: x["ok"]), F.lit(0), lambda a, x: a + x["weight"])
    grade = None
    for least, letter in GRADES:
        step = F.col("lead_score") >= least
        grade = F.when(step, letter) if grade is None else grade.when(step, letter)
    return profiles.withColumn("lead_checks", checks).withColumn("lead_score", score).withColumn("lead_grade", grade.otherwise("D"))


def crawl_stats(log: DataFrame) -> DataFrame:
    """Per job: pages, succeeded, failed, blocked; and the sets of challenges and errors."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return log.groupBy("job_id").agg(
        F.count("*").alias("pages"), F.count_if(blank("error")).alias("succeeded"), F.count_if(~blank("error") & blank("challenge")).alias("failed"), F.count_if(~blank("challenge")).alias("blocked"),
        F.sort_array(F.collect_set(F.nullif("challenge", F.lit("")))).alias("challenges"), F.sort_array(F.collect_set(F.nullif("error", F.lit("")))).alias("errors"),
    )


def crawl_status(companies: DataFrame, log: DataFrame) -> DataFrame:
    """Adds ``crawl_status`` and ``crawl_error`` to companies (job_id, website)."""
    code = F.left(F.coalesce(F.col("status").cast("string"), F.nullif("error", F.lit("")), F.lit("no answer")), F.lit(40))
    seen = log.groupBy("job_id").agg(F.max(F.coalesce(F.col("status").between(200, 399), F.lit(False))).alias("readable"), F.max(F.coalesce(F.col("challenge") == "robots", F.lit(False))).alias("refused"), F.slice(F.sort_array(F.collect_set(code)), 1, 3).alias("codes"))
    rows = companies.join(seen, "job_id", "left")
    status = F.when(F.col("website").isNull(), "no website").when(F.col("readable"), "completed").when(F.col("refused"), "blocked by robots.txt").otherwise("failed")
    error = F.when(status == "failed", F.concat(F.lit("website not readable ("), F.array_join(F.coalesce("codes", F.array().cast("array<string>")), ", "), F.lit(")")))
    return rows.withColumns({"crawl_status": status, "crawl_error": error}).drop("readable", "refused", "codes")


def errors_map(errors: DataFrame, most_chars: int = 300) -> DataFrame:
    """(job_id, errors): first characters of the first error of each source. ``errors``: job_id, source, message, ord."""
    first = errors.groupBy("job_id", "source").agg(F.left(F.min_by("message", "ord"), F.lit(most_chars)).alias("message"))
    return first.groupBy("job_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "message")))).alias("errors"))
