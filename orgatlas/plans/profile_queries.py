"""Registered queries of profiles and enrichment (A1-A25), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orgatlas.operators import enrich as E
from orgatlas.operators import profile as R
from orgatlas.plans.views import table, view, with_views

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def r6(c: str):
    return F.round(c, 6).alias(c)


BEST = "SELECT company_id, field, value, confidence, source_url, source_type, ord, row_number() OVER (PARTITION BY company_id, field ORDER BY confidence DESC, ord) AS rn, count(*) OVER (PARTITION BY company_id, field) AS n FROM evidence_v"


@query("a1_choose_best", f"WITH b AS ({BEST}) SELECT company_id, field, value, round(confidence, 6) AS confidence, source_url, source_type, n AS n_evidence FROM b WHERE rn = 1", "evidence_v")
def _(spark, d):
    return R.choose_best(view(spark, d, "evidence_v"), with_evidence=False).select("company_id", "field", "value", r6("confidence"), "source_url", "source_type", "n_evidence")


@query("a2_field_candidates")
def _(spark, d):
    pages = table(spark, d, "pages")
    company = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1), r"^(www|m|blog)\.", "")
    category = F.when(F.col("page_id") % 4 == 0, "about").when(F.col("page_id") % 4 == 1, "services").when(F.col("page_id") % 4 == 2, "contact").otherwise("team")
    best = R.crawl_profile(pages, company, category)
    return best.select("company_id", *[F.array_join(f, " | ").alias(f) for f in R.FIELDS])


@query("a3_conditional_name", """WITH n AS (SELECT DISTINCT company_id FROM evidence_v WHERE field = 'phone') SELECT company_id, 'company_name' AS field, value FROM evidence_v e WHERE field = 'phone'
UNION ALL SELECT company_id, 'company_name', value FROM evidence_v e WHERE field = 'locations' AND NOT EXISTS (SELECT 1 FROM n WHERE n.company_id = e.company_id)""", "evidence_v")
def _(spark, d):
    rows = view(spark, d, "evidence_v")
    named = lambda f: rows.where(F.col("field") == f).withColumn("field", F.lit("company_name"))
    return R.without_name(named("phone"), named("locations")).select("company_id", "field", "value")


MAILS = "SELECT company_id, local || '@' || email_domain AS email, ord FROM emails_v"


def mails(spark, d):
    return view(spark, d, "emails_v").select("company_id", F.concat("local", F.lit("@"), "email_domain").alias("email"), "ord")


@query("a4_preferred_email", rf"""WITH m AS ({MAILS}), k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY CASE WHEN regexp_matches(email, '(?i)^(info|contact|hello|sales|business|inquir|enquir)') THEN 0 ELSE 1 END, ord) AS rn FROM m)
SELECT company_id, email AS business_email FROM k WHERE rn = 1""", "emails_v")
def _(spark, d):
    return R.preferred_email(mails(spark, d))


NAMES = "SELECT company_id, min(first_name || ' van ' || last_name || ' (CEO)') AS founder_ceo FROM people_v GROUP BY company_id"


@query("a5_ceo_email", rf"""WITH m AS ({MAILS}), n AS ({NAMES}), p AS (SELECT company_id, lower(unnest(regexp_extract_all(split_part(founder_ceo, '(', 1), '[A-Za-z]{{3,}}'))) AS part FROM n),
h AS (SELECT m.company_id, email, ord FROM m JOIN p ON p.company_id = m.company_id AND contains(lower(split_part(email, '@', 1)), part))
SELECT company_id, arg_min(email, ord) AS ceo_email FROM h GROUP BY company_id""", "emails_v", "people_v")
def _(spark, d):
    names = view(spark, d, "people_v").groupBy("company_id").agg(F.min(F.concat("first_name", F.lit(" van "), "last_name", F.lit(" (CEO)"))).alias("founder_ceo"))
    return R.ceo_email(mails(spark, d), names)


@query("a6_value_lists", """WITH v AS (SELECT company_id, ord, title || ' ' || first_name AS value FROM people_v), t AS (SELECT company_id FROM v GROUP BY company_id HAVING count(*) >= 2),
f AS (SELECT company_id, value, min(ord) AS ord FROM v WHERE company_id IN (SELECT company_id FROM t) GROUP BY company_id, value), k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ord) AS rn FROM f)
SELECT company_id, string_agg(value, '|' ORDER BY ord) AS labels FROM k WHERE rn <= 5 GROUP BY company_id""", "people_v")
def _(spark, d):
    values = view(spark, d, "people_v").select("company_id", "ord", F.concat_ws(" ", "title", "first_name").alias("value"))
    return R.value_list(values, 2, 5, 80).select("company_id", F.array_join("values", "|").alias("labels"))


TECH = "SELECT s_suppkey % 20 AS company_id, (['CMS', 'CDN', 'Font'])[s_suppkey % 3 + 1] AS category, 'T' || s_suppkey % 7 AS name, 'e' || s_suppkey AS evidence, 'https://u/' || s_suppkey AS url, s_suppkey AS ord FROM supplier"


@query("a7_tech_stack", f"WITH t AS ({TECH}) SELECT company_id, category, name, count(*) AS pages, arg_min(evidence, ord) AS evidence, arg_min(url, ord) AS source_url FROM t GROUP BY ALL")
def _(spark, d):
    k = F.col("s_suppkey")
    tech = table(spark, d, "supplier").select((k % 20).alias("company_id"), F.get(F.array(F.lit("CMS"), F.lit("CDN"), F.lit("Font")), (k % 3).cast("int")).alias("category"), F.concat(F.lit("T"), k % 7).alias("name"), F.concat(F.lit("e"), k).alias("evidence"), F.concat(F.lit("https://u/"), k).alias("url"), k.alias("ord"))
    return E.tech_stack(tech)


def stories(spark, d):
    """Texts that name years and head counts, derived from suppliers."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("Firm "), k % 30, F.lit(" was founded in "), 1950 + k % 70, F.lit(". A team of "), k * 7 + 3, F.lit(" works here; 120 experts, "), k % 900, F.lit(" employees, since "), 1990 + k % 9, F.lit("."))
    return table(spark, d, "supplier").select((k % 30).alias("company_id"), k.alias("page_ord"), F.concat(F.lit("https://u/"), k).alias("url"), text.alias("text"))


@query("a8_founded_year", """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 30 AS company_id FROM supplier), w AS (SELECT company_id, 1950 + k % 70 AS year, 3 AS weight, k * 10 AS pos FROM s UNION ALL SELECT company_id, 1990 + k % 9, 1, k * 10 + 1 FROM s),
c AS (SELECT company_id, year, weight, min(pos) AS pos, 0 AS k FROM w WHERE weight = 3 GROUP BY company_id, year, weight UNION ALL SELECT company_id, year, weight, pos, pos FROM w WHERE weight = 1),
y AS (SELECT company_id, year, sum(weight) AS weight, min(pos) AS pos FROM c GROUP BY company_id, year), r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY weight DESC, pos) AS rn FROM y)
SELECT company_id, CAST(year AS BIGINT) AS founded_year FROM r WHERE rn = 1""")
def _(spark, d):
    # contexts hold the firm and year for the strong words; those of the weak ones differ by page
    rows = stories(spark, d).withColumn("text", F.regexp_replace("text", "; 120", F.concat(F.lit(" page "), "page_ord", F.lit("; 120"))))
    rows = rows.withColumn("text", F.regexp_replace("text", ", since", F.concat(F.lit(", "), "page_ord", F.lit(" days, since"))))
    return E.founded_year(E.mentions(rows)).select("company_id", "founded_year")


@query("a9_employees", """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 30 AS company_id FROM supplier), m AS (SELECT company_id, k * 7 + 3 AS n, TRUE AS strong FROM s UNION ALL SELECT company_id, 120, FALSE FROM s UNION ALL SELECT company_id, k % 900, TRUE FROM s),
r AS (SELECT company_id, n, row_number() OVER (PARTITION BY company_id ORDER BY strong DESC, n DESC) AS rn FROM m WHERE n BETWEEN 5 AND 500000 AND n NOT BETWEEN 1950 AND 2049)
SELECT company_id, CAST(n AS BIGINT) AS employees FROM r WHERE rn = 1""")
def _(spark, d):
    return E.employees(E.mentions(stories(spark, d))).select("company_id", "employees")


@query("a10_email_table", f"WITH m AS ({MAILS}) SELECT company_id, lower(email) AS email, min(ord) AS ord FROM m GROUP BY ALL", "emails_v")
def _(spark, d):
    return E.email_table(mails(spark, d))


DOMAINS = "SELECT DISTINCT company_id, 'co' || company_id || '.example.com' AS domain FROM emails_v"


def domains(spark, d):
    return view(spark, d, "emails_v").select("company_id").distinct().withColumn("domain", F.concat(F.lit("co"), "company_id", F.lit(".example.com")))


@query("a11_classify_emails", f"""WITH m AS (SELECT company_id, email, min(ord) AS ord FROM ({MAILS}) GROUP BY ALL), c AS (SELECT *, split_part(email, '@', 2) AS host, CASE WHEN split_part(split_part(split_part(email, '@', 1), '.', 1), '+', 1) = 'info' THEN 'role' ELSE 'personal' END AS type FROM m),
k AS (SELECT company_id, email, type, host = 'co' || company_id || '.example.com' AS on_company_domain, host = 'gmail.com' AS free_provider, CASE WHEN host = 'gmail.com' THEN TRUE END AS domain_accepts_mail, ord FROM c)
SELECT company_id, email, type, on_company_domain, free_provider, domain_accepts_mail, row_number() OVER (PARTITION BY company_id ORDER BY on_company_domain DESC, type DESC, ord) AS place FROM k""", "emails_v")
def _(spark, d):
    hosts = spark.createDataFrame([("gmail.com", True)], "domain string, accepts_email boolean")
    found = E.classify_emails(E.email_table(mails(spark, d)), domains(spark, d), hosts)
    return found.select("company_id", "email", "type", "on_company_domain", "free_provider", "domain_accepts_mail", F.col("place").cast("long").alias("place"))


PHONES = "SELECT c_custkey % 50 AS company_id, CASE c_custkey % 4 WHEN 0 THEN '+92 21 ' || (3000000 + c_custkey) WHEN 1 THEN '021 ' || (3000000 + c_custkey - 1) WHEN 2 THEN '12' || c_custkey ELSE '+44 20 ' || (70000000 + c_custkey) END AS raw, c_custkey AS ord FROM customer"


@query("a12_phone_table", f"""WITH p AS ({PHONES}), e AS (SELECT *, CASE WHEN raw LIKE '+%' THEN '+' || regexp_replace(raw, '\\D', '', 'g') WHEN raw LIKE '0%' THEN '+92' || substr(regexp_replace(raw, '\\D', '', 'g'), 2) END AS e164 FROM p),
v AS (SELECT *, e164 IS NOT NULL AS valid FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY company_id, coalesce(e164, raw) ORDER BY ord) AS rn FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY valid DESC, ord) AS place FROM o WHERE rn = 1) SELECT company_id, place, raw, e164, valid FROM k WHERE place <= 15""")
def _(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("+92 21 "), 3000000 + k)).when(k % 4 == 1, F.concat(F.lit("021 "), 3000000 + k - 1)).when(k % 4 == 2, F.concat(F.lit("12"), k)).otherwise(F.concat(F.lit("+44 20 "), 70000000 + k))
    phones = table(spark, d, "customer").select((k % 50).alias("company_id"), raw.alias("raw"), k.alias("ord"))
    where = phones.select("company_id").distinct().withColumn("regions", F.array(F.lit("PK"), F.lit("GB")))
    codes = spark.createDataFrame([("PK", "92", 9, 10), ("GB", "44", 9, 10)], "region string, code string, low int, high int")
    return E.phone_table(phones, where, codes).select("company_id", F.col("place").cast("long").alias("place"), "raw", "e164", "valid")


PLANNED = ", ".join(f"('{r}', '{c}{p}', {low + len(c)}, {high + len(c)}, '{kind}')" for r, c, p, low, high, kind in E.NUMBER_PLANS)


@query("a12_numbering_plans", f"""WITH t AS (SELECT * FROM (VALUES {PLANNED}) v(region, start, low, high, kind)),
n AS (SELECT c_custkey AS id, (['US', 'GB', 'PK', 'IN', 'DE', 'FR', 'AE', 'SG', 'AU', 'ES', 'XX'])[c_custkey % 11 + 1] AS region, (['1', '44', '92', '91', '49', '33', '971', '65', '61', '34', '999'])[c_custkey % 11 + 1] || CAST((c_custkey * 7919) % 1000 AS VARCHAR) || substr('2345678901', 1, CAST(c_custkey % 7 + 3 AS INTEGER)) AS whole FROM customer),
b AS (SELECT id, t.* FROM n JOIN t ON t.region = n.region AND starts_with(whole, start) QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(start) DESC) = 1)
SELECT n.id, n.whole, coalesce(len(whole) BETWEEN low AND high, false) AS valid, CASE WHEN len(whole) BETWEEN low AND high THEN kind END AS kind FROM n LEFT JOIN b USING (id)""")
def _(spark, d):
    k = F.col("c_custkey")
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (k % 11).cast("int"))
    whole = F.concat(pick("1", "44", "92", "91", "49", "33", "971", "65", "61", "34", "999"), (k * 7919 % 1000).cast("string"), F.left(F.lit("2345678901"), (k % 7 + 3).cast("int")))
    numbers = table(spark, d, "customer").select(k.alias("id"), pick("US", "GB", "PK", "IN", "DE", "FR", "AE", "SG", "AU", "ES", "XX").alias("region"), whole.alias("whole"))
    return E.planned_numbers(numbers, E.number_plans(spark)).select("id", "whole", "valid", "kind")


@query("a13_regions", """WITH c AS (SELECT s_suppkey, 'x.' || (['pk', 'de', 'com'])[s_suppkey % 3 + 1] AS domain, (['Lahore, Pakistan', 'Offices in London and Dubai', 'Austin, TX 78701', 'Nowhere'])[s_suppkey % 4 + 1] AS location_text FROM supplier)
SELECT s_suppkey, array_to_string(list_filter([CASE s_suppkey % 3 WHEN 0 THEN 'PK' WHEN 1 THEN 'DE' END, CASE s_suppkey % 4 WHEN 0 THEN CASE WHEN s_suppkey % 3 <> 0 THEN 'PK' END WHEN 1 THEN 'GB' WHEN 2 THEN 'US' END, CASE s_suppkey % 4 WHEN 1 THEN 'AE' END], lambda x: x IS NOT NULL), ',') AS regions FROM c""")
def _(spark, d):
    k = F.col("s_suppkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("x."), pick(("pk", "de", "com"), 3)).alias("domain"), pick(("Lahore, Pakistan", "Offices in London and Dubai", "Austin, TX 78701", "Nowhere"), 4).alias("location_text"))
    return E.regions(rows).select("s_suppkey", F.array_join("regions", ",").alias("regions"))


def people(spark, d):
    return view(spark, d, "people_v").select("company_id", F.concat_ws(" ", "first_name", "last_name").alias("name"), "title", "context", "ord")


MERGED = r"""p AS (SELECT company_id, first_name || ' ' || last_name AS name, title, context, ord, 0 AS src FROM people_v UNION ALL SELECT s_suppkey % 200, 'Officer' || s_suppkey % 9 || ' Smith', 'Director', 'registry officer', s_suppkey, 1 FROM supplier),
o AS (SELECT *, row_number() OVER (PARTITION BY company_id, lower(name) ORDER BY src, ord) AS rn FROM p),
k AS (SELECT company_id, name, title, context, ord, row_number() OVER (PARTITION BY company_id ORDER BY CASE WHEN context IN ('team', 'registry officer') THEN 0 WHEN context LIKE 'mentioned%' THEN 3 ELSE 1 END,
 CASE WHEN regexp_matches(title, '(?i)\bceo\b|chief executive|founder') THEN 0 WHEN regexp_matches(title, '(?i)chief|director') THEN 1 ELSE 2 END, src, ord) AS place FROM o WHERE rn = 1)"""


@query("a14_merge_people", f"WITH {MERGED} SELECT company_id, name, title, context, place FROM k WHERE place <= 40", "people_v")
def _(spark, d):
    k = F.col("s_suppkey")
    officers = table(spark, d, "supplier").select((k % 200).alias("company_id"), F.concat(F.lit("Officer"), k % 9, F.lit(" Smith")).alias("name"), F.lit("Director").alias("title"), F.lit("registry officer").alias("context"), k.alias("ord"))
    return E.merge_people(people(spark, d), officers).select("company_id", "name", "title", "context", F.col("place").cast("long").alias("place"))


# letters only: digits are not part of a name key, so first and last names get letters in place of numbers
PEOPLE = "SELECT company_id, translate(first_name, '0123456789', 'abcdefghij') || ' ' || translate(last_name, '0123456789', 'abcdefghij') AS name, lower(translate(first_name, '0123456789', 'abcdefghij')) AS f, lower(translate(last_name, '0123456789', 'abcdefghij')) AS l, title, context, ord FROM people_v"
LOCALS = "SELECT company_id, translate(local, '0123456789', 'abcdefghij') AS local, min(ord) AS ord FROM emails_v WHERE email_domain <> 'gmail.com' GROUP BY ALL"
MADE = "SELECT company_id, name, ord, context, unnest(['{first}.{last}', '{first}', '{f}{last}', '{first}{last}', '{first}_{last}', '{f}.{last}', '{last}', '{first}{l}']) AS pattern, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS rank, unnest([f || '.' || l, f, f[1] || l, f || l, f || '_' || l, f[1] || '.' || l, l, f || l[1]]) AS local FROM p"


def lettered(c):
    return F.translate(c, "0123456789", "abcdefghij")


def persons(spark, d):
    return view(spark, d, "people_v").select("company_id", F.concat_ws(" ", lettered("first_name"), lettered("last_name")).alias("name"), "title", "context", "ord")


def published(spark, d):
    return view(spark, d, "emails_v").where("email_domain <> 'gmail.com'").groupBy("company_id", lettered("local").alias("local")).agg(F.min("ord").alias("ord"))


@query("a15_email_pattern", f"""WITH p AS ({PEOPLE}), e AS ({LOCALS}), m AS ({MADE}), h AS (SELECT m.company_id, pattern, rank, count(*) AS hits FROM m JOIN e USING (company_id, local) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY hits DESC, rank) AS rn FROM h) SELECT company_id, pattern, hits FROM k WHERE rn = 1""", "people_v", "emails_v")
def _(spark, d):
    return E.infer_pattern(persons(spark, d), published(spark, d))


@query("a16_published_email", f"""WITH p AS ({PEOPLE}), e AS ({LOCALS}), m AS ({MADE}), h AS (SELECT m.company_id, name, m.ord, arg_min(m.local, e.ord) AS email_local FROM m JOIN e ON e.company_id = m.company_id AND e.local = m.local GROUP BY ALL)
SELECT p.company_id, p.name, p.ord, email_local FROM p LEFT JOIN h ON h.company_id = p.company_id AND h.name = p.name AND h.ord = p.ord""", "people_v", "emails_v")
def _(spark, d):
    return E.attach_emails(persons(spark, d), published(spark, d)).select("company_id", "name", "ord", "email_local")


@query("a17_guessed_email", f"""WITH p AS ({PEOPLE}), e AS ({LOCALS}), m AS ({MADE}), h AS (SELECT m.company_id, pattern, rank, count(*) AS hits FROM m JOIN e USING (company_id, local) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY hits DESC, rank) AS rn FROM h), b AS (SELECT company_id, pattern FROM k WHERE rn = 1),
f AS (SELECT DISTINCT m.company_id, name, m.ord FROM m JOIN e ON e.company_id = m.company_id AND e.local = m.local), t AS (SELECT company_id, bool_or(context = 'team') AS has_team FROM p GROUP BY company_id),
g AS (SELECT m.company_id, m.name, m.ord, m.local || '@co' || m.company_id || '.example.com' AS email_guess FROM m LEFT JOIN b USING (company_id) JOIN t USING (company_id)
 WHERE m.pattern = coalesce(b.pattern, '{{first}}.{{last}}') AND (context = 'team' OR (context = 'website' AND NOT has_team)) AND NOT EXISTS (SELECT 1 FROM f WHERE f.company_id = m.company_id AND f.name = m.name AND f.ord = m.ord))
SELECT company_id, name, ord, email_guess FROM g""", "people_v", "emails_v")
def _(spark, d):
    rows = E.attach_emails(persons(spark, d), published(spark, d))
    hosts = domains(spark, d).withColumn("accepts_email", F.lit(True))
    return E.expand_pattern(rows, E.infer_pattern(persons(spark, d), published(spark, d)), hosts, enabled=True).where("email_guess is not null").select("company_id", "name", "ord", "email_guess")


@query("a18_social_map", """WITH l AS (SELECT s_suppkey % 20 AS company_id, 'https://' || (['www.linkedin.com/company/', 'pk.linkedin.com/in/', 'twitter.com/', 'x.com/', 'example.com/'])[s_suppkey % 5 + 1] || s_suppkey AS url, s_suppkey AS ord,
 (['linkedin', 'linkedin', 'x', 'x', NULL])[s_suppkey % 5 + 1] AS network FROM supplier), f AS (SELECT company_id, network, arg_min(url, ord) AS url FROM l WHERE network IS NOT NULL GROUP BY ALL)
SELECT company_id, string_agg(network || '=' || url, ' ' ORDER BY network) AS social FROM f GROUP BY company_id""")
def _(spark, d):
    k = F.col("s_suppkey")
    host = F.get(F.array(*map(F.lit, ("www.linkedin.com/company/", "pk.linkedin.com/in/", "twitter.com/", "x.com/", "example.com/"))), (k % 5).cast("int"))
    links = table(spark, d, "supplier").select((k % 20).alias("company_id"), F.concat(F.lit("https://"), host, k).alias("url"), k.alias("ord"))
    flat = F.array_join(F.transform(F.map_entries("social"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return E.social_map(links).select("company_id", flat.alias("social"))


@query("a19_mail_setup", r"""SELECT domain, bool_or(rtype = 'MX') AS accepts_email, CASE WHEN bool_or(rtype = 'MX' AND contains(data, 'google.com')) THEN 'Google Workspace' WHEN bool_or(rtype = 'MX' AND contains(data, 'outlook.com')) THEN 'Microsoft 365' WHEN bool_or(rtype = 'MX') THEN 'Self-hosted / other' END AS email_provider,
 CASE WHEN bool_or(rtype = 'TXT' AND contains(data, 'v=spf1')) THEN 'Google Workspace, SendGrid' ELSE '' END AS email_senders, min(CASE WHEN rtype = 'DMARC' THEN regexp_extract(data, '\bp=(\w+)', 1) END) AS dmarc_policy,
 CASE WHEN bool_or(rtype = 'TXT' AND contains(data, 'verification')) THEN 'ms' ELSE '' END AS txt_verifications FROM dns_v GROUP BY domain""", "dns_v")
def _(spark, d):
    found = E.mail_setup(view(spark, d, "dns_v"))
    return found.select("domain", "accepts_email", "email_provider", F.array_join("email_senders", ", ").alias("email_senders"), "dmarc_policy", F.array_join("txt_verifications", ", ").alias("txt_verifications"))


@query("a20_domain_facts", """SELECT 'supplier' || s_suppkey || '.example.com' AS domain, 'Registrar ' || s_suppkey % 5 AS registrar, (1995 + s_suppkey % 25) || '-03-01T00:00:00Z' AS created, '2030-01-01' AS expires,
 round(date_diff('day', make_date(1995 + s_suppkey % 25, 3, 1), DATE '2026-01-01') / 365.25, 1) AS age_years, 'ns1.host.example' AS nameserver FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    text = F.concat(
        F.lit('{"events":[{"eventAction":"registration","eventDate":"'), 1995 + k % 25, F.lit('-03-01T00:00:00Z"},{"eventAction":"expiration","eventDate":"2030-01-01"}],"entities":[{"roles":["abuse"]},{"roles":["registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Registrar '),
        k % 5, F.lit('"]]]}],"nameservers":[{"ldhName":"NS1.HOST.example"}],"status":["active"]}'),
    )
    answers = table(spark, d, "supplier").select(F.concat(F.lit("supplier"), k, F.lit(".example.com")).alias("domain"), text.alias("json"))
    return E.domain_facts(answers, F.lit("2026-01-01").cast("date")).select("domain", "registrar", "created", "expires", "age_years", F.get("nameservers", F.lit(0)).alias("nameserver"))


@query("a21_register_facts", """SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 3 = 0 THEN 1999 ELSE CASE WHEN s_suppkey % 4 <> 0 THEN 1960 + s_suppkey % 60 END END AS founded_year, CASE WHEN s_suppkey % 4 <> 0 THEN (1960 + s_suppkey % 60) || '-01-15' END AS incorporation_date,
 CASE WHEN s_suppkey % 2 = 0 THEN 'HQ' ELSE CASE WHEN s_suppkey % 4 <> 0 THEN s_name END END AS headquarters FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier")
    companies = rows.select(k.alias("company_id"), F.when(k % 3 == 0, 1999).alias("founded_year"), F.when(k % 2 == 0, "HQ").alias("headquarters"))
    registry = rows.where("s_suppkey % 4 <> 0").select(k.alias("company_id"), F.concat(1960 + k % 60, F.lit("-01-15")).alias("incorporation_date"), F.col("s_name").alias("registered_address"))
    return E.fill_from_register(companies, registry, 2026).select("company_id", "founded_year", "incorporation_date", "headquarters")


CHECKS = [("has_name", 2, 5), ("has_description", 3, 5), ("has_domain_email", 4, 10), ("accepts_email", 5, 5), ("has_valid_phone", 6, 10), ("has_location", 7, 10), ("has_person", 3, 15), ("has_person_email", 8, 10), ("has_social", 9, 5), ("has_tech", 10, 5), ("has_founded_year", 11, 5), ("has_employees", 2, 10), ("has_registration", 5, 5)]
SCORE = " + ".join(f"CASE WHEN c_custkey % {n} = 0 THEN {w} ELSE 0 END" for _, n, w in CHECKS)


@query("a22_lead_score", f"WITH s AS (SELECT c_custkey, {SCORE} AS lead_score FROM customer) SELECT c_custkey, lead_score, CASE WHEN lead_score >= 80 THEN 'A' WHEN lead_score >= 60 THEN 'B' WHEN lead_score >= 40 THEN 'C' ELSE 'D' END AS lead_grade FROM s")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", *[(F.col("c_custkey") % n == 0).alias(c) for c, n, _ in CHECKS])
    return E.lead_score(rows).select("c_custkey", "lead_score", "lead_grade")


@query("a23_crawl_stats", """SELECT job_id, count(*) AS pages, count(*) FILTER (error = '') AS succeeded, count(*) FILTER (error <> '' AND challenge = '') AS failed, count(*) FILTER (challenge <> '') AS blocked FROM page_log_v GROUP BY job_id""", "page_log_v")
def _(spark, d):
    return E.crawl_stats(view(spark, d, "page_log_v")).select("job_id", "pages", "succeeded", "failed", "blocked")


@query("a24_crawl_status", """WITH g AS (SELECT job_id, coalesce(bool_or(status BETWEEN 200 AND 399), FALSE) AS readable, bool_or(challenge = 'robots') AS refused, list_sort(list(DISTINCT coalesce(CAST(status AS VARCHAR), nullif(error, ''), 'no answer')))[1:3] AS codes FROM page_log_v WHERE ts < TIMESTAMP '2024-01-03' AND job_id % 4 <> 1 OR status IS NULL OR status = 403 GROUP BY job_id),
c AS (SELECT s_suppkey AS job_id, CASE WHEN s_suppkey % 5 <> 0 THEN 'https://x' END AS website FROM supplier)
SELECT job_id, CASE WHEN website IS NULL THEN 'no website' WHEN readable THEN 'completed' WHEN refused THEN 'blocked by robots.txt' ELSE 'failed' END AS crawl_status,
 CASE WHEN website IS NOT NULL AND coalesce(readable, FALSE) = FALSE AND coalesce(refused, FALSE) = FALSE THEN 'website not readable (' || coalesce(array_to_string(codes, ', '), '') || ')' END AS crawl_error FROM c LEFT JOIN g USING (job_id)""", "page_log_v")
def _(spark, d):
    log = view(spark, d, "page_log_v").where("ts < timestamp '2024-01-03' and job_id % 4 <> 1 or status is null or status = 403")
    k = F.col("s_suppkey")
    companies = table(spark, d, "supplier").select(k.alias("job_id"), F.when(k % 5 != 0, "https://x").alias("website"))
    return E.crawl_status(companies, log).select("job_id", "crawl_status", "crawl_error")


@query("a25_errors_map", """WITH e AS (SELECT job_id, split_part(url, '/p', 2) AS source, error || ' at ' || CAST(ts AS VARCHAR) AS message, ts FROM page_log_v WHERE error <> ''), f AS (SELECT job_id, source, arg_min(error, ts) AS message FROM (SELECT job_id, split_part(url, '/p', 2) AS source, error, ts FROM page_log_v WHERE error <> '') GROUP BY ALL)
SELECT job_id, string_agg(source || ':' || left(message, 300), ',' ORDER BY source) AS errors FROM f GROUP BY job_id""", "page_log_v")
def _(spark, d):
    rows = view(spark, d, "page_log_v").where("error <> ''").select("job_id", F.substring_index("url", "/p", -1).alias("source"), F.col("error").alias("message"), F.col("ts").alias("ord"))
    flat = F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return E.errors_map(rows).select("job_id", flat.alias("errors"))
