"""Registered queries of the column functions over URLs, names and texts (P1-P22), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orgatlas.functions import mojibake as M
from orgatlas.functions import text as T
from orgatlas.functions import urls as U
from orgatlas.plans.views import table, texts, view, with_views

Q: dict = {}
SQL: dict[str, str] = {}

TRACKING = "'utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','mc_cid','mc_eid'"


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


@query("p1_normalize_url", rf"""
WITH s AS (SELECT page_id, regexp_extract(url, '^(?i)(https?)://', 1) AS scheme, regexp_extract(url, '(?i)^https?://([^/?#]*)', 1) AS host,
 regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
k AS (SELECT *, rtrim(path, '/') AS p, list_filter(string_split(query, '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({TRACKING})) AS kept FROM s)
SELECT page_id, lower(scheme) || '://' || lower(host) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS url FROM k""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("url"))


@query("p2_domain", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)), '^www\.', '') AS domain FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))


@query("p3_same_domain", r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)), '^www\.', '') AS domain FROM pages)
SELECT a.page_id, b.page_id AS other_id FROM h a JOIN h b ON a.domain = b.domain AND b.page_id > a.page_id""")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))
    return U.pairs_of_domain(pages)


LINKS = """SELECT page_id, url, unnest(['/about', '/team/', '#top', 'mailto:a@b.c', '/logo.png', '/files/x.PDF?v=1', 'https://Other.example.com/a/?utm_source=x&b=2']) AS href FROM pages"""


@query("p4_canonical_link", rf"""
WITH l AS ({LINKS}), a AS (SELECT page_id, href, CASE WHEN href LIKE 'http%' THEN 'https://other.example.com/a?b=2' ELSE lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || rtrim(href, '/') END AS link FROM l)
SELECT page_id, href, CASE WHEN href LIKE '#%' OR href LIKE 'mailto:%' OR regexp_matches(link, '(?i)\.(png|pdf)($|\?)') THEN NULL ELSE link END AS link FROM a""")
def _(spark, d):
    hrefs = ["/about", "/team/", "#top", "mailto:a@b.c", "/logo.png", "/files/x.PDF?v=1", "https://Other.example.com/a/?utm_source=x&b=2"]
    links = table(spark, d, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, hrefs))).alias("href"))
    return links.select("page_id", "href", U.canonical_link(F.col("url"), F.col("href")).alias("link"))


@query("p5_origin", "SELECT id, regexp_extract(website, '^(https?://[^/]+)', 1) AS origin FROM places_v", "places_v")
def _(spark, d):
    return view(spark, d, "places_v").select("id", U.origin_of(F.col("website")).alias("origin"))


@query("p6_site_domain", r"SELECT page_id, regexp_extract(lower(url), '^(?:https?://)?(?:www\d?\.)?([^/:?#]+)', 1) AS site FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.site_domain(F.col("url")).alias("site"))


@query("p7_alternate_urls", r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)) AS host FROM pages),
o AS (SELECT *, CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE 'www.' || host END AS other FROM h),
c AS (SELECT page_id, unnest([1, 2, 3]) AS pos, unnest(['https://' || host, 'https://' || other, scheme || '://' || other]) AS tried, scheme || '://' || host AS own FROM o)
SELECT page_id, tried FROM c WHERE tried <> own GROUP BY page_id, tried""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(U.alternate_urls(F.col("url"))).alias("tried"))


@query("p8_clean", r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM documents")
def _(spark, d):
    return texts(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))


@query("p9_fix_mojibake")
def _(spark, d):
    return M.fix_mojibake(texts(spark, d, "documents").select("doc_id", "text"), "text")


WORDS = "SELECT DISTINCT unnest(string_split(lower(name), ' ')) AS word FROM places_v"


@query("p10_stem", rf"""WITH w AS ({WORDS}), b AS (SELECT word, regexp_replace(word, '\W', '', 'g') AS bare FROM w)
SELECT word, CASE WHEN length(bare) >= 6 THEN left(bare, 5) WHEN length(bare) > 4 THEN rtrim(bare, 's') ELSE bare END AS stem FROM b""", "places_v")
def _(spark, d):
    words = view(spark, d, "places_v").select(F.explode(F.split(F.lower("name"), " ")).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@query("p11_tokens", "WITH t AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand || '/' || p_type), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM part) SELECT p_partkey, token, count(*) AS n FROM t GROUP BY ALL")
def _(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.explode(T.tokens(F.concat_ws(" ", "p_name", F.concat_ws("/", "p_brand", "p_type")))).alias("token"))
    return parts.groupBy("p_partkey", "token").agg(F.count("*").alias("n"))


LEGAL = r"\b(limited|ltd|\(?pvt\)?|private limited|inc|corporation|corp|group|plc|llc)\b\.?"
MAP_LEGAL = r"\b(limited|ltd|\(?pvt\)?|private|inc|corporation|corp|co|company|group|plc|llc|the)\b\.?"
REGISTER_LEGAL = r"\b(private|pvt|limited|ltd|llc|l\.l\.c|inc|incorporated|corp|corporation|co|company|plc|gmbh|ag|sa|s\.a|bv|b\.v|nv|pty|pte|llp|lp|smc|fze|fzco|fz-llc)\b\.?"


@query("p12_name_keys", rf"""SELECT company_number,
 regexp_replace(regexp_replace(lower(name), '{LEGAL}', ' ', 'g'), '[^a-z0-9]', '', 'g') AS sibling_key,
 regexp_replace(regexp_replace(lower(name), '{MAP_LEGAL}', ' ', 'g'), '[^a-z0-9]', '', 'g') AS map_key,
 trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '{REGISTER_LEGAL}', ' ', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS register_key FROM registry_v""", "registry_v")
def _(spark, d):
    from orgatlas.functions.similarity import register_key

    name = F.col("name")
    return view(spark, d, "registry_v").select("company_number", T.sibling_key(name).alias("sibling_key"), T.map_key(name).alias("map_key"), register_key(name).alias("register_key"))


@query("p13_display_name", """WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'SMITH, JANE ' || c_mktsegment WHEN 1 THEN 'maria McDonald' ELSE upper(c_name) END AS filed FROM customer),
t AS (SELECT c_custkey, filed, CASE WHEN contains(filed, ',') THEN trim(string_split(filed, ',')[2]) || ' ' || trim(string_split(filed, ',')[1]) ELSE filed END AS turned FROM n)
SELECT c_custkey, array_to_string(list_transform(string_split(turned, ' '), lambda w: CASE WHEN w = upper(w) OR w = lower(w) THEN upper(w[1]) || lower(w[2:]) ELSE w END), ' ') AS shown FROM t""")
def _(spark, d):
    filed = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("SMITH, JANE "), "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.lit("maria McDonald")).otherwise(F.upper("c_name"))
    return table(spark, d, "customer").select("c_custkey", T.display_name(filed).alias("shown"))


@query("p14_country_code", """WITH t AS (SELECT n_nationkey, unnest([n_name, lower(n_name), 'uk', 'n' || n_nationkey, 'nowhere']) AS typed FROM nation)
SELECT n_nationkey, typed, CASE WHEN typed = 'uk' THEN 'GB' WHEN typed LIKE 'n%' AND length(typed) = 2 THEN upper(typed) WHEN lower(typed) LIKE 'nation%' THEN 'N' || n_nationkey END AS code FROM t""")
def _(spark, d):
    nation = table(spark, d, "nation")
    countries = nation.select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))
    typed = nation.select("n_nationkey", F.explode(F.array("n_name", F.lower("n_name"), F.lit("uk"), F.concat(F.lit("n"), "n_nationkey"), F.lit("nowhere"))).alias("typed"))
    from orgatlas.operators.dimensions import country_codes

    return country_codes(typed, "typed", countries).select("n_nationkey", "typed", "code")


@query("p15_jurisdiction", "SELECT company_number, upper(jurisdiction_code) AS filed, lower(replace(upper(replace(jurisdiction_code, '_', '-')), '-', '_')) AS jurisdiction, left(jurisdiction_code, 2) AS country FROM registry_v", "registry_v")
def _(spark, d):
    code = F.upper("jurisdiction_code")
    filed = F.upper(F.replace("jurisdiction_code", F.lit("_"), F.lit("-")))
    return view(spark, d, "registry_v").select("company_number", code.alias("filed"), T.jurisdiction(filed).alias("jurisdiction"), T.country_of(filed).alias("country"))


@query("p16_address_join", "SELECT id, array_to_string(list_filter([CASE WHEN id % 2 = 0 THEN 'Street ' || id END, city, CASE WHEN id % 3 = 0 THEN ' ' ELSE country END], lambda x: x IS NOT NULL AND trim(x) <> ''), ', ') AS address FROM places_v", "places_v")
def _(spark, d):
    street = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Street "), "id"))
    return view(spark, d, "places_v").select("id", T.joined_address(street, F.col("city"), F.when(F.col("id") % 3 == 0, F.lit(" ")).otherwise(F.col("country"))).alias("address"))


@query("p17_distinct_labels", """WITH l AS (SELECT c_custkey, unnest([1, 2, 3, 4, 5]) AS pos, unnest([c_mktsegment, lower(c_mktsegment), 'About Us', ' ' || c_name, upper(c_name)]) AS label FROM customer),
k AS (SELECT c_custkey, pos, trim(label) AS label, row_number() OVER (PARTITION BY c_custkey, lower(trim(label)) ORDER BY pos) AS rn FROM l WHERE lower(label) <> 'about us')
SELECT c_custkey, string_agg(label, '|' ORDER BY pos) AS labels FROM k WHERE rn = 1 GROUP BY c_custkey""")
def _(spark, d):
    labels = F.array("c_mktsegment", F.lower("c_mktsegment"), F.lit("About Us"), F.concat(F.lit(" "), "c_name"), F.upper("c_name"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(T.distinct_labels(labels), "|").alias("labels"))


@query("p18_category_label", "SELECT id, replace(category_primary, '_', ' ') AS category, category_root || ' > ' || category_primary AS category_path FROM places_v", "places_v")
def _(spark, d):
    return view(spark, d, "places_v").select("id", T.category_label(F.col("category_primary")).alias("category"), T.category_path(F.array("category_root", "category_primary")).alias("category_path"))


@query("p19_email_parts", "SELECT ord, lower(local) AS local, lower(email_domain) AS domain FROM emails_v", "emails_v")
def _(spark, d):
    local, host = T.email_parts(F.upper(F.concat_ws("@", "local", "email_domain")))
    return view(spark, d, "emails_v").select("ord", local.alias("local"), host.alias("domain"))


@query("p20_employee_range", """SELECT o_orderkey, CASE WHEN n <= 10 THEN '1-10' WHEN n <= 50 THEN '11-50' WHEN n <= 200 THEN '51-200' WHEN n <= 500 THEN '201-500' WHEN n <= 1000 THEN '501-1000' WHEN n <= 5000 THEN '1001-5000' WHEN n <= 10000 THEN '5001-10000' ELSE '10000+' END AS employee_range
FROM (SELECT o_orderkey, o_orderkey % 12000 + 1 AS n FROM orders)""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.employee_range(F.col("o_orderkey") % 12000 + 1).alias("employee_range"))


@query("p21_age_years", "SELECT o_orderkey, round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2026-01-01') / 365.25, 1) AS age, 2026 - CAST(year(o_orderdate) AS INTEGER) AS company_age FROM orders")
def _(spark, d):
    as_of = F.lit("2026-01-01").cast("date")
    return table(spark, d, "orders").select("o_orderkey", T.age_years(F.col("o_orderdate"), as_of).alias("age"), (F.year(as_of) - F.year("o_orderdate")).alias("company_age"))
