"""Registered queries over web pages (X1-X17, M15-M17, S5, ST1), with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orgatlas.functions import technology
from orgatlas.operators import extract as X
from orgatlas.operators import frontier as N
from orgatlas.plans.views import table, texts, view, with_views
from orgatlas.sources.html import parse_pages
from orgatlas.sources.pages import read_pages
from orgatlas.sources.staging import spread

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def parsed(spark, d):
    return parse_pages(texts(spark, d, "pages"))


def hrefs():
    return F.transform("links", lambda a: a["href"])


NONE = F.array  # an empty list of links, for rows that have none


@query("s5_page_source", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def _(spark, d):
    pages = read_pages(spark, f"{d.rstrip('/')}/pages.parquet", columns=("page_id", "url", "html"))
    return pages.select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("s5_pages_as_lines", "SELECT page_id, 'https://x/' || page_id AS url, CAST(CASE page_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 301 END AS INTEGER) AS status, length(html) AS n_chars FROM pages WHERE page_id % 4 < 3")
def _(spark, d):
    """Written as JSON lines under a crawler's own names, read back as pages: answers of the 400s are left out, a missing status is none."""
    path = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/pages-{uuid.uuid4().hex}"
    k = F.col("page_id")
    status = F.when(k % 4 == 3, 404).when(k % 3 == 0, 200).when(k % 3 == 1, 301)
    table(spark, d, "pages").select(k, F.concat(F.lit("https://x/"), k).alias("address"), status.alias("code"), F.col("html").alias("body")).write.json(path)
    pages = read_pages(spark, path, "json", ("page_id", "url", "status", "html", "headers"), {"url": "address", "status": "code", "html": "body"}, readable=True)
    return pages.where("headers is null").select("page_id", "url", "status", F.length("html").cast("long").alias("n_chars"))


@query("x1_page_title", r"SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages")
def _(spark, d):
    return parsed(spark, d).select("page_id", "title")


@query("x1_page_text")
def _(spark, d):
    return parsed(spark, d).select("page_id", "title", "description", "site_name", F.array_join("lines", "\n").alias("text"))


@query("x2_headings", r"""WITH h AS (SELECT page_id, trim(regexp_replace(replace(unnest(regexp_extract_all(html, '(?s)<h[123]>(.*?)</h[123]>', 1)), '&amp;', '&'), '\s+', ' ', 'g')) AS value FROM pages)
SELECT page_id, value FROM h WHERE value <> '' GROUP BY ALL""")
def _(spark, d):
    return X.headings(parsed(spark, d)).select("page_id", "value")


def before(spark, d, parts: dict[int, str], modulus: int):
    """Parsed pages with further markup in front, by page_id modulo ``modulus``; # stands for the page_id."""
    extra = F.lit("")
    for rest, markup in parts.items():
        extra = F.when(F.col("page_id") % modulus == rest, F.replace(F.lit(markup), F.lit("#"), F.col("page_id").cast("string"))).otherwise(extra)
    return texts(spark, d, "pages").withColumn("html", F.concat(extra, "html"))


LINKED = '<script type="application/ld+json">%s</script>'


@query("x3_jsonld_objects", """SELECT page_id, 0 AS script, 0 AS item, '{"name":"C' || page_id || '"}' AS object FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 0, unnest([0, 1]), '{"n":' || unnest([1, 2]) || '}' FROM pages WHERE page_id % 4 = 1
UNION ALL SELECT page_id, 1, 0, '{"name":"G' || page_id || '"}' FROM pages WHERE page_id % 4 = 3""")
def _(spark, d):
    pages = before(spark, d, {0: LINKED % '{"name": "C#"}', 1: LINKED % '[{"n": 1}, {"n": 2}]', 2: LINKED % "{bad", 3: LINKED % "{bad" + LINKED % '{"@graph": [{"name": "G#"}]}'}, 4)
    return X.jsonld_objects(parse_pages(pages)).select("page_id", "script", "item", F.to_json("object").alias("object"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("x4_emails", rf"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS found FROM documents), u AS (SELECT doc_id, unnest(found) AS value, unnest(range(1, len(found) + 1)) AS pos FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(value) ORDER BY pos) AS rn FROM u) SELECT doc_id, value FROM k WHERE rn = 1""")
def _(spark, d):
    return X.emails(texts(spark, d, "documents"), F.col("text"), F.array().cast("array<string>"), "doc_id").select("doc_id", "value")


@query("x5_phones")
def _(spark, d):
    return X.phones(texts(spark, d, "documents"), F.split("text", r"\r\n|\n|\r"), F.array().cast("array<string>"), "doc_id").select("doc_id", "pos", "value")


SOCIAL = ("linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "github.com")


@query("x6_social_links", """WITH a AS (SELECT id, unnest(['https://www.linkedin.com/company/' || name, 'https://netflix.com/' || id, website, 'https://example.com/x.com']) AS href FROM places_v)
SELECT DISTINCT id, trim(href) AS value FROM a WHERE regexp_matches(lower(regexp_extract(href, '^https?://([^/:?#]*)', 1)), 'linkedin\\.com|facebook\\.com|instagram\\.com|twitter\\.com|x\\.com|youtube\\.com|github\\.com')""".replace("\\\\", "\\"), "places_v")
def _(spark, d):
    links = F.array(F.concat(F.lit("https://www.linkedin.com/company/"), "name"), F.concat(F.lit("https://netflix.com/"), "id"), "website", F.lit("https://example.com/x.com"))
    return X.social_links(spread(view(spark, d, "places_v")), F.array_compact(links), "id").select("id", "value")


@query("x7_people", """SELECT page_id, CASE page_id % 4 WHEN 1 THEN 2 ELSE 0 END AS pos, (['Ann Lee', 'Bob Stone', 'Cleo Marsh'])[page_id % 4 + 1] AS name, (['CEO', 'Founder', 'President'])[page_id % 4 + 1] AS title FROM pages WHERE page_id % 4 < 3""")
def _(spark, d):
    pages = before(spark, d, {0: "<p>Ann Lee, CEO</p>", 1: "<p>Bob</p><p>Stone</p><p>\u2022 Founder</p>", 2: "<p>President</p><p>Cleo Marsh</p>", 3: "<p>Message of the CEO</p><p>Ann Lee</p>"}, 4)
    return X.people(X.lines_of(parse_pages(pages)))


CERT = r"(?i)\b(ISO(?:/IEC)?\s?\d{4,5}(?::\d{4})?|SOC\s?[12](?:\s?Type\s?(?:II|I|2|1))?|CMMI(?:\s?(?:Level|ML)\s?\d)?|HIPAA(?:\s?Compliant)?|GDPR(?:\s?Compliant)?|PCI[\s-]?DSS|(?:AWS|Microsoft|Google Cloud|Salesforce|Shopify|HubSpot|Odoo|Oracle|SAP)\s(?:Advanced|Select|Premier|Gold|Silver|Certified|Registered|Consulting)?\s?(?:Tier\s)?(?:Consulting\s|Services\s|Solutions\s)?Partner)\b"


@query("x8_certifications", rf"""WITH t AS (SELECT id, name || ' holds ISO ' || (9000 + id % 3) || ':2015, iso 9001:2015, SOC 2 Type II and is an AWS Advanced Consulting Partner; GDPR compliant' AS text FROM places_v),
e AS (SELECT id, regexp_extract_all(text, '{CERT}') AS found FROM t), u AS (SELECT id, unnest(found) AS value, unnest(range(1, len(found) + 1)) AS pos FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY id, lower(value) ORDER BY pos) AS rn FROM u) SELECT id, value FROM k WHERE rn = 1""", "places_v")
def _(spark, d):
    text = F.concat("name", F.lit(" holds ISO "), 9000 + F.col("id") % 3, F.lit(":2015, iso 9001:2015, SOC 2 Type II and is an AWS Advanced Consulting Partner; GDPR compliant"))
    return X.certifications(spread(view(spark, d, "places_v")), text, "id").select("id", "value")


@query("x9_addresses", """SELECT page_id, 0 AS pos, CASE page_id % 3 WHEN 0 THEN page_id || ' Main Street, Springfield' ELSE page_id || ' High Street, Old Town, Avalon' END AS value FROM pages WHERE page_id % 3 < 2""")
def _(spark, d):
    pages = before(spark, d, {0: "<address># Main Street<br>Springfield<br>info@a.example</address>", 1: "<p># High Street,</p><p>Old Town, Avalon</p>"}, 3)
    return X.addresses(parse_pages(pages).withColumn("category", F.lit("homepage")))


@query("x10_internal_links", r"""WITH a AS (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) AS origin, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages)
SELECT page_id, origin || rtrim(href, '/') AS link, trim(label) AS label FROM a WHERE trim(label) <> '' AND rtrim(href, '/') <> '' AND regexp_matches(href, '^/[^ÿ]*$')""")
def _(spark, d):
    return X.internal_links(parsed(spark, d)).select("page_id", "link", "label")


@query("x11_client_logos", "SELECT page_id, unnest([0, 1]) AS pos, unnest(['Acme ' || page_id, 'Beta']) AS value FROM pages WHERE page_id % 2 = 0")
def _(spark, d):
    return X.client_logos(parse_pages(before(spark, d, {0: '<div class="client-logos"><img alt="Acme # logo"><img alt="Beta"><img alt="Beta image"></div>', 1: '<img alt="Gamma logo">'}, 2)))


TEST_SIGNATURES = [("Tracker", "Analytics", r"track\(\d+\);?"), ("Adverts", "Advertising", r"<div class=\"ad\">|<!-- ad \d+"), ("Feed", "Syndication", r"utm_source=feed"), ("Article", "Markup", r"<article>")]


@query("x12_technologies", r"""WITH h AS (SELECT page_id, lower(chr(10) || html) AS hay FROM pages), s AS (SELECT * FROM (VALUES ('Tracker', 'Analytics', 'track\(\d+\);?'), ('Adverts', 'Advertising', '<div class="ad">|<!-- ad \d+'), ('Feed', 'Syndication', 'utm_source=feed'), ('Article', 'Markup', '<article>')) t(name, category, pattern))
SELECT page_id, name, category, left(regexp_extract(hay, pattern), 80) AS evidence FROM h, s WHERE regexp_matches(hay, pattern)""")
def _(spark, d):
    return technology.detect_tech(texts(spark, d, "pages"), TEST_SIGNATURES)


@query("x12_all_signatures", "SELECT page_id, (['Vimeo', 'Google Fonts', 'Calendly'])[page_id % 4 + 1] AS name, (['Video', 'Font', 'Scheduling'])[page_id % 4 + 1] AS category, (['player.vimeo.com', 'fonts.googleapis.com', 'calendly.com/'])[page_id % 4 + 1] AS evidence FROM pages WHERE page_id % 4 < 3")
def _(spark, d):
    return technology.detect_tech(before(spark, d, {0: '<iframe src="https://Player.vimeo.com/1">', 1: '<link href="//fonts.googleapis.com/css">', 2: "see calendly.com/#"}, 4))


#: What a page holds for the signatures whose first alternative is no plain text.
SHOWN = {"BigCommerce": "cdn11.bigcommerce.com", "Vue.js": "data-v-0a1b2c3d", "Svelte": 'class="a svelte-1x2y"', "jQuery": "jquery-3.7.1.js", "GSAP": "gsap.min.js", "Bootstrap": "bootstrap.min.css", "Meta Pixel": "connect.facebook.net/en_US/fbevents.js"}


def shown(name: str, pattern: str) -> str:
    return SHOWN.get(name) or technology.branches(pattern)[0].replace("\\", "")


EACH = [(k, *signature, shown(signature[0], signature[2])) for k, signature in enumerate(technology.SIGNATURES)]
EACH_VALUES = ", ".join("({}, '{}', '{}', '{}', '{}')".format(k, *(str(x).replace("'", "''") for x in rest)) for k, *rest in EACH)


@query("x12_each_signature", f"""WITH s AS (SELECT * FROM (VALUES {EACH_VALUES}) t(k, name, category, pattern, shown)),
h AS (SELECT page_id, lower(chr(10) || shown || html) AS hay FROM pages JOIN s ON page_id % {len(EACH)} = k)
SELECT page_id, name, category, left(regexp_extract(hay, lower(pattern)), 80) AS evidence FROM h, s WHERE regexp_matches(hay, lower(pattern))""")
def _(spark, d):
    # every page shows one of the signatures, in turn, before its own content
    text = F.get(F.array(*[F.lit(e[-1]) for e in EACH]), (F.col("page_id") % len(EACH)).cast("int"))
    return technology.detect_tech(texts(spark, d, "pages").withColumn("html", F.concat(text, "html")))


PATHS = ("/about", "/our-services/x", "/team/leadership", "/a-very-long-slug-about-company-technology", "/careers/", "/x", "/case-study/one", "/")
LABELS = ("Contact our offices", "", "Meet the people who lead every one of our many companies", "Platform", "Home", "Our work", "Jobs", "News")
CRAFTED = """SELECT page_id, 'https://h' || page_id % 9 || '.example.com' || (['/about', '/our-services/x', '/team/leadership', '/a-very-long-slug-about-company-technology', '/careers/', '/x', '/case-study/one', '/'])[page_id % 8 + 1] AS link,
 (['Contact our offices', '', 'Meet the people who lead every one of our many companies', 'Platform', 'Home', 'Our work', 'Jobs', 'News'])[page_id // 8 % 8 + 1] AS label FROM pages"""
WORDS = """w AS (SELECT * FROM (VALUES (1, 'about', 'about|company|who-we-are|our-story|overview'), (2, 'services', 'services|solutions|what-we-do|capabilities'), (3, 'industries', 'industries|industry|expertise|verticals'),
 (4, 'technology', 'technology|technologies|tech-stack|stack|platform'), (5, 'team', 'team|leadership|people|management'), (6, 'contact', 'contact|locations|offices'),
 (7, 'case_studies', 'case-study|case-studies|portfolio|work|clients'), (8, 'careers', 'career|careers|jobs')) t(n, category, pattern))"""


def crafted(spark, d):
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    link = F.concat(F.lit("https://h"), F.col("page_id") % 9, F.lit(".example.com"), pick(PATHS, F.col("page_id") % 8))
    return table(spark, d, "pages").select("page_id", link.alias("link"), pick(LABELS, F.floor(F.col("page_id") / 8) % 8).alias("label"))


@query("x13_page_class", rf"""WITH l AS ({CRAFTED}), {WORDS},
p AS (SELECT *, lower(regexp_extract(link, '^https?://[^/]*([^?#]*)', 1)) AS path FROM l), s AS (SELECT *, regexp_extract(rtrim(path, '/'), '([^/]*)$', 1) AS last FROM p),
t AS (SELECT page_id, link, label, 1 AS step, 0.95 AS score, CASE WHEN len(string_split(last, '-')) <= 3 THEN last ELSE '' END AS text FROM s
 UNION ALL SELECT page_id, link, label, 2, 0.90, CASE WHEN len(string_split(last, '-')) <= 3 THEN path ELSE '' END FROM s UNION ALL SELECT page_id, link, label, 3, 0.82, CASE WHEN length(label) <= 40 THEN lower(label) ELSE '' END FROM s),
m AS (SELECT page_id, arg_min(category, step * 100 + n) AS category, CAST(arg_min(score, step * 100 + n) AS DOUBLE) AS score FROM t, w WHERE regexp_matches(text, pattern) GROUP BY page_id)
SELECT page_id, coalesce(category, 'other') AS category, coalesce(score, 0.2) AS category_score FROM l LEFT JOIN m USING (page_id)""")
def _(spark, d):
    return N.classify_links(crafted(spark, d)).select("page_id", "category", "category_score")


@query("x14_link_ranking", rf"""WITH l AS (SELECT page_id % 10 AS page_id, page_id AS pos, 'https://h.example.com/p' || page_id % 40 AS link, (['about', 'team', 'other'])[page_id % 3 + 1] AS category, (3 - page_id % 3) / 10 AS score FROM pages),
b AS (SELECT page_id, link, arg_max(category, score * 1000000 - pos) AS category, max(score) AS score FROM l GROUP BY page_id, link),
t AS (SELECT *, row_number() OVER (PARTITION BY page_id, category ORDER BY score DESC, length(link), link) AS turn FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY turn, CASE category WHEN 'about' THEN 1 WHEN 'team' THEN 5 ELSE 9 END) AS place FROM t)
SELECT page_id, link, category, place FROM r WHERE place <= 6""")
def _(spark, d):
    kind = F.get(F.array(F.lit("about"), F.lit("team"), F.lit("other")), (F.col("page_id") % 3).cast("int"))
    links = table(spark, d, "pages").select((F.col("page_id") % 10).alias("page_id"), F.col("page_id").alias("pos"), F.concat(F.lit("https://h.example.com/p"), F.col("page_id") % 40).alias("link"), kind.alias("category"), ((3 - F.col("page_id") % 3) / 10).alias("category_score"))
    return N.rank_links(links, 6).select("page_id", "link", "category", F.col("place").cast("long").alias("place"))


@query("x14_discover", rf"""WITH a AS (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) AS origin, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS ls FROM pages),
u AS (SELECT page_id, origin, unnest(hs) AS href, unnest(ls) AS label, unnest(range(len(hs))) AS pos FROM a),
l AS (SELECT page_id, pos, origin || CASE WHEN rtrim(href, '/') = '' THEN '/' ELSE rtrim(href, '/') END AS link, lower(trim(label)) AS label FROM u WHERE starts_with(href, '/')), {WORDS},
p AS (SELECT *, lower(regexp_extract(link, '^https?://[^/]*([^?#]*)', 1)) AS path FROM l), s AS (SELECT *, regexp_extract(rtrim(path, '/'), '([^/]*)$', 1) AS last FROM p),
t AS (SELECT page_id, pos, 1 AS step, 0.95 AS score, CASE WHEN len(string_split(last, '-')) <= 3 THEN last ELSE '' END AS text FROM s
 UNION ALL SELECT page_id, pos, 2, 0.90, CASE WHEN len(string_split(last, '-')) <= 3 THEN path ELSE '' END FROM s UNION ALL SELECT page_id, pos, 3, 0.82, CASE WHEN length(label) <= 40 THEN label ELSE '' END FROM s),
m AS (SELECT page_id, pos, arg_min(category, step * 100 + n) AS category, arg_min(w.n, step * 100 + n) AS n, CAST(arg_min(score, step * 100 + n) AS DOUBLE) AS score FROM t, w WHERE regexp_matches(text, pattern) GROUP BY page_id, pos),
c AS (SELECT page_id, pos, link, coalesce(category, 'other') AS category, coalesce(n, 9) AS n, coalesce(score, 0.2) AS score FROM l LEFT JOIN m USING (page_id, pos)),
b AS (SELECT page_id, link, arg_max(category, score * 1000000 - pos) AS category, arg_max(n, score * 1000000 - pos) AS n, max(score) AS score FROM c GROUP BY page_id, link),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, category ORDER BY score DESC, length(link), link) AS turn FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY turn, n) AS place FROM k)
SELECT page_id, link, category, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 6""")
def _(spark, d):
    return N.discover(parsed(spark, d), F.col("url"), 6)


BLOCKED = "SELECT page_id, html || CASE page_id % 5 WHEN 0 THEN '<div class=g-recaptcha>' WHEN 1 THEN '<title>Just a moment</title>' WHEN 2 THEN '<input name=p type=password>' ELSE '' END AS html, length(html) AS text_length, CASE page_id % 4 WHEN 0 THEN 403 WHEN 1 THEN 401 ELSE 200 END AS status FROM pages"


def blocked(spark, d):
    extra = F.when(F.col("page_id") % 5 == 0, "<div class=g-recaptcha>").when(F.col("page_id") % 5 == 1, "<title>Just a moment</title>").when(F.col("page_id") % 5 == 2, "<input name=p type=password>").otherwise("")
    status = F.when(F.col("page_id") % 4 == 0, 403).when(F.col("page_id") % 4 == 1, 401).otherwise(200)
    return table(spark, d, "pages").select("page_id", "url", F.concat("html", extra).alias("html"), F.length("html").alias("text_length"), status.alias("status"), F.col("url").alias("final_url"))


@query("x15_challenge", rf"""WITH b AS ({BLOCKED})
SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'cloudflare' WHEN (text_length < 1500 OR status >= 400) AND page_id % 5 = 0 THEN 'recaptcha' WHEN page_id % 5 = 2 AND text_length < 1500 AND status = 401 THEN 'login' WHEN status >= 400 AND text_length < 1500 THEN 'blocked' ELSE '' END AS challenge FROM b""")
def _(spark, d):
    return N.challenge(blocked(spark, d)).select("page_id", "challenge")


@query("x16_thin_page", rf"""WITH b AS ({BLOCKED}) SELECT page_id, status IN (401, 403, 429, 503) OR status >= 500 OR text_length < 250 OR (text_length < 800 AND page_id % 7 > 5) AS thin FROM b""")
def _(spark, d):
    return blocked(spark, d).select("page_id", N.is_thin(F.col("status"), F.col("text_length"), F.col("page_id") % 7).alias("thin"))


@query("x17_section_children", """WITH l AS (SELECT page_id, 'https://h' || page_id % 9 || '.example.com/industries/' || (['a', 'b/c', 'd'])[page_id % 3 + 1] AS link, 'Label ' || page_id % 40 AS label FROM pages),
r AS (SELECT DISTINCT 'h' || page_id % 9 || '.example.com' AS site, CASE page_id % 2 WHEN 0 THEN '/industries' ELSE '/industries/b' END AS root FROM pages WHERE page_id % 5 = 0)
SELECT DISTINCT regexp_extract(link, '^https://([^/]*)', 1) AS site, l.page_id, label FROM l JOIN r ON regexp_extract(link, '^https://([^/]*)', 1) = r.site AND starts_with(regexp_extract(link, '^https://[^/]*(.*)$', 1), root || '/')""")
def _(spark, d):
    ids = table(spark, d, "pages").select("page_id")
    host = F.concat(F.lit("https://h"), F.col("page_id") % 9, F.lit(".example.com/industries"))
    tail = F.get(F.array(F.lit("/a"), F.lit("/b/c"), F.lit("/d")), (F.col("page_id") % 3).cast("int"))
    links = ids.select("page_id", F.lit(0).alias("pos"), F.concat(host, tail).alias("link"), F.concat(F.lit("Label "), F.col("page_id") % 40).alias("label"))
    roots = ids.where("page_id % 5 = 0").select(F.concat(host, F.when(F.col("page_id") % 2 == 0, "").otherwise("/b")).alias("url"), F.lit("industries").alias("category"))
    return X.section_children(links, roots, "industries").select("site", "page_id", "label").distinct()


@query("m15_robots_gate", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS path FROM pages),
h AS (SELECT page_id, arg_max(allow, length(path_prefix)) AS allow FROM p JOIN robots_v USING (host) WHERE starts_with(path, path_prefix) GROUP BY page_id)
SELECT page_id, coalesce(allow, TRUE) AS allowed FROM p LEFT JOIN h USING (page_id)""", "robots_v")
def _(spark, d):
    return N.robots_gate(table(spark, d, "pages").select("page_id", "url"), view(spark, d, "robots_v")).select("page_id", "allowed")


@query("m16_robots_fallback", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS path FROM pages),
h AS (SELECT page_id, arg_max(allow, length(path_prefix)) AS allow FROM p JOIN robots_v USING (host) WHERE starts_with(path, path_prefix) GROUP BY page_id)
SELECT url AS seed, regexp_extract(url, '^(https?://[^/]+)', 1) || unnest(['/contact', '/contact-us', '/about', '/about-us']) AS url FROM p JOIN h USING (page_id) WHERE NOT allow""", "robots_v")
def _(spark, d):
    return N.robots_fallback(N.robots_gate(table(spark, d, "pages").select("page_id", "url"), view(spark, d, "robots_v"))).select("seed", "url")


@query("m17_reachable", """WITH l1 AS (SELECT s.page_id AS seed, dst_id AS id, max(score) AS score FROM pages s JOIN links_v ON src_id = s.page_id WHERE dst_id <> s.page_id GROUP BY ALL),
r1 AS (SELECT seed, id FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS n FROM l1) WHERE n + 1 <= 6),
s1 AS (SELECT page_id AS seed, page_id AS id, 0 AS depth FROM pages UNION ALL SELECT seed, id, 1 FROM r1),
l2 AS (SELECT seed, dst_id AS id, max(score) AS score FROM r1 JOIN links_v ON src_id = r1.id GROUP BY ALL),
f2 AS (SELECT * FROM l2 WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.seed = l2.seed AND s1.id = l2.id)),
r2 AS (SELECT f.seed, f.id, row_number() OVER (PARTITION BY f.seed ORDER BY score DESC, f.id) + h.have AS n FROM f2 f JOIN (SELECT seed, count(*) AS have FROM s1 GROUP BY seed) h ON h.seed = f.seed)
SELECT seed, id, depth FROM s1 UNION ALL SELECT seed, id, 2 FROM r2 WHERE n <= 6""", "links_v")
def _(spark, d):
    return N.reachable(view(spark, d, "links_v"), table(spark, d, "pages").select(F.col("page_id").alias("id")), 2, 6)
