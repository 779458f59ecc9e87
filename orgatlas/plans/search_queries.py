"""Registered queries of the company search (C1-C17) and of the places source (S1-S4), with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgatlas.operators import search as S
from orgatlas.plans.views import table, view, with_views
from orgatlas.sources import places as P

COUNTRY = "NATION_11"
INDUSTRY = "machinery"
SEARCHES = [("machinery in 11", "machinery", "NATION_11"), ("makers in 2", "manufacturing", "NATION_2"), ("alpha in 11", "alpha", "NATION_11")]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived places with the columns that search wants."""
    return view(spark, sf_dir, "places_v").withColumns({"hierarchy": F.array("category_root", "category_primary"), "alternates": F.array().cast("array<string>")})


def r6(c: str):
    return F.round(c, 6).alias(c)


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = with_views(sql, "places_v")
        return f

    return add


LEGAL = r"(?i)\b(limited|ltd|\(?pvt\)?|private limited|inc|corporation|corp|group|plc|llc)\b\.?"
SITE = r"nullif(regexp_extract(lower(website), '^(?:https?://)?(?:www\d?\.)?([^/:?#]+)', 1), '')"
VALID = "upper(country) = '{c}' AND coalesce(operating_status, 'open') NOT IN ('closed', 'permanently_closed') AND name IS NOT NULL"


def hits_sql(term: str, country: str, tier: str, extra: str = "") -> str:
    """Hits of one search over places_v with tier and base score, as common table expressions up to ``ranked``."""
    return rf"""
hits AS (SELECT *, {tier} AS tier, CASE WHEN website IS NOT NULL THEN 2.0 ELSE 0.0 END + CASE WHEN email IS NOT NULL THEN 1.0 ELSE 0.0 END
  + CASE WHEN phone IS NOT NULL THEN 1.0 ELSE 0.0 END + coalesce(confidence, 0.0) AS score0,
  regexp_replace(regexp_replace(lower(name), '{LEGAL}', ' ', 'g'), '[^a-z0-9]', '', 'g') AS skey
 FROM places_v WHERE {VALID.format(c=country)} AND (regexp_matches(name, '(?i)(^|[^\pL\pN])({term})') OR regexp_matches(category_primary, '(?i)(^|[^\pL\pN])({term})')
  OR regexp_matches(category_root, '(?i)(^|[^\pL\pN])({term})')) {extra}),
firsts AS (SELECT skey, arg_min(website, id) FILTER (website IS NOT NULL) AS w, arg_min(phone, id) FILTER (phone IS NOT NULL) AS p,
  arg_min(email, id) FILTER (email IS NOT NULL) AS e FROM hits WHERE length(skey) >= 4 GROUP BY skey),
filled AS (SELECT hits.* REPLACE (coalesce(website, w) AS website, coalesce(phone, p) AS phone, coalesce(email, e) AS email) FROM hits LEFT JOIN firsts USING (skey)),
sited AS (SELECT *, {SITE} AS site FROM filled),
located AS (SELECT *, CASE WHEN site IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY site) END AS locations FROM sited),
bonus AS (SELECT *, score0 + least(3.0, log2(locations)) + CASE WHEN regexp_matches(name, '{LEGAL}') THEN 1.0 ELSE 0.0 END AS score1 FROM located),
roots AS (SELECT category_root, count(*) AS n FROM bonus WHERE tier = 0 GROUP BY category_root),
scored AS (SELECT bonus.*, CASE WHEN tier = 0 THEN score1 + 2.0 * n / (SELECT max(n) FROM roots) ELSE score1 END AS score FROM bonus LEFT JOIN roots USING (category_root)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN site IS NOT NULL THEN 'site:' || site ELSE 'name:' || regexp_replace(lower(name), '\W', '', 'g') || chr(9) || lower(city) END
  ORDER BY tier DESC, round(score, 9) DESC, id) AS rn FROM scored),
companies AS (SELECT * FROM ranked WHERE rn = 1)"""


MACHINERY = hits_sql("machi", "NATION_11", "CASE WHEN regexp_matches(category_primary, '(^|_)machinery') THEN 3 ELSE 0 END")
ALPHA = hits_sql("alpha", "NATION_11", "0")
MAKERS = hits_sql("manuf", "NATION_2", "CASE WHEN regexp_matches(category_primary, '(^|_)manuf') THEN 2 ELSE 0 END")


@query("s1_places_scan", "SELECT id, name, category_primary, confidence FROM places_v")
def _(spark, d):
    return places(spark, d).select("id", "name", "category_primary", "confidence")


@query("s2_bbox_filter", "SELECT id, lon, lat FROM places_v WHERE lon > -170.01 AND lon < -99.99 AND lat > -85.01 AND lat < 0.01")
def _(spark, d):
    boxed = view(spark, d, "places_v").withColumn("bbox", F.struct(F.col("lon").alias("xmin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax")))
    return P.within_box(boxed, (-170.0, -85.0, -100.0, 0.0)).select("id", "lon", "lat")


@query("s2_clustered_boxes", "SELECT id, 1 AS box FROM places_v WHERE lon > -100.01 AND lon < -39.99 AND lat > -20.01 AND lat < 30.01 UNION ALL SELECT id, 2 FROM places_v WHERE lon > 10.24 AND lon < 12.76 AND lat > 9.99 AND lat < 20.01")
def _(spark, d):
    path = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/clustered-{uuid.uuid4().hex}"
    box = F.struct(F.col("lon").alias("xmin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax"))
    P.write_clustered(view(spark, d, "places_v").select("id", box.alias("bbox")), path)
    kind = "id LONG, bbox STRUCT<xmin: DOUBLE, xmax: DOUBLE, ymin: DOUBLE, ymax: DOUBLE>"
    parts = [P.read_box(spark, path, b, kind).select("id", F.lit(k).alias("box")) for k, b in ((1, (-100.0, -20.0, -40.0, 30.0)), (2, (10.25, 10.0, 12.75, 20.0)))]
    return parts[0].unionByName(parts[1])


@query("s3_country_extract", "SELECT id, name, upper(country) AS country FROM places_v WHERE upper(country) = 'NATION_11'")
def _(spark, d):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/places-{uuid.uuid4().hex}"
    v = places(spark, d)
    nested = v.select(
        F.col("id").cast("string").alias("id"), F.struct(F.col("name").alias("primary")).alias("names"), F.struct(F.col("category_primary").alias("primary"), "hierarchy", "alternates").alias("taxonomy"),
        *[F.when(F.col(f).isNotNull(), F.array(f)).alias(f"{f}s") for f in ("website", "phone", "email")], F.lit(None).cast("array<string>").alias("socials"),
        F.array(F.struct(F.lit(None).cast("string").alias("freeform"), F.col("city").alias("locality"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("postcode"), "country")).alias("addresses"),
        "confidence", "operating_status",
    )
    P.write_country_extract(nested, path, "2026-01-01")
    return P.read_country_extract(spark, path, COUNTRY).select(F.col("id").cast("long").alias("id"), "name", "country")


RELEASES = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') || '-01' AS release FROM orders"


def releases(spark, d):
    from orgatlas.plans.views import table

    return table(spark, d, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-01")).alias("release"))


@query("s4_newest_release", f"WITH r AS ({RELEASES}) SELECT o_orderkey, release FROM r WHERE release = (SELECT max(release) FROM r)")
def _(spark, d):
    return P.newest_release(releases(spark, d))


@query("s4_prunable_releases", f"WITH r AS ({RELEASES}) SELECT DISTINCT release FROM r WHERE release < (SELECT max(release) FROM r)")
def _(spark, d):
    return P.older_releases(releases(spark, d))


@query("c2_term_filter", r"""SELECT id, name FROM places_v WHERE (regexp_matches(name, '(?i)(^|[^\pL\pN])(machi)') OR regexp_matches(category_primary, '(?i)(^|[^\pL\pN])(machi)') OR regexp_matches(category_root, '(?i)(^|[^\pL\pN])(machi)'))
 AND (regexp_matches(name, '(?i)(^|[^\pL\pN])(manuf)') OR regexp_matches(category_primary, '(?i)(^|[^\pL\pN])(manuf)') OR regexp_matches(category_root, '(?i)(^|[^\pL\pN])(manuf)'))""")
def _(spark, d):
    return S.term_filter(places(spark, d), S.parse_industry("Machinery Manufacturing companies")).select("id", "name")


@query("c3_name_contains", "SELECT id, name FROM places_v WHERE contains(lower(name), 'furniture 1')")
def _(spark, d):
    return S.name_contains(places(spark, d), "Furniture 1").select("id", "name")


@query("c4_valid_places", f"SELECT id, country, operating_status FROM places_v WHERE {VALID.format(c='NATION_11')}")
def _(spark, d):
    return S.valid_places(places(spark, d), "nation_11").select("id", "country", "operating_status")


@query("c5_category_filter", "SELECT id, category_primary FROM places_v WHERE lower(replace(category_primary, '_', ' ')) = 'machinery store'")
def _(spark, d):
    return S.of_category(places(spark, d), "Machinery store").select("id", "category_primary")


@query("c6_relevance_tier", f"WITH {MAKERS} SELECT id, CAST(tier AS INTEGER) AS tier, CASE WHEN tier = 2 THEN 'related category' ELSE 'name only' END AS \"match\" FROM hits")
def _(spark, d):
    return S.scored_hits(places(spark, d), "manufacturing", "NATION_2").select("id", "tier", "match")


@query("c7_base_score", f"WITH {MACHINERY} SELECT id, round(score0, 6) AS score FROM hits")
def _(spark, d):
    return S.scored_hits(places(spark, d), INDUSTRY, COUNTRY).select("id", r6("score"))


@query("c8_sibling_fill", f"WITH {MACHINERY} SELECT id, website, phone, email FROM filled")
def _(spark, d):
    return S.fill_from_siblings(S.scored_hits(places(spark, d), INDUSTRY, COUNTRY)).select("id", "website", "phone", "email")


@query("c9_locations_per_site", f"WITH {MACHINERY} SELECT id, site, CAST(locations AS BIGINT) AS locations FROM located")
def _(spark, d):
    return S.count_locations(S.fill_from_siblings(S.scored_hits(places(spark, d), INDUSTRY, COUNTRY))).select("id", "site", F.col("locations").cast("long").alias("locations"))


@query("c10_score_bonus", f"WITH {MACHINERY} SELECT id, round(score1, 6) AS score FROM bonus")
def _(spark, d):
    return S.score_bonus(S.count_locations(S.fill_from_siblings(S.scored_hits(places(spark, d), INDUSTRY, COUNTRY)))).select("id", r6("score"))


@query("c11_sector_bonus", f"WITH {ALPHA} SELECT id, round(score, 6) AS score FROM scored")
def _(spark, d):
    hits = S.scored_hits(places(spark, d), "alpha", COUNTRY)
    return S.sector_bonus(S.score_bonus(S.count_locations(S.fill_from_siblings(hits)))).select("id", r6("score"))


@query("c12_rank", f"WITH {ALPHA} SELECT id, row_number() OVER (ORDER BY tier DESC, round(score, 9) DESC, id) AS place FROM companies ORDER BY 2 LIMIT 200")
def _(spark, d):
    best = S.top(S.ranked_companies(S.scored_hits(places(spark, d), "alpha", COUNTRY)), 200)  # bounded before it is numbered
    from pyspark.sql import Window

    return best.select("id", F.row_number().over(Window.orderBy(*S.rank_order())).cast("long").alias("place"))


@query("c13_one_row_per_company", f"WITH {ALPHA} SELECT id, site, name FROM companies")
def _(spark, d):
    return S.ranked_companies(S.scored_hits(places(spark, d), "alpha", COUNTRY)).select("id", "site", "name")


@query("c14_counts", f"WITH {MAKERS} SELECT count(*) AS matched, count(*) FILTER (tier >= 1) AS relevant FROM companies")
def _(spark, d):
    return S.counts(S.ranked_companies(S.scored_hits(places(spark, d), "manufacturing", "NATION_2")))


@query("c15_facets", f"WITH {MAKERS} SELECT replace(category_primary, '_', ' ') AS category, count(*) AS n FROM companies WHERE tier >= 1 OR (SELECT count(*) FILTER (tier >= 1) FROM companies) < 10 GROUP BY 1 ORDER BY n DESC, category LIMIT 15")
def _(spark, d):
    return S.facets(S.ranked_companies(S.scored_hits(places(spark, d), "manufacturing", "NATION_2")))


@query("c16_top_companies", f"WITH {MACHINERY} SELECT id, name, site, CAST(locations AS BIGINT) AS locations, CAST(tier AS INTEGER) AS tier, round(score, 6) AS score FROM companies ORDER BY tier DESC, round(companies.score, 9) DESC, id LIMIT 50")
def top_companies(spark, d, industry=INDUSTRY, country=COUNTRY):
    return S.company_search(places(spark, d), industry, country).select("id", "name", "site", F.col("locations").cast("long").alias("locations"), "tier", r6("score"))


def _many() -> str:
    parts = []
    for (query_id, _, _), ctes in zip(SEARCHES, (MACHINERY, MAKERS, ALPHA), strict=True):
        parts.append(f"SELECT * FROM (WITH {ctes} SELECT '{query_id}' AS query_id, id, row_number() OVER (ORDER BY tier DESC, round(score, 9) DESC, id) AS place FROM companies) WHERE place <= 20")
    return " UNION ALL ".join(parts)


@query("c17_many_searches", _many())
def _(spark, d):
    return S.company_search_many(places(spark, d), SEARCHES, 20).select("query_id", "id", F.col("place").cast("long").alias("place"))


@query("c1_parsed_terms", r"""WITH t AS (SELECT DISTINCT p_type || ' ' || p_name || 's, ' || upper(p_brand) || ' & the Textile Industries/softwares' AS industry FROM (SELECT p_type, p_name, split_part(p_brand, '#', 1) AS p_brand FROM part)),
w AS (SELECT industry, unnest(list_filter(list_transform(string_split_regex(lower(industry), '[\s,/;|]+'), lambda x: regexp_replace(x, '\W', '', 'g')), lambda x: len(x) >= 2 AND x NOT IN ('and', 'the', 'of', 'for', 'in', '&', 'companies', 'company', 'industry', 'industries', 'business', 'businesses'))) AS w,
 generate_subscripts(list_filter(list_transform(string_split_regex(lower(industry), '[\s,/;|]+'), lambda x: regexp_replace(x, '\W', '', 'g')), lambda x: len(x) >= 2 AND x NOT IN ('and', 'the', 'of', 'for', 'in', '&', 'companies', 'company', 'industry', 'industries', 'business', 'businesses')), 1) AS k FROM t)
SELECT industry, CAST(k AS BIGINT) AS k, CASE WHEN len(w) > 4 AND ends_with(w, 's') THEN w[:-2] ELSE w END AS word, CASE WHEN len(w) > 5 THEN w[1:5] WHEN len(w) = 5 THEN rtrim(w, 's') ELSE w END AS prefix,
 CASE w[1:5] WHEN 'texti' THEN 8 WHEN 'softw' THEN 3 ELSE 1 END AS alternatives FROM w""")
def _(spark, d):
    typed = F.concat("p_type", F.lit(" "), "p_name", F.lit("s, "), F.upper(F.substring_index("p_brand", "#", 1)), F.lit(" & the Textile Industries/softwares"))
    rows = table(spark, d, "part").select(typed.alias("industry")).distinct()
    parsed = rows.select("industry", F.posexplode(S.parse_terms(F.col("industry"))).alias("k", "t"))
    return parsed.select("industry", (F.col("k") + 1).cast("long").alias("k"), "t.word", "t.prefix", F.size("t.alternatives").alias("alternatives"))


def asked(spark, d):
    """A search for every market segment, with and without a kind of place, in every nation that customers have: hundreds of them."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name").distinct()
    kinds = F.explode(F.array(F.lit(""), F.lit(" store"), F.lit(" manufacturing"), F.lit(" delta")))
    return rows.select(F.lower("c_mktsegment").alias("segment"), "n_name", kinds.alias("kind")).select(F.concat("segment", "kind", F.lit(" in "), "n_name").alias("query_id"), F.concat("segment", "kind").alias("industry"), F.lower("n_name").alias("country"))


@query("c17_matched_searches", r"""WITH a AS (SELECT lower(c_mktsegment) || kind || ' in ' || n_name AS query_id, lower(c_mktsegment) AS segment, trim(kind) AS kind, n_name FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), (SELECT unnest(['', ' store', ' manufacturing', ' delta']) AS kind)),
t AS (SELECT id, country, list_filter(string_split_regex(lower(name || ' ' || category_primary || ' ' || category_root), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM places_v WHERE coalesce(operating_status, 'open') NOT IN ('closed', 'permanently_closed') AND name IS NOT NULL)
SELECT query_id, id FROM a JOIN t ON t.country = a.n_name WHERE len(list_filter(words, lambda x: starts_with(x, segment[1:5]))) > 0 AND (kind = '' OR len(list_filter(words, lambda x: starts_with(x, kind[1:5]))) > 0)""")
def _(spark, d):
    return S.search_hits(places(spark, d), asked(spark, d)).select("query_id", "id")


BOXES = "SELECT s_suppkey AS box_id, (s_suppkey * 37) % 360 - 180.0 AS x0, (s_suppkey * 53) % 180 - 90.0 AS y0, (s_suppkey * 37) % 360 - 180.0 + CAST(s_suppkey % 7 AS DOUBLE) * (s_suppkey % 5) AS x1, (s_suppkey * 53) % 180 - 90.0 + CAST(s_suppkey % 11 AS DOUBLE) AS y1 FROM supplier"


@query("c17_country_boxes", f"SELECT b.box_id, p.id FROM places_v p JOIN ({BOXES}) b ON p.lon BETWEEN b.x0 AND b.x1 AND p.lat BETWEEN b.y0 AND b.y1")
def _(spark, d):
    table(spark, d, "supplier").createOrReplaceTempView("supplier")
    boxes = spark.sql(BOXES).select("box_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return P.within_boxes(places(spark, d), boxes).select("box_id", "id")


@query("c15_facet_levels", r"""WITH a AS (SELECT lower(c_mktsegment) || ' in ' || n_name AS query_id, lower(c_mktsegment) AS segment, n_name FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)),
m AS (SELECT a.query_id, p.category_root, p.category_primary FROM a JOIN places_v p ON p.country = a.n_name WHERE coalesce(operating_status, 'open') NOT IN ('closed', 'permanently_closed') AND contains(lower(name || ' ' || category_primary), segment[1:5]))
SELECT query_id, category_root, category_primary, count(*) AS n FROM m GROUP BY GROUPING SETS ((query_id), (query_id, category_root), (query_id, category_root, category_primary))""")
def _(spark, d):
    hits = S.search_hits(places(spark, d), asked(spark, d).where(~F.col("query_id").rlike(" (store|manufacturing|delta) in ")))
    return S.facet_levels(hits.withColumns({"category_root": F.get("hierarchy", F.lit(0))}), ("category_root", "category_primary"))
