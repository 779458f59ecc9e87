"""Registered queries of registers, matching and gap filling (S6-S11, M1-M14), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orgatlas.functions.similarity import name_similarity
from orgatlas.operators import gapfill as G
from orgatlas.operators import registers as G2
from orgatlas.operators.retrieval import search_names
from orgatlas.plans.views import table, view, with_views
from orgatlas.sources.staging import staged

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def registry(spark, d):
    return view(spark, d, "registry_v").withColumn("record_id", F.col("company_number"))


def companies(spark, d):
    return view(spark, d, "companies_v")


def js(**fields):
    return F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in fields.items()]))


@query("s6_lei_records", """SELECT 'LEI' || company_number AS lei, name, CAST(company_number AS VARCHAR) AS company_number, jurisdiction_code, CASE WHEN inactive THEN 'Inactive' ELSE 'Active' END AS current_status, inactive,
 incorporation_date, 'Street 1, ' || city || ', GB' AS registered_address, 'Old ' || name AS previous_names, 'Alias ' || name AS other_names FROM registry_v""", "registry_v")
def _(spark, d):
    name = F.col("name")
    other = F.array(F.struct(F.concat(F.lit("Old "), name).alias("name"), F.lit("PREVIOUS_LEGAL_NAME").alias("type")), F.struct(F.concat(F.lit("Alias "), name).alias("name"), F.lit("TRADING_OR_OPERATING_NAME").alias("type")))
    entity = F.struct(
        F.struct(name.alias("name")).alias("legalName"), other.alias("otherNames"), F.struct(F.array(F.lit("Street 1")).alias("addressLines"), F.col("city").alias("city"), F.lit("GB").alias("country")).alias("legalAddress"),
        F.col("company_number").cast("string").alias("registeredAs"), F.upper(F.replace("jurisdiction_code", F.lit("_"), F.lit("-"))).alias("jurisdiction"), F.when(F.col("inactive"), "INACTIVE").otherwise("ACTIVE").alias("status"),
        F.concat("incorporation_date", F.lit("T00:00:00Z")).alias("creationDate"),
    )
    raw = view(spark, d, "registry_v").select(F.to_json(F.struct(F.concat(F.lit("LEI"), "company_number").alias("lei"), entity.alias("entity"))).alias("json"))
    found = G2.normalize_lei(raw)
    return found.select("lei", "name", "company_number", "jurisdiction_code", "current_status", "inactive", "incorporation_date", "registered_address", F.array_join("previous_names", ", ").alias("previous_names"), F.array_join("other_names", ", ").alias("other_names"))


@query("s7_uk_records", """SELECT name, CAST(company_number AS VARCHAR) AS company_number, CASE WHEN inactive THEN 'Voluntary Arrangement' ELSE 'Active' END AS current_status, inactive, '1 High Street, ' || city AS registered_address, '62012, 70229' AS industry_codes, incorporation_date FROM registry_v""", "registry_v")
def _(spark, d):
    raw = view(spark, d, "registry_v").select(
        js(company_name=F.col("name"), company_number=F.col("company_number").cast("string"), company_status=F.when(F.col("inactive"), "voluntary-arrangement").otherwise("active"), date_of_creation=F.col("incorporation_date"),
           registered_office_address=F.struct(F.lit("1 High Street").alias("address_line_1"), F.col("city").alias("locality")), sic_codes=F.array(F.lit("62012"), F.lit("70229"))).alias("json")
    )
    return G2.normalize_uk(raw).select("name", "company_number", "current_status", "inactive", "registered_address", F.array_join("industry_codes", ", ").alias("industry_codes"), "incorporation_date")


def global_raw(spark, d):
    k = F.col("company_number")
    officer = lambda name, position, ended: F.struct(F.struct(name.alias("name"), F.lit(position).alias("position"), F.lit("2001-02-03").alias("start_date"), ended.cast("string").alias("end_date")).alias("officer"))
    officers = F.array(officer(F.lit("DOE, JANE"), "director", F.lit(None)), officer(F.concat(F.lit("John Q"), k % 3), "secretary", F.when(k % 2 == 0, "2010-01-01")))
    codes = F.array(F.struct(F.struct(F.lit("62").alias("code"), F.lit("Software").alias("description")).alias("industry_code")))
    return view(spark, d, "registry_v").select(
        k.alias("company_number"),
        js(name=F.col("name"), company_number=k.cast("string"), jurisdiction_code=F.col("jurisdiction_code"), current_status=F.col("current_status"), inactive=F.col("inactive"), incorporation_date=F.col("incorporation_date"),
           registered_address=F.struct(F.lit("1 Road").alias("street_address"), F.col("city").alias("locality")), industry_codes=codes, previous_names=F.array(F.struct(F.lit("Old Co").alias("company_name"))),
           opencorporates_url=F.concat(F.lit("https://register.example/"), k), source=F.struct(F.lit("Publisher").alias("publisher")), officers=officers).alias("json"),
    )


@query("s8_global_records", "SELECT name, CAST(company_number AS VARCHAR) AS company_number, jurisdiction_code, current_status, inactive, '1 Road, ' || city AS registered_address, '62 Software' AS industry_codes, 'Old Co' AS previous_names, 'Publisher' AS source_publisher FROM registry_v", "registry_v")
def _(spark, d):
    found = G2.normalize_global(global_raw(spark, d))
    return found.select("name", "company_number", "jurisdiction_code", "current_status", "inactive", "registered_address", F.array_join("industry_codes", ", ").alias("industry_codes"), F.array_join("previous_names", ", ").alias("previous_names"), "source_publisher")


OFFICERS = "SELECT company_number, 0 AS pos, 'Jane Doe' AS name, 'director' AS position, TRUE AS current FROM registry_v UNION ALL SELECT company_number, 1, 'John Q' || company_number % 3, 'secretary', company_number % 2 <> 0 FROM registry_v"


@query("s9_officers", OFFICERS, "registry_v")
def _(spark, d):
    return G2.normalize_officers(global_raw(spark, d)).select("company_number", "pos", "name", "position", "current")


@query("s10_registry_union", """SELECT CAST(company_number AS VARCHAR) AS company_number, 'opencorporates' AS source, 'https://register.example/' || company_number AS record_url FROM registry_v
UNION ALL SELECT CAST(company_number AS VARCHAR), 'companieshouse', 'https://find-and-update.company-information.service.gov.uk/company/' || company_number FROM registry_v""", "registry_v")
def _(spark, d):
    uk = view(spark, d, "registry_v").select(js(company_name=F.col("name"), company_number=F.col("company_number").cast("string")).alias("json"))
    return G2.union_registries(opencorporates=G2.normalize_global(global_raw(spark, d)), companieshouse=G2.normalize_uk(uk)).select("company_number", "source", "record_url")


def osm_places(spark, d):
    k = F.col("id")
    tags = F.map_from_arrays(F.array(F.lit("contact:website"), F.when(k % 2 == 0, "phone").otherwise("mobile"), F.lit("email")), F.array(F.concat(F.lit("https://osm/"), k, F.lit("; https://b")), F.concat(F.lit("+1 "), k), F.when(k % 3 == 0, "").otherwise("o@osm.example")))
    return view(spark, d, "places_v").where("id % 2 = 0 or id % 5 = 0").select("name", "country", tags.alias("tags"), k.alias("ord"))


OSM = "SELECT name, country, id AS ord, 'https://osm/' || id AS website, '+1 ' || id AS phone, CASE WHEN id % 3 <> 0 THEN 'o@osm.example' END AS email FROM places_v WHERE id % 2 = 0 OR id % 5 = 0"


@query("s11_map_tags", OSM, "places_v")
def _(spark, d):
    return G.map_fields(osm_places(spark, d))


@query("m1_name_similarity")
def _(spark, d):
    names = companies(spark, d).select("company_id", F.col("name").alias("a")).join(view(spark, d, "registry_v").select(F.col("company_number").alias("company_id"), F.col("name").alias("b")), "company_id")
    return names.select("company_id", "a", "b", name_similarity(F.col("a"), F.col("b")).alias("similarity"))


KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '\b(private|pvt|limited|ltd|llc|l\.l\.c|inc|incorporated|corp|corporation|co|company|plc|gmbh|ag|sa|s\.a|bv|b\.v|nv|pty|pte|llp|lp|smc|fze|fzco|fz-llc)\b\.?', ' ', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


RANKED = """, w AS (SELECT record_id, scope, list_sort(list_distinct(list_filter(string_split(k, ' '), lambda x: x <> ''))) AS tokens FROM (SELECT *, {key} AS k FROM r)),
q AS (SELECT company_id, scope, list_sort(list_distinct(list_filter(string_split(k, ' '), lambda x: x <> ''))) AS tokens FROM (SELECT *, {key} AS k FROM c)),
n AS (SELECT token, ln(1 + (SELECT count(DISTINCT record_id) FROM w) / count(DISTINCT record_id)) AS weight FROM (SELECT record_id, unnest(tokens) AS token FROM w) GROUP BY token),
rt AS (SELECT record_id, scope, token, weight FROM (SELECT record_id, scope, unnest(tokens) AS token FROM w) JOIN n USING (token)), qt AS (SELECT company_id, scope, token, weight FROM (SELECT company_id, scope, unnest(tokens) AS token FROM q) JOIN n USING (token)),
rn AS (SELECT record_id, scope, round(sqrt(sum(weight * weight)), 9) AS norm FROM rt GROUP BY ALL), qn AS (SELECT company_id, scope, sqrt(sum(weight * weight)) AS norm FROM qt GROUP BY ALL),
p AS (SELECT company_id, scope, record_id, sum(qt.weight * qt.weight) AS product, count(*) AS shared FROM qt JOIN rt USING (scope, token) GROUP BY ALL),
s AS (SELECT company_id, scope, record_id, shared, round(product / (qn.norm * rn.norm), 9) AS score FROM p JOIN qn USING (company_id, scope) JOIN rn USING (record_id, scope)),
o AS (SELECT *, row_number() OVER (PARTITION BY company_id, scope ORDER BY score DESC, record_id) AS ord FROM s)"""


def ranked_sql(records: str, companies: str, last: str, key: str) -> str:
    """All pairs that share a word, scored and ranked. Both selections: id, scope, name."""
    return f"WITH r AS ({records}), c AS ({companies})" + RANKED.replace("{key}", key) + last


BOTH = "SELECT {id}, name, unnest(['', {country}]) AS scope FROM {table}"
REGISTER_ROWS = BOTH.format(id="company_number AS record_id", country="substr(jurisdiction_code, 1, 2)", table="registry_v")


@query("m2_candidates", rf"""WITH a AS (SELECT company_id, unnest(string_split({KEY}, ' ')) AS w FROM companies_v), b AS (SELECT company_number AS record_id, unnest(string_split({KEY}, ' ')) AS w FROM registry_v),
c AS (SELECT w FROM b GROUP BY w HAVING count(*) <= 4), s AS (SELECT company_id, record_id, count(DISTINCT w) AS shared FROM (SELECT DISTINCT * FROM a WHERE w IN (SELECT w FROM c)) JOIN (SELECT DISTINCT * FROM b) USING (w) GROUP BY ALL),
f AS (SELECT company_id, record_id, shared FROM s)
SELECT company_id, record_id, shared FROM f""", "companies_v", "registry_v")
def _(spark, d):
    # every name is one frequent word and a number: the word alone is too small a part of a name
    return G2.candidates(companies(spark, d), registry(spark, d), max_token_freq=4).select("company_id", "record_id", "shared")


def skewed_records(spark, d):
    """Register names of few, frequent words: parts, their type and, for one in nine, a word of their own."""
    k = F.col("p_partkey")
    own = F.when(k % 9 == 0, F.concat(F.lit(" unit"), F.floor(k / 27).cast("string"))).otherwise("")
    return table(spark, d, "part").select(k.alias("record_id"), F.concat("p_name", F.lit(" "), F.lower("p_type"), own).alias("name"), F.when(k % 3 == 0, "gb").otherwise("us").alias("country"))


def skewed_firms(spark, d):
    """One in thirty of those records, with its words turned round and one more or one less."""
    k = F.col("record_id")
    turned = F.array_join(F.reverse(F.split("name", " ")), " ")
    changed = F.when(k % 2 == 0, F.concat(turned, F.lit(" steel"))).otherwise(F.regexp_replace(turned, r"^\w+ ", ""))
    return skewed_records(spark, d).where("record_id % 30 = 0 or record_id % 30 = 1").select(k.alias("company_id"), changed.alias("name"), F.when(k % 4 == 0, "gb").otherwise("us").alias("country"))


SKEWED = "SELECT p_partkey AS id, p_name || ' ' || lower(p_type) || CASE WHEN p_partkey % 9 = 0 THEN ' unit' || CAST(p_partkey // 27 AS VARCHAR) ELSE '' END AS name FROM part"
SKEWED_RECORDS = f"SELECT id AS record_id, name, unnest(['', CASE WHEN id % 3 = 0 THEN 'gb' ELSE 'us' END]) AS scope FROM ({SKEWED})"
SKEWED_FIRMS = rf"""SELECT id AS company_id, CASE WHEN id % 2 = 0 THEN t || ' steel' ELSE regexp_replace(t, '^\w+ ', '') END AS name, unnest(['', CASE WHEN id % 4 = 0 THEN 'gb' ELSE 'us' END]) AS scope
 FROM (SELECT id, array_to_string(list_reverse(string_split(name, ' ')), ' ') AS t FROM ({SKEWED}) WHERE id % 30 < 2)"""


@query("m2_register_names", ranked_sql(BOTH.format(id="company_number AS record_id", country="substr(jurisdiction_code, 1, 2)", table="registry_v"), BOTH.format(id="company_id", country="country", table="companies_v"),
 " SELECT company_id, record_id, max(shared) AS shared FROM o WHERE ord <= 10 GROUP BY ALL", KEY), "companies_v", "registry_v")
def _(spark, d):
    # whole lists: with so few names the frequent word's records fill up the ten, in the order of their ids
    found = search_names(companies(spark, d), registry(spark, d).withColumn("country", F.substring("jurisdiction_code", 1, 2)))
    return found.groupBy("company_id", "record_id").agg(F.max("shared").cast("long").alias("shared"))


@query("m2_ranked_names", ranked_sql(SKEWED_RECORDS, SKEWED_FIRMS, " SELECT company_id, scope, CAST(ord AS BIGINT) AS ord, score FROM o WHERE ord <= 10", KEY))
def _(spark, d):
    # every word is frequent: what is read is bounded by block maxima; equal scores may belong to other records
    return search_names(skewed_firms(spark, d), skewed_records(spark, d), many=100).select("company_id", "scope", F.col("ord").cast("long").alias("ord"), "score")


@query("m3_global_matches", """SELECT company_id, company_id AS record_id, CAST(CASE WHEN company_id % 5 = 0 THEN 0.9 ELSE 1.0 END AS DOUBLE) AS match_confidence FROM companies_v""", "companies_v")
def _(spark, d):
    return G2.match_register(companies(spark, d), registry(spark, d), 4).select("company_id", "record_id", "match_confidence")


def unequal(spark, d):
    """(companies, register) whose names differ by up to three words at the end, so that their ratio follows from their lengths."""
    own = F.concat(F.lit("x"), F.substring(F.md5(F.col("company_number").cast("string")), 1, 15))
    more = F.get(F.array(*map(F.lit, ("", " Works", " Trading House Limited", " International of the East", " Overseas Holding and Finance Society"))), (F.col("company_number") % 5).cast("int"))
    rows = registry(spark, d).withColumn("inactive", F.col("company_number") % 7 == 0).withColumn("current_status", F.lit("Active")).withColumn("name", F.initcap(F.concat(own, more)))
    firms = rows.select(F.col("company_number").alias("company_id"), F.concat(F.upper(own), F.lit(" Ltd")).alias("name"), F.when(F.col("company_number") % 3 == 0, "gb").otherwise("us").alias("country"), F.lit("none.example").alias("domain"))
    return firms, rows


UNEQUAL = """WITH u AS (SELECT company_number AS id, jurisdiction_code, CASE WHEN company_number % 3 = 0 THEN 'gb' ELSE 'us' END AS country, company_number % 7 = 0 AS inactive,
 16 AS a, 16 + (['', ' works', ' trading house', ' international of the east', ' overseas holding and finance society'])[company_number % 5 + 1].length() AS b FROM registry_v),
s AS (SELECT *, round(CASE WHEN a = b THEN 1.0 ELSE round(2.0 * a / (a + b), 3) END - CASE WHEN inactive THEN 0.15 ELSE 0 END + CASE WHEN starts_with(jurisdiction_code, country) THEN 0.05 ELSE 0 END, 6) AS score FROM u)
SELECT id AS company_id, id AS record_id, CAST(round(least(1.0, score), 2) AS DOUBLE) AS match_confidence FROM s WHERE score >= 0.6"""


@query("m3_unequal_names", UNEQUAL, "registry_v")
def _(spark, d):
    return G2.match_register(*unequal(spark, d)).select("company_id", "record_id", "match_confidence")


@query("m4_lei_matches")
def _(spark, d):
    names = registry(spark, d).withColumns({"other_names": F.array(F.concat(F.lit("Alias "), "name")), "previous_names": F.array(F.concat(F.lit("Supplier "), "company_number"))})
    return G2.match_register(companies(spark, d), names, other_names=True).select("company_id", "record_id", "record_name", "match_confidence")


@query("m5_uk_matches", "SELECT company_id, company_id AS record_id, CAST(CASE WHEN company_id % 5 = 0 THEN 0.9 ELSE 1.0 END AS DOUBLE) AS match_confidence FROM companies_v WHERE country = 'gb'", "companies_v")
def _(spark, d):
    return G2.match_uk(companies(spark, d), registry(spark, d), 4).select("company_id", "record_id", "match_confidence")


@query("m5_unequal_names", UNEQUAL + " AND country = 'gb' AND jurisdiction_code = 'gb'", "registry_v")
def _(spark, d):
    return G2.match_uk(*unequal(spark, d)).select("company_id", "record_id", "match_confidence")


@query("m6_source_priority", "SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 3 = 0 THEN 'companieshouse' WHEN s_suppkey % 2 = 0 THEN 'opencorporates' ELSE 'gleif' END AS source FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("company_id"), k.alias("record_id"), F.lit(1.0).alias("match_confidence"))
    return G2.match_registries(gleif=rows, opencorporates=rows.where("company_id % 2 = 0"), companieshouse=rows.where("company_id % 3 = 0")).select("company_id", "source")


@query("m7_registry_search", "SELECT name, company_number FROM registry_v WHERE contains(lower(name), 'supplier') AND lower(jurisdiction_code) = 'gb' AND incorporation_date >= '1970-01-01' AND NOT inactive ORDER BY name, company_number LIMIT 10 OFFSET 10", "registry_v")
def _(spark, d):
    rows, _totals = G2.search_registry(view(spark, d, "registry_v"), 2, 10, name="Supplier", jurisdiction_code="gb", incorporated_from="1970-01-01", exclude_inactive=True)
    return rows.select("name", "company_number")


@query("m7_registry_totals", "SELECT count(*) AS total_count, CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages FROM registry_v WHERE NOT inactive", "registry_v")
def _(spark, d):
    return G2.search_registry(view(spark, d, "registry_v"), 1, 10, exclude_inactive=True)[1]


@query("m8_with_officers", f"WITH o AS ({OFFICERS}) SELECT r.company_number, r.name, string_agg(o.name, '|' ORDER BY pos) AS officers FROM registry_v r LEFT JOIN o ON o.company_number = r.company_number GROUP BY ALL", "registry_v")
def _(spark, d):
    both = G2.with_officers(view(spark, d, "registry_v"), G2.normalize_officers(global_raw(spark, d)))
    return both.select("company_number", "name", F.array_join(F.transform("officers", lambda o: o["name"]), "|").alias("officers"))


@query("m9_officer_search", f"WITH o AS ({OFFICERS}) SELECT company_number, name FROM o WHERE contains(lower(name), 'john') AND current ORDER BY name, company_number, pos LIMIT 30", "registry_v")
def _(spark, d):
    return G2.search_officers(G2.normalize_officers(global_raw(spark, d)), "John", current_only=True).select("company_number", "name")


def listing(spark, d):
    return view(spark, d, "places_v").withColumnRenamed("id", "company_id")


@query("m10_map_fill", rf"""WITH o AS ({OSM}), k AS (SELECT *, regexp_replace(regexp_replace(lower(name), '\b(limited|ltd|\(?pvt\)?|private|inc|corporation|corp|co|company|group|plc|llc|the)\b\.?', ' ', 'g'), '[^a-z0-9]', '', 'g') AS key FROM places_v),
m AS (SELECT *, regexp_replace(regexp_replace(lower(name), '\b(limited|ltd|\(?pvt\)?|private|inc|corporation|corp|co|company|group|plc|llc|the)\b\.?', ' ', 'g'), '[^a-z0-9]', '', 'g') AS key FROM o),
f AS (SELECT k.id, arg_min(m.website, m.ord) AS w, arg_min(m.phone, m.ord) AS p, arg_min(m.email, m.ord) FILTER (m.email IS NOT NULL) AS e FROM k JOIN m ON m.key = k.key AND m.country = k.country WHERE length(k.key) >= 4 AND (k.website IS NULL OR k.phone IS NULL OR k.email IS NULL) GROUP BY k.id)
SELECT id AS company_id, coalesce(website, w) AS website, coalesce(phone, p) AS phone, coalesce(email, e) AS email FROM places_v LEFT JOIN f USING (id)""", "places_v")
def _(spark, d):
    return G.osm_fill(listing(spark, d), osm_places(spark, d), loose=False).select("company_id", *G.FIELDS)


@query("m10_map_fill_alike")
def _(spark, d):
    return G.osm_fill(listing(spark, d), osm_places(spark, d)).select("company_id", *G.FIELDS, F.to_json("filled_from").alias("filled_from"))


def alike_names(spark, d):
    """(companies, places): twenty letters, and the same with up to six letters more or four less. No letter stands twice in a name: the ratio of a name with
    repeated ones may come from a longest common piece that leaves less beside it, and then doesn't follow from the lengths."""
    k = F.col("s_suppkey")
    mixed = F.sort_array(F.transform(F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxy")), lambda c: F.struct(F.md5(F.concat(k.cast("string"), c)).alias("at"), c.alias("letter"))))
    rows = staged(table(spark, d, "supplier").select(k, F.array_join(F.slice(F.transform(mixed, lambda x: x["letter"]), 1, 20), "").alias("own")))
    own = F.col("own")
    spread = lambda parts: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), parts), "")
    more = spread(lambda i: F.concat(F.substring(own, i * 3 + 1, F.when(i == 6, 2).otherwise(3)), F.when(i < k % 7, "z").otherwise("")))
    less = spread(lambda i: F.substring(own, i * 3 + 1, F.when(i == 6, 2).when(i < k % 5, 2).otherwise(3)))
    places = rows.select(F.when(k % 2 == 0, more).otherwise(less).alias("name"), F.lit("GB").alias("country"), F.create_map(F.lit("website"), F.concat(F.lit("https://w"), k)).alias("tags"), k.alias("ord"))
    return rows.select(k.alias("company_id"), own.alias("name"), F.lit("gb").alias("country")), places


@query("m10_alike_names", """SELECT s_suppkey AS company_id, s_suppkey AS ord FROM supplier
WHERE CASE WHEN s_suppkey % 2 = 0 THEN 40.0 / (40 + s_suppkey % 7) ELSE 2.0 * (20 - s_suppkey % 5) / (40 - s_suppkey % 5) END >= 0.9""")
def _(spark, d):
    return G.osm_matches(*alike_names(spark, d)).select("company_id", "ord")


@query("m10_candidates_met")
def _(spark, d):
    """How many names each map name is compared with, by the way that they met."""
    own, theirs = G.keys_of(listing(spark, d), osm_places(spark, d))
    return G.alike_candidates(own, theirs).groupBy("country", "_key", "way").agg(F.count("*").alias("compared"))


@query("m11_guarded_fill", """SELECT id AS company_id, coalesce(website, CASE WHEN id % 2 = 0 THEN 'https://fill/' || id END) AS website, phone, CASE WHEN website IS NULL AND id % 2 = 0 THEN 'map' END AS website_from FROM places_v""", "places_v")
def _(spark, d):
    rows = listing(spark, d)
    extra = rows.where("company_id % 2 = 0").select("company_id", F.concat(F.lit("https://fill/"), "company_id").alias("website"))
    return G.fill(rows, extra, ("website",), "map").select("company_id", "website", "phone", F.try_element_at("filled_from", F.lit("website")).alias("website_from"))


@query("m12_register_fill", """SELECT c.s_suppkey AS company_id, CASE WHEN s_suppkey % 4 = 0 THEN 'own' WHEN s_suppkey % 3 <> 0 THEN r.city END AS registered_address, CASE WHEN s_suppkey % 3 <> 0 THEN r.name END AS register_name FROM supplier c LEFT JOIN registry_v r ON r.company_number = c.s_suppkey""", "registry_v")
def _(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("company_id"), F.when(k % 4 == 0, "own").alias("registered_address"))
    matches = view(spark, d, "registry_v").where("company_number % 3 <> 0").select(F.col("company_number").alias("company_id"), F.col("city").alias("registered_address"), "name", "company_number", "current_status", F.lit("gleif").alias("source"), F.lit(1.0).alias("match_confidence"))
    return G.register_fill(rows, matches).select("company_id", "registered_address", "register_name")


def merged(spark, d):
    k = F.col("company_id")
    rows = listing(spark, d)
    mail = F.array(F.struct(F.concat(F.lit("x"), k).alias("email"), F.lit(False).alias("on_company_domain")), F.struct(F.concat(F.lit("own"), k).alias("email"), F.lit(True).alias("on_company_domain")))
    phone = F.array(F.struct(F.concat(F.lit("0"), k).alias("raw"), F.when(k % 3 == 0, F.concat(F.lit("+1"), k)).alias("e164"), (k % 3 == 0).alias("valid")))
    rows = rows.withColumns({
        "emails": F.when(k % 2 == 0, mail).otherwise(F.slice(mail, 1, 0)), "phones": F.when(k % 4 == 0, phone).otherwise(F.slice(phone, 1, 0)), "people": F.when(k % 6 == 0, F.array(F.struct(F.lit("Ann Lee").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>")),
        "social": F.when(k % 2 == 0, F.create_map(F.lit("linkedin"), F.lit("https://linkedin.com/own"))).otherwise(F.create_map().cast("map<string,string>")), "socials": F.array(F.concat(F.lit("https://facebook.com/"), k), F.lit("https://linkedin.com/listed")),
        "filled_from": F.when(k % 5 == 0, F.create_map(F.lit("website"), F.lit("sibling listing"))).otherwise(F.create_map().cast("map<string,string>")),
    })
    return G.merge_best(rows)


@query("m13_merge_best", """WITH m AS (SELECT id, website, CASE WHEN website IS NOT NULL THEN CASE WHEN id % 5 = 0 THEN 'sibling listing' ELSE 'listing' END END AS website_source, CASE WHEN id % 2 = 0 THEN 'own' || id ELSE email END AS email,
 CASE WHEN id % 2 = 0 THEN 'website' WHEN email IS NOT NULL THEN 'listing' END AS email_source, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 3 = 0 THEN '+1' || id ELSE '0' || id END ELSE phone END AS phone, CASE WHEN id % 6 = 0 THEN 'Ann Lee' END AS person, CASE WHEN id % 2 = 0 THEN 'https://linkedin.com/own' ELSE 'https://linkedin.com/listed' END AS linkedin FROM places_v)
SELECT id AS company_id, website, website_source, email, email_source, phone, person, linkedin, 'https://facebook.com/' || id AS facebook,
 array_to_string(list_filter([CASE WHEN website IS NULL THEN 'website' END, CASE WHEN email IS NULL THEN 'email' END, CASE WHEN phone IS NULL THEN 'phone' END, CASE WHEN person IS NULL THEN 'contact_person' END], lambda x: x IS NOT NULL), ',') AS missing FROM m""", "places_v")
def _(spark, d):
    best = lambda k: F.try_element_at("best", F.lit(k))
    source = lambda k: F.try_element_at("best_source", F.lit(k))
    return merged(spark, d).select("company_id", best("website").alias("website"), source("website").alias("website_source"), best("email").alias("email"), source("email").alias("email_source"), best("phone").alias("phone"), best("contact_person").alias("person"), best("social_linkedin").alias("linkedin"), best("social_facebook").alias("facebook"), F.array_join("missing", ",").alias("missing"))


@query("m14_alternate_address", """WITH c AS (SELECT s_suppkey AS company_id, 'http://www.h' || s_suppkey || '.example.com/x' AS website FROM supplier), t AS (SELECT company_id, unnest([0, 1, 2, 3]) AS tried, unnest(['http://www.h' || company_id, 'https://www.h' || company_id, 'https://h' || company_id, 'http://h' || company_id]) || '.example.com' AS url FROM c),
l AS (SELECT DISTINCT (['http://www.h', 'https://h', 'http://h'])[s_suppkey % 3 + 1] || s_suppkey || '.example.com' AS url, CASE WHEN s_suppkey % 4 = 0 THEN 500 ELSE 200 END AS status FROM supplier)
SELECT company_id, t.url, tried FROM t JOIN l ON l.url = t.url AND status = 200""")
def _(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier")
    firms = rows.select(k.alias("company_id"), F.concat(F.lit("http://www.h"), k, F.lit(".example.com/x")).alias("website"))
    start = F.get(F.array(F.lit("http://www.h"), F.lit("https://h"), F.lit("http://h")), (k % 3).cast("int"))
    log = rows.select(F.concat(start, k, F.lit(".example.com/page")).alias("url"), F.when(k % 4 == 0, 500).otherwise(200).alias("status"))
    return G.pick_alternate(firms, log).select("company_id", "url", "tried")
