"""Entities that the given tables do not hold, derived from them by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from orgatlas.sources.staging import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS = {
    "places_v": """
SELECT c_custkey AS id,
 concat(CASE c_custkey % 5 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' WHEN 2 THEN 'Gamma' WHEN 3 THEN 'Delta' ELSE 'Omega' END,
        ' ', c_mktsegment, ' ', CAST(c_custkey % 37 AS STRING),
        CASE c_custkey % 3 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Group' ELSE '' END) AS name,
 concat(lower(c_mktsegment), CASE c_custkey % 4 WHEN 0 THEN '_manufacturer' WHEN 1 THEN '_store' ELSE '_service' END) AS category_primary,
 CASE c_custkey % 4 WHEN 0 THEN 'manufacturing' WHEN 1 THEN 'shopping' ELSE 'services' END AS category_root,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('https://www.co', CAST(c_custkey % 211 AS STRING), '.example.com/careers') END AS website,
 CASE WHEN c_custkey % 4 = 1 THEN concat('info@co', CAST(c_custkey % 211 AS STRING), '.example.com') END AS email,
 CASE WHEN c_custkey % 5 < 2 THEN concat('+92 21 ', CAST(3000000 + c_custkey AS STRING)) END AS phone,
 n_name AS country, concat('City', CAST(c_custkey % 7 AS STRING)) AS city,
 CAST(c_custkey % 100 AS DOUBLE) / 100 AS confidence,
 CASE c_custkey % 23 WHEN 0 THEN 'closed' WHEN 1 THEN 'permanently_closed' WHEN 2 THEN NULL ELSE 'open' END AS operating_status,
 CAST(c_custkey % 360 AS DOUBLE) - 180 AS lon, CAST(c_custkey % 180 AS DOUBLE) - 90 AS lat
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "registry_v": """
SELECT s_suppkey AS company_number,
 concat(upper(replace(s_name, '#', ' ')), CASE s_suppkey % 3 WHEN 0 THEN ' LIMITED' WHEN 1 THEN ' (PVT) LTD' ELSE ' INC' END) AS name,
 CASE s_suppkey % 2 WHEN 0 THEN 'gb' ELSE 'us_de' END AS jurisdiction_code,
 CASE s_suppkey % 5 WHEN 0 THEN 'Dissolved' ELSE 'Active' END AS current_status,
 s_suppkey % 5 = 0 AS inactive, n_name AS city,
 concat(CAST(1960 + s_suppkey % 60 AS STRING), '-0', CAST(1 + s_suppkey % 9 AS STRING), '-15') AS incorporation_date
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "companies_v": """
SELECT s_suppkey AS company_id, concat(replace(s_name, '#', ' '), CASE s_suppkey % 4 WHEN 0 THEN ' Ltd' ELSE '' END) AS name,
 CASE s_suppkey % 2 WHEN 0 THEN 'gb' ELSE 'us' END AS country, concat('supplier', CAST(s_suppkey AS STRING), '.example.com') AS domain
FROM supplier""",
    "evidence_v": """
SELECT l_orderkey AS company_id, CASE l_returnflag WHEN 'A' THEN 'phone' WHEN 'N' THEN 'business_email' ELSE 'locations' END AS field,
 CAST(l_partkey AS STRING) AS value, 1.0 - l_discount AS confidence, l_linestatus AS source_type, concat('https://s/', CAST(l_suppkey AS STRING)) AS source_url,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord
FROM lineitem""",
    "page_log_v": """
SELECT user_id AS job_id, concat('https://site', CAST(user_id AS STRING), '.example.com/p', CAST(event_id % 17 AS STRING)) AS url, ts,
 CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 403 ELSE 200 END AS status,
 CASE event_type WHEN 'signup' THEN 'blocked' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'robots' ELSE '' END ELSE '' END AS challenge,
 CASE event_type WHEN 'error' THEN 'timed out' WHEN 'signup' THEN 'blocked' ELSE '' END AS error
FROM events""",
    "history_v": """
SELECT concat('job', CAST(user_id AS STRING)) AS id, ts AS created_at, event_id AS version,
 CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM events""",
    "dns_v": """
SELECT concat('supplier', CAST(s_suppkey AS STRING), '.example.com') AS domain, 'MX' AS rtype,
 CASE s_suppkey % 4 WHEN 0 THEN '10 aspmx.l.google.com.' WHEN 1 THEN '0 x.mail.protection.outlook.com.' ELSE '5 mx.own.example.com.' END AS data FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT concat('supplier', CAST(s_suppkey AS STRING), '.example.com'), 'TXT',
 CASE s_suppkey % 2 WHEN 0 THEN 'v=spf1 include:_spf.google.com include:sendgrid.net ~all' ELSE 'ms-site-verification=x1' END FROM supplier
UNION ALL SELECT concat('supplier', CAST(s_suppkey AS STRING), '.example.com'), 'DMARC',
 concat('v=DMARC1; p=', CASE s_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'reject' ELSE 'quarantine' END) FROM supplier WHERE s_suppkey % 5 <> 0""",
    "people_v": """
SELECT c_custkey % 200 AS company_id, concat('First', CAST(c_custkey % 13 AS STRING)) AS first_name, concat('Last', CAST(c_custkey % 11 AS STRING)) AS last_name,
 CASE c_custkey % 6 WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'Sales Director' WHEN 2 THEN 'Founder' ELSE 'Engineer' END AS title,
 CASE c_custkey % 5 WHEN 0 THEN 'mentioned (possibly a client)' WHEN 1 THEN 'team' ELSE 'website' END AS context, c_custkey AS ord FROM customer""",
    "emails_v": """
SELECT c_custkey % 200 AS company_id, CASE c_custkey % 3
  WHEN 0 THEN concat('first', CAST(c_custkey % 13 AS STRING), '.last', CAST(c_custkey % 11 AS STRING)) WHEN 1 THEN 'info' ELSE concat('first', CAST(c_custkey % 13 AS STRING)) END AS local,
 CASE c_custkey % 10 WHEN 9 THEN 'gmail.com' ELSE concat('co', CAST(c_custkey % 200 AS STRING), '.example.com') END AS email_domain, c_custkey AS ord FROM customer""",
    "links_v": """
SELECT page_id AS src_id, (page_id * 7 + 1) % 250 AS dst_id, 'about' AS category, 0.95 AS score FROM pages
UNION ALL SELECT page_id, (page_id * 3 + 2) % 250, 'team', 0.90 FROM pages UNION ALL SELECT page_id, page_id + 1, 'other', 0.20 FROM pages""",
    "robots_v": """
SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, '/en' AS path_prefix, FALSE AS allow FROM pages
UNION ALL SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]+)', 1), '/en/4', TRUE FROM pages""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of pages or documents: work per row is heavy, so a small one is dealt out to all cores."""
    return spread(table(spark, sf_dir, name))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived entity as a DataFrame."""
    for t in TABLES:
        if f" {t}" in VIEWS[name]:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """DuckDB text in which the named views can be used."""
    start = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {start[1] or ''}{views}, {sql[start.end():]}" if start else f"WITH {views} {sql}"
