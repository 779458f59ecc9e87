"""Registered queries of saved runs, exports and streams (S12-S17, P22, ST1-ST4), with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orgatlas.operators import history as H
from orgatlas.operators.summary import summary_row
from orgatlas.plans.register_queries import merged
from orgatlas.plans.views import table, view, with_views
from orgatlas.sources import sinks
from orgatlas.sources.html import parse_pages
from orgatlas.sources.staging import staged
from orgatlas.streaming import jobs
from orgatlas.streaming.state import admitted, close_quiet_runs, stateful_session

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/out-{uuid.uuid4().hex}"


@query("s12_csv_sink", "SELECT CAST(id AS VARCHAR) AS id, name, website, CAST(confidence AS VARCHAR) AS confidence FROM places_v WHERE name IS NOT NULL", "places_v")
def _(spark, d):
    path = folder(spark)
    rows = view(spark, d, "places_v").select("id", "name", "website", "confidence", F.lit(None).cast("string").alias("crawl_error"))
    sinks.write_csv(rows, path)
    return spark.read.option("header", True).option("escape", '"').csv(path).select("id", "name", "website", "confidence")


@query("s13_json_sink", "SELECT id, name, category_root || ',' || category_primary AS hierarchy FROM places_v", "places_v")
def _(spark, d):
    path = folder(spark)
    sinks.write_json(view(spark, d, "places_v").select("id", "name", F.array("category_root", "category_primary").alias("hierarchy")), path)
    return spark.read.schema("id long, name string, hierarchy array<string>").json(path).select("id", "name", F.array_join("hierarchy", ",").alias("hierarchy"))


@query("s14_sources_sheet", "SELECT DISTINCT CASE WHEN o_orderstatus = 'O' THEN 'overture' WHEN o_orderstatus = 'F' THEN 'gleif' ELSE 'other' END AS source, CASE WHEN o_orderstatus = 'O' THEN 'Open places: CDLA Permissive 2.0' WHEN o_orderstatus = 'F' THEN 'LEI data: CC0 (no restrictions)' END AS licence FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "overture").when(F.col("o_orderstatus") == "F", "gleif").otherwise("other").alias("source"))
    return sinks.sources_sheet(rows)


LATEST = "l AS (SELECT id, arg_max(created_at, version) AS created_at, max(version) AS version, arg_max(status, version) AS status FROM history_v GROUP BY id)"


@query("s15_history_upsert", f"WITH {LATEST} SELECT id, version, status FROM l", "history_v")
def _(spark, d):
    return H.latest_by_key(view(spark, d, "history_v"), "id", "version").select("id", "version", "status")


@query("s15_history_get", f"WITH {LATEST} SELECT id, version, status FROM l WHERE id = (SELECT max(id) FROM history_v)", "history_v")
def _(spark, d):
    rows = view(spark, d, "history_v")
    return H.by_id(rows, rows.agg(F.max("id")).first()[0], "id", "version").select("id", "version", "status")


@query("s15_kept_history", f"WITH {LATEST} SELECT id, version, status FROM l WHERE CAST(substr(id, 4) AS BIGINT) % 5 <> 0", "history_v")
def _(spark, d):
    """Two merges, the older half of the versions last, and a delete."""
    path, rows = folder(spark), view(spark, d, "history_v")
    columns = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    H.merge_into(rows.where("version % 2 = 1"), path)
    H.merge_into(rows.where("version % 2 = 0"), path)
    H.delete_from(spark, path, columns, rows.where(F.substring("id", 4, 20).cast("long") % 5 == 0))
    return H.read_kept(spark, path, columns).select("id", "version", "status")


@query("s15_history_recent", f"WITH {LATEST} SELECT id, version FROM l ORDER BY created_at DESC, id LIMIT 30", "history_v")
def _(spark, d):
    return H.recent(H.latest_by_key(view(spark, d, "history_v"), "id", "version"), "created_at", "id").select("id", "version")


@query("s15_history_delete", f"WITH {LATEST} SELECT id FROM l WHERE CAST(substr(id, 4) AS BIGINT) % 3 <> 0", "history_v")
def _(spark, d):
    rows = H.latest_by_key(view(spark, d, "history_v"), "id", "version")
    return H.without(rows, rows.where(F.substring("id", 4, 20).cast("long") % 3 == 0)).select("id")


@query("s16_close_stale", f"WITH {LATEST} SELECT id, CASE WHEN status = 'running' AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 1 HOUR THEN CASE WHEN version % 2 = 0 THEN 'completed' ELSE 'failed' END ELSE status END AS status FROM l", "history_v")
def _(spark, d):
    rows = H.latest_by_key(view(spark, d, "history_v"), "id", "version")
    return H.close_stale(rows, F.lit("2024-02-01").cast("timestamp"), has_companies=F.col("version") % 2 == 0).select("id", "status")


@query("s17_list_counts", "SELECT c_custkey, count(o_orderkey) AS n_companies FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, d):
    return H.list_counts(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey", "n_companies")


@query("p22_summary_row", """SELECT id AS company_id, name, website, CASE WHEN id % 2 = 0 THEN 'own' || id ELSE email END AS email, CASE WHEN id % 6 = 0 THEN 'Ann Lee' END AS decision_maker, CASE WHEN id % 2 = 0 THEN 'x' || id || ', own' || id ELSE coalesce(email, '') END AS all_emails,
 CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN '+1' || id ELSE '' END AS phones_e164, 'CMS, CDN' AS tech_stack, 'Legal ' || name AS legal_name, 1990 + id % 30 AS founded_year, CASE WHEN id % 2 = 0 THEN 'mx1.example, mx2.example' END AS mx_records, id % 2 = 0 AS spf, CASE WHEN id % 6 = 0 THEN 'medium' END AS decision_maker_email_status,
 'Ann Lee (director)' AS registry_officers, id || ' Road' AS registered_address, CAST(id AS VARCHAR) AS registry_company_number, CAST(NULL AS VARCHAR) AS crawl_error FROM places_v""", "places_v")
def _(spark, d):
    rows = merged(spark, d).withColumns({
        "category": F.col("category_primary"), "tech": F.array(F.lit("CMS"), F.lit("CDN")), "lead_score": F.lit(50), "lead_grade": F.lit("C"),
        "people": F.transform("people", lambda p: F.struct(p["name"].alias("name"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("email_guess"), F.lit("medium").alias("email_guess_confidence"))),
        "registry": F.struct(F.concat(F.lit("Legal "), "name").alias("name"), F.lit(None).cast("string").alias("lei"), F.col("company_id").cast("string").alias("company_number"), F.lit("Active").alias("current_status"), F.concat("company_id", F.lit(" Road")).alias("registered_address"), F.array(F.struct(F.lit("Ann Lee").alias("name"), F.lit("director").alias("position"), F.lit(True).alias("current")), F.struct(F.lit("Old Hand").alias("name"), F.lit("clerk").alias("position"), F.lit(False).alias("current"))).alias("officers")),
        "firmographics": F.struct((1990 + F.col("company_id") % 30).cast("int").alias("founded_year")), "dns": F.when(F.col("company_id") % 2 == 0, F.struct(F.array(F.lit("mx1.example"), F.lit("mx2.example")).alias("mx"), F.lit("v=spf1").alias("spf"))),
    })
    return summary_row(rows).select("company_id", "name", "website", "email", "decision_maker", "all_emails", "phones_e164", "tech_stack", "legal_name", "founded_year", "mx_records", "spf", "decision_maker_email_status", "registry_officers", "registered_address", "registry_company_number", "crawl_error")


@query("st1_page_stream", r"""SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""")
def _(spark, d):
    path = folder(spark)
    table(spark, d, "pages").select("page_id", "url", "html").repartition(3).write.parquet(f"{path}/in")
    jobs.incremental_extraction(jobs.page_stream(spark, f"{path}/in"), f"{path}/out", f"{path}/state", lambda pages: parse_pages(pages).select("page_id", "title")).awaitTermination()
    return spark.read.schema("page_id long, title string").parquet(f"{path}/out").select("page_id", "title")  # a page written twice would show


FILES = 4
NAIVE = lambda c: F.col(c).cast("timestamp_ntz").alias(c)


def arriving(rows, path: str, end: str) -> None:
    """Rows (ts, late or not) written as three batches of ``FILES`` files, every tenth event fifty minutes late, and an event far ahead that lets the watermark pass all others."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    slot = F.least(F.lit(2), F.floor(3 * (F.unix_micros("ts") + F.when(F.col("late"), 3_000_000_000).otherwise(0) - F.unix_micros("a")) / (F.unix_micros("b") - F.unix_micros("a") + 1)))
    told = staged(rows.crossJoin(F.broadcast(bounds)).withColumn("slot", slot).drop("a", "b", "late"))  # bounds: one row
    for k in range(3):
        told.where(F.col("slot") == k).drop("slot").repartition(FILES).write.mode("append").parquet(path)
    told.select([F.lit(end).cast("timestamp").alias(c) if c == "ts" else F.lit("end").cast(t).alias(c) for c, t in told.drop("slot").dtypes]).limit(1).write.mode("append").parquet(path)


def appended(frame, path: str):
    frame.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


@query("st2_first_seen_urls", "SELECT DISTINCT url FROM page_log_v", "page_log_v")
def _(spark, d):
    path = folder(spark)
    view(spark, d, "page_log_v").select("url", "ts").repartition(FILES).write.parquet(f"{path}/in")
    appended(jobs.first_seen(spark.readStream.schema("url string, ts timestamp").parquet(f"{path}/in")), path)
    return spark.read.schema("url string, ts timestamp").parquet(f"{path}/out").select("url")  # one batch: each URL once, at whichever of its times


@query("st2_admitted_urls", """WITH RECURSIVE t AS (SELECT DISTINCT url, ts FROM page_log_v), a AS (SELECT url, min(ts) AS ts FROM t GROUP BY url
UNION ALL SELECT a.url, min(t.ts) AS ts FROM a JOIN t ON t.url = a.url AND t.ts >= a.ts + INTERVAL 6 HOURS GROUP BY a.url, a.ts) SELECT url, ts FROM a""", "page_log_v")
def _(spark, d):
    path, own = folder(spark), stateful_session(spark)
    arriving(view(spark, d, "page_log_v").select("url", "ts", (F.minute("ts") % 10 == 0).alias("late")), f"{path}/in", "2100-01-01")
    appended(admitted(own.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", FILES).parquet(f"{path}/in"), "6 hours", "1 hour"), path)
    return spark.read.schema("url string, ts timestamp").parquet(f"{path}/out").where("url <> 'end'").select("url", NAIVE("ts"))


@query("st3_run_sessions", """WITH g AS (SELECT job_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM page_log_v), s AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS span FROM g)
SELECT job_id, min(ts) AS started, max(ts) + INTERVAL 6 HOURS AS closed, count(*) AS n FROM s GROUP BY job_id, span""", "page_log_v")
def _(spark, d):
    return jobs.run_sessions(view(spark, d, "page_log_v"), "6 hours")


@query("st3_closed_runs", """WITH e AS (SELECT job_id, ts, status = 200 AND challenge = '' AS found, challenge = 'robots' AS finished FROM page_log_v),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) < INTERVAL 5 HOURS THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS span FROM g)
SELECT CAST(job_id AS VARCHAR) AS job_id, min(ts) AS started, max(ts) + INTERVAL 5 HOURS AS closed, count(*) AS events, count(*) FILTER (found AND NOT finished) AS companies,
 CASE WHEN bool_or(finished) OR count(*) FILTER (found AND NOT finished) > 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN NOT bool_or(finished) THEN 'interrupted' END AS note FROM s GROUP BY job_id, span""", "page_log_v")
def _(spark, d):
    path, own = folder(spark), stateful_session(spark)
    kind = F.when(F.col("challenge") == "robots", "finished").when((F.col("status") == 200) & (F.col("challenge") == ""), "company").otherwise("page")
    arriving(view(spark, d, "page_log_v").select(F.col("job_id").cast("string").alias("job_id"), "ts", kind.alias("kind"), (F.minute("ts") % 10 == 0).alias("late")), f"{path}/in", "2100-01-01")
    appended(close_quiet_runs(own.readStream.schema("job_id string, ts timestamp, kind string").option("maxFilesPerTrigger", FILES).parquet(f"{path}/in"), "5 hours", "1 hour"), path)
    return spark.read.schema("job_id string, started timestamp, closed timestamp, events long, companies long, status string, note string").parquet(f"{path}/out").where("job_id <> 'end'").select("job_id", NAIVE("started"), NAIVE("closed"), "events", "companies", "status", "note")


@query("st4_activity_counts", "SELECT date_trunc('hour', ts) AS started, count(*) AS pages, count(*) FILTER (error <> '') AS failed FROM page_log_v GROUP BY 1", "page_log_v")
def _(spark, d):
    return jobs.activity_counts(view(spark, d, "page_log_v"))


@query("st4_activity_stream", "SELECT date_trunc('hour', ts) AS started, count(*) AS pages, count(*) FILTER (error <> '') AS failed FROM page_log_v GROUP BY 1", "page_log_v")
def _(spark, d):
    path = folder(spark)
    arriving(view(spark, d, "page_log_v").select("ts", "error", (F.minute("ts") % 10 == 0).alias("late")), f"{path}/in", "2100-01-01")
    stream = spark.readStream.schema("ts timestamp, error string").option("maxFilesPerTrigger", FILES).parquet(f"{path}/in")
    jobs.keep_activity(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return jobs.activity_table(spark, f"{path}/out").where("started < timestamp'2100-01-01'").select(NAIVE("started"), "pages", "failed")
