"""Values found on pages, as long tables (page_id, ..., pos), by DataFrame functions over parsed pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgatlas.functions import text as T
from orgatlas.functions import urls as U

#: Patterns and word lists.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: The same matches without going back over a long run of letters: a match begins where such a run or the last match ends.
EMAILS = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<![\w/.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w/])|(?<![\w/.])\+\d{8,14}(?!\w)"
YEARS = r"^(19|20)\d{2}[ .-](19|20)?\d{2}$"
MOST_PHONES = 20
ROLE = r"(?iU)\b(co[- ]?founder|founder|ceo|chief executive|president|managing director|owner|chairman)\b"
CALL_TO_ACTION = r"(?i)\s*\b(read more|learn more|view case study|view more|see more|explore|discover more|know more|visit page|view all|see all)\b\s*[→»>]*\s*$"
NAME = r"(?U)^(?:(?:Dr|Mr|Ms|Mrs)\.?\s+)?[A-Z][\w'’.-]+(?:\s+[A-Z][\w'’.-]+){1,3}$"
NAME_WORD = r"(?U)^[A-Z][\w'’.-]+$"
NOT_NAME_WORDS = (
    "download", "company", "profile", "celebration", "celebrations", "birthday", "message", "activity", "activities", "news", "events", "event", "welcome", "contact", "about", "read",
    "view", "team", "board", "group", "limited", "ltd", "pvt", "private", "industries", "mills", "textile", "textiles", "products", "services", "home", "our", "the", "of", "and",
    "vision", "mission", "history", "overview", "corporate", "annual", "report", "gallery", "career", "careers", "happy", "christmas", "eid", "holiday", "us", "apply", "now", "click",
    "here", "learn", "more", "get", "started", "join", "watch", "listen", "explore", "book", "shop", "order", "buy", "sign", "login", "register", "subscribe", "follow", "share",
    "latest", "new", "exclusive", "podcast", "interview", "quote", "request", "free", "trial", "demo",
)
NOT_TITLE = r"(?iU)[\"“”«»]|\b(message|messages|activity|speech|desk|note|profile|if i were)\b|'s\b|’s\b"
SAME_LINE = r"^(.{3,40}?)\s*[,|–—-]\s*(.+)$"
TITLE_EDGES = r"^[ �•·–—\-|:,.]+|[ �•·–—\-|:,.]+$"
CERTIFICATE = (
    r"(?i)\b(ISO(?:/IEC)?\s?\d{4,5}(?::\d{4})?|SOC\s?[12](?:\s?Type\s?(?:II|I|2|1))?|CMMI(?:\s?(?:Level|ML)\s?\d)?|HIPAA(?:\s?Compliant)?|GDPR(?:\s?Compliant)?|PCI[\s-]?DSS|"
    r"(?:AWS|Microsoft|Google Cloud|Salesforce|Shopify|HubSpot|Odoo|Oracle|SAP)\s(?:Advanced|Select|Premier|Gold|Silver|Certified|Registered|Consulting)?\s?(?:Tier\s)?(?:Consulting\s|Services\s|Solutions\s)?Partner)\b"
)
STREET = r"(?i)\b(floor|suite|road|rd|street|st|avenue|ave|block|tower|towers|building|plaza|centre|center|blvd|boulevard|drive|dr|lane|highway|sector|p\.?o\.? box)\b\.?"
ADDRESS_CATEGORIES = ("contact", "about", "homepage")


def exploded(rows: DataFrame, values: Column, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode(values).alias("pos", "value"))


def headings(pages: DataFrame) -> DataFrame:
    return exploded(pages, T.distinct_labels(F.col("headings")), "page_id")


def jsonld_objects(pages: DataFrame) -> DataFrame:
    """One row per JSON-LD object (VARIANT): lists and @graph are opened, bad JSON is skipped."""
    scripts = pages.select("page_id", F.posexplode("jsonld").alias("script", "raw")).select("page_id", "script", F.try_parse_json("raw").alias("v")).where("v is not null")
    several = F.coalesce(F.try_variant_get("v", "$['@graph']", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return scripts.select("page_id", "script", F.posexplode(several).alias("item", "object"))


def emails(rows: DataFrame, text: Column, hrefs: Column, *keys: str) -> DataFrame:
    """Addresses in the text, then those of mailto links in lower case; the first spelling of each."""
    mailto = F.filter(F.transform(F.filter(hrefs, lambda h: h.startswith("mailto:")), lambda h: F.lower(F.substring_index(F.substr(h, F.lit(8)), "?", 1))), lambda e: e != "")
    return exploded(rows, T.distinct_labels(F.concat(F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(EMAILS), F.lit(0))).otherwise(F.array().cast("array<string>")), mailto)), *keys)


def phone_matches(line: Column) -> Column:
    """Numbers of one line: 8 to 15 digits, no year range, and international, bracketed or of 10 digits at least."""
    found = F.transform(F.regexp_extract_all(line, F.lit(PHONE), F.lit(0)), lambda x: F.trim(x))
    length = lambda p: F.length(F.regexp_replace(p, r"\D", ""))
    return F.filter(found, lambda p: length(p).between(8, 15) & ~p.rlike(YEARS) & (p.startswith("+") | p.startswith("(") | (length(p) >= 10)))


def phones(rows: DataFrame, lines: Column, hrefs: Column, *keys: str) -> DataFrame:
    """Numbers of tel links (the last first), then of the lines; at most ``MOST_PHONES`` distinct ones."""
    links = F.reverse(F.transform(F.filter(hrefs, lambda h: h.startswith("tel:")), lambda h: F.trim(F.substr(h, F.lit(5)))))
    return exploded(rows, F.slice(T.distinct_labels(F.concat(links, F.flatten(F.transform(lines, phone_matches)))), 1, MOST_PHONES), *keys)


def social_links(rows: DataFrame, hrefs: Column, *keys: str) -> DataFrame:
    """Links whose host contains a social host's name anywhere (``netflix.com`` contains ``x.com``: kept on purpose)."""
    social = F.filter(hrefs, lambda h: U.host_of(h).rlike("|".join(map(re.escape, U.SOCIAL_HOSTS))))
    return exploded(rows, T.distinct_labels(social), *keys)


def lines_of(pages: DataFrame) -> DataFrame:
    """(page_id, pos, line): cleaned lines without empty ones, numbered."""
    return pages.select("page_id", F.posexplode(F.filter(F.transform("lines", T.clean), lambda x: x != "")).alias("pos", "line"))


def looks_like_name(value: Column) -> Column:
    words = F.transform(F.split(value, r"(?U)\s+"), lambda w: F.regexp_replace(F.lower(w), r"^\.+|\.+$", ""))
    return value.rlike(NAME) & ~F.exists(words, lambda w: w.isin(*NOT_NAME_WORDS))


def people(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, name, title): a line with a role, and the name on it, split over the two lines before, before it or after it."""
    order = Window.partitionBy(key).orderBy("pos")
    near = lines.withColumns({"b2": F.lag("line", 2).over(order), "b1": F.lag("line", 1).over(order), "a1": F.lead("line", 1).over(order)})
    role = near.where((F.length("line") <= 80) & F.col("line").rlike(ROLE) & ~F.col("line").rlike(NOT_TITLE))
    same_name, same_title = F.regexp_extract("line", SAME_LINE, 1), F.regexp_extract("line", SAME_LINE, 2)
    both = F.concat_ws(" ", "b2", "b1")
    alone = lambda c: F.coalesce((F.length(c) <= 40) & looks_like_name(F.col(c)) & ~F.col(c).rlike(ROLE), F.lit(False))
    split_name = F.coalesce(F.col("b1").rlike(NAME_WORD) & F.col("b2").rlike(NAME_WORD) & looks_like_name(both), F.lit(False))
    pair = lambda n, t: F.struct(n.alias("name"), t.alias("title"))
    line = F.col("line")
    found = F.when((same_name != "") & looks_like_name(same_name) & same_title.rlike(ROLE), pair(same_name, same_title)).when(split_name, pair(both, line)).when(alone("b1"), pair(F.col("b1"), line)).when(alone("a1"), pair(F.col("a1"), line))
    return role.select(key, "pos", found.alias("found")).where("found is not null").select(key, "pos", "found.name", F.regexp_replace("found.title", TITLE_EDGES, "").alias("title"))


def certifications(rows: DataFrame, text: Column, *keys: str) -> DataFrame:
    return exploded(rows, T.distinct_labels(F.regexp_extract_all(text, F.lit(CERTIFICATE), F.lit(0))), *keys)


def addresses(pages: DataFrame) -> DataFrame:
    """Marked-up addresses without their phone and e-mail lines; else, on some categories, lines that read like one."""
    is_contact = lambda x: (F.size(phone_matches(x)) > 0) | x.rlike(EMAILS) | x.rlike(r"^[\d\s()+./-]{7,}$")
    tagged = F.filter(F.transform("addresses", lambda a: F.array_join(F.filter(F.transform(a, T.clean), lambda x: (x != "") & ~is_contact(x)), ", ")), lambda a: a != "")
    marked = pages.withColumn("_tagged", tagged)
    rest = marked.where((F.size("_tagged") == 0) & F.col("category").isin(*ADDRESS_CATEGORIES))
    order = Window.partitionBy("page_id").orderBy("pos")
    lines = lines_of(rest).withColumn("before", F.lag("line").over(order))
    island = F.sum(F.when(F.coalesce(F.col("before").rlike("[,–-]$"), F.lit(False)), 0).otherwise(1)).over(order)
    merged = lines.withColumn("island", island).groupBy("page_id", "island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("value"))
    street = F.length("value").between(15, 220) & (F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))) >= 2) & F.col("value").rlike(r"\d") & F.col("value").rlike(STREET) & ~F.col("value").rlike(EMAILS)
    by_line = merged.where(street).groupBy("page_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("island", "value"))), lambda x: x["value"]), 1, 10).alias("found"))
    found = marked.where(F.size("_tagged") > 0).select("page_id", F.col("_tagged").alias("found")).unionByName(by_line)
    return exploded(found, T.distinct_labels(F.col("found")), "page_id")


def internal_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link, label): links inside the page's own domain that have a label."""
    links = pages.select("page_id", "url", F.posexplode("links").alias("pos", "a")).select("page_id", "url", "pos", U.canonical_link(F.col("url"), F.col("a.href")).alias("link"), F.col("a.label").alias("raw"))
    label = F.regexp_replace(F.regexp_replace(T.clean(F.col("raw")), CALL_TO_ACTION, ""), r"^[ →»>|-]+|[ →»>|-]+$", "")
    return links.where(F.col("link").isNotNull() & U.same_domain(F.col("url"), F.col("link"))).select("page_id", "pos", "link", label.alias("label")).where("label <> ''")


def client_logos(pages: DataFrame) -> DataFrame:
    """Alternative texts of images in elements marked as clients or logos."""
    cut = F.filter(F.transform("logos", lambda a: F.regexp_replace(T.clean(a), r"(?i)\s*(logo|image|icon)\s*$", "")), lambda a: F.length(a).between(3, 49))
    return exploded(pages, T.distinct_labels(cut), "page_id")


def section_children(links: DataFrame, pages: DataFrame, category: str) -> DataFrame:
    """Labels of links below the path of a section page of the same domain (root pages ignored).

    Every proper parent path of a link is one row, so the prefix test is an equality join.
    """
    path = lambda c: F.regexp_replace(F.regexp_extract(c, r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    roots = pages.where(F.col("category") == category).select(U.domain(F.col("url")).alias("site"), path("url").alias("root")).where("root <> ''").distinct()
    parts = links.where(F.length("label").between(3, 59) & (F.size(F.split("label", r"\s+")) <= 6)).select("page_id", "pos", "label", U.domain(F.col("link")).alias("site"), F.split(path("link"), "/").alias("parts"))
    parents = F.transform(F.sequence(F.lit(2), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    below = parts.where(F.size("parts") > 2).select("page_id", "pos", "label", "site", F.explode(parents).alias("root"))
    return below.join(roots, ["site", "root"], "left_semi").select("site", "page_id", "pos", "label").distinct()
