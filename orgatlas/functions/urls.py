"""Column functions over addresses (URLs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid")
ASSET_EXTENSIONS = "jpg jpeg png gif svg webp ico mp4 mp3 wav zip rar 7z pdf doc docx xls xlsx ppt pptx css js woff woff2 ttf"
SHARED_HOSTS = (
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "wa.me", "whatsapp.com", "linktr.ee", "google.com", "sites.google.com",
    "business.site", "blogspot.com", "wordpress.com", "wixsite.com", "tiktok.com", "daraz.pk", "olx.com.pk", "t.me",
)
SOCIAL_HOSTS = ("linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "github.com")
SKIPPED_LINKS = ("#", "mailto:", "tel:", "javascript:", "data:")

#: Parts that the pages of a domain are dealt into.
DEALT = 32

_PARTS = r"(?i)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, parameters, tracking keys or trailing slashes; empty for blank."""
    bare = F.trim(url)
    full = F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    part = lambda i: F.regexp_extract(full, _PARTS, i)
    path = F.regexp_replace(F.regexp_replace(part(3), r";[^/]*$", ""), "/+$", "")
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING_KEYS))
    query = F.array_join(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    joined = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(bare == "", F.lit("")).otherwise(joined)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def domain(url: Column) -> Column:
    """Host in lower case without a leading ``www.``."""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def same_domain(a: Column, b: Column) -> Column:
    return domain(a) == domain(b)


def pairs_of_domain(pages: DataFrame) -> DataFrame:
    """(page_id, other_id): each page with the later ones of its domain. Pages of a domain are dealt into ``DEALT`` parts that each meet the whole domain, so that
    the pairs of a large one are made by many tasks; a task holds its part and one copy of the domain."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = pages.withColumn("_part", F.pmod(F.xxhash64("page_id"), F.lit(DEALT)).cast("int")).repartition(n, "domain", "_part")
    whole = pages.select(F.col("page_id").alias("other_id"), "domain", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_part"))
    return part.join(whole.repartition(n, "domain", "_part"), ["domain", "_part"]).where("other_id > page_id").select("page_id", "other_id")


def canonical_link(base: Column, href: Column) -> Column:
    """Absolute, normalised target of a link (absolute, scheme- or root-relative, or relative to the folder); NULL if it leads to no page."""
    origin = F.regexp_extract(base, r"(?i)^([a-z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    full = (
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"(?i)^([a-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )
    target = normalize_url(full)
    bad = target.rlike(rf"(?i)^[^?]*\.(?:{ASSET_EXTENSIONS.replace(' ', '|')})(?:$|\?)")
    skipped = href.isNull() | (href == "")
    for start in SKIPPED_LINKS:
        skipped = skipped | href.startswith(start)
    return F.when(~skipped & ~bad, target)


def origin_of(url: Column) -> Column:
    """``scheme://host`` of a deep link; http is assumed where there is no scheme."""
    full = F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("http://"), url))
    return F.regexp_extract(full, r"(?i)^(https?://[^/]+)", 1)


def site_domain(url: Column) -> Column:
    """Company domain of a web site; NULL for hosts that unrelated companies share."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"(?i)^(?:https?://)?(?:www\d?\.)?([^/:?#]+)", 1)), r"\.+$", "")
    shared = F.lit(False)
    for h in SHARED_HOSTS:
        shared = shared | (host == h) | host.endswith("." + h)
    return F.when((host != "") & host.contains(".") & ~shared, host)


def alternate_urls(url: Column) -> Column:
    """Other spellings of an address: https on the same host, https with or without www, the same scheme with or without www."""
    scheme, host = F.lower(F.regexp_extract(url, "(?i)^([a-z]+)://", 1)), host_of(url)
    other = F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(F.concat(F.lit("www."), host))
    own = F.concat(scheme, F.lit("://"), host)
    tried = F.array(F.concat(F.lit("https://"), host), F.concat(F.lit("https://"), other), F.concat(scheme, F.lit("://"), other))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(F.filter(tried, lambda c: c != own)), 1, 3))
