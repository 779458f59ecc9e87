"""Which pages a crawl reads next: classes of links, their ranking, blocked pages, robots rules, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgatlas.functions import urls as U
from orgatlas.sources.staging import staged

#: Page categories in order, with the words that name them.
CATEGORY_WORDS = {
    "about": ["about", "company", "who-we-are", "our-story", "overview"],
    "services": ["services", "solutions", "what-we-do", "capabilities"],
    "industries": ["industries", "industry", "expertise", "verticals"],
    "technology": ["technology", "technologies", "tech-stack", "stack", "platform"],
    "team": ["team", "leadership", "people", "management"],
    "contact": ["contact", "locations", "offices"],
    "case_studies": ["case-study", "case-studies", "portfolio", "work", "clients"],
    "careers": ["career", "careers", "jobs"],
}
ORDER = [*CATEGORY_WORDS, "other"]
#: Marks of pages that block readers.
DECISIVE = [("cloudflare", r"(?i)<title>\s*(just a moment|attention required)|cf-browser-verification|window\._cf_chl_opt")]
WIDGETS = [
    ("turnstile", r"(?i)cf-turnstile|challenges\.cloudflare\.com/turnstile"),
    ("recaptcha", r"(?i)google\.com/recaptcha|g-recaptcha|recaptcha/api\.js"),
    ("hcaptcha", r"(?i)hcaptcha\.com|h-captcha"),
    ("datadome", r"(?i)captcha-delivery\.com|geo\.captcha-delivery"),
    ("perimeterx", r"(?i)px-captcha|_pxCaptcha|perimeterx"),
    ("akamai", r"(?i)sec-if-cpt-container|akamai-bm-telemetry|/_sec/cp_challenge"),
    ("imperva", r"(?i)_Incapsula_Resource|incapsula incident"),
]
LOGIN_URL = r"(?i)/(login|log-in|signin|sign-in|auth|sso|account/login)(/|\?|$)"
PASSWORD_FIELD = r"(?i)<input[^>]+type=[\"']?password"
BLOCKING = (401, 403, 429, 503)
FALLBACK_PATHS = ("/contact", "/contact-us", "/about", "/about-us")


def classify_links(links: DataFrame, url: str = "link", anchor: str = "label") -> DataFrame:
    """Adds ``category`` and ``category_score``: last path segment, then the path, then the anchor text decides."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    last = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    short = F.size(F.split(last, "-")) <= 3
    label = F.lower(F.coalesce(anchor, F.lit("")))
    tried = ((last, short, 0.95), (path, short, 0.90), (label, F.length(label) <= 40, 0.82))
    found = None
    for text, usable, score in tried:
        for category, words in CATEGORY_WORDS.items():
            hit = usable & text.rlike("|".join(words))
            value = F.struct(F.lit(category).alias("c"), F.lit(score).alias("s"))
            found = F.when(hit, value) if found is None else found.when(hit, value)
    found = found.otherwise(F.struct(F.lit("other").alias("c"), F.lit(0.20).alias("s")))
    return links.withColumn("_class", found).withColumns({"category": F.col("_class.c"), "category_score": F.col("_class.s")}).drop("_class")


def rank_links(links: DataFrame, limit: int, key: str = "page_id") -> DataFrame:
    """(key, link, category, score, place): best class per link, then categories take turns, up to ``limit`` per key."""
    best = links.groupBy(key, "link").agg(F.max_by(F.struct("category", "category_score"), F.struct("category_score", -F.col("pos"))).alias("b")).select(key, "link", "b.category", F.col("b.category_score").alias("score"))
    turn = Window.partitionBy(key, "category").orderBy(F.desc("score"), F.length("link"), "link")
    place = Window.partitionBy(key).orderBy("turn", F.array_position(F.array(*map(F.lit, ORDER)), F.col("category")))
    return best.withColumn("turn", F.row_number().over(turn)).withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit).drop("turn")


def discover(pages: DataFrame, seed: Column, limit: int) -> DataFrame:
    """Links of parsed pages resolved against the seed address, of its domain, classified and ranked."""
    links = pages.withColumn("_seed", seed).select("page_id", "_seed", F.posexplode("links").alias("pos", "a"))
    target = U.canonical_link(F.col("_seed"), F.col("a.href"))
    links = links.select("page_id", "_seed", "pos", target.alias("link"), F.col("a.label").alias("label")).where(F.col("link").isNotNull() & U.same_domain(F.col("_seed"), F.col("link")))
    upgraded = F.when(F.col("_seed").startswith("https://") & F.col("link").startswith("http://"), F.concat(F.lit("https://"), F.substr("link", F.lit(8)))).otherwise(F.col("link"))
    return rank_links(classify_links(links.withColumn("link", upgraded)), limit)


def challenge(pages: DataFrame, html: str = "html", text_length: str = "text_length", status: str = "status", final_url: str = "final_url", url: str = "url", most_chars: int | None = None) -> DataFrame:
    """Adds ``challenge``: what blocks the page, or an empty string. Widgets count on thin or refused pages only. With ``most_chars`` only so much of a page is read."""
    head = F.left(F.col(html), F.lit(most_chars)) if most_chars else F.col(html)
    code = F.coalesce(status, F.lit(0))
    thin, refused = F.coalesce(text_length, F.lit(0)) < 1500, code.isin(*BLOCKING)
    found = None
    for name, pattern in DECISIVE:
        hit = head.rlike(pattern)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    for name, pattern in WIDGETS:
        found = found.when((thin | refused) & head.rlike(pattern), name)
    final = F.coalesce(final_url, url)
    login = head.rlike(PASSWORD_FIELD) & thin & ((final.rlike(LOGIN_URL) & ~F.col(url).rlike(LOGIN_URL)) | (code == 401))
    return pages.withColumn("challenge", found.when(login, "login").when(refused & thin, "blocked").otherwise(""))


def is_thin(status: Column, text_length: Column, n_scripts: Column) -> Column:
    """Refused, failed or nearly empty: a page that needs a browser."""
    code = F.coalesce(status, F.lit(0))
    return code.isin(*BLOCKING) | (code >= 500) | (text_length < 250) | ((text_length < 800) & (n_scripts > 5))


def robots_gate(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed`` to rows of (url): the longest matching path prefix of the host's rules decides, allow wins ties.

    Each prefix of the path is one row, so the prefix test is an equality join.
    """
    rows = urls.withColumns({"_host": U.host_of(F.col("url")), "_path": F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*(.*)$", 1)})
    lengths = rules.select(F.col("host").alias("_host"), F.length("path_prefix").alias("_n")).groupBy("_host").agg(F.collect_set("_n").alias("_lengths"))
    tried = rows.select("url", "_host", "_path").distinct().join(lengths, "_host").select("url", "_host", F.explode(F.transform(F.filter("_lengths", lambda n: n <= F.length("_path")), lambda n: F.left(F.col("_path"), n))).alias("_prefix"))
    hits = tried.join(rules.select(F.col("host").alias("_host"), F.col("path_prefix").alias("_prefix"), "allow"), ["_host", "_prefix"])
    decided = hits.groupBy("url").agg(F.max_by("allow", F.struct(F.length("_prefix"), "allow")).alias("_allow"))
    return rows.join(decided, "url", "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_host", "_path", "_allow")


def robots_fallback(gated: DataFrame) -> DataFrame:
    """Contact and about addresses of seeds whose home page is disallowed."""
    return gated.where("not allowed").select(F.col("url").alias("seed"), F.explode(F.array(*[F.concat(U.origin_of(F.col("url")), F.lit(p)) for p in FALLBACK_PATHS])).alias("url"))


def reachable(links: DataFrame, seeds: DataFrame, depth: int, max_pages: int) -> DataFrame:
    """(seed, id, depth) of the pages found from each seed, at most ``max_pages``, breadth first.

    ``links``: src_id, dst_id, score. One join per level (``depth`` is small); a level is cut by score, then id.
    """
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    level = seen
    for step in range(1, depth + 1):
        found = level.join(links, level["id"] == links["src_id"]).groupBy("seed", F.col("dst_id").alias("id")).agg(F.max("score").alias("score"))
        fresh = found.join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        have = seen.groupBy("seed").agg(F.count("*").alias("have"))
        order = Window.partitionBy("seed").orderBy(F.desc("score"), "id")
        level = fresh.withColumn("n", F.row_number().over(order)).join(have, "seed").where(F.col("n") + F.col("have") <= max_pages).select("seed", "id", F.lit(step).alias("depth"))
        level = staged(level)  # else every level would compute all earlier ones again
        seen = seen.unionByName(level)
    return seen
