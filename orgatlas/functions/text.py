"""Column functions over names and other short texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing as a heading or label, and the legal words of the three name keys.
GENERIC = (
    "home", "about", "about us", "services", "contact", "contact us", "learn more", "read more", "menu", "team", "careers", "our services", "site footer", "footer", "header", "navigation",
    "main menu", "frequently asked questions", "faq", "faqs", "how can we help", "get in touch", "let's talk", "subscribe", "newsletter", "privacy policy", "cookie policy", "share", "follow us",
)
LEGAL_WORDS = r"(?i)\b(limited|ltd|\(?pvt\)?|private limited|inc|corporation|corp|group|plc|llc)\b\.?"
MAP_LEGAL_WORDS = r"(?i)\b(limited|ltd|\(?pvt\)?|private|inc|corporation|corp|co|company|group|plc|llc|the)\b\.?"
COUNTRY_ALIASES = {
    "uk": "GB", "great britain": "GB", "britain": "GB", "england": "GB", "usa": "US", "america": "US", "uae": "AE", "emirates": "AE",
    "korea": "KR", "south korea": "KR", "russia": "RU", "iran": "IR", "vietnam": "VN", "turkey": "TR", "ivory coast": "CI",
}
EMPLOYEE_STEPS = (10, 50, 200, 500, 1000, 5000, 10000)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(value: Column) -> Column:
    """White space collapsed and trimmed; NULL becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), F.lit(""))


def stem(word: Column) -> Column:
    bare = F.regexp_replace(F.lower(word), r"(?U)[^\w]", "")
    return F.when(F.length(bare) >= 6, F.substring(bare, 1, 5)).when(F.length(bare) > 4, F.regexp_replace(bare, "s+$", "")).otherwise(bare)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def sibling_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), LEGAL_WORDS, " "), "[^a-z0-9]", "")


def map_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), MAP_LEGAL_WORDS, " "), "[^a-z0-9]", "")


def display_name(name: Column) -> Column:
    """"LAST, FIRST" becomes "First Last"; words in one case are capitalised, others stay."""
    bare = F.trim(name)
    turned = F.when(bare.rlike("^[^,]+,[^,]+$"), F.concat(F.trim(F.substring_index(bare, ",", -1)), F.lit(" "), F.trim(F.substring_index(bare, ",", 1)))).otherwise(bare)
    words = F.filter(F.split(turned, r"\s+"), lambda w: w != "")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    return F.array_join(F.transform(words, lambda w: F.when((w == F.upper(w)) | (w == F.lower(w)), capital(w)).otherwise(w)), " ")


def jurisdiction(code: Column) -> Column:
    return F.lower(F.replace(code, F.lit("-"), F.lit("_")))


def country_of(code: Column) -> Column:
    return F.substring_index(F.substring_index(F.lower(code), "_", 1), "-", 1)


def joined_address(*parts: Column) -> Column:
    """Parts that are not blank, separated by commas; NULL if there is none."""
    return F.nullif(F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]), F.lit(""))


def distinct_labels(values: Column) -> Column:
    """First spelling of each label in order, case ignored; generic words are dropped."""
    kept = F.filter(F.transform(values, clean), lambda v: (v != "") & ~F.lower(v).isin(*GENERIC))
    return once(kept, lambda k: once(F.transform(k, F.lower), lambda low: F.filter(k, lambda v, i: F.array_position(low, F.get(low, i)) == i + 1)))


def category_label(category: Column) -> Column:
    return F.nullif(F.replace(category, F.lit("_"), F.lit(" ")), F.lit(""))


def category_path(hierarchy: Column) -> Column:
    return F.nullif(F.array_join(hierarchy, " > "), F.lit(""))


def email_parts(email: Column) -> tuple[Column, Column]:
    """(local part, domain) in lower case."""
    low = F.lower(email)
    return F.substring_index(low, "@", 1), F.when(low.contains("@"), F.regexp_extract(low, "@(.*)$", 1)).otherwise("")


def employee_range(n: Column) -> Column:
    label, low = F.lit(None).cast("string"), 1
    out = None
    for high in EMPLOYEE_STEPS:
        step = n <= high
        out = F.when(step, F.lit(f"{low}-{high}")) if out is None else out.when(step, F.lit(f"{low}-{high}"))
        low = high + 1
    return F.when(n.isNull(), label).otherwise(out.otherwise(F.lit(f"{EMPLOYEE_STEPS[-1]}+")))


def age_years(day: Column, as_of: Column) -> Column:
    return F.round(F.datediff(as_of, day) / 365.25, 1)
