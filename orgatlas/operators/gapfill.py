"""Missing contact fields filled from other sources, and one best value per field with its source."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from orgatlas.functions import text as T
from orgatlas.functions import urls as U
from orgatlas.sources.staging import looked_up, spread, staged

#: Tags of a map extract per field, in order; and the shared length of names that may match loosely.
MAP_TAGS = {"website": ("website", "contact:website", "url"), "phone": ("phone", "contact:phone", "contact:mobile", "mobile"), "email": ("email", "contact:email")}
LEAST_KEY, LIKE = 4, 0.9
#: Letters that may be taken out of each key when alike keys meet on the rest; length of a piece otherwise.
DEEPEST, PIECE = 2, 3
FIELDS = ("website", "phone", "email")
SOCIAL = ("linkedin", "facebook", "instagram", "twitter", "youtube", "x")
NO_SOURCES = "map<string,string>"


def map_fields(places: DataFrame) -> DataFrame:
    """(name, country, website, phone, email) from map places with ``tags``: the first tag that is set, before a semicolon."""
    first = lambda keys: F.trim(F.substring_index(F.coalesce(*[F.nullif(F.try_element_at("tags", F.lit(k)), F.lit("")) for k in keys]), ";", 1))
    return places.select("name", "country", "ord", *[first(keys).alias(field) for field, keys in MAP_TAGS.items()])


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def fill(companies: DataFrame, source: DataFrame, fields: tuple = FIELDS, label: str = "source", key: str = "company_id") -> DataFrame:
    """NULL fields of companies get the source's values; ``filled_from`` notes which."""
    if "filled_from" not in companies.columns:
        companies = companies.withColumn("filled_from", F.create_map().cast(NO_SOURCES))
    both = companies.join(source.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key, "left")
    taken = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.when(F.col(f).isNull() & F.col(f"_{f}").isNotNull(), F.lit(label)) for f in fields])), lambda _, v: v.isNotNull())
    noted = F.map_concat(F.coalesce("filled_from", F.create_map().cast(NO_SOURCES)), taken)
    return both.withColumn("filled_from", noted).withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).drop(*[f"_{f}" for f in fields])


def most_edits(a: Column, b: Column) -> Column:
    """Letters that stand in one of two keys of these lengths only, at most, when their ratio is ``LIKE`` or more."""
    return F.floor(F.round((1 - LIKE) * (a + b), 6)).cast("int")


def left_out(a: Column, b: Column) -> tuple[Column, Column]:
    """How many letters must at most be taken out of each of two alike keys of these lengths, so that the rest is the same."""
    own = F.floor((most_edits(a, b) + a - b) / 2).cast("int")
    return own, own - a + b


def other_lengths(n: Column) -> Column:
    """All lengths that a key alike to one of ``n`` letters may have."""
    return F.sequence(F.ceil(F.round(n * LIKE / (2 - LIKE), 6)).cast("int"), F.floor(F.round(n * (2 - LIKE) / LIKE, 6)).cast("int"))


def shallow(a: Column, b: Column) -> Column:
    own, other = left_out(a, b)
    return (own <= DEEPEST) & (other <= DEEPEST)


def variants(key: Column, count: Column) -> Column:
    """Hashes of what is left of a key when ``count`` letters (0 to ``DEEPEST``) are taken out, in every way."""
    n = F.length(key)
    without = lambda text, i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))
    one = F.transform(F.sequence(F.lit(1), n), lambda i: without(key, i))
    two = F.flatten(F.transform(F.sequence(F.lit(2), n), lambda i: F.transform(F.sequence(F.lit(1), i - 1), lambda k: without(without(key, i), k))))
    return F.transform(F.array_distinct(F.when(count == 0, F.array(key)).when(count == 1, one).otherwise(two)), lambda t: F.xxhash64(t))


def unbroadcast(rows: DataFrame) -> DataFrame:
    """``rows`` as the side of a join that deals out both sides: what is exploded is estimated by what it came from, and hundreds of rows a key would be sent to the driver."""
    return rows.hint("merge")


def by_variants(own: DataFrame, theirs: DataFrame) -> DataFrame:
    """(country, key, _key): keys that are the same without one or two letters each; only pairs that the bound allows meet."""

    def rows(table: DataFrame, key: str, count: str) -> DataFrame:
        n = F.length(key)
        depth = F.transform(F.filter(other_lengths(n), lambda m: shallow(n, m)), lambda m: left_out(n, m)[0])
        return table.select("country", key, F.explode(F.array_distinct(depth)).alias(count)).select("country", key, count, F.explode(variants(F.col(key), F.col(count))).alias("rest"))

    met = rows(own, "key", "out").join(unbroadcast(rows(theirs, "_key", "_out")), ["country", "rest"])
    a, b = left_out(F.length("key"), F.length("_key"))
    return met.where((F.col("out") == a) & (F.col("_out") == b) & (F.col("key") != F.col("_key"))).select("country", "key", "_key").distinct()


def strangers(a: Column, b: Column, reach: Column) -> Column:
    """Letters of ``a`` that do not stand in ``b`` within ``reach`` places: no common subsequence has them."""
    near = lambda p: F.substring(b, F.greatest(F.lit(1), p - reach), p + reach - F.greatest(F.lit(1), p - reach) + 1)
    return F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda p: ~F.contains(near(p), F.substring(a, p, F.lit(1)))))


def letters(key: Column) -> Column:
    """Which letters a key has, as 64 bits; letters may share one."""
    return F.aggregate(F.transform(F.split(key, ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def only(a: Column, b: Column) -> Column:
    """Bits of ``a`` that ``b`` lacks: at most as many as ``strangers``, and much cheaper to count."""
    return F.bit_count(a.bitwiseAND(F.bitwise_not(b)))


def by_rare_pieces(own: DataFrame, theirs: DataFrame) -> DataFrame:
    """(country, key, _key): the other alike keys, whose lengths differ much or are great. Of one separate piece more than there may be edits at least one stands in both.

    A key's pieces are those three letters long that the fewest keys of the other side have, from the best of three ways to cut it; what meets must also stay within the bound on the common letters, anywhere and then in a band.
    """
    n, m = F.length("key"), F.length("_key")
    deep = lambda a: F.filter(other_lengths(a), lambda b: ~shallow(a, b))
    grams = lambda key: F.transform(F.sequence(F.lit(1), F.length(key) - (PIECE - 1)), lambda p: F.struct(p.alias("at"), F.substring(key, p, F.lit(PIECE)).alias("text")))
    places = staged(theirs.where((m >= PIECE) & (F.size(deep(m)) > 0)).select("country", "_key", letters(F.col("_key")).alias("_letters"), F.inline(grams("_key"))))
    often = places.groupBy("country", "text").agg(F.count("*").alias("n"))
    ours = own.where((n >= PIECE) & (F.size(deep(n)) > 0)).withColumn("edits", F.array_max(F.transform(deep(n), lambda b: most_edits(n, b))))
    counted = ours.select("country", "key", "edits", F.inline(grams("key"))).join(unbroadcast(often), ["country", "text"], "left")
    listed = counted.groupBy("country", "key", "edits").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "at", "text"))).alias("pieces"))
    cuts = F.transform(F.array(*map(F.lit, range(PIECE))), lambda c: F.slice(F.filter("pieces", lambda x: x["at"] % PIECE == c), F.lit(1), F.col("edits") + 1))
    priced = F.transform(F.filter(cuts, lambda c: F.size(c) > F.col("edits")), lambda c: F.struct(F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("cost"), c.alias("chosen")))
    chosen = listed.select("country", "key", "edits", letters(F.col("key")).alias("letters"), F.inline(F.array_min(priced)["chosen"])).where("n > 0").withColumnRenamed("at", "_at")
    met = chosen.withColumn("m", F.explode(deep(n))).join(unbroadcast(places.withColumn("m", m)), ["country", "text", "m"])
    a, b = left_out(n, m)
    near = (F.abs(F.col("at") - F.col("_at")) <= F.col("edits")) & (only(F.col("letters"), F.col("_letters")) <= a) & (only(F.col("_letters"), F.col("letters")) <= b)
    pairs = met.where(near).select("country", "key", "_key").distinct()
    reach = most_edits(n, m)
    return pairs.where((strangers(F.col("key"), F.col("_key"), reach) <= a) & (strangers(F.col("_key"), F.col("key"), reach) <= b))


def keys_of(companies: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(company_id, country, key) and (country, ord, fields, _key) of names that are long enough."""
    own = companies.select("company_id", F.lower("country").alias("country"), T.map_key(F.col("name")).alias("key")).where(F.length("key") >= LEAST_KEY)
    theirs = map_fields(places).select(F.lower("country").alias("country"), "ord", *FIELDS, T.map_key(F.col("name")).alias("_key")).where(F.length("_key") >= LEAST_KEY)
    return own, theirs


def alike_candidates(own: DataFrame, theirs: DataFrame) -> DataFrame:
    """(country, key, _key, way): the pairs of different keys that are compared letter by letter. Both tables: country and key or _key."""
    a, b = spread(staged(own.select("country", "key").distinct())), spread(staged(theirs.select("country", "_key").distinct()))
    return by_variants(a, b).withColumn("way", F.lit("variants")).unionByName(by_rare_pieces(a, b).withColumn("way", F.lit("pieces")))


def osm_matches(companies: DataFrame, places: DataFrame) -> DataFrame:
    """(company_id, ord, fields) of map places with the company's name: equal keys, or alike to nine tenths.

    Alike keys differ by a bounded number of inserted and missing letters. Where at most two go on each side, the keys meet on what is left without them
    (only pairs within the bound do, however common their words); the others meet on their rarest pieces. No pair is lost, and each pair of keys is compared once,
    whatever number of companies and places have them.
    """
    own, theirs = keys_of(companies, places)
    theirs = unbroadcast(theirs)
    equal = own.join(theirs, (own["country"] == theirs["country"]) & (own["key"] == theirs["_key"])).select("company_id", "ord", *FIELDS)
    pairs = staged(alike_candidates(own, theirs))
    alike = pairs.where(_ratio("key", "_key") >= LIKE).drop("way")
    loose = own.join(unbroadcast(alike), ["country", "key"]).join(theirs, ["country", "_key"]).select("company_id", "ord", *FIELDS)
    return equal.unionByName(loose)


def first_values(own: DataFrame, theirs: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """(company_id, fields): per field the first value, by ``ord``, of the places with the company's key or, by ``alike`` (country, key, _key), one like it.

    Places are reduced to one row a key before companies meet them: many places and many companies of one name never meet in pairs.
    """
    least = lambda value: [F.min(value(f)).alias(f) for f in FIELDS]
    theirs = staged(theirs.groupBy("country", "_key").agg(*least(lambda f: F.when(F.col(f).isNotNull(), F.struct("ord", f)))))
    rows = own.where("country is not null")
    keys = staged(rows.groupBy("country", "key").agg(F.count("*").alias("companies")))
    met = keys.select("country", "key", F.col("key").alias("_key"))
    met = met if alike is None else met.unionByName(alike.select("country", "key", "_key"))
    best = met.join(theirs, ["country", "_key"]).groupBy("country", "key").agg(*least(F.col))
    found = looked_up(rows.select("company_id", "country", "key"), staged(best.join(keys, ["country", "key"])), ["country", "key"], "companies", F.col("company_id"))
    return found.groupBy("company_id").agg(*least(F.col)).select("company_id", *[F.col(f)[f].alias(f) for f in FIELDS])


def osm_fill(companies: DataFrame, places: DataFrame, loose: bool = True) -> DataFrame:
    """Fill from a map extract: per field the first value of the places with the company's name, or with ``loose`` one like it (see ``osm_matches``). Complete rows are left alone."""
    open_ = companies.where(F.col("website").isNull() | F.col("phone").isNull() | F.col("email").isNull())
    own, theirs = keys_of(open_, places)
    alike = staged(alike_candidates(own, theirs)).where(_ratio("key", "_key") >= LIKE) if loose else None
    return fill(companies, first_values(own, theirs, alike), FIELDS, "OpenStreetMap")


def register_fill(companies: DataFrame, matches: DataFrame) -> DataFrame:
    """The register's record beside each company, and its address where none is known."""
    record = matches.select("company_id", "registered_address", *[F.col(c).alias(f"register_{c}") for c in ("name", "company_number", "current_status", "source", "match_confidence")])
    filled = fill(companies, record, ("registered_address",), "registry")
    return filled.join(record.drop("registered_address"), "company_id", "left")


def merge_best(companies: DataFrame) -> DataFrame:
    """Adds ``best``, ``best_source`` (maps) and ``missing``.

    ``companies``: website, phone, email, socials (array), filled_from (map); and from the site profile ``emails``
    (array of email, on_company_domain), ``phones`` (array of raw, e164, valid), ``people`` (array of name), ``social`` (map).
    """
    own_mail = F.coalesce(F.get(F.filter("emails", lambda e: e["on_company_domain"]), F.lit(0)), F.get("emails", F.lit(0)))["email"]
    number = F.coalesce(F.get(F.filter("phones", lambda p: p["valid"]), F.lit(0)), F.get("phones", F.lit(0)))
    own_phone = F.coalesce(number["e164"], number["raw"])
    listing = lambda f: F.coalesce(F.try_element_at("filled_from", F.lit(f)), F.lit("listing"))
    pick = [
        ("website", F.col("website"), listing("website")),
        ("email", F.coalesce(own_mail, "email"), F.when(own_mail.isNotNull(), "website").otherwise(listing("email"))),
        ("phone", F.coalesce(own_phone, "phone"), F.when(own_phone.isNotNull(), "website").otherwise(listing("phone"))),
        ("contact_person", F.get("people", F.lit(0))["name"], F.lit("website")),
    ]
    for network in SOCIAL:
        seen = F.try_element_at("social", F.lit(network))
        listed = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.coalesce("socials", F.array().cast("array<string>")), lambda u: F.contains(u, F.lit(f"{network}.com")))), -1)
        pick.append((f"social_{network}", F.coalesce(seen, listed), F.when(seen.isNotNull(), "website").otherwise("listing")))
    rows = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.nullif(v, F.lit("")).alias("v"), s.alias("s")) for k, v, s in pick]), lambda x: x["v"].isNotNull())
    out = companies.withColumn("_picked", rows)
    chosen = F.transform("_picked", lambda x: x["k"])
    best = F.map_from_arrays(chosen, F.transform("_picked", lambda x: x["v"]))
    source = F.map_from_arrays(chosen, F.transform("_picked", lambda x: x["s"]))
    missing = F.array_except(F.array(*map(F.lit, ("website", "email", "phone", "contact_person"))), chosen)
    return out.withColumns({"best": best, "best_source": source, "missing": missing}).drop("_picked")


def pick_alternate(companies: DataFrame, log: DataFrame) -> DataFrame:
    """(company_id, url, tried): the first readable of a company's address and its other spellings, in order. ``log``: url, status."""
    own = U.origin_of(F.col("website"))
    tried = companies.where("website is not null").select("company_id", F.posexplode(F.concat(F.array(own), U.alternate_urls(own))).alias("tried", "url"))
    readable = log.where("status between 200 and 399").select(U.origin_of(F.col("url")).alias("url")).distinct()
    return tried.join(readable, "url", "left_semi").groupBy("company_id").agg(F.min_by("url", "tried").alias("url"), F.min("tried").alias("tried"))
