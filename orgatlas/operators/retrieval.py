"""Ranked retrieval of names: an inverted index with impact-ordered postings and block maxima, and the best k records of every query.

Records with the same words are one entry of the index, in every scope, so copies cost no reading. A record's terms are its words and, of words in more than ``many`` names, their pairs. The postings of a term are ordered by the
length of the record's weight vector, which is the order of their impact, and cut into blocks of ``BLOCK``; a block's least length is the bound of all that it holds. Every record is
posted under its country and under no country, so that "the best in the country" and "the best anywhere" are lists of their own.

Queries with the same words are one query. All are answered together, in rounds: all blocks of rare terms and the first block of each frequent one are joined by equality and scored whole (a posting
carries the record's words); a query is done when no record further down its lists can pass its k-th score. A record that was not read has none of the query's rare words (their lists
are read whole in the first round); it has one frequent word, and then no more than that word's share, or several, and then it stands further down in the list of a pair.
Only the queries that are left read on, twice as far each round. Nothing is cut off: rounds end when every list is bounded or read.

The score is the cosine of the weight vectors, rounded to nine digits; a word in n of N names weighs ln(1 + N / n). Equal scores are ordered by id among the records that were read.
Nulls: names without words (null ones too) have no postings and find nothing; a null country is only searched and found anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgatlas.functions.similarity import register_key
from orgatlas.sources.staging import looked_up, numbered, staged

#: Postings of a rare term's block, and of a frequent one's at least; parts that the queries of a frequent term are dealt into.
BLOCK, LEAST_BLOCK, SALTS = 64, 8, 16
ANYWHERE = ""


@dataclass
class NameIndex:
    """terms: token, n, weight; blocks: scope, term, block, least_norm, often, postings (norm, entry, tokens); members: scope, entry, record_id; ``many``: names beyond which a word counts as frequent;
    ``deepest``: the last block that any term has. An entry is the least record_id of its scope with the same words."""

    terms: DataFrame
    blocks: DataFrame
    members: DataFrame
    many: int
    deepest: int


def words(name: Column) -> Column:
    """The different words of a name, sorted."""
    return F.sort_array(F.array_distinct(F.filter(F.split(register_key(name), " "), lambda w: w != "")))


def weighted(rows: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, own): the words of ``tokens`` that the index knows, as an array of token, weight, n; rows without any are left out."""
    long = rows.select(key, F.explode("tokens").alias("token"))
    asked = staged(long.groupBy("token").agg(F.count("*").alias("asked")).join(terms, "token"))
    found = looked_up(long, asked, ["token"], "asked", F.col(key)).where("weight is not null")
    return found.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("token", "weight", "n"))).alias("own"))


def norm(own: str) -> Column:
    return F.sqrt(F.aggregate(own, F.lit(0.0), lambda acc, t: acc + t["weight"] * t["weight"]))


def terms_of(own: str, many: int) -> Column:
    """Terms of a record or query: (term, often, part), part being the weight that an unread record of the term's list can share."""
    often = F.filter(own, lambda t: t["n"] > many)
    square = lambda t: t["weight"] * t["weight"]
    every = F.aggregate(often, F.lit(0.0), lambda acc, t: acc + square(t))
    single = F.transform(own, lambda t: F.struct(t["token"].alias("term"), (t["n"] > many).alias("often"), square(t).alias("part")))
    pairs = F.flatten(F.transform(often, lambda a, i: F.transform(F.filter(often, lambda b: b["token"] > a["token"]), lambda b: F.struct(F.concat_ws(" ", a["token"], b["token"]).alias("term"), F.lit(True).alias("often"), every.alias("part")))))
    kind = "array<struct<term: string, often: boolean, part: double>>"
    return F.concat(single.cast(kind), pairs.cast(kind))


def first_blocks(many: int) -> int:
    """Blocks that hold the whole list of a rare term."""
    return max(1, -(-many // BLOCK))


def build_index(records: DataFrame, many: int = 1_000) -> NameIndex:
    """Index of ``records``: record_id, name, country."""
    named = records.select("record_id", F.lower("country").alias("country"), words(F.col("name")).alias("tokens")).where(F.size("tokens") > 0)
    rows = staged(named.groupBy("record_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("tokens"), F.collect_set("country").alias("countries")))
    total = rows.count()
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    terms = staged(counts.withColumn("weight", F.log(1 + F.lit(float(total)) / F.col("n"))))
    scoped = rows.select("record_id", "tokens", F.explode(F.array_distinct(F.concat(F.array(F.lit(ANYWHERE)), "countries"))).alias("scope"))
    entries = staged(scoped.groupBy("scope", "tokens").agg(F.min("record_id").alias("entry"), F.count("*").alias("records")))
    members = staged(looked_up(scoped, entries, ["scope", "tokens"], "records", F.col("record_id")).select("scope", "entry", "record_id"))
    own = weighted(entries.select("entry", "tokens").distinct(), terms, "entry").join(entries, "entry")
    posted = own.select("entry", "records", F.round(norm("own"), 9).alias("norm"), "tokens", "scope", terms_of("own", many).alias("terms"))
    posted = posted.select("entry", "records", "norm", "tokens", "scope", F.inline("terms")).drop("part")
    placed = numbered(posted, ["scope", "term"], ["norm", "entry"]).withColumn("block", F.floor((F.col("pos") - 1) / F.when(F.col("often"), max(LEAST_BLOCK, BLOCK // first_blocks(many))).otherwise(BLOCK)).cast("int"))
    blocks = placed.groupBy("scope", "term", "block").agg(F.min("norm").alias("least_norm"), F.first("often").alias("often"), F.sort_array(F.collect_list(F.struct("norm", "entry", "tokens", "records"))).alias("postings"))
    blocks = staged(blocks)
    return NameIndex(terms, blocks, members, many, blocks.agg(F.max("block")).first()[0] or 0)


def _read(active: DataFrame, index: NameIndex, low: int, high: int, k: int, least: float, before: DataFrame | None) -> DataFrame:
    """The k best entries of each active query among those of blocks ``low`` to ``high`` and those found before."""
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("query"), F.lit(SALTS)).cast("int")).otherwise(0)
    asked = active.select("query", "scope", "own", "norm", F.inline("terms")).withColumn("salt", salt).drop("often", "part").withColumnRenamed("norm", "query_norm")
    part = index.blocks.where((F.col("block") >= low) & (F.col("block") < high))
    part = part.select("scope", "term", "postings", F.explode(F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    hits = asked.join(part, ["scope", "term", "salt"]).select("query", "scope", "own", "query_norm", F.inline("postings"))
    met = F.filter("own", lambda t: F.array_contains(F.col("tokens"), t["token"]))
    product = F.aggregate("met", F.lit(0.0), lambda acc, t: acc + t["weight"] * t["weight"])
    common = F.size(F.filter("met", lambda t: t["n"] > index.many))
    telling = F.size("met") - common + (common * (common - 1) / 2).cast("int")
    scored = hits.withColumn("met", met).select("query", "scope", "entry", "records", F.round(product / (F.col("query_norm") * F.col("norm")), 9).alias("score"), F.size("met").alias("shared"), telling.alias("telling")).where(F.col("score") >= least)
    every = scored if before is None else scored.unionByName(before.select(*scored.columns))
    best = every.groupBy("query", "scope", "entry").agg(F.max("records").alias("records"), F.max("score").alias("score"), F.max("shared").alias("shared"), F.max("telling").alias("telling"))
    return staged(best.withColumn("ord", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("entry")))).where(F.col("ord") <= k))


def _unfinished(active: DataFrame, index: NameIndex, high: int, k: int, least: float, best: DataFrame) -> DataFrame:
    """The active queries for which a block from ``high`` on may hold a better record."""
    before = F.coalesce(F.sum("records").over(Window.partitionBy("query").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of k entries at most
    reached = best.withColumn("_before", before).where(F.col("_before") < k).groupBy("query").agg(F.when(F.sum("records") >= k, F.min("score")).otherwise(least).alias("reached"))
    fronts = index.blocks.where(F.col("block") == high).select("scope", "term", "least_norm")
    further = active.select("query", "scope", "norm", F.inline("terms")).join(fronts, ["scope", "term"])  # one row per term
    bound = further.groupBy("query").agg(F.max(F.col("part") / (F.col("norm") * F.col("least_norm"))).alias("bound"))
    return active.join(bound.join(reached, "query", "left").where(F.round("bound", 9) > F.coalesce("reached", F.lit(least))).select("query"), "query", "left_semi")


def _records(best: DataFrame, index: NameIndex, k: int) -> DataFrame:
    """The k best records of each query from its k best entries: of an entry the k least ids, and among equal scores the least of all."""
    best = staged(best)
    wanted = staged(best.groupBy("scope", "entry").agg(F.count("*").alias("asked")))
    place = F.row_number().over(Window.partitionBy("scope", "entry").orderBy("record_id"))
    firsts = index.members.join(wanted, ["scope", "entry"]).withColumn("_place", place).where(F.col("_place") <= k)
    lists = staged(firsts.groupBy("scope", "entry").agg(F.first("asked").alias("asked"), F.collect_list("record_id").alias("ids")))  # k of an entry
    rows = looked_up(best, lists.select("scope", "entry", "asked", "ids"), ["scope", "entry"], "asked", F.col("query"))
    rows = rows.select("query", F.explode("ids").alias("record_id"), "score", "shared", "telling")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("record_id")))).where(F.col("ord") <= k)


def best_records(queries: DataFrame, index: NameIndex, k: int = 10, least: float = 0.0) -> DataFrame:
    """(query, record_id, score, shared, telling, ord): the k best records of each query (query, scope, tokens) among those with a score of ``least`` or more."""
    own = weighted(queries, index.terms, "query").join(queries.select("query", "scope"), "query")
    active = staged(own.select("query", "scope", "own", norm("own").alias("norm"), terms_of("own", index.many).alias("terms")))
    low, high, done, before = 0, first_blocks(index.many), None, None
    while True:
        best = _read(active, index, low, high, k, least, before)
        if high > index.deepest:  # all is read
            return _records(best if done is None else done.unionByName(best), index, k)
        rest = staged(_unfinished(active, index, high, k, least, best))
        left = rest.select("query")
        settled = best.join(left, "query", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if rest.isEmpty():
            return _records(done, index, k)
        active, before, low, high = rest, best.join(left, "query", "left_semi"), high, 2 * high


def search_names(companies: DataFrame, records: DataFrame, k: int = 10, many: int = 1_000, least: float = 0.0) -> DataFrame:
    """(company_id, scope, record_id, score, shared, telling, ord): the k best records in a company's country (scope: the country) and the k best anywhere (scope '').

    ``companies``: company_id, name, country; ``records``: record_id, name, country. shared: words in common; telling: of the terms in common, those that are
    no frequent word by itself.
    """
    index = build_index(records, many)
    rows = companies.select("company_id", F.lower("country").alias("country"), words(F.col("name")).alias("tokens")).where(F.size("tokens") > 0)
    scopes = F.when(F.coalesce("country", F.lit(ANYWHERE)) == ANYWHERE, F.array(F.lit(ANYWHERE))).otherwise(F.array(F.lit(ANYWHERE), F.col("country")))
    asked = staged(rows.select("company_id", "tokens", F.explode(scopes).alias("scope")).withColumn("query", F.concat_ws(" ", F.concat("scope", F.lit(":")), F.array_join("tokens", " "))))
    queries = staged(asked.groupBy("query", "scope", "tokens").agg(F.count("*").alias("companies")))
    found = best_records(queries.drop("companies"), index, k, least).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("ord", "record_id", "score", "shared", "telling"))).alias("found"))  # k of a query
    facts = staged(found.join(queries.select("query", "companies"), "query"))
    return looked_up(asked.select("company_id", "scope", "query"), facts, ["query"], "companies", F.col("company_id")).select("company_id", "scope", F.inline("found")).select("company_id", "scope", "record_id", "score", "shared", "telling", "ord")
