"""Personal data: exact patterns for protected entities, and terms that reveal them.

Protected entities (e-mail addresses, IP addresses, card and phone numbers) are found by patterns with
their positions. For each pair of entity and term the corpus tells how strongly the term reveals the
entity: by how much seeing the term in a text lowers the surprise at the entity, as a share of the
entity's own information content. All counts are of different texts, so copies count once: texts with
the entity, with the term, with both, and all. A term counts wherever it stands in a text that holds
the entity, but for the words of entities themselves. What a term reveals it reveals in any text, so all
texts are searched, with or without entities: terms that reveal some entity at or above ``DISCLOSING``
are generalised to the one class of revealing terms (``<term>``), those at or above ``REVEALING`` removed.

Everything is DataFrame functions: no Python runs on the executors. The patterns never go back over
characters they have taken, and positions are running sums over what stands between the matches, so
the work is linear in the length of a text. Each different text is moved and written once, and its words are
counted and looked up where it lies, so words are never moved while Spark can broadcast the revealing terms. Entities,
terms and texts that very many rows share are counted with partial aggregation, and joins on them are salted.

Defined results: null texts are empty; rows with equal text are treated alike, whatever their doc_id
(null too); other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgatlas.llm.shared import let, materialize, salted

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
NAMES = (*KINDS, "term")
#: Least number of different texts with an entity, and with it and a term, before the term is rated.
LEAST_TEXTS = 3
#: Pseudo-count of the rate of an entity among texts with a term: a few chance meetings reveal nothing.
PRIOR = 2.0
DISCLOSING = 0.8
REVEALING = 0.95

#: The patterns (Java), possessive. A match can begin where a run of its characters begins or the last
#: match ended. The card pattern takes whole digit chains of 12 to 19 digits only.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"\p{L}++"
LEAST_LETTERS = 4
#: Elements that a running total handles at once.
BLOCK = 128
#: Characters of the blocks that a text is cut into, so that a piece of it is found without a scan.
TEXT_BLOCK = 256


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """The weighted digit sum of a string of digits is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits(number)), ""), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(F.filter(each, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def valid_ip(address: Column) -> Column:
    parts = F.transform(F.split(address, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))


def running(values: Column, merge) -> Column:
    """What an associative ``merge`` makes of the first 1, 2, ... elements of an array of integers; blocks keep the copying linear."""

    def totals(block: Column, first: Column) -> Column:
        return F.aggregate(block, F.array(first), lambda acc, v: F.concat(acc, F.array(merge(F.element_at(acc, -1), v))))

    def scan(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), merge))
        return let(totals(sums, F.lit(0)), lambda before: F.flatten(F.transform(blocks, lambda block, b: F.slice(totals(block, F.get(before, b)), 2, BLOCK))))

    def cut(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, BLOCK))
        return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(let(blocks, scan))

    return let(values, cut)


def spans_of(text: Column, pattern: str, kind: int, valid=None) -> Column:
    """(start, kind, end, value) of every match of ``pattern`` that is valid, in code points."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def place(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        ends = running(F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i))), lambda a, v: a + v)
        spans = F.transform(F.arrays_zip(ends.alias("end"), found.alias("value")), lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
        return F.filter(spans, lambda s: valid(s["value"])) if valid else spans

    return let(F.struct(matches.alias("found"), between.alias("gaps")), place)


def entity_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind. A cheap look for a needed character comes first."""
    none = F.array().cast("array<struct<start: int, kind: int, end: int, value: string>>")

    def length_between(low: int, high: int):
        return lambda m: F.length(digits(m)).between(low, high)

    found = F.concat(
        F.when(F.contains(text, F.lit("@")), spans_of(text, EMAIL, 0)).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), spans_of(text, IP, 1, valid_ip)).otherwise(none),
        F.when(text.rlike(CARD), spans_of(text, CARD, 2, passes_luhn)).otherwise(none),
        F.when(text.rlike(r"\+[0-9]"), spans_of(text, PHONE, 3, length_between(9, 15))).otherwise(none),
    )
    return F.sort_array(found)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, cuts: Column, put) -> Column:
    """``text`` with ``put(cut, at)`` in place of each of ``cuts`` (sorted by start); ``at`` is where the earlier ones end."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{TEXT_BLOCK}}}+"), F.lit(0))

    def build(x: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / TEXT_BLOCK).cast("int")
            some = F.slice(x["blocks"], first + 1, F.greatest(F.lit(0), F.floor((b - 1) / TEXT_BLOCK).cast("int") - first + 1))
            return F.when(b > a, F.substring(F.array_join(some, ""), a % TEXT_BLOCK + 1, b - a)).otherwise("")

        def one(cut: Column, i: Column) -> Column:
            at = F.when(i == 0, F.lit(0)).otherwise(F.get(x["ends"], i - 1))
            return F.concat(piece(at, cut["start"]), put(cut, at))

        return F.concat(F.array_join(F.transform(cuts, one), ""), piece(F.get(x["ends"], F.size(cuts) - 1), F.length(text)))

    ends = running(F.transform(cuts, lambda c: c["end"]), lambda a, v: F.greatest(a, v))
    return F.when(F.size(cuts) == 0, text).otherwise(let(F.struct(blocks.alias("blocks"), ends.alias("ends")), build))


def body_of(text: Column) -> Column:
    """What tells texts apart."""
    return F.xxhash64(text)


def long_words(text: Column) -> Column:
    """Hashes of the different words of a text with enough letters."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    return F.transform(F.filter(words, lambda w: F.length(w) >= LEAST_LETTERS), lambda w: F.xxhash64(w))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, body, base spans, and for texts with entities these (normalised) and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", entity_spans(F.col("text")).alias("found"))

    def entity(s: Column) -> Column:
        return F.concat(s["kind"].cast("string"), F.lit(":"), F.when(s["kind"] >= 2, digits(s["value"])).otherwise(F.lower(s["value"])))

    spans = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.select("doc_id", body_of(F.col("text")).alias("body"), spans.alias("spans"), F.array_distinct(F.transform("found", entity)).alias("entities"), F.when(F.size("found") > 0, F.col("text")).alias("held"))


def texts_with_entities(found: DataFrame) -> DataFrame:
    """One row per different text with entities; ``plain`` has blanks in place of these."""
    units = found.where("held is not null").groupBy("body").agg(F.first("spans").alias("spans"), F.first("entities").alias("entities"), F.first("held").alias("held"))
    blanks = lambda s, at: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], at)))
    return units.withColumn("plain", replaced(F.col("held"), F.col("spans"), blanks))


def disclosing_terms(texts: DataFrame, units: DataFrame, total: int) -> DataFrame:
    """(entity, term, disclosure): hashes of terms that reveal an entity, from counts over all different texts."""
    entities = units.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).where((F.col("n_entity") >= LEAST_TEXTS) & (F.col("n_entity") < total))
    holders = salted(units.select("body", "plain", F.explode("entities").alias("entity")), materialize(entities), ["entity"], F.col("body"))
    pairs = holders.select("entity", "n_entity", F.explode(long_words(F.col("plain"))).alias("term")).groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both"))
    pairs = materialize(pairs.where(F.col("n_both") >= LEAST_TEXTS))
    words = texts.select(F.explode(long_words(F.col("text"))).alias("term"))
    # written before the join: a filter by the candidate terms would only be small enough to move below this count on small inputs
    common = materialize(words.groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= LEAST_TEXTS))
    common = common.join(pairs.select("term").distinct(), "term", "left_semi")
    share = F.col("n_entity") / F.lit(float(total))
    rate = (F.col("n_both") + PRIOR * share) / (F.greatest("n_term", "n_both") + PRIOR)
    rated = salted(pairs, materialize(common), ["term"], F.xxhash64("entity")).select("entity", "term", (F.log(rate / share) / -F.log(share)).alias("disclosure"))
    return rated.where(F.col("disclosure") >= DISCLOSING)


def different_texts(docs: DataFrame) -> DataFrame:
    """(body, text): each different text once, however many copies it has."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(body_of(text).alias("body"), text.alias("text")).groupBy("body").agg(F.first("text").alias("text"))


def spots(plain: Column, hits: Column) -> Column:
    """(start, kind, end, disclosure) of every word of ``plain`` that is one of ``hits`` (term, disclosure); these are cut into parts by term, so that a word meets few."""
    parts = F.ceil(F.sqrt(F.size(hits))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), parts - 1), lambda part: F.filter(hits, lambda h: F.pmod(h["term"], parts) == part))

    def rate(parted: Column) -> Column:
        def one(s: Column) -> Column:
            own = let(F.xxhash64(F.lower(s["value"])), lambda term: F.get(F.filter(F.get(parted, F.pmod(term, F.size(parted)).cast("int")), lambda h: h["term"] == term), F.lit(0)))
            return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), own["disclosure"].alias("disclosure"))

        return F.filter(F.transform(spans_of(plain, WORD, TERM), one), lambda s: s["disclosure"].isNotNull())

    return let(cut, rate)


def revealing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(body, spans, held, terms) of every text with entities or terms that reveal one; ``terms`` are (start, kind, end, disclosure), or null."""
    texts, units = materialize(different_texts(docs)), materialize(texts_with_entities(found))
    terms = disclosing_terms(texts, units, texts.count())
    terms = materialize(terms.groupBy("term").agg(F.max("disclosure").alias("disclosure")))

    def hits(rows: DataFrame, text: str) -> DataFrame:
        words = rows.select("body", F.explode(long_words(F.col(text))).alias("term"))
        return salted(words, terms, ["term"], F.col("body")).groupBy("body").agg(F.collect_list(F.struct("term", "disclosure")).alias("hits"))

    own = units.join(hits(units, "plain").hint("merge"), "body", "left").select("body", "spans", "held", "plain", "hits")
    others = materialize(hits(texts, "text").join(units.select("body"), "body", "left_anti"))
    more = texts.join(others, "body").select("body", F.array().cast(units.schema["spans"].dataType).alias("spans"), F.col("text").alias("held"), F.col("text").alias("plain"), "hits")
    return own.unionByName(more).select("body", "spans", "held", F.when(F.col("hits").isNotNull(), spots(F.col("plain"), F.col("hits"))).alias("terms"))


def clean(text: Column, spans: Column, terms: Column) -> Column:
    """Entities become their kind, terms the class of terms, and terms that reveal most are left out."""
    both = F.sort_array(F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("double").alias("disclosure"))), F.coalesce(terms, F.array().cast("array<struct<start: int, kind: int, end: int, disclosure: double>>"))))
    names = F.array(*[F.lit(f"<{n}>") for n in NAMES])

    def put(s: Column, at: Column) -> Column:
        label = F.when(s["disclosure"] >= REVEALING, "").otherwise(F.get(names, s["kind"]))
        return F.when(s["start"] >= at, label).otherwise("")

    return let(both, lambda cuts: replaced(text, cuts, put))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document the counts and digest of the base kinds, all spans, how many terms are generalised and removed, and the digest of what is left."""
    found = materialize(scanned(docs))
    units = revealing(docs, found)
    every = F.sort_array(F.concat("spans", F.coalesce(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))), F.array().cast("array<struct<start: int, kind: int, end: int>>"))))
    removed = F.coalesce(F.size(F.filter("terms", lambda s: s["disclosure"] >= REVEALING)), F.lit(0))
    extra = units.select(
        "body",
        joined(every).alias("all_spans"),
        removed.cast("long").alias("n_removed"),
        (F.coalesce(F.size("terms"), F.lit(0)) - removed).cast("long").alias("n_generalised"),
        F.sha2(clean(F.col("held"), F.col("spans"), F.col("terms")), 256).alias("clean_sha256"),
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    rows = found.select("doc_id", "body", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(joined(F.col("spans")), 256).alias("base_sha256"))
    shared = ["doc_id", *[f"n_{name}" for name in KINDS], "base_sha256"]
    zero = F.lit(0).cast("long")
    both = salted(rows, materialize(extra), ["body"], F.xxhash64("doc_id"), "left")
    return both.select(*shared, F.coalesce("all_spans", F.lit("")).alias("spans"), F.coalesce("n_generalised", zero).alias("n_generalised"), F.coalesce("n_removed", zero).alias("n_removed"), "clean_sha256")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with entities and revealing terms in ``text`` generalised or removed; rows and columns stay."""
    units = revealing(docs, materialize(scanned(docs)))
    put = units.select(F.col("body").alias("own_body"), clean(F.col("held"), F.col("spans"), F.col("terms")).alias("own_text"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body, row = F.struct(*[F.col(c) for c in docs.columns]), body_of(text)
    rows = docs.select(body.alias("own_row"), row.alias("own_body"))
    both = salted(rows, materialize(put), ["own_body"], F.xxhash64("own_row.doc_id"), "left")
    return both.select(*[F.coalesce("own_text", "own_row.text").alias(c) if c == "text" else F.col("own_row")[c].alias(c) for c in docs.columns])
