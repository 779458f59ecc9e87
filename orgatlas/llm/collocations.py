"""Phrases that belong together, mined from stripes: each prefix keys an associative counter of the words that follow it.

Level by level: the empty prefix counts single words, prefixes of one word what follows it, prefixes of two words what follows those. Tasks count in blocks
of about ``BLOCK_BYTES`` of text (numbers for words, sorted runs of numbers for phrases) and hand on one stripe for each prefix of a block; stripes of a
prefix meet in one partition and are added element by element there. A merged stripe holds the counts of the extensions of its prefix (the candidates), the prefix's own total, and
in its largest extension what may subsume the prefix.

What cannot become a candidate is not told apart: a phrase with ``least`` occurrences has only parts with as many, so a prefix counts only if it has them, and a next word
that does not complete such a part is left out of the stripe, whose total is kept beside its counts. Tasks know frequent parts by a bit filter of fixed size (``FILTER_BITS``); where it errs a count
is kept that is dropped after merging. Stripes of prefixes that hold a thousandth of all words or more (at most a thousand a level, and the empty one) are split by their next word.

Scores are exact: counts up to 10**13 are multiplied as 38-digit decimals. A language's best are ranked in two steps, so no task sorts all of them.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count again; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgatlas.llm.shared import HOT_KEYS, looked_up, materialize, sliced

#: Characters that end a piece, and that part words inside one; in a block both kinds become one byte each.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
ONE_KIND = bytes.maketrans(ENDS + b"\t", b"." * len(ENDS) + b" ")
#: Text that is counted at once.
BLOCK_BYTES = 12_000_000
#: Bits of the filter of frequent parts, and how many of them a part sets.
FILTER_BITS, PLACES = 26, 3
#: Parts that stripes of frequent prefixes are split into.
SHARDS = 64
#: Parts that the candidates of a language are ranked in at first.
RANKED_IN = 64
STRIPES = "lang string, prefix string, shard int, total long, next array<string>, counts array<long>"


def mixed(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of each phrase that is one word longer."""
    total = hashes * np.uint64(0x9E3779B97F4A7C15) + (more ^ (more >> np.uint64(31)))
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode(), 13)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def bit_places(hashes: np.ndarray, filter_bits: int) -> list[np.ndarray]:
    steps = [np.uint64(k * (64 - filter_bits) // (PLACES - 1)) for k in range(PLACES)]
    return [(hashes >> step) & np.uint64((1 << filter_bits) - 1) for step in steps]


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), dtype=bool)
    for place in bit_places(hashes, (64 * len(bits)).bit_length() - 1):
        out &= ((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def phrase_hashes(lang: str, phrases: list[str]) -> np.ndarray:
    """Hashes of phrases of equally many words."""
    columns = [word_hashes(lang, list(words)) for words in zip(*(p.encode().split(b" ") for p in phrases), strict=True)]
    hashes = columns[0]
    for more in columns[1:]:
        hashes = mixed(hashes, more)
    return hashes


def _bits(batches: Iterator[pa.RecordBatch], filter_bits: int) -> Iterator[pa.RecordBatch]:
    """Bits that the phrases (lang, phrase) of a table set."""
    for batch in sliced(batches, 100_000):
        by_lang = defaultdict(list)
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang[lang].append(phrase)
        for lang, phrases in by_lang.items():
            places = np.unique(np.concatenate(bit_places(phrase_hashes(lang, phrases), filter_bits)))
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], ["word", "bits"])


def bit_filter(phrases: DataFrame, filter_bits: int) -> np.ndarray:
    """The filter over (lang, phrase) rows: as many bits at any size."""
    words = phrases.select("lang", "phrase").mapInArrow(lambda batches: _bits(batches, filter_bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (filter_bits - 6), dtype=np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[str, bytes]]:
    """(lang, text) in blocks; each text is followed by an end of a piece, and a very long one is cut at such ends only."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in sliced(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = (text or "").encode().lower().translate(ONE_KIND)
            start = 0
            while len(data) - start > block_bytes and (cut := data.find(b".", start + block_bytes // 2)) >= 0:
                yield lang, data[start:cut]
                start = cut + 1
            held[lang].append(data[start:])
            size += len(data) - start
            if size > block_bytes:
                yield from ((own, b".".join(texts)) for own, texts in held.items())
                held, size = defaultdict(list), 0
    yield from ((own, b".".join(texts)) for own, texts in held.items())


def coded(block: bytes) -> tuple[np.ndarray, pa.Array, int]:
    """Numbers of the words of a block, the words, and the number that stands for the end of a piece."""
    parts = pc.list_flatten(pc.split_pattern(pa.array([b". " + block.replace(b".", b" . ") + b" ."], pa.large_binary()), pattern=b" "))
    known = parts.filter(pc.greater(pc.binary_length(parts), 0)).dictionary_encode()
    codes = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, known.dictionary.cast(pa.string()), int(codes[0])


def stripes_of(lang: str, block: bytes, words: int, bits: np.ndarray | None, hot: np.ndarray) -> pa.RecordBatch:
    """The stripes of a block for prefixes of ``words`` words: how often the prefix stands there, and what follows it how often."""
    codes, vocabulary, end = coded(block)
    own = word_hashes(lang, [w.encode() for w in vocabulary.to_pylist()])
    hashes, ends, size = own[codes], codes == end, max(0, len(codes) - words)
    inside = ~ends[:size]
    phrase = hashes[:size]
    for k in range(1, words):
        phrase, inside = mixed(phrase, hashes[k : k + size]), inside & ~ends[k : k + size]
    at = np.flatnonzero(inside)
    follow = ~ends[at + words]
    if words:
        at = at[passes(phrase[at], bits)]
        tail = hashes[at + 1]
        for k in range(2, words + 1):
            tail = mixed(tail, hashes[at + k])
        follow = ~ends[at + words] & passes(tail, bits)  # the last words of a longer phrase must be frequent as well
    split = np.isin(phrase[at], hot) if words else np.ones(len(at), dtype=bool)
    shard = np.where(split, (hashes[at + words] % np.uint64(SHARDS)).astype(np.int64), 0)
    key = np.zeros(len(at), dtype=np.int64)
    for k in range(words):
        _, key = np.unique(key * len(vocabulary) + codes[at + k], return_inverse=True)
    _, first, stripe, totals = np.unique(key * SHARDS + shard, return_index=True, return_inverse=True, return_counts=True)
    pairs, counts = np.unique(stripe[follow] * len(vocabulary) + codes[at + words][follow], return_counts=True)
    offsets = pa.array(np.searchsorted(pairs, np.arange(len(totals) + 1) * len(vocabulary)).astype(np.int32))
    prefix = pa.array([""] * len(totals), pa.string())
    if words:
        prefix = pc.binary_join_element_wise(*[vocabulary.take(pa.array(codes[at[first] + k])) for k in range(words)], " ")
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(totals), pa.string()), prefix, pa.array(shard[first].astype(np.int32)), pa.array(totals.astype(np.int64)),
            pa.ListArray.from_arrays(offsets, vocabulary.take(pa.array(pairs % len(vocabulary)))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
        ],
        [part.split()[0] for part in STRIPES.split(", ")],
    )


def _stripes(batches: Iterator[pa.RecordBatch], words: int, bits: np.ndarray | None, hot: np.ndarray, block_bytes: int) -> Iterator[pa.RecordBatch]:
    for lang, block in blocks(batches, block_bytes):
        made = stripes_of(lang, block, words, bits, hot)
        yield from (made.slice(at, 20_000) for at in range(0, made.num_rows, 20_000))


def merged(stripes: DataFrame) -> DataFrame:
    """(lang, prefix, shard, next, f): stripes of a prefix added element by element; next '' is the prefix itself."""
    met = stripes.repartition("lang", "prefix", "shard")
    whole = F.array(F.struct(F.lit("").alias("next"), F.col("total").alias("f")))
    entries = met.select("lang", "prefix", "shard", F.inline(F.concat(whole, F.arrays_zip(F.col("next"), F.col("counts").alias("f")))))
    return entries.groupBy("lang", "prefix", "shard", "next").agg(F.sum("f").alias("f"))


def levels(docs: DataFrame, most_words: int, least: int, block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> list[DataFrame]:
    """For each length of prefix, from none: (lang, prefix, next, f) of the phrases with ``least`` occurrences or more, and of the prefixes themselves with next ''."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    context = docs.sparkSession.sparkContext
    sent, hot, out = None, np.zeros(0, dtype=np.uint64), []
    for words in range(most_words):

        def count(batches: Iterator[pa.RecordBatch], words: int = words, sent=sent, hot: np.ndarray = hot) -> Iterator[pa.RecordBatch]:
            return _stripes(batches, words, sent.value if sent else None, hot, block_bytes)

        found = materialize(merged(rows.mapInArrow(count, STRIPES)).where((F.col("f") >= least) | (F.col("next") == "")).drop("shard"))
        out.append(found)
        if words + 1 < most_words:
            often = found.where("next <> ''").select("lang", phrase(), "f")
            sent = context.broadcast(bit_filter(often, filter_bits))
            most = out[0].where("next = ''").agg(F.sum("f")).first()[0] or 0
            share = often.where(F.col("f") * HOT_KEYS >= most).select("lang", "phrase").collect()  # at most HOT_KEYS phrases
            hot = np.array(sorted(int(phrase_hashes(lang, [text])[0]) for lang, text in share), dtype=np.uint64)
    return out


def phrase() -> Column:
    return F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase")


def known(rows: DataFrame, column: str, counts: DataFrame, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in ``column``."""
    asked = rows.where(F.col(column).isNotNull()).groupBy("lang", column).agg(F.count("*").alias("asked"))
    facts = materialize(asked.join(counts.select("lang", F.col("phrase").alias(column), F.col("f").alias(name)), ["lang", column]))
    return looked_up(rows, facts, ["lang", column], "asked", F.col("phrase")).drop("asked")


def exact_score() -> Column:
    """floor(1000000 * a * a / (l * r)) of whole numbers up to 10**13."""
    return F.expr("(cast(a as decimal(13,0)) * cast(a as decimal(13,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(13,0)) * cast(r as decimal(13,0)))")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, top: int = 2000, subsumed: int = 50, block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``most_words`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase with ``least`` occurrences or more is a candidate; one is dropped if a longer candidate around it has ``subsumed`` percent of its occurrences or more.
    """
    found = levels(docs, most_words, least, block_bytes, filter_bits)
    entries = [level.where("next <> ''") for level in found]
    counts, longer = entries[0].select("lang", phrase(), "f"), None
    for level in entries[1:-1]:
        counts = counts.unionByName(level.select("lang", phrase(), "f"))
    candidates = None
    for level in range(1, most_words):
        whole = found[level].where("next = ''").groupBy("lang", "prefix").agg(F.sum("f").alias("l"))
        own = entries[level].withColumnRenamed("f", "a")
        own = own.select("lang", "prefix", "next", "a", phrase(), F.lit(level).alias("k")).join(whole, ["lang", "prefix"])
        candidates = own if candidates is None else candidates.unionByName(own)
        if level > 1:  # of the phrases one word longer, each holds two of this length
            tail = F.substring_index(phrase(), " ", -level)
            inside = entries[level].select("lang", F.explode(F.array(F.col("prefix"), tail)).alias("phrase"), "f")
            longer = inside if longer is None else longer.unionByName(inside)
    if longer is not None:
        around = longer.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
        candidates = candidates.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < subsumed * F.col("a"))).drop("around")
    whole = F.array(F.struct(F.col("k").alias("cut"), F.lit(None).cast("string").alias("left"), F.col("next").alias("right")))
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    inner = F.when(F.col("k") > 1, F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("cut"), part(F.lit(1), i).alias("left"), part(i + 1, F.col("k") + 1 - i).alias("right")))).otherwise(F.filter(whole, lambda _: F.lit(False)))
    cuts = materialize(candidates.select("lang", "phrase", "a", "l", F.inline(F.concat(whole, inner))))
    both = known(known(cuts, "right", counts, "r"), "left", counts, "other")
    both = both.withColumn("l", F.when(F.col("left").isNull(), F.col("l")).otherwise(F.col("other")))
    best = both.withColumn("score", exact_score()).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.score", "b.l", "b.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_IN)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = found[0].where("next = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS words FROM p),
o AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, unnest([1, 2, 3]) AS size, words, i FROM o),
f AS (SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM g WHERE i + size - 1 <= len(words) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE size > 1 AND f >= 10),
x AS (SELECT lang, unnest([words[1] || ' ' || words[2], words[2] || ' ' || words[3]]) AS phrase, a FROM c WHERE size = 3),
k AS (SELECT c.*, unnest(range(1, size)) AS cut FROM c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = c.lang AND x.phrase = c.phrase AND c.size = 2 AND 100 * x.a >= 50 * c.a)),
s AS (SELECT k.lang, k.phrase, k.a, cut, y.f AS l, z.f AS r, CAST(CAST(1000000 AS HUGEINT) * k.a * k.a // (CAST(y.f AS HUGEINT) * z.f) AS BIGINT) AS score FROM k
 JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(words[1:cut], ' ') JOIN f z ON z.lang = k.lang AND z.phrase = array_to_string(words[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM b)
SELECT lang, rank, phrase, a, l, r.r, CAST(n AS BIGINT) AS n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
