"""Near copies by exact word-shingle similarity: prefix filter, check of every link, components.

Two texts are near copies if the Jaccard similarity of their sets of ``SIZE``-word shingles is at least
0.8. The candidates lose no such pair: in any common order of all shingles, the first n - ceil(0.8 n) + 1
shingles of both texts share one. The order puts shingles that a sample finds often last, so that
common lines make few candidates; which ones the sample finds changes the work, never the result.

1. One map stage writes per row the hash of its text, its SimHash over the same shingles, the first shingles of its set, and a
   parity map: bit i tells whether an odd number of its shingles fall on i. Maps of two sets differ in at most as many bits as the
   sets differ in shingles, so too many bits rule 0.8 out.
2. Equal texts become one entry, with their least doc_id.
3. The Gray-order index of ``simhash`` gives the first candidates: entries whose fingerprints differ in at most three bits.
   At 0.8 fingerprints often differ in more, so entries that share one of their least shingle hashes are candidates
   too, with their neighbours by size: a few rows an entry that link most near copies. What follows finds the rest, exactly.
4. Entries that share a first shingle meet in one bucket, by size of the set. Sizes and positions that
   rule out 0.8 are dropped, and so are entries that are linked already. The first round pairs neighbours, and hands on the rows of a
   bucket that have an entry of fitting size, not linked with theirs yet, farther off.
5. Those rows get their maps, and all of a bucket whose maps allow 0.8 are partners. Each row is paired with its likest partner only,
   and rows with others are handed on. When links are known, the last round pairs what partners are left: each pair once, in the
   least bucket that both share. So a group of near copies costs rows in proportion to its size, besides pairs close to 0.8.
6. Every pair is checked, on the maps, then on the whole sets. Components are built on checked links only.

Defined results: words are cut at ASCII white space, A-Z in lower case; a text of at most ``SIZE`` words is one
shingle; null and empty texts are copies of each other; rows without doc_id take no part; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orgatlas.llm import simhash
from orgatlas.llm.components import components
from orgatlas.llm.shared import forget, looked_up, materialize, salted, sliced

SIZE = 5
#: Texts read for the order of shingles, and shingles kept from them: bounds of the work, not of the result.
SAMPLE_ROWS = 10_000
OFTEN, OFTEN_KEPT = 3, 100_000
WORDS_KEPT = 200_000
#: Distance in a bucket up to which the first round pairs entries, and further rounds in which each row has its likest partner before all meet that are left.
FIRST, FARTHER = 2, 1
#: Bits of a parity map, and pairs whose maps a worker compares at once.
MAP_BITS, MAPS_AT_ONCE = 2_048, 1 << 15
#: Least hashes of a set by which an entry is paired before all else: they decide how early links are found, not which.
EARLY = 4
#: So many entries at most are sent to all tasks, in place of moving the texts.
FEW = 200_000
FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3) ** 5) % (1 << 64) | 1) for i in range(SIZE)]
ROWS = "a long, b long, key long, n int, pos int, place int"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = self[word] = xxhash.xxh64_intdigest(word, 5)
        return got


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The set of shingles of a text, as sorted hashes."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(hashes) > WORDS_KEPT:
        hashes.clear()
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - SIZE + 1)
    total = np.full(n, min(len(words), SIZE), dtype=np.uint64)
    for i, factor in enumerate(FACTORS[: len(words)]):
        total += own[i : i + n] * factor
    total ^= total >> np.uint64(29)
    total *= FACTORS[0]
    return np.unique(total ^ (total >> np.uint64(32)))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def parity(own: np.ndarray) -> np.ndarray:
    """For each bit of a map, whether an odd number of shingles fall on it; as 64-bit words."""
    counts = np.bincount((own & np.uint64(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.where("doc_id is not null")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))


def _prints(batches: Iterator[pa.RecordBatch], often: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, e, n, keys, fp, least, map): keys are the first shingles by ``often`` and hash, or the whole set without it; then what follows is left out."""
    import xxhash

    hashes = WordHashes()
    for batch in sliced(batches):
        entries, sizes, keys, prints, least, maps = [], [], [], [], [], []
        for raw in batch.column(1).to_pylist():
            words = (raw or b"").lower().split()
            own = shingles(words, hashes)
            entries.append(xxhash.xxh64_intdigest(b" ".join(words), 42))
            sizes.append(len(own))
            prints.append(0 if often is None else simhash.fingerprint(words, SIZE))
            least.append([] if often is None else own[:EARLY].view(np.int64))
            maps.append([] if often is None else parity(own))
            if often is not None and len(own):
                known, counts = often
                rank = np.zeros(len(own), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, counts[at], 0)
                own = own[np.argsort(rank, kind="stable")[: prefix_length(len(own))]]
            keys.append(own.view(np.int64))
        offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(entries, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists, pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(least, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))], ["doc_id", "e", "n", "keys", "fp", "least", "map"])


PRINTS = "doc_id long, e long, n int, keys array<long>, fp long, least array<long>, map array<long>"


def often_found(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample holds several times, sorted, with their counts."""
    every = max(1, docs.count() // SAMPLE_ROWS)
    sample = _texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(lambda b: _prints(b, None), PRINTS)
    counts = sample.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN)
    rows = counts.orderBy(F.desc("c"), "key").limit(OFTEN_KEPT).collect()
    keys, c = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64), np.array([r[1] for r in rows], dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], c[order]


def _whole(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets, ``key`` first; rows come sorted by it. A bucket may span batches."""
    held = None
    for batch in batches:
        now = columns(batch)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        held = [x[last:] for x in now]
        if last:
            yield [x[:last] for x in now]
    if held is not None and len(held[0]):
        yield held


def _longs(batch: pa.RecordBatch, count: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(count)]


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of one key."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(key)])))


def _rows(a, b=None, key=None, n=None, pos=None, place=None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), k) if x is None else pa.array(x).cast(k) for x, k in zip((a, b, key, n, pos, place), kinds, strict=True)], ["a", "b", "key", "n", "pos", "place"])


def _pairs(batches: Iterator[pa.RecordBatch], low: int, high: int, hand_on: bool = True) -> Iterator[pa.RecordBatch]:
    """Pairs at a distance above ``low`` and up to ``high`` in their bucket, and the rows to hand on: with a partner farther off, fitting in size, with another label.

    Rows that are handed on meet all others of their bucket that are, so those are not paired here.
    Rows (key, n, pos, e, label, place) come sorted by key, place, n and e; ``place`` is that in the whole bucket, told by the first round.
    """

    def farther(starts: np.ndarray, sizes: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rows with a partner beyond ``high`` in their bucket: of another label, and of a size that fits. Of such partners the nearest fits best."""
        at, bucket = np.arange(len(n)), np.repeat(np.arange(len(starts)), sizes)
        begin, end = starts[bucket], (starts + sizes)[bucket]
        line = bucket * (int(place.max()) + high + 2) + place
        breaks = np.concatenate(([0], np.flatnonzero((label[1:] != label[:-1]) | (bucket[1:] != bucket[:-1])) + 1, [len(n)]))
        run = np.repeat(np.arange(len(breaks) - 1), np.diff(breaks))  # neighbours of one label

        after = np.searchsorted(line, line + high + 1)
        one = at[after < end]
        near = after[one]
        near = np.where(label[near] == label[one], breaks[run[near] + 1], near)
        one, near = one[near < end[one]], near[near < end[one]]
        ahead = one[(5 * n[one] >= 4 * n[near]) & (9 * (n[one] - pos[one]) >= 4 * (n[one] + n[near]))]

        before = np.searchsorted(line, line - high - 1, "right") - 1
        one = at[before >= begin]
        near = before[one]
        near = np.where(label[near] == label[one], breaks[run[near]] - 1, near)
        one, near = one[near >= begin[one]], near[near >= begin[one]]
        return np.union1d(ahead, one[5 * n[near] >= 4 * n[one]])

    for key, n, pos, e, label, place in _whole(batches, lambda batch: _longs(batch, 6)):
        starts, sizes = _bounds(key)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1  # entries after this one in its bucket
        if low == 0:
            place = np.arange(len(key)) - np.repeat(starts, sizes)
        later = np.zeros(len(key), dtype=bool)
        if hand_on:
            big = farther(starts, sizes, n, pos, label, place)
            later[big] = True
            if len(big):
                yield _rows(e[big], None, key[big], n[big], pos[big], place[big])
        first, step = np.flatnonzero(left > 0), 1
        while step <= high and len(first):
            first = first[(left[first] >= step)]
            # sizes and places only grow with the distance
            first = first[(5 * n[first] >= 4 * n[first + step]) & (place[first + step] - place[first] <= high)]
            second = first + step
            most = np.minimum(n[first] - pos[first], n[second] - pos[second])  # the shared shingle and what follows it
            keep = (label[first] != label[second]) & (9 * most >= 4 * (n[first] + n[second])) & (place[second] - place[first] > low) & ~(later[first] & later[second])
            a, b = e[first[keep]], e[second[keep]]
            if len(a):
                yield _rows(np.maximum(a, b), np.minimum(a, b))
            step += 1


def paired(rows: DataFrame, low: int, high: int) -> DataFrame:
    spread = rows.select("key", "n", "pos", "e", "label", "place").repartition("key").sortWithinPartitions("key", "place", "n", "e")
    return spread.mapInArrow(lambda batches: _pairs(batches, low, high), ROWS)


def close(rows: DataFrame) -> DataFrame:
    """Pairs of neighbours alone."""
    spread = rows.select("key", "n", "pos", "e", "label", "place").repartition("key").sortWithinPartitions("key", "n", "e")
    return spread.mapInArrow(lambda batches: _pairs(batches, 0, FIRST, False), ROWS).select("a", "b")


def _met(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Partners in a bucket: entries of different labels whose sizes and maps allow a link.

    Each row is paired with its likest partner, and rows with others are handed on; with ``last``, all partners are paired in the least of
    the ``keys`` that both rows have. Rows (key, n, e, label, map, keys) come sorted by key, n and e.
    """

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        maps = batch.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, MAP_BITS // 64)
        keys = np.fromiter((frozenset(k or ()) for k in batch.column(5).to_pylist()), dtype=object, count=batch.num_rows)
        return [*_longs(batch, 4), maps, keys]

    def partners(n: np.ndarray, label: np.ndarray, maps: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows that are partners, and in how many bits they differ; pairs of the label that most rows of a bucket have are never looked at."""
        order = np.lexsort((label, bucket))
        runs = np.flatnonzero(np.concatenate(([True], (label[order][1:] != label[order][:-1]) | (bucket[1:] != bucket[:-1]))))
        long = np.diff(np.concatenate((runs, [len(order)])))
        of = bucket[runs]
        largest = np.lexsort((long, of))
        largest = largest[np.flatnonzero(np.concatenate((of[1:] != of[:-1], [True])))]  # the last run of each bucket by length
        other = label != label[order[runs[largest]]][bucket]
        line = (bucket << 32) + n
        low, high = np.searchsorted(line, (bucket << 32) - (-4 * n // 5)), np.searchsorted(line, (bucket << 32) + 5 * n // 4, "right")
        own = np.flatnonzero(other)
        ends = np.concatenate(([0], np.cumsum(high[own] - low[own])))
        for at in range(0, int(ends[-1]), MAPS_AT_ONCE):
            flat = np.arange(at, min(at + MAPS_AT_ONCE, int(ends[-1])))
            which = np.searchsorted(ends, flat, "right") - 1
            first = own[which]
            second = low[first] + flat - ends[which]
            keep = (label[first] != label[second]) & (~other[second] | (second > first))
            first, second = first[keep], second[keep]
            apart = np.bitwise_count(maps[first] ^ maps[second]).sum(axis=1, dtype=np.int64)
            keep = 9 * apart <= n[first] + n[second]
            if keep.any():
                yield first[keep], second[keep], apart[keep]

    for key, n, e, label, maps, keys in _whole(batches, columns):
        starts, sizes = _bounds(key)
        bucket = np.repeat(np.arange(len(starts)), sizes)
        likest, partner, met = np.full(len(n), np.inf), np.full(len(n), -1), np.zeros(len(n), dtype=np.int64)
        for first, second, apart in partners(n, label, maps, bucket):
            if last:
                least = np.fromiter((min(keys[i] & keys[j]) for i, j in zip(first.tolist(), second.tolist(), strict=True)), dtype=np.int64, count=len(first))
                a, b = e[first[least == key[first]]], e[second[least == key[first]]]
                if len(a):
                    yield _rows(np.maximum(a, b), np.minimum(a, b))
                continue
            unlike = apart / (n[first] + n[second])
            for x, y in ((first, second), (second, first)):
                met += np.bincount(x, minlength=len(n))
                order = np.lexsort((y, unlike, x))
                best = order[np.concatenate(([True], x[order][1:] != x[order][:-1]))]
                best = best[unlike[best] < likest[x[best]]]
                likest[x[best]], partner[x[best]] = unlike[best], y[best]
        one = np.flatnonzero(partner >= 0)
        if not len(one):
            continue
        a, b = np.divmod(np.unique(np.maximum(one, partner[one]) * len(n) + np.minimum(one, partner[one])), len(n))
        yield _rows(np.maximum(e[a], e[b]), np.minimum(e[a], e[b]))
        more = np.flatnonzero(met > np.bincount(a, minlength=len(n)) + np.bincount(b, minlength=len(n)))
        if len(more):
            yield _rows(e[more], None, key[more], n[more])


def met(rows: DataFrame, first: DataFrame, last: bool) -> DataFrame:
    """``rows`` (key, n, e, label) with the maps that ``first`` has, paired in their buckets."""
    if last:
        maps = rows.groupBy("e").agg(F.collect_set("key").alias("keys")).join(first.select("e", "map"), "e")
    else:
        maps = first.select("e", "map", F.lit(None).cast("array<long>").alias("keys"))
    spread = rows.join(maps, "e").select("key", "n", "e", "label", "map", "keys").repartition("key").sortWithinPartitions("key", "n", "e")
    return spread.mapInArrow(lambda batches: _met(batches, last), ROWS)


def with_both(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) with what ``rows`` has on both entries, as structs x and y."""
    value = F.struct(*[c for c in rows.columns if c != "e"])
    return pairs.join(rows.select(F.col("e").alias("a"), value.alias("x")), "a").join(rows.select(F.col("e").alias("b"), value.alias("y")), "b")


def checked(pairs: DataFrame, first: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of entries whose whole sets are similar enough.

    Maps rule most others out. They say little on sets of more shingles than bits, which are ruled out by their first shingles: what
    both share is among the first shingles of both, or after those of the set whose first shingles end earlier.
    """
    shared = F.size(F.array_intersect("x.keys", "y.keys"))
    most = shared + F.greatest(F.col("x.n") - F.size("x.keys"), F.col("y.n") - F.size("y.keys"))
    apart = F.aggregate(F.zip_with("x.map", "y.map", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)
    known = first.select("e", "n", "map", F.when(F.col("n") > MAP_BITS, F.col("keys")).alias("keys"))
    both, short = F.col("x.n") + F.col("y.n"), F.col("x.keys").isNull() | F.col("y.keys").isNull()
    pairs = with_both(pairs.select("a", "b").distinct(), known).where((9 * apart <= both) & (short | (9 * most >= 4 * both)))
    pairs = materialize(pairs.select("a", "b"))
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("e")).distinct().join(first, "e").select("e", "doc_id"))
    few = F.broadcast(nodes) if nodes.count() <= FEW else nodes
    sets = _texts(docs).join(few.select("doc_id"), "doc_id", "left_semi").mapInArrow(lambda b: _prints(b, None), PRINTS)
    sets = materialize(sets.join(few, ["e", "doc_id"], "left_semi").select("e", "keys"))
    found = materialize(with_both(pairs, sets).where(9 * shared >= 4 * (F.size("x.keys") + F.size("y.keys"))).select("a", "b").distinct())
    forget(pairs, nodes, sets)
    return found


def by_fingerprint(first: DataFrame) -> DataFrame:
    """Candidates (a, b): entries with one fingerprint and its least entry, and what connects all fingerprints that differ in at most three bits."""
    prints = materialize(first.groupBy("fp").agg(F.min("e").alias("rep")))
    same = first.select("e", "fp").join(prints, "fp").where("e <> rep").select(F.col("e").alias("a"), F.col("rep").alias("b"))
    return same.unionByName(simhash.links(prints))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, e) of every row, and (e, component_id) of every different text."""
    often = docs.sparkSession.sparkContext.broadcast(often_found(docs))
    prints = materialize(_texts(docs).mapInArrow(lambda b: _prints(b, often.value), PRINTS))
    entries = materialize(prints.groupBy("e").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    first = materialize(prints.join(entries.select("e", F.col("rep").alias("doc_id")), ["e", "doc_id"], "left_semi").dropDuplicates(["e"]))
    early = first.select("e", "n", F.lit(0).alias("pos"), F.explode("least").alias("key"), F.col("e").alias("label"), F.lit(0).alias("place"))
    found = components(checked(by_fingerprint(first).unionByName(close(early)), first, docs))
    labelled = first.join(found, first["e"] == F.col("node"), "left").select("e", "n", "keys", F.coalesce("root", "e").alias("label"))
    out = materialize(paired(labelled.select("e", "n", F.posexplode("keys").alias("pos", "key"), "label", F.lit(0).alias("place")), 0, FIRST))
    for turn in range(FARTHER + 2):
        known = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = components(known.unionByName(checked(out.where("b is not null"), first, docs)))
        large = out.where("b is null").select("key", "n", F.col("a").alias("e"))
        if turn > FARTHER or large.isEmpty():
            break
        rows = large.join(found.withColumnRenamed("node", "e"), "e", "left").withColumn("label", F.coalesce("root", "e"))
        out = materialize(met(rows.select("key", "n", "e", "label"), first, turn == FARTHER))
    classes = entries.join(found, entries["e"] == found["node"], "left").select("e", "rep", "n", F.coalesce("root", "e").alias("root"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.select("doc_id", "e"), materialize(classes.join(least, "root").select("e", "component_id", "n"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row with a doc_id; component_id is the least doc_id of its near copies."""
    prints, classes = _classes(docs)
    return looked_up(prints, classes, ["e"], "n", F.col("doc_id")).select("doc_id", "component_id")


def _entries(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches with the hash of the words of each row's text behind their columns."""
    import xxhash

    for batch in sliced(batches):
        texts = ((t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist())
        e = np.fromiter((xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 42) for t in texts), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(e.view(np.int64))], [*batch.schema.names, "own_entry"])


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, of those with its least doc_id; rows without doc_id stay."""
    prints, classes = _classes(docs)
    # texts that may go: all but those held by just one row, which names its component
    once = prints.groupBy("e").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    some = materialize(once.join(classes.drop("n"), "e").where("n > 1 or least <> component_id").select(F.col("e").alias("own_entry"), "component_id"))
    at = docs.columns.index("text")
    kind = StructType([*docs.schema.fields, StructField("own_entry", LongType())])
    rows = docs.where("doc_id is not null").mapInArrow(lambda b: _entries(b, at), kind)
    told = salted(rows, some, ["own_entry"], F.col("doc_id"), "left")
    free = told.where("component_id is null").select(*docs.columns)
    one = told.where("component_id = doc_id").dropDuplicates(["component_id"]).select(*docs.columns)
    return free.unionByName(one).unionByName(docs.where("doc_id is null"))
