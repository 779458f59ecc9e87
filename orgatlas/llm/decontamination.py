"""Benchmark decontamination with spaced-seed hashing.

A seed is a fixed mask over some consecutive tokens: positions marked 0 are ignored, so a substituted
token there does not hide the match. Short items have masks of five tokens, longer ones of six; together
they hit every item of 12 tokens or more of which at most one token in five is substituted, wherever these stand (of shorter ones: one token).

1. The benchmark's items are read by Spark; items of equal tokens are one. Their seeds make a table of hashes, and a
   bit filter of fixed size, the only thing that is sent to all tasks.
2. One map stage hashes all documents with the same masks. Of documents that pass the filter somewhere, the hits and
   the tokens (as hashes) are written.
3. Hits are joined with the seeds; a popular seed's rows are dealt over copies of it. A hit names a document, an item and a diagonal.
4. Around the hits the item is laid over the document: the best stretch on one diagonal, and the best local alignment over
   the neighbouring diagonals, so that inserted and missing tokens do not cut an overlap in two. An overlap counts if at least ``SHARE`` of the item
   (and ``LEAST`` tokens) agree, or ``RUN`` tokens in a row (part of a long item, word for word).

Defined results: tokens are runs of letters and digits in lower case. Items of fewer than ``SHORTEST`` tokens are never
reported, as such words stand in clean texts too; items of up to ``LEAST`` tokens must agree whole. Null and empty texts and items match
nothing; repeated rows give one result row; rows without doc_id are never reported, but ``decontaminate`` drops them by their text; other
columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgatlas.llm.shared import materialize, salted, sliced

#: Fixed masks: 1 is compared, 0 ignored. The first three are for items of fewer than ``LONG`` tokens, the others for longer ones.
MASKS = ("11111", "111011", "111101", "111111", "1110111", "1111011")
SHORT_MASKS = 3
LONG = 25
SHORTEST = 5
SHARE = 0.6
LEAST = 8
RUN = 13
#: What a substituted, inserted or missing token costs against a matching one, in finding the best stretch.
PENALTY = 1.5
#: Diagonals that may be bridged by inserted or missing tokens.
BAND = 4
WORDS_KEPT = 200_000
#: Bits of the filter, and how many of them a seed sets.
FILTER_BITS, PLACES = 25, 3

TOKEN = re.compile(r"[^\W_]+")
HITS = "doc_id long, body long, size int, tokens array<long>, seeds array<long>, places array<int>"
RESULT = "doc_id long, body long, size int, item long, start long, length long, n_match long, item_tokens long"


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        import xxhash

        got = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 11)
        return got

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self) > WORDS_KEPT:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def factors(number: int) -> list[tuple[int, np.uint64]]:
    """Odd 64-bit factors for the compared positions of a mask."""
    chosen = [i for i, c in enumerate(MASKS[number]) if c == "1"]
    return [(i, np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3) ** 5 + 2 * (number + 1) * 0x2545F4914F6CDD1D) % (1 << 64) | 1)) for i in chosen]


def seeds(hashes: np.ndarray, number: int) -> np.ndarray:
    """One hash per position at which the mask fits into the tokens."""
    n = max(0, len(hashes) - len(MASKS[number]) + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i, factor in factors(number):
        total += hashes[i : i + n] * factor
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def bit_places(found: np.ndarray) -> list[np.ndarray]:
    """The bits of the filter that seeds set."""
    steps = [np.uint64(k * (64 - FILTER_BITS) // (PLACES - 1)) for k in range(PLACES)]
    return [(found >> step) & np.uint64((1 << FILTER_BITS) - 1) for step in steps]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = TokenHashes()
    for batch in sliced(batches):
        tokens = [hashes.of(TOKEN.findall(t.lower())).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int64()))], ["item_id", "tokens"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = []
        for item, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.array(tokens, dtype=np.int64).view(np.uint64)
            for number in range(SHORT_MASKS) if len(own) < LONG else range(SHORT_MASKS, len(MASKS)):
                rows += [(seed, item, at) for at, seed in enumerate(seeds(own, number).view(np.int64).tolist())]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], ["seed", "item", "at"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        places = np.unique(np.concatenate(bit_places(found))) if len(found) else np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], ["word", "bits"])


def bit_filter(table: DataFrame) -> np.ndarray:
    """The filter over the seeds of ``table``: as many bits at any size of the benchmark."""
    words = table.select("seed").mapInArrow(_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _hits(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each document that passes the filter: its tokens, and the seeds that pass with their places. A slice of documents is one row of tokens."""
    hashes = TokenHashes()
    for batch in sliced(batches):
        tokens = [TOKEN.findall(t.lower()) for t in batch.column(1).to_pylist()]
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat, ends = hashes.of(list(chain.from_iterable(tokens))), np.cumsum(sizes)
        row = np.repeat(np.arange(len(tokens)), sizes)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for number, mask in enumerate(MASKS):
            own = seeds(flat, number)
            at = np.arange(len(own))
            for place in range(PLACES):
                bit = bit_places(own)[place]
                keep = np.flatnonzero((words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                own, at = own[keep], at[keep]
            keep = row[at] == row[at + len(mask) - 1] if len(at) else at
            found.append((own[keep], at[keep]))
        seed, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(at, kind="stable")
        seed, at = seed[order].view(np.int64), at[order]
        rows = np.unique(row[at])
        cuts = np.searchsorted(at, ends - sizes), np.searchsorted(at, ends)
        first = ends - sizes
        part = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0), part.column(2), part.column(3), pa.array([flat[first[r] : ends[r]].view(np.int64) for r in rows], pa.list_(pa.int64())),
                pa.array([seed[cuts[0][r] : cuts[1][r]] for r in rows], pa.list_(pa.int64())), pa.array([(at[cuts[0][r] : cuts[1][r]] - first[r]).astype(np.int32) for r in rows], pa.list_(pa.int32())),
            ],
            ["doc_id", "body", "size", "tokens", "seeds", "places"],
        )


def on_one_diagonal(item: np.ndarray, doc: np.ndarray, diagonal: int) -> tuple[int, int, int, int]:
    """(start, length, matches, longest run) of the best stretch."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = item[low:high] == doc[low + diagonal : high + diagonal]
    gain = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -PENALTY))))
    stop = int(np.argmax(gain - np.minimum.accumulate(gain)))
    start = int(np.argmin(gain[: stop + 1]))
    breaks = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    return low + start + diagonal, stop - start, int(same[start:stop].sum()), int(np.diff(breaks).max()) - 1


def over_diagonals(item: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(start, length, matches) of the best local alignment that stays on the diagonals from ``low`` to ``high``."""
    width = high - low + 1
    across = np.arange(width)
    score, matches, start = np.zeros(width), np.zeros(width, dtype=np.int64), across + low
    best, cost = (0.0, 0, 0, 0), PENALTY * across
    for i in range(len(item)):
        at = i + low + across
        same = (at >= 0) & (at < len(doc)) & (doc[np.clip(at, 0, len(doc) - 1)] == item[i])
        score, matches = score + np.where(same, 1.0, -PENALTY), matches + same
        for way in (1, -1):  # inserted tokens lead to higher diagonals, missing ones to lower
            reach = score[::way] + cost
            top = np.maximum.accumulate(reach)
            source = np.maximum.accumulate(np.where(reach == top, across, 0))
            score, matches, start = (top - cost)[::way], matches[::way][source][::way], start[::way][source][::way]
        fresh = score <= 0
        score, matches, start = np.where(fresh, 0.0, score), np.where(fresh, 0, matches), np.where(fresh, at + 1, start)
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (float(score[k]), int(start[k]), int(at[k]) + 1, int(matches[k]))
    return best[1], best[2] - best[1], best[3]


def overlap(item: np.ndarray, doc: np.ndarray, diagonals: list[int]) -> tuple[int, int, int] | None:
    """(start, length, matches) of the best overlap around hits on some diagonals, or None if none counts."""
    need = min(len(item), max(LEAST, SHARE * len(item)))
    best = None
    ordered = sorted(diagonals)
    for diagonal in ordered:
        start, length, matches, run = on_one_diagonal(item, doc, diagonal)
        if (matches >= need or run >= RUN) and (best is None or matches > best[2]):
            best = (start, length, matches)
    cuts = [k for k in range(1, len(ordered)) if ordered[k] - ordered[k - 1] > BAND]
    for a, b in zip([0, *cuts], [*cuts, len(ordered)], strict=True):
        if best is None or best[2] < len(item):
            found = over_diagonals(item, doc, ordered[a] - BAND, ordered[b - 1] + BAND)
            if found[2] >= need and (best is None or found[2] > best[2]):
                best = found
    return best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        out = []
        for doc_id, body, size, item, diagonals, own, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = overlap(np.array(own, dtype=np.int64), np.array(tokens, dtype=np.int64), diagonals)
            if found:
                out.append((doc_id, body, size, item, *found, len(own)))
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "body", "size", "item", "start", "length", "n_match", "item_tokens"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlaps of documents (also those without doc_id) with items, and (item, item_id): the names of each item."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    named = materialize(own.mapInArrow(_items, "item_id long, tokens array<long>").where(F.size("tokens") >= SHORTEST))
    items = materialize(named.groupBy("tokens").agg(F.min("item_id").alias("item")).select("item", "tokens"))
    names = named.join(items, "tokens").select("item", "item_id").distinct()
    table = materialize(items.mapInArrow(_item_seeds, "seed long, item long, at int"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(table))

    text = F.col("text").cast("string")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("body"), F.length(text).alias("size"))
    found = materialize(rows.mapInArrow(lambda b: _hits(b, sent.value), HITS))
    key = ["doc_id", "body", "size"]
    hits = found.select(*key, F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select(*key, F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
    pairs = salted(hits, table, ["seed"], F.col("body")).groupBy(*key, "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("diagonals"))
    both = salted(pairs, items.withColumnRenamed("tokens", "own"), ["item"], F.col("body"))
    tokens = found.groupBy(*key).agg(F.first("tokens").alias("tokens"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in key]
    rows = both.alias("p").join(tokens.alias("t"), same).select(*[f"p.{c}" for c in key], "p.item", "p.diagonals", "p.own", "t.tokens")
    return rows.mapInArrow(_verify, RESULT), names


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, length, n_match, item_tokens): one row per document and item it contains."""
    found, names = overlaps(docs, benchmark)
    best = found.where("doc_id is not null").groupBy("doc_id", "item", "item_tokens").agg(F.max(F.struct("n_match", -F.col("start"), "length")).alias("b"))
    best = best.select("doc_id", "item", (-F.col("b.col2")).alias("start"), F.col("b.length").alias("length"), F.col("b.n_match").alias("n_match"), "item_tokens")
    return salted(best, materialize(names), ["item"], F.col("doc_id")).select("doc_id", "item_id", "start", "length", "n_match", "item_tokens")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item."""
    found, _ = overlaps(docs, benchmark)
    gone = materialize(found.select(F.col("body").alias("own_body"), F.col("size").alias("own_size")).distinct())
    text = F.col("text").cast("string")
    rows = docs.withColumn("own_body", F.xxhash64(text)).withColumn("own_size", F.length(text))
    return salted(rows, gone, ["own_body", "own_size"], F.col("doc_id"), "left_anti").select(*docs.columns)
