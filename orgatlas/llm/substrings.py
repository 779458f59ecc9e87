"""Substring dedup: words of passages that also start in a document with a smaller doc_id are removed.

A window is ``width`` consecutive words of one document. Every window names one anchor: the phrase
of ``phrase`` words with the least hash inside it. Equal windows name the same anchor, wherever
they stand, so only anchors have to meet in a shuffle, about one per twenty words.

1. One map stage gives each document's anchors with their words. Phrases that recur in several documents
   are confirmed: least and largest doc_id per anchor, and one digest of the words, pre-aggregated.
2. Documents are dealt out with their recurring phrases. Per shard (a slice of documents) these are compiled to
   Aho-Corasick automata, and all documents of the shard stream through them, which locates every occurrence.
   A window whose least phrase was located is a candidate; neighbouring ones with one anchor form a segment.
   (Streaming each document past the phrases of all shards would cost documents times phrases; a document
   that is not dealt a phrase cannot hold a window that recurs around it.)
3. Equal segments need one comparison: the least doc_id per (anchor, words of the segment).
   Only where an anchor has different segments, one document of each is compared by single windows.
4. What is covered is cut from the words.

Words are compared by 128 bits: two independent hashes. A hot passage is a row per document and anchor at most; all groupings
pre-aggregate to the least doc_id, and rows are told from it by joins that doc_id is part of, so no passage is a hot key.

Defined results: null and empty texts have no words; rows with equal doc_id never remove each other's
words (nor do windows repeated inside one document); rows without doc_id keep all words and remove
none; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgatlas.llm.shared import materialize, salted, sliced

WIDTH = 50
PHRASE = 10
#: Documents of a shard, which is streamed through automata of its own.
SHARD = 512
#: Phrases of one automaton at most: their words then have symbols enough.
PHRASES = 50_000
WORDS_KEPT = 200_000
ODD = 0x9E3779B97F4A7C15
ODD_INVERSE = pow(ODD, -1, 1 << 64)
#: Stands between the documents of a slice; no word holds a blank.
BETWEEN = b" "
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it holds too many."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_KEPT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any run of words of one document, from prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        powers = np.full(n + 1, ODD, dtype=np.uint64)
        back = np.full(n + 1, ODD_INVERSE, dtype=np.uint64)
        powers[0] = back[0] = 1
        powers, self.back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * powers[:n], dtype=np.uint64)))

    def every(self, size: int) -> np.ndarray:
        starts = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:starts]) * self.back[:starts])

    def some(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def anchors_of(phrases: np.ndarray, span: int) -> np.ndarray:
    """Least phrase hash inside each window, of ``span`` phrases."""
    best, have = phrases, 1
    while 2 * have <= span:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    rest = span - have
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


class Slice:
    """The words of some documents in one row, so that each step is one array operation for all of them."""

    def __init__(self, raws: list[bytes | None], width: int, phrase: int):
        self.words = [(raw or b"").split() for raw in raws]
        self.flat = list(chain.from_iterable([*w, BETWEEN] for w in self.words))
        self.sizes = np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]
        count = max(0, len(self.flat) - width + 1)
        gaps = np.zeros(len(self.flat) + 1, dtype=np.int64)
        gaps[self.starts + self.sizes + 1] = 1
        gaps = np.cumsum(gaps)
        self.row = gaps[:count]  # document of each window
        self.inside = (gaps[width : width + count] == self.row) & (count > 0)
        self.width, self.span, self.phrase = width, width - phrase + 1, phrase

    def phrases(self, hashes: WordHashes) -> np.ndarray:
        return Rolling(hashes.of(self.flat)).every(self.phrase)


def _anchors(batches: Iterator[pa.RecordBatch], width: int, phrase: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, anchor, check, phrase): the least phrases of a document's windows, with a second hash and their words."""
    import xxhash

    hashes, span = WordHashes(7), width - phrase + 1
    for batch in sliced(batches, SHARD):
        part = Slice(batch.column(1).to_pylist(), width, phrase)
        at, every = np.flatnonzero(part.inside), part.phrases(hashes) if part.inside.any() else None
        if len(at):
            least = anchors_of(every, span)[at]
            fresh = np.concatenate(([True], (least[1:] != least[:-1]) | (part.row[at[1:]] != part.row[at[:-1]])))
            at, least = at[fresh], least[fresh]
            order = np.lexsort((least, part.row[at]))
            at, least = at[order], least[order]
            once = np.concatenate(([True], (least[1:] != least[:-1]) | (part.row[at[1:]] != part.row[at[:-1]])))
            at, least = at[once], least[once]
            place = at + np.lib.stride_tricks.sliding_window_view(every, span)[at].argmin(axis=1)
            texts = [b" ".join(part.flat[p : p + phrase]) for p in place.tolist()]
        else:
            least, texts = np.zeros(0, dtype=np.uint64), []
        checks = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), dtype=np.uint64, count=len(texts))
        ids = batch.column(0).take(pa.array(part.row[at])) if len(at) else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(least.view(np.int64)), pa.array(checks.view(np.int64)), pa.array(texts, pa.binary())], ["doc_id", "anchor", "check", "phrase"])


def symbol(number: int) -> str:
    """One character for a word of an automaton's phrases; 1 is any other word, and code points for surrogates are left out."""
    return chr(number + 2 if number + 2 < 0xD800 else number + 2 + 0x800)


def located(flat: list[bytes], phrases: set[bytes]) -> np.ndarray:
    """Where in the words of a shard one of the phrases begins, as its automata say."""
    import ahocorasick

    found = np.zeros(len(flat), dtype=bool)
    ordered = sorted(phrases)
    for first in range(0, len(ordered), PHRASES):
        letters: dict[bytes, str] = {}
        automaton = ahocorasick.Automaton()
        for text in ordered[first : first + PHRASES]:
            words = text.split()
            automaton.add_word("".join([letters.get(w) or letters.setdefault(w, symbol(len(letters))) for w in words]), len(words) - 1)
        automaton.make_automaton()
        line = "".join([letters.get(w, "\1") for w in flat])
        hits = [last - back for last, back in automaton.iter(line)]
        found[hits] = True
    return found


SEGMENT = pa.struct([("anchor", pa.int64()), ("seg", pa.int64()), ("check", pa.int64()), ("start", pa.int32()), ("count", pa.int32())])
LOCATED = "doc_id long, n_words long, digest string, body long, line binary, segments array<struct<anchor: long, seg: long, check: long, start: int, count: int>>"


def _locate(batches: Iterator[pa.RecordBatch], width: int, phrase: int) -> Iterator[pa.RecordBatch]:
    """Per document its words' digest and, for those with located phrases, the segments to check."""
    hashes, second = WordHashes(7), WordHashes(8)
    for batch in sliced(batches, SHARD):
        part = Slice(batch.column(1).to_pylist(), width, phrase)
        phrases = {p for own in batch.column(2).to_pylist() if own for p in own}
        segments: list[list] = [[] for _ in part.words]
        if phrases and part.inside.any():
            first = Rolling(hashes.of(part.flat))
            every = first.every(phrase)
            seen = located(part.flat, phrases)[: len(every)]
            anchors = anchors_of(every, part.span)
            # candidates: the least phrase of the window is one that an automaton located
            held = part.inside & (anchors_of(np.where(seen, every, NONE), part.span) == anchors) & (anchors != NONE)
            known = np.array([i is not None for i in batch.column(0).to_pylist()], dtype=bool)
            held &= known[np.minimum(part.row, len(known) - 1)]
            if held.any():
                joint = (anchors[1:] == anchors[:-1]) & (part.row[1:] == part.row[:-1])
                fresh, ends = held.copy(), held.copy()
                fresh[1:] &= ~(held[:-1] & joint)
                ends[:-1] &= ~(held[1:] & joint)
                starts, stops = np.flatnonzero(fresh), np.flatnonzero(ends) + 1
                other = Rolling(second.of(part.flat))
                columns = (anchors[starts].view(np.int64), first.some(starts, stops + width - 1).view(np.int64), other.some(starts, stops + width - 1).view(np.int64), starts - part.starts[part.row[starts]], stops - starts)
                for row, a, h, c, s, n in zip(part.row[starts].tolist(), *(x.tolist() for x in columns), strict=True):
                    segments[row].append({"anchor": a, "seg": h, "check": c, "start": s, "count": n})
        lines = [b" ".join(w) for w in part.words]
        digests = [hashlib.sha256(x).hexdigest() for x in lines]
        keys = [int(d[:15], 16) for d in digests]  # tells texts of rows with equal doc_id apart in joins
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(part.sizes), pa.array(digests, pa.string()), pa.array(keys, pa.int64()), pa.array([x if own else None for x, own in zip(lines, segments, strict=True)], pa.binary()), pa.array(segments, pa.list_(SEGMENT))],
            ["doc_id", "n_words", "digest", "body", "line", "segments"],
        )


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, body, anchor, start, window, check) for each single window of the given segments."""
    hashes, second = WordHashes(7), WordHashes(8)
    for batch in sliced(batches, SHARD):
        part = Slice(batch.column(2).to_pylist(), width, PHRASE)
        spans = [(row, s["start"], s["count"], s["anchor"]) for row, own in enumerate(batch.column(3).to_pylist()) for s in own]
        if not spans:
            continue
        row, start, count, anchor = (np.array(x, dtype=np.int64) for x in zip(*spans, strict=True))
        first = np.repeat(np.cumsum(count) - count, count)
        inner = np.repeat(start, count) + np.arange(len(first)) - first
        rows = np.repeat(row, count)
        at = inner + part.starts[rows]
        both = [Rolling(h.of(part.flat)).every(width)[at].view(np.int64) for h in (hashes, second)]
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.repeat(anchor, count)), pa.array(inner.astype(np.int32)), *map(pa.array, both)], ["doc_id", "body", "anchor", "start", "window", "check"])


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        out = []
        for doc_id, n_words, digest, line, spans in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if not spans:
                out.append((doc_id, n_words, 0, digest, line))
                continue
            words = line.split()
            edge = np.zeros(len(words) + 1, dtype=np.int32)
            start, count = np.array([(s["start"], s["count"]) for s in spans], dtype=np.int64).T
            np.add.at(edge, start, 1)
            np.add.at(edge, start + count + width - 1, -1)
            keep = np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()
            left = b" ".join([words[i] for i in keep])
            out.append((doc_id, n_words, n_words - len(keep), hashlib.sha256(left).hexdigest(), left))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def later_copies(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose group (``keys``) has a lesser doc_id, and the groups with the least of each.

    Joined by keys and doc_id, so that the rows of a large group are dealt over all tasks.
    """
    firsts = materialize(rows.groupBy(*keys).agg(F.min("doc_id").alias("doc_id")))
    return rows.join(firsts, [*keys, "doc_id"], "left_anti"), firsts


def remove_repeats(docs: DataFrame, width: int = WIDTH, phrase: int = PHRASE) -> DataFrame:
    """Per document n_words, n_removed, kept_sha256, and ``kept``: the words left of a document that had candidates (else null: all)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    anchors = materialize(rows.where("doc_id is not null").mapInArrow(lambda b: _anchors(b, width, phrase), "doc_id long, anchor long, check long, phrase binary"))
    shared = anchors.groupBy("anchor", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor", "check")
    wanted = anchors.join(shared, ["anchor", "check"], "left_semi").groupBy("doc_id").agg(F.collect_set("phrase").alias("phrases"))
    dealt = rows.where("doc_id is not null").join(wanted.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "raw", "phrases")
    dealt = dealt.unionByName(rows.where("doc_id is null").select("doc_id", "raw", F.lit(None).cast("array<binary>").alias("phrases")))
    found = materialize(dealt.mapInArrow(lambda b: _locate(b, width, phrase), LOCATED))

    lines = found.where("line is not null")
    segments = lines.select("doc_id", "body", F.inline("segments"))
    same = ["anchor", "seg", "check"]
    copies, firsts = later_copies(segments, same)
    several = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    single = segments.join(salted(firsts, several, ["anchor"], F.col("seg"), "left_semi"), [*same, "doc_id"], "left_semi")
    spans = single.groupBy("doc_id", "body").agg(F.collect_set(F.struct("anchor", "start", "count")).alias("spans"))
    windows = lines.select("doc_id", "body", "line").join(spans, ["doc_id", "body"]).select("doc_id", "body", "line", "spans")
    windows = materialize(windows.mapInArrow(lambda b: _windows(b, width), "doc_id long, body long, anchor long, start int, window long, check long"))
    covered, _ = later_copies(windows, ["anchor", "window", "check"])
    copies, covered = copies.select("doc_id", "body", "start", "count"), covered.select("doc_id", "body", "start", F.lit(1).alias("count"))

    cuts = copies.unionByName(covered).groupBy("doc_id", "body").agg(F.collect_set(F.struct("start", "count")).alias("cuts"))
    held = lines.select("doc_id", "n_words", "digest", "body", "line").join(cuts, ["doc_id", "body"], "left").select("doc_id", "n_words", "digest", "line", "cuts")
    result = held.mapInArrow(lambda b: _cut(b, width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    rest = found.where("line is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    return result.unionByName(rest)
