"""Packing token sequences with Karmarkar-Karp multiway differencing.

Each document becomes token ids plus an end id. Pieces of exactly ``capacity`` ids are cut off and
fill a sequence by themselves; what is left of each document (its tail) is cut evenly into pieces of at most
``LARGEST`` ids, which are packed in blocks. A block holds the ids of ``BLOCK`` windows but for ``SLACK`` ids each. In it
the multiway differencing method starts with one partial partition per piece, repeatedly takes the two
with the largest imbalance and merges them so that the largest windows of one meet the smallest of the
other. The result is a set of windows of nearly equal sums, and it stands: no piece is cut or moved
afterwards. Where a window exceeds the capacity all the same, the window count rises by one and the block is
partitioned again.

Everything happens in one map stage: nothing is shuffled, and a task holds one block and one Arrow
batch at a time. Padding is the slack and the last block of a task.

Defined results: a null text is read as empty and yields one piece with the end id alone; repeated
rows are packed once each; a null doc_id is passed through; other columns are ignored; an empty
table gives an empty table. ``sequence_id`` is unique over the whole result (task number in the high
bits).
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgatlas.llm.shared import sliced

CAPACITY = 2048
#: Windows of a block, ids of a window that a block leaves free, and ids of a tail's piece at most.
BLOCK, SLACK, LARGEST = 16, 14, 512
END_ID = 1
#: Entries of a worker's cache of encoded parts from which on only those of the current batch stay.
CACHE_ENTRIES = 500_000
#: Documents, and unknown words, that are encoded together.
STEP, WORDS_AT_ONCE = 512, 256
#: Characters that Python's split() takes for white space, but the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Lower-case letters of ASCII and Latin-1; parts of lower-case texts made of these and of ASCII, as the tokenizer cuts them; and all other characters.
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
PART = re.compile("[ \\t-\\r]*+([a-z\xdf-\xf6\xf8-\xff]++|'(?:[stmd]|re|ve|ll)|[^ \\t-\\ra-z0-9\xdf-\xf6\xf8-\xff]++|[0-9])")
OTHER = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Split items into ``windows`` groups of nearly equal sums; returns the items of each group."""
    sums = np.zeros(windows, dtype=np.int64)
    heap = []
    for item, size in enumerate(sizes):
        first = sums.copy()
        first[-1] = size  # ascending
        heap.append((-size, item, first, [()] * (windows - 1) + [(item,)]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, a_items = heapq.heappop(heap)
        _, _, b, b_items = heapq.heappop(heap)
        both = a + b[::-1]
        order = np.argsort(both, kind="stable")
        items = [joined(a_items[i], b_items[windows - 1 - i]) for i in order.tolist()]
        both = both[order]
        both -= both[0]  # only imbalances matter from here on
        heapq.heappush(heap, (-int(both[-1]), tick, both, items))
        tick += 1
    return [flat(group) for group in heap[0][3]] if heap else []


def joined(a: tuple, b: tuple) -> tuple:
    """The items of two windows as one tree; empty ones leave no trace in it."""
    return (a, b) if a and b else a or b


def flat(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        top = stack.pop()
        for x in top:
            if isinstance(x, tuple):
                stack.append(x)
            else:
                out.append(x)
    return out


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each window; the window count rises as long as one exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, windows)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [sorted(g) for g in groups if g]
        windows += 1


def evenly(size: int, largest: int) -> list[int]:
    """Sizes of the fewest pieces of at most ``largest``, as equal as can be."""
    count = -(-size // largest)
    return [size // count + (i < size % count) for i in range(count)]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; parts of texts are encoded once and remembered.

    The tokenizer lower-cases, then splits at white space and between letters, digits and other characters, so the ids of
    a text are those of its parts. Texts of ASCII and Latin-1 letters alone are cut the same way by ``PART``; of others, words
    are remembered. Unknown runs of letters are encoded together without the tokenizer's own cutting, and told apart by
    the ids that end a word.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)  # the same merges, for lower-case letters
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, parts: set[str]) -> None:
        known = self.known
        letters = []
        for part in parts:
            if LETTERS.fullmatch(part):
                letters.append(part)
            else:
                known[part] = self.raw(part)
        for at in range(0, len(letters), WORDS_AT_ONCE):
            some = letters[at : at + WORDS_AT_ONCE]
            ids = np.asarray(self.letters.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                raw, start = ids.tobytes(), 0
                for part, stop in zip(some, (4 * cuts).tolist(), strict=True):
                    known[part] = raw[start:stop]
                    start = stop
            else:
                known.update((w, self.raw(w)) for w in some)

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = ["<|" in t or ODD_SPACE.search(t) is not None for t in texts]
        split = [() if o else t.split() if not t.isascii() and OTHER.search(t) else PART.findall(t.lower()) for t, o in zip(texts, odd, strict=True)]
        needed = set().union(*split)
        if len(self.known) > CACHE_ENTRIES:  # what this batch has again stays
            self.known = {w: self.known[w] for w in needed.intersection(self.known)}
        missing = needed.difference(self.known)
        if missing:
            self.learn(missing)
        get = self.known.__getitem__
        return [self.raw(t) if o else b"".join(map(get, s)) for t, o, s in zip(texts, odd, split, strict=True)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(docs: DataFrame, tokenizer_path: Callable[[], str] | str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most ``capacity`` ids.

    ``tokenizer_path`` may be a function, which is then called where the tokenizer is read: on the workers.
    """
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    fill = BLOCK * (capacity - min(SLACK, capacity // 8))
    largest = min(LARGEST, max(1, capacity // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path if isinstance(tokenizer_path, str) else tokenizer_path()).encode
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 32
        count, held = 0, 0
        pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        rows: list[tuple] = []

        def settle(over: int) -> None:
            """Pack the block but for its last ``over`` ids, which stay for the next."""
            nonlocal count, held
            kept = []
            if over:
                doc_id, start, ids, total = pieces.pop()
                cut = len(ids) // 4 - over
                pieces.append((doc_id, start, ids[: 4 * cut], total))
                kept.append((doc_id, start + cut, ids[4 * cut :], total))
            for window in pack_block([len(p[2]) // 4 for p in pieces], capacity):
                offset = 0
                for item in window:
                    doc_id, start, ids, total = pieces[item]
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, first + count, offset))
                    offset += len(ids) // 4
                count += 1
            pieces[:], held = kept, over

        def taken() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(NAMES)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)
            rows.clear()
            return out

        for batch in sliced(batches, STEP):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                at = total - total % capacity
                for start in range(0, at, capacity):
                    rows.append((doc_id, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, first + count, 0))
                    count += 1
                for size in evenly(total - at, largest):
                    pieces.append((doc_id, at, ids[4 * at : 4 * (at + size)], total))
                    at, held = at + size, held + size
                    if held >= fill:
                        settle(held - fill)
            if rows:
                yield taken()
        if pieces:
            settle(0)
        yield taken()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
