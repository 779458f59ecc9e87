"""SimHash near-duplicates with a Gray-order hierarchical index.

1. Every text gets a 64-bit fingerprint of its word shingles (one map stage).
2. Equal fingerprints become one entry, with their least doc_id (pre-aggregated).
3. Upper nodes of the index: the bits are cut into five blocks. Two fingerprints that differ in at
   most three bits agree on at least two whole blocks, so under one of ten masks they share the
   masked bit pattern. That pattern is the upper node, and the rows of a node meet in one task. A
   node that holds more than ``node_limit`` entries is split further by the same argument: four
   blocks of the bits not yet shared, of which one must agree.
4. In a node the entries stand in Gray rank, where close patterns tend to be neighbours. Groups of
   neighbours keep the bits they share; two groups whose shared bits already differ in more than
   three places are pruned whole, and so are groups already known to be linked.
5. A node gives at most one link per entry beyond small nodes; components follow by star operations.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows
are rows of the same group; rows without doc_id take the component of their fingerprint and never
name one; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgatlas.llm.components import components
from orgatlas.llm.shared import looked_up, materialize, sliced

SEED = 42
MOST_DIFFERENCES = 3
#: Widths of the five blocks; together 64 bits.
BLOCKS = (13, 13, 13, 13, 12)
#: Nodes up to this size are compared directly.
SMALL_NODE = 24
LEAF = 16
NODE_LIMIT = 100_000


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_masks() -> list[int]:
    starts = np.cumsum((0, *BLOCKS))
    one = [((1 << width) - 1) << int(at) for width, at in zip(BLOCKS, starts, strict=False)]
    return [a | b for a, b in itertools.combinations(one, 2)]


MASKS = block_masks()


def quarters(mask: int) -> list[int]:
    """Four masks over the bits that ``mask`` leaves open."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [free[len(free) * k // 4 : len(free) * (k + 1) // 4] for k in range(4)]
    return [sum(1 << i for i in part) for part in cut]


def fingerprint(words: list[bytes], size: int) -> int:
    """Fingerprint of a text's lower-case words (none: zero)."""
    import xxhash

    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, SEED)
    digest = xxhash.xxh64_intdigest
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))[: len(words) - size + 1].tolist()
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops[size - 1 :].tolist(), strict=True)], dtype=np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        # bytes: lower() and split() know exactly A-Z and the six white-space characters
        out = np.array([fingerprint((raw or b"").lower().split(), size) for raw in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): ``fp`` is the 64-bit fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(lambda batches: _fingerprint(batches, size), "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the reflected Gray sequence."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: list[int], b: list[int]) -> None:
        for x, y in zip(a, b, strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def labels(self) -> np.ndarray:
        return np.fromiter(map(self.find, range(len(self.up))), dtype=np.int64, count=len(self.up))


def _groups(low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """AND and OR over runs of ``width`` neighbours."""
    at = np.arange(0, len(low), width)
    return np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)


def gray_links(fps: np.ndarray) -> np.ndarray:
    """For entries in Gray order, the least entry each is connected with by links inside the node."""
    n = len(fps)
    union = Union(n)
    for step in range(1, min(9, n)):  # neighbours in Gray order first: dense groups join at once
        near = np.flatnonzero(np.bitwise_count(fps[:-step] ^ fps[step:]) <= MOST_DIFFERENCES)
        union.join(near.tolist(), (near + step).tolist())
    levels = [_groups(fps, fps, LEAF)]
    while len(levels[-1][0]) > 1:
        levels.append(_groups(*levels[-1], 8))
    labels = union.labels()

    def apart(level: int, a: np.ndarray, b: np.ndarray, single: list[np.ndarray]) -> np.ndarray:
        low, high = levels[level]
        shared = ~(low ^ high)
        keep = np.bitwise_count((low[a] ^ low[b]) & shared[a] & shared[b]) <= MOST_DIFFERENCES
        one = single[level]
        return keep & ~((one[a] >= 0) & (one[a] == one[b]))

    def singles() -> list[np.ndarray]:
        """Per level and group the label that all its entries have, or -1."""
        out, low, high = [], labels, labels
        for level, (groups, _) in enumerate(levels):
            at = np.arange(0, len(low), LEAF if level == 0 else 8)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
            assert len(groups) == len(low)
        return out

    single, fresh = singles(), 0
    stack = [(len(levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        level, a, b = stack.pop()
        keep = apart(level, a, b, single)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        width, below = (8, len(levels[level - 1][0])) if level else (LEAF, n)
        step = 2048
        if len(a) > step:
            stack += [(level, a[i : i + step], b[i : i + step]) for i in range(0, len(a), step)]
            continue
        i, j = np.divmod(np.arange(width * width), width)
        x, y = (a[:, None] * width + i).ravel(), (b[:, None] * width + j).ravel()
        inside = (x < below) & (y < below) & (x <= y if level else x < y)
        x, y = x[inside], y[inside]
        if level:
            stack.append((level - 1, x, y))
            continue
        near = (np.bitwise_count(fps[x] ^ fps[y]) <= MOST_DIFFERENCES) & (labels[x] != labels[y])
        if near.any():
            union.join(x[near].tolist(), y[near].tolist())
            fresh += int(near.sum())
            if fresh > n // 16:  # labels only prune: renewing them pays after enough links
                labels, fresh = union.labels(), 0
                single = singles()
    return union.labels()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside nodes; rows come sorted by node and Gray rank. A node may span batches."""
    held: list[np.ndarray] | None = None

    def solve(node: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(node)])))
        pairs = []
        size_of = np.repeat(sizes, sizes)
        for step in range(1, SMALL_NODE):
            first = np.flatnonzero((node[:-step] == node[step:]) & (size_of[:-step] <= SMALL_NODE)) if len(node) > step else starts[:0]
            if not len(first):
                break
            first = first[np.bitwise_count(fps[first] ^ fps[first + step]) <= MOST_DIFFERENCES]
            pairs.append((reps[first], reps[first + step]))
        for start, size in zip(starts[sizes > SMALL_NODE].tolist(), sizes[sizes > SMALL_NODE].tolist(), strict=True):
            labels = gray_links(fps[start : start + size])
            tied = np.flatnonzero(labels != np.arange(size))
            pairs.append((reps[start + tied], reps[start + labels[tied]]))
        a = np.concatenate([p[0] for p in pairs]) if pairs else reps[:0]
        b = np.concatenate([p[1] for p in pairs]) if pairs else reps[:0]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        path, key, fps, reps = now
        changes = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
        last = int(changes[-1]) if len(changes) else 0
        held = [x[last:] for x in now]
        if last:
            node = np.zeros(last, dtype=np.int64)
            node[changes[:-1]] = 1
            yield solve(np.cumsum(node), fps[:last].view(np.uint64), reps[:last])
    if held is not None and len(held[0]):
        yield solve(np.zeros(len(held[0]), dtype=np.int64), held[2].view(np.uint64), held[3])


def links(entries: DataFrame, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (a, b), a > b, between representatives of fingerprints; they connect all that differ in at most three bits.

    ``entries``: distinct ``fp`` with its representative ``rep``.
    """

    def nodes(rows: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
        """``masks``: (number of the mask, bits)."""
        options = [F.struct(F.lit(number).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(bits))).alias("key")) for number, bits in masks]
        return rows.select(F.explode(F.array(*options)).alias("node"), "fp", "rep").select("node.path", "node.key", "fp", "rep")

    current = nodes(entries, list(enumerate(MASKS)))
    masks = dict(enumerate(MASKS))
    solved = []
    while True:
        large = materialize(current.groupBy("path", "key").count().where(F.col("count") > node_limit).select("path", "key"))
        paths = [r["path"] for r in large.select("path").distinct().collect()]  # at most as many as there are masks
        if not paths:
            solved.append(current)
            break
        solved.append(current.join(F.broadcast(large) if large.count() <= 10_000 else large, ["path", "key"], "left_anti"))
        split, finer = [], {}
        for path in paths:
            rows = current.where(F.col("path") == path).join(large.where(F.col("path") == path), ["path", "key"], "left_semi")
            new = [(4 * path + k + len(MASKS), masks[path] | part) for k, part in enumerate(quarters(masks[path])) if part]
            finer |= dict(new)
            split.append(nodes(rows, new))
        masks = finer
        current = materialize(_union(split))
    rows = _union(solved)
    spread = rows.repartition("path", "key").sortWithinPartitions("path", "key", gray_rank(F.col("fp")))
    return spread.select("path", "key", "fp", "rep").mapInArrow(_links, "a long, b long")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def near_duplicates(docs: DataFrame, size: int = 3, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    prints = materialize(fingerprints(docs, size))
    entries = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = components(links(entries.where("rep is not null").drop("n"), node_limit))
    classes = entries.join(found, entries["rep"] == found["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"), "n")
    return looked_up(prints, materialize(classes), ["fp"], "n", F.col("doc_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
