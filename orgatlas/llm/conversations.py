"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations become one weighted sequence with the list of conversations that end there. Sequences that are proper prefixes of others
leave by an anti join; those that remain are the leaves. Only one conversation of each sequence is then spelled out into its prefixes,
each with the weight of the sequence, and prefixes are added up: members, leaves, words.

Texts never travel: a turn is 120 bits of the MD5 of its role and text, and its number of words. A prefix is its depth and the exclusive or of its turns, each
hashed with its place, so that prefixes of a conversation come from running sums. No task takes a whole conversation: turns
are placed by a range partition and the counts of the parts before, prefixes by blocks of ``BLOCK`` turns.

The words saved below a node are a sum over its subtree, taken without visiting it. Members' words less what stands above the node, less the words of the distinct
nodes below. Of these, each node is owned by its least conversation; along one conversation the owned nodes are a tail, so a node needs only
the owned words of its members, and those of its own owner from here on. Keys that hold a thousandth of the rows (the root, a common first turn, a very
long conversation) are looked up in a broadcast table of at most a thousand rows.

The list of conversations that end at a node is hashed in order from sorted pieces of at most ``CHUNK`` ids, read one after another.

Defined results: rows without conv_id are left out; a null role or text is empty; turns with null come first; rows of one conversation with equal turn stand in the order of
the digests of role and text; repeated rows are turns of their own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgatlas.llm.shared import looked_up, materialize, words_of

#: Turns of one conversation that a running sum takes at once, and conversation ids in one piece of an end list (as a power of two).
BLOCK, CHUNK_BITS = 1024, 13
CHUNK = 1 << CHUNK_BITS
NODE = ["depth", "x1", "x2"]


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, words): every turn with its place in its conversation, from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    part = lambda start: F.conv(F.substring("digest", start, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.size(words_of(text)).cast("long").alias("words"))
    rows = rows.select("conv_id", "turn", part(1).alias("t1"), part(16).alias("t2"), "words").withColumn("tie", F.rand(7))  # equal rows can be parted too
    placed = materialize(rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "t1", "t2", "tie").withColumn("part", F.spark_partition_id()).drop("tie"))
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2"))
    both = placed.withColumn("within", within).join(counts.select("conv_id", "part", before.alias("before")), ["conv_id", "part"])
    return both.select("conv_id", (F.col("before") + F.col("within")).alias("pos"), "t1", "t2", "words")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))


def branched(conversations: DataFrame, heads: Column, source: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another one: (turns, conversations).

    ``source``: the conversation that lends its first ``heads`` turns (all of fewer, none if it is absent; ``most`` at most), as expressions of conv_id. A conversation's own turns
    after its first ``heads`` follow. Every conv_id stays, also without turns.
    """
    turns = materialize(ordered(conversations))
    sizes = materialize(lengths(turns))
    plans = sizes.select("conv_id", "n_turns", heads.cast("long").alias("heads"), source.cast("long").alias("source"))
    plans = materialize(plans.join(sizes.select(F.col("conv_id").alias("source"), F.col("n_turns").alias("there")), "source", "left").withColumn("lent", F.least("heads", F.coalesce("there", F.lit(0).cast("long")))))
    first = turns.where(F.col("pos") <= most).join(plans.select("source").distinct().withColumnRenamed("source", "conv_id"), "conv_id", "left_semi")
    lent = plans.where("lent > 0").select("conv_id", "source", "lent").join(first.withColumnRenamed("conv_id", "source"), "source").where("pos <= lent")
    own = looked_up(turns, plans.select("conv_id", "n_turns", "heads", "lent"), ["conv_id"], "n_turns", F.col("pos")).where("pos > heads")
    rows = lent.select("conv_id", "pos", "t1", "t2", "words").unionByName(own.select("conv_id", (F.col("pos") - F.col("heads") + F.col("lent")).alias("pos"), "t1", "t2", "words"))
    return rows, plans.select("conv_id")


def sequences(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, total): the whole sequence of each conversation, and its words. ``rows``: conv_id, pos, f1, f2, words."""
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("depth"), F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2"), F.sum("words").alias("total"))
    return convs.join(whole, "conv_id", "left").fillna(0)


def prefixes(rows: DataFrame, collapsed: DataFrame) -> DataFrame:
    """(rep, depth, x1, x2, p1, p2, above, words, weight, size, total): all prefixes of one conversation of each sequence; p1, p2: its parent's."""
    facts = collapsed.select(F.col("rep").alias("conv_id"), F.col("weight"), F.col("depth").alias("size"), "total")
    chosen = looked_up(rows, materialize(facts.where("size > 0")), ["conv_id"], "size", F.col("pos")).where("weight is not null")
    chosen = materialize(chosen.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")))
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = chosen.select("*", F.bit_xor("f1").over(upto).alias("x1"), F.bit_xor("f2").over(upto).alias("x2"), F.sum("words").over(upto).alias("upto"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = chosen.where(F.col("size") >= BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("f1").alias("e1"), F.bit_xor("f2").alias("e2"), F.sum("words").alias("e"))
    blocks = blocks.select("conv_id", "block", F.bit_xor("e1").over(earlier).alias("e1"), F.bit_xor("e2").over(earlier).alias("e2"), F.sum("e").over(earlier).alias("e"))
    joined = run.join(blocks, ["conv_id", "block"], "left").fillna(0, ["e1", "e2", "e"])
    x1, x2 = F.col("x1").bitwiseXOR(F.col("e1")), F.col("x2").bitwiseXOR(F.col("e2"))
    deep = joined.select(
        F.col("conv_id").alias("rep"), F.col("pos").alias("depth"), x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("f1")).alias("p1"), x2.bitwiseXOR(F.col("f2")).alias("p2"), (F.col("upto") + F.col("e") - F.col("words")).alias("above"), "words", "weight", "size", "total"
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = collapsed.select("rep", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"), zero.alias("above"), zero.alias("words"), "weight", F.col("depth").alias("size"), "total")
    return deep.unionByName(root)


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's sorted pieces, which follow each other."""
    node, running = None, None

    def done(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], [*NODE, "ends_sha256"])

    for batch in batches:
        rows = []
        for *own, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != node:
                if node is not None:
                    rows.append((*node, running.hexdigest()))
                node, running = own, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield done(rows)
    if node is not None:
        yield done([(*node, running.hexdigest())])


def end_lists(ended: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) from (conv_id, depth, x1, x2): ids in numerical order, joined by commas."""
    pieces = ended.groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("piece")).agg(F.sort_array(F.collect_set("conv_id")).alias("ids"))
    texts = pieces.select(*NODE, "piece", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    lined = texts.repartition(*NODE).sortWithinPartitions(*NODE, "piece").drop("piece")
    return lined.mapInArrow(_hash_lists, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node. ``turns``: conv_id, pos (from 1, gapless), t1, t2, words; ``convs``: every conv_id, also those without turns.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    mixed = lambda k: F.xxhash64(F.lit(k), "pos", "t1", "t2")
    rows = materialize(turns.select("conv_id", "pos", mixed("first").alias("f1"), mixed("second").alias("f2"), "words"))
    ended = materialize(sequences(rows, convs))
    collapsed = materialize(ended.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("rep"), F.first("total").alias("total")))
    spelled = materialize(prefixes(rows, collapsed))
    proper = spelled.where("depth < size").select(*NODE).distinct()
    leaves = collapsed.join(proper, NODE, "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    nodes = materialize(spelled.groupBy(*NODE).agg(
        F.count("*").alias("n_rows"), F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("above").alias("above"), F.sum(F.col("weight") * F.col("total")).alias("spoken")
    ))
    owner = nodes.select(*NODE, F.col("conv_id").alias("owner"), "n_rows")
    owned = materialize(looked_up(spelled, owner, NODE, "n_rows", F.col("rep")).select(*NODE, "rep", "above", "total", F.when(F.col("owner") == F.col("rep"), F.col("words")).alias("owned")))
    reps = owned.groupBy("rep").agg(F.count("*").alias("n"), F.coalesce(F.sum("owned"), F.lit(0).cast("long")).alias("all_owned"))
    reps = materialize(reps.join(leaves, "rep", "left").fillna(0, ["leaf"]))
    rest = F.col("total") - F.col("above") - F.col("all_owned")
    below = looked_up(owned, reps, ["rep"], "n", F.xxhash64(*NODE)).groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), (F.sum("all_owned") + F.sum(F.when(F.col("owned").isNotNull(), rest))).alias("distinct_words"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    full = materialize(nodes.join(below, NODE).join(children, NODE, "left").fillna(0, ["n_children"]))
    parents = full.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    found = looked_up(full.withColumnRenamed("n_children", "own_children"), parents, ["depth", "p1", "p2"], "n_children", F.col("conv_id")).join(end_lists(ended), NODE, "left")
    saved = F.col("spoken") - F.col("n_convs") * F.col("above") - F.col("distinct_words")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("own_children").alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = materialize(ordered(conversations))
    return trie(turns, materialize(lengths(turns).select("conv_id")))


#: Conversations that stand together, and how many of the first one's turns the others take (by a CRC of the id).
FAMILY, HEADS = 20, 4


def shared_starts(conversations: DataFrame) -> DataFrame:
    """The trie after each conversation took its first 0 to 3 turns from the first one of its family of twenty."""
    conv = F.col("conv_id")
    turns, convs = branched(conversations, F.crc32(conv.cast("string").cast("binary")) % HEADS, conv - conv % FAMILY, HEADS - 1)
    return trie(turns, convs)


SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(d, 1, 30)) AS pos, role, text FROM
  (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
h AS (SELECT conv_id, conv_id - conv_id % 20 AS source, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda v, c: list_reduce([xor(v, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 4 AS heads FROM n),
r AS (SELECT h.conv_id, t.pos, role, text FROM h JOIN t ON t.conv_id = h.source AND t.pos <= h.heads
  UNION ALL SELECT h.conv_id, t.pos - h.heads + least(h.heads, coalesce(n.n, 0)), role, text FROM h JOIN t USING (conv_id) LEFT JOIN n ON n.conv_id = h.source WHERE t.pos > h.heads),
s AS (SELECT conv_id, coalesce(list(sha256(role || chr(31) || text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS seq, coalesce(list(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS words FROM h LEFT JOIN r USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, unnest(range(0, len(seq) + 1)) AS depth, seq, words FROM s),
k AS (SELECT conv_id, depth, array_to_string(seq[1:depth], ' ') AS node, CASE WHEN depth > 0 THEN array_to_string(seq[1:depth - 1], ' ') END AS up, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS w, len(seq) = depth AS ended FROM p),
d AS (SELECT node, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(w) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM k GROUP BY node, depth),
c AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM d WHERE depth > 0 GROUP BY ALL),
f AS (SELECT d.*, coalesce(n_children, 0) AS n_children FROM d LEFT JOIN c USING (node, depth)),
a AS (SELECT node, saved, n_children, unnest(range(0, depth + 1)) AS top FROM f),
u AS (SELECT top AS depth, array_to_string(string_split(node, ' ')[1:top], ' ') AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM a GROUP BY ALL)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (node, depth) LEFT JOIN f q ON q.node = f.up AND q.depth = f.depth - 1
"""
