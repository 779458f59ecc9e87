"""The prefix trie against a trie of dictionaries: random conversations with shared starts, long and hot ones, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from orgatlas.llm import conversations as C


def turns_of(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:30]
            out[conv].append((turn is not None, turn or 0, digest, role, text))
    return {conv: [(t[3], t[4]) for t in sorted(own)] for conv, own in out.items()}


def regrafted(own):
    out = {}
    for conv in own:
        heads = zlib.crc32(str(conv).encode()) % 4
        out[conv] = own.get(conv - conv % 20, [])[:heads] + own[conv][heads:]
    return out


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def brute(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(conv)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        saved[node] = (len(members[node]) - 1) * (words(node[-1][1]) if node else 0) + sum(saved[c] for c in below)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], sha(ends[node])) for node, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "conv_id long, turn long, role string, text string, words long, depth string")


def test_trie_equals_dictionaries(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(C, "BLOCK", 3)
    monkeypatch.setattr(C, "CHUNK_BITS", 2)
    rows = [(conv, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "d  e\tf", ""])) for conv in range(90) for t in range(rng.randrange(0, 6))]
    rows += [(200, t, "user", f"turn {t % 3}") for t in range(25)] + [(240, t, "user", f"turn {t % 3}") for t in range(25)] + [(241, t, "user", f"turn {t % 3}") for t in range(9)]
    rows += [(conv, t, "user", "hot") for conv in range(300, 340) for t in range(3)]
    own = turns_of(rows)
    assert found(C.prefix_trie(table(spark, rows))) == brute(own)
    assert found(C.shared_starts(table(spark, rows))) == brute(regrafted(own))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 5, "user", "x"), (1, 5, "user", "x"), (1, 5, "assistant", "y"), (1, None, "user", "first?"), (-3, 1, "user", "x y z"), (2, 1, "", None), (None, 1, "user", "nobody"), (41, 1, "user", "one")]
    own = turns_of(rows)
    assert found(C.prefix_trie(table(spark, rows))) == brute(own)
    assert found(C.shared_starts(table(spark, rows))) == brute(regrafted(own))
    assert C.shared_starts(table(spark, rows).limit(0)).count() == 0 == C.prefix_trie(table(spark, rows).where("conv_id is null")).count()


@pytest.mark.parametrize("turns", [1, 2])
def test_conversations_that_lose_all_turns_are_members_of_the_root(spark, turns):
    rows = [(conv, t, "user", f"{conv}") for conv in range(101, 119) for t in range(turns)]  # conversation 100 is absent
    got = found(C.shared_starts(table(spark, rows)))
    assert got == brute(regrafted(turns_of(rows))) and [r for r in got if r[1] == 0][0][3] == 18


def test_a_conversation_is_placed_over_several_parts(spark):
    rows = spark.range(20_000).selectExpr("5L AS conv_id", "id % 7000 AS turn", "'user' AS role", "cast(id AS string) AS text")
    placed = C.ordered(rows)
    assert placed.select("pos").distinct().count() == 20_000 and placed.agg({"pos": "max"}).first()[0] == 20_000
    top = C.prefix_trie(rows).orderBy("depth").collect()
    assert len(top) == 20_001 and [r.depth for r in top] == list(range(20_001)) and {r.n_leaves for r in top} == {1} and {r.saved_tokens for r in top} == {0}
