import itertools
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from orgatlas.llm import decontamination as dc


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def aligned(item, doc):
    """Most matches of any local alignment (a table over all pairs of positions), and the longest common run."""
    best, run = (0.0, 0), 0
    score = [[(0.0, 0)] * (len(doc) + 1) for _ in range(len(item) + 1)]
    runs = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            same = item[i - 1] == doc[j - 1]
            runs[i][j] = runs[i - 1][j - 1] + 1 if same else 0
            run = max(run, runs[i][j])
            s, m = score[i - 1][j - 1]
            score[i][j] = max((s + 1, m + 1) if same else (s - 1.5, m), (score[i - 1][j][0] - 1.5, score[i - 1][j][1]), (score[i][j - 1][0] - 1.5, score[i][j - 1][1]), (0.0, 0))
            best = max(best, score[i][j])
    return best[1], run


def test_masks_hit_every_placement():
    """One substituted token in five never hides an item."""
    for size in (8, 9, 10, 11, 12, 13, 15, 19, 20, 24):
        for gone in itertools.combinations(range(size), size // 5 if size >= 12 else 1):
            left = [i not in gone for i in range(size)]
            assert any(all(left[p + k] for k, c in enumerate(m) if c == "1") for m in dc.MASKS[:3] for p in range(size - len(m) + 1)), (size, gone)
    for size in (25, 30, 44, 59):  # least number of substitutions that avoids all masks, by their last tokens
        states = {(): 0}
        for _ in range(size):
            after = {}
            for state, cost in states.items():
                for token in (0, 1):
                    last = (*state, token)[-7:]
                    if not any(len(last) >= len(m) and all(last[len(last) - len(m) + k] for k, c in enumerate(m) if c == "1") for m in dc.MASKS[3:]):
                        after[last] = min(after.get(last, 99), cost + 1 - token)
            states = after
        assert min(states.values()) > size // 5


@pytest.mark.parametrize("seed", [2, 3])
def test_equals_brute_force(spark, make_docs, seed):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.choice([6, 10, 15, 24, 30, 59]))) for i in range(30)]
    docs = []
    for i in range(90):
        text, item = words(rng, 60), list(items[i % 30][1])
        way = i % 6
        if way == 1:
            for k in range(2, len(item), 5):
                item[k] = "substituted"
        elif way == 2:
            item.insert(len(item) // 2, "inserted")
        elif way == 3:
            del item[len(item) // 2]
        elif way == 4:
            item = item[: len(item) // 2]
        elif way == 5:
            item = items[(i * 7) % 30][1][:4] + words(rng, 5)
        text[20:20] = [w.upper() if i % 4 else w + "," for w in item]
        docs.append((i, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(t), 0) for i, t in items], "item_id long, text string, start int")
    found = {(r.doc_id, r.item_id) for r in dc.contamination(make_docs(docs), bench).collect()}
    truth = set()
    for d, text in docs:
        for i, item in items:
            matches, run = aligned(item, text.lower().replace(",", "").split())
            if matches >= min(len(item), max(dc.LEAST, dc.SHARE * len(item))) or run >= dc.RUN:
                truth.add((d, i))
    # overlaps of fewer tokens than four in five may miss all seeds; here none does
    assert found == truth


def test_alignment_bridges_diagonals():
    item = np.arange(40)
    doc = np.concatenate((np.arange(100, 110), item[:20], [7_000], item[20:], np.arange(200, 210)))
    assert dc.on_one_diagonal(item, doc, 10)[2] == 20 and dc.overlap(item, doc, [10, 11]) == (10, 41, 40)
    assert dc.overlap(item, np.delete(doc, [15, 25]), [10, 9, 8])[2] == 38 and dc.overlap(item, doc[:15], [10]) is None


def test_odd_rows_and_short_items(spark, make_docs, odd_docs, no_docs):
    rng = random.Random(7)
    long = words(rng, 30)
    bench = spark.createDataFrame([(1, "yes", 0), (2, "a short item of five", 0), (3, None, 0), (4, "", 0), (5, " ".join(long), 0), (6, " ".join(long).upper(), 0), (None, "x y z a b c d e f", 0)], "item_id long, text string, start int")
    rows = [(1, "well yes of course it rained"), (2, "this is A SHORT item, of five words"), (3, " ".join(words(rng, 3_000) + long + words(rng, 9))), (3, "other text"), (None, " ".join(long)), (8, " ".join(long * 40))]
    docs = make_docs([*rows, rows[1]])
    assert {(r.doc_id, r.item_id) for r in dc.contamination(docs, bench).collect()} == {(2, 2), (3, 5), (3, 6), (8, 5), (8, 6)} and dc.contamination(docs, bench).count() == 5
    kept = dc.decontaminate(docs, bench)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, rows[0][1]), (3, "other text")] and kept.columns == docs.columns
    assert dc.contamination(odd_docs, bench).count() == 0 and dc.contamination(no_docs, bench).count() == 0 and dc.decontaminate(odd_docs, bench).count() == 8
    assert dc.contamination(docs, bench.where("item_id < 0")).count() == 0 and dc.decontaminate(docs, bench.where("item_id < 0")).count() == 7
    assert [s[0] for s in corpus_pipeline.STAGES][2] == "decontamination"


@pytest.mark.parametrize("size", [12, 20, 25, 30, 50])
def test_masks_find_overlaps_from_three_quarters_on(size):
    """With random substitutions some mask fits in nine of ten overlaps of at least three quarters of an item."""
    rng = random.Random(size)
    own = dc.MASKS[: dc.SHORT_MASKS] if size < dc.LONG else dc.MASKS[dc.SHORT_MASKS :]
    for share in (0.75, 0.8, 0.9):
        found = 0
        for _ in range(600):
            changed = set(rng.sample(range(size), size - math.ceil(share * size)))
            found += any(all(c == "0" or start + k not in changed for k, c in enumerate(mask)) for mask in own for start in range(size - len(mask) + 1))
        assert found >= 0.9 * 600, (size, share, found)
