import random

import corpus_pipeline
import pytest

from orgatlas.llm import near_copies


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> least doc_id of its component, by comparing all pairs."""
    rows = sorted(rows)
    sets, up = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    out = [None, "", " ", "one two", "ONE  two", "one two three four five six"]
    for _ in range(25):
        base = [f"w{rng.randrange(5_000)}" for _ in range(rng.choice([6, 30, 120, 300]))]
        out += [edited(rng, base, rng.choice([0, 1, 2, len(base) // 50, len(base) // 25])) for _ in range(6)]
    line = "a very common line that stands in many of these documents today"
    out += [" ".join([line, *[f"v{rng.randrange(90)}" for _ in range(12)], line]) for _ in range(40)]
    base = [f"g{i}" for i in range(150)]
    out += [edited(rng, base, 3) for _ in range(60)]  # one large group, not all of it similar
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("first", [8, 2])
def test_equals_brute_force(make_docs, monkeypatch, first):
    monkeypatch.setattr(near_copies, "FIRST", first)
    monkeypatch.setattr(near_copies, "FARTHER", 3)
    rows = corpus(first)
    found = near_copies.near_copies(make_docs([*rows, (None, rows[-1][1]), rows[-1]])).collect()
    assert len(found) == len(rows) + 1 and {r.doc_id: r.component_id for r in found} == brute(rows)


def test_stage_drops_edited_copies(spark, make_docs, odd_docs, no_docs):
    words = [f"w{i}" for i in range(300)]
    near = [*words[:50], "new", *words[51:150], "new", *words[151:250], "new", *words[251:]]  # similarity 281 of 311
    far = ["new" if i % 25 == 0 else w for i, w in enumerate(words)]
    docs = make_docs([(4, " ".join(words)), (6, " ".join(near)), (8, " ".join(far)), (None, " ".join(words))])
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == {4, 8, None}
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_dedup_stage(spark, odd_docs, "").collect()) == [0, 1, 4, 5, 6]
    assert corpus_pipeline.near_dedup_stage(spark, no_docs, "").count() == 0


def test_rows_are_told_apart_by_text(spark, make_docs):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (1, text("c")), (5, text("d")), (5, text("d")), (None, text("d")), (None, None), (7, None), (8, "")]
    kept = corpus_pipeline.near_dedup_stage(spark, make_docs(rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, text("a")), (2, text("b")), (1, text("c")), (5, text("d")), (None, text("d")), (None, None), (7, None)], key=str)


def test_stage_equals_brute_force(spark, make_docs):
    rows = corpus(3)
    best = brute(rows)
    kept = corpus_pipeline.near_dedup_stage(spark, make_docs([*rows, rows[4], rows[4]]), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, _ in rows if best[i] == i)


def test_fingerprints_give_the_first_links(spark, make_docs, monkeypatch):
    """without the prefix filter, close copies are still found by SimHash, and texts that only share a fingerprint's bits are not."""
    words = [f"w{i}" for i in range(2_000)]
    rows = [(3, " ".join(words)), (4, " ".join([*words[:900], "new", *words[901:]])), (5, " ".join(f"v{w}" for w in words))]
    monkeypatch.setattr(near_copies, "paired", lambda rows, low, high: spark.createDataFrame([], near_copies.ROWS))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, make_docs(rows), "").collect()) == [3, 5]
    monkeypatch.setattr(near_copies, "by_fingerprint", lambda first: spark.createDataFrame([(a.e, b.e) for a in first.collect() for b in first.collect() if a.e > b.e], "a long, b long"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, make_docs(rows), "").collect()) == [3, 5]


def test_rows_without_a_fitting_partner_are_read_once():
    """Rows for later rounds: none where sizes are too far apart or all entries are linked, else those that fit beyond the first distances."""
    import pyarrow as pa

    def later(sizes, labels):
        n = len(sizes)
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([7] * n, sizes, [0] * n, range(n), labels, [0] * n)], ["key", "n", "pos", "e", "label", "place"])
        out = [r for b in near_copies._pairs(iter([batch]), 0, 2) for r in b.to_pylist() if r["b"] is None]
        return [(r["a"], r["place"]) for r in out]

    assert later([2**i for i in range(12)], range(12)) == [] and later([100] * 12, [0] * 12) == []
    assert later([10, 100, 101, 102, 103, 500, 900], range(7)) == [(1, 1), (4, 4)] and len(later([100] * 12, range(12))) == 12


def test_linked_partners_are_not_handed_on():
    """Only rows with a partner of another label farther off go to later rounds, and each round tells which are left."""
    import pyarrow as pa

    def later(labels, places, low, high):
        n = len(labels)
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([7] * n, [100] * n, [0] * n, range(n), labels, places)], ["key", "n", "pos", "e", "label", "place"])
        return sorted(r["place"] for b in near_copies._pairs(iter([batch]), low, high) for r in b.to_pylist() if r["b"] is None)

    assert later([0] * 11 + [1], [0] * 12, 0, 2) == [*range(9), 11] and later([0] * 9 + [1] * 3, [0] * 12, 0, 8) == [0, 1, 2, 9, 10, 11]
    assert later([0, 1, 2, 3], [0, 5, 16, 40], 2, 16) == [0, 5, 16, 40] and later([0, 1, 2, 3], [0, 5, 14, 16], 2, 16) == [] and later([0, 1, 1, 0], [0, 5, 16, 40], 2, 16) == [5, 16, 40]


def test_close_groups_are_linked_before_rows_are_handed_on(make_docs, monkeypatch):
    """A group of near copies makes no rows for later rounds, however large: its least shingles link it before."""
    rng, handed, write = random.Random(4), [], near_copies.materialize

    def counted(df):
        out = write(df)
        if "place" in out.columns:
            handed.append(out.where("b is null").count())
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    base = [f"g{i}" for i in range(400)]
    rows = [(i, edited(rng, base, 1)) for i in range(40)]
    assert {r.component_id for r in near_copies.near_copies(make_docs(rows)).collect()} == {0} and handed == [0]


def shared_bucket(sets, keys=((7,),), last=False):
    """Rows that a round with maps makes of ``sets`` with a label each, which meet in the buckets ``keys`` names: of all rows, or of each."""
    import numpy as np
    import pyarrow as pa

    keys = list(keys) * (len(sets) // len(keys))
    rows = sorted((k, len(s), i) for i, s in enumerate(sets) for k in keys[i])
    maps = [near_copies.parity(np.array(sorted(s), dtype=np.uint64)) for s in sets]
    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[2] for r in rows]]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *(pa.array(c, pa.list_(pa.int64())) for c in ([maps[r[2]] for r in rows], [keys[r[2]] if last else None for r in rows]))], ["key", "n", "e", "label", "map", "keys"])
    parts = [batch.slice(at, 7) for at in range(0, batch.num_rows, 7)]  # buckets span batches
    return [r for b in near_copies._met(iter(parts), last) for r in b.to_pylist()]


def test_a_large_bucket_makes_rows_in_proportion():
    """Unlike sets make none; of like ones each is paired with one, and handed on while it has others."""
    rng = random.Random(9)
    draw = lambda n: {rng.randrange(1 << 62) for _ in range(n)}
    base = draw(300)
    assert shared_bucket([{*draw(300), 7} for _ in range(60)]) == []
    for n in (60, 120):
        out = shared_bucket([base | draw(3) for _ in range(n)])
        assert n / 2 <= sum(r["b"] is not None for r in out) <= n and sum(r["b"] is None for r in out) == n
    assert {(r["a"], r["b"]) for r in shared_bucket([base | draw(3), draw(300), base | draw(3)])} == {(2, 0)}


def test_the_last_round_pairs_once():
    """All partners that are left meet, each pair in the least bucket that both share."""
    rng = random.Random(10)
    base = {rng.randrange(1 << 62) for _ in range(300)}
    sets = [base | {rng.randrange(1 << 62) for _ in range(3)} for _ in range(30)]
    out = shared_bucket(sets, [(3, 7, 9), (-4, 7, 9)], last=True)
    assert len(out) == 30 * 29 // 2 and {(r["a"], r["b"]) for r in out} == {(a, b) for a in range(30) for b in range(a)}


def test_a_group_short_of_similar_is_not_paired_in_full(make_docs, monkeypatch):
    """Texts of one family, each similar to few others: rows of all rounds grow with the family, not with its square."""
    made, write = [], near_copies.materialize

    def counted(df):
        out = write(df)
        if "place" in out.columns:
            made[-1] += out.count()
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    for size in (40, 120):
        rng = random.Random(11)
        base = [f"g{i}" for i in range(300)]
        rows = [(i, edited(rng, base, 12)) for i in range(size)]
        made.append(0)
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(make_docs(rows)).collect()} == brute(rows)
    assert made[0] and made[1] < 4.5 * made[0]
