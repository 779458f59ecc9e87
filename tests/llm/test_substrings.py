import hashlib
import random
import re

from orgatlas.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first, out = {}, []
    windows = {}
    for n, (doc_id, text) in enumerate(rows):
        words = windows[n] = WORD.findall(text or "")
        for k in range(len(words) - 49):
            key = tuple(words[k : k + 50])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    for n, (doc_id, _) in enumerate(rows):
        words, gone = windows[n], set()
        for k in range(len(words) - 49):
            if doc_id is not None and first[tuple(words[k : k + 50])] < doc_id:
                gone.update(range(k, k + 50))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(make_docs, rows):
    found = substrings.remove_repeats(make_docs(rows).repartition(3)).drop("kept").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_equals_brute_force(make_docs):
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(5000)
    passage, other, loop = [word() for _ in range(120)], [word() for _ in range(55)], [word() for _ in range(7)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(30, 200))]
        if i % 3 == 0:
            text[10:10] = passage[rng.randrange(40) : rng.randrange(60, 120)]
        if i % 4 == 0:
            text += other
        if i % 5 == 0:
            text += loop * rng.randrange(5, 30)
        rows.append((rng.randrange(10**6), " ".join(text)))
    rows += [(rows[0][0] + 1, rows[0][1]), (rows[1][0], rows[1][1]), (2, rows[2][1]), (rows[3][0], rows[4][1]), (None, rows[5][1]), (7, "\n\t".join(passage)), (8, " ".join(passage[:49])), (9, " ".join(passage[:50]))]
    near = rows[6][1].split()
    near[len(near) // 2] = "edited"
    check(make_docs, [*rows, (5, " ".join(near))])


def test_odd_rows(make_docs, odd_docs, no_docs):
    check(make_docs, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert substrings.remove_repeats(no_docs).count() == 0


def test_hot_passage_and_many_automata(make_docs, monkeypatch):
    monkeypatch.setattr(substrings, "PHRASES", 2)
    rng = random.Random(5)
    hot = [f"h{i}" for i in range(130)]
    rows = [(i, " ".join([*(f"a{rng.random()}" for _ in range(rng.randrange(40))), *hot[: rng.choice([130, 130, 130, 90])], *(f"b{rng.random()}" for _ in range(i % 3))])) for i in range(80)]
    check(make_docs, rows)


def test_the_automata_find_what_is_removed(make_docs, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(60))) for i in range(2)]
    removed = lambda: substrings.remove_repeats(make_docs(rows)).agg({"n_removed": "sum"}).first()[0]
    assert removed() == 60
    assert substrings.located([b"a", b"b", b"c", b"a", b"b"], {b"a b", b"c a"}).tolist() == [True, False, True, True, False]
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(substrings)
    monkeypatch.setattr(substrings, "located", lambda flat, phrases: substrings.np.zeros(len(flat), dtype=bool))
    try:
        assert removed() == 0
    finally:
        cloudpickle.unregister_pickle_by_value(substrings)


def test_many_repeated_rows_cost_no_square(spark, make_docs):
    """Thousands of rows with one doc_id and one text that an earlier document has as well."""
    import time

    text = " ".join(f"word{i}" for i in range(60))
    docs = make_docs([(1, text)] + [(2, text)] * 8_000)
    start = time.time()
    counts = substrings.remove_repeats(docs).groupBy("doc_id", "n_removed").count().collect()
    assert {(r.doc_id, r.n_removed, r["count"]) for r in counts} == {(1, 0, 1), (2, 60, 8_000)} and time.time() - start < 60
