"""Ranked retrieval against all pairs, on names of few and frequent words."""

import math
import random
from collections import Counter

import pytest

from orgatlas.operators import retrieval


def names(rng, n):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    weights = [1 / (1 + i) for i in range(40)]
    return [" ".join(rng.choices(words, weights, k=rng.randrange(1, 5)) + ([f"own{i // 3}"] if i % 8 == 0 else [])) for i in range(n)]


def brute(company, record, k):
    """(company, scope) -> scores of the best k."""
    bags = {r: (frozenset(n.split()), c) for r, n, c in record}
    counts = Counter(w for bag, _ in bags.values() for w in bag)
    weight = {w: math.log(1 + len(record) / n) for w, n in counts.items()}
    length = lambda bag: math.sqrt(sum(weight[w] ** 2 for w in bag))
    out = {}
    for i, name, country in company:
        own = {w for w in name.split() if w in weight}
        for scope in ("", country):
            scores = [sum(weight[w] ** 2 for w in own & bag) / (length(own) * length(bag)) for bag, c in bags.values() if own & bag and scope in ("", c)]
            out[i, scope] = sorted(scores, reverse=True)[:k]
    return {key: scores for key, scores in out.items() if scores}


@pytest.mark.parametrize("many,block", [(5, 4), (50, 16), (10_000, 128)])
def test_best_records_are_those_of_all_pairs(spark, monkeypatch, many, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = random.Random(many)
    record = [(i, n, rng.choice(["gb", "us"])) for i, n in enumerate(names(rng, 1500))]
    company = [(i, n, rng.choice(["gb", "us"])) for i, n in enumerate(names(rng, 60))]
    company += [(100, record[7][1], "gb"), (101, "unknownword", "gb")]
    frames = spark.createDataFrame(company, "company_id long, name string, country string"), spark.createDataFrame(record, "record_id long, name string, country string")
    got = {}
    for r in retrieval.search_names(*frames, k=10, many=many).orderBy("ord").collect():
        got.setdefault((r.company_id, r.scope), []).append(r.score)
    want = brute(company, record, 10)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-8)


def test_reads_little_of_frequent_lists(spark, monkeypatch):
    """Thousands of records with the same words: a query is done after the first blocks."""
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    record = spark.range(4000).selectExpr("id AS record_id", "concat('alpha trading ', CASE WHEN id % 4 = 0 THEN '' ELSE concat('n', id) END) AS name", "'gb' AS country")
    index = retrieval.build_index(record, many=32)
    seen = []
    read = retrieval._read
    monkeypatch.setattr(retrieval, "_read", lambda active, index, low, high, *rest: seen.append((active.count(), high)) or read(active, index, low, high, *rest))
    queries = spark.createDataFrame([(f"q{i}", "", t) for i, t in enumerate([["alpha", "trading"], ["alpha"], ["alpha", "n5", "trading"]])], "query string, scope string, tokens array<string>")
    best = retrieval.best_records(queries, index, 10).collect()
    assert seen == [(3, 2)]
    assert {r.record_id for r in best if r.query == "q0"} == set(range(0, 40, 4)) and [r.record_id for r in best if r.query == "q2" and r.ord == 1] == [5]


def test_odd_names(spark):
    record = spark.createDataFrame([(1, None, "gb"), (2, "", "gb"), (3, "Acme Ltd", None), (4, "Acme Ltd", "gb"), (4, "Acme Ltd", "gb")], "record_id long, name string, country string")
    company = spark.createDataFrame([(1, None, "gb"), (2, "ACME", "gb"), (3, "acme acme", None), (4, "...", "gb")], "company_id long, name string, country string")
    found = {(r.company_id, r.scope, r.record_id) for r in retrieval.search_names(company, record).collect()}
    assert found == {(2, "", 3), (2, "", 4), (2, "gb", 4), (3, "", 3), (3, "", 4)}
    assert retrieval.search_names(company.limit(0), record).count() == 0 == retrieval.search_names(company, record.limit(0)).count()
