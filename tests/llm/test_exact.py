"""Exact duplicates against plain grouping, collisions of the hash, odd rows."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from orgatlas.llm import exact


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of every row."""
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    sizes = Counter(body(t) for _, t in rows)
    least = {}
    for i, t in rows:
        if i is not None:
            least[body(t)] = min(i, least.get(body(t), i))
    return sorted(((i, least.get(body(t)), sizes[body(t)], i == least.get(body(t)), hashlib.sha256(body(t).encode()).hexdigest()) for i, t in rows), key=str)


ROWS = [(9, "same  text"), (3, "same text"), (7, "same\ttext"), (8, "same text "), (1, None), (2, ""), (4, " "), (5, "\n\x0b"), (3, "same text"), (None, "same text"), (None, "only here"), (None, "only here"), (6, "same\xa0text"), (10, "ünï 😀")]


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_groups_equal_plain_grouping(make_docs, odd_docs):
    assert found(exact.exact_duplicates(make_docs(ROWS))) == brute(ROWS)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(exact.exact_duplicates(odd_docs)) == brute(odd)


def test_colliding_hashes_are_told_apart_by_their_bytes(make_docs):
    for weak in (lambda body: F.length(body), lambda body: F.lit(1), lambda body: F.left(body, F.lit(1))):
        assert found(exact.exact_duplicates(make_docs(ROWS), weak)) == brute(ROWS)


def test_large_groups_and_singles(spark, make_docs):
    rows = [(i, f"text {min(i % 7, 3)}" if i % 2 else f"single {i}") for i in range(3_000)]
    assert found(exact.exact_duplicates(make_docs(rows))) == brute(rows)
    plan = exact.exact_duplicates(make_docs(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_dropped_copies_leave_whole_rows(make_docs, no_docs):
    docs = make_docs(ROWS)
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "same text"), (3, "same text"), (8, "same text "), (1, None), (4, " "), (None, "only here"), (None, "only here"), (6, "same\xa0text"), (10, "ünï 😀")], key=str)
    assert exact.exact_duplicates(no_docs).count() == 0 == exact.drop_exact_copies(no_docs).count()
