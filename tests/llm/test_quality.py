import re
from collections import Counter

from orgatlas.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = ["a b c d a b c e a b", "x " * 60, "one two three four " * 20 + "\nsame line\nsame line\n \n", " ".join(f"word{i}" for i in range(80)), "### *** a|b <c>", "a a a", "a a a a"]


def test_counts_equal_brute_force(make_docs, odd_docs):
    rows = quality.judge(make_docs(list(enumerate(TEXTS))), order=list(quality.rules())).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    odd = {r.doc_id: r for r in quality.judge(odd_docs).collect()}
    assert odd[1].n_words == odd[2].n_words == odd[3].n_words == 0 and not odd[1].kept
    assert odd[4].n_words == 30_000 and odd[4].kept and odd[6].n_words == 4


def test_order_changes_only_the_named_rule(make_docs):
    docs = make_docs([(0, "LOUD WORDS EVERYWHERE | " * 30), (1, " ".join(f"calm{i}" for i in range(90)))])
    names = list(quality.rules())
    a = {r.doc_id: r.kept for r in quality.judge(docs, names).collect()}
    b = {r.doc_id: r.kept for r in quality.judge(docs, names[::-1]).collect()}
    assert a == b == {0: False, 1: True}


def test_cascade_order_is_stable(spark, make_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    orders = {tuple(quality.cascade_order(docs, quality.rules())) for _ in range(3)}
    assert len(orders) == 1 and sorted(*orders) == sorted(quality.rules())
    assert quality.judge(no_docs).count() == 0 and quality.cascade_order(no_docs, quality.rules()) == list(quality.rules())


def test_greedy_order_is_conditional():
    """A rule that rejects only what an earlier one rejects comes last, and costs count."""
    outcomes = [(True, True, False)] * 60 + [(False, False, True)] * 20 + [(False, False, False)] * 20
    assert quality.greedy_order(outcomes, [1.0, 1.1, 1.0]) == [0, 2, 1]
    assert quality.greedy_order(outcomes, [1.0, 1.1, 0.1]) == [2, 0, 1] and quality.greedy_order([], [1.0, 2.0]) == [0, 1]


def test_sampling_moves_no_rows(make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(5_000)])
    plan = quality.measured(quality.sampled(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Sample" in plan and "Exchange" not in plan and "Limit" not in plan
    assert 280 < quality.sampled(docs).count() < 520


def test_no_python_in_the_plan(make_docs):
    plan = quality.judge(make_docs([(1, "a b")]), order=list(quality.rules()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
