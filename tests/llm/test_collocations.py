"""Phrases against plain counting: random texts with frequent pairs, split stripes, small blocks, exact scores, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from orgatlas.llm import collocations as P

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute(rows, most_words=3, least=10, top=2000, subsumed=50):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UPPER, UPPER.lower()))):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for size in range(1, most_words + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in candidates.items() for size in range(2, len(p)) for i in range(len(p) - size + 1) if (q := p[i : i + size]) in candidates and 100 * a >= subsumed * candidates[q]}
        rated = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, text, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, text.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(rng, n):
    words = ["The", "quick", "fox", "é", "\x1cx", "new", "york", "city", *[f"w{i}" for i in range(30)]]
    weights = [9, 5, 5, 3, 2, 4, 4, 3, *[1] * 30]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 40)):
            parts.append(rng.choice(["New York city", "the Quick", *rng.choices(words, weights, k=6)]) + rng.choice([" ", " ", " ", "  \t", ". ", "\n", ","]))
        rows.append((rng.choice(["en", "de", None]), "".join(parts)))
    return rows


@pytest.mark.parametrize("block,bits", [(300, 26), (12_000_000, 10)])
def test_phrases_equal_plain_counts(spark, block, bits):
    """Also with blocks of a few lines, with stripes that are split, and with a filter so full that it passes nearly everything."""
    rows = texts(random.Random(block), 150)
    docs = spark.createDataFrame([(i, lang, text, None) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, prefix string").repartition(3)
    assert found(P.collocations(docs, block_bytes=block, filter_bits=bits)) == brute(rows)
    assert found(P.collocations(docs, most_words=4, least=5, top=7, subsumed=80, block_bytes=block, filter_bits=bits)) == brute(rows, 4, 5, 7, 80)
    assert found(P.collocations(docs, most_words=2, least=3)) == brute(rows, 2, 3)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert found(P.collocations(odd_docs)) == brute(rows)
    assert P.collocations(no_docs).count() == 0
    same = spark.createDataFrame([("x", "a b. A  B! a\tb")] * 5 + [("x", None), ("x", ""), ("x", ".,;"), (None, "a b"), ("und", "a b " * 10)], "lang string, text string")
    assert found(P.collocations(same)) == brute([tuple(r) for r in same.collect()])


def test_very_long_text_is_cut_at_ends_of_pieces():
    import pyarrow as pa

    text = "one two three. " * 40 + "no end in sight " * 20
    made = list(P.blocks(iter([pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": [text, "last"]})]), 50))
    whole = " . ".join(b.decode() for _, b in made)
    assert whole.replace(".", " ").split() == (text + " last").replace(".", " ").split() and len(made) > 5 and all(b"three o" not in b for _, b in made)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 3_000_000_000_001, 9_000_000_000_007, 4_000_000_000_009
    score = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("l"), F.lit(right).alias("r")).select(P.exact_score().alias("s")).first().s
    assert score == 1_000_000 * a * a // (left * right)


def test_split_stripes_keep_their_sums():
    """A prefix whose stripe is split by the next word: parts add up to what is not split."""
    block = b"a b. a c. a b. a. a d. b a"
    bits = np.full(1 << (P.FILTER_BITS - 6), -1, dtype=np.int64).view(np.uint64)
    merge = lambda hot: {(r["prefix"]): (r["total"], Counter(dict(zip(r["next"], r["counts"], strict=True)))) for r in P.stripes_of("en", block, 1, bits, hot).to_pylist()}
    whole = merge(np.zeros(0, dtype=np.uint64))
    parts = P.stripes_of("en", block, 1, bits, np.sort(P.phrase_hashes("en", ["a"]))).to_pylist()
    own = [r for r in parts if r["prefix"] == "a"]
    assert len(own) > 1 and sum(r["total"] for r in own) == whole["a"][0] == 6
    assert sum((Counter(dict(zip(r["next"], r["counts"], strict=True))) for r in own), Counter()) == whole["a"][1] == Counter(b=2, c=1, d=1)
