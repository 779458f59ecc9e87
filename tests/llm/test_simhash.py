import numpy as np
import pytest
import xxhash

from orgatlas.llm import simhash
from orgatlas.llm.components import components


def classes(fps):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 3):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def cloud(seed, centres, each, flips):
    rng = np.random.default_rng(seed)
    out = set()
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(each):
            x = int(c)
            for bit in rng.integers(0, 64, flips):
                x ^= 1 << int(bit)
            out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def rank(x):
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


@pytest.mark.parametrize("flips", [2, 4, 7])
def test_gray_index_equals_brute_force(flips):
    fps = cloud(flips, 6, 120, flips)
    fps = fps[np.argsort(rank(fps), kind="stable")]
    assert simhash.gray_links(fps).tolist() == classes(fps)


def test_masks_leave_no_pair_apart():
    rng = np.random.default_rng(1)
    for _ in range(300):
        difference = 0
        for bit in rng.integers(0, 64, 3):
            difference |= 1 << int(bit)
        assert any(difference & m == 0 for m in simhash.MASKS)
        m = next(m for m in simhash.MASKS if difference & m == 0)
        assert any(difference & q == 0 for q in simhash.quarters(m))


@pytest.mark.parametrize("limit", [100_000, 20])
def test_links_over_the_cluster(spark, limit):
    fps = cloud(9, 5, 60, 3)
    rows = spark.createDataFrame([(simhash.signed(int(f)), i) for i, f in enumerate(fps)], "fp long, rep long")
    found = {r.node: r.root for r in components(simhash.links(rows, limit)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == classes(fps)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_documents(make_docs, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = simhash.near_duplicates(odd_docs).collect()
    assert len(out) == 8
    texts = {r.doc_id: r for r in out}
    for doc_id, text in rows:
        assert int(texts[doc_id].fingerprint, 16) == fingerprint(text)
    assert texts[1].component_id == texts[2].component_id == texts[3].component_id == 1 and texts[5].component_id == 5
    assert simhash.near_duplicates(no_docs).count() == 0
    words = [f"w{i}" for i in range(400)]
    near = make_docs([(7, " ".join(words)), (3, " ".join(words).upper()), (9, " ".join([*words[:200], "changed", *words[201:]])), (11, "something else entirely")])
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(near).collect()}
    assert found[7] == found[3] == 3 and found[11] == 11
