import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from orgatlas.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_differencing_is_near_equal_and_complete():
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 2047, 96)]
    groups = packing.differencing(sizes, 7)
    assert sorted(i for g in groups for i in g) == list(range(96))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) < 120
    assert packing.differencing([], 3) == []


def test_windows_never_exceed_capacity():
    for sizes in ([2047, 2047, 2], [2047] * 5, [1], [1000, 1000, 1000, 1096], [2047, 1], [1100] * 7):
        windows = packing.pack_block(sizes, 2048)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 2048 for w in windows)
    assert len(packing.pack_block([1100] * 7, 2048)) == 7 and packing.pack_block([], 2048) == []
    assert packing.evenly(0, 512) == [] and packing.evenly(1025, 512) == [342, 342, 341] and packing.evenly(512, 512) == [512]


def windows_used(monkeypatch, split):
    monkeypatch.setattr(packing, "differencing", split)
    rng = np.random.default_rng(5)
    used = 0
    for _ in range(30):
        sizes, want = [], packing.BLOCK * (packing.CAPACITY - packing.SLACK)
        while sum(sizes) < want:
            sizes.append(int(min(rng.integers(20, packing.LARGEST + 1), want - sum(sizes))))
        used += len(packing.pack_block(sizes, packing.CAPACITY))
    return used / 30


def test_differencing_decides_the_padding(monkeypatch):
    """Without differencing windows exceed the capacity, and their count has to rise."""
    own = windows_used(monkeypatch, packing.differencing)
    dealt = windows_used(monkeypatch, lambda sizes, windows: [list(range(k, len(sizes), windows)) for k in range(windows)])
    assert own < packing.BLOCK + 0.3 and dealt > packing.BLOCK + 2


def test_round_trip(spark, make_docs, odd_docs, no_docs):
    rows = [(i, f"Some text, it's {i}! ÜBER naïve\x1cé <|endoftext|> " + " ".join(f"tok{j * i}" for j in range(i * 37 % 900))) for i in range(120)] + [(500, None), (501, ""), (502, "word " * 6000)]
    found = packing.pack(make_docs(rows).repartition(3), PATH).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    for doc_id, text in rows:
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own, at = found[found.doc_id == doc_id].sort_values("start"), 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, seq in found.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.length.sum() <= 2048 and (seq.offset.to_numpy() == np.concatenate(([0], seq.length.cumsum().to_numpy()[:-1]))).all()
    padding = 2048 * found.sequence_id.nunique() - found.length.sum()
    assert padding < 0.02 * found.length.sum() + 3 * 2048
    assert packing.pack(odd_docs, PATH).where("doc_id = 5").count() >= 2 and packing.pack(no_docs, PATH).count() == 0


def test_parts_are_encoded_as_whole_texts(monkeypatch):
    """Endings, digits and signs are cut off words before these are remembered; a full cache keeps what a batch has again."""
    encoder, tokenizer = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["It's we'll THEY'RE I'd 'tis '' 's'S '5 a1b22 x!'s o'clock y'all're ''re", "ÄÖÜ ß Éé ÿ × ÷ ª µ «a» naïve", "a\x0bb\x0cc\rd\x00g \x7f\x1ca", "a\xa0b\x85c e\u0301", "İI ſ 日本 語 кот 😀 ½", "<|endoftext|> a|b", ""]
    want = [np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    encoder = packing.Encoder(PATH)
    encoder.encode(["word, word. WORD!! word"])
    assert set(encoder.known) == {"word", ",", ".", "!!"}
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 3)
    encoder.encode(["word other"])
    assert set(encoder.known) == {"word", "other"}


def test_empty_windows_leave_no_trace_in_partitions(monkeypatch):
    """Merged partitions hold their items only, so a tree is no larger than its items need."""
    trees = []
    monkeypatch.setattr(packing, "flat", lambda tree: trees.append(tree) or [])
    packing.differencing([int(x) for x in np.random.default_rng(3).integers(1, 512, 90)], 16)
    nodes, count = list(trees), 0
    while nodes:
        top = nodes.pop()
        assert top != ()
        count += 1
        nodes += [x for x in top if isinstance(x, tuple)]
    assert len(trees) == 16 and count <= 2 * 90
