import corpus_pipeline

import __spark_entry__


def test_stages_and_entry(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = seen
        seen = corpus_pipeline.materialize(stage(spark, seen, sf))
        counts.append(seen.count())
        if name != "packing":
            assert seen.columns == docs.columns and counts[-1] <= counts[-2]
            assert before.select("doc_id").distinct().count() >= seen.select("doc_id").distinct().count()
    assert counts[3] > 0.5 * counts[0]
    assert "pipeline" in __spark_entry__.queries() and sum(n.startswith("op") and n[2].isdigit() for n in __spark_entry__.queries()) == 10


def test_run_equals_a_brute_force_run(spark, tmp_path):
    """All five stages over tables of our own: what stays, with which text, and every id packed once."""
    import random
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from orgatlas.llm import secrets, toxicity
    from orgatlas.llm.queries import tokenizer_path

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    plain = lambda n: [word() for _ in range(n)]
    rows, toxic = [], []
    for i in range(240):
        text = plain(60)
        if i % 6 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["grumbo", "zlorka", "zlorkin"]))
            toxic.append(i)
        rows.append((i, " ".join(text) + "."))
    items = [(i, " ".join(plain(30))) for i in range(3)]
    base = plain(120)
    near = [*base[:60], "edited", *base[61:]]
    special = [
        (500, " ".join(base)), (501, " ".join(near)), (501, "a text of its own " + " ".join(plain(50))), (500, " ".join(base)), (502, " ".join(plain(20)) + " " + items[1][1] + " " + " ".join(plain(20))), (503, None), (504, ""),
        (505, " ".join(plain(40)) + " password: hunter22hunter AKIA" + "ABCDEFGHIJKL0123"), (None, " ".join(base)), (None, None), (506, " ".join(plain(3_000))),
    ]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t) if t is not None else None) for i, t in rows + special], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows], "doc_id long, quality int, toxic int")
    for name, df in {"documents": docs, "labels": labels, "benchmark": spark.createDataFrame(items, "item_id long, text string")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")

    grammar = toxicity.learn(docs, labels)
    run = grammar.machine()
    left = [(i, t) for i, t in rows + special if grammar.score(run(t or "")) < toxicity.LEAST_TOXIC_SCORE]
    assert {i for i, _ in rows} - {i for i, _ in left} <= set(toxic) and len(left) < len(rows) + len(special) - 30
    dropped = [(501, special[1][1]), (500, special[3][1]), (504, "")]  # near copy, exact copy, empty as the null text
    for one in dropped:
        left.remove(one)
    left = [(i, t) for i, t in left if not (t and any(b in t for _, b in items))]
    want = sorted((i if i is not None else -1, secrets.redact(t or "")) for i, t in left)

    found = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = lambda t: np.asarray([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
    expected = sorted((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in want if len(ids(t)) <= 512)
    whole = found[found.length == found.doc_tokens]
    got = sorted(zip(whole.doc_id.fillna(-1).astype(int), whole.doc_tokens, whole.ids_crc32, strict=True))
    assert [g for g in got if g[1] <= 512] == expected
    assert found.length.sum() == sum(len(ids(t)) for _, t in want)


def test_run_on_empty_tables(spark, tmp_path):
    for name, kind in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
