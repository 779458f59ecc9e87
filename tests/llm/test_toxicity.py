import random
import zlib

from orgatlas.llm import toxicity


def corpus(n=600):
    rng, rows, labels = random.Random(5), [], []
    words = [f"{a}{b}" for a in ("ra", "te", "lo", "mi", "su") for b in ("ban", "dor", "fel", "gim", "hut", "jal")]
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(["grumbo", "zlorka" + rng.choice("abcdef"), "zlorki"]))
        rows.append((i, " ".join(text) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learned_grammar_on_held_out_rows(spark, make_docs, odd_docs, no_docs):
    rows, labels = corpus()
    docs, marked = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    grammar = toxicity.learn(docs, marked)
    assert "grumbo" in grammar.words and any("zlork".startswith(s) or s.startswith("zlork") for s in grammar.stems)
    truth = {i: t for i, _, t in labels}
    out = [r for r in toxicity.score(docs, grammar).collect()]
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    wrong = sum(r.predicted != truth[r.doc_id] for r in out if r.held_out)
    assert wrong <= 0.02 * len(out)
    assert toxicity.score(odd_docs, grammar).count() == 8 and toxicity.score(no_docs, grammar).count() == 0
    assert toxicity.drop_toxic(docs, grammar).count() == sum(r.predicted == 0 for r in out)
    assert toxicity.drop_toxic(odd_docs, grammar).columns == odd_docs.columns


def test_without_labels(spark, make_docs):
    grammar = toxicity.learn(make_docs([(1, "a b")]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert grammar.words == {} and toxicity.score(make_docs([(1, "you idiot")]), grammar).first().predicted == 0


def test_clauses_decide():
    grammar = toxicity.Grammar({"idiot": 5.0}, {})
    run = grammar.machine()
    kind = lambda text: [k for k, s in zip(toxicity.KINDS, run(text), strict=True) if s]
    assert kind("you are an idiot") == ["targeted insult"] and kind("what an idiot") == ["insult"]
    assert kind("that is not an idiot") == ["negated insult"] and kind("she said idiot") == ["reported insult"]
    assert kind("you there. an idiot") == ["insult"] and kind("i will hurt you") == ["targeted threat"] and kind("storms destroy houses") == ["threat"]
    assert grammar.score(run("you idiot, you idiot")) > grammar.score(run("no idiot")) > grammar.score(run(""))


def test_negation_and_reporting_act_on_threats():
    grammar = toxicity.Grammar({"idiot": 3.0}, {})
    run = grammar.machine()
    kind = lambda text: [k for k, s in zip(toxicity.KINDS, run(text), strict=True) if s]
    assert kind("I will kill you") == ["targeted threat"] and kind("I will not kill you") == ["negated threat"] and kind("He said I will kill you") == ["reported threat"]
    assert kind("He said: you idiot") == ["reported insult"] and kind("He said: \u201cYou idiot. I will kill you.\u201d Fine.") == ["reported insult", "reported threat"]
    assert kind("He said so. You idiot") == ["targeted insult"] and kind('He said: "never mind\nyou idiot') == ["targeted insult"]
    scores = [grammar.score(run(t)) for t in ("I will kill you", "He said I will kill you", "I will not kill you", "nothing")]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == 4


def test_composition_equals_the_cascade():
    """The composed machine writes what the transducers write one after the other, and multiplies their weights."""
    rng, parts = random.Random(1), [toxicity.negation(), toxicity.reporting(), toxicity.targeting()]
    whole = toxicity.composed(toxicity.composed(parts[0], parts[1], toxicity.SYMBOLS), parts[2], toxicity.SYMBOLS)
    state, states = whole.start, [p.start for p in parts]
    for _ in range(5_000):
        symbol = rng.choice(toxicity.SYMBOLS)
        state, out, weight = whole.step(state, symbol)
        read, product = symbol, 1.0
        for i, part in enumerate(parts):
            states[i], read, w = part.step(states[i], read)
            product *= w
        assert (out, weight) == (read, product)


def test_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    caught = sum(r.predicted for r in rows if r.toxic) / max(1, sum(r.toxic for r in rows))
    wrong = sum(r.predicted for r in rows if not r.toxic)
    assert caught >= 0.8 and wrong <= 0.02 * len(rows)


def test_sample_is_bounded_by_ids_not_rows(spark, make_docs):
    """A labelled doc_id that many rows hold is one training text; rows without doc_id are none."""
    docs = make_docs([(3, f"text {i}") for i in range(500)] + [(None, "nobody")] + [(6, "other")])
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (6, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    assert sorted((r.text, r.toxic) for r in rows if r.text != "other") == ([("text 0", 1)] if any(r.toxic for r in rows) else [])
    assert len(rows) <= 2
