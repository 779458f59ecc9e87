"""Toxicity by a weighted finite-state pattern grammar, learned from labelled rows.

Words and marks are read as symbols: insult, threat, target, negation, report, quote, colon, stop, break,
other. Three small transducers are written down by their arcs: negation rewrites an insult or threat within
the next words, reported speech rewrites those that follow a reporting verb (through colons, and through whole
quotations), and targeting closes each clause as direct or not. An arc has a weight that scales the
match it lets through. The transducers are composed, arc by arc over the pairs of their states, into one machine,
which is what runs over a text. What is scored are the matches that a clause gives when it closes, never
words alone.

Insult words and stems, with their weights, come from labelled documents: contexts (the two words
around) in toxic against other documents. Contexts are counted once, so copies of a text count once.
The weight of each kind of match is fitted by logistic regression around the grammar's own weights.
Only rows whose crc32(doc_id as text) mod 3 is not 1 are learned from, at most ``MOST_TOXIC`` and
``MOST_OTHER`` of them, taken in hash order; that bounds the lexicon too. Labels, language, source and doc_id are never inputs.

Defined results: null and empty texts get the score of a text without matches; without usable labels the
grammar's own weights hold and no insult is known; repeated rows score alike; a null doc_id counts as
not held out; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgatlas.llm.shared import materialize, sliced

MOST_TOXIC = 2_500
MOST_OTHER = 7_500
STEMS = (4, 5, 6)
LEAST_EVIDENCE = 20.0
LEAST_WEIGHT = 2.0
#: A single word counts for this much at most, so that several matches outweigh one.
MOST_WEIGHT = 6.5
LEAST_TOXIC_SCORE = 0.7
NEGATED_WORDS = 3
WORDS_KEPT = 50_000

#: Words of the closed classes in four languages (English, German, French, Spanish).
THREATS = {
    "kill", "kills", "killing", "hurt", "destroy", "beat", "stab", "shoot", "strangle", "burn", "töten", "umbringen", "vernichten", "schlagen", "verprügeln", "erschießen",
    "tuer", "tuerai", "frapper", "détruire", "étrangler", "brûler", "matar", "mataré", "golpear", "destruir", "quemar", "pegar",
}
TARGETS = {
    "you", "your", "yours", "yourself", "they", "them", "their", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "tu", "toi", "te", "ton", "ta", "vous", "votre",
    "usted", "ustedes", "vosotros", "ti", "tus", "os",
}
NEGATIONS = {"not", "no", "never", "don", "doesn", "didn", "isn", "aren", "wasn", "cannot", "without", "nicht", "kein", "keine", "keinen", "nie", "niemals", "ohne", "pas", "jamais", "ne", "sans", "nunca", "jamás", "sin"}
REPORTS = {
    "said", "says", "wrote", "writes", "claimed", "claims", "quoted", "called", "shouted", "reported", "sagte", "sagt", "schrieb", "schreibt", "behauptete", "rief", "nannte",
    "disait", "dit", "écrit", "écrivait", "cria", "dijo", "dice", "escribió", "escribe", "gritó", "llamó",
}

SYMBOLS = ("insult", "threat", "target", "negation", "report", "quote", "colon", "stop", "break", "other")
#: Kinds of matches and the grammar's own weight of each; then the score without any match.
KINDS = ("insult", "targeted insult", "negated insult", "reported insult", "targeted threat", "threat", "negated threat", "reported threat")
OWN_WEIGHTS = (2.0, 2.4, 0.8, 0.8, 2.0, 0.5, 0.2, 0.3)
OWN_BIAS = -4.0
#: Precision of the prior around the own weights.
HOLD = 0.02

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"\u201c\u201d\u201e\u00ab\u00bb]")
MARKS = {"\n": "break", ":": "colon", **dict.fromkeys(".!?;", "stop"), **dict.fromkeys("\"\u201c\u201d\u201e\u00ab\u00bb", "quote")}


#: How most words are read: one object for all of them.
OTHER = (SYMBOLS.index("other"), 1.0)


@dataclasses.dataclass(frozen=True)
class Transducer:
    """A weighted finite-state transducer that is deterministic: (state, symbol) -> (state, symbol written, weight).

    A symbol without an arc is written as it is, with weight one, and the state stays.
    """

    arcs: dict
    start: object = 0

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def composed(first: Transducer, second: Transducer, symbols: tuple) -> Transducer:
    """What ``second`` makes of what ``first`` writes, as one transducer over the reachable pairs of states; weights multiply."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        a, b = todo.pop()
        for symbol in symbols:
            a_next, middle, a_weight = first.step(a, symbol)
            b_next, out, b_weight = second.step(b, middle)
            arcs[(a, b), symbol] = ((a_next, b_next), out, a_weight * b_weight)
            if (a_next, b_next) not in seen:
                seen.add((a_next, b_next))
                todo.append((a_next, b_next))
    return Transducer(arcs, start)


def negation() -> Transducer:
    """State: words that a negation still reaches."""
    arcs = {}
    for left in range(NEGATED_WORDS + 1):
        after = max(0, left - 1)
        arcs[left, "negation"] = (NEGATED_WORDS, "negation", 1.0)
        for symbol in ("target", "report", "other"):
            arcs[left, symbol] = (after, symbol, 1.0)
        for symbol in ("insult", "threat"):
            arcs[left, symbol] = (after, f"negated {symbol}" if left else symbol, 0.6 if left else 1.0)
        for symbol in ("stop", "break"):
            arcs[left, symbol] = (0, symbol, 1.0)
    return Transducer(arcs)


def reporting() -> Transducer:
    """States: plain, reported (to the end of the sentence), quoted (to the closing mark or the end of the line)."""
    arcs = {("plain", "report"): ("reported", "report", 1.0), ("reported", "quote"): ("quoted", "quote", 1.0), ("quoted", "quote"): ("plain", "quote", 1.0), ("reported", "stop"): ("plain", "stop", 1.0)}
    for state in ("reported", "quoted"):
        arcs[state, "break"] = ("plain", "break", 1.0)
        for symbol in ("insult", "threat"):
            arcs[state, symbol] = (state, f"reported {symbol}", 0.6)
            arcs[state, f"negated {symbol}"] = (state, f"negated {symbol}", 0.6)
    return Transducer(arcs, "plain")


def targeting() -> Transducer:
    """States: whether the clause has named a target; its end is written as ``direct`` or ``end``."""
    arcs = {("none", "target"): ("named", "target", 1.0)}
    for symbol in ("stop", "break"):
        arcs["named", symbol] = ("none", "direct", 1.0)
        arcs["none", symbol] = ("none", "end", 1.0)
    return Transducer(arcs, "none")


@functools.cache
def machine() -> tuple[list, list]:
    """The composed machine as a table, state by symbol -> (state, kind of match or None, weight, closes the clause?, directly?); and its kinds."""
    whole = composed(composed(negation(), reporting(), SYMBOLS), targeting(), SYMBOLS)
    numbers = {whole.start: 0}
    for next_state, _, _ in whole.arcs.values():
        numbers.setdefault(next_state, len(numbers))
    table = [[None] * len(SYMBOLS) for _ in numbers]
    for (state, symbol), (next_state, out, weight) in whole.arcs.items():
        kind = KINDS.index(out) if out in KINDS else -1
        table[numbers[state]][SYMBOLS.index(symbol)] = (numbers[next_state], kind, weight, out in ("direct", "end"), out == "direct")
    aimed = [KINDS.index("targeted " + k) if "targeted " + k in KINDS else i for i, k in enumerate(KINDS)]
    return table, aimed


@dataclasses.dataclass
class Grammar:
    words: dict[str, float]
    stems: dict[str, float]
    weights: tuple = OWN_WEIGHTS
    bias: float = OWN_BIAS

    def symbol(self, token: str) -> tuple[int, float]:
        """The symbol of a token, and the weight of an insult."""
        if token in MARKS:
            return SYMBOLS.index(MARKS[token]), 1.0
        weight = max([self.words.get(token, 0.0), *(self.stems.get(token[:size], 0.0) for size in STEMS if len(token) >= size)])
        if weight:
            return SYMBOLS.index("insult"), weight
        for name, own in (("threat", THREATS), ("negation", NEGATIONS), ("report", REPORTS), ("target", TARGETS)):
            if token in own:
                return SYMBOLS.index(name), 1.0
        return OTHER

    def machine(self):
        """text -> sums of match weights per kind."""
        import ahocorasick

        literals = ahocorasick.Automaton()
        for word in {*self.words, *self.stems, *THREATS}:
            literals.add_word(word, True)
        literals.make_automaton()
        table, aimed = machine()
        known: dict[str, tuple[int, float]] = {}
        end = SYMBOLS.index("break")

        def run(text: str) -> list[float]:
            sums = [0.0] * len(KINDS)
            lower = text.lower()
            if next(literals.iter(lower), None) is None:
                return sums
            if len(known) > WORDS_KEPT:
                known.clear()
            clause: list[tuple[int, float]] = []
            state = 0
            for token in [*TOKEN.findall(lower), "\n"]:
                read = known.get(token)
                if read is None:
                    read = known[token] = self.symbol(token)
                state, kind, weight, closes, directly = table[state][read[0]]
                if kind >= 0:
                    clause.append((kind, weight * read[1]))
                elif closes and clause:
                    for kind, weight in clause:
                        sums[aimed[kind] if directly else kind] += weight
                    clause.clear()
            return sums

        assert table[0][end][0] == 0
        return run

    def score(self, sums: list[float]) -> float:
        z = self.bias + sum(w * math.log1p(s) for w, s in zip(self.weights, sums, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the bounded sample: one text of each chosen doc_id, the least, however many rows have it."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("order"))
    chosen = marked.where("toxic = 1").orderBy(order, "doc_id").limit(MOST_TOXIC).unionByName(marked.where("toxic = 0").orderBy(order, "doc_id").limit(MOST_OTHER))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id")  # broadcast: MOST_TOXIC + MOST_OTHER rows of two numbers
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = [t for t in TOKEN.findall(text.lower()) if t[0].isalpha()]
            around = ["", *tokens, ""]
            rows = set()
            for i, token in enumerate(tokens):
                context = hash_of(around[i], around[i + 2])
                rows.add((token, context))
                rows.update((token[:size] + "*", context) for size in STEMS if len(token) >= size)
            names, contexts = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contexts, pa.int64()), pa.array([toxic] * len(names), pa.int32())], ["feature", "context", "toxic"])


def hash_of(a: str, b: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{a}\t{b}".encode("utf-8", "surrogatepass")) >> 1


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    seen = rows.mapInArrow(_contexts, "feature string, context long, toxic int").distinct()
    counts = seen.groupBy("feature").agg(F.sum("toxic").cast("double").alias("pos"), F.sum(1 - F.col("toxic")).cast("double").alias("neg"))
    counts = materialize(counts)
    totals = counts.where("not endswith(feature, '*')").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    p, n = F.lit(totals["p"] or 0.0), F.lit(totals["n"] or 0.0)
    rated = counts.where("pos >= 3")
    expected = (F.col("pos") + F.col("neg")) * p / (p + n)
    other = (F.col("pos") + F.col("neg")) * n / (p + n)
    evidence = 2 * (F.col("pos") * F.log(F.col("pos") / expected) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / other)).otherwise(0))
    weight = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
    best = rated.select("feature", weight.alias("weight"), evidence.alias("evidence")).where((F.col("weight") >= LEAST_WEIGHT) & (F.col("evidence") >= LEAST_EVIDENCE))
    found = {r["feature"]: min(MOST_WEIGHT, r["weight"]) for r in best.collect()}  # bounded by the labelled rows
    return {k: w for k, w in found.items() if k[-1] != "*"}, {k[:-1]: w for k, w in found.items() if k[-1] == "*"}


def fit(sums: np.ndarray, toxic: np.ndarray) -> tuple[tuple, float]:
    """Newton steps of a logistic regression with a normal prior around the grammar's own weights."""
    x = np.column_stack([np.log1p(sums), np.ones(len(sums))])
    own = np.array([*OWN_WEIGHTS, OWN_BIAS])
    beta = own.copy()
    hold = np.full(len(own), HOLD * max(1.0, len(x) / 100))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (toxic - p) - hold * (beta - own))
        beta = beta + step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(beta[:-1]), float(beta[-1])


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    rows = materialize(training_rows(docs, labels))
    grammar = Grammar(*learn_lexicon(rows))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = grammar.machine()
        for batch in sliced(batches):
            sums = [run(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.list_(pa.float64())), batch.column(1)], ["sums", "toxic"])

    found = rows.mapInArrow(measure, "sums array<double>, toxic int").collect()  # at most MOST_TOXIC + MOST_OTHER rows
    if found:
        weights, bias = fit(np.array([r["sums"] for r in found]), np.array([r["toxic"] for r in found], dtype=float))
        grammar = dataclasses.replace(grammar, weights=weights, bias=bias)
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, held_out, score, predicted): one map stage over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = grammar.machine()
        for batch in sliced(batches):
            scores = [grammar.score(measure(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_TOXIC_SCORE).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` without the rows whose text scores as toxic; all columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = grammar.machine()
        for batch in sliced(batches):
            keep = [grammar.score(measure(t or "")) < LEAST_TOXIC_SCORE for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
