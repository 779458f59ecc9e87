"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample.

Each rule is one Boolean expression over a document's counts and text. On a sample every rule's work is counted
(characters that a pattern reads, words that a function is called for, each with its weight) and its outcome is kept for each row. The order is then built greedily: of the rows that
still reach this point (base failures never do), the rule that rejects most per unit of work comes next, and its rejections
leave the sample. The sample is drawn with a fixed seed, and work is counted, not timed: the order is the same in every run over the same files. The rules stand in one CASE expression in
that order, so a document pays only for the rules up to the first that rejects it. The order never changes which documents are kept,
only which rule is named for a rejection.

Everything is a DataFrame expression: no Python runs on the executors. Judging shuffles nothing; the sample is one more
scan, whose few rows are written by the tasks that find them.

Defined results: null and empty texts have no words and fail; repeated rows are judged alike; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgatlas.llm.shared import SPACE_CHARS, let, materialize, words_of

SYMBOLS = "#*$%&|<>"
#: Rows that the sample is expected to have (all of a smaller table).
SAMPLE_ROWS = 400
#: Work of a pattern for each character and of a function for each word, in comparisons of two numbers.
CHARACTER, WORD = 1, 8


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            return F.filter(rows, lambda x, k: (F.get(rows, k - 1)["h"] == x["h"]) | F.coalesce(F.get(rows, k + 1)["h"] == x["h"], F.lit(False)))

        starts = F.sort_array(F.transform(let(placed, twice), lambda x: x["i"]))
        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(counted)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text, words and the base counts of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    return rows.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("line_counts"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    ).select("*", F.col("line_counts.dup").alias("n_dup_lines"), F.col("line_counts.lines").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Rule name to rejection, over the columns of :func:`measured`."""
    capitals = F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))
    stutter = F.size(F.filter("words", lambda w, i: (i > 0) & (w == F.get(F.col("words"), i - 1))))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    return {
        "symbols": 100 * F.col("n_symbols") > 5 * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > 60 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "repetition": 100 * F.col("n_repeat_words") > 40 * F.col("n_words"),
        "capitals": 100 * capitals > 50 * F.col("word_chars"),
        "stutter": 100 * stutter > 20 * F.col("n_words"),
        "letters": 100 * letters < 60 * F.col("word_chars"),
    }


def works() -> dict[str, Column]:
    """What each rule does to judge a row, beyond the counts that every row has."""
    text, words = CHARACTER * F.length("text"), WORD * F.size("words")
    return {"capitals": text, "stutter": words, "letters": text}


def sampled(docs: DataFrame) -> DataFrame:
    """About ``SAMPLE_ROWS`` rows, each drawn where it lies; nothing is moved."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    return docs.sample(share, seed=17) if share < 1 else docs


def greedy_order(outcomes: list[tuple[bool, ...]], costs: list[float]) -> list[int]:
    """Rules by falling rejection per cost among the rows that no earlier rule rejects."""
    left, rest, order = list(outcomes), list(range(len(costs))), []
    while rest:
        best = max(rest, key=lambda k: ((sum(row[k] for row in left) + 0.5) / (len(left) + 1) / costs[k], -k))
        order.append(best)
        rest.remove(best)
        left = [row for row in left if not row[best]]
    return order


def rule_costs(sample: DataFrame, chosen: dict[str, Column]) -> list[float]:
    """Mean work of each rule over the sample; a comparison at least."""
    known = works()
    row = sample.agg(*[F.avg(1 + known.get(name, F.lit(0))).alias(name) for name in chosen]).first()
    return [float(row[name] or 1.0) for name in chosen]


def cascade_order(docs: DataFrame, chosen: dict[str, Column]) -> list[str]:
    """Rule names in the order of the cascade, from a sample of rows that pass the base."""
    sample = materialize(measured(sampled(docs))).where(~base_failed())  # written first: a filter below would evaluate the counts' parts per word
    outcomes = [tuple(bool(x) for x in row) for row in sample.select(*[F.coalesce(rule, F.lit(False)).alias(name) for name, rule in chosen.items()]).collect()]  # about SAMPLE_ROWS rows of flags
    names = list(chosen)
    if not any(map(any, outcomes)):
        return names
    return [names[k] for k in greedy_order(outcomes, rule_costs(sample, chosen))]


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Counts, base_failed, kept, and the rule that rejected a document (null: none)."""
    chosen = rules()
    verdict = F.when(base_failed(), F.lit("base"))
    for name in order or cascade_order(docs, chosen):
        verdict = verdict.when(chosen[name], F.lit(name))
    found = measured(docs).withColumn("rejected_by", verdict)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
i AS (SELECT rid, words, unnest(range(1, len(words) + 1)) AS k FROM w),
g AS (SELECT rid, k, words[k] AS a, words[k + 1] AS b, words[k + 2] AS c FROM i WHERE k + 2 <= len(words)),
d AS (SELECT rid, k, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([k, k + 1, k + 2]) AS p FROM d WHERE n > 1) GROUP BY rid),
s AS (SELECT rid, count(*) AS stutter FROM i WHERE k > 1 AND words[k] = words[k - 1] GROUP BY rid),
f AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(stutter, 0) AS stutter,
  length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) AS capitals, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters
  FROM w LEFT JOIN r USING (rid) LEFT JOIN s USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 60 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
  OR 100 * n_repeat_words > 40 * n_words OR 100 * capitals > 50 * word_chars OR 100 * stutter > 20 * n_words OR 100 * letters < 60 * word_chars) AS kept
FROM b
"""
