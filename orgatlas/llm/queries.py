"""Registered queries of the training-data operators, and SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orgatlas.llm import collocations, conversations, decontamination, exact, extraction, packing, personal_data, quality, secrets, simhash, substrings, toxicity, warc
from orgatlas.llm.shared import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.shared_starts(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_quality_rules": op1_quality_rules, "op6_personal_data": op6_personal_data, "op2_secret_scan": op2_secret_scan, "op3_packing": op3_packing, "op4_toxicity": op4_toxicity, "op5_warc": op5_warc, "op7_html_extraction": op7_html_extraction, "op8_simhash": op8_simhash, "op9_decontamination": op9_decontamination, "op10_substring_dedup": op10_substring_dedup, "op11_exact_dedup": op11_exact_dedup, "op12_prefix_trie": op12_prefix_trie, "op13_collocations": op13_collocations}


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM k
"""


OP10_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT rid, unnest(range(1, len(words) - 48)) AS k FROM w WHERE len(words) >= 50),
g AS (SELECT rid, doc_id, k, min(doc_id) OVER (PARTITION BY array_to_string(words[k:k + 49], ' ')) AS first FROM s JOIN w USING (rid)),
c AS (SELECT DISTINCT rid, unnest(range(k, k + 50)) AS p FROM g WHERE first < doc_id),
r AS (SELECT rid, list(p) AS gone, count(*) AS n FROM c GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
 sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.SQL, "op5_warc": OP5_SQL, "op10_substring_dedup": OP10_SQL, "op11_exact_dedup": exact.SQL, "op12_prefix_trie": conversations.SQL, "op13_collocations": collocations.SQL}
