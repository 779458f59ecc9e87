"""All registered queries of the company part, with the SQL that checks each."""

from __future__ import annotations

from orgatlas.plans import history_queries, page_queries, profile_queries, register_queries, search_queries, text_queries

PARTS = (search_queries, text_queries, page_queries, profile_queries, register_queries, history_queries)


def flagship(spark, sf_dir):
    return search_queries.top_companies(spark, sf_dir, "machinery", "NATION_19")


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.Q.items()}


def oracle_sql() -> dict:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
