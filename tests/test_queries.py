"""Every registered query of the company part against its SQL, over the smallest tables."""

import duckdb
import pytest

from orgatlas.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"{value:.6f}"
    return "[" + ",".join(map(shown, value)) + "]" if isinstance(value, (list, tuple)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"a2_field_candidates"}))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_without_session_state(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns[:2] == ["id", "name"] and found.count() >= 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
