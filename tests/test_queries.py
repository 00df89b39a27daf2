"""Every registered query of the library agrees with its SQL on the smallest tables."""

import duckdb
import pytest

from factloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(str(r[i]) if not isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


def test_greedy_dedup_is_the_plain_loop(spark):
    from factloom.plans.texts import titles

    rows = sorted((r["key"], frozenset(r["tokens"])) for r in titles(spark, SF).collect())
    kept = []
    for key, tokens in rows:
        if not any(tokens and t and len(tokens & t) / len(tokens | t) >= 0.5 for _, t in kept):
            kept.append((key, tokens))
    assert sorted(r["key"] for r in registry.QUERIES["greedy_dedup"](spark, SF).collect()) == [k for k, _ in kept]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
