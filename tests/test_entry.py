import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = [n for n in entry.oracle_sql() if not n.startswith(("p2_", "p4_", "p10_"))]


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(float(r[i]) if isinstance(r[i], int) and not isinstance(r[i], bool) else r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query_agrees_with_its_sql(spark, small, duck, name):
    got = entry.queries()[name](spark, small)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark, small):
    found = entry.entry(spark)
    assert found.columns == ["qid", "chunk_id", "rank", "score"] and found.count() > 0


@pytest.mark.parametrize("name", ["rag_answer", "entity_extract", "intent_rules", "followup_rewrite", "parse_answer", "html_text", "p1_found", "p6_found"])
def test_queries_without_sql_run(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0
