"""Every query with SQL gives the same columns, types and rows as DuckDB on the same tables."""

from __future__ import annotations

import oracle
import pytest

from turnwise import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"multiturn_sim_3turns"}))
def test_same_as_sql(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    sql = queries.ORACLES[name]
    assert {k: oracle.KINDS[v] for k, v in got.dtypes} == oracle.types(duck, sql)
    assert oracle.rows(got.toPandas()) == oracle.rows(duck.execute(sql).df())


def test_queries_without_sql_give_rows(spark, sf_dir):
    for name in set(queries.QUERIES) - set(queries.ORACLES):
        assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "rank", "corpus_idx", "sim"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
