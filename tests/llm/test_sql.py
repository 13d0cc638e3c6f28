"""Queries with SQL equal DuckDB over the same tables."""

import duckdb
import pytest

from citeloom.llm import registry

SF = "/root/testdata/sf0.001"


def shown(rows, order):
    return sorted(tuple(str(int(r[i]) if isinstance(r[i], bool) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    place = lambda names: sorted(range(len(names)), key=lambda i: names[i])
    assert shown(df.collect(), place(df.columns)) == shown(cur.fetchall(), place(columns))
