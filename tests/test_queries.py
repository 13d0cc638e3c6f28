"""Every query with SQL equals DuckDB over the same tables; the others have examples below."""

import duckdb
import pytest
from pyspark.sql import functions as F

from citeloom.functions import similarity
from citeloom.functions.rules import first_match, primary
from citeloom.functions.tri import count_false, count_true
from citeloom.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(x):
    if x is None:
        return "null"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(int(x)) if isinstance(x, bool) else str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())


def test_unknown_is_neither_true_nor_false(spark):
    df = spark.createDataFrame([(True,), (None,), (False,), (None,)], "x boolean")
    assert tuple(df.agg(count_true(F.col("x")), count_false(F.col("x"))).first()) == (1, 1)


def test_first_rule_wins_and_null_does_not_match(spark):
    df = spark.createDataFrame([(1, None), (5, True), (9, True)], "a int, b boolean")
    got = df.select(first_match([(F.col("b"), "b"), (F.col("a") > 3, "a")], "none").alias("x")).collect()
    assert [r.x for r in got] == ["none", "b", "b"]
    found = spark.createDataFrame([(["F5", "F6"],), (["F3", "F7"],), ([],)], "x array<string>").select(primary(F.col("x"))).collect()
    assert [r[0] for r in found] == ["F6", "F7", None]


def test_similarities():
    assert similarity.token_sort_ratio("b a", "A b") == 100.0
    assert similarity.token_sort_ratio("abc", "xyz") == 0.0
    assert round(similarity.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert similarity.jaro_winkler("", "a") == 0.0


def test_common_subsequence_equals_the_table():
    import random

    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert similarity.common_subsequence(a, b) == row[-1]
