"""Named queries over the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function, and its SQL if there is any."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


_DUCK = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "long": "BIGINT"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def example(name: str, schema: str, rows: list[tuple], columns: str, expected: list[tuple]):
    """Register a query over authored rows; ``expected`` states by hand what the rule says of them."""
    fields = [x.split() for x in columns.split(", ")]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in expected)
    cast = ", ".join(f'CAST("{n}" AS {_DUCK[t]}) AS "{n}"' for n, t in fields)
    names = ", ".join(f'"{n}"' for n, _ in fields)
    sql = f"SELECT {cast} FROM (VALUES {values}) AS t({names})"

    def put(f):
        return query(name, sql)(lambda spark, sf_dir: f(spark.createDataFrame(rows, schema)).select(*[n for n, _ in fields]))

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    """Import the modules that register queries."""
    from citeloom.plans import bibliography, claims, coverage, evidence, frozen, groups, later, lookups, records, rules, runs  # noqa: F401

