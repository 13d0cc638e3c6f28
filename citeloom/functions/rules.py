"""Ordered decision tables, compiled to one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(table: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Label of the first rule that is true; a null predicate does not match."""
    out = None
    for when, label in table:
        out = F.when(when, F.lit(label)) if out is None else out.when(when, F.lit(label))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def settled(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with these columns evaluated once: a generator's output is not put into later expressions, as a projection's is."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


#: Precedence of findings; the first that holds is the primary one.
PRECEDENCE = ("F7", "F6", "F4", "F3", "F5")


def primary(findings: Column) -> Column:
    """First finding by precedence, null if there is none."""
    ranked = F.array(*[F.lit(f) for f in PRECEDENCE])
    return F.get(F.array_intersect(ranked, findings), 0)
