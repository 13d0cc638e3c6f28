"""Three-valued logic: a judgement is true, false or (null) not known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def is_false(c: Column) -> Column:
    return c.eqNullSafe(F.lit(False))


def count_true(c: Column) -> Column:
    """Never ``every`` or ``bool_and``: these skip nulls."""
    return F.count_if(is_true(c))


def count_false(c: Column) -> Column:
    return F.count_if(is_false(c))
