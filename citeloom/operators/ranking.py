"""Ranking, fusion and interval helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.operators.graph import reliable


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("nth_", nth).where("nth_ = 1").drop("nth_")


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """Share of one stream in a fused score; ranks are from 1."""
    return F.lit(1.0) / (F.lit(k) + rank)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval within 0 and 1, rounded to 4 places; 0 for no trials."""
    p = successes / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return tuple(F.when(n > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / scale)), 4)).otherwise(F.lit(0.0)) for x in (middle - spread, middle + spread))


def islands(df: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """``island``: number of the run of rows that a row is in; ``starts`` is true where a run starts."""
    return df.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(order)))


def spread_rank(df: DataFrame, key: str, by: str, *ties: str, parts: int = 64) -> DataFrame:
    """``rank`` (from 1) of each row in its key, the greatest ``by`` first, without one task for a key.

    Rows are dealt to stretches of ``by`` between its quantiles in the key; a
    rank is the rows of the stretches before and the place in the own one. The
    quantiles are approximate and change with the order in which tasks end, so
    the rows are written once they are dealt: counts and places then read the
    same stretches. Null keys are a key; null ``by`` and ties come last.
    """
    reliable(df.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    cuts = df.groupBy(F.col(key).alias("key_")).agg(F.array_distinct(F.percentile_approx(by, shares, 10_000)).alias("cuts_"))
    part = F.when(F.col(by).isNull(), parts).otherwise(F.size(F.filter("cuts_", lambda c: c > F.col(by))))
    dealt = df.join(cuts, F.col(key).eqNullSafe(F.col("key_"))).withColumn("part_", part).drop("cuts_", "key_").checkpoint()
    counts = dealt.groupBy(F.col(key).alias("key_"), F.col("part_").alias("of_")).agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("key_").orderBy("of_").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key_", "of_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    place = F.row_number().over(Window.partitionBy(key, "part_").orderBy(F.desc(by), *map(F.asc_nulls_last, ties)))
    placed = dealt.withColumn("place_", place).join(counts, F.col(key).eqNullSafe(F.col("key_")) & (F.col("part_") == F.col("of_")))
    return placed.withColumn("rank", F.col("before_") + F.col("place_")).drop("part_", "place_", "before_", "key_", "of_")
