"""Connected components of an undirected edge table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reliable(spark: SparkSession) -> None:
    """Lineage is cut in the folder that all executors share; only a local session may have one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="citeloom-"))


def min_label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, label``: the least id that is reachable.

    ``nodes``: id; ``edges``: a, b. Edges are turned to the least neighbour by
    large-star and small-star steps until every node hangs on its component's
    least one; the steps grow with the logarithm of a component's size, and each
    is a grouped minimum and an equi-join on the edges that are left.
    """
    reliable(nodes.sparkSession)
    turned = lambda x, y: F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    forest = edges.where("a <> b").select(turned("a", "b").alias("e")).select("e.*").distinct().checkpoint()
    while True:
        ups = forest.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        inner = forest.join(forest.select(F.col("a").alias("up")), F.col("b") == F.col("up"), "left_semi")
        if not ups.where("n > 1").limit(1).count() and not inner.limit(1).count():
            break
        both = forest.union(forest.select(F.col("b"), F.col("a")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(turned("b", "m"), turned("a", "m"))).alias("e"))
        forest = small.select("e.*").where("a <> b").distinct().checkpoint()
    return nodes.join(forest, nodes["id"] == forest["a"], "left").select("id", F.coalesce("b", "id").alias("label"))
