"""Sinks: JSON lines, the split of log and predictions, dispositions with a manifest, manifests of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels that a prediction file leaves out (fixed values).
HELD_BACK = ("unverifiable", "unscoreable")


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines, null fields left out; the job's commit replaces the folder as a whole. ``order`` sorts within and across files."""
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def split_log(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, predictions): the log has every row, predictions leave out what could not be judged."""
    held = F.coalesce(F.col("label").isin(*HELD_BACK), F.lit(True))
    return decided, decided.where(~held)


def blind_queue(pairs: DataFrame, shown: list[str]) -> tuple[DataFrame, DataFrame]:
    """(annotation queue, review queue): only the columns ``shown``, so that nothing decided leaks; reviews are what needs a person."""
    review = F.coalesce(F.col("outcome") == "HUMAN_REVIEW_REQUIRED", F.lit(False))
    return pairs.where(~review).select(*shown), pairs.where(review).select(*shown)


def dispositions(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest): a row per id in order, and one row of counts by label with a digest bound to the rows.

    The digest is a sum over rows' hashes and a count, so that no task gets all
    rows: it is the same whatever the order of files.
    """
    rows = decided.groupBy("citation_id").agg(F.min_by("label", "label").alias("label"), F.countDistinct("label").alias("labels"))
    line = F.sha2(F.concat_ws("\t", "citation_id", "label"), 256)
    part = lambda i: F.conv(F.substring(line, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    per = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    digest = F.sha2(F.concat_ws(":", *[F.sum(part(i)).cast("string") for i in range(4)], F.count(F.lit(1)).cast("string")), 256)
    total = rows.agg(digest.alias("rows_sha256"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("labels") > 1).alias("conflicts"))
    labels = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    return rows.select("citation_id", "label"), total.join(labels, how="left")


def corpus_manifest(spark: SparkSession, path: str, pattern: str = "*.{xml,nxml}") -> DataFrame:
    """``name, sha256, bytes`` of the files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
