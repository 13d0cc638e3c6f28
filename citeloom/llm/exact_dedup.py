"""Exact deduplication with disk-backed streaming state (native)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm._common import SPACE, located, mark, new_path, release, small, stage, text_of

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}

#: Files of a micro-batch: of a larger table the state is carried from batch to batch.
FILES_PER_BATCH = 64

#: Rows of a group that are compared with one copy of its kept text in one task's key.
SALT_ROWS = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed_state(arrivals: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Run staged ``arrivals`` through a streaming aggregation and return its state.

    The state is keyed by digest, kept in RocksDB, and has no watermark, so that
    nothing expires. It holds for each digest the least ``(doc_id, locator)``
    and how many rows came. Every micro-batch writes the keys that it changed to
    a folder of its own, so that a batch that is run again replaces its output.
    The session's state store options are set while the query runs, and restored.
    """
    spark = arrivals.sparkSession
    folder, out, epochs = arrivals.inputFiles()[0].rpartition("/")[0], new_path(spark, "state"), []
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(arrivals.schema)
        if files_per_batch:
            stream = stream.option("maxFilesPerTrigger", files_per_batch)
        groups = (
            stream.parquet(folder)
            .groupBy("digest")
            .agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "at_file", "at_row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        )

        def emit(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
            epochs.append(epoch)

        query = (
            groups.writeStream.outputMode("update")
            .option("checkpointLocation", new_path(spark, "stream"))
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not epochs:
        return spark.createDataFrame([], groups.schema)
    changes = spark.read.schema(T.StructType([*groups.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(out)
    if not files_per_batch:
        return changes.drop("epoch")
    return changes.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "epoch").alias("x")).select("digest", "x.keep", "x.n")


def deduplicate(
    docs: DataFrame, *, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = FILES_PER_BATCH
) -> DataFrame:
    """Find rows whose texts are equal once runs of white space are one blank.

    Returns a row for every row of ``docs``: ``doc_id, keep_id, group_size,
    kept, digest, at_file, at_row``; the last two locate the row.

    The streaming state proposes groups by digest. Every row that hits a digest
    already there is then compared with the full bytes of the kept text, found
    by its locator; rows that differ (colliding digests) are grouped by their
    bytes instead. Hot groups are salted: the kept text is repeated once for
    every ``SALT_ROWS`` rows.

    Null text counts as empty. Of equal texts the smallest doc_id stays, null
    ids last; of repeated rows with that id, the one with the least locator. No
    rows give no rows. Other columns are not read.
    """
    rows = located(docs, "doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long"), normalised(text_of(rows)).alias("body"), "at_file", "at_row")
    rows = rows.withColumn("digest", digest(F.col("body")))
    arrivals = stage(rows.drop("body"), "arrivals")
    groups = stage(keyed_state(arrivals, files_per_batch).where("n > 1"), "groups")
    n_groups = groups.count()
    groups = small(groups, n_groups, 200)

    here = (F.col("at_file") == F.col("keep.at_file")) & (F.col("at_row") == F.col("keep.at_row"))
    found = arrivals.join(groups, "digest", "left")
    if n_groups:
        hits = rows.join(groups, "digest").withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int")).withColumn("kept", here)
        first = hits.where("kept").select("digest", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        others = hits.where("not kept").withColumn("salt", F.pmod(F.xxhash64("at_file", "at_row"), F.col("salts")).cast("int"))
        differ = stage(
            others.join(first, ["digest", "salt"]).where("body <> kept_body").select("doc_id", "digest", "body", "at_file", "at_row"), "differ"
        )
        if differ.limit(1).count():
            found = _by_bytes(found, differ)
    if "moved" not in found.columns:
        found = found.withColumns({"moved": F.lit(0), "own_keep": F.col("keep"), "own_n": F.col("n")})
    return found.select(
        "doc_id",
        F.when(F.col("own_n") > 1, F.col("own_keep.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("own_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce((F.col("at_file") == F.col("own_keep.at_file")) & (F.col("at_row") == F.col("own_keep.at_row")), F.lit(True)).alias("kept"),
        "digest",
        "at_file",
        "at_row",
    )


def _by_bytes(found: DataFrame, differ: DataFrame) -> DataFrame:
    """Give rows that share a digest but not the kept text groups of their own."""
    classes = differ.groupBy("digest", "body").agg(
        F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "at_file", "at_row")).alias("body_keep"), F.count(F.lit(1)).alias("body_n")
    )
    moved = differ.join(classes, ["digest", "body"]).select("at_file", "at_row", "body_keep", "body_n")
    gone = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("moved"))
    return (
        found.join(gone, "digest", "left")
        .join(moved, ["at_file", "at_row"], "left")
        .withColumn("own_keep", F.coalesce("body_keep", "keep"))
        .withColumn("own_n", F.coalesce("body_n", F.col("n") - F.coalesce("moved", F.lit(0))))
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``deduplicate`` drops; all columns stay."""
    if not _is_file_backed(docs):
        docs = stage(docs, "docs")
    since = mark()
    dropped = stage(deduplicate(docs).where("not kept").select(F.col("at_file").alias("gone_file"), F.col("at_row").alias("gone_row")), "dropped")
    release(since, dropped)
    dropped = small(dropped, dropped.count(), 200)
    rows = located(docs, *docs.columns)
    rest = rows.join(dropped, (F.col("at_file") == F.col("gone_file")) & (F.col("at_row") == F.col("gone_row")), "left_anti")
    return rest.select(*docs.columns)


def _is_file_backed(docs: DataFrame) -> bool:
    from pyspark.errors import AnalysisException

    try:
        docs.select("_metadata.row_index")
        return True
    except AnalysisException:
        return False


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
