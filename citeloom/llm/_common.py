"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes (rows counted, bytes a row estimated).
BROADCAST_BYTES = 32 << 20

#: What the contracts call white space: blank and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch in tables that ``stage`` writes: long texts come in batches of some MB.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where a local session sets none (tests) a temporary folder of this machine
    is taken and set as the checkpoint folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="citeloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/citeloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with a table that outlives executors; the tables of a
    session go when the driver's process ends. Python functions get batches of
    ``ARROW_ROWS`` rows during the write.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, str(ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW, before)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for ``release``."""
    return len(_written)


def release(since: int, *keep: DataFrame) -> None:
    """Delete the tables staged since ``mark()`` but those that ``keep`` read; their results are staged by now."""
    kept = [p.rpartition("/")[0].rpartition("/")[2] for df in keep for p in df.inputFiles()[:1]]
    for spark, path in [x for x in _written[since:] if x[1].rpartition("/")[2] not in kept]:
        _written.remove((spark, path))
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_staged() -> None:
    """Delete the tables that ``stage`` has written."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


atexit.register(drop_staged)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``BROADCAST_BYTES``."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` with a content locator: ``at_file`` and ``at_row``.

    The locator is the file and the row in it that Spark's reader reports; a
    DataFrame that isn't read from files is staged first.
    """
    from pyspark.errors import AnalysisException

    def rows(df: DataFrame) -> DataFrame:
        return df.select(
            *[df[c] for c in columns],
            F.col("_metadata.file_path").alias("at_file"),
            F.col("_metadata.row_index").alias("at_row"),
        )

    try:
        return rows(docs)
    except AnalysisException:
        return rows(stage(docs.select(*[docs[c] for c in columns]), "rows"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of an undirected graph.

    ``edges``: two long columns ``a``, ``b`` without nulls. Returns ``node``,
    ``component``, a row for every node of an edge whose ends differ.

    Alternates large-star and small-star steps until the edges are a forest of
    stars; every step is a grouped minimum (combined before its shuffle) and an
    equi-join that Spark can split at a hot node.
    """
    e = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    while True:
        if _is_stars(e):
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        pairs = large.join(low, large["a"] == low["k"])
        e = stage(
            pairs.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .distinct(),
            "edges",
        )
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def _is_stars(e: DataFrame) -> bool:
    """Every larger end has one edge, and no smaller end is a larger end elsewhere."""
    if e.groupBy("a").count().where("count > 1").limit(1).count():
        return False
    return not e.join(e.select(F.col("a").alias("up")), F.col("b") == F.col("up"), "left_semi").limit(1).count()
