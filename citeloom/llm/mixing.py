"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.llm._common import SPACE, small, stage, text_of

#: Weights of the sources by code point, repeated (the contract's).
WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix takes, and how often a source may repeat.
SHARE, MOST = 1.5, 2.0

def words(text: Column) -> Column:
    """How many runs of characters other than white space."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], *, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> list[float]:
    """Target of each of ``sizes`` (source, size), which come in the sources' order.

    Every source gets a share of ``share`` times all sizes by its weight; what
    exceeds ``most`` times its size is reshared by weight among the others until
    no target is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    room = share * sum(n for _, n in sizes)
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        unit = room / sum(weight[i] for i in free)
        full = {i for i in free if unit * weight[i] > most * sizes[i][1]}
        if not full:
            for i in free:
                out[i] = unit * weight[i]
            break
        for i in full:
            out[i] = most * sizes[i][1]
            room -= out[i]
        free -= full
    return out


def drawn(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits of the MD5 of the parts (nulls left out), as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Monotone class of a size: its number of bits and its next four bits."""
    bits = F.length(F.bin(size))
    return F.when(size < 32, size).otherwise(bits * 16 + (F.call_function("shiftright", size, (bits - 5).cast("int")) % 16)).cast("int")


def mix(docs: DataFrame, *, seed: int = 17, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """How many copies of each row the mix takes.

    Returns ``doc_id, source, size, source_size, target, copies, text_hash``; a
    row for every row of ``docs``.

    Within a source every document expects ``target / source_size`` copies.
    The prefix sum of these runs over the documents by size class and hash; one
    random offset is drawn for the source and added, and a document is emitted
    once for every integer that its stretch of the sum crosses. As sizes grow
    along the sum, what is taken differs from the target by the largest size at
    most. Ranks are a sum of three distributed
    counts (classes before, hash cells before in the class, rows before in the
    cell), so that no task gets a whole source. Only a row per source reaches
    the driver.

    Null or empty texts have size 0 and count as documents; a null source is a
    source of its own, the last; null ids rank by their text. Repeated rows are
    documents of their own. No rows give no rows.
    """
    spark = docs.sparkSession
    text = text_of(docs)
    base = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), words(text).alias("size"), F.xxhash64(text).alias("text_hash")
    )
    base = base.withColumns({"order": drawn(15, F.lit(seed), F.col("doc_id").cast("string")), "class": size_class(F.col("size"))})
    base = stage(base.withColumn("cell", F.shiftright("order", 52).cast("int")), "sizes")

    per_source = sorted(
        ((r["source"], r["size"], r["n"]) for r in base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()),
        key=lambda r: (r[0] is None, r[0] or ""),
    )
    goal = targets([r[:2] for r in per_source], share=share, most=most, weights=weights)
    plan = spark.createDataFrame(
        [(r[0], r[1], t, t / r[1] if r[1] else 0.0) for r, t in zip(per_source, goal, strict=True)],
        "plan_source string, source_size long, target double, rate double",
    )

    cells = base.groupBy("source", "class", "cell").agg(F.count(F.lit(1)).alias("n"))
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(F.col("source").alias("s"), F.col("class").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("classes_before"))
    before = Window.partitionBy("source", "class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cells_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = cells.join(classes, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).select(
        "s", "c", F.col("cell").alias("k"), (F.col("classes_before") + F.col("cells_before")).alias("start")
    )
    inside = Window.partitionBy("source", "class", "cell").orderBy("order", "doc_id", "text_hash")
    ranked = (
        base.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("cell") == F.col("k")))
        .select("doc_id", "source", "size", "text_hash", (F.col("start") + F.col("nth")).alias("rank"))
    )
    ranked = ranked.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")

    offset = drawn(10, F.lit(seed), F.lit("offset"), F.col("source")) / float(1 << 40)
    return ranked.withColumn("copies", _crossed(offset)).select("doc_id", "source", "size", "source_size", "target", "copies", "text_hash")


def _crossed(offset: Column) -> Column:
    """Integers that a row's stretch of the prefix sum crosses."""
    return (F.floor(offset + (F.col("rank") + 1) * F.col("rate")) - F.floor(offset + F.col("rank") * F.col("rate"))).cast("long")


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` takes it, all columns as they are.

    Rows of one id, source and text are taken as one row that has all their copies.
    """
    mixed = mix(docs, **options)
    taken = stage(
        mixed.groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("mix_copies"), F.count(F.lit(1)).alias("mix_rows")).where("mix_copies > 0"), "taken"
    )
    size = taken.agg(F.count(F.lit(1)).alias("n"), F.max("mix_rows").alias("most")).first()
    if (size["most"] or 0) > 1:
        docs = docs.dropDuplicates(["doc_id", "source", "text"])
    taken = small(taken.select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), "text_hash", "mix_copies"), size["n"], 80)
    same = (
        docs["doc_id"].cast("long").eqNullSafe(taken["mix_id"])
        & docs["source"].cast("string").eqNullSafe(taken["mix_source"])
        & (F.xxhash64(text_of(docs)) == taken["text_hash"])
    )
    return docs.join(taken, same).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), taken["mix_copies"].cast("int"))).alias("mix_copy")).drop("mix_copy")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


# The mix again by one window over each source; exact where ids are distinct.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || doc_id), 1, 15) AS BIGINT) AS ord
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(sum(size)) OVER () AS every,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 1.5 * every::DOUBLE
              - 2 * coalesce(sum(source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS room,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weights
  FROM s),
u AS (SELECT first(room / weights ORDER BY 2.0 * source_size / weight, source) FILTER (WHERE NOT room / weights * weight > 2.0 * source_size) AS unit FROM r),
t AS (SELECT source, source_size, CASE WHEN unit IS NULL OR unit * weight > 2.0 * source_size THEN 2.0 * source_size ELSE unit * weight END AS target FROM r, u),
k AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
         CAST('0x' || substr(md5(concat_ws(':', '17', 'offset', d.source)), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE AS off,
         row_number() OVER (PARTITION BY d.source ORDER BY
           CASE WHEN size < 32 THEN size ELSE length(bin(size)) * 16 + (size >> (length(bin(size)) - 5)) % 16 END, ord, doc_id) - 1 AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies
FROM (SELECT *, CAST(floor(off + (rank + 1) * rate) - floor(off + rank * rate) AS BIGINT) AS copies FROM k)
"""
