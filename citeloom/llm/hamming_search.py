"""Exact top-k Hamming search by incremental multi-index hashing of binary codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.llm._common import small, stage

#: Bits of a code and of a segment.
BITS, SEGMENT = 64, 16


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Signs of a vector's coordinates as a long; missing, null and NaN ones count as not positive. More than ``bits`` are an error."""
    wide = F.raise_error(F.concat(F.lit(f"a code of {bits} bits can't hold coordinates: "), F.size(vector).cast("string")))
    ones = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.coalesce((F.get(vector, i) > 0) & ~F.isnan(F.get(vector, i).cast("double")), F.lit(False)))
    number = F.array_join(F.transform(F.reverse(ones), lambda b: b.cast("int").cast("string")), "")
    high = F.conv(F.substring(number, 1, bits - 32), 2, 10).cast("long")
    low = F.conv(F.substring(number, bits - 31, 32), 2, 10).cast("long")
    return F.when(F.size(vector) > bits, wide.cast("long")).when(vector.isNotNull(), F.shiftleft(high, 32).bitwiseOR(low))


def segments(code: Column, bits: int, width: int) -> Column:
    """(number, value) of each segment of a code."""
    part = lambda i: F.shiftrightunsigned(code, i * width).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.struct(F.lit(i).alias("segment"), part(i).alias("value")) for i in range(bits // width)])


def search(
    rows: DataFrame, queries: DataFrame, k: int = 10, *, bits: int = BITS, width: int = SEGMENT
) -> DataFrame:
    """The ``k`` rows nearest to every query by Hamming distance, other than the query itself.

    ``rows`` and ``queries``: ``id`` long, ``code`` long. Returns ``query_id,
    id, distance, rank``; ties go to the smaller id.

    Rows with one code are an entry, with their ``k + 1`` smallest ids (no more
    can be among a query's results). Every entry is in the table of each segment
    under the segment's value. A round probes the values at distance r, for
    queries whose kth distance isn't proven yet; an entry that no round up to r
    has met differs in more than r bits of every segment, so at least
    ``segments * (r + 1)``: a query is done once its kth distance is less.
    Equal query codes are searched once.

    Null codes and null ids are left out. Fewer than ``k`` other rows give all of
    them. No rows give no rows.
    """
    spark, n_segments = rows.sparkSession, bits // width
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = rows.where("id is not null and code is not null")
    ranked = some.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for key in (["code", "salt"], ["code"]):  # a common code is cut down by many tasks first
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
        ranked = ranked.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    entries = stage(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    n_entries = entries.count()
    index = stage(entries.select("code", F.size("ids").alias("held"), F.explode(segments(F.col("code"), bits, width)).alias("s")).select("code", "held", "s.*"), "index")
    wanted = queries.where("id is not null and code is not null").select("id", "code").distinct()
    open_codes = stage(wanted.select("code").distinct().withColumn("edge", F.lit(bits)), "open")
    best = None
    parts = []
    for r in range(width + 1):
        n_open = open_codes.count()
        if not n_open:
            break
        # made once, not for every row
        masks = spark.range(1 << width).where(F.bit_count("id") == r).agg(F.collect_list("id")).scalar()
        probes = open_codes.repartition(n_parts, "code").select(F.col("code").alias("q"), "edge", F.explode(segments(F.col("code"), bits, width)).alias("s"))
        probes = probes.withColumn("masks", masks).select(
            "q", "edge", F.col("s.segment").alias("segment"), F.explode(F.transform("masks", lambda m: F.col("s.value").bitwiseXOR(m))).alias("value")
        )
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance")
        # Spark takes probes for as few as the codes they come from, and would broadcast them
        met = probes.join(small(index.hint("merge"), n_entries * n_segments, 48), ["segment", "value"]).select("q", "edge", "code", "held", distance)
        met = met.where("distance <= edge").drop("edge").distinct()
        if best is not None:
            met = met.union(best.join(open_codes.select(F.col("code").alias("q")), "q", "left_semi")).distinct()
        # the nearest entries that hold k + 1 ids between them, one for the query itself
        before = F.sum("held").over(Window.partitionBy("q").orderBy("distance", "code").rowsBetween(Window.unboundedPreceding, -1))
        kept = met.withColumn("before", F.coalesce(before, F.lit(0)))
        edge = kept.groupBy("q").agg(F.max(F.when(F.col("before") <= k, F.col("distance"))).alias("edge"), F.sum("held").alias("total"))
        best = stage(kept.join(edge, "q").where("distance <= edge").select("q", "code", "held", "distance", "edge", "total"), "best")
        known = best.groupBy("q").agg(F.max("edge").alias("best_edge"), F.max("total").alias("total"))
        proven = ((F.col("total") > k) & (F.col("best_edge") < n_segments * (r + 1))) | F.lit(r == width)
        known = stage(known.select("q", "total", "best_edge", proven.alias("proven")), "known")
        best = best.drop("edge", "total")
        parts.append(best.join(known.where("proven"), "q", "left_semi"))
        reach = F.when(F.col("total") > k, F.col("best_edge")).otherwise(bits)
        open_codes = open_codes.drop("edge").join(known, F.col("code") == F.col("q"), "left").where("proven is null or not proven")
        open_codes = stage(open_codes.select("code", F.coalesce(reach, F.lit(bits)).alias("edge")), "open")
    schema = "query_id long, id long, distance int, rank int"
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    pairs = found.join(small(entries, n_entries, 8 * (k + 3)), "code").select("q", "distance", F.explode("ids").alias("id"))
    top = Window.partitionBy("q").orderBy("distance", "id")
    pairs = pairs.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    out = wanted.join(pairs, wanted["code"] == pairs["q"]).select(
        F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near")
    )
    return out.select("query_id", F.posexplode("near").alias("at", "x")).select(
        "query_id", F.col("x.id").alias("id"), F.col("x.distance").cast("int").alias("distance"), (F.col("at") + 1).cast("int").alias("rank")
    )


def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes = stage(vectors.select(F.col("vec_id").cast("long").alias("id"), sign_code(F.col("embedding")).alias("code")), "signs")
    return search(codes, codes.where(F.col("id") % 50 == 0), 10)


OP8_SQL = """
WITH c AS (
  SELECT vec_id, list_reduce([CASE WHEN embedding[i + 1] > 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END FOR i IN range(64)], lambda a, x: a | x) AS code
  FROM embeddings),
d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id, CAST(bit_count(xor(q.code, r.code)) AS INTEGER) AS distance
  FROM c q JOIN c r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank
FROM d QUALIFY rank <= 10
"""
