"""Line deduplication by fingerprints of runs of lines, with windows counted in code points (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm._common import SPACE, small, stage, text_of

#: Least code points (white space folded) that a repeated run must have to be deleted.
RUN_CHARS = 40


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def folded(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACE, " "))


def passages(full: Column, n_lines: Column, run_chars: int) -> Column:
    """Least runs of at least ``run_chars`` code points from every line onwards and from every line back.

    ``full``: (at, h, n), position, hash and code points of the lines that aren't
    blank, in order. Returns (at, upto, print): a run's lines, blank ones in it
    included, and the hash of its content. A run has at most ``run_chars`` lines
    that aren't blank.
    """
    least, zero = F.lit(run_chars), F.lit(0)

    def steps(some: Column) -> Column:
        return F.aggregate(
            some,
            F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n")),
            lambda a, x: F.when(a["chars"] >= least, a).otherwise(F.struct((a["chars"] + x["n"]).alias("chars"), (a["n"] + 1).alias("n"))),
            lambda a: F.when(a["chars"] >= least, a["n"]),
        )

    def run(first: Column, n: Column, before: Column, after: Column) -> Column:
        """The run of ``n`` lines that aren't blank, alone and with 1 to ``before`` (``after``) blank lines beside it."""
        inside = F.slice(full, first + 1, n)
        start, end = F.get(full, first)["at"], F.get(full, first + n - 1)["at"] + 1
        content = F.xxhash64(F.transform(inside, lambda x: F.struct(x["h"], x["at"] - F.get(inside, 0)["at"])))
        one = F.struct(start.alias("at"), end.alias("upto"), content.alias("print"))

        def beside(o: Column, c: Column) -> Column:
            content = F.when(c == 0, o["print"]).otherwise(F.xxhash64(o["print"], c))
            return F.struct((o["at"] - F.greatest(c, zero)).alias("at"), (o["upto"] - F.least(c, zero)).alias("upto"), content.alias("print"))

        return F.get(F.transform(F.array(one), lambda o: F.transform(F.sequence(-after, before), lambda c: beside(o, c))), 0)

    nothing = F.array().cast("array<struct<at:int,upto:int,print:bigint>>")

    def runs(line: Column, k: Column) -> Column:
        before = F.when(k > 0, line["at"] - F.get(full, k - 1)["at"] - 1).otherwise(line["at"])
        after = F.when(k + 1 < F.size(full), F.get(full, k + 1)["at"]).otherwise(n_lines) - line["at"] - 1
        low = F.greatest(k - run_chars + 1, zero)
        onwards = steps(F.slice(full, k + 1, run_chars))
        back = steps(F.reverse(F.slice(full, low + 1, k - low + 1)))
        both = lambda n, part: F.coalesce(F.get(F.transform(F.array(n), lambda m: F.when(m.isNotNull(), part(m))), 0), nothing)
        return F.when(line["n"] >= least, run(k, F.lit(1), before, after)).otherwise(
            F.concat(both(onwards, lambda m: run(k, m, before, zero)), both(back, lambda m: run(k - m + 1, m, zero, after)))
        )

    return F.flatten(F.transform(full, runs))


def repeated_runs(docs: DataFrame, *, run_chars: int = RUN_CHARS) -> DataFrame:
    """Runs of lines that an earlier row, or an earlier place, has too.

    Returns ``row_key, at, upto, first_id, first_at``: lines ``at`` to ``upto``
    (exclusive, from 0) of the row repeat those from ``first_at`` of the row with
    id ``first_id``. A row's key is (doc_id, hash of its text).

    A window is counted in code points: from every line, onwards and back, the
    least run of ``run_chars`` code points gives a fingerprint of its whole
    content. Every line of any longer repeated run lies in such a run that is
    inside it, so nothing is extended, and a short line never stands for a run.
    For a fingerprint the least (doc_id, text hash, position) is the origin, and
    the other places are repeats; no pairs are made, whatever its frequency.
    """
    text = text_of(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), lines(text).alias("parts"))
    each = F.transform(F.transform("parts", folded), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.length(x).alias("n")))
    hashed = rows.select(
        F.struct(F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash")).alias("key"),
        F.size("parts").alias("n_lines"),
        F.filter(each, lambda x: x["n"] > 0).alias("full"),
    )
    hashed = stage(hashed.dropDuplicates(["key"]), "lines")
    marks = hashed.select("key", F.explode(passages(F.col("full"), F.col("n_lines"), run_chars)).alias("run"))
    marks = stage(marks.select("key", "run.at", "run.upto", "run.print"), "marks")
    origins = marks.groupBy("print").agg(F.min(F.struct("key", "at", "upto")).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").select("print", "origin")
    origins = stage(origins, "origins")
    joined = marks.join(small(origins, origins.count(), 64), "print")
    joined = joined.where((F.col("key") != F.col("origin.key")) | (F.col("at") != F.col("origin.at")))
    return joined.select(F.col("key").alias("row_key"), "at", "upto", F.col("origin.key.id").alias("first_id"), F.col("origin.at").alias("first_at"))


def drop_repeats(docs: DataFrame, *, run_chars: int = RUN_CHARS) -> DataFrame:
    """Texts without the runs of lines that an earlier row, or an earlier place, has.

    Returns ``doc_id, text_hash, n_lines, dropped`` (sorted positions of deleted
    lines), ``first_ids`` (ids that have them first) and ``cleaned``, a row for
    every row of ``docs``. Lines are equal when they are once white space is
    folded. Earlier means a smaller doc_id (null ids last), then text hash, then
    position; the first of all occurrences stays.

    Rows of one id and text are one row to the operator, so repeated rows have
    the same result. Null text counts as empty. No rows give no rows.
    """
    runs = repeated_runs(docs, run_chars=run_chars)
    gone = runs.select("row_key", "first_id", F.explode(F.sequence(F.col("at"), F.col("upto") - 1)).alias("line")).groupBy("row_key").agg(
        F.sort_array(F.collect_set("line")).alias("lines_gone"), F.sort_array(F.collect_set("first_id")).alias("ids")
    )
    gone = stage(gone, "gone").hint("merge")  # the texts are shuffled at every size: no row of lines has a bound
    text = text_of(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("body"))
    key = F.struct(F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash"))
    none = F.array().cast("array<int>")
    out = rows.withColumn("row_key", key).join(gone, "row_key", "left").withColumn("dropped", F.coalesce("lines_gone", none))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines(F.col("body"))) - 1), F.col("dropped"))
    # the lines are bound once, not split again for every place
    kept = F.get(F.transform(F.array(lines(F.col("body"))), lambda parts: F.transform(places, lambda i: F.get(parts, i))), 0)
    return out.select(
        "doc_id",
        "text_hash",
        F.size(lines(F.col("body"))).cast("long").alias("n_lines"),
        "dropped",
        F.coalesce("ids", F.array().cast("array<bigint>")).alias("first_ids"),
        F.when(F.size("dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("body")).alias("cleaned"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "n_lines",
        F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join(F.transform("dropped", lambda i: i.cast("string")), ",").alias("dropped"),
        F.array_join(F.transform("first_ids", lambda i: i.cast("string")), ",").alias("first_ids"),
        F.sha2("cleaned", 256).alias("cleaned_sha256"),
    )


# Exact where ids are distinct and not null.
OP10_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
f AS (
  SELECT doc_id, body, parts, list_transform(parts, lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS folded FROM t),
l AS (
  SELECT doc_id, pos, len(folded) AS n_lines, length(folded[pos + 1]) AS n
  FROM (SELECT doc_id, folded, unnest(range(len(folded))) AS pos FROM f)),
g AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS cum,
         pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -1) - 1 AS before,
         coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), n_lines) - pos - 1 AS after
  FROM l WHERE n > 0),
runs AS (
  SELECT a.doc_id, a.pos AS first, b.pos AS last, unnest(range(a.before + 1)) AS c
  FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.pos <= b.pos AND b.cum - a.cum + a.n >= 40 AND b.cum - b.n - a.cum + a.n < 40
  UNION
  SELECT a.doc_id, a.pos, b.pos, -unnest(range(b.after + 1))
  FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.pos <= b.pos AND b.cum - a.cum + a.n >= 40 AND b.cum - a.cum < 40),
m AS (
  SELECT r.doc_id, first - greatest(c, 0) AS pos, last + 1 - least(c, 0) AS upto, c, md5(array_to_string(folded[first + 1 : last + 1], chr(10))) AS print
  FROM runs r JOIN f USING (doc_id)),
o AS (SELECT *, first_value(struct_pack(doc_id := doc_id, pos := pos)) OVER (PARTITION BY print, c ORDER BY doc_id, pos, upto) AS origin FROM m),
x AS (SELECT doc_id, pos, upto, origin.doc_id AS first_id FROM o WHERE doc_id <> origin.doc_id OR pos <> origin.pos),
gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(pos, upto))))) AS dropped, list_sort(list_distinct(list(first_id))) AS ids FROM x GROUP BY doc_id)
SELECT f.doc_id, CAST(len(parts) AS BIGINT) AS n_lines, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(dropped, ','), '') AS dropped, coalesce(array_to_string(ids, ','), '') AS first_ids,
       sha256(CASE WHEN dropped IS NULL THEN body
                   ELSE array_to_string([parts[i] FOR i IN range(1, len(parts) + 1) IF NOT list_contains(dropped, i - 1)], chr(10)) END) AS cleaned_sha256
FROM f LEFT JOIN gone USING (doc_id)
"""
