"""Decision tables over columns derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.operators import decisions
from citeloom.plans.catalog import query, table

SQL_V = "WITH v AS (SELECT *, l_returnflag = 'R' AND l_linestatus = 'F' AS con, CASE WHEN l_discount < 0.02 THEN FALSE WHEN l_discount > 0.09 THEN NULL ELSE TRUE END AS eng, CAST(l_tax > 0.06 AS INT) AS unc FROM lineitem) "


def _signals(spark, sf_dir):
    con = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    eng = F.when(F.col("l_discount") < 0.02, False).when(F.col("l_discount") > 0.09, None).otherwise(True)
    return table(spark, sf_dir, "lineitem").withColumns({"con": con, "eng": eng, "unc": (F.col("l_tax") > 0.06).cast("int")})


def _histogram(df, **columns):
    return df.groupBy(*[c.alias(n) for n, c in columns.items()]).agg(F.count(F.lit(1)).alias("n"))


@query("coverage_abstract_scope", SQL_V + "SELECT CASE WHEN con THEN FALSE WHEN eng IS DISTINCT FROM TRUE THEN NULL WHEN unc > 0 THEN NULL ELSE TRUE END AS established, count(*) AS n FROM v GROUP BY 1")
def coverage_abstract_scope(spark, sf_dir):
    return _histogram(_signals(spark, sf_dir), established=decisions.coverage_by_abstract(F.col("con"), F.col("eng"), F.col("unc")))


@query("coverage_full_text_scope", SQL_V + "SELECT CASE WHEN con THEN FALSE WHEN eng AND unc = 0 THEN TRUE WHEN l_quantity > 25 THEN FALSE END AS established, count(*) AS n FROM v GROUP BY 1")
def coverage_full_text_scope(spark, sf_dir):
    return _histogram(_signals(spark, sf_dir), established=decisions.coverage_by_full_text(F.col("con"), F.col("eng"), F.col("unc"), F.col("l_quantity") > 25))


@query("coverage_buckets_tri_state", SQL_V + "SELECT CASE WHEN con THEN 'contradicted' WHEN eng IS NOT DISTINCT FROM FALSE THEN 'off_topic' WHEN eng AND unc > 0 THEN 'unconfirmed_specific' WHEN eng THEN 'established' END AS bucket, count(*) AS n FROM v GROUP BY 1")
def coverage_buckets_tri_state(spark, sf_dir):
    return _histogram(_signals(spark, sf_dir), bucket=decisions.coverage_bucket(F.col("con"), F.col("eng"), F.col("unc")))


@query("absence_guard", SQL_V + "SELECT CASE WHEN eng IS NOT DISTINCT FROM FALSE AND NOT con THEN NULL ELSE eng END AS established, count(*) AS n FROM v GROUP BY 1")
def absence_guard(spark, sf_dir):
    return _histogram(_signals(spark, sf_dir), established=decisions.absence_guard(F.col("eng"), F.col("con")))


@query("admission", "SELECT CASE WHEN l IS NULL THEN 'excluded_preband_disposition_missing' WHEN l IN ('cleared', 'accurate', 'same_work') THEN 'admitted' ELSE 'excluded_preband' END AS admission, count(*) AS n FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'cleared' WHEN 1 THEN 'same_work' WHEN 2 THEN 'human_review' WHEN 3 THEN 'accurate' WHEN 4 THEN 'unscoreable' END AS l FROM orders) GROUP BY 1")
def admission(spark, sf_dir):
    labels = F.array(*[F.lit(x) for x in ("cleared", "same_work", "human_review", "accurate", "unscoreable")])
    return _histogram(table(spark, sf_dir, "orders"), admission=decisions.admission(F.get(labels, (F.col("o_orderkey") % 6).cast("int"))))


@query("notice_date_state", "SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'absent' WHEN a IS NULL OR b IS NULL OR a > b THEN 'unparseable' WHEN b <= c THEN 'compared' WHEN a > c THEN 'after_cutoff' ELSE 'boundary_uncertain' END AS state, count(*) AS n FROM (SELECT CASE WHEN l_linenumber <> 1 THEN o_orderdate::DATE END AS a, CASE WHEN l_linenumber > 2 OR l_linenumber = 1 AND l_tax > 0.04 THEN l_shipdate::DATE END AS b, DATE '1996-06-01' AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1")
def notice_date_state(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    low = F.when(F.col("l_linenumber") != 1, F.col("o_orderdate").cast("date"))
    high = F.when((F.col("l_linenumber") > 2) | (F.col("l_linenumber") == 1) & (F.col("l_tax") > 0.04), F.col("l_shipdate").cast("date"))
    return _histogram(rows, state=decisions.date_state(low, high, F.lit("1996-06-01").cast("date")))


@query("fetch_status", "SELECT CASE WHEN h IS NULL THEN 'not_attempted' WHEN h = 200 AND value > 10 THEN 'answered_record' WHEN h IN (200, 404) THEN 'answered_absent' ELSE 'resolver_error' END AS status, count(*) AS n FROM (SELECT *, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 404 WHEN 'error' THEN 503 END AS h FROM events) GROUP BY 1")
def fetch_status(spark, sf_dir):
    http = F.when(F.col("event_type") == "click", 200).when(F.col("event_type") == "view", 404).when(F.col("event_type") == "error", 503)
    return _histogram(table(spark, sf_dir, "events"), status=decisions.fetch_status(http, F.col("value") > 10))


SQL_P = "CASE ({0}) % 5 WHEN 0 THEN 'found' WHEN 1 THEN 'absent' WHEN 2 THEN 'absent' WHEN 3 THEN 'error' ELSE 'absent' END"


@query(
    "exact_doi_status",
    "WITH p AS (SELECT " + ", ".join(f"{SQL_P.format(e)} AS {n}" for n, e in (("a", "l_partkey"), ("b", "l_suppkey"), ("c", "l_orderkey"), ("d", "l_linenumber"))) + " FROM lineitem) SELECT CASE WHEN b = 'absent' AND 'found' IN (a, c, d) THEN 'conflict' WHEN 'found' IN (a, c, d) THEN 'found' WHEN b = 'found' THEN 'found_no_metadata' WHEN a = 'absent' AND b = 'absent' AND c = 'absent' AND d = 'absent' THEN 'answered_absent' ELSE 'incomplete' END AS status, count(*) AS n FROM p GROUP BY 1",
)
def exact_doi_status(spark, sf_dir):
    said = lambda c: F.when(F.col(c) % 5 == 0, "found").when(F.col(c) % 5 == 3, "error").otherwise("absent")
    return _histogram(table(spark, sf_dir, "lineitem"), status=decisions.exact_doi(*[said(c) for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")]))


@query("comparability", "SELECT CASE WHEN c = 'mismatch' OR p IN ('narrower', 'disjoint') THEN 'not_comparable' WHEN c = 'uncertain' OR p = 'unclear' THEN 'uncertain' ELSE 'comparable' END AS comparability, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'uncertain' ELSE 'match' END AS c, CASE p_partkey % 7 WHEN 0 THEN 'narrower' WHEN 1 THEN 'disjoint' WHEN 2 THEN 'unclear' ELSE 'same' END AS p FROM part) GROUP BY 1")
def comparability(spark, sf_dir):
    claim = F.when(F.col("p_size") % 4 == 0, "mismatch").when(F.col("p_size") % 4 == 1, "uncertain").otherwise("match")
    people = F.when(F.col("p_partkey") % 7 == 0, "narrower").when(F.col("p_partkey") % 7 == 1, "disjoint").when(F.col("p_partkey") % 7 == 2, "unclear").otherwise("same")
    return _histogram(table(spark, sf_dir, "part"), comparability=decisions.comparability(claim, F.lit("same"), people))


@query("evidence_pattern", "SELECT pattern, count(*) AS n FROM (SELECT CASE WHEN m > 0 OR o > 0 AND c > 0 THEN 'mixed_evidence' WHEN o > 1 THEN 'multiple_opposition' WHEN o > 0 THEN 'single_opposition' WHEN c > 0 THEN 'confirmation_only_found' WHEN u THEN 'unassessable' ELSE 'no_controversy_found' END AS pattern FROM (SELECT l_orderkey, count_if(l_quantity > 48) AS m, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R' AND l_tax > 0.05) AS o, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'A' AND l_tax > 0.05) AS c, bool_or(l_discount > 0.08) AS u FROM lineitem GROUP BY 1)) GROUP BY 1")
def evidence_pattern(spark, sf_dir):
    some = lambda flag: F.countDistinct(F.when((F.col("l_returnflag") == flag) & (F.col("l_tax") > 0.05), F.col("l_suppkey")))
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 48).alias("m"), some("R").alias("o"), some("A").alias("c"), F.max(F.col("l_discount") > 0.08).alias("u"))
    return _histogram(per, pattern=decisions.evidence_pattern(F.col("m"), F.col("o"), F.col("c"), F.col("u")))


@query("resolved_identifier", "SELECT o_orderkey, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'pmid' WHEN c IS NOT NULL THEN 'doi' ELSE 'none' END AS kind FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'r' || o_custkey END AS a, nullif(trim(CASE WHEN o_orderkey % 2 = 0 THEN ' ' WHEN o_orderkey % 5 = 0 THEN ' 12 ' END), '') AS b, CASE WHEN o_orderkey % 7 = 0 THEN '10.1/x' END AS c FROM orders)")
def resolved_identifier(spark, sf_dir):
    key = F.col("o_orderkey")
    found = decisions.resolved_identifier(
        F.when(key % 3 == 0, F.concat(F.lit("r"), F.col("o_custkey").cast("string"))), F.when(key % 2 == 0, " ").when(key % 5 == 0, " 12 "), F.when(key % 7 == 0, "10.1/x")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("x")).select("o_orderkey", "x.value", "x.kind")


@query("high_band_rate", "SELECT count_if(quality = 1) AS high, count(*) AS scoreable, CASE WHEN count(*) > 0 THEN round(count_if(quality = 1) / count(*), 6) END AS rate FROM labels WHERE toxic = 0")
def high_band_rate(spark, sf_dir):
    high, n = F.count_if(F.col("quality") == 1), F.count(F.lit(1))
    return table(spark, sf_dir, "labels").where("toxic = 0").agg(high.alias("high"), n.alias("scoreable"), F.when(n > 0, F.round(high / n, 6)).alias("rate"))


@query("hold_reasons", "SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_tax > 0.07 THEN 'strength' END, CASE WHEN l_discount > 0.08 THEN 'entity' END, CASE WHEN l_quantity < 3 THEN 'provenance' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY 1")
def hold_reasons(spark, sf_dir):
    reasons = [(F.col("l_tax") > 0.07, "strength"), (F.col("l_discount") > 0.08, "entity"), (F.col("l_quantity") < 3, "provenance")]
    held = table(spark, sf_dir, "lineitem").select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons]))).alias("reason"))
    return _histogram(held, reason=F.col("reason"))


@query("round_robin_interleave", "SELECT event_id, place FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY r, event_type) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events)) WHERE place <= 10")
def round_robin_interleave(spark, sf_dir):
    """First of each stream, then second of each, and so on; the first ten of a user (a report)."""
    r = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("r", "event_type"))
    return table(spark, sf_dir, "events").withColumn("r", r).withColumn("place", place).where("place <= 10").select("event_id", F.col("place").cast("long").alias("place"))


@query("candidate_cap", "SELECT user_id, count(*) AS pool, least(count(*), 50) AS kept, count(*) > 50 AS truncated FROM events GROUP BY 1")
def candidate_cap(spark, sf_dir):
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("pool"), F.least(n, F.lit(50)).alias("kept"), (n > 50).alias("truncated"))


@query("word_alignment", "WITH b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM benchmark), t AS (SELECT DISTINCT item_id, unnest(w) AS word FROM b), p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS n_both FROM t x JOIN t y ON x.word = y.word AND x.item_id <> y.item_id GROUP BY 1, 2) SELECT a, p.b, round(n_both / (len(l.w) + len(r.w) - n_both), 6) AS jaccard FROM p JOIN b l ON l.item_id = a JOIN b r ON r.item_id = p.b QUALIFY row_number() OVER (PARTITION BY a ORDER BY n_both / (len(l.w) + len(r.w) - n_both) DESC, p.b) = 1")
def word_alignment(spark, sf_dir):
    """Best aligned other item by word Jaccard, ties to the earliest; counted from an equi-join on words."""
    from citeloom.functions.text import words
    from citeloom.operators.ranking import first_per

    items = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("w"))
    by = items.select("item_id", F.size("w").alias("size"), F.explode("w").alias("word"))
    other = by.select(F.col("item_id").alias("b"), F.col("size").alias("b_size"), "word")
    both = by.withColumnRenamed("item_id", "a").join(other, "word").where("a <> b").groupBy("a", "b", "size", "b_size").agg(F.count(F.lit(1)).alias("both"))
    scored = both.withColumn("j", F.col("both") / (F.col("size") + F.col("b_size") - F.col("both")))
    return first_per(scored, ["a"], [F.desc("j"), "b"]).select("a", "b", F.round("j", 6).alias("jaccard"))


@query("word_alignment_sentences")
def word_alignment_sentences(spark, sf_dir):
    """Best sentence of all documents for every item by word Jaccard, ties to the first document and sentence; too slow as SQL."""
    from citeloom.functions.text import words
    from citeloom.operators.alignment import best_sentences

    items = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("words"))
    best = best_sentences(table(spark, sf_dir, "documents"), items)
    return best.select("item_id", "doc_id", "sentence", F.round("score", 6).alias("jaccard"))
