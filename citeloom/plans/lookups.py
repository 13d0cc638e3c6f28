"""Joins, ranks, reports and identity rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions import similarity, text
from citeloom.functions.rules import first_match
from citeloom.functions.tri import is_false, is_true
from citeloom.operators.graph import min_label
from citeloom.operators.ranking import first_per, islands, reciprocal_rank, spread_rank, wilson
from citeloom.plans.catalog import query, table


@query(
    "disposition_join",
    """SELECT o_orderkey AS pair, CASE WHEN c_custkey IS NULL THEN 'excluded_preband_disposition_missing' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'admitted' ELSE 'excluded_preband' END AS disposition
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey""",
)
def disposition_join(spark, sf_dir):
    """Left and fail-closed: a pair without a disposition has a bucket of its own."""
    known = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select("c_custkey", "c_mktsegment")
    label = first_match([(F.col("c_custkey").isNull(), "excluded_preband_disposition_missing"), (F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "admitted")], "excluded_preband")
    return table(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("pair"), label.alias("disposition"))


def _sides(spark, sf_dir):
    want = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("w", F.lit(1))
    have = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id")).withColumn("h", F.lit(1))
    return want.join(have, "id", "full_outer")


SQL_SIDES = "WITH s AS (SELECT coalesce(w.id, h.id) AS id, w.id AS w, h.id AS h FROM (SELECT DISTINCT o_custkey AS id FROM orders) w FULL JOIN (SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0) h ON w.id = h.id) "


@query("join_accounting", SQL_SIDES + "SELECT count_if(w IS NOT NULL AND h IS NOT NULL) AS matched, count_if(h IS NULL) AS missing, count_if(w IS NULL) AS extra, count_if(w IS NOT NULL AND h IS NOT NULL) / count(w) AS coverage FROM s")
def join_accounting(spark, sf_dir):
    matched = F.count_if(F.col("w").isNotNull() & F.col("h").isNotNull())
    return _sides(spark, sf_dir).agg(matched.alias("matched"), F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("extra"), (matched / F.count("w")).alias("coverage"))


@query("missing_extra_samples", SQL_SIDES + "SELECT side, id FROM (SELECT CASE WHEN h IS NULL THEN 'missing' ELSE 'extra' END AS side, id, row_number() OVER (PARTITION BY h IS NULL ORDER BY id) AS n FROM s WHERE w IS NULL OR h IS NULL) WHERE n <= 10")
def missing_extra_samples(spark, sf_dir):
    sides = _sides(spark, sf_dir).where("w is null or h is null").select(F.when(F.col("h").isNull(), "missing").otherwise("extra").alias("side"), "id")
    return sides.withColumn("n", F.row_number().over(Window.partitionBy("side").orderBy("id"))).where("n <= 10").select("side", "id")


SQL_SIDES_ALL = "WITH s AS (SELECT coalesce(w.id, h.id) AS id, w.id AS w, h.id AS h FROM (SELECT DISTINCT o_custkey AS id FROM orders) w FULL JOIN (SELECT c_custkey AS id FROM customer) h ON w.id = h.id) "


def _sides_all(spark, sf_dir):
    want = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("w", F.lit(1))
    return want.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).withColumn("h", F.lit(1)), "id", "full_outer")


@query(
    "disposition_join_all",
    "SELECT o_orderkey AS pair, CASE WHEN c_custkey IS NULL THEN 'excluded_preband_disposition_missing' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'admitted' ELSE 'excluded_preband' END AS disposition FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def disposition_join_all(spark, sf_dir):
    """``disposition_join`` over every customer; who is missing comes from the tables."""
    label = first_match([(F.col("c_custkey").isNull(), "excluded_preband_disposition_missing"), (F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "admitted")], "excluded_preband")
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("pair"), label.alias("disposition"))


@query("join_accounting_all", SQL_SIDES_ALL + "SELECT count_if(w IS NOT NULL AND h IS NOT NULL) AS matched, count_if(h IS NULL) AS missing, count_if(w IS NULL) AS extra, count_if(w IS NOT NULL AND h IS NOT NULL) / count(w) AS coverage FROM s")
def join_accounting_all(spark, sf_dir):
    matched = F.count_if(F.col("w").isNotNull() & F.col("h").isNotNull())
    return _sides_all(spark, sf_dir).agg(matched.alias("matched"), F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("extra"), (matched / F.count("w")).alias("coverage"))


@query("missing_extra_all", SQL_SIDES_ALL + "SELECT CASE WHEN h IS NULL THEN 'missing' ELSE 'extra' END AS side, id FROM s WHERE w IS NULL OR h IS NULL")
def missing_extra_all(spark, sf_dir):
    """Every id that one side lacks."""
    return _sides_all(spark, sf_dir).where("w is null or h is null").select(F.when(F.col("h").isNull(), "missing").otherwise("extra").alias("side"), "id")


@query(
    "queue_audit",
    "SELECT CASE WHEN q.id IS NULL THEN 'not_queued' ELSE 'not_predicted' END AS fault, count(*) AS n FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F') q FULL JOIN (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linestatus = 'O') p ON q.id = p.id WHERE q.id IS NULL OR p.id IS NULL GROUP BY 1",
)
def queue_audit(spark, sf_dir):
    """Symmetric difference of the queue and the predictions."""
    queue = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))
    seen = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("id")).distinct()
    one = seen.join(queue, "id", "left_anti").select(F.lit("not_queued").alias("fault")).union(queue.join(seen, "id", "left_anti").select(F.lit("not_predicted")))
    return one.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


SQL_HITS = "WITH h AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE greatest(s_acctbal, 0) / 100 END AS a, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey * 37) % 101 END AS b FROM supplier) "


@query(
    "hits_answered_states",
    SQL_HITS + "SELECT id, CAST(greatest(a, b) AS DOUBLE) AS best, CASE WHEN a IS NULL AND b IS NULL THEN 'unanswered' WHEN greatest(a, b) >= 95 THEN 'settled' WHEN greatest(a, b) >= 85 THEN 'found' WHEN a IS NULL OR b IS NULL THEN 'not_fully_answered' ELSE 'absent' END AS state FROM h",
)
def hits_answered_states(spark, sf_dir):
    """No answer is null and never becomes 0; the best score skips nulls."""
    a = F.when(F.col("s_suppkey") % 3 != 0, F.greatest("s_acctbal", F.lit(0.0)) / 100)
    b = F.when(F.col("s_suppkey") % 4 != 0, ((F.col("s_suppkey") * 37) % 101).cast("double"))
    best = F.greatest(a, b)
    state = first_match([(best.isNull(), "unanswered"), (best >= 95, "settled"), (best >= 85, "found"), (a.isNull() | b.isNull(), "not_fully_answered")], "absent")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), best.alias("best"), state.alias("state"))


@query(
    "retraction_timing",
    "SELECT CASE WHEN l_returnflag = 'N' THEN 'unresolved' WHEN l_returnflag = 'A' THEN 'clear' WHEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) >= 31 THEN 'qualified' ELSE 'timing_indeterminate' END AS status, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def retraction_timing(spark, sf_dir):
    """A notice counts from 31 days after the citing date."""
    gap = F.datediff("l_shipdate", "o_orderdate")
    status = first_match([(F.col("l_returnflag") == "N", "unresolved"), (F.col("l_returnflag") == "A", "clear"), (gap >= 31, "qualified")], "timing_indeterminate")
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "asof_notice",
    "SELECT e.event_id, n.event_id AS notice_id FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') n ON e.user_id = n.user_id AND e.ts >= n.ts",
)
def asof_notice(spark, sf_dir):
    """Latest notice of a user at or before an event: one window, no join."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'error')")
    back = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "error").rowsBetween(Window.unboundedPreceding, 0)
    notice = F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(back)
    return e.withColumn("notice_id", notice).where("event_type = 'click'").select("event_id", "notice_id")


@query(
    "interval_valid_mapping",
    "SELECT l_partkey AS surface, l_orderkey, l_linenumber, l_suppkey, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state FROM (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, count(DISTINCT s_suppkey) AS n FROM lineitem LEFT JOIN supplier ON l_suppkey % 25 = s_nationkey AND l_quantity BETWEEN s_suppkey % 20 AND s_suppkey % 20 + 15 GROUP BY 1, 2, 3, 4)",
)
def interval_valid_mapping(spark, sf_dir):
    """Mappings that are valid at a value, counted once for each key and whole value, so that a line meets one row.

    Only lines that stand several times with other values meet the mappings themselves.
    """
    low = F.col("s_suppkey") % 20
    mapping = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey", F.explode(F.sequence(low, low + 15)).alias("value"))
    valid = mapping.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    keys = ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.collect_set(F.col("l_quantity").cast("long")).alias("values"))
    lines = lines.withColumn("at", F.col("l_suppkey") % 25)
    same = (F.col("at") == F.col("key")) & (F.get("values", 0) == F.col("value"))
    once = lines.where("size(values) = 1").join(valid, same, "left").select(*keys, "n")
    more = lines.where("size(values) > 1").join(mapping, (F.col("at") == F.col("key")) & F.array_contains("values", F.col("value")), "left")
    n = once.union(more.groupBy(*keys).agg(F.countDistinct("s_suppkey").alias("n")))
    state = first_match([(F.col("n") == 1, "resolved"), (F.col("n") > 1, "ambiguous")], "unresolved")
    return n.select(F.col("l_partkey").alias("surface"), *keys[1:], state.alias("state"))


@query(
    "date_window_candidates",
    "SELECT state, count(*) AS n FROM (SELECT CASE WHEN last_day(o_orderdate) <= DATE '1998-06-15' AND date_trunc('month', o_orderdate) > DATE '1995-03-01' THEN 'in_window' WHEN date_trunc('month', o_orderdate) <= DATE '1998-06-15' AND last_day(o_orderdate) > DATE '1998-06-15' THEN 'boundary_uncertain' ELSE 'outside' END AS state FROM orders) GROUP BY 1",
)
def date_window_candidates(spark, sf_dir):
    """Month-precise dates as intervals against a window; a straddled end is uncertain and counted."""
    low, high, as_of = F.trunc("o_orderdate", "month"), F.last_day("o_orderdate"), F.lit("1998-06-15").cast("date")
    state = first_match([((high <= as_of) & (low > F.lit("1995-03-01").cast("date")), "in_window"), ((low <= as_of) & (high > as_of), "boundary_uncertain")], "outside")
    return table(spark, sf_dir, "orders").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


NAMES = "WITH n AS (SELECT DISTINCT lower(p_name) AS t FROM part), p AS (SELECT a.t AS a, b.t AS b FROM n a JOIN n b ON a.t < b.t) "


def _names(spark, sf_dir):
    """Pairs of distinct names that share a word: an equi-join on words, not all pairs."""
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("t")).distinct()
    by = names.select("t", F.explode(F.split("t", " ")).alias("w")).distinct()
    other = by.select(F.col("t").alias("b"), "w")
    return by.withColumnRenamed("t", "a").join(other, "w").where("a < b").select("a", "b").distinct()


SHARED = NAMES.replace("ON a.t < b.t", "ON a.t < b.t AND len(list_intersect(string_split(a.t, ' '), string_split(b.t, ' '))) > 0")
TRIGRAMS = "list_distinct([substring({0}, i, 3) FOR i IN range(1, greatest(length({0}) - 1, 2))])"


@query(
    "trigram_similarity",
    SHARED
    + ", g AS (SELECT a, b, " + TRIGRAMS.format("a") + " AS x, " + TRIGRAMS.format("b") + " AS y FROM p) SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) AS jaccard, round(len(list_intersect(x, y)) / least(len(x), len(y)), 4) AS containment FROM g",
)
def trigram_similarity(spark, sf_dir):
    x, y = similarity.trigrams(F.col("a")), similarity.trigrams(F.col("b"))
    pairs = _names(spark, sf_dir).withColumns({"x": x, "y": y})
    return pairs.select("a", "b", F.round(similarity.jaccard(F.col("x"), F.col("y")), 4).alias("jaccard"), F.round(similarity.containment(F.col("x"), F.col("y")), 4).alias("containment"))


@query("jaro_winkler_pairs", SHARED + "SELECT a, b, round(jaro_winkler_similarity(a, b), 4) AS similarity FROM p")
def jaro_winkler_pairs(spark, sf_dir):
    return _names(spark, sf_dir).select("a", "b", F.round(similarity.jaro_winkler_udf("a", "b"), 4).alias("similarity"))


SQL_SCORE = """WITH f AS (SELECT p_partkey AS id, p_retailprice / 2200.0 AS ts, CASE p_size % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS author, CASE p_size % 5 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS year, p_size % 2 = 0 AS journal FROM part),
s AS (SELECT *, round(greatest(0, least(1, ts + CASE WHEN author THEN .05 WHEN NOT author THEN -.15 ELSE 0 END + CASE WHEN year THEN .05 WHEN NOT year THEN -.10 ELSE 0 END + CASE WHEN journal THEN .03 ELSE 0 END)), 4) AS score FROM f) """


def _scored(spark, sf_dir):
    """Title similarity with nudges for fields that agree or don't; unknown fields add nothing."""
    f = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (F.col("p_retailprice") / 2200.0).alias("ts"),
        F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 3 == 1, False).alias("author"),
        F.when(F.col("p_size") % 5 == 0, False).when(F.col("p_size") % 5 != 1, True).alias("year"),
        (F.col("p_size") % 2 == 0).alias("journal"),
    )
    nudge = lambda c, up, down: F.when(is_true(F.col(c)), up).when(is_false(F.col(c)), down).otherwise(0.0)
    total = F.col("ts") + nudge("author", 0.05, -0.15) + nudge("year", 0.05, -0.10) + nudge("journal", 0.03, 0.0)
    return f.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4))


@query("composite_score", SQL_SCORE + "SELECT id, CAST(score AS DOUBLE) AS score, score < 0.85 OR year IS NOT DISTINCT FROM FALSE AS flagged FROM s")
def composite_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "score", ((F.col("score") < 0.85) | is_false(F.col("year"))).alias("flagged"))


@query("evidence_bands", SQL_SCORE + "SELECT CASE WHEN author IS NOT DISTINCT FROM FALSE OR year IS NOT DISTINCT FROM FALSE THEN 'STRONG_WRONG' WHEN author IS NULL THEN 'SPARSE' WHEN author AND year IS NOT DISTINCT FROM TRUE THEN 'SAME_AUTHOR_SAME_YEAR' ELSE 'OTHER' END AS band, count(*) AS n FROM s GROUP BY 1")
def evidence_bands(spark, sf_dir):
    author, year = F.col("author"), F.col("year")
    band = first_match([(is_false(author) | is_false(year), "STRONG_WRONG"), (author.isNull(), "SPARSE"), (is_true(author) & is_true(year), "SAME_AUTHOR_SAME_YEAR")], "OTHER")
    return _scored(spark, sf_dir).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "best_match_margin",
    "SELECT l_partkey AS id, l_suppkey AS best, round(s, 4) AS score, coalesce(s - nxt < 0.05, FALSE) AS ambiguous FROM (SELECT *, row_number() OVER w AS n, lead(s) OVER w AS nxt FROM (SELECT l_partkey, l_suppkey, max(l_extendedprice) / 105000 AS s FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_partkey ORDER BY s DESC, l_suppkey)) WHERE n = 1",
)
def best_match_margin(spark, sf_dir):
    """Best candidate, ambiguous if the second is less than 0.05 below."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg((F.max("l_extendedprice") / 105000).alias("s"))
    w = Window.partitionBy("l_partkey").orderBy(F.desc("s"), "l_suppkey")
    best = c.withColumns({"n": F.row_number().over(w), "nxt": F.lead("s").over(w)}).where("n = 1")
    return best.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("best"), F.round("s", 4).alias("score"), F.coalesce(F.col("s") - F.col("nxt") < 0.05, F.lit(False)).alias("ambiguous"))


@query("first_citance_wins", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def first_citance_wins(spark, sf_dir):
    return first_per(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "role")


@query("group_ids", "SELECT conv_id, turn, role, printf('%d:g%02d', conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn)) AS group_id FROM conversations")
def group_ids(spark, sf_dir):
    nth = F.dense_rank().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.format_string("%d:g%02d", "conv_id", nth).alias("group_id"))


@query(
    "marker_clusters",
    "WITH m AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR AS gap FROM events), c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM m) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS members, min(event_id) AS first_member FROM c GROUP BY 1, 2",
)
def marker_clusters(spark, sf_dir):
    """Runs of neighbours: gaps and islands."""
    at = F.col("ts").cast("timestamp").cast("double")
    gap = at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts"))
    e = table(spark, sf_dir, "events").withColumn("gap", gap)
    return islands(e, ["user_id"], "ts", F.col("gap").isNull() | (F.col("gap") > 6 * 3600)).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("members"), F.min("event_id").alias("first_member"))


@query("range_expand", "SELECT l_orderkey AS doc, unnest(range(lo + 1, hi)) AS member FROM (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1)")
def range_expand(spark, sf_dir):
    """Members inside a printed range a-b."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi")).where("hi - lo > 1")
    return r.select(F.col("l_orderkey").alias("doc"), F.explode(F.sequence(F.col("lo").cast("long") + 1, F.col("hi").cast("long") - 1)).alias("member"))


SQL_STREAMS = "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, user_id) AS rank FROM (SELECT user_id, event_type, round(sum(value), 6) AS v FROM events GROUP BY 1, 2)) "


def _streams(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("v"))
    return spread_rank(v, "event_type", "v", "user_id")


@query("rrf_fusion", SQL_STREAMS + "SELECT user_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS streams, min(rank) AS best_rank FROM r GROUP BY 1")
def rrf_fusion(spark, sf_dir):
    return _streams(spark, sf_dir).groupBy("user_id").agg(F.round(F.sum(reciprocal_rank(F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("streams"), F.min("rank").cast("long").alias("best_rank"))


@query("multi_stream_rank", SQL_STREAMS + "SELECT user_id, row_number() OVER (ORDER BY n DESC, lo, total, user_id) AS place FROM (SELECT user_id, count(*) AS n, min(rank) AS lo, sum(rank) AS total FROM r GROUP BY 1) QUALIFY place <= 50")
def multi_stream_rank(spark, sf_dir):
    """Top 50 by number of streams, best rank, sum of ranks, id (a report)."""
    c = _streams(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"), F.sum("rank").alias("total"))
    top = c.orderBy(F.desc("n"), "lo", "total", "user_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "lo", "total", "user_id")).cast("long")).select("user_id", "place")


@query("budgeted_priority", "SELECT user_id, event_id, used FROM (SELECT *, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM events) WHERE used <= 8")
def budgeted_priority(spark, sf_dir):
    """In priority order until a budget is used up; free rows don't use any."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").withColumn("used", F.sum(F.when(F.col("event_type") != "view", 1).otherwise(0)).over(w)).where("used <= 8").select("user_id", "event_id", "used")


@query("representative_pick", "SELECT o_custkey, o_orderkey AS pick FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) = 1")
def representative_pick(spark, sf_dir):
    return first_per(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderpriority", F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("pick"))


@query("retry_within_budget", "SELECT user_id, min(attempt) FILTER (event_type <> 'error') AS first_ok FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS attempt FROM events) WHERE attempt <= 3 GROUP BY 1")
def retry_within_budget(spark, sf_dir):
    tries = table(spark, sf_dir, "events").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))).where("attempt <= 3")
    return tries.groupBy("user_id").agg(F.min(F.when(F.col("event_type") != "error", F.col("attempt"))).cast("long").alias("first_ok"))


@query("status_tally_delta", "SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS later, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') - count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS delta FROM events GROUP BY 1")
def status_tally_delta(spark, sf_dir):
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(late).alias("later"), (F.count_if(late) - F.count_if(~late)).alias("delta"))


@query("token_ledger_cost", "SELECT l_linestatus AS stage, CAST(sum(l_quantity) AS DOUBLE) AS tokens, round(sum(l_quantity * CASE WHEN l_quantity > 40 THEN 2 ELSE 1 END * price), 4) AS cost FROM lineitem JOIN (VALUES ('A', 0.5), ('N', 1.0), ('R', 2.5)) p(flag, price) ON flag = l_returnflag GROUP BY 1")
def token_ledger_cost(spark, sf_dir):
    """Sums by stage at a price table, with a surcharge on long prompts."""
    prices = F.broadcast(spark.createDataFrame([("A", 0.5), ("N", 1.0), ("R", 2.5)], "flag string, price double"))
    cost = F.col("l_quantity") * F.when(F.col("l_quantity") > 40, 2).otherwise(1) * F.col("price")
    return table(spark, sf_dir, "lineitem").join(prices, F.col("flag") == F.col("l_returnflag")).groupBy(F.col("l_linestatus").alias("stage")).agg(F.sum("l_quantity").alias("tokens"), F.round(F.sum(cost), 4).alias("cost"))


SQL_WILSON = "(k / n + 3.8416 / (2 * n) {0} 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)"


@query("wilson_precision", f"SELECT lang, n, k, round({SQL_WILSON.format('-')}, 4) AS low, round({SQL_WILSON.format('+')}, 4) AS high FROM (SELECT lang, count(*) AS n, count_if(quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def wilson_precision(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select("lang", "n", "k", low.alias("low"), high.alias("high"))


@query("verdict_conflicts", "SELECT l_orderkey, l_linenumber, count(DISTINCT l_returnflag) AS verdicts FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def verdict_conflicts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_returnflag").alias("verdicts")).where("verdicts > 1")


@query("journal_census", "SELECT p_brand, p_type, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place FROM part GROUP BY 1, 2")
def journal_census(spark, sf_dir):
    """Pairs ranked by how frequent they are; ties share a place. Ranks come from the histogram of counts."""
    c = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    levels = c.groupBy("n").agg(F.count(F.lit(1)).alias("at"))
    above = F.coalesce(F.sum("at").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.join(levels.select("n", (above + 1).alias("place")), "n").select("p_brand", "p_type", "n", "place")


@query(
    "study_clusters",
    "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 50 AND l_discount >= 0.09), n AS (SELECT DISTINCT x.a, y.a AS b FROM e x JOIN e y ON x.c = y.c), r AS (SELECT DISTINCT a AS id, a AS far FROM e UNION SELECT r.id, n.b FROM r JOIN n ON r.far = n.a) SELECT id, min(far) AS cluster FROM r GROUP BY 1",
)
def study_clusters(spark, sf_dir):
    """Parts that customers tie together: edges of a star for each customer, then components."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_discount >= 0.09").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("l_partkey").alias("id"), "o_custkey").distinct()
    hub = rows.groupBy("o_custkey").agg(F.min("id").alias("hub"))
    edges = rows.join(hub, "o_custkey").select(F.col("id").alias("a"), F.col("hub").alias("b")).where("a <> b")
    return min_label(rows.select("id").distinct(), edges).select("id", F.col("label").alias("cluster"))


@query("study_clusters_all")
def study_clusters_all(spark, sf_dir):
    """The clusters of ``study_clusters`` over every line, without its rule on quantity and discount; too slow as recursive SQL."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("l_partkey").alias("id"), "o_custkey").distinct()
    hub = rows.groupBy("o_custkey").agg(F.min("id").alias("hub"))
    edges = rows.join(hub, "o_custkey").select(F.col("id").alias("a"), F.col("hub").alias("b")).where("a <> b")
    return min_label(rows.select("id").distinct(), edges).select("id", F.col("label").alias("cluster"))


@query("json_field_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("doi_normalize", r"SELECT page_id, regexp_replace(regexp_replace(lower(trim('https://doi.org/' || url || '. ')), '^(https?://(dx\.)?doi\.org/|doi: *)', ''), '[.,; ]+$', '') AS doi FROM pages")
def doi_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.normal_doi(F.concat(F.lit("https://doi.org/"), "url", F.lit(". "))).alias("doi"))


@query(
    "hash_chain",
    "SELECT o_custkey, list_reduce(list_prepend('genesis', list(sha256(CAST(o_orderkey AS VARCHAR)) ORDER BY o_orderkey)), lambda a, x: sha256(a || x)) AS tip FROM orders GROUP BY 1",
)
def hash_chain(spark, sf_dir):
    """Ordered fold: every link is the digest of the link before and the record's digest."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    tip = F.aggregate("keys", F.lit("genesis"), lambda a, x: F.sha2(F.concat(a, F.sha2(x.cast("string"), 256)), 256))
    return rows.select("o_custkey", tip.alias("tip"))


@query("cohort_digest", "SELECT o_orderpriority, sha256(string_agg(DISTINCT CAST(o_custkey AS VARCHAR), chr(10) ORDER BY CAST(o_custkey AS VARCHAR)) || chr(10)) AS digest FROM orders GROUP BY 1")
def cohort_digest(spark, sf_dir):
    ids = F.sort_array(F.collect_set(F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sha2(F.concat(F.array_join(ids, "\n"), F.lit("\n")), 256).alias("digest"))


@query("contract_violations", "SELECT 'duplicate_id' AS clause, sum(n - 1)::BIGINT AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'orphan', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'unknown_label', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def contract_violations(spark, sf_dir):
    """Checks over all rows before anything is written; one row for each clause."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    twice = items.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.sum(F.col("n") - 1).alias("n"))
    orphans = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    unknown = orders.agg(F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("n"))
    named = lambda df, s: df.select(F.lit(s).alias("clause"), "n")
    return named(twice, "duplicate_id").union(named(orphans, "orphan")).union(named(unknown, "unknown_label"))
