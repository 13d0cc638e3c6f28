"""Verdicts, routes, co-citation groups and judgements over orders and lineitem.

A pair is an order, a claim a line; a line's return flag stands for the verdict:
A established, R not established, N not known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.rules import first_match, primary
from citeloom.functions.tri import count_false, count_true
from citeloom.plans.catalog import query, table

def verdict():
    return F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)


SQL_VERDICT = "CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END"


def routed(pairs: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Route of every pair from its verdicts; a pair without claims has one too."""
    per = verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("n"), count_false(F.col("established")).alias("f"), count_true(F.col("established")).alias("t"))
    n = F.coalesce("n", F.lit(0))
    route = first_match([(n == 0, "NO_CLAIMS"), (F.col("f") > 0, "F6_FLAGGED"), (F.col("t") == n, "FULL_COVERAGE")], "HELD_LOW_CONFIDENCE")
    return pairs.join(per, key, "left").select(key, n.alias("n_claims"), route.alias("route"))


def _routes(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair"), "o_orderstatus", "o_orderpriority")
    verdicts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), verdict().alias("established"))
    return pairs, routed(pairs, verdicts, "pair")


SQL_ROUTES = f"""
WITH v AS (SELECT l_orderkey AS pair, count(*) AS n, count_if(({SQL_VERDICT}) IS NOT DISTINCT FROM FALSE) AS f,
                  count_if(({SQL_VERDICT}) IS NOT DISTINCT FROM TRUE) AS t FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS pair, coalesce(n, 0) AS n_claims, o_orderstatus, o_orderpriority,
             CASE WHEN coalesce(n, 0) = 0 THEN 'NO_CLAIMS' WHEN f > 0 THEN 'F6_FLAGGED' WHEN t = n THEN 'FULL_COVERAGE' ELSE 'HELD_LOW_CONFIDENCE' END AS route
      FROM orders LEFT JOIN v ON pair = o_orderkey)
"""


@query("route_per_pair", SQL_ROUTES + "SELECT pair, n_claims, route FROM r")
def route_per_pair(spark, sf_dir):
    return _routes(spark, sf_dir)[1]


@query("route_distribution", SQL_ROUTES + "SELECT route, count(*) AS n FROM r GROUP BY 1")
def route_distribution(spark, sf_dir):
    return _routes(spark, sf_dir)[1].groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(
    "histogram_grouping_sets",
    SQL_ROUTES + "SELECT route, o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM r GROUP BY GROUPING SETS ((route), (o_orderstatus), (o_orderpriority))",
)
def histogram_grouping_sets(spark, sf_dir):
    """Three histograms from one scan."""
    pairs, routes = _routes(spark, sf_dir)
    one = F.explode(F.array(*[F.struct(*[(F.col(c) if c == k else F.lit(None).cast("string")).alias(n) for c, n in COLUMNS]) for k, _ in COLUMNS]))
    return pairs.join(routes, "pair").groupBy(*[c for c, _ in COLUMNS]).agg(F.count(F.lit(1)).alias("n")).select(one.alias("x"), "n").groupBy("x").agg(F.sum("n").alias("n")).select("x.*", "n")


COLUMNS = (("route", "route"), ("o_orderstatus", "status"), ("o_orderpriority", "priority"))


SQL_BUCKET = "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'contradicted' WHEN l_discount < 0.02 THEN 'off_topic' WHEN l_tax > 0.06 THEN 'unconfirmed_specific' WHEN l_returnflag <> 'N' THEN 'established' ELSE 'unjudged' END"


def bucket():
    """Bucket of a verdict, first match wins."""
    return first_match(
        [
            ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "contradicted"),
            (F.col("l_discount") < 0.02, "off_topic"),
            (F.col("l_tax") > 0.06, "unconfirmed_specific"),
            (F.col("l_returnflag") != "N", "established"),
        ],
        "unjudged",
    )


@query("coverage_bucket_counts", f"SELECT {SQL_BUCKET} AS bucket, count(*) AS n, count(DISTINCT l_orderkey) AS pairs FROM lineitem GROUP BY 1")
def coverage_bucket_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("pairs"))


SQL_CLAIMS = f"""
WITH c AS (SELECT l_orderkey AS grp, l_linenumber AS claim, count(*) AS n_members, count_if(b = 'established') AS covered, count_if(b <> 'unjudged') AS judged,
                  count_if(b = 'contradicted') AS contradicted, list_sort(list(DISTINCT l_suppkey) FILTER (b = 'established')) AS who
           FROM (SELECT *, {SQL_BUCKET} AS b FROM lineitem) GROUP BY 1, 2),
g AS (SELECT grp, claim, CASE WHEN covered > 0 THEN 'covered' WHEN judged > 0 THEN 'uncovered' ELSE 'unknown' END AS status, n_members, contradicted,
             coalesce(array_to_string(who, ','), '') AS covered_by FROM c)
"""


def _group_rows(spark, sf_dir):
    """Rows dealt by group once: what is counted by group and claim, or member, is then counted in place."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", bucket().alias("b")).repartition("l_orderkey")


def _group_claims(spark, sf_dir):
    rows = _group_rows(spark, sf_dir)
    covered, judged = F.count_if(F.col("b") == "established"), F.count_if(F.col("b") != "unjudged")
    return rows.groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("claim")).agg(
        first_match([(covered > 0, "covered"), (judged > 0, "uncovered")], "unknown").alias("status"),
        F.count(F.lit(1)).alias("n_members"),
        F.count_if(F.col("b") == "contradicted").alias("contradicted"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("b") == "established", F.col("l_suppkey")))).cast("array<string>"), ",").alias("covered_by"),
    )


@query("group_claim_coverage", SQL_CLAIMS + "SELECT * FROM g")
def group_claim_coverage(spark, sf_dir):
    return _group_claims(spark, sf_dir)


@query(
    "group_record",
    SQL_CLAIMS + "SELECT grp, count(*) AS claims, count_if(status = 'covered') AS covered, count_if(status = 'uncovered') AS uncovered, count_if(status = 'unknown') AS unknown, max(n_members) AS size FROM g GROUP BY 1",
)
def group_record(spark, sf_dir):
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return _group_claims(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("claims"), count("covered"), count("uncovered"), count("unknown"), F.max("n_members").alias("size"))


@query("group_size_distribution", "SELECT size, count(*) AS groups FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) GROUP BY 1")
def group_size_distribution(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


@query(
    "member_route",
    SQL_CLAIMS
    + f""", m AS (SELECT l_orderkey AS grp, l_suppkey AS member, count(*) AS n, list(DISTINCT b) AS bs FROM (SELECT *, {SQL_BUCKET} AS b FROM lineitem) GROUP BY 1, 2),
    a AS (SELECT grp, count_if(status = 'uncovered') AS uncovered, count_if(status = 'unknown') AS unknown FROM g GROUP BY 1),
    s AS (SELECT grp, count(*) AS size FROM m GROUP BY 1)
    SELECT m.grp, member, CASE WHEN size <= 1 THEN 'solo' WHEN list_contains(bs, 'unjudged') THEN 'solo' WHEN bs = ['established'] THEN 'solo'
      WHEN list_contains(bs, 'contradicted') THEN 'solo' WHEN bs = ['off_topic'] THEN 'UNSUPPORTED_MEMBER' WHEN uncovered > 0 THEN 'GROUP_COVERAGE_GAP' WHEN unknown > 0 THEN 'solo' ELSE 'GROUP_COVERED' END AS route
    FROM m JOIN a ON a.grp = m.grp JOIN s ON s.grp = m.grp""",
)
def member_route(spark, sf_dir):
    rows = _group_rows(spark, sf_dir)
    members = rows.groupBy(F.col("l_orderkey").alias("grp"), F.col("l_suppkey").alias("member")).agg(F.collect_set("b").alias("bs"))
    gaps = _group_claims(spark, sf_dir).groupBy("grp").agg(F.count_if(F.col("status") == "uncovered").alias("uncovered"), F.count_if(F.col("status") == "unknown").alias("unknown"))
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    only = lambda b: (F.size("bs") == 1) & F.array_contains("bs", b)
    route = first_match(
        [
            (F.col("size") <= 1, "solo"),
            (F.array_contains("bs", "unjudged"), "solo"),
            (only("established"), "solo"),
            (F.array_contains("bs", "contradicted"), "solo"),
            (only("off_topic"), "UNSUPPORTED_MEMBER"),
            (F.col("uncovered") > 0, "GROUP_COVERAGE_GAP"),
            (F.col("unknown") > 0, "solo"),
        ],
        "GROUP_COVERED",
    )
    return members.join(gaps, "grp").join(sizes, "grp").select("grp", "member", route.alias("route"))


SQL_JUDGED = f"""
WITH a AS (SELECT l_orderkey AS pair, count(*) AS n, count_if(l_returnflag = 'R' AND l_linestatus = 'O') AS f6, count_if(l_tax >= 0.08) AS f4,
                  count_if(l_returnflag = 'A') AS ok, count_if(l_quantity >= 50) AS f7, count_if(l_discount >= 0.1) AS f5, count_if(l_returnflag = 'N') AS unknown FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey AS pair, o_orderstatus, coalesce(n, 0) AS n, coalesce(unknown, 0) AS unknown,
             list_filter([CASE WHEN f7 > 0 THEN 'F7' END, CASE WHEN f6 > 0 THEN 'F6' END, CASE WHEN f4 > 0 THEN 'F4' END, CASE WHEN ok = n AND o_orderpriority = '1-URGENT' THEN 'F3' END,
                          CASE WHEN f5 > 0 AND ok > 0 THEN 'F5' END], lambda x: x IS NOT NULL) AS findings
      FROM orders LEFT JOIN a ON a.pair = o_orderkey),
j AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'OUTSIDE_BAND' WHEN n = 0 OR unknown > 0 THEN 'HELD' ELSE 'TERMINAL' END AS state FROM f)
"""


def _judged(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    hit = lambda c, n: F.count_if(c).alias(n)
    a = rows.groupBy(F.col("l_orderkey").alias("pair")).agg(
        F.count(F.lit(1)).alias("k"),
        hit((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "f6"),
        hit(F.col("l_tax") >= 0.08, "f4"),
        hit(F.col("l_returnflag") == "A", "ok"),
        hit(F.col("l_quantity") >= 50, "f7"),
        hit(F.col("l_discount") >= 0.1, "f5"),
        hit(F.col("l_returnflag") == "N", "open_claims"),
    )
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "pair")
    all_ok = (F.col("ok") == F.col("k")) & (F.col("o_orderpriority") == "1-URGENT")
    found = [(F.col("f7") > 0, "F7"), (F.col("f6") > 0, "F6"), (F.col("f4") > 0, "F4"), (all_ok, "F3"), ((F.col("f5") > 0) & (F.col("ok") > 0), "F5")]
    findings = F.array_compact(F.array(*[F.when(c, F.lit(f)) for c, f in found]))
    n, unknown = F.coalesce("k", F.lit(0)), F.coalesce("open_claims", F.lit(0))
    state = first_match([(F.col("o_orderstatus") == "P", "OUTSIDE_BAND"), ((n == 0) | (unknown > 0), "HELD")], "TERMINAL")
    return orders.join(a, "pair", "left").select("pair", "o_orderstatus", n.alias("n"), findings.alias("findings"), state.alias("state"))


@query(
    "judgment_hierarchy",
    SQL_JUDGED + "SELECT pair, state, CASE WHEN state = 'OUTSIDE_BAND' THEN '' ELSE array_to_string(findings, ',') END AS findings, CASE WHEN state = 'TERMINAL' THEN coalesce(findings[1], 'accurate') END AS primary_label FROM j",
)
def judgment_hierarchy(spark, sf_dir):
    """Findings are kept under a hold; the primary label is given only to terminal pairs."""
    label = F.when(F.col("state") == "TERMINAL", F.coalesce(primary(F.col("findings")), F.lit("accurate")))
    shown = F.when(F.col("state") == "OUTSIDE_BAND", "").otherwise(F.array_join("findings", ","))
    return _judged(spark, sf_dir).select("pair", "state", shown.alias("findings"), label.alias("primary_label"))


@query(
    "terminal_outcome",
    SQL_JUDGED
    + """SELECT outcome, reason, count(*) AS n FROM (SELECT CASE WHEN state = 'OUTSIDE_BAND' THEN 'UNJUDGEABLE' WHEN len(findings) > 0 THEN findings[1] WHEN n = 0 THEN 'NONE' WHEN state = 'HELD' THEN 'UNJUDGEABLE' ELSE 'NONE' END AS outcome,
      CASE WHEN state = 'OUTSIDE_BAND' THEN 'preband_excluded' WHEN len(findings) > 0 THEN 'taxonomy_finding' WHEN n = 0 THEN 'no_claims' WHEN state = 'HELD' THEN 'held' ELSE 'all_stages_ran' END AS reason FROM j) GROUP BY 1, 2""",
)
def terminal_outcome(spark, sf_dir):
    some = F.size("findings") > 0
    outside, none, held = F.col("state") == "OUTSIDE_BAND", F.col("n") == 0, F.col("state") == "HELD"
    outcome = F.when(outside, "UNJUDGEABLE").when(some, primary(F.col("findings"))).when(none, "NONE").when(held, "UNJUDGEABLE").otherwise("NONE")
    reason = first_match([(outside, "preband_excluded"), (some, "taxonomy_finding"), (none, "no_claims"), (held, "held")], "all_stages_ran")
    return _judged(spark, sf_dir).groupBy(outcome.alias("outcome"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
