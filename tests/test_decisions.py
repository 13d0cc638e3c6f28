"""Decision tables on small truth tables, and the text folds."""

import pytest
from pyspark.sql import functions as F

from citeloom.functions import folding
from citeloom.operators import decisions as d
from citeloom.operators.graph import min_label
from citeloom.operators.ranking import spread_rank, wilson


def answers(spark, schema, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_coverage(spark):
    schema = "c boolean, e boolean, u int, k boolean"
    rows = [(True, True, 0, True), (False, None, 0, True), (False, True, 1, True), (False, True, 0, None), (False, False, 0, False), (False, False, 0, None)]
    c, e, u, k = map(F.col, "ceuk")
    assert answers(spark, schema, rows, d.coverage_by_abstract(c, e, u)) == [False, None, None, True, None, None]
    assert answers(spark, schema, rows, d.coverage_by_full_text(c, e, u, k)) == [False, False, False, True, None, None]
    assert answers(spark, schema, rows, d.coverage_bucket(c, e, u)) == ["contradicted", None, "unconfirmed_specific", "established", "off_topic", "off_topic"]
    assert answers(spark, "v boolean, c boolean", [(False, False), (False, True), (True, False), (None, None)], d.absence_guard(F.col("v"), F.col("c"))) == [None, False, True, None]


def test_providers(spark):
    rows = [("found", "absent", None, None), ("absent", "found", "absent", "absent"), ("absent",) * 4, ("absent", "absent", "absent", "error"), ("found", "found", "error", "absent"), ("conflict", "found", "found", "found")]
    got = answers(spark, "a string, b string, c string, d string", rows, d.exact_doi(*map(F.col, "abcd")))
    assert got == ["conflict", "found_no_metadata", "answered_absent", "incomplete", "found", "conflict"]
    assert answers(spark, "h int, r boolean", [(None, False), (200, True), (200, False), (404, False), (503, False)], d.fetch_status(F.col("h"), F.col("r"))) == ["not_attempted", "answered_record", "answered_absent", "answered_absent", "resolver_error"]


def test_dates_and_patterns(spark):
    rows = [(None, None), (None, "2020-01-01"), ("2020-02-01", "2020-01-01"), ("2020-01-01", "2020-01-31"), ("2021-01-01", "2021-02-01"), ("2020-01-01", "2021-01-01")]
    low, high = F.col("a").cast("date"), F.col("b").cast("date")
    assert answers(spark, "a string, b string", rows, d.date_state(low, high, F.lit("2020-06-30").cast("date"))) == ["absent", "unparseable", "unparseable", "compared", "after_cutoff", "boundary_uncertain"]
    rows = [(1, 0, 0, False), (0, 1, 1, False), (0, 2, 0, False), (0, 1, 0, True), (0, 0, 3, True), (0, 0, 0, True), (0, 0, 0, False)]
    got = answers(spark, "m int, o int, c int, u boolean", rows, d.evidence_pattern(*map(F.col, "mocu")))
    assert got == ["mixed_evidence", "mixed_evidence", "multiple_opposition", "single_opposition", "confirmation_only_found", "unassessable", "no_controversy_found"]
    assert answers(spark, "s string", [("qualified",), ("clear",), ("unresolved",), (None,)], d.retracted(F.col("s"))) == [True, False, None, None]


def test_relations(spark):
    rows = [(True, False, False, False, False, True), (False, True, True, False, False, False), (False, True, False, False, False, True), (False, False, True, False, False, False)]
    assert answers(spark, ", ".join(f"c{i} boolean" for i in range(6)), rows, d.study_relation(*[F.col(f"c{i}") for i in range(6)])) == ["not_independent", "not_independent", "independent", "unknown"]


def test_components_and_intervals(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(9, 8), (8, 11)], "a long, b long")
    assert dict(map(tuple, min_label(nodes, edges).collect())) == dict.fromkeys(range(7), 0) | {7: 7, 8: 8, 9: 8, 10: 10, 11: 8}
    assert {r.id: r.label for r in min_label(nodes, edges.limit(0)).collect()} == {i: i for i in range(12)}
    low, high = wilson(F.col("k"), F.col("n"))
    assert answers(spark, "k int, n int", [(74, 80), (0, 0), (5, 5), (0, 5)], F.struct(low, high)) == [(0.8459, 0.9652), (0.0, 0.0), (0.5655, 1.0), (0.0, 0.4345)]


def test_components_of_chains_and_cycles_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    up = {i: i for i in range(150)}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    got = dict(map(tuple, min_label(spark.range(150), spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {i: top(i) for i in range(150)}


def test_ranks_over_stretches_equal_one_window(spark):
    rows = [(k, i * 7 % 50 / 2, i) for k in ("a", "b") for i in range(200 if k == "a" else 3)]
    got = spread_rank(spark.createDataFrame(rows, "k string, v double, id int"), "k", "v", "id", parts=8).collect()
    for k in ("a", "b"):
        want = {i: n for n, (_, i) in enumerate(sorted((-v, i) for kk, v, i in rows if kk == k), 1)}
        assert {r.id: r["rank"] for r in got if r.k == k} == want


def test_ranks_hold_where_quantiles_differ_each_time_and_nulls_come_last(spark, monkeypatch):
    import random

    some = F.udf(lambda vs: sorted(random.SystemRandom().sample(vs, min(len(vs), 7))), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda by, *_: some(F.collect_list(by)))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = [("a", i * 7 % 101 / 2, i) for i in range(300)] + [(None, float(i), i) for i in range(9)] + [("b", None, 1), ("c", None, 2), ("c", 1.0, 3), ("c", 1.0, None)]
        got = spread_rank(spark.createDataFrame(rows, "k string, v double, id int"), "k", "v", "id", parts=8).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    last = lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or 0)
    want = [(*r, n) for k in ("a", "b", "c", None) for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=last), 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("text", "want"), [("Caf&eacute; <i>β</i>–x ﬁn", "Cafe  beta -x fin"), ("", "")])
def test_fold(text, want):
    assert folding.fold(text) == want
