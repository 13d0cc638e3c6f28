"""Cached records, repairs, profiles, queues, packets, tallies and clauses on authored rows; the expected rows are stated by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import evidence
from citeloom.plans.bibliography import _numbered
from citeloom.plans.catalog import example


@example(
    "cached_occurrences", "source string, citation_id string, pmid string", [("P1", "P1:a", "10"), ("P1", "P1:b", "10"), ("P2", "P2:a", "10"), ("P2", "P2:c", "11"), ("P3", "P3:a", "12")],
    "source string, citation_id string, pmid string, title string",
    [("P1", "P1:a", "10", "one"), ("P1", "P1:b", "10", "one"), ("P2", "P2:c", "11", "two"), ("P3", "P3:a", "12", "three")],
)
def cached_occurrences(df):
    cache = [("P1", "10", ("one",)), ("P1", "10", ("one",)), ("", "11", ("two",)), (None, "12", ("three",)), ("P9", "12", ("x",)), ("P3", "", ("y",))]
    cache = df.sparkSession.createDataFrame(cache, "source string, pmid string, rec struct<title: string>")
    return evidence.occurrences_of_cache(df, cache).withColumn("title", F.col("rec.title"))


@example(
    "repair_outcomes", evidence.REPAIR,
    _numbered([
        (True, [("cited_doi", "10.1/a", 0.1, False)], 0, 0), (False, [("cited_doi", "10.1/a", 0.1, True)], 0, 0), (False, [("pubmed", "10.1/a", 0.95, False), ("candidates", "10.1/b", 1.0, True)], 0, 0),
        (False, [("candidates", None, 0.9, None)], 1, 0), (False, [("candidates", "10.1/c", 0.89, None)], 1, 2), (False, [], 2, 1), (None, [], 0, 1), (None, [], 0, 0),
    ]),
    "id int, outcome string, source string, doi string",
    _numbered([
        ("not_f2", "biorxiv_relation", None), ("not_f2", "cited_doi", None), ("f2_with_repair", "pubmed", "10.1/a"), ("not_f2", "candidates", None), ("f2_with_repair", "candidates", "10.1/c"),
        ("ambiguous_multiple", "", None), ("undetermined", "", None), ("unscoreable", "", None),
    ]),
)
def repair_outcomes(df):
    return df.withColumn("x", evidence.repair_outcome(F.col)).select("id", "x.*")


_CAND = [
    (1, "clear", "QUALIFYING", "independent", "c1", "rct", 0.9, False), (1, "clear", "QUALIFYING", "independent", "c1", "case_control", 0.4, False), (1, "clear", "QUALIFYING", "independent", "c2", "rct", 0.5, False),
    (2, "clear", "confirming", "independent", "c3", "rct", 0.7, False), (2, "clear", "QUALIFYING", "unknown", "c4", "rct", 0.8, False), (3, "clear", "confirming", "not_independent", "c5", "rct", 0.6, False),
    (4, "unresolved", "QUALIFYING", "independent", "c6", "rct", 0.9, False), (5, "clear", "no", "independent", "c7", "rct", 0.9, False), (6, "clear", "borderline", "not_independent", "c8", "rct", 0.2, False),
    (7, "clear", "no", "independent", "c9", "rct", 0.2, True), (8, "clear", "mixed", "independent", "c1", "rct", None, False), (9, "clear", "QUALIFYING", "independent", "c1", "rct", 0.3, True),
]


@example(
    "evidence_profiles", "claim int, notice string, state string, independence string, cluster string, tier string, confidence double, open boolean", _CAND,
    "claim int, opposing long, confirming long, mixed long, uncertain long, opposing_clusters long, confirming_clusters long, tiers string, best double, pattern string",
    [
        (1, 3, 0, 0, 0, 2, 0, "case_control|rct", 0.9, "multiple_opposition"), (2, 1, 1, 0, 0, 0, 1, "rct", 0.8, "mixed_evidence"), (3, 0, 1, 0, 0, 0, 0, "", 0.6, "confirmation_only_found"),
        (4, 0, 0, 0, 1, 0, 0, "", None, "unassessable"), (5, 0, 0, 0, 0, 0, 0, "", None, "no_controversy_found"), (6, 0, 0, 0, 0, 0, 0, "", None, "no_controversy_found"),
        (7, 0, 0, 0, 0, 0, 0, "", None, "unassessable"), (8, 0, 0, 1, 0, 0, 0, "", None, "mixed_evidence"), (9, 1, 0, 0, 0, 1, 0, "rct", 0.3, "single_opposition"),
    ],
)
def evidence_profiles(df):
    rows = df.withColumn("category", evidence.candidate_category(F.col("notice"), F.col("state"), F.col("independence")))
    return evidence.evidence_profile(rows, "claim").withColumn("tiers", F.array_join("opposing_tiers", "|"))


@example(
    "review_queues", "claim int, work string, disposition string",
    [(1, "a", "surface"), (1, "b", "surface"), (1, "c", "do_not_surface"), (2, "d", "unassessable"), (5, "e", "do_not_surface")],
    "claim int, work string, kind string",
    [(1, "a", "candidate_review"), (1, "b", "candidate_review"), (2, None, "controversy_bundle_reference"), (3, None, "controversy_bundle_reference")],
)
def review_queues(df):
    claims = [(1, "x", True, "eligible"), (2, "x", True, "eligible"), (3, "x", False, "uncertain"), (4, "x", False, "not_applicable"), (5, None, True, "eligible")]
    return evidence.review_queue(df, df.sparkSession.createDataFrame(claims, "claim int, bundle string, search_complete boolean, applicability string"))


@example(
    "disposition_tallies", "claim int, disposition string", [(1, "surface"), (1, "do_not_surface"), (2, "surface"), (3, "unassessable"), (3, None)],
    "disposition string, n long", [("surface", 2), ("do_not_surface", 1), ("unassessable", 1)],
)
def disposition_tallies(df):
    return df.where("disposition in ('surface', 'do_not_surface', 'unassessable')").groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@example("negative_reasons", "id int, status string", _numbered(["ok", "failure", None]), "id int, reason string", _numbered(["no_evidence_found", "retrieval_failed", "retrieval_failed"]))
def negative_reasons(df):
    return df.withColumn("reason", evidence.negative_reason(F.col("status")))


@example(
    "queue_leaks", "id int, claim string, more struct<final_verdict: string, note: string>", _numbered([("the verdict: x", None), ("x", ("F6", "label: y"))]),
    "id int, leaks string", _numbered(["", "final_verdict"]),
)
def queue_leaks(df):
    return df.withColumn("leaks", F.array_join(evidence.leaks(F.struct("claim", "more")), ","))


@example(
    "distinct_data", "id int, cited string, candidate string",
    _numbered([
        ("We used Cohort ALPHA.", "Trial BETA began. No patients were recruited from cohort ALPHA."),
        ("We used Cohort ALPHA.", "No patients were recruited from cohort ALPHA."),
        ("We used Cohort ALPHA.", "Trial BETA is a subset of cohort ALPHA. No data came from ALPHA."),
        ("We used Cohort ALPHA.", "Trial BETA began elsewhere, in ALPHA too."),
        ("See NCT01234567.", "Study GAMMA. Participants did not overlap with those of nct01234567! End."),
        (None, "Trial BETA. No data came from it."),
    ]),
    "id int, said string", _numbered(["No patients were recruited from cohort ALPHA.", None, None, None, "Participants did not overlap with those of nct01234567!", None]),
)
def distinct_data(df):
    return df.withColumn("said", evidence.distinct_data(F.col("cited"), F.col("candidate")))


@example(
    "source_packets", "pmid string, ord int, label string, title string, text string", [("1", 2, "Results", "", "It rose."), ("1", 1, "methods", "Digging", "We dug."), ("1", 3, "results", "More", "Then fell."), ("1", 0, "table", "T1", "a | b"), ("2", 0, "other", None, "x")],
    "pmid string, methods string, results string, other string, mismatched long, gaps string",
    [("1", "[methods] Digging\nWe dug.", "[results]\nIt rose.\n\n[results] More\nThen fell.", "[table] T1\na | b", 0, ""), ("2", None, None, "[other]\nx", 1, "methods,results")],
)
def source_packets(df):
    hashed = df.withColumn("sha256", F.when(F.col("pmid") == "2", "0").otherwise(F.sha2("text", 256)))
    return evidence.source_packet(hashed).withColumn("gaps", F.array_join(evidence.fact_gaps(F.col), ","))


@example(
    "high_band_rates", "verdict string", [(x,) for x in ["match", "match", "review_formatting", "review_wrong_paper", "review_same_work_variant", "unscoreable", "unresolved", "out_of_scope_cross_language", None]],
    "high long, scoreable long, same_work long, unscoreable long, unresolved long, cross_language long, rate double", [(1, 4, 1, 1, 1, 1, 0.25)],
)
def high_band_rates(df):
    return evidence.high_band(df)


@example(
    "marker_tallies", "group_id string, style string, runs int",
    [("g1", "numeric", 2), ("g1", "numeric", 2), ("g2", "numeric", 1), ("g2", "numeric", 1), ("g3", "author-year", 2), ("g3", "author-year", 2), ("g4", "numeric", 1), (None, "numeric", 1), ("", "numeric", 1)],
    "sentences long, multi_reference long, multi_run long, numeric_multi_reference long, numeric_multi_run long", [(4, 3, 2, 2, 1)],
)
def marker_tallies(df):
    return evidence.marker_tallies(df)


@example(
    "scope_tallies", "document string, status string, reason string, n_claims int, n_asked int", [("d", "scoped", "", 3, 1), ("d", "scoped", "", 2, 2), ("d", "whole_sentence", "ambiguous", 2, 2)],
    "document string, status string, reason string, pairs long, asked long, not_asked long", [("d", "scoped", "", 2, 3, 2), ("d", "whole_sentence", "ambiguous", 1, 2, 0)],
)
def scope_tallies(df):
    return evidence.scope_tallies(df)


_RUN = {
    "status": "complete", "canonical": True, "attested": ["F1", "F2", "F8"], "missing": 0, "disposition_corpus": "a", "run_corpus": "a", "code_commit": "c", "model": "m", "temperature": "0.0", "judged": 5,
    "accounted": True, "parse_failures": 0, "stable": True, "segment": False, "total": 5, "chained": 5, "written": 5, "duplicates": 0, "domain_matches": True, "queue_matches": True, "review_matches": None,
    "disjoint": None, "findings": ["F6", "F4"], "provenance": ["F4"],
}


@example(
    "reportability", evidence.MANIFEST,
    [(i, *(_RUN | x).values()) for i, x in enumerate([
        {}, {"status": "running", "attested": ["F1", "F8"]}, {"missing": 2, "run_corpus": "b"}, {"temperature": None, "model": " "}, {"temperature": "warm"}, {"written": 4}, {"judged": 0, "accounted": False, "duplicates": 1},
        {"findings": ["F3", "F7"], "provenance": ["F7"]}, {"segment": True, "disjoint": False, "queue_matches": None},
    ])],
    "id int, failed string",
    _numbered([
        "", "status_complete,F2_attested", "full_coverage,corpus_cross_bound", "model_recorded,temperature_recorded,temperature_legal", "temperature_legal", "counters_match_file",
        "pairs_judged,terminal_outcomes_accounted,unique_citation_ids", "F3_provenance", "single_segment,queue_matches_findings,queues_disjoint",
    ]),
)
def reportability(df):
    return df.withColumn("failed", F.array_join(evidence.clauses(F.col), ","))
