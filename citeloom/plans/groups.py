"""Co-citation, retraction timing, caps, scores against gold, authority snapshots and packets on authored rows; expected rows by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import cocitation, later_work
from citeloom.plans.bibliography import _numbered
from citeloom.plans.catalog import example

_E, _O, _C, _U = "established", "off_topic", "contradicted", "unconfirmed_specific"
_XY = ["x", "y"]
GROUPS = [
    ("a", 0, "a1", _XY, [_E, _O]), ("a", 1, "a2", _XY, [_U, _E]), ("a", 2, "a3", _XY, [_O, _O]), ("a", 3, "a4", ["x", "z"], [_E, _E]), ("a", 4, "a5", _XY, []), ("a", 5, "a6", _XY, [_C, _E]),
    ("b", 0, "b1", ["x"], [_E]), ("c", 0, "c1", _XY, [_U, _O]), ("c", 1, "c2", _XY, [_E, _U]), ("d", 0, "d1", _XY, [_E, None]), ("d", 1, "d2", _XY, [_U]), ("d", 2, "d3", _XY, [_O, _O]),
    ("e", 0, "e1", _XY, None), ("e", 1, "e2", _XY, [None, None]),
]


@example(
    "cocited_claims", cocitation.MEMBERS, GROUPS,
    "grp string, claim string, status string, covered_by string, contradicted_by string, judged_by string",
    [
        ("a", "x", "covered", "a1", "a6", "a1,a2,a3,a6"), ("a", "y", "covered", "a2,a6", "", "a1,a2,a3,a6"), ("b", "x", "covered", "b1", "", "b1"),
        ("c", "x", "covered", "c2", "", "c1,c2"), ("c", "y", "uncovered", "", "", "c1,c2"), ("d", "x", "covered", "d1", "", "d1,d2,d3"), ("d", "y", "uncovered", "", "", "d3"),
        ("e", "x", "unknown", "", "", ""), ("e", "y", "unknown", "", "", ""),
    ],
)
def cocited_claims(df):
    out = cocitation.group_claims(cocitation.contributions(df))
    return out.withColumns({c: F.array_join(c, ",") for c in ("covered_by", "contradicted_by", "judged_by")})


@example(
    "cocited_groups", cocitation.MEMBERS, GROUPS,
    "grp string, size long, contributing long, excluded long, covered long, uncovered long, unknown long",
    [("a", 6, 4, 2, 2, 0, 0), ("b", 1, 1, 0, 1, 0, 0), ("c", 2, 2, 0, 1, 1, 0), ("d", 3, 3, 0, 1, 1, 0), ("e", 2, 1, 1, 0, 0, 2)],
)
def cocited_groups(df):
    found = cocitation.contributions(df)
    return cocitation.group_records(found, cocitation.group_claims(found))


@example(
    "cocited_exclusions", cocitation.MEMBERS, GROUPS,
    "member string, excluded string", [("a4", "atomic_claims_differ_from_group"), ("a5", "no_coverage_verdicts"), ("e1", "no_coverage_verdicts")],
)
def cocited_exclusions(df):
    return cocitation.contributions(df).where("excluded is not null")


@example(
    "cocited_routes", cocitation.MEMBERS, GROUPS,
    "member string, route string, flags string",
    [
        ("a1", "GROUP_COVERED", "1,1"), ("a2", "GROUP_COVERED", "1,1"), ("a3", "UNSUPPORTED_MEMBER", "1,1"), ("a4", "solo", ""), ("a5", "solo", ""), ("a6", "solo", "0,1"), ("b1", "solo", "1"),
        ("c1", "GROUP_COVERAGE_GAP", "1,0"), ("c2", "GROUP_COVERAGE_GAP", "1,0"), ("d1", "solo", "1,0"), ("d2", "solo", ""), ("d3", "UNSUPPORTED_MEMBER", "1,0"), ("e1", "solo", ""), ("e2", "solo", ""),
    ],
)
def cocited_routes(df):
    found = cocitation.contributions(df)
    out = cocitation.with_routes(found, cocitation.group_claims(found))
    return out.withColumn("flags", F.array_join(F.transform("flags", lambda x: x.cast("int").cast("string")), ","))


_T = {"cited": "1", "citing": "2", "cited_fetch": "ok", "citing_fetch": "ok", "citing_day": "2021-06-30", "notice": "retraction", "resolution": "flagged", "retracted_type": True, "notice_day": "2021-01-01"}


@example(
    "retraction_times", cocitation.TIMING.replace(" date", " string"),
    [(i, *(_T | x).values()) for i, x in enumerate([
        {}, {"cited": "10.1/a"}, {"citing": None}, {"cited_fetch": "error"}, {"cited_fetch": "absent"}, {"cited_fetch": "conflict"}, {"citing_fetch": "absent"}, {"citing_day": None}, {"resolution": "resolved_clear"},
        {"notice": "correction", "retracted_type": False}, {"notice": "correction"}, {"resolution": "unresolved"}, {"notice_day": "2021-05-30"}, {"notice_day": "2021-05-31"},
    ])],
    "id int, status string, gap int, reason string",
    _numbered([
        ("qualified", 180, "retracted_before_citation_31_day_floor_met"), ("not_applicable", None, "no_resolved_cited_pubmed_work"), ("unresolved", None, "work_identity_unavailable"),
        ("unresolved", None, "cited_metadata_failure"), ("not_applicable", None, "cited_pubmed_record_absent"), ("unresolved", None, "cited_metadata_conflict"), ("unresolved", None, "citing_metadata_unavailable"),
        ("unresolved", None, "citing_date_unavailable"), ("clear", None, "no_retraction_in_force_at_citation"), ("clear", None, "only_non_retraction_notice_in_force"),
        ("unresolved", None, "retraction_notice_or_date_unresolved"), ("unresolved", None, "retraction_notice_or_date_unresolved"), ("qualified", 31, "retracted_before_citation_31_day_floor_met"),
        ("timing_indeterminate", 30, "retraction_to_citation_gap_below_31_days"),
    ]),
)
def retraction_times(df):
    dated = df.withColumns({c: F.col(c).cast("date") for c in ("citing_day", "notice_day")})
    return dated.withColumn("x", cocitation.retraction_time(F.col)).select("id", "x.*")


@example(
    "retried_timings", "pair string, attempt int, status string, retryable boolean", [("a", 1, "unresolved", True), ("a", 2, "qualified", False), ("b", 1, "unresolved", True), ("b", 2, "unresolved", True), ("b", 3, "clear", False), ("c", 1, "clear", False), ("c", 2, "x", False)],
    "pair string, attempt int, status string", [("a", 2, "qualified"), ("b", 2, "unresolved"), ("c", 1, "clear")],
)
def retried_timings(df):
    return cocitation.after_retries(df, "pair")


@example(
    "capped_candidates", "claim int, work int", [(1, i) for i in range(7)] + [(2, 9)],
    "claim int, work int, pool long, truncated boolean", [(1, 0, 7, True), (1, 1, 7, True), (2, 9, 1, False)],
)
def capped_candidates(df):
    return cocitation.capped(df, "claim", F.col("work"), cap=2)


@example(
    "scored_predictions", "citation_id string, band string", [("a", "HIGH"), ("b", "LOW"), ("c", "HIGH"), ("d", "LOW")],
    "citation_id string, band string, label_correct boolean, secondary_correct boolean, exact boolean", [("a", "HIGH", True, True, True), ("b", "LOW", False, True, False), ("c", "HIGH", True, False, False)],
)
def scored_predictions(df):
    make, schema = df.sparkSession.createDataFrame, "citation_id string, label string, secondary string"
    return cocitation.scored(df, make([("a", "F2", None), ("b", "F2", None), ("c", "F6", "F4"), ("x", "F2", None)], schema), make([("a", "F2", None), ("b", "F1", None), ("c", "F6", None), ("d", "F6", None)], schema))


_RECORDS = [
    ("E1", "Tumor protein 53", "active", "2000-01-01", None, [("TP53", "hgnc", "symbol", True, "1999-01-01", None), ("p53", "x", "text", False, "2000-01-01", None), ("TRP53", "x", "old", True, "2000-01-01", "2010-12-31")]),
    ("E2", "Old thing", "withdrawn", "2000-01-01", "2012-01-01", [("thing", "x", "text", True, "2000-01-01", None)]), ("E3", "Thing  one", "active", "2005-01-01", None, [("thing", "x", "text", True, "2000-01-01", None)]),
    ("E4", "Thing two", "active", "2015-01-01", None, [("thing", "x", "text", True, "2000-01-01", None)]),
]


@example(
    "snapshot_lookups", cocitation.SNAPSHOT, [("gene", "2020-01-01", _RECORDS, [])],
    "surface string, day string, entity string, state string, exact boolean",
    [
        ("tumor  Protein 53", "2019-01-01", "E1", "resolved", True), ("TP53", "1999-06-01", None, "unresolved", False), ("TP53", "2001-06-01", "E1", "resolved", False), ("p53", "2001-06-01", None, "unresolved", False),
        ("trp53", "2010-12-31", "E1", "resolved", False), ("trp53", "2011-01-01", None, "unresolved", False), ("thing", "2010-01-01", "E3", "resolved", False), ("thing", "2016-01-01", None, "ambiguous", False), ("Old thing", "2010-01-01", None, "unresolved", False),
    ],
)
def snapshot_lookups(df):
    asked = [("tumor  Protein 53", "2019-01-01"), ("TP53", "1999-06-01"), ("TP53", "2001-06-01"), ("p53", "2001-06-01"), ("trp53", "2010-12-31"), ("trp53", "2011-01-01"), ("thing", "2010-01-01"), ("thing", "2016-01-01"), ("Old thing", "2010-01-01")]
    found = cocitation.valid_at(cocitation.snapshot_mappings(df), df.sparkSession.createDataFrame(asked, "surface string, day string"))
    return later_work.normalised(found, "surface", "day")


@example(
    "review_packets", "citation_id string, sentence string, claim_index int, claim string, span string", [("P:1", "It rose and fell.", 1, "It fell.", None), ("P:1", "It rose and fell.", 0, "It rose.", "a rise"), ("P:2", "Dry.", 0, "It was dry.", "")],
    "citation_id string, markdown string", [("P:1", '## P:1\n\nIt rose and fell.\n\n- It rose.\n  > "a rise"\n- It fell.\n'), ("P:2", "## P:2\n\nDry.\n\n- It was dry.\n")],
)
def review_packets(df):
    return cocitation.packet(df)


_P = {"canonical": True, "missing": 0, "parse_failures": 0, "code_commit": "c", "model": "m", "declared": "a", "corpus": "a", "out_files": 0, "genesis": None, "resumed": False, "max_docs": None}


@example(
    "production_preflights", cocitation.PREFLIGHT,
    [(i, *(_P | x).values()) for i, x in enumerate([{}, {"canonical": None, "missing": 2}, {"code_commit": " ", "model": None, "corpus": ""}, {"declared": None}, {"declared": "b"}, {"out_files": 1, "genesis": "x", "resumed": True, "max_docs": 5}, {"parse_failures": 1}])],
    "id int, problems string",
    _numbered(["", "disposition_not_canonical,ids_missing", "no_code_commit,no_model,no_corpus_manifest", "corpus_not_declared", "corpus_mismatch", "out_dir_not_empty,extends_a_segment,resumed,limited", "documents_not_parsed"]),
)
def production_preflights(df):
    return df.withColumn("problems", F.array_join(cocitation.preflight(F.col), ","))
